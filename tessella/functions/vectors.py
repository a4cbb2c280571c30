"""Vectors: cosine, the byte form, and a deterministic stand-in embedder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision as a float; 0 for unequal lengths and zero vectors."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(_dot(a, b) / norm).cast("float")


def fake_embedding(text: Column, dim: int = 64) -> Column:
    """A unit vector that depends on the text alone: components from digests of the text and their number."""
    part = lambda i: F.conv(F.substring(F.sha2(F.concat(text, F.lit("|"), i.cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(2147483648.0) - 1.0
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), part)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: (x / norm).cast("float"))


def encode_vector(values) -> bytes:
    """Little-endian 32-bit floats."""
    return np.asarray(values, "<f4").tobytes()


def decode_vector(data: bytes) -> list[float]:
    return np.frombuffer(data, "<f4").tolist()
