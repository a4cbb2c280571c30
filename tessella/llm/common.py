"""Shared helpers: table access, Arrow slicing, vectorised word hashing over raw UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Bytes of text that one vectorised step takes at most, unless a single text is longer.
STEP_BYTES = 2 << 20
#: Bytes that word hashing expands to numbers at a time, unless a single word is longer.
SEGMENT = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation.

    The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "llm")
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts back to back, and each text's start with the end of the last; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _release() -> None:
    """Give freed memory back to the system, so workers that live on don't add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding at most `limit` bytes in column `text`, one row at least."""
    done = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = utf8(batch.column(text))[1]
        row = 0
        while row < batch.num_rows:
            to = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, to - row)
            row = to
        done += batch.nbytes
        if done > 16 * STEP_BYTES:
            done = 0
            _release()
    _release()  # idle workers keep nothing


def binary_column(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over one buffer cut at the offsets."""
    raw = np.ascontiguousarray(data).view(np.uint8) if isinstance(data, np.ndarray) else data
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


# Word hashing. A word's hash is a polynomial over its bytes, each byte replaced by a 64-bit value, then mixed.
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words between ASCII white space.
PLAIN = ~SPACE
#: Words of ASCII letters, digits and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: 64-bit value of each byte, of its lower-case form for A-Z.
BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))[LOWER]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        factor = np.full(max(n, 1 << 16), BASE if which == "up" else INVERSE, np.uint64)
        factor[0] = 1
        have = _powers[which] = np.cumprod(factor, dtype=np.uint64)
    return have[:n]


def words(raw: np.ndarray, at: np.ndarray, kind: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes of the kind, never across texts."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kind[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased; some SEGMENT bytes at a time, as values take 32 bytes for each."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        base = starts[k]
        to = max(k + 1, int(np.searchsorted(starts, base + SEGMENT)))
        part, s, e = raw[base : ends[to - 1]], starts[k:to] - base, ends[k:to] - base
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * powers("up", len(part)), out=sums[1:])
        out[k:to] = mix((sums[e] - sums[s]) * powers("down", len(part))[s] + (e - s).astype(np.uint64))
        k = to
    return out


def hash_word(word: str) -> int:
    """word_hashes of one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n consecutive values."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xC6BC279692B5C323) + hashes[k : k + size]
    return mix(out)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def spread(df: DataFrame, key: str, size: int, part: int = 16 << 20) -> DataFrame:
    """df by key in parts of `part` bytes where that takes more of them than the session's shuffles make."""
    parts = size // part
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def blocked(rows: DataFrame, key: str, item: str, block: int, counts: DataFrame | None = None, loose: str | None = None) -> DataFrame:
    """rows with own, i, j: groups of `key` of over `block` rows fall into blocks, and every two blocks meet in one (key, i, j).

    Groups of one row are left out. counts: (key, n), if there is a cheaper way to them than the rows. With a column
    `loose`, blocks hold either rows for which it is true or others, and the others' blocks don't meet each other.
    """
    place, zero = F.xxhash64(item), F.lit(0).cast("long")
    if loose is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
        sizes = stored(counts.where("n > 1").select(key, F.ceil(F.col("n") / block).alias("_a")))
        rows = rows.join(sizes, key).withColumn("own", F.pmod(place, F.col("_a"))).withColumn("_last", F.col("_a") - 1)
    else:
        n = lambda c: F.ceil(F.count(F.when(c, 1)) / block)
        sizes = stored(rows.groupBy(key).agg(n(F.col(loose)).alias("_a"), n(~F.col(loose)).alias("_b")).where("_a > 0"))
        own = F.when(F.col(loose), F.pmod(place, F.col("_a"))).otherwise(F.col("_a") + F.pmod(place, F.greatest(F.col("_b"), F.lit(1).cast("long"))))
        rows = rows.join(sizes, key).withColumn("own", own).withColumn("_last", F.when(F.col(loose), F.col("_a") + F.col("_b") - 1).otherwise(F.col("_a") - 1))
    rows = rows.withColumn("_other", F.explode(F.sequence(zero, "_last")))
    return rows.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_other", "_a", "_b", "_last")
