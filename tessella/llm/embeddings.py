"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A table rotates each vector several times by random signs and a Hadamard transform; a rotation's hash is the axis
(with sign) that the vector comes closest to, and a bucket joins the hashes of the rotations. The last rotation looks at
as few of its axes as give buckets of an even size, so buckets stay alike as the table grows. Every vector stands in its
own bucket and in those of its nearest alternatives. There are as many tables as pairs at the threshold need to share
a bucket with probability TARGET, which is measured on random pairs for the rotations in use. Vectors of a bucket are
compared exactly, in blocks.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK, binary_column, blocked, hash_word, longs, mix, stored, utf8
from .components import components, forest

THRESHOLD = 0.93
#: Share of the pairs at the threshold that meet in a bucket, at least; buckets of a vector in each table; vectors of a
#: label in a bucket at most if they lie evenly.
TARGET, PROBES, EVEN = 0.99, 4, 64
#: Vectors in a block; larger buckets are compared block by block.
BLOCK = 1024
#: Random pairs that tell how often a table lets a pair meet.
TRIALS = 4000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; columns must be a power of two."""
    rows, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(rows, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, d)
        h *= 2
    return x / math.sqrt(d)


def signs(seed: int, d: int) -> np.ndarray:
    return np.where(mix(np.arange(d, dtype=np.uint64) + np.uint64((seed + 1) << 20)) & np.uint64(1), 1.0, -1.0)


def rotations(x: np.ndarray, seed: int) -> np.ndarray:
    """One pseudo-random rotation: signs and a Hadamard transform, three times."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    for k in range(3):
        y = hadamard(y * signs(3 * seed + k, d))
    return y


def hashes(x: np.ndarray, table: int, depth: int, last: int, probes: int) -> np.ndarray:
    """Each row's bucket in a table, as 32 bits, then those of its nearest alternatives: one rotation's hash replaced."""
    axes, gaps = [], []
    for k in range(depth):
        y = rotations(x, table * 64 + k)
        y = y[:, :last] if k == depth - 1 else y
        both = np.concatenate([y, -y], axis=1)
        best = np.argsort(-both, axis=1, kind="stable")[:, :probes] if both.shape[1] <= 64 else np.argpartition(-both, probes, axis=1)[:, :probes]
        value = np.take_along_axis(both, best, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        axes.append(np.take_along_axis(best, order, 1).astype(np.uint64))
        value = np.take_along_axis(value, order, 1)
        gaps.append((value[:, :1] - value[:, 1:]) ** 2)
    choice = np.argsort(np.concatenate(gaps, 1), axis=1, kind="stable")[:, : probes - 1]
    rotation = np.repeat(np.arange(depth), [g.shape[1] for g in gaps])[choice]
    rank = np.concatenate([np.arange(1, 1 + g.shape[1]) for g in gaps])[choice]
    codes = np.full((len(x), 1 + choice.shape[1]), table, np.uint64)
    for k in range(depth):
        taken = np.concatenate([np.zeros((len(x), 1), int), np.where(rotation == k, rank, 0)], 1)
        codes = mix(codes * np.uint64(0x9E3779B97F4A7C15) + np.take_along_axis(axes[k], taken, 1))
    return codes & np.uint64(0xFFFFFFFF)


@cache
def tables_for(d: int, depth: int, last: int, probes: int, threshold: float) -> int:
    """Tables that let pairs at the threshold meet with probability TARGET, from random pairs of that cosine."""
    rng = np.random.default_rng(d)
    x, z = rng.normal(size=(2, TRIALS, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    a, b = hashes(x, 0, depth, last, probes), hashes(y, 0, depth, last, probes)
    missed = 1 - (a[:, :, None] == b[:, None, :]).any((1, 2)).mean()
    return max(1, math.ceil(math.log(1 - TARGET) / math.log(min(max(missed, 1e-9), 0.999))))


def shape(n: int, d: int, probes: int, threshold: float) -> tuple[int, int, int]:
    """Rotations, axes of the last one, and tables for n vectors of length d."""
    wide = 1 << max(0, (d - 1).bit_length())
    depth = last = 1
    while (2 * wide) ** depth * EVEN < n:
        depth += 1
    while last < wide and (2 * wide) ** (depth - 1) * 2 * last * EVEN < n:
        last *= 2
    return depth, last, tables_for(d, depth, last, probes, threshold)


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(rep, least, size, label, vector): each distinct usable vector of a label once, known by a 64-bit hash, with its smallest id."""
    v = F.col(vector_col)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(label_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("vector"))
    return stored(rows.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("size")).withColumn("rep", F.xxhash64("label", "vector")))


def links(known: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """What pairs of classes at the threshold that share a bucket come to, each pair counted once.

    (u, null, n): n vectors of other classes link with class u, summed over blocks. (u, v, null): links that connect
    what a block's links connect. Pairs themselves stay in their block.
    """
    sizes = known.groupBy(F.size("vector").alias("d"), "label").agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()  # a row for each length of vectors
    shapes = {r["d"]: shape(r["n"], r["d"], probes, threshold) for r in sizes}
    kind = np.float32 if known.schema["vector"].dataType.elementType.typeName() == "float" else np.float64

    def coded(batches):
        """Rows of a batch with vectors of one length, the vectors, and each one's buckets: (table << 32) + hash."""
        for batch in batches:
            column = batch.column("vector")
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            first = np.concatenate([[0], np.cumsum(size)])
            labels = np.array([hash_word(repr(x)) for x in batch.column("label").to_pylist()], np.uint64)
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                x = flat[first[own][:, None] + np.arange(d)]
                unit = _units(x)
                depth, last, tables = shapes[int(d)]
                salt = mix(labels[own] + np.uint64(d))[:, None]
                codes = [(np.uint64(t) << np.uint64(32)) | (mix(hashes(unit, t, depth, last, probes) ^ salt) >> np.uint64(32)) for t in range(tables)]
                yield batch, own, x, np.concatenate(codes, 1)

    def counted(batches):
        for _, _, _, codes in coded(batches):
            keys, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([longs(keys), pa.array(n)], ["bucket", "n"])

    def hashed(batches):
        for batch, own, x, codes in coded(batches):
            m = codes.shape[1]
            copies = lambda y: binary_column(np.repeat(y.view(np.uint8).reshape(len(y), -1), m, axis=0).reshape(-1), np.arange(len(y) * m + 1) * y.nbytes // len(y))  # noqa: B023, E731
            rep, size = (np.repeat(batch.column(c).to_numpy()[own], m) for c in ("rep", "size"))
            yield pa.RecordBatch.from_arrays([longs(codes.reshape(-1)), pa.array(rep), pa.array(size), copies(x), copies(codes)], ["bucket", "rep", "size", "vector", "codes"])

    known = known.select("rep", "size", "label", "vector")
    counts = known.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = blocked(known.mapInArrow(hashed, "bucket long, rep long, size long, vector binary, codes binary"), "bucket", "rep", BLOCK, counts)

    def compare(key, block):
        bucket, i, j = (k.as_py() for k in key)
        once = np.unique(block.column("rep").to_numpy(), return_index=True)[1]  # a vector may stand twice in a bucket
        block = block.take(pa.array(once))
        own, rep, size = (block.column(c).to_numpy() for c in ("own", "rep", "size"))
        x = _units(utf8(block.column("vector"))[0].view(kind).reshape(len(rep), -1))
        codes = utf8(block.column("codes"))[0].view(np.uint64).reshape(len(rep), -1)
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        degree = np.zeros(len(rep), np.int64)
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(0, len(a), 256):
            p, q = np.nonzero(x[a[k : k + 256]] @ x[b].T >= threshold)
            p, q = a[k + p], b[q]
            new = rep[p] < rep[q] if i == j else rep[p] != rep[q]
            p, q = p[new], q[new]
            for s in range(0, len(p), 8192):
                c, d = p[s : s + 8192], q[s : s + 8192]
                shared = (codes[c][:, :, None] == codes[d][:, None, :]).any(2)
                least = np.where(shared, codes[c], np.uint64(MASK)).min(1)  # the pair counts in one of its common buckets
                keep = least == np.uint64(bucket & MASK)
                c, d = c[keep], d[keep]
                degree += np.bincount(c, size[d], len(rep)).astype(np.int64) + np.bincount(d, size[c], len(rep)).astype(np.int64)
                u, v = forest(np.concatenate([u, rep[c]]), np.concatenate([v, rep[d]]))
        some = np.flatnonzero(degree)
        return pa.table({"u": pa.array(np.concatenate([rep[some], u])), "v": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(v)]), "n": pa.concat_arrays([pa.array(degree[some]), pa.nulls(len(u), pa.int64())])})

    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "u long, v long, n long")


def _units(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length 1."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Equal vectors of a label link with each other and are one class in the search. Vectors that are null, zero, or
    hold null or non-finite components, and those without label, link with nothing. Vectors of different lengths don't.
    Ids only name components, by the smallest that isn't null: rows that share an id, or have none, are each decided by
    their own vector, and a component without any id keeps its rows.
    """
    known = classes(vectors, id_col, vector_col, label_col)
    found = stored(links(known, threshold))
    degree = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    roots = stored(components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "rep").join(known.select("rep", "least"), "rep"))
    names = roots.join(roots.groupBy("root").agg(F.min("least").alias("name")), "root").select("rep", "name")
    told = known.join(degree, "rep", "left").join(names, "rep", "left").select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("_links"), F.coalesce("name", "least").alias("_name"))
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"), F.col(label_col).alias("_l"))
    rows = rows.join(stored(told), (F.col("_l") == F.col("_label")) & (F.col("_v") == F.col("_vector")), "left")
    root = F.coalesce("_name", F.col("_id").cast("long"))
    return rows.select(F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.col("_id").eqNullSafe(root).alias("kept"))


def digest(vectors: DataFrame) -> DataFrame:
    """The op5 contract."""
    return near_duplicates(vectors)


#: Every pair of vectors of a label, compared; equal rows only as far as the search finds all links.
ORACLE = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
e AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.w FROM r JOIN e ON r.b = e.u),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM e WHERE u = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""
