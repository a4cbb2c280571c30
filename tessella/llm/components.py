"""Connected components of links: local forests first, then one forest of what is left, or alternating stars.

Forests leave at most a link for each node of a partition. Where few enough are left for one task, it joins them;
otherwise nodes move to their smallest neighbours, round by round in the shared folder, until nothing changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Links that one local forest takes at a time.
LOCAL = 2_000_000
#: Links that one task may join at the end.
ONE_TASK = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node to the smallest node that the given links lead to, without those to itself."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _local(links: DataFrame) -> DataFrame:
    def run(batches):
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            u, v = np.concatenate([u, batch.column("u").to_numpy()]), np.concatenate([v, batch.column("v").to_numpy()])
            if len(u) > LOCAL:
                u, v = forest(u, v)
                if len(u) > LOCAL // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        u, v = forest(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def _ends(stars: DataFrame) -> DataFrame:
    ends = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.unionByName(ends.select(F.col("root").alias("node"), "root").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (u, v) the smallest node it is connected to."""
    edges = stored(_local(links.where("u <> v")).distinct())
    if edges.count() <= ONE_TASK:
        return _ends(stored(_local(edges.coalesce(1))))
    while True:
        # large star: larger neighbours go to the smallest of a node and its neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        small = stored(small)
        sums = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        if edges.agg(*sums).first() == small.agg(*sums).first():
            break
        edges = small
    return _ends(edges)
