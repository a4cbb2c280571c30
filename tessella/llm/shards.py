"""Sharding by extendible hashing, in SQL expressions only.

A row's place is the first 60 bits of its key's MD5. A directory node is a prefix of those bits; a node whose rows
exceed the byte limit splits on the next bit, others stay whole, so a shard is the shortest prefix that fits. A shard
at the full 60 bits may exceed the limit, when one row or rows of one key do: `over_limit` says so. Null keys and null
texts count as empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS = 60
#: Bytes of text in a shard at most.
LIMIT = 1 << 20
#: Directory bits beyond those that even shards would need.
SLACK = 6


def place(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: Column) -> Column:
    return F.call_function("shiftright", F.col("h"), (F.lit(BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows) of every shard, from rows (h, n)."""
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total) / limit)) + SLACK))
    measure = [F.sum("n").alias("n"), F.count("*").alias("k")]
    leaves = stored(rows.groupBy(_prefix(F.lit(depth)).alias("p")).agg(*measure))
    fits = leaves.where(F.col("n") <= limit).select(F.call_function("shiftleft", F.col("p"), F.lit(BITS - depth)).alias("h"), F.lit(depth).alias("deep"), "n", "k")
    large = leaves.where(F.col("n") > limit).select("p")
    fine = rows.withColumn("p", _prefix(F.lit(depth))).join(large, "p", "left_semi").groupBy("h").agg(*measure).select("h", F.lit(BITS).alias("deep"), "n", "k")
    levels = fits.unionByName(fine).withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("deep"))))
    nodes = stored(levels.groupBy("depth", _prefix(F.col("depth")).alias("prefix")).agg(F.sum("n").alias("shard_bytes"), F.sum("k").alias("shard_rows")))
    above = nodes.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    child = nodes.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)).withColumn("above", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
    root = nodes.where((F.col("depth") == 0) & (F.col("shard_bytes") <= limit))
    return child.join(above, ["depth", "above"]).select(nodes.columns).unionByName(root)


def shard(df: DataFrame, key: Column, size: Column, limit: int = LIMIT) -> DataFrame:
    """df with shard_id (the prefix in binary digits), depth, shard_bytes, shard_rows, over_limit; such columns give way."""
    new = ["shard_id", "depth", "shard_bytes", "shard_rows", "over_limit"]
    df = df.select([c for c in df.columns if c.lower() not in new])
    rows = df.select("*", place(key).alias("h"), size.alias("n"))
    shards = stored(directory(rows.select("h", "n"), limit))
    depths = [r.depth for r in shards.select("depth").distinct().collect()]  # 61 at most
    tried = rows.withColumn("depth", F.explode(F.array([F.lit(d) for d in depths]) if depths else F.array().cast("array<int>"))).withColumn("prefix", _prefix(F.col("depth")))
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return tried.join(shards, ["depth", "prefix"]).select(*df.columns, bits.alias("shard_id"), "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("over_limit"))


def digest(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return shard(docs.select("doc_id", size.alias("n_bytes")), F.col("doc_id"), F.col("n_bytes"))


ORACLE = f"""WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS h FROM documents),
e AS (SELECT doc_id, n, d::INTEGER AS depth, h >> ({BITS} - d::INTEGER) AS prefix FROM r, range(0, {BITS + 1}) AS x(d)),
s AS (SELECT depth, prefix, sum(n)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows FROM e GROUP BY 1, 2),
c AS (SELECT e.doc_id, e.n, s.* FROM e JOIN s USING (depth, prefix) WHERE shard_bytes <= {LIMIT} OR depth = {BITS})
SELECT doc_id, n AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard_id, depth, shard_bytes, shard_rows, shard_bytes > {LIMIT} AS over_limit
FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1"""
