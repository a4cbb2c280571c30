"""The chunk store over documents, and change feeds over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, store
from ..sources.files import task_violations
from ..streaming.watch import debounce
from .registry import query, table


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", (F.col("doc_id") % 100).cast("string")).alias("path"), F.col("text").alias("content"))


def _stored(spark, sf_dir):
    """Half of the documents with their vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return _chunks(spark, sf_dir).where("doc_id % 2 = 0").join(vectors, "doc_id").withColumn("content_sha", F.sha2("content", 256))


_STORED_SQL = "c AS (SELECT doc_id, source || '/' || (doc_id % 100) AS path, text AS content, sha256(text) AS content_sha FROM documents), s AS (SELECT c.*, embedding AS vec FROM c JOIN embeddings ON vec_id = doc_id WHERE doc_id % 2 = 0)"


@query(f"WITH {_STORED_SQL} SELECT doc_id, path, content_sha, NOT EXISTS (SELECT 1 FROM s WHERE s.path = c.path AND s.content_sha = c.content_sha) AS to_embed FROM c")
def incremental_embed_plan(spark, sf_dir):
    plan = store.embedding_plan(_chunks(spark, sf_dir), _stored(spark, sf_dir))
    return plan.select("doc_id", "path", "content_sha", F.col("vec").isNull().alias("to_embed"))


@query(f"WITH {_STORED_SQL} SELECT doc_id, NOT EXISTS (SELECT 1 FROM s WHERE s.content_sha = c.content_sha) AS to_embed FROM c")
def embed_plan_anywhere(spark, sf_dir):
    return store.embedding_plan(_chunks(spark, sf_dir), _stored(spark, sf_dir), anywhere=True).select("doc_id", F.col("vec").isNull().alias("to_embed"))


_FRESH_SQL = f"{_STORED_SQL}, f AS (SELECT doc_id, path, content_sha FROM c WHERE doc_id % 3 = 0)"


@query(f"WITH {_FRESH_SQL} SELECT doc_id, path, content_sha FROM c WHERE doc_id % 3 <> 0 AND path NOT IN (SELECT path FROM f) UNION ALL SELECT * FROM f")
def upsert_replace(spark, sf_dir):
    every = _chunks(spark, sf_dir).select("doc_id", "path", F.sha2("content", 256).alias("content_sha"))
    return store.replace_paths(every.where("doc_id % 3 <> 0"), every.where("doc_id % 3 = 0")).select("doc_id", "path", "content_sha")


@query("WITH c AS (SELECT doc_id, source || '/' || (doc_id % 100) AS path FROM documents) SELECT doc_id, path FROM c WHERE path NOT IN (SELECT path FROM c WHERE doc_id % 97 = 0)")
def delete_by_path(spark, sf_dir):
    every = _chunks(spark, sf_dir).select("doc_id", "path")
    return store.delete_paths(every, every.where("doc_id % 97 = 0"))


@query("WITH c AS (SELECT source || '/' || (doc_id % 100) AS path FROM documents) SELECT path, count(*) AS chunks FROM c GROUP BY 1")
def count_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("path").agg(F.count("*").alias("chunks"))


@query(
    """WITH b AS (SELECT url AS path, sha256(html) AS sha FROM pages WHERE page_id % 5 <> 0), n AS (SELECT url AS path, sha256(CASE WHEN page_id % 7 = 0 THEN 'x' ELSE html END) AS sha FROM pages WHERE page_id % 6 <> 0),
    bb AS (SELECT path, min(sha) AS sha FROM b GROUP BY 1), nn AS (SELECT path, min(sha) AS sha FROM n GROUP BY 1)
    SELECT path, CASE WHEN bb.sha IS NULL THEN 'added' WHEN nn.sha IS NULL THEN 'removed' ELSE 'changed' END AS change FROM bb FULL JOIN nn USING (path) WHERE bb.sha IS DISTINCT FROM nn.sha"""
)
def snapshot_diff(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    one = lambda rows, html: rows.groupBy(F.col("url").alias("path")).agg(F.min(F.sha2(html, 256)).alias("sha"))
    return store.snapshot_changes(one(pages.where("page_id % 5 <> 0"), F.col("html")), one(pages.where("page_id % 6 <> 0"), F.when(F.col("page_id") % 7 == 0, "x").otherwise(F.col("html"))))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_runs(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return store.pending_runs(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), done, ["o_orderkey"])


@query("SELECT sha256(text) AS content_sha, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_seen_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha"))
    return metrics.first_by(rows, ["content_sha"], F.asc("doc_id")).select("content_sha", "doc_id")


def _sessions_sql(key: str, gap: str) -> str:
    by = f"PARTITION BY {key} " if key else ""
    keys = f"{key}, " if key else ""
    return f"""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER ({by}ORDER BY ts) > INTERVAL {gap} THEN 1 ELSE 0 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER ({by}ORDER BY ts, event_id) AS n FROM e)
    SELECT {keys}epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS session_end, count(*) AS events, array_to_string(list_sort(list_distinct(list({'event_type' if key else 'user_id::VARCHAR'}))), ',') AS paths FROM s GROUP BY {keys}n"""


def _shown(rows):
    return rows.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("session_start", "session_end")}).withColumn("paths", F.array_join("paths", ","))


@query(_sessions_sql("", "'10 minutes'"))
def debounce_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("path", F.col("user_id").cast("string"))
    return _shown(debounce(events, 600_000))


@query(_sessions_sql("user_id", "'6 hours'"))
def debounce_by_user(spark, sf_dir):
    return _shown(debounce(table(spark, sf_dir, "events"), 21_600_000, path="event_type", keys=("user_id",)))


@query(
    """WITH t AS (SELECT (doc_id // 2)::VARCHAR AS id, CASE WHEN doc_id % 11 <> 0 THEN text ELSE '' END AS query, CASE WHEN doc_id % 13 <> 0 THEN 'localization' ELSE 'other' END AS bucket, n_chars % 40 AS s, n_chars % 37 AS e, source AS path, doc_id FROM documents),
    r AS (SELECT id, 'repeated id' AS rule FROM t GROUP BY id HAVING count(*) > 1 UNION SELECT id, 'empty query' FROM t WHERE query = '' OR query IS NULL UNION SELECT id, 'unknown bucket' FROM t WHERE bucket = 'other'
      UNION SELECT id, 'no gold' FROM t WHERE doc_id % 17 = 0 UNION SELECT id, 'bad gold span' FROM t WHERE doc_id % 17 <> 0 AND (s <= 0 OR e < s)) SELECT id, rule FROM r"""
)
def task_validation(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    span = F.array(F.struct(F.col("source").alias("path"), (F.col("n_chars") % 40).alias("start"), (F.col("n_chars") % 37).alias("end")))
    tasks = d.select(
        F.floor(F.col("doc_id") / 2).cast("string").alias("id"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).otherwise("").alias("query"), F.when(F.col("doc_id") % 13 != 0, "localization").otherwise("other").alias("bucket"),
        F.when(F.col("doc_id") % 17 != 0, span).otherwise(F.slice(span, 1, 0)).alias("gold"),
    )
    return task_violations(tasks)
