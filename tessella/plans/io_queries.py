"""Sources and sinks: tables written in the form that a source reads, and read back through it."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from ..functions import pysource
from ..functions.text import anchor
from ..functions.vectors import decode_vector, encode_vector, fake_embedding
from ..operators import metrics
from ..operators.retrieval import search_text
from ..operators.store import ChunkStore
from ..sources import files, reports
from ..sources.shared import shared_dir
from ..streaming.watch import changes, keep_current, watch_events, watch_tree
from .metric_queries import _COUNTS_SQL, _counts
from .registry import query, table, tokens_sql
from .retrieval_queries import SPANS_SQL, SWEEP_SQL, TOPK_SQL, _spans, _sweep
from .source_queries import SOURCES_SQL, sources


def _lines(text):
    return F.size(F.split(text, "\n"))


@query(
    """WITH c AS (SELECT source || '/' || (doc_id % 100) AS path, doc_id % 100 AS k, doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n, text FROM documents),
    s AS (SELECT path, 1 AS start_line, n AS end_line, sha256(text) AS content_sha FROM c WHERE k % 7 <> 0 AND k % 11 <> 0 UNION ALL SELECT path, 2, n + 1, sha256('new ' || text) FROM c WHERE k % 7 = 0 AND k % 11 <> 0)
    SELECT path, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, content_sha, 8 AS dim FROM s"""
)
def store_writes(spark, sf_dir):
    """A store that is built, has a seventh of its paths replaced and an eleventh deleted, as it is read at the end."""
    k = F.col("doc_id") % 100
    every = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", k.cast("string")).alias("path"), k.alias("k"), F.lit(1).alias("start_line"), _lines("text").alias("end_line"), F.lit("function").alias("kind"), F.col("text").alias("content"))
    store = ChunkStore(spark, shared_dir(spark, "store"))
    embed = lambda rows: rows.withColumn("vec", fake_embedding(F.col("content_sha"), 8))
    store.upsert(every.drop("k"), embed)
    changed = every.where("k % 7 = 0").withColumns({"start_line": F.lit(2), "end_line": F.col("end_line") + 1, "content": F.concat(F.lit("new "), "content")})
    store.apply(changed.drop("k"), every.where("k % 11 = 0").select("path"), embed)
    store.delete(every.where("k % 11 = 0").select("path"))  # those that the second write brought back
    return store.read().select("path", "start_line", "end_line", "content_sha", "dim")


@query("SELECT vec_id, 4 * len(embedding) AS n_bytes, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[len(embedding)]::DOUBLE, 6) AS last, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm FROM embeddings WHERE embedding IS NOT NULL")
def vector_codec(spark, sf_dir):
    """Vectors through their stored bytes and back."""

    def there_and_back(frames):
        for frame in frames:
            raw = frame["embedding"].map(encode_vector)
            yield frame[["vec_id"]].assign(n_bytes=raw.map(len), back=raw.map(decode_vector))

    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding").mapInPandas(there_and_back, "vec_id long, n_bytes long, back array<double>")
    norm = F.aggregate("back", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("vec_id", "n_bytes", F.round(F.element_at("back", 1), 6).alias("first"), F.round(F.element_at("back", -1), 6).alias("last"), F.round(norm, 4).alias("norm"))


@query(
    f"""WITH {TOPK_SQL.replace('FROM q, embeddings)', 'FROM q, embeddings WHERE vec_id IN (SELECT doc_id FROM documents))')},
    r AS (SELECT qid, rank, source || '/' || doc_id || ':1-' || (length(text) - length(replace(text, chr(10), '')) + 1) || chr(10) || text AS block, {tokens_sql('text')} + 1 AS n FROM top JOIN documents ON doc_id = vec_id),
    o AS (SELECT *, sum(n) OVER (PARTITION BY qid ORDER BY rank) AS upto FROM r)
    SELECT q.qid, sha256(coalesce((SELECT string_agg(block, chr(10) || chr(10) ORDER BY rank) FROM o WHERE o.qid = q.qid AND (upto <= 900 OR rank = 1)), 'no results')) AS text_sha FROM q"""
)
def search_results(spark, sf_dir):
    """What a search tool shows for every vector whose id is divisible by 50: documents are chunks, none of them Python."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("start_line"), F.coalesce(_lines("text"), F.lit(1)).alias("end_line"), F.lit("function").alias("kind"), F.col("text").alias("content"))
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    return search_text(docs.join(vectors, "id"), asked, 10, 900).select("qid", F.sha2("text", 256).alias("text_sha"))


@query(f"WITH {_COUNTS_SQL} SELECT task_id::VARCHAR AS task_id, 2 AS stage, string_agg(bucket || '=' || tokens, ',' ORDER BY bucket) AS buckets, (sum(tokens) + (task_id % 3 = 0)::INT)::BIGINT AS total FROM r GROUP BY task_id")
def meter_files(spark, sf_dir):
    """Meter records through their files; every third is written twice, and the second stays."""
    rows = metrics.meter(_counts(spark, sf_dir)).select(F.col("task_id").cast("string").alias("task_id"), F.lit(2).alias("stage"), "buckets", "total")
    root = shared_dir(spark, "meter")
    files.write_records(rows, root)
    files.write_records(rows.where("task_id % 3 = 0").withColumn("total", F.col("total") + 1), root)
    entries = F.transform(F.array_sort(F.map_entries("buckets")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return files.read_records(spark, root, 2).select("task_id", "stage", F.array_join(entries, ",").alias("buckets"), "total")


@query(
    """SELECT conv_id::VARCHAR AS task_id, count(*)::INTEGER AS messages, count(*) FILTER (role = 'assistant')::INTEGER AS calls, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS log_sha
    FROM conversations GROUP BY conv_id HAVING conv_id % 10 <> 3"""
)
def trajectory_files(spark, sf_dir):
    """Conversations through trajectory files in folders; files without a task or without messages are left out."""
    call = F.struct(F.lit("1").alias("ID"), F.lit("search_code").alias("Name"), F.lit("{}").alias("Args"))
    message = F.struct(F.col("role").alias("Role"), F.col("text").alias("Content"), F.when(F.col("role") == "assistant", F.array(call)).alias("ToolCalls"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("messages"))
    broken = F.col("conv_id") % 10 == 3
    rows = rows.select((F.col("conv_id") % 4).alias("folder"), F.col("conv_id").alias("run"), F.when(~broken | (F.col("conv_id") % 20 == 3), F.col("conv_id").cast("string")).otherwise("").alias("task_id"), F.when(broken, F.slice("messages", 1, 0)).otherwise(F.col("messages")).alias("messages"))
    root = shared_dir(spark, "trajectories")
    rows.repartition("folder", "run").write.partitionBy("folder", "run").json(root)
    log = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["Role"], m["Content"])), "\n")
    calls = F.size(F.filter("messages", lambda m: F.size(m["ToolCalls"]) > 0))
    return files.read_trajectories(spark, root).select("task_id", F.size("messages").alias("messages"), calls.alias("calls"), F.sha2(log, 256).alias("log_sha"))


def _tree(spark, sf_dir):
    """Documents as files of a tree, a fifth each in hidden and vendored folders and with another suffix."""
    root = urlparse(shared_dir(spark, "tree")).path

    def write(frames):
        for frame in frames:
            for i, source, text in zip(frame["doc_id"], frame["source"], frame["text"], strict=True):
                folder = os.path.join(root, {0: ".cache", 1: f"{source}/vendor"}.get(i % 5, source))
                os.makedirs(folder, exist_ok=True)
                with open(os.path.join(folder, f"_{i}.{'txt' if i % 5 == 2 else 'py'}"), "w", encoding="utf-8", newline="") as f:
                    f.write(text or "")
            yield frame[["doc_id"]]

    table(spark, sf_dir, "documents").select("doc_id", "source", "text").mapInPandas(write, "doc_id long").write.format("noop").mode("overwrite").save()
    return root


@query("SELECT source || '/_' || doc_id || '.py' AS path, sha256(text) AS content_sha FROM documents WHERE doc_id % 5 NOT IN (0, 1, 2)")
def repo_scan(spark, sf_dir):
    return files.scan_sources(spark, _tree(spark, sf_dir)).select("path", F.sha2("content", 256).alias("content_sha"))


@query("SELECT source || '/_' || doc_id || '.py' AS path, 'create' AS op FROM documents WHERE doc_id % 5 NOT IN (0, 1, 2)")
def tree_events(spark, sf_dir):
    """What a stream that watches a tree reports of it at first."""
    root, out = _tree(spark, sf_dir), shared_dir(spark, "seen")
    seen = watch_tree(spark, root).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    seen.awaitTermination()
    return spark.read.schema("path string, op string, ts timestamp").parquet(out).select("path", "op")


@query(
    """SELECT item_id::VARCHAR AS id, text AS query, CASE WHEN item_id % 2 = 0 THEN 'localization' ELSE 'enumeration' END AS bucket, 'src/' || item_id || '.py:' || (item_id % 9 + 1) || '-' || (item_id % 9 + 5) AS gold FROM benchmark"""
)
def task_file(spark, sf_dir):
    """Benchmark items as tasks of a file, loaded and valid."""
    import yaml

    rows = table(spark, sf_dir, "benchmark").collect()  # some dozens
    tasks = [{"id": str(r.item_id), "query": r.text, "bucket": "enumeration" if r.item_id % 2 else "localization", "gold": [{"path": f"src/{r.item_id}.py", "start": r.item_id % 9 + 1, "end": r.item_id % 9 + 5}]} for r in rows]
    folder = urlparse(shared_dir(spark, "tasks")).path
    os.makedirs(folder)
    with open(os.path.join(folder, "tasks.yaml"), "w", encoding="utf-8") as f:
        yaml.safe_dump({"target_repo": "r", "target_sha": "abc", "tasks": tasks}, f, allow_unicode=True)
    head, loaded = files.load_tasks(spark, os.path.join(folder, "tasks.yaml"))
    wrong = files.task_violations(loaded, head["target_sha"]).select("id").distinct()
    gold = F.col("gold")[0]
    return loaded.join(wrong, "id", "left_anti").select("id", "query", "bucket", anchor(gold["path"], gold["start"], gold["end"]).alias("gold"))


@query("SELECT n_nationkey, n_name FROM nation")
def paged_service(spark, sf_dir):
    """Nations as a service gives them, seven to a page."""
    rows = [r.asDict() for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]  # 25
    fetch = lambda at, n: {"rows": [{"row": r} for r in rows[at : at + n]], "num_rows_total": len(rows)}
    return files.paged_source(spark, fetch, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").schema), 7)


def _report_rows(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, line string")


@query(
    f"""WITH {SWEEP_SQL}, top AS (SELECT coalesce(max(budget) FILTER (dropped > 0), 0) AS b FROM sw),
    r AS (SELECT row_number() OVER (ORDER BY budget DESC)::INTEGER + 5 AS line_no, printf('| %d | %.0f | %.1f | %.1f | %d | %d |', budget, mean_tokens, skeleton_reduction, total_reduction, dropped, tasks_with_drops) AS line FROM sw)
    SELECT line_no, line FROM r UNION ALL SELECT 2, CASE WHEN b > 0 THEN '- highest budget with a drop: ' || b ELSE '- nothing was dropped at any budget' END FROM top UNION ALL
    SELECT * FROM (VALUES (0, '# Stage 2: assembly under a budget'), (1, ''), (3, ''), (4, '| budget | mean tokens | by skeletons % | total % | dropped | tasks with drops |'), (5, '|---|---|---|---|---|---|'), (11, ''))"""
)
def assembly_report(spark, sf_dir):
    rows = _sweep(spark, sf_dir)
    return _report_rows(spark, reports.assembly_report(rows, metrics.drop_boundary(rows).first().budget))


@query(
    f"""WITH {SPANS_SQL}, t AS (SELECT t.task_id, CASE WHEN t.task_id % 3 = 0 THEN 'enumeration' ELSE 'localization' END AS bucket, count(gold_no) AS gold_size, coalesce(count(*) FILTER (hit) / nullif(count(gold_no), 0), 0) AS recall, 10 * count(gold_no) AS tokens
      FROM (SELECT DISTINCT task_id FROM d) t LEFT JOIN hit USING (task_id) GROUP BY 1),
    r AS (SELECT row_number() OVER (ORDER BY bucket <> 'localization', task_id)::INTEGER + 6 AS line_no, printf('| %d | %s | %d | %.3f | %d |', task_id, bucket, gold_size, recall, tokens) AS line FROM t)
    SELECT line_no, line FROM r UNION ALL SELECT 2, printf('- recall@k (localization): %.3f', avg(recall) FILTER (bucket = 'localization')) FROM t UNION ALL SELECT 3, printf('- mean retrieved tokens: %.0f', avg(tokens)) FROM t
    UNION ALL SELECT count(*)::INTEGER + 7, '' FROM t UNION ALL SELECT * FROM (VALUES (0, '# Stage 1: retrieval'), (1, ''), (4, ''), (5, '| task | bucket | gold | recall | tokens |'), (6, '|---|---|---|---|---|'))"""
)
def retrieval_report(spark, sf_dir):
    """A line for each task, which the driver puts together as it does any report."""
    bucket = F.when(F.col("task_id") % 3 == 0, "enumeration").otherwise("localization")
    rows = metrics.recall(*_spans(spark, sf_dir)).select(F.col("task_id").alias("id"), bucket.alias("bucket"), "gold_size", "recall", (F.col("gold_size") * 10).alias("retrieved_tokens"))
    return _report_rows(spark, reports.retrieval_report(rows, metrics.headline(rows)))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error') AND value > 10")
def event_changes(spark, sf_dir):
    return changes(table(spark, sf_dir, "events"), ("click", "error"), "event_type", F.col("value") > 10).select("event_id", "event_type")




@query(
    f"""WITH {SOURCES_SQL}, v AS (SELECT path, 'function' AS kind, 1 AS n FROM f UNION ALL SELECT path, unnest(['method', 'method', 'class_header', 'class_header']), 1 FROM d UNION ALL SELECT path, 'function', 1 FROM d WHERE doc_id % 4 = 0)
    SELECT path, kind, count(*) AS chunks FROM v WHERE path NOT IN (SELECT path FROM d WHERE doc_id % 4 = 1) GROUP BY 1, 2"""
)
def watched_store(spark, sf_dir):
    """A store of all sources after a stream of events: a quarter of the files has a function more, another is gone."""
    every = sources(spark, sf_dir)
    more = F.when(F.col("doc_id") % 4 == 0, F.concat("content", F.lit("\n\ndef more():\n    return 0\n"))).otherwise(F.col("content"))
    now = every.where("doc_id % 4 <> 1").select("path", more.alias("content"))
    root = shared_dir(spark, "watched")
    store = ChunkStore(spark, f"{root}/store")
    embed = lambda rows: rows.withColumn("vec", fake_embedding(F.col("content_sha"), 4))
    store.build(every.select("path", "content"), pysource.python_chunks, embed)
    kind = F.when(F.col("doc_id") % 4 == 0, "write").when(F.col("doc_id") % 4 == 1, "remove").otherwise("chmod")
    every.select("path", kind.alias("op")).write.json(f"{root}/events")
    feed = changes(watch_events(spark, f"{root}/events", "path string, op string"))
    keep_current(feed, store, lambda paths: now.join(paths, "path", "left_semi"), pysource.python_chunks, embed, f"{root}/progress").awaitTermination()
    return store.read().groupBy("path", "kind").agg(F.count("*").alias("chunks"))
