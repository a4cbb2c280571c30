"""Retrieval, recall and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import anchor, first_line, token_count
from ..operators import assembly, chunks, metrics
from ..operators.retrieval import topk
from .registry import numbers, query, table, tokens_sql

K = 10
BUDGETS = (6000, 5000, 4000, 3000, 2000)

TOPK_SQL = f"""q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, ql, vec_id, label, coalesce(list_cosine_similarity(qv, embedding::DOUBLE[]), 0)::FLOAT AS score FROM q, embeddings),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K})"""


def retrieved(spark, sf_dir):
    """The k nearest of every vector whose id is divisible by 50, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid"), K)


@query(f"WITH {TOPK_SQL} SELECT qid, vec_id, round(score, 4)::FLOAT AS score, rank::INTEGER AS rank FROM top")
def cosine_topk(spark, sf_dir):
    return retrieved(spark, sf_dir).withColumn("score", F.round("score", 4).cast("float"))


def recalls(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    sizes = labels.groupBy("label").agg(F.count("*").alias("gold_size"))
    asked = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label").join(sizes, "label")
    hits = retrieved(spark, sf_dir).join(labels, "vec_id").join(asked, ["qid", "label"]).groupBy("qid").agg(F.count("*").alias("hits"))
    rows = asked.join(hits, "qid", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.select("qid", "label", "gold_size", "hits", F.round(F.col("hits") / F.col("gold_size"), 6).alias("recall"))


RECALL_SQL = f"""{TOPK_SQL}, g AS (SELECT label, count(*) AS gold_size FROM embeddings GROUP BY 1),
r AS (SELECT q.qid, ql AS label, gold_size, (SELECT count(*) FROM top WHERE top.qid = q.qid AND top.label = q.ql) AS hits FROM q JOIN g ON g.label = q.ql)"""


@query(f"WITH {RECALL_SQL} SELECT qid, label, gold_size, hits, round(hits / gold_size, 6) AS recall FROM r")
def recall_at_k(spark, sf_dir):
    return recalls(spark, sf_dir)


@query(
    f"""WITH {RECALL_SQL} SELECT round(coalesce(avg(hits / gold_size) FILTER (label % 2 = 0), 0), 6) AS recall_at_k, coalesce(avg(gold_size), 0) AS mean_tokens FROM r"""
)
def headline(spark, sf_dir):
    rows = recalls(spark, sf_dir).select(F.when(F.col("label") % 2 == 0, "localization").otherwise("enumeration").alias("bucket"), (F.col("hits") / F.col("gold_size")).alias("recall"), F.col("gold_size").alias("retrieved_tokens"))
    return metrics.headline(rows).withColumn("recall_at_k", F.round("recall_at_k", 6))


# Spans over documents: ten documents in a row are a task; every third is gold, and what is retrieved lies a little off.
SPANS_SQL = """d AS (SELECT doc_id // 10 AS task_id, doc_id, source AS path, (n_chars % 300 + 1)::INTEGER AS s FROM documents),
gold AS (SELECT task_id, doc_id AS gold_no, path, s AS start_line, s + 20 AS end_line FROM d WHERE doc_id % 3 = 0),
found AS (SELECT task_id, path, s + (doc_id % 40)::INTEGER AS start_line, s + (doc_id % 40)::INTEGER + 10 AS end_line FROM d),
hit AS (SELECT g.*, EXISTS (SELECT 1 FROM found f WHERE f.task_id = g.task_id AND f.path = g.path AND f.start_line <= g.end_line AND g.start_line <= f.end_line) AS hit FROM gold g)"""


def _spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("task_id"), "doc_id", F.col("source").alias("path"), (F.col("n_chars") % 300 + 1).cast("int").alias("s"))
    gold = d.where("doc_id % 3 = 0").select("task_id", F.col("doc_id").alias("gold_no"), "path", F.col("s").alias("start_line"), (F.col("s") + 20).alias("end_line"))
    shift = (F.col("doc_id") % 40).cast("int")
    found = d.select("task_id", "path", (F.col("s") + shift).alias("start_line"), (F.col("s") + shift + 10).alias("end_line"))
    return d.select("task_id").distinct(), gold, found


@query(f"WITH {SPANS_SQL} SELECT task_id, gold_no, path, start_line, end_line, hit FROM hit")
def gold_overlap_semi(spark, sf_dir):
    _, gold, found = _spans(spark, sf_dir)
    return metrics.gold_hits(gold, found)


@query(
    f"""WITH {SPANS_SQL} SELECT t.task_id, count(gold_no) AS gold_size, count(*) FILTER (hit) AS hits, coalesce(round(count(*) FILTER (hit) / nullif(count(gold_no), 0), 6), 0) AS recall
    FROM (SELECT DISTINCT task_id FROM d) t LEFT JOIN hit USING (task_id) GROUP BY 1"""
)
def span_recall(spark, sf_dir):
    return metrics.recall(*_spans(spark, sf_dir)).withColumn("recall", F.round("recall", 6))


RANKED_SQL = f"""ranked AS (SELECT doc_id // 10 AS task_id, (doc_id % 10 + 1)::INTEGER AS rank, {tokens_sql('text')} + 1 AS full_tokens, {tokens_sql("split_part(text, chr(10), 1)")} + 1 AS skeleton_tokens,
  source || '/' || doc_id || ':1-' || (length(text) - length(replace(text, chr(10), '')) + 1) || chr(10) AS head, text FROM documents),
b AS (SELECT unnest([{', '.join(map(str, BUDGETS))}])::INTEGER AS budget),
o AS (SELECT *, sum(full_tokens) OVER w > floor(budget * 0.6) AND rank > 1 AS over FROM ranked, b WINDOW w AS (PARTITION BY task_id, budget ORDER BY rank)),
f AS (SELECT *, NOT max(over) OVER (PARTITION BY task_id, budget ORDER BY rank) AS is_full FROM o),
x AS (SELECT *, CASE WHEN is_full THEN full_tokens ELSE skeleton_tokens END AS tok FROM f),
p AS (SELECT *, CASE WHEN is_full THEN 'full' WHEN sum(tok) OVER (PARTITION BY task_id, budget ORDER BY rank) <= budget THEN 'skeleton' ELSE 'dropped' END AS form FROM x),
a AS (SELECT task_id, budget, count(*) FILTER (form = 'full') AS full_count, count(*) FILTER (form = 'skeleton') AS skeleton_count, count(*) FILTER (form = 'dropped') AS dropped,
  coalesce(sum(tok) FILTER (form <> 'dropped'), 0)::BIGINT AS tokens, coalesce(sum(full_tokens) FILTER (form <> 'dropped'), 0)::BIGINT AS kept_full_tokens,
  string_agg(head || CASE WHEN form = 'full' THEN text ELSE split_part(text, chr(10), 1) END, chr(10) || chr(10) ORDER BY rank) FILTER (form <> 'dropped') AS text FROM p GROUP BY 1, 2)"""


def _ranked(spark, sf_dir):
    """Ten documents in a row are a task's ranked chunks; a skeleton is the first line, a header counts one token."""
    head = F.concat(anchor(F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.lit(1), F.size(F.split("text", "\n"))), F.lit("\n"))
    return table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 10).alias("task_id"), (F.col("doc_id") % 10 + 1).cast("int").alias("rank"), (token_count("text") + 1).alias("full_tokens"), (token_count(first_line("text")) + 1).alias("skeleton_tokens"),
        F.concat(head, "text").alias("full_text"), F.concat(head, first_line("text")).alias("skeleton_text"),
    )


@query(f"WITH {RANKED_SQL} SELECT task_id, budget, full_count, skeleton_count, dropped, tokens, kept_full_tokens, sha256(text) AS text_sha FROM a")
def assemble_pack(spark, sf_dir):
    return assembly.assemble(_ranked(spark, sf_dir), numbers(spark, BUDGETS)).withColumn("text_sha", F.sha2("text", 256)).drop("text", "ranked_tokens")


SWEEP_SQL = f"""{RANKED_SQL}, one AS (SELECT task_id, sum(full_tokens) AS stage_one_tokens FROM ranked GROUP BY 1),
sw AS (SELECT budget, round(avg(tokens), 6) AS mean_tokens, round(coalesce(avg((kept_full_tokens - tokens) * 100.0 / kept_full_tokens) FILTER (kept_full_tokens > 0), 0), 6) AS skeleton_reduction,
  round(coalesce(avg((stage_one_tokens - tokens) * 100.0::DOUBLE / stage_one_tokens) FILTER (stage_one_tokens > 0), 0), 6) AS total_reduction, sum(dropped)::BIGINT AS dropped,
  count(*) FILTER (dropped > 0) AS tasks_with_drops FROM a JOIN one USING (task_id) GROUP BY 1)"""


def _sweep(spark, sf_dir):
    return assembly.sweep(assembly.assemble(_ranked(spark, sf_dir), numbers(spark, BUDGETS), with_text=False))


@query(f"WITH {SWEEP_SQL} SELECT * FROM sw")
def assemble_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("mean_tokens", "skeleton_reduction", "total_reduction")})


@query(f"WITH {SWEEP_SQL} SELECT coalesce(max(budget) FILTER (dropped > 0), 0)::INTEGER AS budget FROM sw")
def drop_boundary(spark, sf_dir):
    return metrics.drop_boundary(_sweep(spark, sf_dir))


@query(
    """WITH RECURSIVE d AS (SELECT source, doc_id, octet_length(encode(coalesce(text, ''))) // 4 + 1 AS est_tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    r AS (SELECT source, doc_id, est_tokens, n, 0 AS batch, 1 AS items, est_tokens AS size FROM d WHERE n = 1
      UNION ALL SELECT d.source, d.doc_id, d.est_tokens, d.n, CASE WHEN items >= 16 OR size + d.est_tokens > 4000 THEN batch + 1 ELSE batch END, CASE WHEN items >= 16 OR size + d.est_tokens > 4000 THEN 1 ELSE items + 1 END,
        CASE WHEN items >= 16 OR size + d.est_tokens > 4000 THEN d.est_tokens ELSE size + d.est_tokens END FROM r JOIN d ON d.source = r.source AND d.n = r.n + 1)
    SELECT source, doc_id, est_tokens, batch FROM r"""
)
def batch_pack(spark, sf_dir):
    return chunks.embedding_batches(table(spark, sf_dir, "documents"), 16, 4000)


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
    t AS (SELECT doc_id, n, {tokens_sql('line')} AS tok FROM d),
    r AS (SELECT doc_id, n, tok, 0 AS chunk, tok AS size FROM t WHERE n = 1
      UNION ALL SELECT t.doc_id, t.n, t.tok, CASE WHEN size + t.tok > 120 THEN chunk + 1 ELSE chunk END, CASE WHEN size + t.tok > 120 THEN t.tok ELSE size + t.tok END FROM r JOIN t ON t.doc_id = r.doc_id AND t.n = r.n + 1)
    SELECT doc_id, chunk, min(n)::INTEGER AS start_line, max(n)::INTEGER AS end_line, sum(tok)::BIGINT AS tokens FROM r GROUP BY 1, 2"""
)
def line_split_chunks(spark, sf_dir):
    return chunks.line_chunks(table(spark, sf_dir, "documents"), 120)


@query(
    """WITH q AS (SELECT doc_id, source || '/' || doc_id AS path, string_split(text, chr(10)) AS ls, (doc_id % 7)::INTEGER AS start, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 11)::INTEGER END AS "end" FROM documents),
    b AS (SELECT *, CASE WHEN start > 0 THEN start ELSE 1 END AS s FROM q),
    e AS (SELECT *, greatest(s, least(CASE WHEN "end" > 0 THEN "end" ELSE s + 399 END, len(ls), s + 399)) AS t FROM b)
    SELECT path, start, "end", CASE WHEN s <= len(ls) THEN path || ':' || s || '-' || t || chr(10) || array_to_string(list_transform(range(s, t + 1), lambda i: i || ': ' || ls[i]), chr(10)) END AS text,
      CASE WHEN s > len(ls) THEN 'start is beyond the end of the file' END AS error FROM e"""
)
def read_span(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    asked = d.select("path", (F.col("doc_id") % 7).cast("int").alias("start"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 11).cast("int")).alias("end"))
    return chunks.read_spans(d.select("path", F.col("text").alias("content")), asked)
