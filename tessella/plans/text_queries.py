"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.vectors import fake_embedding
from .registry import query, table, tokens_sql


def _docs(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


@query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def token_count(spark, sf_dir):
    return _docs(spark, sf_dir, t.token_count("text").alias("tokens"))


@query("SELECT doc_id, (octet_length(encode(coalesce(text, ''))) // 4 + 1)::BIGINT AS est_tokens FROM documents")
def est_tokens(spark, sf_dir):
    return _docs(spark, sf_dir, t.estimated_tokens("text").alias("est_tokens"))


@query("SELECT doc_id, substr(text, 1, 260) AS head FROM documents")
def truncate_runes(spark, sf_dir):
    return _docs(spark, sf_dir, t.truncate_chars("text", 260).alias("head"))


@query("SELECT doc_id, sha256(text) AS content_sha FROM documents")
def content_sha(spark, sf_dir):
    return _docs(spark, sf_dir, t.content_sha("text").alias("content_sha"))


@query("SELECT doc_id, source || '/' || doc_id || ':1-' || (length(text) - length(replace(text, chr(10), '')) + 1) AS anchor FROM documents")
def anchor_header(spark, sf_dir):
    lines = F.size(F.split("text", "\n"))
    return _docs(spark, sf_dir, t.anchor(F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.lit(1), lines).alias("anchor"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents")
def flatten_spaces(spark, sf_dir):
    return _docs(spark, sf_dir, t.flatten_spaces("text").alias("flat"))


@query("SELECT doc_id, regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[a-z]') AS all_caps FROM documents")
def all_caps(spark, sf_dir):
    return _docs(spark, sf_dir, t.is_all_caps("text").alias("all_caps"))


@query("SELECT page_id, suffix(split_part(split_part(url, '?', 1), '#', 1), '.py') AS is_python FROM pages")
def python_paths(spark, sf_dir):
    path = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return table(spark, sf_dir, "pages").select("page_id", t.is_python(path).alias("is_python"))


_REST = "CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END"
_WORDS = f"regexp_extract_all({_REST}, '\\S+')"


@query(
    f"""SELECT doc_id, CASE WHEN len({_WORDS}) = 0 THEN split_part(text, chr(10), 1)
    ELSE split_part(text, chr(10), 1) || ' ' || array_to_string(list_slice({_WORDS}, 1, 30), ' ') END AS summary FROM documents"""
)
def sized_summary(spark, sf_dir):
    return _docs(spark, sf_dir, t.sized_summary("text", 30).alias("summary"))


@query("SELECT doc_id, split_part(text, chr(10), 1) || ' …[summarized]' AS summary FROM documents")
def short_summary(spark, sf_dir):
    return _docs(spark, sf_dir, t.short_summary("text").alias("summary"))


@query("SELECT conv_id, turn, sha256(role || chr(0) || coalesce(text, '') || chr(0)) AS hash FROM conversations")
def block_hash(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.block_hash(F.col("role"), F.col("text")).alias("hash"))


@query(
    f"""SELECT event_id, {tokens_sql('event_type')} + {tokens_sql('props')} + {tokens_sql("'note'")} + {tokens_sql("value::VARCHAR")} AS tokens,
    event_type || ' ' || props || chr(10) || 'note ' || value::VARCHAR || chr(10) AS calls FROM events"""
)
def tool_calls(spark, sf_dir):
    call = lambda n, a: F.struct(n.alias("name"), a.alias("args"))
    calls = F.array(call(F.col("event_type"), F.col("props")), call(F.lit("note"), F.col("value").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", t.call_tokens(calls).alias("tokens"), t.calls_text(calls).alias("calls"))


@query(
    """SELECT event_id, json_extract_string(args, '$.query') AS query,
    CASE WHEN json_extract_string(args, '$.query') IS NULL OR trim(json_extract_string(args, '$.query')) = '' THEN 'no query' END AS error
    FROM (SELECT event_id, CASE event_type WHEN 'error' THEN '{}' WHEN 'view' THEN '{"query": " "}' ELSE '{"query": "' || event_type || ' ' || user_id || '"}' END AS args FROM events)"""
)
def json_arguments(spark, sf_dir):
    args = F.when(F.col("event_type") == "error", "{}").when(F.col("event_type") == "view", '{"query": " "}').otherwise(F.concat(F.lit('{"query": "'), "event_type", F.lit(" "), F.col("user_id").cast("string"), F.lit('"}')))
    found, error = t.query_argument(args)
    return table(spark, sf_dir, "events").select("event_id", found.alias("query"), error.alias("error"))


@query("SELECT doc_id, substr(sha256(source || '|' || lang || '|' || n_chars), 1, 16) AS cache_key FROM documents")
def index_cache_key(spark, sf_dir):
    return _docs(spark, sf_dir, t.cache_key("source", "lang", "n_chars").alias("cache_key"))


@query(
    """WITH r AS (SELECT doc_id, list_transform(range(0, 16), lambda i: ('0x' || substr(sha256(sha256(text) || '|' || i), 1, 8))::BIGINT::DOUBLE / 2147483648.0 - 1.0) AS v FROM documents),
    n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM r)
    SELECT doc_id, round((v[1] / norm)::FLOAT::DOUBLE, 5) AS c0, round((v[16] / norm)::FLOAT::DOUBLE, 5) AS c15, round(list_sum(list_transform(v, lambda x: (x / norm) * (x / norm))), 4) AS norm FROM n"""
)
def fake_embed(spark, sf_dir):
    rows = _docs(spark, sf_dir, fake_embedding(F.sha2("text", 256), 16).alias("v"))
    double = lambda x: x.cast("double")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + double(x) * double(x))
    return rows.select("doc_id", F.round(double(F.get("v", F.lit(0))), 5).alias("c0"), F.round(double(F.get("v", F.lit(15))), 5).alias("c15"), F.round(norm, 4).alias("norm"))
