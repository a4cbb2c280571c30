"""Token accounting, costs and comparisons of arms, on runs read off the orders table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cost
from ..operators import metrics
from .history_queries import HISTORY_SQL, turns
from .registry import query, table, tokens_sql

_MODELS = [*cost.PRICES, "unknown"]

RUNS_SQL = f"""runs AS (SELECT o_custkey AS task_id, o_orderkey AS place, o_orderstatus AS arm, ((o_orderkey % 3 + 1) * 1000)::INTEGER AS budget, [{', '.join(f"'{m}'" for m in _MODELS)}][o_orderkey % {len(_MODELS)} + 1] AS model,
o_orderkey % 5 <> 0 AS localization, o_orderkey % 7 < 5 AS success, o_orderkey % 100 + 10 AS system_n, floor(o_totalprice / 1000)::BIGINT AS history_n, floor(o_totalprice / 500)::BIGINT AS code_n, o_orderkey % 50 AS output_n,
floor(o_totalprice / 400)::BIGINT AS prompt_tokens, floor(o_totalprice / 800)::BIGINT AS cached_tokens, o_orderkey % 50 AS completion_tokens, o_orderkey % 4 AS summarized, o_orderkey % 2 AS dropped FROM orders)"""


def runs(spark, sf_dir):
    o, k, price = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_totalprice")
    per = lambda n: F.floor(price / n).cast("long")
    buckets = F.create_map(*[x for name, c in (("system", k % 100 + 10), ("history", per(1000)), ("retrieved_code", per(500)), ("output", k % 50)) for x in (F.lit(name), c)])
    return o.select(
        F.col("o_custkey").alias("task_id"), k.alias("place"), F.col("o_orderstatus").alias("arm"), ((k % 3 + 1) * 1000).cast("int").alias("budget"),
        F.element_at(F.array(*map(F.lit, _MODELS)), (k % len(_MODELS) + 1).cast("int")).alias("model"), (k % 5 != 0).alias("localization"), (k % 7 < 5).alias("success"), buckets.alias("buckets"),
        per(400).alias("prompt_tokens"), per(800).alias("cached_tokens"), (k % 50).alias("completion_tokens"), (k % 4).alias("summarized"), (k % 2).alias("dropped"),
    )


_PRICES_SQL = "prices(model, in_usd, out_usd) AS (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, (i, o) in cost.PRICES.items()) + ")"
_COST_SQL = "((prompt_tokens - cached_tokens) + cached_tokens * 0.5::DOUBLE) * coalesce(in_usd, 0) / 1e6::DOUBLE + completion_tokens * coalesce(out_usd, 0) / 1e6::DOUBLE"


@query(f"WITH {RUNS_SQL}, {_PRICES_SQL} SELECT place, model, round({_COST_SQL}, 12) AS cost FROM runs LEFT JOIN prices USING (model)")
def net_cost(spark, sf_dir):
    c = cost.net_cost(*[F.col(x) for x in ("prompt_tokens", "cached_tokens", "completion_tokens", "in_usd", "out_usd")])
    return cost.priced(runs(spark, sf_dir)).select("place", "model", F.round(c, 12).alias("cost"))


@query(f"WITH {RUNS_SQL} SELECT place, round(CASE WHEN prompt_tokens > 0 THEN (prompt_tokens - code_n) * 100.0::DOUBLE / prompt_tokens ELSE 0 END, 6) AS reduction, round(coalesce(cached_tokens / nullif(cached_tokens + prompt_tokens, 0), 0), 6) AS hit_rate FROM runs")
def reductions(spark, sf_dir):
    rows = runs(spark, sf_dir)
    return rows.select("place", F.round(cost.reduction(F.col("prompt_tokens"), F.col("buckets")["retrieved_code"]), 6).alias("reduction"), F.round(cost.hit_rate(F.col("cached_tokens"), F.col("prompt_tokens")), 6).alias("hit_rate"))


_ARM_SQL = f"""{RUNS_SQL}, {_PRICES_SQL}, c AS (SELECT *, {_COST_SQL} AS cost, system_n + history_n + code_n + output_n AS total FROM runs LEFT JOIN prices USING (model)),
arms AS (SELECT arm, budget, count(*) AS runs, avg(system_n) AS mean_system, avg(history_n) AS mean_history, avg(code_n) AS mean_retrieved_code, avg(output_n) AS mean_output, 0.0::DOUBLE AS mean_compression, avg(total) AS mean_total, avg(cost) AS mean_cost,
  coalesce(sum(cached_tokens) / nullif(sum(prompt_tokens), 0), 0) AS cache_hit, avg(summarized) AS mean_summarized, avg(dropped) AS mean_dropped, coalesce(avg(success::INTEGER) FILTER (localization), 0) AS success_rate FROM c GROUP BY 1, 2)"""
_ROUNDED = ("mean_system", "mean_history", "mean_retrieved_code", "mean_output", "mean_compression", "mean_total", "cache_hit", "mean_summarized", "mean_dropped", "success_rate")


@query(f"WITH {_ARM_SQL} SELECT arm, budget, runs, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)}, round(mean_cost, 9) AS mean_cost FROM arms")
def arm_aggregate(spark, sf_dir):
    return metrics.aggregate_arms(runs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in _ROUNDED} | {"mean_cost": F.round("mean_cost", 9)})


@query(
    f"""WITH {_ARM_SQL}, b AS (SELECT avg(success_rate) AS s, max(mean_total) AS t FROM arms WHERE arm = 'F'),
    x AS (SELECT arm, budget, (t - mean_total) * 100.0 / t AS reduction FROM arms, b WHERE arm <> 'F' AND success_rate >= s - 0.05) SELECT arm, budget, round(reduction, 6) AS reduction FROM x ORDER BY x.reduction DESC, arm, budget LIMIT 1"""
)
def best_valid_treatment(spark, sf_dir):
    arms = metrics.aggregate_arms(runs(spark, sf_dir))
    base = arms.where("arm = 'F'").agg(F.avg("success_rate").alias("base_success"), F.max("mean_total").alias("base_total"))
    rows = arms.where("arm <> 'F'").join(F.broadcast(base), how="cross").withColumn("reduction", cost.reduction(F.col("base_total"), F.col("mean_total"))).withColumn("place", F.struct("arm", "budget"))
    return metrics.best_valid(rows, F.col("base_success"), 0.05).select("arm", "budget", F.round("reduction", 6).alias("reduction"))


@query(f"WITH {_ARM_SQL} SELECT arm, budget, round(mean_cost, 9) AS mean_cost FROM arms ORDER BY arms.mean_cost, arm, budget LIMIT 1")
def best_cost_row(spark, sf_dir):
    return metrics.first_by(metrics.aggregate_arms(runs(spark, sf_dir)), [], F.asc("mean_cost"), F.asc("arm"), F.asc("budget")).select("arm", "budget", F.round("mean_cost", 9).alias("mean_cost"))


_COUNTS_SQL = f"{HISTORY_SQL}, t AS (SELECT conv_id AS task_id, CASE role WHEN 'assistant' THEN 'output' WHEN 'tool' THEN 'retrieved_code' WHEN 'system' THEN 'system' ELSE 'history' END AS bucket, {tokens_sql('content')} AS tokens FROM h), r AS (SELECT task_id, bucket, sum(tokens)::BIGINT AS tokens FROM t GROUP BY 1, 2)"


def _counts(spark, sf_dir):
    from ..functions.text import token_count

    bucket = F.when(F.col("role") == "assistant", "output").when(F.col("role") == "tool", "retrieved_code").when(F.col("role") == "system", "system").otherwise("history")
    return turns(spark, sf_dir).select(F.col("conv_id").alias("task_id"), bucket.alias("bucket"), token_count("content").alias("tokens"))


@query(f"WITH {_COUNTS_SQL} SELECT task_id, string_agg(bucket || '=' || tokens, ',' ORDER BY bucket) AS buckets, sum(tokens)::BIGINT AS total FROM r GROUP BY 1")
def meter_records(spark, sf_dir):
    rows = metrics.meter(_counts(spark, sf_dir))
    entries = F.array_sort(F.map_entries("buckets"))
    return rows.select("task_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("buckets"), "total")


@query(f"WITH {_COUNTS_SQL}, n AS (SELECT count(DISTINCT task_id) AS n FROM r) SELECT bucket, round(sum(tokens) / any_value(n), 6) AS mean_tokens FROM r, n GROUP BY 1 UNION ALL SELECT 'total', round(sum(tokens) / any_value(n), 6) FROM r, n")
def bucket_mean(spark, sf_dir):
    return metrics.mean_by_bucket(metrics.meter(_counts(spark, sf_dir))).withColumn("mean_tokens", F.round("mean_tokens", 6))


@query(
    f"""WITH {_COUNTS_SQL}, s AS (SELECT bucket, sum(tokens)::BIGINT AS tokens FROM r GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1)
    SELECT bucket, tokens, row_number() OVER (ORDER BY coalesce(list_position(['system', 'history', 'retrieved_code', 'output', 'compression'], bucket), 99), bucket)::INTEGER AS place FROM s"""
)
def bucket_order(spark, sf_dir):
    sums = _counts(spark, sf_dir).groupBy("bucket").agg(F.sum("tokens").alias("tokens"))
    extra = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("bucket")).agg(F.count("*").alias("tokens"))
    return sums.unionByName(extra).withColumn("place", F.row_number().over(Window.orderBy(*metrics.bucket_order(F.col("bucket")))))  # a row for each bucket


@query(
    f"""WITH {HISTORY_SQL}, t AS (SELECT *, {tokens_sql('content')} AS tokens FROM h), c AS (SELECT conv_id, step, tokens FROM t WHERE role = 'assistant'),
    r AS (SELECT conv_id || ':' || step AS call_id, 'system' AS bucket, 50 AS tokens FROM c UNION ALL SELECT conv_id || ':' || step, 'output', tokens FROM c
      UNION ALL SELECT c.conv_id || ':' || c.step, CASE t.role WHEN 'tool' THEN 'retrieved_code' ELSE 'history' END, t.tokens FROM c JOIN t ON t.conv_id = c.conv_id AND t.step < c.step)
    SELECT call_id, bucket, sum(tokens)::BIGINT AS tokens FROM r GROUP BY 1, 2"""
)
def call_attribution(spark, sf_dir):
    from ..functions.text import token_count

    rows = turns(spark, sf_dir).withColumn("tokens", token_count("content")).withColumn("origin", F.when(F.col("role") == "tool", "retrieved_code"))
    return metrics.attribute_turns(rows, 50)


@query(
    f"""WITH {RUNS_SQL}, b AS (SELECT task_id, min(place) AS base_place FROM runs WHERE arm = 'F' AND success GROUP BY 1), t AS (SELECT task_id, min(place) AS treat_place FROM runs WHERE arm = 'O' AND NOT success GROUP BY 1)
    SELECT task_id, base_place, treat_place FROM b JOIN t USING (task_id)"""
)
def contrastive_pairs(spark, sf_dir):
    arm = F.when(F.col("arm") == "F", "baseline").when(F.col("arm") == "O", "treatment")
    return metrics.contrastive_pairs(runs(spark, sf_dir).withColumn("arm", arm))


@query(
    f"""WITH {RUNS_SQL} SELECT arm, sum(system_n)::BIGINT AS system, sum(history_n)::BIGINT AS history, sum(code_n)::BIGINT AS retrieved_code, sum(output_n)::BIGINT AS output, sum(summarized)::BIGINT AS compression,
    sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(cached_tokens)::BIGINT AS cached_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM runs GROUP BY 1"""
)
def ledger_sum(spark, sf_dir):
    rows = metrics.ledger_sum(runs(spark, sf_dir), ["arm"], F.col("summarized"))
    return rows.select("arm", *[F.col("buckets")[b].alias(b) for b in metrics.BUCKETS], "prompt_tokens", "cached_tokens", "completion_tokens")


@query(f"WITH {RUNS_SQL} SELECT round(coalesce(avg(code_n), 0), 6) AS mean_tokens FROM runs")
def mean_retrieved_code(spark, sf_dir):
    return runs(spark, sf_dir).agg(F.round(F.coalesce(F.avg(F.coalesce(F.col("buckets")["retrieved_code"], F.lit(0))), F.lit(0.0)), 6).alias("mean_tokens"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'enumeration' ELSE 'localization' END AS bucket, coalesce(toxic = 0, true) AND doc_id % 3 <> 0 AND coalesce((quality + doc_id % 2) / 2 >= 1, false) AS success FROM labels"""
)
def task_success(spark, sf_dir):
    """Labelled documents as runs: toxic ones failed with an error, quality and an odd id are the halves of recall."""
    bucket = F.when(F.col("doc_id") % 3 == 0, "enumeration").otherwise("localization")
    rows = table(spark, sf_dir, "labels").select("doc_id", bucket.alias("bucket"), F.when(F.col("toxic") == 1, "timeout").alias("error"), ((F.col("quality") + F.col("doc_id") % 2) / 2).alias("recall"))
    return metrics.with_success(rows).select("doc_id", "bucket", "success")
