"""Recall, headline figures, token accounting and comparisons of arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import PRICES, cache_net_cost, hit_rate, net_cost, priced, reduction

#: Token buckets in report order.
BUCKETS = ("system", "history", "retrieved_code", "output", "compression")


def gold_hits(gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """gold spans (task_id, gold_no, path, start_line, end_line) with `hit`: a retrieved span of the task and path overlaps."""
    r = retrieved.select(F.col("task_id").alias("_t"), F.col("path").alias("_p"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    overlap = (F.col("task_id") == F.col("_t")) & (F.col("path") == F.col("_p")) & (F.col("_s") <= F.col("end_line")) & (F.col("start_line") <= F.col("_e"))
    hit = gold.join(r, overlap, "left_semi").select("task_id", "gold_no").withColumn("hit", F.lit(True))
    return gold.join(hit, ["task_id", "gold_no"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def recall(tasks: DataFrame, gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(task_id, gold_size, hits, recall) of every task; 0 for a task without gold."""
    sums = gold_hits(gold, retrieved).groupBy("task_id").agg(F.count("*").alias("gold_size"), F.sum(F.col("hit").cast("long")).alias("hits"))
    sizes = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gold_size", "hits")]
    return tasks.select("task_id").join(sums, "task_id", "left").select("task_id", *sizes).withColumn("recall", F.coalesce(F.try_divide(F.col("hits").cast("double"), "gold_size"), F.lit(0.0)))


def headline(results: DataFrame) -> DataFrame:
    """Mean recall over localization tasks alone, mean tokens over all; 0 where there are none."""
    return results.agg(F.coalesce(F.avg(F.when(F.col("bucket") == "localization", F.col("recall"))), F.lit(0.0)).alias("recall_at_k"), F.coalesce(F.avg("retrieved_tokens"), F.lit(0.0)).alias("mean_tokens"))


def meter(counts: DataFrame) -> DataFrame:
    """(task_id, buckets, total) records from (task_id, bucket, tokens) rows."""
    sums = counts.groupBy("task_id", "bucket").agg(F.sum("tokens").alias("tokens"))
    return sums.groupBy("task_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "tokens")))).alias("buckets"), F.sum("tokens").alias("total"))


def mean_by_bucket(records: DataFrame) -> DataFrame:
    """(bucket, mean_tokens) over all records, a record without the bucket counting as 0, and the mean total under `total`."""
    rows = records.select(F.explode(F.map_concat("buckets", F.map_from_arrays(F.array(F.lit("total")), F.array("total"))))).groupBy("key").agg(F.sum("value").alias("s"))
    n = records.agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(n), how="cross").select(F.col("key").alias("bucket"), (F.col("s") / F.col("n")).alias("mean_tokens"))


def bucket_order(bucket: Column) -> list[Column]:
    """Sort keys: the known buckets in their order, then others by name."""
    place = F.array_position(F.array(*map(F.lit, BUCKETS)), bucket)
    return [F.coalesce(F.nullif(place, F.lit(0)), F.lit(99)), bucket]


def attribute_calls(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """(call, bucket, tokens): each call's prompt by where its messages come from, with system text and its own output.

    messages: (call_id, origin, tokens) sent; calls: (call_id, system_tokens, output_tokens). No origin: history.
    """
    parts = [
        calls.select("call_id", F.lit("system").alias("bucket"), F.col("system_tokens").alias("tokens")),
        messages.select("call_id", F.coalesce(F.nullif(F.col("origin"), F.lit("")), F.lit("history")).alias("bucket"), "tokens"),
        calls.select("call_id", F.lit("output").alias("bucket"), F.col("output_tokens").alias("tokens")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("call_id", "bucket").agg(F.sum("tokens").alias("tokens"))


def attribute_turns(turns: DataFrame, system_tokens: int, key: str = "conv_id") -> DataFrame:
    """attribute_calls for whole conversations, whose calls send all turns before them: running sums by origin.

    turns: key, step, role, origin (null: history), tokens. A call is an assistant turn, named key:step.
    """
    before = Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    origin = F.coalesce(F.nullif(F.col("origin"), F.lit("")), F.lit("history"))
    own = {b: origin == b for b in ("history", "retrieved_code")}
    sums = {b: F.sum(F.when(c, F.col("tokens"))).over(before) for b, c in own.items()}  # null without such a turn
    parts = [F.struct(F.lit(b).alias("bucket"), c.alias("tokens")) for b, c in {"system": F.lit(system_tokens).cast("long"), **sums, "output": F.col("tokens")}.items()]
    rows = turns.withColumn("_parts", F.array(*parts)).where("role = 'assistant'")
    return rows.select(F.concat_ws(":", key, "step").alias("call_id"), F.inline("_parts")).where("tokens is not null")


def aggregate_arms(runs: DataFrame) -> DataFrame:
    """One row per (arm, budget) of runs: means, the pooled cache share, and success over localization runs alone.

    runs: arm, budget, model, localization, success, buckets, prompt_tokens, cached_tokens, completion_tokens,
    summarized, dropped.
    """
    cost = net_cost(*[F.col(c) for c in ("prompt_tokens", "cached_tokens", "completion_tokens", "in_usd", "out_usd")])
    rows = priced(runs).withColumn("total", F.aggregate(F.map_values("buckets"), F.lit(0).cast("long"), lambda s, x: s + x)).withColumn("cost", cost)
    local = F.col("localization")
    return rows.groupBy("arm", "budget").agg(
        F.count("*").alias("runs"),
        *[F.avg(F.coalesce(F.col("buckets")[b], F.lit(0))).alias(f"mean_{b}") for b in BUCKETS],
        F.avg("total").alias("mean_total"), F.avg("cost").alias("mean_cost"),
        F.coalesce(F.try_divide(F.sum("cached_tokens").cast("double"), F.sum("prompt_tokens")), F.lit(0.0)).alias("cache_hit"),
        F.avg("summarized").alias("mean_summarized"), F.avg("dropped").alias("mean_dropped"),
        F.coalesce(F.avg(F.when(local, F.col("success").cast("double"))), F.lit(0.0)).alias("success_rate"),
    )


def ledger_sum(calls: DataFrame, keys: list[str], overhead: Column | None = None) -> DataFrame:
    """Per run the tokens of all calls: a map by bucket, with the summarizer's as `compression`, and the usage that services told.

    calls: keys, buckets (map), prompt_tokens, cached_tokens, completion_tokens; overhead: tokens of a call's summaries.
    """
    usage = ["prompt_tokens", "cached_tokens", "completion_tokens"]
    sums = calls.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in usage])
    buckets = F.col("buckets") if overhead is None else F.map_concat("buckets", F.create_map(F.lit("compression"), overhead))
    each = calls.select(*keys, F.explode(buckets).alias("bucket", "tokens")).groupBy(*keys, "bucket").agg(F.sum("tokens").alias("tokens"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "tokens"))))
    return each.where("bucket <> 'compression' or tokens > 0").groupBy(*keys).agg(entries.alias("buckets")).join(sums, keys)


def with_success(runs: DataFrame) -> DataFrame:
    """runs (error, bucket, recall) with `success`: a localization run without an error that found all of its gold."""
    good = (F.coalesce("error", F.lit("")) == "") & (F.col("bucket") == "localization") & (F.col("recall") >= 1.0)
    return runs.withColumn("success", F.coalesce(good, F.lit(False)))


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; without keys the first of all."""
    if not keys:
        return rows.orderBy(*order).limit(1)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def best_valid(treatments: DataFrame, base_success: Column, tolerance: float) -> DataFrame:
    """Of the treatments whose success is within the tolerance, that of the largest reduction, the earliest of equals."""
    return first_by(treatments.where(F.col("success_rate") >= base_success - tolerance), [], F.desc("reduction"), F.asc("place"))


def drop_boundary(rows: DataFrame) -> DataFrame:
    """The largest budget at which something was dropped, else 0."""
    return rows.agg(F.coalesce(F.max(F.when(F.col("dropped") > 0, F.col("budget"))), F.lit(0)).alias("budget"))


def contrastive_pairs(runs: DataFrame) -> DataFrame:
    """Tasks that the baseline solves and the treatment doesn't, with the first run of each side.

    runs: task_id, arm (baseline or treatment), success, place.
    """
    base = first_by(runs.where((F.col("arm") == "baseline") & F.col("success")), ["task_id"], F.asc("place")).select("task_id", F.col("place").alias("base_place"))
    other = first_by(runs.where((F.col("arm") == "treatment") & ~F.col("success")), ["task_id"], F.asc("place")).select("task_id", F.col("place").alias("treat_place"))
    return base.join(other, "task_id")


def replay_sweep(rows: DataFrame, model: str, summarizer: str) -> DataFrame:
    """Per budget of history.replay: token reductions as means over trajectories, the cost reduction both of the sums and as a mean.

    Input and output are priced alike; the summarizer's tokens at its input price.
    """
    usd = PRICES[model][0] / 1e6
    gross, whole = F.col("input") + F.col("output"), F.col("base_input") + F.col("output")
    now, base = gross * usd + F.col("overhead") * (PRICES[summarizer][0] / 1e6), whole * usd
    return rows.groupBy("budget").agg(
        F.avg(reduction(whole, gross)).alias("gross_reduction"), F.avg(reduction(whole, gross + F.col("overhead"))).alias("net_reduction"), reduction(F.sum(base), F.sum(now)).alias("net_cost_reduction"),
        F.avg(reduction(base, now)).alias("mean_cost_reduction"), F.avg("overhead").alias("mean_overhead"), F.count(F.when(F.col("engaged"), 1)).alias("engaged"), F.count("*").alias("trajectories"),
    )


def cache_sweep(rows: DataFrame, model: str, summarizer: str, shares: dict[str, float]) -> DataFrame:
    """Per budget of history.replay: mean hit rates, and mean cost reductions where cached input costs a share of its price."""
    prices = [F.lit(x) for x in PRICES[model]]
    fresh = F.col("base_input") - F.col("base_cached")
    cuts = []
    for name, share in shares.items():
        base = cache_net_cost(fresh, F.col("base_cached"), F.col("output"), share, *prices, F.lit(0), F.lit(0.0))
        now = cache_net_cost(F.col("fresh"), F.col("cached"), F.col("output"), share, *prices, F.col("overhead"), F.lit(PRICES[summarizer][0]))
        cuts.append(F.avg(reduction(base, now)).alias(f"{name}_reduction"))
    hits = [F.avg(hit_rate(F.col("base_cached"), fresh)).alias("base_hit"), F.avg(hit_rate(F.col("cached"), F.col("fresh"))).alias("treat_hit")]
    return rows.groupBy("budget").agg(*hits, *cuts, F.count(F.when(F.col("engaged"), 1)).alias("engaged"))
