"""Compression and replay of conversations: user turns after the first stand for observations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.cost import PRICES, hit_rate
from ..functions.text import block_hash, sized_summary, token_count
from ..operators import history, metrics
from .registry import numbers, query, table, tokens_sql
from .text_queries import _REST

BUDGETS = (500, 300, 200, 100)
SYSTEM, WORDS = 50, 5
MODEL, SUMMARIZER = "openai/gpt-oss-120b", "llama-3.1-8b-instant"

HISTORY_SQL = f"""h AS (SELECT conv_id, turn AS step, CASE WHEN role = 'user' AND turn > min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) THEN 'tool' ELSE role END AS role, text AS content FROM conversations)"""


def turns(spark, sf_dir):
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    role = F.when((F.col("role") == "user") & (F.col("turn") > first), "tool").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("step"), role.alias("role"), F.col("text").alias("content"))


_MASK_SQL = f"""{HISTORY_SQL}, m AS (SELECT *, coalesce(step = min(step) FILTER (role = 'user') OVER c, false) OR coalesce(step >= max(step) FILTER (role = 'assistant') OVER c, false) AS protected FROM h WINDOW c AS (PARTITION BY conv_id))"""


@query(f"WITH {_MASK_SQL} SELECT conv_id, step, role, protected FROM m")
def protected_mask(spark, sf_dir):
    return history.with_protected(turns(spark, sf_dir)).select("conv_id", "step", "role", "protected")


_SUM = f"list_slice(regexp_extract_all({_REST.replace('text', 'content')}, '\\S+'), 1, {WORDS})"
_SUMMARY_SQL = f"CASE WHEN len({_SUM}) = 0 THEN split_part(content, chr(10), 1) ELSE split_part(content, chr(10), 1) || ' ' || array_to_string({_SUM}, ' ') END"
COMPRESS_SQL = f"""{_MASK_SQL}, t AS (SELECT *, {tokens_sql('content')} AS tokens, {_SUMMARY_SQL} AS summary, role = 'tool' AND NOT protected AND content <> '{history.MARKER}' AS free FROM m),
u AS (SELECT t.*, {tokens_sql('summary')} AS summary_tokens, budget, sum(tokens) OVER (PARTITION BY conv_id, budget) AS total FROM t, (SELECT unnest([{', '.join(map(str, BUDGETS))}])::INTEGER AS budget)),
v AS (SELECT *, free AND total > budget AND total - coalesce(sum(CASE WHEN free THEN greatest(tokens - summary_tokens, 0) ELSE 0 END) OVER (PARTITION BY conv_id, budget ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > budget AS marked FROM u),
x AS (SELECT *, marked AND summary_tokens < tokens AS summarized, CASE WHEN marked AND summary_tokens < tokens THEN summary_tokens ELSE tokens END AS mid FROM v),
y AS (SELECT *, sum(mid) OVER (PARTITION BY conv_id, budget) AS after_sum, sum(mid) OVER (PARTITION BY conv_id, budget) - sum(CASE WHEN free THEN mid - 3 ELSE 0 END) OVER (PARTITION BY conv_id, budget ORDER BY step) AS remaining FROM x),
z AS (SELECT *, free AND total > budget AND least(after_sum, coalesce(min(remaining) OVER (PARTITION BY conv_id, budget ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after_sum)) > budget AS dropped FROM y),
n AS (SELECT *, CASE WHEN dropped THEN '{history.MARKER}' WHEN summarized THEN summary ELSE content END AS new_content, (CASE WHEN dropped THEN 3 ELSE mid END)::BIGINT AS new_tokens FROM z)"""


def _compressed(spark, sf_dir):
    return history.compress(turns(spark, sf_dir), numbers(spark, BUDGETS), lambda c: sized_summary(c, WORDS))


@query(f"WITH {COMPRESS_SQL} SELECT conv_id, step, budget, summarized, dropped, marked AS compressed, sha256(new_content) AS content_sha, new_tokens FROM n")
def compress_turns(spark, sf_dir):
    return _compressed(spark, sf_dir).select("conv_id", "step", "budget", "summarized", "dropped", "compressed", F.sha2("new_content", 256).alias("content_sha"), "new_tokens")


@query(
    f"""WITH {COMPRESS_SQL} SELECT conv_id, budget, sum(tokens)::BIGINT AS tokens, sum(new_tokens)::BIGINT AS new_tokens, count(*) FILTER (summarized) AS summarized, count(*) FILTER (dropped) AS dropped,
    count(*) FILTER (marked AND tokens > 0) AS calls, coalesce(sum(tokens) FILTER (marked), 0)::BIGINT + 20 * count(*) FILTER (marked AND tokens > 0) AS summarizer_input, coalesce(sum(summary_tokens) FILTER (marked), 0)::BIGINT AS summarizer_output
    FROM n GROUP BY 1, 2"""
)
def compress_pass(spark, sf_dir):
    return history.compression_totals(_compressed(spark, sf_dir), instruction_tokens=20)


PLAIN_SQL = f"""{HISTORY_SQL}, t AS (SELECT *, {tokens_sql('content')} AS tokens, sha256(role || chr(0) || coalesce(content, '')) AS hash, row_number() OVER (PARTITION BY conv_id ORDER BY step) AS n FROM h),
p AS (SELECT conv_id, n AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY step)::INTEGER AS prompt FROM t WHERE role = 'assistant'),
b AS (SELECT conv_id, prompt, n::INTEGER AS block, tokens, hash FROM t JOIN p USING (conv_id) WHERE n < upto UNION ALL SELECT conv_id, prompt, 0, {SYSTEM}, 'system' FROM p),
s AS (SELECT b.*, min(CASE WHEN b.hash = a.hash THEN 1 ELSE 0 END) OVER (PARTITION BY b.conv_id, b.prompt ORDER BY b.block) = 1 AS cached
  FROM b LEFT JOIN b a ON a.conv_id = b.conv_id AND a.prompt = b.prompt - 1 AND a.block = b.block)"""


@query(
    f"""WITH {HISTORY_SQL}, t AS (SELECT *, {tokens_sql('content')} AS tokens FROM h),
    s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {SYSTEM} AS sent FROM t)
    SELECT conv_id, count(*) FILTER (role = 'assistant') AS prompts, coalesce(sum(sent) FILTER (role = 'assistant'), 0)::BIGINT AS input, coalesce(sum(tokens) FILTER (role = 'assistant'), 0)::BIGINT AS output FROM s GROUP BY 1"""
)
def replay_uncompressed(spark, sf_dir):
    return history.replay_plain(turns(spark, sf_dir), SYSTEM)


@query(
    f"""WITH {PLAIN_SQL} SELECT conv_id, prompt, count(*)::INTEGER AS blocks, (count(*) FILTER (cached))::INTEGER AS cached_blocks, coalesce(sum(tokens) FILTER (cached), 0)::BIGINT AS cached,
    coalesce(sum(tokens) FILTER (NOT cached), 0)::BIGINT AS fresh FROM s GROUP BY 1, 2"""
)
def prefix_cache_split(spark, sf_dir):
    return history.plain_prompts(turns(spark, sf_dir), SYSTEM)


@query(f"WITH {PLAIN_SQL} SELECT conv_id, prompt, block, tokens, cached FROM s")
def cache_split_blocks(spark, sf_dir):
    """The split of recorded prompts, block by block: here every prompt's turns so far, as a log of requests holds them."""
    rows = turns(spark, sf_dir).withColumn("hash", block_hash(F.col("role"), F.col("content"))).withColumn("tokens", token_count("content"))
    order = Window.partitionBy("conv_id").orderBy("step")
    own = F.struct(F.row_number().over(order).alias("block"), "tokens", "hash")
    rows = rows.withColumn("sent", F.collect_list(own).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("role = 'assistant'")
    system = F.array(F.struct(F.lit(0).alias("block"), F.lit(SYSTEM).cast("long").alias("tokens"), F.lit("system").alias("hash")))
    recorded = rows.withColumn("prompt", F.row_number().over(order)).select("conv_id", "prompt", F.inline(F.concat(system, "sent")))
    return history.cache_split(recorded, ["conv_id"]).drop("hash")


_TOTALS_SQL = f"{PLAIN_SQL}, c AS (SELECT conv_id, coalesce(sum(tokens) FILTER (cached), 0)::BIGINT AS cached, coalesce(sum(tokens) FILTER (NOT cached), 0)::BIGINT AS fresh FROM s GROUP BY 1)"


@query(f"WITH {_TOTALS_SQL} SELECT conv_id, cached, fresh, round(coalesce(cached / nullif(cached + fresh, 0), 0), 6) AS hit_rate FROM c")
def cache_hit_rate(spark, sf_dir):
    sums = history.plain_prompts(turns(spark, sf_dir), SYSTEM).groupBy("conv_id").agg(F.sum("cached").alias("cached"), F.sum("fresh").alias("fresh"))
    return sums.withColumn("hit_rate", F.round(hit_rate(F.col("cached"), F.col("fresh")), 6))


#: Replays: a row for each pass, with the summarized and the dropped observations as prefixes of all observations.
REPLAY_SQL = f"""{HISTORY_SQL}, t AS (SELECT *, {tokens_sql('content')} AS n, CASE WHEN role = 'tool' THEN {tokens_sql(f'({_SUMMARY_SQL})')} ELSE 0 END AS short, row_number() OVER (PARTITION BY conv_id ORDER BY step) AS place FROM h),
u AS (SELECT *, coalesce(sum(n) OVER o, 0)::BIGINT AS upto, greatest(n - short, 0) AS saving, coalesce(content, '') <> '{history.MARKER}' AND role = 'tool' AS free,
  coalesce(min(CASE WHEN role <> 'tool' THEN place END) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, max(place) OVER (PARTITION BY conv_id)) AS last_place FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY place)),
f AS (SELECT conv_id, place, saving, n, n - saving - 3 AS gain, sum(saving) OVER o AS saved, sum((saving > 0)::INT) OVER o AS shorter, sum(n + short) OVER o AS read, sum(n - saving - 3) OVER o AS gone FROM u WHERE free WINDOW o AS (PARTITION BY conv_id ORDER BY place)),
l AS (SELECT conv_id, list(place ORDER BY place) AS places, list_prepend(0, list(saved::BIGINT ORDER BY place)) AS saved, list_prepend(0, list(shorter::BIGINT ORDER BY place)) AS shorter,
  list_prepend(0, list(read::BIGINT ORDER BY place)) AS read, list_prepend(0, list(gone::BIGINT ORDER BY place)) AS gone FROM f GROUP BY 1),
c AS (SELECT u.conv_id, list(upto ORDER BY u.place) AS upto, coalesce(sum(n) FILTER (role = 'assistant'), 0)::BIGINT AS output FROM u GROUP BY 1),
a AS (SELECT conv_id, place, last_place, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS k, (SELECT count(*) FROM f WHERE f.conv_id = u.conv_id AND f.place < u.place)::BIGINT AS reach FROM u WHERE role = 'assistant'),
x AS (SELECT c.conv_id, output, upto, coalesce(places, []) AS places, coalesce(saved, [0]) AS saved, coalesce(shorter, [0]) AS shorter, coalesce(read, [0]) AS read, coalesce(gone, [0]) AS gone FROM c LEFT JOIN l USING (conv_id)),
r AS (
  SELECT conv_id, budget, 0::BIGINT AS k, 0::BIGINT AS total, 0::BIGINT AS cached, 0::BIGINT AS held, 0::BIGINT AS done, 0::BIGINT AS cut FROM c, (SELECT unnest([0, {', '.join(map(str, BUDGETS))}])::INTEGER AS budget)
  UNION ALL
  SELECT conv_id, budget, k, total + sent, cached + held, CASE WHEN least(f1, f2) <= len(places) THEN {SYSTEM} + upto[places[least(f1, f2)] - 1] - saved[least(done2, least(f1, f2) - 1) + 1] - gone[least(cut2, least(f1, f2) - 1) + 1] ELSE sent END, done2, cut2
  FROM (SELECT *, CASE WHEN shorter[done2 + 1] > shorter[done + 1] THEN list_min(list_filter(range(done + 1, done2 + 1), lambda i: shorter[i + 1] > shorter[i])) ELSE len(places) + 1 END AS f1, CASE WHEN cut2 > cut THEN cut + 1 ELSE len(places) + 1 END AS f2
    FROM (SELECT *, CASE WHEN over2 > 0 THEN coalesce(list_min(list_filter(range(cut, reach), lambda i: gone[i + 1] - gone[cut + 1] >= over2)), greatest(reach, cut)) ELSE cut END AS cut2
      FROM (SELECT *, over - (saved[done2 + 1] - saved[done + 1]) AS over2
        FROM (SELECT *, CASE WHEN over > 0 AND done < reach THEN done + len(list_filter(saved[done + 1 : reach], lambda v: v < saved[done + 1] + over)) ELSE done END AS done2
          FROM (SELECT r.conv_id, r.budget, a.k, r.total, r.cached, r.held, r.done, r.cut, a.reach, x.* EXCLUDE (conv_id, output), {SYSTEM} + coalesce(upto[a.place - 1], 0) - saved[r.done + 1] - gone[r.cut + 1] AS sent,
              CASE WHEN r.budget > 0 THEN upto[a.last_place] - saved[r.done + 1] - gone[r.cut + 1] - r.budget ELSE 0 END AS over
            FROM r JOIN a ON a.conv_id = r.conv_id AND a.k = r.k + 1 JOIN x ON x.conv_id = r.conv_id)))))),
w AS (SELECT conv_id, budget, total AS input, output, read[done + 1] AS overhead, cached, total - cached AS fresh, shorter[done + 1] AS summarized, cut AS dropped, shorter[done + 1] + cut > 0 AS engaged
  FROM r JOIN x USING (conv_id) QUALIFY row_number() OVER (PARTITION BY conv_id, budget ORDER BY k DESC) = 1),
z AS (SELECT w.*, b.input AS base_input, b.cached AS base_cached, b.fresh AS base_fresh FROM w JOIN w b ON b.conv_id = w.conv_id AND b.budget = 0 WHERE w.budget > 0)"""


def _replayed(spark, sf_dir):
    return history.replay(turns(spark, sf_dir), numbers(spark, BUDGETS), SYSTEM, WORDS)


@query(f"WITH RECURSIVE {REPLAY_SQL} SELECT conv_id, budget, input, output, overhead, cached, fresh, summarized, dropped, engaged, base_input, base_cached FROM z")
def replay_compressed(spark, sf_dir):
    return _replayed(spark, sf_dir)


def _per_budget(exprs: str) -> str:
    return f"WITH RECURSIVE {REPLAY_SQL} SELECT budget, {exprs} FROM z GROUP BY 1"


_IN, _OUT, _OVER = (*PRICES[MODEL], PRICES[SUMMARIZER][0])
_CUT = "coalesce(avg(CASE WHEN {0} > 0 THEN ({0} - {1}) * 100.0 / {0} ELSE 0.0 END), 0.0)".format
_USD = f"((input + output) * {_IN} / 1e6 + overhead * {_OVER} / 1e6)"
_BASE_USD = f"((base_input + output) * {_IN} / 1e6)"
_NET_COST = f"CASE WHEN sum({_BASE_USD}) > 0 THEN (sum({_BASE_USD}) - sum({_USD})) * 100.0 / sum({_BASE_USD}) ELSE 0.0 END"


@query(
    _per_budget(
        f"""round({_CUT('(base_input + output)', '(input + output)')}, 6) AS gross_reduction, round({_CUT('(base_input + output)', '(input + output + overhead)')}, 6) AS net_reduction, round({_NET_COST}, 6) AS net_cost_reduction,
        round({_CUT(_BASE_USD, _USD)}, 6) AS mean_cost_reduction, avg(overhead) AS mean_overhead, count(*) FILTER (engaged) AS engaged, count(*) AS trajectories"""
    )
)
def replay_sweep(spark, sf_dir):
    rows = metrics.replay_sweep(_replayed(spark, sf_dir), MODEL, SUMMARIZER)
    return rows.withColumns({c: F.round(c, 6) for c in rows.columns if c.endswith("reduction")})


@query(f"SELECT budget, net_cost_reduction FROM ({_per_budget(f'round({_NET_COST}, 6) AS net_cost_reduction')}) ORDER BY net_cost_reduction DESC, budget DESC LIMIT 1")
def best_replay_budget(spark, sf_dir):
    rows = metrics.replay_sweep(_replayed(spark, sf_dir), MODEL, SUMMARIZER).withColumn("net_cost_reduction", F.round("net_cost_reduction", 6))
    return metrics.first_by(rows, [], F.desc("net_cost_reduction"), F.desc("budget")).select("budget", "net_cost_reduction")


def _cached_cut(share: float) -> str:
    price = "((({0}fresh + {0}cached * " + str(share) + f") * {_IN} + output * {_OUT} + {{1}} * {_OVER}) / 1e6)"
    return f"round({_CUT(price.format('base_', '0'), price.format('', 'overhead'))}, 6)"


_HIT = "avg(coalesce({0}cached / nullif({0}cached + {0}fresh, 0), 0))".format


@query(
    _per_budget(f"round({_HIT('base_')}, 6) AS base_hit, round({_HIT('')}, 6) AS treat_hit, {_cached_cut(1.0)} AS no_cache_reduction, {_cached_cut(0.5)} AS half_reduction, {_cached_cut(0.1)} AS tenth_reduction, count(*) FILTER (engaged) AS engaged")
)
def cache_cost_sweep(spark, sf_dir):
    rows = metrics.cache_sweep(_replayed(spark, sf_dir), MODEL, SUMMARIZER, {"no_cache": 1.0, "half": 0.5, "tenth": 0.1})
    return rows.withColumns({c: F.round(c, 6) for c in rows.columns if c.endswith(("hit", "reduction"))})
