"""Compressing agent histories to a budget, replaying trajectories, and prefix-cache accounting."""

from __future__ import annotations

import bisect
import itertools
import operator
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import sized_summary, token_count

#: Fixed value: what stands for an observation that was left out.
MARKER = "[earlier observation omitted]"
MARKER_TOKENS = 3
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def with_protected(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """turns (key, step, role, ...) with `protected`: the first user turn, and all from the last assistant turn on."""
    whole = Window.partitionBy(key)
    goal = F.min(F.when(F.col("role") == "user", F.col("step"))).over(whole)
    action = F.max(F.when(F.col("role") == "assistant", F.col("step"))).over(whole)
    return turns.withColumn("protected", F.coalesce(F.col("step") == goal, F.lit(False)) | F.coalesce(F.col("step") >= action, F.lit(False)))


def compress(turns: DataFrame, budgets: DataFrame, summary: Callable[[Column], Column] = lambda c: sized_summary(c, 30), min_tokens: int = 0, key: str = "conv_id") -> DataFrame:
    """One compression pass: every turn under every budget with new_content, new_tokens, compressed, summarized, dropped.

    turns: key, step, role, content[, compressed]. While a history exceeds its budget the oldest unprotected
    observations (role tool) are summarized, then, if need be, replaced by a marker, oldest first. The running sums say
    for each turn whether those before it sufficed.
    """
    if "compressed" not in turns.columns:
        turns = turns.withColumn("compressed", F.lit(False))
    # counted below the window's exchange, so once and not for each budget
    rows = with_protected(turns.withColumn("tokens", token_count("content")).withColumn("summary", summary(F.col("content"))).withColumn("summary_tokens", token_count("summary")), key)
    free = (F.col("role") == "tool") & ~F.col("protected") & (F.col("content") != MARKER)
    rows = rows.withColumn("can_sum", free & ~F.col("compressed") & (F.col("tokens") > min_tokens if min_tokens > 0 else F.lit(True)))
    rows = rows.withColumn("can_drop", free).join(F.broadcast(budgets), how="cross")
    whole = Window.partitionBy(key, "budget")
    before = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    upto = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("tokens").over(whole)
    saving = F.when(F.col("can_sum"), F.greatest(F.col("tokens") - F.col("summary_tokens"), F.lit(0))).otherwise(0)
    acts = (F.col("budget") > 0) & (total > F.col("budget"))
    rows = rows.withColumn("acts", acts).withColumn("marked", F.col("can_sum") & F.col("acts") & (total - F.coalesce(F.sum(saving).over(before), F.lit(0)) > F.col("budget")))
    rows = rows.withColumn("summarized", F.col("marked") & (F.col("summary_tokens") < F.col("tokens")))
    rows = rows.withColumn("mid", F.when(F.col("summarized"), F.col("summary_tokens")).otherwise(F.col("tokens")))
    gain = F.when(F.col("can_drop"), F.col("mid") - MARKER_TOKENS).otherwise(0)
    rows = rows.withColumn("left", F.sum("mid").over(whole) - F.sum(gain).over(upto))  # tokens if all up to here were dropped
    least = F.least(F.sum("mid").over(whole), F.coalesce(F.min("left").over(before), F.sum("mid").over(whole)))
    rows = rows.withColumn("dropped", F.col("can_drop") & F.col("acts") & (least > F.col("budget")))
    return rows.select(
        *turns.columns[: turns.columns.index("compressed")], *[c for c in turns.columns[turns.columns.index("compressed") + 1 :]], "budget", "protected", "tokens",
        (F.col("compressed") | F.col("marked")).alias("compressed"), "summarized", "dropped",
        F.when(F.col("dropped"), MARKER).when(F.col("summarized"), F.col("summary")).otherwise(F.col("content")).alias("new_content"),
        F.when(F.col("dropped"), MARKER_TOKENS).otherwise(F.col("mid")).cast("long").alias("new_tokens"),
        F.when(F.col("marked"), F.col("tokens")).otherwise(0).cast("long").alias("summarizer_input"), F.when(F.col("marked"), F.col("summary_tokens")).otherwise(0).cast("long").alias("summarizer_output"),
    )


def compression_totals(rows: DataFrame, instruction_tokens: int = 0, key: str = "conv_id") -> DataFrame:
    """Per history and budget: tokens before and after, counts, and the summarizer's calls and tokens."""
    calls = F.count(F.when(F.col("summarizer_input") > 0, 1))
    return rows.groupBy(key, "budget").agg(
        F.sum("tokens").alias("tokens"), F.sum("new_tokens").alias("new_tokens"), F.sum(F.col("summarized").cast("long")).alias("summarized"), F.sum(F.col("dropped").cast("long")).alias("dropped"),
        calls.alias("calls"), (F.sum("summarizer_input") + calls * instruction_tokens).alias("summarizer_input"), F.sum("summarizer_output").alias("summarizer_output"),
    )


def replay_plain(turns: DataFrame, system_tokens: int, key: str = "conv_id") -> DataFrame:
    """(key, prompts, input, output) without compression: each assistant turn is sent system text and all before it."""
    rows = turns.withColumn("tokens", token_count("content"))
    before = Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("sent", F.coalesce(F.sum("tokens").over(before), F.lit(0)) + system_tokens)
    own = F.col("role") == "assistant"
    return rows.groupBy(key).agg(F.count(F.when(own, 1)).alias("prompts"), F.coalesce(F.sum(F.when(own, F.col("sent"))), F.lit(0)).alias("input"), F.coalesce(F.sum(F.when(own, F.col("tokens"))), F.lit(0)).alias("output"))


def plain_prompts(turns: DataFrame, system_tokens: int, key: str = "conv_id") -> DataFrame:
    """(key, prompt, blocks, cached_blocks, cached, fresh) of every prompt without compression.

    Such a prompt extends the one before, so running sums tell what a prefix cache holds; no prompt is written out.
    """
    order = Window.partitionBy(key).orderBy("step")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("sent", F.coalesce(F.sum(token_count("content")).over(before), F.lit(0)) + system_tokens).withColumn("blocks", F.row_number().over(order))
    rows = rows.where(F.col("role") == "assistant").select(key, "step", "blocks", "sent")  # the system text and the turns before this one
    last = lambda c: F.coalesce(F.lag(c).over(order), F.lit(0))
    return rows.select(key, F.row_number().over(order).alias("prompt"), "blocks", last("blocks").alias("cached_blocks"), last("sent").alias("cached"), (F.col("sent") - last("sent")).alias("fresh"))


def cache_split(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (keys, prompt, block, tokens, hash) with `cached`: this block and all before it equal those of the prompt before."""
    place = Window.partitionBy(*keys, "block").orderBy("prompt")
    same = (F.lag("hash").over(place) == F.col("hash")) & (F.lag("prompt").over(place) == F.col("prompt") - 1)
    upto = Window.partitionBy(*keys, "prompt").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("_same", F.coalesce(same, F.lit(False)).cast("int")).withColumn("cached", F.min("_same").over(upto) == 1).drop("_same")


def cache_totals(split: DataFrame, keys: list[str]) -> DataFrame:
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0))
    return split.groupBy(*keys).agg(part(F.col("cached")).alias("cached"), part(~F.col("cached")).alias("fresh"), F.max("prompt").alias("prompts"))


def count_words(text: str | None) -> int:
    return len(_WORD.findall(text or ""))


def size_summary(text: str, words: int) -> str:
    head, _, rest = text.partition("\n")
    kept = _WORD.findall(rest)
    kept = kept[:words] if words > 0 else kept
    return " ".join([head, *kept]) if kept else head


class Trajectory:
    """Token sums of a trajectory from which every budget's replay follows.

    A pass works on observations from the oldest on, so what it has summarized and what it has dropped are two prefixes
    of the list of observations. Sums over prefixes say what either has saved; a replay moves two marks and adds up.
    """

    def __init__(self, is_action, is_tool, size, calls, short, fixed, min_tokens: int = 0):
        size, short = np.asarray(size, np.int64), np.asarray(short, np.int64)
        block = size + np.asarray(calls, np.int64)
        self.actions = np.flatnonzero(is_action)
        self.output = int(block[self.actions].sum())
        self.sent = np.concatenate([[0], np.cumsum(block)])  # tokens of all turns before one, as prompts hold them
        told = np.concatenate([[0], np.cumsum(size)])  # the same of contents alone, which budgets are about
        stop = np.append(np.flatnonzero(~np.asarray(is_tool, bool)), len(size))
        self.told = told[stop[np.searchsorted(stop, self.actions, "right")]]  # after the observations of each action
        self.tools = np.flatnonzero(np.asarray(is_tool, bool) & ~np.asarray(fixed, bool))
        self.open = np.searchsorted(self.tools, self.actions)  # observations that the pass after an action may touch
        size, short = size[self.tools], short[self.tools]
        asked = size > min_tokens if min_tokens > 0 else np.ones(len(size), bool)
        saving = np.where(asked, np.maximum(size - short, 0), 0)
        sums = lambda x: [0, *np.cumsum(x).tolist()]
        self.saved, self.shorter, self.read = sums(saving), sums(saving > 0), sums(np.where(asked, size + short, 0))
        self.gain = (size - saving - MARKER_TOKENS).tolist()
        self.gone = sums(self.gain)

    def plain(self, system_tokens: int) -> tuple[int, int]:
        """Input and cached tokens without compression."""
        sent = self.sent[self.actions] + system_tokens
        return int(sent.sum()), int(sent[:-1].sum())

    def replay(self, budget: int, system_tokens: int) -> tuple[int, int, int, int, int]:
        """Input, cached and summarizer's tokens, summarized and dropped observations under a budget."""
        total = reused = held = done = cut = 0

        def kept(turn: int, summarized: int, dropped: int) -> int:
            return system_tokens + int(self.sent[turn]) - self.saved[summarized] - self.gone[dropped]

        for action, end, reach in zip(self.actions.tolist(), self.told.tolist(), self.open.tolist(), strict=True):
            reused += held
            total += (held := kept(action, done, cut))  # the next prompt begins like this one, unless a pass rewrites some of it
            over = end - self.saved[done] - self.gone[cut] - budget
            if budget <= 0 or over <= 0:
                continue
            first = len(self.tools)
            if done < reach:
                upto = bisect.bisect_left(self.saved, self.saved[done] + over, done, reach)
                if self.shorter[upto] > self.shorter[done]:
                    first = bisect.bisect_right(self.shorter, self.shorter[done]) - 1
                over -= self.saved[upto] - self.saved[done]
                done = upto
            if over > 0 and cut < reach:
                first = min(first, cut)
                while over > 0 and cut < reach:
                    over -= self.gain[cut]
                    cut += 1
            if first < len(self.tools):
                held = kept(int(self.tools[first]), min(done, first), min(cut, first))
        return total, reused, self.read[done], self.shorter[done], cut


def squeeze(sizes: list[int], free: list[int], fresh: set[int], budget: int, shorten: Callable[[int], int], marker: int = MARKER_TOKENS) -> tuple[list[int], list[int]]:
    """What a pass over live turns does: places that took their summary, and places to drop.

    sizes: tokens of every turn; free: places a pass may touch, oldest first; fresh: those of them not yet summarized.
    `shorten` asks for the summary of a place and gives its tokens; it is called only while the budget is exceeded.
    """
    if budget <= 0:
        return [], []
    size = dict(enumerate(sizes))
    over = sum(sizes) - budget
    shorter: list[int] = []
    asked = (p for p in free if p in fresh)
    while over > 0 and (place := next(asked, None)) is not None:
        if (less := size[place] - shorten(place)) > 0:
            size[place] -= less
            over -= less
            shorter.append(place)
    left = itertools.accumulate((size[p] - marker for p in free), operator.sub, initial=over)
    return shorter, [p for p, more in zip(free, itertools.takewhile(lambda x: x > 0, left), strict=False)]


def replay(turns: DataFrame, budgets: DataFrame, system_tokens: int, words: int = 30, key: str = "conv_id", min_tokens: int = 0) -> DataFrame:
    """(key, budget, input, output, overhead, cached, fresh, summarized, dropped, engaged, base_input, base_cached); budget 0: not compressed.

    turns: key, step, role, content[, call_tokens]. Texts stay in the JVM, which counts their tokens and those of their
    summaries; a trajectory's counts go to Python once and give every budget, and the base without compression.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    tool = F.col("role") == "tool"
    calls = F.col("call_tokens") if "call_tokens" in turns.columns else F.lit(0)
    facts = F.struct(
        "step", F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("is_action"), F.coalesce(tool, F.lit(False)).alias("is_tool"), token_count(content).alias("size"), calls.cast("long").alias("calls"),
        F.when(tool, token_count(sized_summary(content, words))).otherwise(0).cast("long").alias("short"), (content == MARKER).alias("fixed"),
    )
    kind = turns.schema[key].dataType.simpleString()
    every = budgets.agg(F.sort_array(F.collect_set(F.col("budget").cast("int"))).alias("budgets"))
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(facts)).alias("turns")).crossJoin(F.broadcast(every))  # budgets are one row

    def fold(batches):
        for batch in batches:
            limits = np.concatenate([[0], np.cumsum(batch.column("turns").value_lengths().to_numpy())]).tolist()
            flat = batch.column("turns").flatten()
            columns = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("is_action", "is_tool", "size", "calls", "short", "fixed")]
            out = []
            for k, name, wanted in zip(range(batch.num_rows), batch.column(key).to_pylist(), batch.column("budgets").to_pylist(), strict=True):
                own = Trajectory(*(c[limits[k] : limits[k + 1]] for c in columns), min_tokens=min_tokens)
                base, base_cached = own.plain(system_tokens)
                for budget in wanted:
                    total, cached, read, shorter, cut = own.replay(budget, system_tokens)
                    out.append((name, budget, total, own.output, read, cached, total - cached, shorter, cut, shorter + cut > 0, base, base_cached))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t.type) for c, t in enumerate(arrow)], schema=arrow)

    names = ["input", "output", "overhead", "cached", "fresh", "summarized", "dropped"]
    schema = f"{key} {kind}, budget int, " + ", ".join(f"{n} long" for n in names) + ", engaged boolean, base_input long, base_cached long"
    arrow = pa.schema([(key, to_arrow_type(turns.schema[key].dataType)), ("budget", pa.int32()), *((n, pa.int64()) for n in names), ("engaged", pa.bool_()), ("base_input", pa.int64()), ("base_cached", pa.int64())])
    return rows.mapInArrow(fold, schema)
