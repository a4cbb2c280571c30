"""Markdown reports from small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell(value, form: str = "") -> str:
    """A table cell: a tick or cross for truth values, a dash for what is missing."""
    if value is None:
        return "—"
    if isinstance(value, bool):
        return "✓" if value else "✗"
    return format(value, form)


def markdown_table(rows: DataFrame, columns: dict[str, tuple[str, str]]) -> str:
    """A table of the rows as they are ordered; columns: heading -> (column, number format)."""
    found = rows.select(*[c for c, _ in columns.values()]).collect()  # report tables have a row for each task or budget
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(cell(v, form) for v, (_, form) in zip(r, columns.values(), strict=True)) + " |" for r in found]
    return "\n".join(lines) + "\n"


def _report(title: str, lead: list[str], table: str) -> str:
    return "\n".join([f"# {title}", "", *lead, "", table])


def report_order(results: DataFrame) -> DataFrame:
    """Localization tasks first, then by id."""
    return results.orderBy(F.when(F.col("bucket") == "localization", 0).otherwise(1), "id")


def retrieval_report(results: DataFrame, headline: DataFrame) -> str:
    h = headline.first()
    lead = [f"- recall@k (localization): {h.recall_at_k:.3f}", f"- mean retrieved tokens: {h.mean_tokens:.0f}"]
    return _report("Stage 1: retrieval", lead, markdown_table(report_order(results), {"task": ("id", ""), "bucket": ("bucket", ""), "gold": ("gold_size", "d"), "recall": ("recall", ".3f"), "tokens": ("retrieved_tokens", "d")}))


def assembly_report(sweep: DataFrame, boundary: int) -> str:
    lead = [f"- highest budget with a drop: {boundary}" if boundary else "- nothing was dropped at any budget"]
    columns = {"budget": ("budget", "d"), "mean tokens": ("mean_tokens", ".0f"), "by skeletons %": ("skeleton_reduction", ".1f"), "total %": ("total_reduction", ".1f"), "dropped": ("dropped", "d"), "tasks with drops": ("tasks_with_drops", "d")}
    return _report("Stage 2: assembly under a budget", lead, markdown_table(sweep.orderBy(F.desc("budget")), columns))


def arms_report(arms: DataFrame, best: int | None) -> str:
    columns = {"arm": ("arm", ""), "budget": ("budget", "d"), "success": ("success_rate", ".3f"), "tokens": ("mean_total", ".0f"), "cost USD": ("mean_cost", ".6f"), "cache hit": ("cache_hit", ".3f"), "summarized": ("mean_summarized", ".2f"), "dropped": ("mean_dropped", ".2f")}
    return _report("Stage 3: end to end", [f"- best valid budget: {cell(best)}"], markdown_table(arms.orderBy("arm", F.desc("budget")), columns))


def replay_report(sweep: DataFrame) -> str:
    columns = {"budget": ("budget", "d"), "net cost %": ("net_cost_reduction", ".1f"), "gross tokens %": ("gross_reduction", ".1f"), "net tokens %": ("net_reduction", ".1f"), "overhead": ("mean_overhead", ".0f"), "engaged": ("engaged", "d")}
    return _report("Stage 3: replayed trajectories", ["Token reductions are means over trajectories, the cost reduction is that of the sums."], markdown_table(sweep.orderBy(F.desc("budget")), columns))


def cache_report(sweep: DataFrame) -> str:
    columns = {"budget": ("budget", "d"), "hit before": ("base_hit", ".3f"), "hit after": ("treat_hit", ".3f"), "no cache %": ("no_cache_reduction", "+.1f"), "at 0.5 %": ("half_reduction", "+.1f"), "at 0.1 %": ("tenth_reduction", "+.1f"), "engaged": ("engaged", "d")}
    return _report("Stage 3 under prefix caching", ["Positive: cheaper than without compression."], markdown_table(sweep.orderBy(F.desc("budget")), columns))
