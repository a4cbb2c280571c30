"""Greedy packing in order: embedding batches, and windows of lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, token_count


def greedy_starts(sizes: np.ndarray, max_items: int, max_size: int) -> list[int]:
    """Where bins begin: a bin closes before it would exceed either limit; a large item stands alone."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    starts, at = [], 0
    while at < len(sizes):
        starts.append(at)
        at = max(at + 1, min(at + max_items, int(np.searchsorted(upto, upto[at] + max_size, "right")) - 1))
    return starts


def embedding_batches(texts: DataFrame, max_items: int = 128, max_tokens: int = 100_000, key: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, order, est_tokens, batch): each key's texts in order cut into requests within both limits, by estimated tokens.

    Requests of a key follow from all texts before them, so its sizes pass through one task, as numbers in a stream of
    which nothing is held but the open request. Texts stay where they are.
    """
    rows = texts.select(F.col(key).alias("key"), F.col(order).alias("item"), estimated_tokens(text).alias("est_tokens"))

    def run(batches):
        now, first, batch_no, items, size = None, True, 0, 0, 0
        for batch in batches:
            out = []
            for k, n in zip(batch.column("key").to_pylist(), batch.column("est_tokens").to_pylist(), strict=True):
                if first or k != now:
                    now, first, batch_no, items, size = k, False, 0, 0, 0
                elif items >= max_items or size + n > max_tokens:
                    batch_no, items, size = batch_no + 1, 0, 0
                items, size = items + 1, size + n
                out.append(batch_no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "batch"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    placed = rows.repartition("key").sortWithinPartitions("key", "item").mapInArrow(run, f"key {kinds['key']}, item {kinds['item']}, est_tokens long, batch int")
    return placed.select(F.col("key").alias(key), F.col("item").alias(order), "est_tokens", "batch")


def line_chunks(texts: DataFrame, max_tokens: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, chunk, start_line, end_line, tokens): windows of consecutive lines within the limit; a longer line stands alone.

    Lines count from 1. Only the lines' token counts leave the JVM.
    """
    rows = texts.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.transform(F.split(text, "\n"), lambda x: token_count(x)).alias("sizes"))

    def run(batches):
        for batch in batches:
            lengths = batch.column("sizes").value_lengths().to_numpy()
            ends = np.cumsum(lengths)
            flat = batch.column("sizes").flatten().to_numpy()
            owner, chunk, first, last, tokens = ([] for _ in range(5))
            for row, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist(), strict=True)):
                sizes = flat[end - n : end]
                starts = greedy_starts(sizes, n + 1, max_tokens)
                owner += [row] * len(starts)
                chunk += range(len(starts))
                first += [s + 1 for s in starts]
                last += [*starts[1:], n]
                tokens.append(np.add.reduceat(sizes, starts))
            sums = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner, pa.int64())), pa.array(chunk, pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(sums, pa.int64())], names)

    names = ["id", "chunk", "start_line", "end_line", "tokens"]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, chunk int, start_line int, end_line int, tokens long").withColumnRenamed("id", id_col)


def read_spans(files: DataFrame, requests: DataFrame, max_lines: int = 400) -> DataFrame:
    """Requests (path, start, end) with `text`, a header and numbered lines, or `error`.

    start defaults to 1, end to max_lines from start; an end before start is start; spans are cut to the file and to
    max_lines. Absolute paths and those that begin with .. are refused.
    """
    lines = files.select(F.col("path").alias("_path"), F.split("content", "\n").alias("_lines"))
    rows = requests.join(lines, F.col("path") == F.col("_path"), "left")
    n = F.size("_lines")
    start = F.when(F.col("start") > 0, F.col("start")).otherwise(1)
    end = F.greatest(start, F.least(F.coalesce(F.nullif(F.greatest(F.col("end"), F.lit(0)), F.lit(0)), start + max_lines - 1), n, start + max_lines - 1))
    error = F.when(F.col("path").startswith("/") | F.col("path").startswith(".."), "path outside the repository").when(F.col("_path").isNull(), "no such file").when(start > n, "start is beyond the end of the file")
    rows = rows.withColumn("error", error).withColumn("_s", start).withColumn("_e", end)
    body = F.array_join(F.transform(F.slice("_lines", F.col("_s"), F.col("_e") - F.col("_s") + 1), lambda x, i: F.concat((F.col("_s") + i).cast("string"), F.lit(": "), x)), "\n")
    text = F.concat(F.col("path"), F.lit(":"), F.col("_s").cast("string"), F.lit("-"), F.col("_e").cast("string"), F.lit("\n"), body)
    return rows.select(*requests.columns, F.when(F.col("error").isNull(), text).alias("text"), "error")


def parse_patches(patches: DataFrame) -> DataFrame:
    """(patch_id, path, symbol) of every hunk header of unified diffs that names a function or class, in first-seen order.

    patches: patch_id, patch. The file of the last `+++ b/` line holds for the hunks below it.
    """
    lines = patches.select("patch_id", F.posexplode(F.split("patch", "\n")).alias("n", "line"))
    path = F.nullif(F.regexp_extract("line", r"^\+\+\+ b/(.+)$", 1), F.lit(""))
    symbol = F.nullif(F.regexp_extract("line", r"^@@.*@@.*?\b(?:def|class)\s+(\w+)", 1), F.lit(""))
    upto = Window.partitionBy("patch_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("path", F.last(path, ignorenulls=True).over(upto)).withColumn("symbol", symbol).where("symbol is not null and path is not null")
    return rows.groupBy("patch_id", "path", "symbol").agg(F.min("n").alias("n")).select("patch_id", "path", "symbol", F.row_number().over(Window.partitionBy("patch_id").orderBy("n")).alias("place"))


def reanchor(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Gold spans (patch_id, path, start_line, end_line, place): hunks by the symbols of their files, each span once.

    symbols: path, name, start_line, end_line.
    """
    rows = hunks.join(symbols.select("path", F.col("name").alias("symbol"), "start_line", "end_line"), ["path", "symbol"])
    return rows.groupBy("patch_id", "path", "start_line", "end_line").agg(F.min("place").alias("place"))
