"""Change feeds: debounced sessions of events, in batch and as a stream, and the handler that keeps a store current."""

from __future__ import annotations

import contextlib
import datetime
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import ChunkStore
from ..sources.files import source_paths

#: Event kinds that count as changes.
CHANGES = ("write", "create", "remove", "rename")


def changes(events: DataFrame, kinds: tuple[str, ...] = CHANGES, kind_col: str = "op", match=None) -> DataFrame:
    """Events of the kinds, and if `match` is given those it holds for."""
    rows = events.where(F.col(kind_col).isin(*kinds))
    return rows if match is None else rows.where(match)


def debounce(events: DataFrame, gap_ms: int, ts: str = "ts", path: str = "path", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, session_start, session_end, events, paths): runs of events no more than the gap apart, with their distinct paths.

    Events first fall into cells of the gap's length: those of one cell are one run. Only cells are put in order, so
    without a key one task sees a row for each cell in use rather than for each event.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_ts"), micros.alias("_us"), F.col(path).alias("_path"))
    rows = rows.withColumn("_cell", F.floor(F.col("_us") / (gap_ms * 1000)).cast("long"))
    cells = rows.groupBy(*keys, "_cell").agg(F.min("_us").alias("a"), F.max("_us").alias("b"))
    order = Window.partitionBy(*keys).orderBy("_cell")
    opens = F.coalesce(F.col("a") - F.lag("b").over(order) > gap_ms * 1000, F.lit(True))
    cells = cells.withColumn("_opens", opens.cast("long")).withColumn("_session", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).select(*keys, "_cell", "_session")
    found = rows.join(cells, [*keys, "_cell"]).groupBy(*keys, "_session")
    return found.agg(F.min("_ts").alias("session_start"), F.max("_ts").alias("session_end"), F.count("*").alias("events"), F.array_sort(F.collect_set("_path")).alias("paths")).drop("_session")


def debounce_stream(events: DataFrame, gap: str = "200 milliseconds", watermark: str = "10 minutes", ts: str = "ts", path: str = "path", keys: tuple[str, ...] = ()) -> DataFrame:
    """The same on a stream: session windows, closed when the watermark passes them; later events are dropped."""
    rows = events.withWatermark(ts, watermark).withColumn("_all", F.lit(0))  # a stream's session needs a key
    return rows.groupBy(F.session_window(ts, gap).alias("w"), *(keys or ("_all",))).agg(F.count("*").alias("events"), F.array_sort(F.collect_set(path)).alias("paths")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "paths")


def watch_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New JSON event files of a folder as a stream."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).json(folder)


class TreeReader(SimpleDataSourceStreamReader):
    """Scans of a tree, each told apart from the one before: (path, op, ts) of files that appeared, changed or went."""

    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix
        self.seen: dict[str, tuple[int, int]] = {}
        self.log: dict[int, list[tuple]] = {}

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def scan(self) -> list[tuple]:
        now, found = datetime.datetime.now(), {}
        for path in source_paths(self.root, self.suffix):
            with contextlib.suppress(OSError):  # gone meanwhile
                s = os.stat(os.path.join(self.root, path))
                found[path] = s.st_mtime_ns, s.st_size
        before, self.seen = self.seen, found
        ops = {p: "create" if p not in before else "write" for p, state in found.items() if before.get(p) != state}
        return [(p, op, now) for p, op in (ops | dict.fromkeys(before.keys() - found.keys(), "remove")).items()]

    def read(self, start: dict):
        rows = self.scan()
        end = start["scan"] + bool(rows)
        self.log[end] = rows
        return iter(rows), {"scan": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        """What scans told; a reader that has started anew tells all there is, so a handler sees every change at least once."""
        known = range(start["scan"] + 1, end["scan"] + 1)
        return iter([r for k in known for r in self.log[k]] if all(k in self.log for k in known) else self.scan())

    def commit(self, end: dict) -> None:
        for k in [k for k in self.log if k <= end["scan"]]:
            del self.log[k]


class TreeSource(DataSource):
    """A folder tree that the driver sees, watched for files of a suffix; folders that a scan skips are skipped here too."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, op string, ts timestamp"

    def simpleStreamReader(self, schema) -> TreeReader:
        return TreeReader(self.options["root"], self.options.get("suffix", ".py"))


def watch_tree(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """Changes of files below a folder as a stream (path, op, ts): each micro-batch is a scan of the tree."""
    spark.dataSource.register(TreeSource)
    return spark.readStream.format("source_tree").option("root", root).option("suffix", suffix).load()


def keep_current(changed: DataFrame, store: ChunkStore, read: Callable[[DataFrame], DataFrame], chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
    """Bring a store up to date from a stream of changed paths: `read` gives (path, content) of those that exist; others are deleted.

    A micro-batch is one write. stop() of the returned query ends it between writes.
    """

    def handle(batch: DataFrame, _: int) -> None:
        paths = batch.where(F.col("path").endswith(".py")).select("path").distinct().persist()
        files = read(paths).persist()
        # a file without chunks loses those it had
        store.apply(chunk(files), paths, embed)
        files.unpersist()
        paths.unpersist()

    return changed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
