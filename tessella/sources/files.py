"""Sources and sinks: source trees, task files, meter records, trajectories, paged JSON."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that a scan leaves out, besides those that begin with a dot.
SKIPPED = {"vendor", "node_modules"}

TASK = "id string, query string, bucket string, gold array<struct<path:string,start:int,end:int>>, source string"
RECORD = "task_id string, stage int, buckets map<string,long>, total long"
_CALL = "struct<ID:string,Name:string,Args:string>"
TRAJECTORY = (
    "task_id string, arm string, budget int, repeat int, query string, localization boolean, success boolean, recall double, stop_reason string, turns int, "
    "buckets map<string,long>, prompt_tokens long, cached_tokens long, completion_tokens long, summarized int, dropped int, "
    f"locations array<struct<path:string,start:int,end:int>>, messages array<struct<Role:string,Content:string,ToolCalls:array<{_CALL}>,ToolCallID:string,Origin:string,Compressed:boolean>>"
)


def source_paths(root: str, suffix: str = ".py") -> Iterator[str]:
    """Relative paths in name order; what can't be read is left out."""
    for folder, folders, names in os.walk(root):
        folders[:] = _folders(folder)
        yield from (os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in sorted(names) if n.endswith(suffix))


def scan_sources(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """(path, content) of a source tree on a file system that all workers share.

    Spark's own listing hides names that begin with _ or a dot, so __init__.py would be missing. The driver looks only
    into as many folders as give each worker some; workers walk what lies below and read the files.
    """
    wanted = 4 * spark.sparkContext.defaultParallelism
    todo, flat = [""], []  # folders to walk whole, and those of which only their own files are left
    while todo and len(todo) < wanted:
        flat += todo
        todo = [os.path.join(f, d) for f in todo for d in _folders(os.path.join(root, f))]
    rows = [(f, True) for f in todo] + [(f, False) for f in flat]
    folders = spark.createDataFrame(rows, "folder string, whole boolean").repartition(max(1, min(len(rows), wanted)))

    def read(frames):
        for frame in frames:
            for folder, whole in zip(frame.folder, frame.whole, strict=True):
                base = os.path.join(root, folder)
                names = source_paths(base, suffix) if whole else (n for n in _names(base) if n.endswith(suffix) and os.path.isfile(os.path.join(base, n)))
                out, size = [], 0
                for n in names:
                    try:
                        with open(os.path.join(base, n), encoding="utf-8", errors="replace", newline="") as f:
                            out.append((os.path.join(folder, n).replace(os.sep, "/"), f.read()))
                    except OSError:
                        continue
                    size += len(out[-1][1])
                    if size > 16 << 20:
                        yield pd.DataFrame(out, columns=["path", "content"])
                        out, size = [], 0
                yield pd.DataFrame(out, columns=["path", "content"])

    return folders.mapInPandas(read, "path string, content string")


def _names(folder: str) -> list[str]:
    try:
        return sorted(os.listdir(folder))
    except OSError:
        return []


def _folders(folder: str) -> list[str]:
    """Folders that a scan goes into."""
    return [n for n in _names(folder) if not n.startswith(".") and n not in SKIPPED and os.path.isdir(os.path.join(folder, n)) and not os.path.islink(os.path.join(folder, n))]


def load_tasks(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The head (target_repo, target_sha) and the tasks of a YAML task file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    rows = [(t.get("id"), t.get("query"), t.get("bucket"), [(g.get("path"), g.get("start"), g.get("end")) for g in t.get("gold") or []], t.get("source")) for t in data.get("tasks") or []]
    return {k: data.get(k) for k in ("target_repo", "target_sha")}, spark.createDataFrame(rows, TASK)


def task_violations(tasks: DataFrame, target_sha: str | None = "-") -> DataFrame:
    """(id, rule) for everything a task set must not have; a set without sha breaks a rule of its own."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    tasks = tasks.withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    bad_span = F.exists("gold", lambda g: g["path"].isNull() | (g["path"] == "") | (F.coalesce(g["start"], F.lit(0)) <= 0) | (F.coalesce(g["end"], F.lit(0)) < F.coalesce(g["start"], F.lit(0))))
    rules = {
        "empty id": empty("id"), "repeated id": F.col("_n") > 1, "empty query": empty("query"), "unknown bucket": ~F.coalesce(F.col("bucket").isin("localization", "enumeration"), F.lit(False)),
        "no gold": F.coalesce(F.size("gold"), F.lit(0)) <= 0, "bad gold span": F.coalesce(bad_span, F.lit(False)),
    }
    rows = tasks.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("rule")).distinct()
    if not target_sha:
        rows = rows.unionByName(tasks.sparkSession.createDataFrame([(None, "no target sha")], "id string, rule string"))
    return rows


def write_records(records: DataFrame, root: str) -> None:
    """Meter records as JSON, a folder for each stage and task; a record replaces what its stage and task had."""
    parts = records.select("*", F.col("stage").alias("_stage"), F.col("task_id").alias("_task"))
    parts.repartition("_stage", "_task").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_stage", "_task").json(root)


def read_records(spark: SparkSession, root: str, stage: int | None = None, strict: bool = True) -> DataFrame:
    """Records of all stages or one; a broken file fails a strict read, and is left out otherwise."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    rows = spark.read.schema(RECORD).option("mode", mode).option("multiLine", False).option("recursiveFileLookup", True).json(root)
    return rows if stage is None else rows.where(F.col("stage") == stage)


def read_trajectories(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Trajectory files with a task id and messages; broken ones are left out."""
    rows = spark.read.schema(TRAJECTORY).option("mode", "DROPMALFORMED").option("multiLine", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json").json(folder)
    return rows.where("task_id <> '' and size(messages) > 0")


def paged_rows(fetch: Callable[[int, int], dict], page: int = 100) -> Iterator[dict]:
    """Rows of a paged JSON service: `fetch(offset, length)` gives {"rows": [...], "num_rows_total": n}."""
    at = 0
    while True:
        got = fetch(at, page)
        rows = got.get("rows") or []
        yield from (r.get("row", r) for r in rows)
        at += len(rows)
        if not rows or at >= int(got.get("num_rows_total", at)):
            return


class PagedReader(DataSourceReader):
    """Pages are read by the workers; a service that doesn't tell its total is read page by page by one of them."""

    def __init__(self, fetch: Callable[[int, int], dict], page: int, fields: list[str]):
        self.fetch, self.page, self.fields = fetch, page, fields

    def partitions(self) -> list[InputPartition]:
        total = self.fetch(0, 1).get("num_rows_total")
        return [InputPartition(None)] if total is None else [InputPartition(at) for at in range(0, int(total), self.page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            rows = paged_rows(lambda at, n: {"num_rows_total": 1 << 62} | self.fetch(at, n), self.page)
        else:
            rows = (r.get("row", r) for r in self.fetch(partition.value, self.page).get("rows") or [])
        yield from (tuple(r.get(c) for c in self.fields) for r in rows)


def paged_source(spark: SparkSession, fetch: Callable[[int, int], dict], schema: str, page: int = 100) -> DataFrame:
    """Rows of a paged JSON service; `fetch` must work on the workers."""
    fields = spark.createDataFrame([], schema).columns
    shape, label = schema, f"paged_{uuid.uuid4().hex}"

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return shape

        def reader(self, schema) -> PagedReader:
            return PagedReader(fetch, page, fields)

    spark.dataSource.register(PagedSource)
    return spark.read.format(label).load()
