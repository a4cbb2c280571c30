"""The chunk store: a Parquet table in parts, of which a write replaces those it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_sha

SCHEMA = "id long, path string, start_line int, end_line int, kind string, content string, content_sha string, dim int, vec array<float>"


def embedding_plan(chunks: DataFrame, stored: DataFrame, anywhere: bool = False) -> DataFrame:
    """chunks with content_sha and the stored vec where the path (or with `anywhere` any path) has that content, else null."""
    keys = ["content_sha"] if anywhere else ["path", "content_sha"]
    known = stored.groupBy(*keys).agg(F.min("vec").alias("vec"))
    return chunks.withColumn("content_sha", content_sha("content")).join(known, keys, "left").select(*chunks.columns, "content_sha", "vec")


def embed_missing(plan: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """plan with every vec filled: `embed` gets the rows without one, by distinct content, as (content_sha, content), and adds vec."""
    missing = plan.where(F.col("vec").isNull()).groupBy("content_sha").agg(F.min("content").alias("content"))
    fresh = embed(missing).select("content_sha", F.col("vec").alias("_fresh"))
    return plan.join(fresh, "content_sha", "left").withColumn("vec", F.coalesce("vec", "_fresh")).drop("_fresh").withColumn("dim", F.size("vec"))


def replace_paths(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored without the paths of fresh, with fresh."""
    changed = fresh.select("path").distinct()
    return stored.join(changed, "path", "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete_paths(stored: DataFrame, paths: DataFrame) -> DataFrame:
    return stored.join(paths.select("path").distinct(), "path", "left_anti")


def snapshot_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): added, changed or removed files between two snapshots (path, sha)."""
    b, n = before.select("path", F.col("sha").alias("b")), now.select("path", F.col("sha").alias("n"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("b") != F.col("n"), "changed")
    return b.join(n, "path", "full").select("path", change.alias("change")).where(F.col("change").isNotNull())


def pending_runs(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned runs without a finished one."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


#: Parts of a store by the hash of the path.
PARTS = 64


class ChunkStore:
    """Chunks in parts by a hash of their path. A manifest names each part's folder and moves in one step.

    A write replaces only the parts that its paths fall into. Readers keep the folders that the manifest named when they
    opened it; `vacuum` removes those that no manifest since the last two names.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        """{"parts": {part: folder}, "next_id": n, "before": folders of the manifest before}"""
        pointer = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(pointer):
            return {"parts": {}, "next_id": 0, "before": []}
        stream = self._fs.open(pointer)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        fresh = self._path(f"{self.folder}/CURRENT.{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        rename = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE  # one step where the file system has it
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(self._path(f"{self.folder}/CURRENT")), options)

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], SCHEMA)

    def read(self) -> DataFrame:
        return self._read(sorted(self._manifest()["parts"].values()))

    def count(self) -> int:
        return self.read().count()

    def apply(self, chunks: DataFrame, gone: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> None:
        """One write: replace the chunks of all paths in `chunks` (path, start_line, end_line, kind, content), remove those of the paths in `gone`.

        Known content of a path keeps its vector; ids go on from the highest ever given.
        """
        part = F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int")
        chunks = chunks.persist()
        try:
            paths = chunks.select("path").unionByName(gone.select("path")).distinct().persist()
            touched = sorted(r[0] for r in paths.select(part).distinct().collect())  # PARTS numbers at most
            if not touched:
                return
            manifest = self._manifest()
            stored = self._read([manifest["parts"][str(k)] for k in touched if str(k) in manifest["parts"]])
            fresh = embed_missing(embedding_plan(chunks, stored), embed).withColumn("id", F.lit(manifest["next_id"]) + F.monotonically_increasing_id())
            rows = delete_paths(stored, paths).unionByName(fresh, allowMissingColumns=True)
            version = f"v-{uuid.uuid4().hex}"
            columns = [F.col(c.split()[0]).cast(" ".join(c.split()[1:])) for c in SCHEMA.split(", ")]
            rows.select(*columns, part.alias("part")).repartition("part").write.partitionBy("part").parquet(f"{self.folder}/{version}")
            parts = {k: f for k, f in manifest["parts"].items() if int(k) not in touched}
            parts |= {str(k): f"{version}/part={k}" for k in touched if self._fs.exists(self._path(f"{self.folder}/{version}/part={k}"))}
            top = self._read([parts[str(k)] for k in touched if str(k) in parts]).agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
            self._publish({"parts": parts, "next_id": max(manifest["next_id"], top + 1), "before": sorted(manifest["parts"].values())})
            paths.unpersist()
        finally:
            chunks.unpersist()

    def upsert(self, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> None:
        self.apply(chunks, chunks.select("path").limit(0), embed)

    def delete(self, paths: DataFrame) -> None:
        none = self.spark.createDataFrame([], "path string, start_line int, end_line int, kind string, content string")
        self.apply(none, paths, lambda rows: rows.withColumn("vec", F.lit(None).cast("array<float>")))

    def build(self, files: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame]) -> int:
        """Index all files (path, content); the number of files."""
        self.upsert(chunk(files), embed)
        return files.count()

    def vacuum(self) -> int:
        """Remove part folders that neither the manifest nor the one before it names; how many."""
        manifest = self._manifest()
        named = {*manifest["parts"].values(), *manifest["before"]}
        found = self._fs.globStatus(self._path(f"{self.folder}/v-*/part=*")) or []
        old = [x.getPath() for x in found if "/".join(x.getPath().toString().rsplit("/", 2)[1:]) not in named]
        for path in old:
            self._fs.delete(path, True)
        return len(old)
