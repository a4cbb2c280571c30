"""Variable-capacity best-fit packing of texts into sequences of several permitted lengths.

Pieces go by a hash of their row into buckets of some thousand, each packed on its own in one streaming pass. In a
bucket pieces come in order of falling length. Each goes to the open bin that it leaves least room in; where none has
room, a bin opens. All openings (each permitted length as the least to open, and the length of least cost for the
tokens still to come) are packed side by side, every bin is downsized to the smallest length that holds its contents,
and the cheapest of the packings is taken.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count
from .common import stored

#: Permitted lengths in tokens.
CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Tokens at which attention costs as much as all else, so a sequence of n costs n * (1 + n / EVEN).
EVEN = 8192
#: Tokens of a bucket on average.
BUCKET_TOKENS = 1 << 21


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / EVEN)


class Packing:
    """Best-fit with one rule for opening bins; `rest` tells the tokens that are still to come."""

    def __init__(self, capacities: tuple[int, ...], opening: int | None):
        self.capacities, self.opening = capacities, opening
        self.room: list[tuple[int, int]] = []  # open bins by room left
        self.used: list[int] = []
        self.placed: list[tuple[int, int]] = []

    def put(self, n: int, rest: int) -> None:
        at = bisect_left(self.room, (n, -1))
        if at < len(self.room):
            room, b = self.room.pop(at)
        else:
            b, room = len(self.used), self.open(n, rest)
            self.used.append(0)
        self.placed.append((b, self.used[b]))
        self.used[b] += n
        if room > n:
            insort(self.room, (room - n, b))

    def open(self, n: int, rest: int) -> int:
        fitting = [c for c in self.capacities if c >= n]
        if self.opening is not None:
            return max(fitting[0], self.opening)
        return min(fitting, key=lambda c: cost(c) / min(c, max(n, rest)))

    def sizes(self) -> list[int]:
        return [self.capacities[bisect_left(self.capacities, u)] for u in self.used]


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[tuple[int, int]], list[int]]:
    """For lengths in falling order: each one's bin and place in it, and the bins' final lengths."""
    tries = [Packing(capacities, c) for c in (*capacities, None)]
    rest = sum(lengths)
    for n in lengths:
        for t in tries:
            t.put(n, rest)
        rest -= n
    best = min(tries, key=lambda t: sum(map(cost, t.sizes())))
    return best.placed, best.sizes()


def tokens(text: Column) -> Column:
    """Words between ASCII white space and one end; null counts as empty."""
    return token_count(text) + 1


def pack_rows(df: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """(id, piece, piece_start, n_tokens, bin_id, bin_start, bin_length): rows longer than the largest length in several pieces.

    Rows of null or no length take no bin and give no row. Rows that repeat an id, or have none, are packed each on its
    own and spread like others. Lengths are stored once, so a text is read once.
    """
    capacities = tuple(sorted(set(capacities)))
    most = capacities[-1]
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(length_col).cast("long").alias("length")).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows).where("length > 0")
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_TOKENS))
    pieces = rows.select("id", "row", "length", F.explode(F.sequence(F.lit(0), F.expr(f"(length - 1) div {most}"))).alias("piece"))
    pieces = pieces.select("id", "row", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).cast("long").alias("start"), F.least(F.lit(most), F.col("length") - F.col("piece") * most).cast("int").alias("n"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))

    def run(batches):
        held: list[tuple] = []
        now = None
        names = ["id", "piece", "piece_start", "n_tokens", "bin_id", "bin_start", "bin_length"]
        types = None

        def packed():
            placed, sizes = pack([x[3] for x in held], capacities)
            for k in range(0, len(held), 50_000):
                part, where = held[k : k + 50_000], placed[k : k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part], types), pa.array([x[1] for x in part], pa.int32()), pa.array([x[2] for x in part], pa.int64()), pa.array([x[3] for x in part], pa.int32()),
                     pa.array([f"{now}-{b}" for b, _ in where], pa.string()), pa.array([s for _, s in where], pa.int32()), pa.array([sizes[b] for b, _ in where], pa.int32())], names,
                )

        for batch in batches:
            types = batch.schema.field("id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "piece", "start", "n", "bucket")), strict=True):
                if row[4] != now:
                    if held:
                        yield from packed()
                        held.clear()
                    now = row[4]
                held.append(row)
        if held:
            yield from packed()

    sorted_ = pieces.repartition("bucket").sortWithinPartitions("bucket", F.desc("n"), "row", "piece").drop("row")
    return sorted_.mapInArrow(run, f"id {kind}, piece int, piece_start long, n_tokens int, bin_id string, bin_start int, bin_length int").withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text", end: str = "</s>") -> DataFrame:
    """(bin_id, bin_length, n_tokens, tokens): what each bin holds in order, words and ends; ids of docs must be distinct."""
    words = F.filter(F.split(F.translate(F.coalesce(text_col, F.lit("")), "\t\n\x0b\f\r", " " * 5), " "), lambda w: w != "")
    texts = docs.select(F.col(id_col).alias("_id"), F.concat(words, F.array(F.lit(end))).alias("_words"))
    rows = packed.join(texts, F.col(id_col) == F.col("_id")).select("bin_id", "bin_length", F.struct("bin_start", F.slice("_words", F.col("piece_start").cast("int") + 1, F.col("n_tokens")).alias("w")).alias("part"))
    parts = F.array_sort(F.collect_list("part"))  # no more than a bin's length
    return rows.groupBy("bin_id", "bin_length").agg(F.flatten(F.transform(parts, lambda p: p["w"])).alias("tokens")).select("bin_id", "bin_length", F.size("tokens").alias("n_tokens"), "tokens")


def digest(docs: DataFrame) -> DataFrame:
    """The op3 query: every piece of every document with its bin."""
    return pack_rows(docs.select("doc_id", tokens(F.col("text")).alias("n_tokens")))
