"""Language-model scoring: quantised n-gram counts in a log-frequency Bloom filter that lies in parts by hash range.

Tokens are words between ASCII white space, A-Z lower-cased, then one end; n-grams have up to three. A count c goes in as
levels 1 to 1 + floor(log2 c); reading probes levels until one is missing. The number of parts grows with the texts and
each part with its n-grams, so every count is in; no worker holds more than a part. Texts lie in chunks: a chunk sends
each range its distinct n-grams with their counts, the range merges them, fills its part and sends back the levels that
it reads for each chunk's n-grams. Words travel along by their whole hash and come back with exact counts, for the base
score, so nothing of the corpus is broadcast or sent to the driver but the numbers of tokens and of words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_column, chained, hash_word, mix, spread, steps, stored, utf8, word_hashes, words

#: Bits of the filter for each level of a count.
LEVEL_BITS = 12
#: Bytes of text in a chunk, unless a single text is longer; a row counts as ROW_BYTES more.
CHUNK_BYTES, ROW_BYTES = 4 << 20, 4
#: Bytes of the texts whose n-grams one hash range holds on average.
RANGE_BYTES = 4 << 20
#: What is taken off the count of a seen n-gram, and how the share left to shorter contexts falls with a context's count.
DISCOUNT, FALL = 0.75, 0.25
END = np.uint64(hash_word("\x00end"))
#: Bits of an n-gram's hash that are kept below those of its range.
KEPT = 32


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' token hashes, each text followed by an end, and the limits of each text."""
    s, e = words(raw, at)
    limits = np.searchsorted(s, at)
    n = np.diff(limits)
    text = np.repeat(np.arange(len(n)), n)
    out = np.full(len(s) + len(n), END, np.uint64)
    out[np.arange(len(s)) + text] = word_hashes(raw, s, e)
    return out, limits + np.arange(len(at))


def ngrams(h: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token with the one before it, and with the two before it; before a text there are ends only."""
    before = np.concatenate([[END, END], h])
    two = chained(before[1:], 2)
    three = chained(before, 3)
    starts = limits[:-1]
    three[starts] = mix(mix(two[starts]) + np.uint64(3))  # the token two places before is of another text
    return two, three


def learns(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 10 != 0


def _ranged(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of a hash that are kept: those of the range, then KEPT."""
    return h >> np.uint64(64 - bits - KEPT)


@dataclass
class Filter:
    """Parts of equal size, one for each hash range; a probe reads one 64-bit word."""

    bits: int
    cells: np.ndarray

    def count(self, h: np.ndarray) -> np.ndarray:
        """Expected counts of n-grams."""
        return expected(self.levels(_ranged(h, self.bits)))

    def levels(self, kept: np.ndarray) -> np.ndarray:
        """Levels of n-grams by repeated membership probes: level j stands for counts of 2^(j-1) to 2^j - 1."""
        level = np.zeros(len(kept), np.uint8)
        alive = np.arange(len(kept))
        size = len(self.cells) >> self.bits
        j = 1
        while len(alive) and size and j < 64:
            own = kept[alive]
            place, mask = _probe(own, j, size)
            hit = (self.cells[(own >> np.uint64(KEPT)).astype(np.int64) * size + place] & mask) == mask
            alive = alive[hit]
            level[alive] = j
            j += 1
        return level


def expected(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, (1.5 * 2.0 ** (level.astype(np.float64) - 1)) - 0.5, 0.0)


def _probe(kept: np.ndarray, level: int | np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the part, and its four bits, that hold a level of an n-gram."""
    x = mix(kept * np.uint64(0x9FB21C651E98DF25) + np.asarray(level, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    place = ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
    mask = np.zeros(len(kept), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
    return place, mask


def fitting(counts: np.ndarray) -> int:
    """Words of a part that has room for all levels of the counts."""
    return max(1, -(-int((np.floor(np.log2(counts)).astype(np.int64) + 1).sum()) * LEVEL_BITS // 64))


def part(counts: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """A range's words of the filter, as many as its n-grams need."""
    levels = np.floor(np.log2(counts)).astype(np.int64) + 1
    cells = np.zeros(fitting(counts), np.uint64)
    for j in range(1, int(levels.max(initial=0)) + 1):
        place, mask = _probe(kept[levels >= j], j, len(cells))
        np.bitwise_or.at(cells, place, mask)
    return cells


def chunks(docs: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    """(chunk, ids, learn, sizes, raw): texts of up to CHUNK_BYTES in one row, back to back and compressed; chunk numbers its first text."""

    def run(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 33
        held: list[tuple] = []

        def chunk():
            ids, learn, sizes = (pa.concat_arrays(x) for x in list(zip(*held, strict=True))[:3])
            raw = pa.compress(b"".join(x[3] for x in held), codec="zstd", asbytes=True)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, learn, sizes)]
            return pa.RecordBatch.from_arrays([pa.array([serial]), *lists, pa.array([raw], pa.binary())], ["chunk", "ids", "learn", "sizes", "raw"]), len(ids)

        n = 0
        for batch in steps(batches, "text"):
            raw, at = utf8(batch.column("text"))
            more = len(raw) + ROW_BYTES * batch.num_rows
            if held and n + more > CHUNK_BYTES:
                out, rows = chunk()
                yield out
                serial += rows
                held.clear()
                n = 0
            held.append((batch.column("id"), batch.column("learn"), pa.array(np.diff(at), pa.int64()), raw.tobytes()))
            n += more
        if held:
            yield chunk()[0]

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"chunk long, ids array<{kind}>, learn array<boolean>, sizes array<long>, raw binary")


def _read(sizes: pa.ListScalar, raw: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's token hashes, and the number of tokens of each of its texts."""
    at = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())])
    texts = binary_column(pa.decompress(raw.as_buffer(), decompressed_size=int(at[-1]), codec="zstd", asbytes=True), at)
    got = [tokens(*utf8(x.column("text"))) for x in steps(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text")]
    return np.concatenate([h for h, _ in got]), np.concatenate([np.diff(limits) for _, limits in got])


@dataclass
class Grams:
    """A chunk's tokens, its distinct words, and its distinct n-grams of all orders by what is kept of their hashes."""

    words: np.ndarray
    word: np.ndarray  # each token's place in words
    kept: np.ndarray
    where: np.ndarray  # orders x tokens: places in kept

    @classmethod
    def of(cls, h: np.ndarray, size: np.ndarray, bits: int) -> Grams:
        found, word = np.unique(h, return_inverse=True)
        two, three = ngrams(h, np.concatenate([[0], np.cumsum(size)]))
        codes, parts, total = [], [], 0
        for code, kinds in ((word, chained(found, 1)), pd.factorize(two), pd.factorize(three)):
            codes.append(code + total)
            parts.append(_ranged(kinds, bits))
            total += len(kinds)
        kept, where = np.unique(np.concatenate(parts), return_inverse=True)
        return cls(found, word, kept, where[np.stack(codes)])

    def limits(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each range's n-grams and words begin and end."""
        edges = np.arange((1 << bits) + 1, dtype=np.uint64)
        top = self.words >> np.uint64(64 - bits) if bits else np.zeros(len(self.words), np.uint64)
        return np.searchsorted(self.kept, edges << np.uint64(KEPT)), np.searchsorted(top, edges)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of little-endian numbers byte by byte: bytes of the same place lie together, as most repeat."""
    return b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in columns)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    rows = np.frombuffer(data, np.uint8).reshape(sum(widths), -1)
    return [np.ascontiguousarray(x.T).view(k).reshape(-1) for x, k in zip(np.split(rows, np.cumsum(widths)[:-1]), kinds, strict=True)]


def answered(chunked: DataFrame, bits: int, size: int) -> DataFrame:
    """(chunk, range, levels, counts, n, v): for a chunk's n-grams in one of 2^bits ranges their levels, for its words their counts.

    Both are of all texts learned from, in the order of the hashes. A row without chunk has a range's tokens n and words v.
    """

    def send(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                h, size = _read(batch.column("sizes")[row], batch.column("raw")[row])
                teach = np.repeat(batch.column("learn")[row].values.to_numpy(zero_copy_only=False), size)
                own = Grams.of(h, size, bits)
                n = np.bincount(own.where[:, teach].reshape(-1), minlength=len(own.kept)).astype("<u4")
                taught = np.bincount(own.word[teach], minlength=len(own.words)).astype("<u4")
                low = (own.kept & np.uint64((1 << KEPT) - 1)).astype("<u4")
                at, word_at = own.limits(bits)
                ranges = np.flatnonzero((at[1:] > at[:-1]) | (word_at[1:] > word_at[:-1]))
                for k in range(0, len(ranges), 256):
                    part = ranges[k : k + 256]
                    grams = pa.array([_packed(low[at[r] : at[r + 1]], n[at[r] : at[r + 1]]) for r in part], pa.binary())
                    asked = pa.array([_packed(own.words[word_at[r] : word_at[r + 1]], taught[word_at[r] : word_at[r + 1]]) for r in part], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column("chunk")[row].as_py())), pa.array(part), grams, asked], ["chunk", "range", "grams", "words"])

    def merged(blobs, key):
        """Distinct keys with their sums, and each blob's places among them."""
        keys, counts = (np.concatenate(x) for x in zip(*(_unpacked(b, key, "<u4") for b in blobs), strict=True))
        kinds, where = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(kinds), np.int64)
        np.add.at(sums, where, counts.astype(np.int64))
        width = np.dtype(key).itemsize + 4
        return kinds, sums, where, np.cumsum([0, *(len(b) // width for b in blobs)])

    def answer(key, rows):
        kept, counts, where, ends = merged(rows.column("grams").to_pylist(), "<u4")
        kept = kept.astype(np.uint64)
        taught = counts > 0
        levels = Filter(0, part(counts[taught], kept[taught])).levels(kept)[where]
        _, sums, word, word_ends = merged(rows.column("words").to_pylist(), "<u8")
        told = pa.array([_packed(sums[word[a:b]]) for a, b in zip(word_ends[:-1], word_ends[1:], strict=True)], pa.binary())
        none = pa.nulls(rows.num_rows, pa.int64())
        out = pa.table({"chunk": rows.column("chunk"), "range": rows.column("range"), "levels": binary_column(levels, ends), "counts": told, "n": none, "v": none})
        whole = pa.table([pa.nulls(1, pa.int64()), rows.column("range").slice(0, 1), pa.array([b""]), pa.array([b""]), pa.array([int(sums.sum())]), pa.array([int((sums > 0).sum())])], schema=out.schema)
        return pa.concat_tables([out, whole])

    grams = chunked.select("chunk", "learn", "sizes", "raw").mapInArrow(send, "chunk long, range long, grams binary, words binary")
    return spread(grams, "range", size).groupBy("range").applyInArrow(answer, "chunk long, range long, levels binary, counts binary, n long, v long")


def smoothed(word: np.ndarray, two: np.ndarray, three: np.ndarray, starts: np.ndarray, end: float, below: float) -> np.ndarray:
    """Probability of each token from the counts of its n-grams: discounted shares, interpolated down to smoothed words.

    A context of count c leaves DISCOUNT / c^FALL of its share to the next shorter one; one that was never seen, all.
    """
    first = np.zeros(len(word), bool)
    first[starts] = True
    before = np.where(first, end, np.roll(word, 1))  # an end stands before each text
    pair = np.where(first, end, np.roll(two, 1))
    p = (word + 0.1) / below
    for count, context in ((two, before), (three, pair)):
        c = np.maximum(context, 1.0)
        left = DISCOUNT / c**FALL
        p = np.where(context > 0, np.minimum(np.maximum(count - DISCOUNT, 0.0) / c, 1 - left) + left * p, p)
    return np.minimum(p, 1.0)


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row, from the rows for which `learn` holds.

    Null texts count as empty. Rows need no distinct ids; null ids pass through and are not learned from where `learn`
    is null for them. base_score adds up exact counts; score takes counts of words, pairs and triples from the filter.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chunked = stored(chunks(docs, learn, id_col, text_col))
    bytes_ = chunked.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, bytes_) / RANGE_BYTES)))
    answers = stored(answered(chunked, bits, bytes_))
    n, v = answers.where("chunk is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    below = n + 0.1 * (v + 1)

    def run(texts, told):
        h, size = _read(texts.column("sizes")[0], texts.column("raw")[0])
        own = Grams.of(h, size, bits)
        told = told.take(pa.array(np.argsort(told.column("range").to_numpy())))
        count = expected(np.frombuffer(b"".join(told.column("levels").to_pylist()), np.uint8))[own.where]
        taught = np.concatenate([_unpacked(x, "<i8")[0] for x in told.column("counts").to_pylist()])[own.word]
        rows, limits = len(size), np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(rows), size)
        end = count[0, -1]  # every text has one
        p = smoothed(*count, limits[:-1], end, below)
        sums = [np.bincount(owner, x, rows) for x in (taught > 0, np.log10((taught + 0.1) / below), np.log10(p))]
        return pa.table({"id": texts.column("ids")[0].values, "n_tokens": size.astype(np.int64), "n_known": sums[0].astype(np.int64), "base": sums[1], "score": sums[2]})

    texts, told = (spread(x, "chunk", bytes_).groupBy("chunk") for x in (chunked.select("chunk", "ids", "sizes", "raw"), answers.where("chunk is not null")))
    rows = texts.cogroup(told).applyInArrow(run, f"id {kind}, n_tokens long, n_known long, base double, score double")
    return rows.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def digest(docs: DataFrame) -> DataFrame:
    """The op8 contract."""
    got = score(docs, learns())
    return got.select("doc_id", (~learns()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
