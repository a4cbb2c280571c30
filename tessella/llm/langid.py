"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A text is lower-cased and every run of characters that are neither letters nor marks becomes one space. Each language
has one model of order 4; a text gets the language of the lowest cross-entropy a character. A text is `rejected` if it
has no letter (`und`), or if that cross-entropy lies above what calibration texts of the language showed. Ties go to
the language that comes first in order of names.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MASK, mix, steps

ORDER = 4
#: Expected labelled texts that each language is learned from; a fifth of them calibrate the rejection.
TEXTS = 2000
#: Characters of evidence that the score assumes at most: all characters count for the entropies, but those of a text
#: are not independent, and without a bound the score of any longer text would be 1.
TRUSTED = 60
SPACE = 0x20
#: Characters of a long text that are held as numbers at a time.
SEGMENT = 1 << 18


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane its normal form, and whether it is a letter."""
    form, letter = np.full(0x10000, SPACE, np.uint64), np.zeros(0x10000, bool)
    for k in range(0x10000):
        c = chr(k)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            form[k] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else k
            letter[k] = c.isalpha()
    return form, letter


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    whole = "\n".join([*texts, ""])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return points, np.repeat(np.arange(len(texts)), lengths)


def _normal(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal forms of code points, SPACE for what is neither letter nor mark, and whether each is a letter."""
    form, letter = _tables()
    beyond = points > 0xFFFF
    low = np.where(beyond, 0, points)
    seq, isletter = form[low], letter[low]
    if beyond.any():  # characters beyond the basic plane share the private-use ones
        alpha = np.fromiter((chr(c).isalpha() for c in points[beyond]), bool)
        seq[beyond] = np.where(alpha, 0xE000 + (points[beyond] & 0xFFF), SPACE)
        isletter[beyond] = alpha
    return seq, isletter


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every 4-gram as four 16-bit characters, the text it is of, and each text's number of letters."""
    points, owner = _points(texts)
    seq, isletter = _normal(points)
    letters = np.bincount(owner[isletter], minlength=len(texts))
    same = np.zeros(len(seq), bool)
    same[1:] = owner[1:] == owner[:-1]
    before = np.concatenate([[SPACE], seq[:-1]]).astype(np.uint64)
    keep = (seq != SPACE) | (same & (before != SPACE))
    seq, owner = seq[keep], owner[keep]
    packed = seq.copy()
    for k in range(1, ORDER):
        back = np.full(len(seq), SPACE, np.uint64)
        back[k:] = np.where(owner[k:] == owner[:-k], seq[:-k], SPACE) if len(seq) > k else SPACE
        packed |= back << np.uint64(16 * k)
    return packed, owner, letters


def pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The 4-grams of a long text, SEGMENT characters at a time, and the letters among those."""
    held = np.full(ORDER - 1, SPACE, np.uint64)
    whole = text + "\n"
    for k in range(0, len(whole), SEGMENT):
        seq, isletter = _normal(np.frombuffer(whole[k : k + SEGMENT].encode("utf-32-le", "surrogatepass"), np.uint32))
        before = np.concatenate([held[-1:], seq[:-1]])
        full = np.concatenate([held, seq[(seq != SPACE) | (before != SPACE)]])
        held = full[-(ORDER - 1) :]
        yield sum((full[ORDER - 1 - j : len(full) - j] << np.uint64(16 * j) for j in range(1, ORDER)), full[ORDER - 1 :]), int(isletter.sum())


def _last(packed: np.ndarray, n: int) -> np.ndarray:
    return packed if n == 4 else packed & np.uint64((1 << 16 * n) - 1)


def _hash(packed: np.ndarray, n: int) -> np.ndarray:
    return mix(packed + np.uint64(0x9E3779B97F4A7C15 * n & MASK))


@dataclass
class Hashed:
    """Values by 64-bit hash, in the order of the hashes."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, packed: np.ndarray, values: np.ndarray, n: int) -> Hashed:
        keys = _hash(packed, n)
        order = np.argsort(keys)
        return cls(keys[order], values[order].astype(np.float32))

    def get(self, packed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is there, and its value."""
        if not len(self.keys):
            return np.zeros(len(packed), bool), np.zeros(len(packed), np.float32)
        wanted = _hash(packed, n)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted, self.values[at]


class KneserNey:
    """An interpolated Kneser-Ney model of order 4 from 4-gram counts."""

    def __init__(self, packed: np.ndarray, counts: np.ndarray):
        self.probs: dict[int, Hashed] = {}
        self.weights: dict[int, Hashed] = {}
        levels = {ORDER: (packed, counts.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):  # below the top, a gram counts once for each different character before it
            levels[n] = tuple(np.unique(_last(levels[n + 1][0], n), return_counts=True))
        kinds, seen = levels[1]
        self.unseen = float(np.log(1.0 / (len(kinds) + 1.0) / (seen.sum() + len(kinds) + 1.0)))
        prob = (seen + 1.0 / (len(kinds) + 1.0)) / (seen.sum() + len(kinds) + 1.0)
        self.probs[1] = Hashed.of(kinds, np.log(prob), 1)
        for n in range(2, ORDER + 1):
            grams_n, c = levels[n]
            c = c.astype(np.float64)
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = once / (once + 2.0 * twice) if once and twice else 0.5
            contexts, where = np.unique(grams_n >> np.uint64(16), return_inverse=True)
            total, kinds_after = np.bincount(where, c), np.bincount(where)
            weight = d * kinds_after / total
            lower = np.exp(self.log_prob(_last(grams_n, n - 1), n - 1))
            self.probs[n] = Hashed.of(grams_n, np.log((c - d) / total[where] + weight[where] * lower), n)
            self.weights[n] = Hashed.of(contexts, np.log(weight), n)

    def log_prob(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Natural log of each gram's last character given those before it."""
        found, value = self.probs[1].get(_last(packed, 1), 1)
        out = np.where(found, value, self.unseen)
        for n in range(2, order + 1):
            gram = _last(packed, n)
            known, weight = self.weights[n].get(gram >> np.uint64(16), n)
            found, value = self.probs[n].get(gram, n)
            out = np.where(found, value, out + np.where(known, weight, 0.0))
        return out


@dataclass
class Model:
    names: list[str]
    models: list[KneserNey]
    #: Highest cross-entropy that each language accepts.
    limits: np.ndarray

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a character by text and language, characters, letters."""
        long = [i for i, t in enumerate(texts) if len(t) > SEGMENT]
        packed, owner, letters = grams(["" if len(t) > SEGMENT else t for t in texts])
        codes, kinds = pd.factorize(packed)
        n = np.bincount(owner, minlength=len(texts))
        out = np.empty((len(texts), len(self.names)))
        for k, m in enumerate(self.models):
            out[:, k] = -np.bincount(owner, m.log_prob(kinds)[codes], minlength=len(texts))
        for i in long:
            for own, some in pieces(texts[i]):
                kinds, times = np.unique(own, return_counts=True)
                out[i] -= [times @ m.log_prob(kinds) for m in self.models]
                n[i] += len(own)
                letters[i] += some
        return out / np.maximum(n, 1)[:, None], n, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, confidence, cross-entropy and whether it is rejected.

        A model that nothing was learned for says `und`, and rejects only texts without letters.
        """
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), grams(texts)[2] == 0
        h, n, letters = self.entropies(texts)
        best = h.argmin(1)
        low = h[np.arange(len(texts)), best]
        share = 1.0 / np.exp(-(h - low[:, None]) * np.minimum(n, TRUSTED)[:, None]).sum(1)
        none = letters == 0
        return [("und" if z else self.names[k]) for k, z in zip(best, none, strict=True)], np.where(none, 0.0, share), low, none | (low > self.limits[best])


def trained_on(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


def fit(docs: DataFrame, texts: int = TEXTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from labelled texts: a hash of the id draws `texts` a language on average, however many there are.

    Rows without text or label teach nothing. Counts come to the driver by language and gram: as many as the drawn
    texts hold, whose number has that bound.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    sizes = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], [], np.zeros(0))
    unit = 1 << 30
    drawn = F.lit(False)
    for lang, n in sizes.items():
        drawn |= (F.col("lang") == lang) & (F.pmod("h", F.lit(unit)) < int(unit * min(1.0, texts / n)))
    rows = rows.where(drawn).withColumn("fits", F.pmod(F.shiftright("h", 32), F.lit(5)) > 0)

    def count(batches):
        for batch in steps(batches, "text"):
            langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
            packed, owner, _ = grams(["" if len(t) > SEGMENT else t for t in texts])
            parts = [(lang, packed[(langs == lang)[owner]]) for lang in set(langs)]
            for lang, own in chain(parts, ((lang, own) for lang, t in zip(langs, texts, strict=True) if len(t) > SEGMENT for own, _ in pieces(t))):
                kinds, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counted = rows.where("fits").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counted["lang"].unique())
    models = []
    for lang in names:
        own = counted[counted["lang"] == lang].sort_values("gram")
        models.append(KneserNey(own["gram"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.int64)))
    model = Model(names, models, np.full(len(names), np.inf))
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def measure(batches):
        own = pickle.loads(sent.value)
        for batch in steps(batches, "text"):
            h, n, letters = own.entropies(batch.column("text").to_pylist())
            where = np.array([own.names.index(x) if x in own.names else -1 for x in batch.column("lang").to_pylist()])
            good = (letters > 0) & (where >= 0) & (h.argmin(1) == where)
            yield pa.RecordBatch.from_arrays([pa.array(where[good].astype(np.int32)), pa.array(h[np.arange(len(h)), where][good])], ["k", "h"])

    held = rows.where(~F.col("fits")).mapInArrow(measure, "k int, h double").toPandas()
    for k in range(len(names)):
        h = held["h"].to_numpy()[held["k"].to_numpy() == k]
        if len(h):  # a nat beyond what nearly all reach, so that clean texts of a few characters are not lost
            model.limits[k] = np.quantile(h, 0.999) + 1.0
    return model


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred, lang_score (0 to 1), lang_entropy (nats a character), lang_rejected; such columns give way.

    Null, empty and letterless texts: `und`, score 0, rejected. Whole texts are read.
    """
    new = ["lang_pred", "lang_score", "lang_entropy", "lang_rejected"]
    df = df.select([c for c in df.columns if c.lower() not in new])
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "lang_pred string, lang_score double, lang_entropy double, lang_rejected boolean"])

    def run(batches):
        own = pickle.loads(sent.value)
        for batch in steps(batches, text_col, 1 << 20):
            lang, score, h, rejected = own.predict([t or "" for t in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(h), pa.array(rejected)], [*batch.schema.names, *new])

    return df.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """The op10 contract: learn from documents of remainders 0, 1 and 3, predict all from their texts alone."""
    model = fit(docs.where(trained_on()))
    got = predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", (~trained_on()).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_entropy").alias("entropy"), F.col("lang_rejected").alias("rejected"))
