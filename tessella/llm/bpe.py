"""Byte-level BPE with the tokenizers library over Arrow batches.

The pattern cuts each text into pieces; the library encodes every distinct piece of a step once, and ids are laid out
by piece. Tokens are bytes: the printable characters of the vocabulary map back by the byte table, so a token may hold
part of a character, and offsets count bytes. A null text counts as empty and gives no ids.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, steps

#: Distinct pieces a worker remembers between steps.
REMEMBERED = 200_000


def byte_table() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def _vocabulary(path: str):
    """The library's tokenizer set to take whole pieces, and all tokens' bytes with their limits."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
    of = byte_table()
    tokens = [b""] * tokenizer.get_vocab_size()
    for token, k in tokenizer.get_vocab(with_added_tokens=False).items():
        tokens[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return tokenizer, np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1])) + np.repeat(starts - (ends - sizes), sizes)


@cache
def _newer() -> np.ndarray:
    """Characters that are letters or numbers to the regex module alone: tiktoken's engine follows an older Unicode."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    raw = {bytes([b]): b for b in range(256)}
    odd: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        theirs = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=raw, special_tokens={})
        odd |= set(regex.findall(kind, every)) ^ set(bytes(theirs.encode_ordinary(every)).decode())
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in odd]] = True
    return table


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.path = path
        self.tokenizer = _vocabulary(path)[0]
        self.pieces = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def split(self, text: str) -> list[str]:
        if text.isascii() or not (odd := _newer()[points := np.frombuffer(text.encode("utf-32-le"), np.uint32)]).any():
            return self.pieces.findall(text)
        # a private-use character stands in for each such character: neither letter, number nor white space
        alike = np.where(odd, np.uint32(0xE000), points).astype("<u4").tobytes().decode("utf-32-le")
        return [text[a:b] for a, b in (m.span() for m in self.pieces.finditer(alike))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the limits of each text's ids."""
        if len(self.known) > REMEMBERED:
            self.__init__(self.path, self.pieces.pattern)
        cut = [self.split(t) for t in texts]
        known = self.known
        fresh = list({p for c in cut for p in c if p not in known})
        if fresh:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self.ids = np.concatenate([self.ids, np.fromiter((k for g in got for k in g), np.uint32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(g) for g in got])])
        number = np.fromiter((known[p] for c in cut for p in c), np.int64)
        sizes = np.diff(self.starts)[number]
        ids = self.ids[_spread(self.starts[number], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)]


def decode_ids(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ids back to back, and the byte offsets at which each token starts and the last ends."""
    _, data, limits = _vocabulary(path)
    if len(ids) and int(ids.max()) >= len(limits) - 1:
        raise ValueError("an id outside the vocabulary")
    starts, sizes = limits[ids], np.diff(limits)[ids]
    return data[_spread(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)])


def char_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character number at which each token starts, and whether it starts inside a character (that of the number less one)."""
    leads = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(leads)])[offsets]
    inside = np.zeros(len(offsets), bool)
    at = offsets < len(data)
    inside[at] = ~leads[offsets[at]]
    return before, inside


class StreamDecoder:
    """Text from ids that come in parts: bytes of a character that is not complete wait for the next part."""

    def __init__(self, path: str):
        import codecs

        self.path, self.text = path, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, final: bool = False) -> str:
        return self.text.decode(decode_ids(np.asarray(ids, np.int64), self.path)[0].tobytes(), final)


def encode_texts(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """df with token_ids: little-endian unsigned 32-bit ids as binary, in place of a column of that name."""
    df = df.select([c for c in df.columns if c.lower() != "token_ids"])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "token_ids binary"])

    def run(batches):
        e = Encoder(path, pattern)
        for batch in steps(batches, text_col):
            ids, limits = e.encode([t or "" for t in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, binary_column(ids.astype("<u4"), limits * 4)], [*batch.schema.names, "token_ids"])

    return df.mapInArrow(run, schema)


def decode_texts(df: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """df with decoded: the bytes of each row's ids, as binary, since ids may end inside a character. Null ids: empty."""
    df = df.select([c for c in df.columns if c.lower() != "decoded"])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "decoded binary"])

    def run(batches):
        from .common import utf8

        for batch in steps(batches, ids_col):
            raw, at = utf8(batch.column(ids_col))
            data, offsets = decode_ids(np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), path)
            yield pa.RecordBatch.from_arrays([*batch.columns, binary_column(data, offsets[at // 4])], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, schema)


def token_rows(df: DataFrame, path: str, ids_col: str = "token_ids", id_col: str = "doc_id") -> DataFrame:
    """One row per token: id, number, token id, byte range, character it starts in, whether that is inside a character."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, token_no int, token_id long, byte_start long, byte_end long, char_start long, splits_char boolean"

    def run(batches):
        for batch in steps(batches, ids_col, 1 << 18):
            for key, raw in zip(batch.column(id_col), batch.column(ids_col).to_pylist(), strict=True):
                ids = np.frombuffer(raw or b"", "<u4").astype(np.int64)
                data, at = decode_ids(ids, path)
                chars, inside = char_offsets(data, at)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * n, key.type), pa.array(np.arange(n, dtype=np.int32)), pa.array(ids), pa.array(at[:-1]), pa.array(at[1:]), pa.array((chars - inside)[:-1]), pa.array(inside[:-1])], schema_names)

    schema_names = [id_col, "token_no", "token_id", "byte_start", "byte_end", "char_start", "splits_char"]
    return df.select(id_col, ids_col).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The op6 contract: ids and decoded bytes of every whole text."""
    import public_tokenizers as public

    path, pattern = path or public.path("byte_bpe_50k.json"), pattern or public.PATTERN
    got = decode_texts(encode_texts(docs.select("doc_id", "text"), path, pattern).select("doc_id", "token_ids"), path)
    return got.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
