"""Column functions over text: token counts, anchors, summaries, diffs and JSON arguments."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_count(text: ColumnOrName, tokenizer: str = "ws", path: str | None = None) -> Column:
    """Tokens of a text, 0 for null and empty: `ws` counts runs of non-space, `bpe` the ranks file at `path`."""
    if tokenizer == "ws":
        words = F.array_remove(F.split(F.translate(_col(text), "\t\n\x0b\f\r", " " * 5), " "), "")  # cheaper than a pattern
        return F.coalesce(F.array_size(words), F.lit(0)).cast("long")
    if tokenizer == "bpe":
        return _bpe_counter(path)(_col(text))
    raise ValueError(f"unknown tokenizer {tokenizer}")


@cache
def _bpe_encoding(path: str | None):
    import base64

    import tiktoken

    if path is None:
        return tiktoken.get_encoding("o200k_base")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _bpe_counter(path: str | None):
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _bpe_encoding(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count


def estimated_tokens(text: ColumnOrName) -> Column:
    """A quarter of the bytes, and one."""
    return (F.floor(F.octet_length(F.coalesce(_col(text), F.lit(""))) / 4) + 1).cast("long")


def truncate_chars(text: ColumnOrName, n: int) -> Column:
    """The first n characters; all of them when n is not positive."""
    return _col(text) if n <= 0 else F.substring(_col(text), 1, n)


def truncate_bytes(text: ColumnOrName, n: int) -> Column:
    """The first n bytes of a text's UTF-8 form, as binary: error messages keep 200 of them, transcripts 1500."""
    return F.substring(F.encode(_col(text), "UTF-8"), 1, n)


def flatten_spaces(text: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def is_all_caps(name: ColumnOrName) -> Column:
    """At least one of A-Z and none of a-z; other characters don't matter."""
    return _col(name).rlike("[A-Z]") & ~_col(name).rlike("[a-z]")


def is_python(path: ColumnOrName) -> Column:
    return _col(path).endswith(".py")


def content_sha(text: ColumnOrName) -> Column:
    return F.sha2(_col(text), 256)


def anchor(path: ColumnOrName, start: ColumnOrName, end: ColumnOrName) -> Column:
    """path:start-end"""
    return F.concat(_col(path), F.lit(":"), _col(start).cast("string"), F.lit("-"), _col(end).cast("string"))


def first_line(text: ColumnOrName) -> Column:
    return F.substring_index(_col(text), "\n", 1)


def rest_of_lines(text: ColumnOrName) -> Column:
    """What follows the first newline, or nothing."""
    t = _col(text)
    return F.when(t.contains("\n"), F.substring(t, F.instr(t, "\n") + 1, F.length(t))).otherwise("")


def sized_summary(text: ColumnOrName, words: int) -> Column:
    """The first line and `words` words of the rest; with 0 or fewer the whole rest."""
    rest = F.regexp_extract_all(rest_of_lines(text), F.lit(r"(\S+)"), 1)
    kept = F.slice(rest, 1, words) if words > 0 else rest
    return F.when(F.size(kept) == 0, first_line(text)).otherwise(F.concat_ws(" ", first_line(text), F.array_join(kept, " ")))


def short_summary(text: ColumnOrName) -> Column:
    """The first line and a mark that the rest is left out."""
    return F.concat(first_line(text), F.lit(" …[summarized]"))


def block_hash(*parts: Column) -> Column:
    """A digest of the parts that tells different splits apart."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p, F.lit("")), F.lit("\0")) for p in parts]), 256)


def call_tokens(calls: Column) -> Column:
    """Tokens of tool calls: names and arguments counted apart."""
    return F.aggregate(F.coalesce(calls, F.array().cast("array<struct<name:string,args:string>>")), F.lit(0).cast("long"), lambda n, c: n + token_count(c["name"]) + token_count(c["args"]))


def calls_text(calls: Column) -> Column:
    """Each tool call as its name, a space, its arguments and a newline."""
    return F.array_join(F.transform(calls, lambda c: F.concat(c["name"], F.lit(" "), c["args"], F.lit("\n"))), "")


def query_argument(args: ColumnOrName) -> tuple[Column, Column]:
    """The query of a JSON argument object, and what is wrong with it."""
    query = F.get_json_object(_col(args), "$.query")
    return query, F.when(query.isNull() | (F.trim(query) == ""), F.lit("no query"))


def is_submit(name: ColumnOrName) -> Column:
    return _col(name).isin("submit_answer", "commentary")


def cache_key(*parts: ColumnOrName) -> Column:
    """The first 16 hex digits of a digest over the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *[_col(p).cast("string") for p in parts]), 256), 1, 16)
