"""Line dedup by overlapping three-line windows, in SQL expressions only.

Lines lie between newlines. Each run of three consecutive lines, of which not all are blank (nothing or spaces), is a
window. Of equal windows anywhere the first by (id, place) stays; the lines that later ones cover go, overlapping or
touching windows as one span. Every removed line so stands earlier in the order. Texts under three lines, empty texts
and null texts stay as they are. Rows that agree in id and text are one document: they get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 3


def _split(text: Column) -> Column:
    return F.split(text, "\n")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, place, k1, k2): two hashes of the window at each place."""
    rows = docs.where(F.col(text_col).contains("\n")).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.transform(_split(F.col(text_col)), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.trim(x) == "").alias("blank"))).alias("lines")
    )
    rows = rows.where(F.size("lines") >= WINDOW)
    at = lambda i, k: F.get(F.col("lines"), i + k)
    each = F.transform(
        F.sequence(F.lit(0), F.size("lines") - WINDOW),
        lambda i: F.when(
            ~(at(i, 0)["blank"] & at(i, 1)["blank"] & at(i, 2)["blank"]),
            F.struct(i.alias("place"), F.xxhash64(at(i, 0)["h"], at(i, 1)["h"], at(i, 2)["h"]).alias("k1"), F.xxhash64(at(i, 2)["h"], at(i, 0)["h"], at(i, 1)["h"]).alias("k2")),
        ),
    )
    return rows.select("id", "text_key", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("w")).select("id", "text_key", "w.place", "w.k1", "w.k2")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, places): places of windows that occur earlier."""
    every = windows(docs, id_col, text_col)
    where = F.struct("id", "text_key", "place")
    # stored, so that the join below reads both sides from their own exchange and large keys can be split
    firsts = stored(every.groupBy("k1", "k2").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first < last").drop("last"))
    later = every.join(firsts, ["k1", "k2"]).where(F.struct("id", "text_key", "place") > F.col("first"))
    return later.groupBy("id", "text_key").agg(F.array_sort(F.collect_set("place")).alias("places"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text that is left, and n_lines, n_removed, removed_spans (pairs of first and last line, from 0).

    A text of which no line is left becomes empty. Columns of these names in docs give way.
    """
    new = ["n_lines", "n_removed", "removed_spans"]
    docs = docs.select([c for c in docs.columns if c.lower() not in new])
    found = repeated(docs, id_col, text_col).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.col("places").alias("_places"))
    rows = docs.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_key")), "left")
    places = F.coalesce("_places", F.array().cast("array<int>"))
    starts = F.filter(places, lambda x, i: (i == 0) | (F.get(F.col("_places"), i - 1) + WINDOW < x))
    ends = F.transform(F.filter(places, lambda x, i: F.coalesce(F.get(F.col("_places"), i + 1) > x + WINDOW, F.lit(True))), lambda x: x + (WINDOW - 1))
    rows = rows.withColumn("_spans", F.arrays_zip(starts.alias("first"), ends.alias("last"))).withColumn("_lines", F.when(F.size("_spans") > 0, _split(F.col(text_col))))
    gap = lambda k: (F.when(k > 0, F.get(F.col("_spans"), k - 1)["last"] + 1).otherwise(0), F.coalesce(F.get(F.col("_spans"), k)["first"], F.size("_lines")))
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_spans")), lambda k: F.slice(F.col("_lines"), gap(k)[0] + 1, F.greatest(gap(k)[1] - gap(k)[0], F.lit(0)))))
    covered = F.aggregate("_spans", F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)
    return rows.select(
        *[F.when(F.size("_spans") > 0, F.array_join(left, "\n")).otherwise(F.col(text_col)).alias(text_col) if c == text_col else F.col(c) for c in docs.columns],
        n_lines.cast("long").alias("n_lines"), covered.cast("long").alias("n_removed"), F.col("_spans").alias("removed_spans"),
    )


def digest(docs: DataFrame) -> DataFrame:
    spans = F.concat_ws(",", F.transform("removed_spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))))
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", spans.alias("removed_spans"), "text")


SQL_LINES = r"""
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {docs}),
w AS (SELECT doc_id, p, ls[p + 1] AS a, ls[p + 2] AS b, ls[p + 3] AS c FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS p FROM l)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM w
          WHERE trim(a) <> '' OR trim(b) <> '' OR trim(c) <> '') WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS n FROM later, (VALUES (0), (1), (2)) AS x(o)),
spans AS (SELECT doc_id, min(n) AS a, max(n) AS b, count(*) AS n FROM (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM gone) GROUP BY doc_id, g),
removed AS (SELECT doc_id, sum(n)::BIGINT AS n_removed, string_agg(a || '-' || b, ',' ORDER BY a) AS removed_spans FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY n) AS kept FROM (SELECT doc_id, unnest(ls) AS x, unnest(range(0, len(ls))) AS n FROM l WHERE doc_id IN (SELECT doc_id FROM removed))
         WHERE (doc_id, n) NOT IN (SELECT doc_id, n FROM gone) GROUP BY doc_id),
deduped AS (SELECT l.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_spans, '') AS removed_spans,
            CASE WHEN n_removed IS NULL THEN text ELSE coalesce(kept, '') END AS text FROM l LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id))"""

ORACLE = "WITH " + SQL_LINES.format(docs="documents") + "\nSELECT doc_id, n_lines, n_removed, removed_spans, text FROM deduped"
