"""Queries against their SQL on texts that the given tables have none of."""

import pytest

from tessella.functions import pysource
from tessella.plans import catalog

#: Too deep for Python's parser as one token and as many, no text, nothing in it, a byte that no source may have, a text that begins as errors do.
TEXTS = ["-" * 20000 + "1", "Eranre " * 1500, None, "", " \n\t ", "a\0b c", "error: one two\n\nthree", "Rows of\nwords " + "w " * 300]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("odd"))
    docs = [(i, TEXTS[i * 7 % len(TEXTS)], "en", f"src{i % 3}", 0) for i in range(301)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    vectors = [(i, [float((i * k * 37 + i) % 101 - 50) for k in range(1, 9)], i % 3) for i in range(301)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return root


@pytest.mark.parametrize("name", ["search_results", "agent_runs"])
def test_against_sql(spark, odd, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(repr(tuple(r)) for r in found.fetchall())
    got = catalog.queries()[name](spark, odd)
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == want


def test_texts_that_the_parser_gives_up_on(spark):
    for text in TEXTS[:2]:
        assert pysource.skeleton("a.py", 1, "function", text) == text and not pysource.parses(text)
    rows = spark.createDataFrame([("a.py", 1, "function", t) for t in (TEXTS[0], None, "def f():\n    return 1\n")], "path string, start_line int, kind string, content string")
    got = [(r.skeleton, r.parses) for r in pysource.python_skeletons(rows).collect()]
    assert got[:2] == [(TEXTS[0], False), (None, None)] and got[2][1] and "body omitted" in got[2][0]
