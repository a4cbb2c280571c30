"""Structure of Python sources. The tables hold none, so each document gives one: its row says what stands in it.

A source has a docstring, imports and two names, then one to four functions of one to nine assignments, then a class
with a method and a class inside. SQL says where everything stands from the row's numbers alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pysource
from ..functions.text import token_count
from ..operators.chunks import parse_patches, reanchor
from .registry import query, table

MOST, MERGED = 24, 60


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def sources(spark, sf_dir):
    """(path, content, doc_id): a source for each document."""
    i = F.col("doc_id")
    words = _text("Rows of ", F.col("source"), F.repeat(F.lit(" more"), (i % 5).cast("int")))

    def function(j):
        lines = F.transform(F.sequence(F.lit(1), ((i + 3 * j) % 9 + 1).cast("int")), lambda n: _text("    x", n, " = call", n, "(a)\n"))
        return _text("@cached\ndef f", j, "_", i, '(a, b=None):\n    """', words, '"""\n', F.array_join(lines, ""), "    return b\n\n\n")

    head = _text('"""', F.col("source"), '."""\nimport json, os.path as p\nLIMIT = ', F.col("n_chars"), "\nrate = 1\n\n\n")
    functions = F.array_join(F.transform(F.sequence(F.lit(1), (i % 4 + 1).cast("int")), function), "")
    last = _text("class C", i, '(Base, mixins.Sized):\n    """Kept."""\n    size = ', F.col("n_chars"), "\n\n    def get(self):\n        return json.dumps(self)\n\n    class Inner:\n        def put(self):\n            pass\n")
    return table(spark, sf_dir, "documents").select(_text(F.col("source"), "/", i, ".py").alias("path"), F.concat(head, functions, last).alias("content"), "doc_id")


#: d: documents; f: functions with k assignments, from line s to e; c: the class from line s.
SOURCES_SQL = """d AS (SELECT doc_id, n_chars, source || '/' || doc_id || '.py' AS path, 'Rows of ' || source || repeat(' more', (doc_id % 5)::INTEGER) AS words, 3 + doc_id % 5 AS n_words FROM documents),
g AS (SELECT *, unnest(range(1, doc_id % 4 + 2)) AS j FROM d),
k AS (SELECT *, (doc_id + 3 * j) % 9 + 1 AS k FROM g),
f AS (SELECT *, 7 + sum(k + 6) OVER (PARTITION BY doc_id ORDER BY j) - (k + 6) AS s, 7 + sum(k + 6) OVER (PARTITION BY doc_id ORDER BY j) - 3 AS e, 'f' || j || '_' || doc_id AS name FROM k),
c AS (SELECT d.*, (SELECT max(e) + 3 FROM f WHERE f.doc_id = d.doc_id) AS s FROM d)"""

_SYMBOLS_SQL = f"""{SOURCES_SQL}, y AS (SELECT path, name, name AS qualified, 'function' AS kind, s AS start_line, e AS end_line, 'def ' || name || '(a, b=None)' AS signature, words AS docstring FROM f
UNION ALL SELECT path, 'LIMIT', 'LIMIT', 'constant', 3, 3, '', '' FROM d UNION ALL SELECT path, 'rate', 'rate', 'variable', 4, 4, '', '' FROM d
UNION ALL SELECT path, 'C' || doc_id, 'C' || doc_id, 'class', s, s + 9, '', 'Kept.' FROM c UNION ALL SELECT path, 'get', 'C' || doc_id || '.get', 'method', s + 4, s + 5, 'def get(self)', '' FROM c
UNION ALL SELECT path, 'Inner', 'C' || doc_id || '.Inner', 'class', s + 7, s + 9, '', '' FROM c UNION ALL SELECT path, 'put', 'C' || doc_id || '.Inner.put', 'method', s + 8, s + 9, 'def put(self)', '' FROM c)"""


@query(f"WITH {_SYMBOLS_SQL} SELECT path, name, qualified, kind, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, signature, docstring FROM y")
def py_symbols(spark, sf_dir):
    return pysource.python_symbols(sources(spark, sf_dir))


@query(f"WITH {_SYMBOLS_SQL} SELECT path, name, qualified, kind, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, signature, docstring FROM y WHERE name = qualified AND kind IN ('function', 'class')")
def py_top_level(spark, sf_dir):
    return pysource.top_level(pysource.python_symbols(sources(spark, sf_dir)))


@query(
    f"""WITH {SOURCES_SQL}, r AS (SELECT path, 'call' || i AS name, 'call' AS kind, s + 2 + i AS line, 10 AS col FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM f)
    UNION ALL SELECT path, 'json', 'import', 2, 8 FROM d UNION ALL SELECT path, 'path', 'import', 2, 17 FROM d
    UNION ALL SELECT path, 'Base', 'subclass', s, 8 + length('C' || doc_id) FROM c UNION ALL SELECT path, 'Sized', 'subclass', s, 21 + length('C' || doc_id) FROM c UNION ALL SELECT path, 'dumps', 'call', s + 5, 21 FROM c)
    SELECT path, name, kind, line::INTEGER AS line, col::INTEGER AS col FROM r"""
)
def py_references(spark, sf_dir):
    return pysource.python_references(sources(spark, sf_dir))


#: o: whole functions; h: the parts of those over the limit, the declaration and two or three runs of statements; m: the class.
_CHUNKS_SQL = f"""{SOURCES_SQL}, q AS (SELECT *, 6 + n_words + 3 * k > {{most}} AS cut, least(k, ({{most}} - n_words) // 3) AS q, '@cached' || chr(10) || 'def ' || name || '(a, b=None):' || chr(10) || '    ' AS opening, '\"\"\"' || words || '\"\"\"' AS doc,
  list_transform(range(1, k + 1), lambda i: 'x' || i || ' = call' || i || '(a)') || ['return b'] AS body FROM f),
b AS (SELECT *, q = k AND n_words + 3 * k + 2 <= {{most}} AS ends FROM q),
h AS (SELECT path, s, e, s AS a, s + 2 AS z, opening AS content FROM b WHERE cut
  UNION ALL SELECT path, s, e, s + 2, s + 2 + q + ends::INT, array_to_string([doc] || body[1 : q + ends::INT], chr(10) || '    ') FROM b WHERE cut
  UNION ALL SELECT path, s, e, s + 3 + q, e, array_to_string(body[q + 1 : k + 1], chr(10) || '    ') FROM b WHERE cut AND NOT ends),
o AS (SELECT path, s AS a, e AS z, opening || array_to_string([doc] || body, chr(10) || '    ') AS content FROM b WHERE NOT cut),
m AS (SELECT path, s + 4 AS a, s + 5 AS z, 'method' AS kind, 'def get(self):' || chr(10) || '        return json.dumps(self)' AS content FROM c
  UNION ALL SELECT path, s + 8, s + 9, 'method', 'def put(self):' || chr(10) || '            pass' FROM c UNION ALL SELECT path, s + 7, s + 9, 'class_header', 'class Inner:' || chr(10) || '    def put(self) ...' FROM c
  UNION ALL SELECT path, s, s + 9, 'class_header', array_to_string(['class C' || doc_id || '(Base, mixins.Sized):', '\"\"\"Kept.\"\"\"', 'size = ' || n_chars, 'def get(self) ...', 'class Inner ...'], chr(10) || '    ') FROM c)""".format(most=MOST)


@query(f"WITH {_CHUNKS_SQL} SELECT path, a::INTEGER AS start_line, z::INTEGER AS end_line, kind, content FROM (SELECT path, a, z, 'function' AS kind, content FROM h UNION ALL SELECT path, a, z, 'function', content FROM o UNION ALL SELECT * FROM m)")
def py_chunks(spark, sf_dir):
    return pysource.python_chunks(sources(spark, sf_dir), most=MOST)


_MERGED_SQL = f"""{SOURCES_SQL}, w AS (SELECT *, 6 + n_words + 3 * k AS n FROM f), r AS (SELECT path, doc_id, j, s AS a, e AS z, n FROM w WHERE j = 1
  UNION ALL SELECT w.path, w.doc_id, w.j, CASE WHEN r.n + w.n <= {MERGED} THEN r.a ELSE w.s END, w.e, CASE WHEN r.n + w.n <= {MERGED} THEN r.n + w.n ELSE w.n END FROM r JOIN w ON w.doc_id = r.doc_id AND w.j = r.j + 1)"""


@query(
    f"""WITH RECURSIVE {_MERGED_SQL}, m AS (SELECT path, a, max(z) AS z, 'function' AS kind, max(n) AS n FROM r GROUP BY path, a
    UNION ALL SELECT path, s + 4, s + 9, 'method', 9 FROM c UNION ALL SELECT path, s + 7, s + 9, 'class_header', 5 FROM c UNION ALL SELECT path, s, s + 9, 'class_header', 13 FROM c)
    SELECT path, a::INTEGER AS start_line, z::INTEGER AS end_line, kind, n::BIGINT AS tokens FROM m"""
)
def py_chunks_merged(spark, sf_dir):
    return pysource.python_chunks(sources(spark, sf_dir), most=MERGED, merge=True).select("path", "start_line", "end_line", "kind", token_count("content").alias("tokens"))


@query(
    f"""WITH {_CHUNKS_SQL}, v AS (SELECT path, a, z, 'function' AS kind, content AS skeleton, NOT contains(content, chr(10)) AS parses FROM h
    UNION ALL SELECT path, a, z, 'function', split_part(content, '\"\"\"', 1) || '\"\"\"' || split_part(content, '\"\"\"', 2) || '\"\"\"' || chr(10) || '    ...  # body omitted — expand via ' || path || ':' || a || '-' || z, true FROM o
    UNION ALL SELECT path, a, z, kind, CASE kind WHEN 'method' THEN split_part(content, chr(10), 1) || chr(10) || '    ...  # body omitted — expand via ' || path || ':' || a || '-' || z ELSE content END, kind = 'method' FROM m)
    SELECT path, a::INTEGER AS start_line, z::INTEGER AS end_line, kind, skeleton, parses FROM v"""
)
def py_skeleton(spark, sf_dir):
    return pysource.python_skeletons(pysource.python_chunks(sources(spark, sf_dir), most=MOST)).select("path", "start_line", "end_line", "kind", "skeleton", "parses")


@query(f"WITH {_SYMBOLS_SQL} SELECT path, qualified, kind, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line FROM y")
def py_symbols_sql(spark, sf_dir):
    pysource.register(spark)
    return spark.sql("SELECT path, s.* FROM {files}, LATERAL py_symbols(content) AS s", files=sources(spark, sf_dir)).select("path", "qualified", "kind", "start_line", "end_line")


@query(
    f"""WITH {_SYMBOLS_SQL}, p AS (SELECT doc_id, path, s, e, 1 AS place FROM f WHERE j = 1 UNION ALL SELECT doc_id, path, s, s + 9, 2 FROM c UNION ALL SELECT doc_id, path, s + 4, s + 5, 3 FROM c)
    SELECT doc_id AS patch_id, path, s::INTEGER AS start_line, e::INTEGER AS end_line, place FROM p"""
)
def patch_gold(spark, sf_dir):
    """Patches that name a document's first function twice, its class, a method and a function that it lacks."""
    files, i = sources(spark, sf_dir), F.col("doc_id")
    hunk = lambda *names: _text("@@ -1,2 +1,3 @@ ", *names, ":\n+    pass\n")
    patch = F.concat(_text("--- a/", F.col("path"), "\n+++ b/", F.col("path"), "\n"), hunk("def f1_", i, "(a)"), hunk("class C", i, "(Base)"), hunk("def f1_", i, "(a)"), hunk("    def get(self)"), hunk("def gone()"))
    return reanchor(parse_patches(files.select(i.alias("patch_id"), patch.alias("patch"))), pysource.python_symbols(files))
