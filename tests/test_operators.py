from __future__ import annotations

import base64
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import cost, text, vectors
from tessella.operators import assembly, chunks, history, metrics, store
from tessella.operators.retrieval import search_text, topk
from tessella.plans import agent
from tessella.plans.registry import numbers


def one(df):
    return df.first().asDict()


def test_topk_ties_dimensions_and_k(spark):
    rows = [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "qid long, embedding array<float>")
    got = [(r.vec_id, r.score, r.rank) for r in topk(df, q, 4).orderBy("rank").collect()]
    assert got == [(1, 1.0, 1), (3, 1.0, 2), (2, 0.0, 3), (4, 0.0, 4)]
    assert topk(df, q, 0).count() == 0 and topk(df, q.limit(0), 3).count() == 0
    many = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(50)], "vec_id long, embedding array<float>")
    asked = many.withColumnRenamed("vec_id", "qid").where("qid < 5")
    exact = many.join(asked.withColumnRenamed("embedding", "e")).select("qid", "vec_id", vectors.cosine(F.col("embedding"), F.col("e")).alias("s"))
    for r in topk(many, asked, 3).collect():
        assert r.score == pytest.approx(exact.where(f"qid = {r.qid} and vec_id = {r.vec_id}").first().s, abs=1e-6)


def test_vector_bytes():
    assert vectors.decode_vector(vectors.encode_vector([1.5, -2.0])) == [1.5, -2.0] and vectors.encode_vector([1.0]) == b"\0\0\x80\x3f"


def test_recall(spark):
    tasks = spark.createDataFrame([("a",), ("b",)], "task_id string")
    gold = spark.createDataFrame([("a", 1, "x", 5, 10), ("a", 2, "x", 20, 30), ("a", 3, "x", 50, 60)], "task_id string, gold_no long, path string, start_line int, end_line int")
    found = spark.createDataFrame([("a", "x", 10, 12), ("a", "x", 22, 25), ("a", "y", 50, 60), ("a", "x", 9, 11)], "task_id string, path string, start_line int, end_line int")
    got = {r.task_id: (r.gold_size, r.hits, r.recall) for r in metrics.recall(tasks, gold, found).collect()}
    assert got == {"a": (3, 2, 2 / 3), "b": (0, 0, 0.0)}


def test_headline(spark):
    rows = [("localization", 1.0, 100), ("localization", 0.5, 200), ("enumeration", 0.0, 300)]
    df = spark.createDataFrame(rows, "bucket string, recall double, retrieved_tokens long")
    assert one(metrics.headline(df)) == {"recall_at_k": 0.75, "mean_tokens": 200.0} and one(metrics.headline(df.limit(0))) == {"recall_at_k": 0.0, "mean_tokens": 0.0}


def test_arms_and_choices(spark):
    cols = "arm string, budget int, model string, localization boolean, success boolean, buckets map<string,long>, prompt_tokens long, cached_tokens long, completion_tokens long, summarized long, dropped long"
    rows = [("t", 1, "none", True, True, {"system": 100, "history": 50}, 200, 100, 0, 1, 0), ("t", 1, "none", True, False, {"system": 200, "history": 100}, 400, 0, 0, 0, 2)]
    got = one(metrics.aggregate_arms(spark.createDataFrame(rows, cols)))
    assert (got["success_rate"], got["mean_system"], got["mean_total"], got["cache_hit"], got["mean_cost"]) == (0.5, 150.0, 225.0, 100 / 600, 0.0)
    t = spark.createDataFrame([(5000, 0.9, 10.0, 1), (3000, 0.86, 30.0, 2), (2000, 0.5, 60.0, 3)], "budget int, success_rate double, reduction double, place int")
    assert metrics.best_valid(t, F.lit(0.9), 0.05).first().budget == 3000 and metrics.best_valid(t, F.lit(9.0), 0.05).count() == 0
    sweep = spark.createDataFrame([(5000, 0), (3000, 2), (2000, 5)], "budget int, dropped long")
    assert metrics.drop_boundary(sweep).first().budget == 3000 and metrics.drop_boundary(sweep.limit(1)).first().budget == 0


def test_costs(spark):
    df = spark.createDataFrame([(1000, 800, 100)], "p long, c long, o long")
    assert df.select(cost.net_cost(F.col("p"), F.col("c"), F.col("o"), F.lit(1.0), F.lit(2.0))).first()[0] == pytest.approx(0.0008)
    assert df.select(cost.reduction(F.lit(0), F.col("p"))).first()[0] == 0.0 and df.select(cost.hit_rate(F.lit(0), F.lit(0))).first()[0] == 0.0
    assert df.select(cost.cache_net_cost(F.col("p"), F.col("c"), F.col("o"), 0.5, F.lit(1.0), F.lit(2.0), F.lit(10), F.lit(3.0))).first()[0] == pytest.approx((1400 + 200 + 30) / 1e6)


def test_summaries_and_tokens(spark):
    df = spark.createDataFrame([("head\na b c d",), ("only",), ("x\n",), (None,)], "t string")
    assert [r[0] for r in df.select(text.sized_summary("t", 2)).collect()] == ["head a b", "only", "x", None]
    assert [r[0] for r in df.select(text.sized_summary("t", 0)).collect()][0] == "head a b c d"
    assert [r[0] for r in df.select(text.token_count("t")).collect()] == [5, 1, 1, 0]
    assert [r[0] for r in spark.createDataFrame([("AB_1",), ("aB",), ("_1",)], "t string").select(text.is_all_caps("t")).collect()] == [True, False, False]
    assert history.size_summary("head\na b c d", 2) == "head a b"


def test_bpe_tokens(spark):
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "def f(x):\n    return x + 1\n", "Ünïcode 漢字 \U0001f600 it's", "a" * 5000, "<|endoftext|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text.token_count("t", "bpe", path)).collect()] == [len(own.encode_ordinary(t or "")) for t in texts]


FULL, SKELETON = 31, 4


def _ranked(spark, sizes):
    block = lambda n: " ".join(["w"] * n)
    rows = [("t", i + 1, n, SKELETON, block(n), block(SKELETON)) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "task_id string, rank int, full_tokens long, skeleton_tokens long, full_text string, skeleton_text string")


@pytest.mark.parametrize(("budget", "want"), [(100_000, (3, 0, 0)), (49, (1, 2, 0)), (31, (1, 0, 2)), (36, (1, 1, 1))])
def test_assembly(spark, budget, want):
    got = assembly.assemble(_ranked(spark, [31, 9, 9]), numbers(spark, (budget,))).first()
    assert (got.full_count, got.skeleton_count, got.dropped) == want


def test_assembly_is_the_fold(spark):
    rng = random.Random(5)
    count = lambda t: len(t.split())
    for _ in range(3):
        ranked = _ranked(spark, [rng.randint(5, 60) for _ in range(8)])
        budgets = numbers(spark, (20, 60, 120, 250))
        a = {r.budget: r for r in assembly.assemble(ranked, budgets).collect()}
        b = {r.budget: r for r in assembly.assemble_by(ranked, budgets, count).collect()}
        assert {k: (r.full_count, r.skeleton_count, r.dropped, r.tokens, r.kept_full_tokens, r.text) for k, r in a.items()} == {k: (r.full_count, r.skeleton_count, r.dropped, r.tokens, r.kept_full_tokens, r.text) for k, r in b.items()}
    assert assembly.fold([], 10, count) == ("", 0, 0, 0, 0)


TURNS = [("user", "goal is here now"), ("assistant", "look"), ("tool", "a:1\nb c d e"), ("assistant", "more"), ("tool", "b:2\nf g h i"), ("assistant", "last"), ("tool", "c:3 z")]


def _turns(spark, turns, conv=1):
    return spark.createDataFrame([(conv, i, r, c) for i, (r, c) in enumerate(turns)], "conv_id long, step long, role string, content string")


def test_protected(spark):
    got = lambda t: [r.protected for r in history.with_protected(_turns(spark, t)).orderBy("step").collect()]
    assert got([("user", "g"), ("assistant", "a"), ("tool", "o"), ("assistant", "b"), ("tool", "p")]) == [True, False, False, True, True]
    assert got([("tool", "x"), ("tool", "y")]) == [False, False]


def test_compression_goes_oldest_first(spark):
    run = lambda b: history.compress(_turns(spark, TURNS), numbers(spark, (b,)), lambda c: text.first_line(c)).orderBy("step").collect()
    assert not any(r.compressed for r in run(1000)) and not any(r.compressed for r in run(0))
    total = sum(len(c.split()) for _, c in TURNS)
    few = run(total - 1)
    assert [r.summarized for r in few] == [False, False, True, False, False, False, False] and few[2].new_content == "a:1"
    all_ = run(3)
    assert [r.summarized for r in all_] == [False, False, True, False, True, False, False] and [r.dropped for r in all_] == [False, False, True, False, True, False, False]
    assert all_[0].new_content == TURNS[0][1] and all_[6].new_content == TURNS[6][1]


def _pass(turns, budget, shorten):
    """One compression pass, slowly: turns are [role, content, asked]; gives the summarizer's tokens, and what was shortened and dropped."""
    count = lambda: sum(len(t[1].split()) for t in turns)
    last = max(i for i, t in enumerate(turns) if t[0] == "assistant")
    read, done = 0, [0, 0]
    for kind in (0, 1):
        for t in turns[:last]:
            if count() > budget and t[0] == "tool" and t[1] != history.MARKER and not (kind == 0 and t[2]):
                new = history.MARKER if kind else shorten(t[1])
                if not kind:
                    read += len(t[1].split()) + len(new.split())
                    t[2] = True
                if kind or len(new.split()) < len(t[1].split()):
                    t[1] = new
                    done[kind] += 1
    return read, *done


def _random_turns(rng):
    turns = [("user", "goal")]
    for _ in range(rng.randint(1, 9)):
        turns += [("assistant", "go " * rng.randint(1, 4)), *[("tool", "h x\n" + "w " * rng.randint(0, 30)) for _ in range(rng.randint(0, 3))], *[("user", "and")] * (rng.random() < 0.2)]
    return turns + [("tool", history.MARKER)] * (rng.random() < 0.3) + [("assistant", "end")]


def test_compression_is_the_slow_pass(spark):
    rng = random.Random(2)
    for conv in range(4):
        turns = _random_turns(rng)
        budgets = (10, 40, 80)
        rows = history.compress(_turns(spark, turns, conv), numbers(spark, budgets), lambda c: text.sized_summary(c, 5)).collect()
        for b in budgets:
            slow = [[r, c, False] for r, c in turns]
            _, short, cut = _pass(slow, b, lambda t: history.size_summary(t, 5))
            own = sorted((x for x in rows if x.budget == b), key=lambda x: x.step)
            assert [x.new_content for x in own] == [t[1] for t in slow]
            assert (sum(x.summarized for x in own), sum(x.dropped for x in own)) == (short, cut)
            live = [agent.Message(r, c) for r, c in turns]
            assert agent.compact(live, b, lambda t: history.size_summary(t, 5)) == (short, cut) and [m.content for m in live] == [t[1] for t in slow]


def test_replay_is_the_slow_walk(spark):
    rng = random.Random(9)
    convs = {c: _random_turns(rng) for c in range(12)} | {12: [("user", "q")], 13: [("assistant", "a")]}
    budgets = (0, 12, 30, 60)
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    got = {(r.conv_id, r.budget): r for r in history.replay(spark.createDataFrame(rows, "conv_id long, step long, role string, content string"), numbers(spark, budgets), 7, 3).collect()}
    assert len(got) == len(convs) * len(budgets)
    for c, turns in convs.items():
        for b in budgets:
            seen, held, want = [], None, [0] * 6
            for i, (role, words) in enumerate(turns):
                if role == "assistant":
                    now = [(r, t) for r, t, _ in seen]
                    same = next((k for k, (x, y) in enumerate(zip(now, held or [], strict=False)) if x != y), len(held or []))
                    want[0] += 7 + sum(len(t.split()) for _, t in now)
                    want[2] += 0 if held is None else 7 + sum(len(t.split()) for _, t in now[:same])
                    want[1] += len(words.split())
                    held = now
                seen.append([role, words, False])
                acted = next((r for r, _ in turns[i::-1] if r != "tool"), "") == "assistant"
                if b and acted and (i + 1 == len(turns) or turns[i + 1][0] != "tool"):
                    want[3:] = [x + y for x, y in zip(want[3:], _pass(seen, b, lambda t: history.size_summary(t, 3)), strict=True)]
            r = got[c, b]
            assert [r.input, r.output, r.cached, r.overhead, r.summarized, r.dropped] == want and r.fresh == r.input - r.cached and r.engaged == (want[4] + want[5] > 0)
            assert b or (r.base_input, r.base_cached) == (r.input, r.cached)
            assert (r.base_input, r.base_cached) == (got[c, 0].input, got[c, 0].cached)


def test_replay_engages_and_breaks_the_cache(spark):
    long = [("user", "find the bug"), ("assistant", "read"), ("tool", "f:1\n" + "word " * 80)] + [x for i in range(4) for x in (("assistant", f"step {i}"), ("tool", f"ok {i}"))] + [("assistant", "submit")]
    got = {r.budget: r for r in history.replay(_turns(spark, long), numbers(spark, (0, 20)), 10, 3).collect()}
    assert not got[0].engaged and got[20].engaged and got[0].output == got[20].output and got[20].input < got[0].input
    assert got[20].cached / got[20].input < got[0].cached / got[0].input and got[0].cached + got[0].fresh == got[0].input
    plain = history.replay_plain(_turns(spark, long), 10).first()
    assert (plain.input, plain.output) == (got[0].input, got[0].output)
    sums = history.plain_prompts(_turns(spark, long), 10).agg(F.sum("cached").alias("cached"), F.sum("fresh").alias("fresh")).first()
    assert (sums.cached, sums.fresh) == (got[0].cached, got[0].fresh)


def test_batches(spark):
    df = spark.createDataFrame([("s", i, "x" * 20) for i in range(5)], "source string, doc_id long, text string")
    got = [r.batch for r in chunks.embedding_batches(df, 128, 12).orderBy("doc_id").collect()]
    assert got == [0, 0, 1, 1, 2]
    assert [r.batch for r in chunks.embedding_batches(df, 2, 10**6).orderBy("doc_id").collect()] == [0, 0, 1, 1, 2]


def test_line_chunks_and_spans(spark):
    df = spark.createDataFrame([(1, "a b\nc d e f g\nh\ni"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.start_line, r.end_line, r.tokens) for r in chunks.line_chunks(df, 3).orderBy("doc_id", "chunk").collect()] == [(1, 1, 1, 2), (1, 2, 2, 5), (1, 3, 4, 2), (3, 1, 1, 0)]
    files = spark.createDataFrame([("a.py", "one\ntwo\nthree")], "path string, content string")
    asked = spark.createDataFrame([("a.py", 2, 9), ("a.py", 7, None), ("b.py", 1, 1), ("/a", 1, 1), ("../a", 1, 1), ("a.py", None, None), ("a.py", 2, 1)], "path string, start int, end int")
    got = {(r.path, r.start, r.end): (r.text, r.error) for r in chunks.read_spans(files, asked, 2).collect()}
    assert got["a.py", 2, 9][0] == "a.py:2-3\n2: two\n3: three" and got["a.py", 7, None][1] and got["b.py", 1, 1][1] == "no such file"
    assert got["/a", 1, 1][1] and got["../a", 1, 1][1] and got["a.py", None, None][0] == "a.py:1-2\n1: one\n2: two" and got["a.py", 2, 1][0] == "a.py:2-2\n2: two"


def test_store_keeps_vectors_of_known_content(spark, tmp_path):
    asked = []

    def embed(rows):
        asked.append(rows.count())
        return rows.withColumn("vec", vectors.fake_embedding(F.col("content"), 8))

    s = store.ChunkStore(spark, str(tmp_path / "store"))
    assert s.count() == 0
    both = spark.createDataFrame([("a.py", 1, 2, "function", "def a"), ("a.py", 3, 4, "function", "def b"), ("b.py", 1, 5, "class_header", "class C")], "path string, start_line int, end_line int, kind string, content string")
    s.upsert(both, embed)
    s.upsert(both.where("path = 'a.py'"), embed)
    assert asked == [3, 0] and s.count() == 3 and s.read().where("dim = 8 and size(vec) = 8").count() == 3
    q = spark.createDataFrame([("def b",)], "content string").select(F.lit(1).cast("long").alias("qid"), vectors.fake_embedding(F.col("content"), 8).alias("vec"))
    best = topk(s.read(), q, 1, chunk_id="id", vector="vec").join(s.read(), "id").first()
    assert best.content == "def b" and best.score >= 0.99
    s.delete(spark.createDataFrame([("b.py",)], "path string"))
    assert s.count() == 2 and s.read().where("path = 'b.py'").count() == 0
    parts = s._manifest()["parts"]
    many = spark.range(40).select(F.format_string("p%d.py", "id").alias("path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit("function").alias("kind"), F.col("id").cast("string").alias("content"))
    assert s.build(many, lambda f: f, embed) == 40 and s.count() == 42 and s.read().select("id").distinct().count() == 42
    s.delete(spark.createDataFrame([("p7.py",), ("none.py",)], "path string"))
    assert s.count() == 41 and len(set(s._manifest()["parts"].values()) - set(parts.values())) > 5
    before, held = s._manifest()["before"], s.read()
    assert s.vacuum() > 0 and held.count() == 41 and s._read(before).count() == 42 and s.vacuum() == 0


def test_patches(spark):
    patch = "+++ b/x.py\n@@ -1 +1 @@ def f(a):\n@@ -5 +5 @@ class G:\n+++ b/y.py\n@@ -1 +1 @@ def f():\n@@ -9 +9 @@ def f(a):\n"
    rows = chunks.parse_patches(spark.createDataFrame([(7, patch)], "patch_id long, patch string")).orderBy("place").collect()
    assert [(r.path, r.symbol) for r in rows] == [("x.py", "f"), ("x.py", "G"), ("y.py", "f")]


def test_json_arguments(spark):
    df = spark.createDataFrame([(json.dumps({"query": "a"}),), ("{",), ("{}",)], "args string")
    q, e = text.query_argument("args")
    assert [tuple(r) for r in df.select(q, e).collect()] == [("a", None), (None, "no query"), (None, "no query")]


def test_search_text(spark):
    rows = [(1, "a.py", 1, 2, "function", "def f(x):\n    return x + 1\n", [1.0, 0.0]), (2, "b.py", 5, 6, "function", "def g(x):\n    return x - 1\n", [0.8, 0.6])]
    df = spark.createDataFrame(rows, "id long, path string, start_line int, end_line int, kind string, content string, vec array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vec array<float>")
    got = search_text(df, q, 2, 12).first().text
    assert got.startswith("a.py:1-2\ndef f(x):\n    return") and "b.py:5-6" not in got or "body omitted" in got
    assert search_text(df.limit(0), q, 2, 100).first().text == "no results"
