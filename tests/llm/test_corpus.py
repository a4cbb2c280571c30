"""Line dedup, packing, sharding, embeddings, language models, similarity join, language ID, pipeline."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, common, components, embeddings, gif, jaccard, langid, license, lines, lm, packing, queries, shards


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(same_rows, name):
    same_rows(queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_best_fit_packing", "op4_extendible_shards", "op8_lm_score", "op9_ngram_jaccard", "op10_language_id"])
def test_odd_rows_and_empty_tables(odd, empty, name):
    f = {"op2": lines.digest, "op3": packing.digest, "op4": shards.digest, "op8": lm.digest, "op9": jaccard.digest, "op10": langid.identify}[name.split("_")[0]]
    assert f(empty).count() == 0
    got = f(odd)
    if name == "op3_best_fit_packing":
        assert got.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    else:
        assert got.count() == odd.count()


def test_word_hashes_by_segments(monkeypatch):
    text = ("Ünïcode words AND w" + "x" * 300 + " ab\t") * 20
    raw = np.frombuffer(text.encode(), np.uint8)
    s, e = common.words(raw, np.array([0, len(raw)]))
    whole = common.word_hashes(raw, s, e)
    assert len(set(whole)) == 5 and [int(h) for h in whole[:5]] == [common.hash_word(w) for w in text.split()[:5]]
    for size in (1, 7, 100, 1000):
        monkeypatch.setattr(common, "SEGMENT", size)
        assert (common.word_hashes(raw, s, e) == whole).all()
    assert len(common.word_hashes(raw, s[:0], e[:0])) == 0


def test_null_ids(spark):
    """Rows without an id are rows like others: each gets its own result, the same as a row of that text with an id."""
    texts = ["one two three four five\nsix seven\neight nine\nten", "der Hund und die Katze", "Licensed under the Apache License, Version 2.0", "", None]
    rows = [(i, t, "en", "s", 1) for k, t in enumerate(texts) for i in (None, k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in queries.queries().items():
        if name.startswith(("op5_", "op4_", "op2_", "op9_")):
            continue
        digest = {"op1": gif.digest, "op3": packing.digest, "op6": bpe.digest, "op7": license.digest, "op8": lm.digest, "op10": langid.identify}[name.split("_")[0]]
        got = digest(df)
        own = [c for c in got.columns if c not in ("doc_id", "held_out", "bin_id", "bin_start", "bin_length")]
        known, unknown = (Counter(tuple(r[c] for c in own) for r in got.where(w).collect()) for w in ("doc_id is not null", "doc_id is null"))
        assert known == unknown and sum(known.values()) == len(texts), name
    # without ids first: of equal windows that of the row without an id stays, and null keys count as empty
    cut = {r.doc_id: r.n_removed for r in lines.digest(df.where("text like 'one%'")).collect()}
    assert cut == {None: 0, 0: 4}
    assert shards.digest(df).where("doc_id is null").count() == len(texts)
    same = {(r.doc_id, r.component_id) for r in jaccard.digest(df.where("length(text) > 0")).collect()}
    assert same == {(None, 0), (0, 0), (None, 1), (1, 1), (None, 2), (2, 2)}


def _slow_lines(texts):
    """Texts in id order with later windows of three lines taken out."""
    seen, out = set(), []
    for t in texts:
        ls = t.split("\n")
        gone = set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if all(x.strip(" ") == "" for x in w):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out.append("\n".join(x for i, x in enumerate(ls) if i not in gone) if gone else t)
    return out


def test_line_dedup_against_brute_force(docs):
    rng = random.Random(7)
    texts = ["\n".join(rng.choice("abcd ") for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["a\nb\nc", "a\nb\nc", "z\n" * 8, "\n\n\n\n", "x\ny"]
    rows = {r.doc_id: r for r in lines.dedup_lines(docs(texts)).collect()}
    assert [rows[i].text for i in range(len(texts))] == _slow_lines(texts)
    for i, t in enumerate(texts):
        removed = sum(s["last"] - s["first"] + 1 for s in rows[i].removed_spans)
        assert rows[i].n_removed == removed and rows[i].n_lines == len(t.split("\n"))
    assert lines.dedup_lines(docs([None, "", "a"])).where("text is null").count() == 1


def test_packing_rules():
    rng = random.Random(3)
    caps = (64, 128, 256)
    for _ in range(5):
        sizes = sorted((rng.randint(1, 256) for _ in range(200)), reverse=True)
        placed, bins = packing.pack(sizes, caps)
        used, spans = Counter(), defaultdict(list)
        for n, (b, start) in zip(sizes, placed, strict=True):
            used[b] += n
            spans[b].append((start, start + n))
        for b, c in enumerate(bins):
            assert used[b] <= c and c in caps and c == min(x for x in caps if x >= used[b])
            ends = sorted(spans[b])
            assert all(x[1] == y[0] for x, y in zip(ends, ends[1:], strict=False)) and ends[0][0] == 0
        alone = sum(packing.cost(min(c for c in caps if c >= n)) for n in sizes)
        assert sum(map(packing.cost, bins)) <= alone
    one = packing.Packing((10,), 10)
    for n in (6, 5, 4, 3):
        one.put(n, 0)
    assert [b for b, _ in one.placed] == [0, 1, 0, 1]  # each where least room is left
    assert packing.pack([], caps) == ([], [])


def _slow_pack(lengths, capacities, opening):
    """Best fit by looking at every bin: the least room that holds a piece, then the bin that had it first by room."""
    bins = []
    for k, n in enumerate(lengths):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[0] - b[1], bins.index(b)))
        else:
            rest = sum(lengths[k:])
            able = [c for c in capacities if c >= n]
            size = max(able[0], opening) if opening else min(able, key=lambda c: packing.cost(c) / min(c, max(n, rest)))
            bins.append(b := [size, 0])
        b[1] += n
    return sorted(min(c for c in capacities if c >= used) for _, used in bins)


def test_packing_is_the_cheapest_slow_packing():
    rng = random.Random(8)
    caps = (16, 32, 64, 128)
    for n in (1, 5, 60, 300):
        lengths = sorted((min(128, int(rng.paretovariate(0.7))) for _ in range(n)), reverse=True)
        slow = [_slow_pack(lengths, caps, c) for c in (*caps, None)]
        best = min(slow, key=lambda sizes: sum(map(packing.cost, sizes)))
        got = packing.pack(lengths, caps)[1]
        assert sum(map(packing.cost, got)) == pytest.approx(sum(map(packing.cost, best))) and sorted(got) in slow


def test_sequences_hold_the_texts(docs):
    rng = random.Random(5)
    texts = [" ".join(f"w{i}_{k}" for k in range(rng.randint(0, 700))) for i in range(40)] + ["a " * 9000, None, "\t x\n"]
    df = docs(texts)
    packed = packing.digest(df)
    own = {r.bin_id: r for r in packing.sequences(df, packed).collect()}
    assert all(r.n_tokens == len(r.tokens) <= r.bin_length for r in own.values())
    got = defaultdict(list)
    for r in sorted(packed.collect(), key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] += own[r.bin_id].tokens[r.bin_start : r.bin_start + r.n_tokens]
    assert got == {i: [*(t or "").split(), "</s>"] for i, t in enumerate(texts)} and sum(r.n_tokens for r in own.values()) == sum(map(len, got.values()))


def test_repeated_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_TOKENS", 1000)
    rows = packing.pack_rows(spark.createDataFrame([(None if k % 2 else 7, 50) for k in range(400)], "doc_id long, n_tokens long")).collect()
    assert len(rows) == 400 and len({r.bin_id.split("-")[0] for r in rows}) > 10


def test_packing_keeps_every_token(docs):
    texts = ["w " * 10_000, "a b c", "", None, "a b c"]
    rows = packing.digest(docs(texts)).collect()
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
        assert r.bin_start + r.n_tokens <= r.bin_length and r.bin_length in packing.CAPACITIES and r.piece_start == r.piece * 4096
    assert got == {0: 10_001, 1: 4, 2: 1, 3: 1, 4: 4}
    assert all(r.n_tokens <= 4096 for r in rows)


@pytest.mark.parametrize("limit", [1, 40, 1000, 10**9])
def test_shards_against_a_directory(spark, limit):
    rng = random.Random(limit)
    sizes = {i: rng.randint(0, 30) for i in range(300)} | {300: 500}
    df = spark.createDataFrame(list(sizes.items()), "k long, size long")
    rows = shards.shard(df, F.col("k"), F.col("size"), limit).collect()
    place = {r.k: f"{r.h:060b}" for r in df.select("k", shards.place(F.col("k")).alias("h")).collect()}
    leaves, todo = {}, [""]
    while todo:
        prefix = todo.pop()
        own = [k for k in sizes if place[k].startswith(prefix)]
        if sum(sizes[k] for k in own) <= limit or len(prefix) == 60:
            leaves |= dict.fromkeys(own, prefix)
        else:
            todo += [prefix + "0", prefix + "1"]
    assert {r.k: r.shard_id for r in rows} == leaves and len(rows) == len(sizes)
    sums = Counter()
    for r in rows:
        sums[r.shard_id] += r.size
    assert all(sums[r.shard_id] == r.shard_bytes and r.over_limit == (r.shard_bytes > limit) and len(r.shard_id) == r.depth for r in rows)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = embeddings.rotations(x, 3)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(embeddings.hadamard(embeddings.hadamard(x)), x)
    assert embeddings.rotations(x[:, :5], 1).shape == (5, 8)


def _vectors(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(12):
            base = rng.normal(size=32)
            for _ in range(rng.integers(1, 9)):
                rows.append((n, (base + rng.normal(size=32) * rng.choice([0.05, 0.2, 0.3])).tolist(), label))
                n += 1
    rows += [(n + k, rows[0][1], 0) for k in range(5)] + [(n + 5, rows[0][1], 1), (n + 6, rows[0][1], None)]
    rows += [(n + 7, None, 0), (n + 8, [0.0] * 32, 0), (n + 9, [0.0] * 32, 0), (n + 10, [math.nan] * 32, 0), (n + 11, [1.0, None], 0), (n + 12, [math.inf] * 32, 0), (n + 13, [1.0, 2.0], 0), (n + 14, [2.0, 4.0], 0), (n + 15, [], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def test_embeddings_against_brute_force(spark):
    df, rows = _vectors(spark)
    good = {i: (np.float32(v).astype(float), c) for i, v, c in rows if v and None not in v and np.isfinite(v).all() and np.any(v) and c is not None}
    linked = defaultdict(set)
    for i, (x, c) in good.items():
        for j, (y, d) in good.items():
            if i != j and c == d and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                linked[i].add(j)
    got = {r.vec_id: r for r in embeddings.digest(df).collect()}
    assert len(got) == len(rows)
    found, exact = sum(r.n_links for r in got.values()), sum(map(len, linked.values()))
    assert all(r.n_links <= len(linked[i]) for i, r in got.items()) and found >= 0.98 * exact > 0
    for i, r in got.items():
        assert r.kept == (r.component_id == i) and (i in good or (r.n_links, r.component_id) == (0, i))
    assert embeddings.digest(df.limit(0)).count() == 0


@pytest.mark.parametrize(("d", "n"), [(64, 500), (64, 6000), (64, 700_000), (64, 10**8), (128, 10**9), (768, 10**9), (768, 10**11), (5, 10**6)])
def test_recall_is_held_at_every_size(d, n):
    """Of random pairs at the threshold, those that the tables for n vectors let meet."""
    depth, last, tables = embeddings.shape(n, d, embeddings.PROBES, embeddings.THRESHOLD)
    rng = np.random.default_rng(11)
    x, z = rng.normal(size=(2, 1500, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    met = np.zeros(len(x), bool)
    for t in range(tables):
        a, b = (embeddings.hashes(v, t, depth, last, embeddings.PROBES) for v in (x, y))
        met |= (a[:, :, None] == b[:, None, :]).any((1, 2))
    assert met.mean() >= 0.95


def test_embeddings_take_any_ids_and_columns(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 16)).tolist()
    near = [x + 0.01 for x in a]
    rows = [(5, a), (5, b), (None, near), (3, near), (None, [-x for x in b]), (None, [-x for x in b]), (9, None), (None, None)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    df = df.withColumns({c: F.lit(1) for c in ("rep", "size", "bucket", "n_links", "component_id", "_id", "least", "root")})
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.digest(df).collect())
    assert got == Counter([(5, 2, 3, False), (5, 0, 5, True), (None, 2, 3, False), (3, 2, 3, True), (None, 1, None, True), (None, 1, None, True), (9, 0, 9, True), (None, 0, None, True)])


@pytest.mark.parametrize(("seed", "one_task"), [(1, 1_000_000), (2, 0)])
def test_components(spark, seed, one_task, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", one_task)  # 0: stars, round by round
    rng = random.Random(seed)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    assert got == {n: find(n) for u, v in edges if u != v for n in (u, v)}


def _tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_lm_base_scores(spark, sf, odd):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        rows = [(r.doc_id, _tokens(r.text)) for r in df.collect()]
        counts = Counter(w for i, ts in rows if zlib.crc32(str(i).encode()) % 10 for w in ts)
        n, v = sum(counts.values()), len(counts)
        want = sorted((i, len(ts), sum(counts[w] > 0 for w in ts), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), 5)) for i, ts in rows)
        got = lm.digest(df).collect()
        assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)


def test_lm_in_many_parts(spark, sf, monkeypatch):
    """In many chunks and ranges the base sums stay the same."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda: {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in lm.digest(df).collect()}
    want = rows()
    monkeypatch.setattr(lm, "RANGE_BYTES", 5000)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(lm, "spread", lambda df, key, size: df.repartition(9, key))
    assert rows() == want


def test_lm_against_brute_force(docs, monkeypatch):
    """The score from exact levels of all n-grams, however many there are, from chunks and ranges of any number."""
    monkeypatch.setattr(lm, "RANGE_BYTES", 4096)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 3000)
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.5)) % 5000}" for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts[7] = texts[5] = texts[3]  # learned from more than once
    counts = Counter()
    for i, text in enumerate(texts):
        t = [None, None, *_tokens(text)]
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(tuple(t[k - n : k + 1]) if n < 2 or k > 2 else ("start", t[k]) for k in range(2, len(t)) for n in range(3))
    singles = {g: c for g, c in counts.items() if len(g) == 1}
    n, below = sum(singles.values()), sum(singles.values()) + 0.1 * (len(singles) + 1)
    level = lambda c: 1.5 * 2 ** math.floor(math.log2(c)) - 0.5 if c else 0

    def slow(text):
        out, t = 0.0, [None, None, *_tokens(text)]
        for k in range(2, len(t)):
            p = (level(counts[(t[k],)]) + 0.1) / below
            pair, triple = (t[k - 1], t[k]), (t[k - 2], t[k - 1], t[k]) if k > 2 else ("start", t[k])
            for gram, context in ((pair, level(counts[(t[k - 1],)])), (triple, level(counts[(t[k - 2], t[k - 1]) if k > 2 else (None,)]))):
                if context:
                    left = 0.75 / context**0.25
                    p = min(max(level(counts[gram]) - 0.75, 0) / context, 1 - left) + left * p
            out += math.log10(min(p, 1))
        return out

    got = {r.doc_id: r for r in lm.digest(docs(texts).repartition(3)).collect()}
    assert len(got) == len(texts) and {r.train_tokens for r in got.values()} == {n}
    off = [(got[i].score - slow(texts[i])) / got[i].n_tokens for i in range(len(texts))]
    # a filter tells a level too much now and then, which moves a share between orders, and never one too few
    assert sum(abs(x) < 1e-6 for x in off) > 0.5 * len(off) and sum(map(abs, off)) / len(off) < 0.02
    assert got[3].score / got[3].n_tokens > max(got[i].score / got[i].n_tokens for i in range(20, 60) if got[i].n_tokens > 5)


def test_bloom_filter_counts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    counts = rng.integers(1, 300, len(h))
    f = lm.Filter(0, lm.part(counts, lm._ranged(h, 0)))
    got = f.count(h)
    assert (got >= 2.0 ** np.floor(np.log2(counts))).all()  # levels never go missing
    assert (np.abs(np.log2(got) - np.log2(counts)) <= 1.1).mean() > 0.95
    assert (f.count(rng.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.05


def _shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def _slow_join(texts, size, percent):
    sets = {i: _shingles(t, size) for i, t in enumerate(texts)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def _near_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    shared = " ".join(word() for _ in range(60))
    out = [None, "", " ", "a", "a", "A", "b c", "b  c", "a b c", "a b c d"]
    for _ in range(14):
        base = [word() for _ in range(rng.choice([5, 9, 12, 16, 25, 60, 250]))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    out += [shared + " " + " ".join(word() for _ in range(rng.choice([1, 5, 40]))) for _ in range(25)] + [out[-1]] * 3
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 4, 85), (2, 4, 85), (3, 5, 80)])
def test_jaccard_against_brute_force(docs, seed, size, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 10)
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # several blocks in a group
    texts = _near_texts(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(texts), size, percent).collect()}
    want = _slow_join(texts, size, percent)
    assert got == want and len({c for _, c in want.values()}) < len(texts) - 20


def test_large_groups_around_a_center(docs, monkeypatch):
    """Chains and stars of copies over many blocks: those far from a group's center are compared with all."""
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(80)]
        for _ in range(30):
            own = list(base)
            own[rng.randrange(80)] = word()
            texts.append(" ".join(own))
        for k in range(25):  # each like the one before, the ends unlike
            base[k * 3] = word()
            texts.append(" ".join(base))
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(texts)).collect()}
    assert got == _slow_join(texts, 4, 85)


def test_light_and_heavy_meet(docs, monkeypatch):
    texts = _near_texts(5)
    want = _slow_join(texts, 4, 85)
    for last in (1, 10, jaccard.LIGHT_MAX):
        monkeypatch.setattr(jaccard, "boundary", lambda sizes, percent, last=last: last)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(texts)).collect()}
        assert got == want


def test_sketches_never_rule_out_links():
    rng = np.random.default_rng(2)
    links = 0
    for n in (3, 40, 500, 515, 1100):
        for share in (0.8, 0.93, 0.97, 1.0):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(0, 2**63, len(a) // 30).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            near = [x for p, _, _ in jaccard._near(np.array([len(a)]), [jaccard.sketch(a)], np.array([len(b)]), [jaccard.sketch(b)], 85) for x in p]
            if 100 * both >= 85 * (len(a) + len(b) - both):
                links += 1
                assert near == [0]
    assert links >= 10
    far = [jaccard.sketch(rng.integers(0, 2**63, 400).astype(np.uint64)) for _ in range(2)]
    assert not list(x for p, _, _ in jaccard._near(np.array([400]), far[:1], np.array([400]), far[1:], 85) for x in p)


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in df.select("doc_id", "lang", "text").collect()}
    got = langid.identify(df).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) >= 0.98 * len(held) and len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.rejected for r in got) <= 2
    model = langid.fit(df.where(langid.trained_on()))
    lang, score, _, rejected = model.predict(["", "12 !", "漢字漢字漢字", "The and of that with are this", "\U00020000"])
    assert lang[:2] == ["und", "und"] and score[0] == 0 and list(rejected[:3]) == [True] * 3 and lang[3] == "en" and not rejected[3]


def test_kneser_ney_sums_to_one():
    packed, _, _ = langid.grams(["the cat sat on the mat and the rat sat on the cat", "a cat and a rat"])
    model = langid.KneserNey(*np.unique(packed, return_counts=True))
    letters = np.unique(packed & np.uint64(0xFFFF))
    for context in np.unique(packed >> np.uint64(16))[:20]:
        total = np.exp(model.log_prob((context << np.uint64(16)) + letters)).sum()
        assert 0.9 < total <= 1.0001


def _slow_kneser_ney(texts):
    """log p(last | three before) of a gram, from the definition: strings, dictionaries and a recursion."""
    counts = {4: Counter()}
    for t in texts:
        whole = "   " + t
        counts[4].update(whole[k - 3 : k + 1] for k in range(3, len(whole)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[-n:] for g in counts[n + 1])
    total = sum(counts[1].values())
    kinds = len(counts[1])

    def p(gram):
        n = len(gram)
        if n == 1:
            return (counts[1][gram] + 1 / (kinds + 1)) / (total + kinds + 1)
        own = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        c = Counter(counts[n].values())
        d = c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5
        seen = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / seen + d * len(own) / seen * p(gram[1:])

    return p


def test_kneser_ney_against_the_definition():
    texts = ["the cat sat on the mat and the rat sat on the cat", "a cat and a rat", "thé ça à", "x"]
    packed, _, _ = langid.grams(texts)
    model = langid.KneserNey(*np.unique(packed, return_counts=True))
    slow = _slow_kneser_ney([t + " " for t in texts])
    asked, owner, _ = langid.grams(["the rat", "a thing of zz", "ça sat"])
    unpack = lambda g: "".join(chr(int(g) >> 16 * k & 0xFFFF) for k in (3, 2, 1, 0))
    for gram, got in zip(asked, model.log_prob(asked), strict=True):
        assert got == pytest.approx(math.log(slow(unpack(gram))), abs=1e-4), unpack(gram)


def test_rejection_takes_foreign_text_and_little_else(spark):
    """Languages and texts that nothing was learned of, against held-out documents of those that are known."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(df.where(langid.trained_on()))
    rng = random.Random(6)
    noise = ["".join(rng.choice("qxzjkvwpgb") for _ in range(80)) for _ in range(20)]
    far = ["Tämä on suomenkielinen lause, jota malli ei ole koskaan nähnyt.", "To jest polskie zdanie, którego model nigdy nie widział.", "Αυτή είναι μια ελληνική πρόταση.", "これは日本語の文です。", *noise]
    assert sum(model.predict(far)[3]) >= 0.95 * len(far)
    held = [r.text for r in df.where(~langid.trained_on()).select("text").collect() if r.text]
    assert sum(model.predict(held)[3]) <= 0.01 * len(held)


def test_long_texts_in_segments(docs, monkeypatch):
    texts = ["Wörter  und\n\n -- Sätze " * 30, "   x" + " " * 400 + "yz 漢字 \U0001f600\U00020000 ", "a", "", "kurz und gut"]
    model = langid.fit(docs(["the cat and the dog " * 9] * 20 + ["der Hund und die Katze " * 9] * 20, {i: "de" for i in range(20, 40)}))
    want, fitted = model.entropies(texts), model.models[0].probs[4]
    for size in (1, 5, 64):
        monkeypatch.setattr(langid, "SEGMENT", size)
        assert all(np.allclose(a, b) for a, b in zip(model.entropies(texts), want, strict=True))
        assert [g for p, _ in langid.pieces(texts[1]) for g in p] == list(langid.grams(texts[1:2])[0])
    again = langid.fit(docs(["the cat and the dog " * 9] * 20 + ["der Hund und die Katze " * 9] * 20, {i: "de" for i in range(20, 40)}))
    assert np.array_equal(again.models[0].probs[4].keys, fitted.keys) and np.allclose(again.models[0].probs[4].values, fitted.values)


def test_ties_confidence_and_models_of_nothing(docs):
    same = langid.KneserNey(*np.unique(langid.grams(["abc abd"])[0], return_counts=True))
    tied = langid.Model(["aa", "bb"], [same, same], np.full(2, np.inf))
    assert tied.predict(["abc"])[0] == ["aa"] and tied.predict(["abc"])[1][0] == pytest.approx(0.5)
    df = docs(["one text here", "", None, "12"], dict.fromkeys(range(4)))
    assert [(r.lang_pred, r.score, r.rejected) for r in langid.identify(df).orderBy("doc_id").collect()] == [("und", 0.0, False)] + [("und", 0.0, True)] * 3
    model = langid.fit(docs(["the cat and the dog"] * 30 + ["der Hund und die Katze"] * 30, {i: "de" for i in range(30, 60)}))
    scores = model.predict(["der Hund " * k for k in (1, 3, 10, 1000)])[1]
    assert (np.diff(scores) >= 0).all() and scores[3] <= 1


def test_labels_teach_nothing_they_should_not(docs):
    texts = [f"the quick brown fox {i} jumps" for i in range(40)] + ["der schnelle braune Fuchs springt"] * 40
    df = docs(texts, {i: "de" for i in range(40, 80)} | {0: None})
    got = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert got[1] == "en" and got[50] == "de" and got[0] == "en"


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf).persist()
        if k < 3:
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
            assert docs.where("length(text) <> n_chars").count() == before.where("length(text) <> n_chars").count()
        else:
            assert docs.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_pipeline_against_brute_force(spark, tmp_path):
    """Kept ids and texts after each of the first three stages, and what packing holds, with null and repeated ids."""
    rng = random.Random(21)
    german, english = (["der", "die", "und", "nicht", "ein", "Haus", "Straße", "schön", "auch", "wir", "über", "gegangen"], ["the", "and", "of", "house", "street", "with", "walked", "which", "their", "over", "nothing", "light"])
    sentence = lambda words, n: " ".join(rng.choice(words) + str(rng.randrange(10)) * (rng.random() < 0.3) for _ in range(n))
    rows = []
    for k in range(60):
        words = (german, english)[k % 2]
        rows.append((k if k % 7 else None, "\n".join(sentence(words, rng.randint(4, 12)) for _ in range(rng.randint(1, 8))), ("de", "en")[k % 2]))
    passage = "\n".join(sentence(english, 9) for _ in range(4))
    rows += [(103, passage, "en"), (100, rows[3][1] + "\n" + passage, "en"), (101, passage + "\n" + rows[5][1] + " more", "en"), (102, rows[9][1] + " end", "en"), (7, rows[11][1] + " end", "en"), (7, sentence(german, 80), "de")]
    rows += [(8, "12 34 !", "en"), (9, None, "en"), (None, "", "de"), (105, "qzxv jkwq " * 40, None), (8, rows[8][1], "de")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    model = langid.fit(docs.where(langid.trained_on()))
    rejected = model.predict([t or "" for _, t, _ in rows])[3]
    left = [(i, t) for (i, t, _), no in zip(rows, rejected, strict=True) if not no]
    assert not {"12 34 !", None, "", "qzxv jkwq " * 40} & {t for _, t in left} and len(left) > 60
    got = corpus_pipeline.keep_identified(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(left)

    key = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in left], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(set(left), key=lambda x: (x[0] is not None, x[0] or 0, key[x[1]]))  # rows that agree in both are one document
    after = dict(zip(order, _slow_lines([t for _, t in order]), strict=True))
    assert sum(after[x] != x[1] for x in order) >= 2 and "" in after.values()
    left = [(x[0], after[x]) for x in left if after[x] == x[1] or after[x].strip(" ")]
    got = corpus_pipeline.drop_repeated_lines(spark, got, "")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(left) and got.where("n_chars <> length(text)").count() == 0

    groups = defaultdict(list)
    for k, (_, root) in _slow_join([t for _, t in left], corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT).items():
        groups[root].append(left[k])
    near = corpus_pipeline.drop_near_copies(spark, got, "")
    kept = Counter((r.doc_id, r.text) for r in near.collect())
    assert sum(kept.values()) == len(groups) < len(left)
    for own in groups.values():  # the smallest id of each group; of null ids or repeated ones, any text
        least = min((i for i, _ in own if i is not None), default=None)
        assert sum(kept[x] for x in set(own)) == 1 and any(kept[x] for x in own if x[0] == least)

    sums, whole = Counter(), Counter()
    for r in corpus_pipeline.pack(spark, near, "").collect():
        sums[r.doc_id] += r.n_tokens
    for (i, t), n in kept.items():
        whole[i] += n * (len(t.split()) + 1)
    assert sums == whole
    sums = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        sums[r.doc_id] += r.n_tokens
    assert sum(sums.values()) == pytest.approx(sum(whole.values()), abs=40)  # of null ids another copy may stay


def test_pipeline_stages_take_odd_rows(spark, odd, empty):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), empty):
        ids = {r.doc_id for r in docs.collect()}
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs, "")
            rows = got.collect()
            # packing gives every document a place; line dedup drops those without a line left, the join one of each pair of copies
            lost = {0: {0, 1, 2}, 1: set(), 2: {4}, 3: set()}[k] if ids else set()
            assert {r.doc_id for r in rows} == ids - lost and (k == 3 or got.columns == docs.columns)
    copies = odd.where("doc_id = 6").select("doc_id", "text", "lang", "source", "n_chars")
    copies = copies.unionByName(copies.withColumn("doc_id", F.lit(99).cast("long"))).unionByName(copies)
    assert corpus_pipeline.drop_near_copies(spark, copies, "").count() == 1


def test_unlabelled_documents_stay(spark):
    rows = [(i, f"a plain text of some words number {i}", None, "s", 30) for i in range(5)] + [(9, None, None, "s", 0), (8, "123", None, "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_identified(spark, df, "").collect()) == [0, 1, 2, 3, 4]


def test_near_copies_by_row(spark):
    """Null and repeated ids: only what is near another row goes, whatever the ids."""
    rng = random.Random(7)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60))
    near = lambda t: t + " end"
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(3, a), (7, near(a)), (7, b), (None, c), (None, d), (None, near(d)), (None, near(b)), (5, e), (5, e), (9, f), (4, near(f)), (-1, text())]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (df, df.repartition(5)):
        got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
        one = next(t for i, t in got if i is None and t in (d, near(d)))  # of null ids, either
        assert got == Counter([(3, a), (7, b), (None, c), (None, one), (5, e), (4, near(f)), rows[-1]])
