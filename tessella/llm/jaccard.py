"""Size-aware heavy-light join of documents whose word shingles reach a Jaccard similarity.

Equal sets are one class from the start. Light classes (few shingles) meet by enumerated subsets: a link leaves its
common part in both, so a bucket of equal subsets links without a comparison. Heavy classes scan inverted lists of
their prefixes: of n shingles the first n - ceil(t n) + 1 in an order that puts frequent ones last, one of which any
linked set shares. Which size is the last light one follows from the cost of both ways on the data. Classes of a list
are compared in blocks by parity sketches, which never rule out a link; what they connect is compared exactly, again
in blocks, and pairs that are connected already need no comparison: in a group of over a block, those linked with its
center are not compared with each other. Nothing is dropped or capped.

Null and empty texts, and those without words, have no shingles and link with nothing. Ids pass through, null ones too,
and may be of any type that has an order; they only name components, so rows that share an id, or have none, are each
decided by their own text. Sets are held as 64-bit hashes.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocked, chained, longs, mix, steps, stored, utf8, word_hashes, words
from .components import components, forest

#: Words in a shingle, and similarity in hundredths.
SHINGLE, PERCENT = 4, 85
#: Documents from which a shingle counts as frequent, and frequent shingles at most (they are broadcast).
FREQUENT, FREQUENT_MAX = 64, 1 << 22
#: Largest size that may be light, and what a place in an inverted list costs in subsets.
LIGHT_MAX, LIST_COST = 24, 4
#: Bits of a sketch at least, and classes in a block.
SKETCH, BLOCK = 512, 2048


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words than `size` is one shingle."""
    s, e = words(raw, at)
    h = word_hashes(raw, s, e)
    limits = np.searchsorted(s, at)
    grams = chained(h, size)
    out = []
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(chained(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def set_hash(x: np.ndarray) -> int:
    return int(mix(np.array([mix(x).sum(dtype=np.uint64) + np.uint64(len(x))], np.uint64)).view(np.int64)[0])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def spare(n: int, percent: int) -> int:
    """Shingles that a set of n may have beyond its common part with a linked set."""
    return n - -(-percent * n // 100)


def sketch(x: np.ndarray) -> bytes:
    """Parity of the shingles by hash: two sketches differ in no more bits than the sets differ in shingles.

    It has as many bits as shingles at least, a power of two, so unlike sets of any size differ in many. Its halves
    combine to the sketch of half the bits.
    """
    m = max(SKETCH, 1 << max(0, len(x) - 1).bit_length())
    bits = np.bincount(((x >> np.uint64(7)) % np.uint64(m)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def frequent(docs: DataFrame, size: int, threshold: int, most: int) -> np.ndarray:
    """Shingles that many documents have. Counts of one within a part of the data don't travel: the order need not be exact."""

    def run(batches):
        held, n = [], 0
        for batch in steps(batches, "text"):
            sets = shingle_sets(*utf8(batch.column("text")), size)
            held += sets
            n += sum(map(len, sets))
            if n > 1_500_000:
                yield from told(held, n)
                held, n = [], 0
        if held:
            yield from told(held, n)

    def told(held, n):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        some = counts > 1
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([longs(keys[some]), pa.nulls(1, pa.int64())]), pa.array(np.append(counts[some], n))], ["shingle", "n"])

    counts = stored(docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(f"shingle is null or n >= {threshold}"))
    total = counts.where("shingle is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = counts.where(F.col("shingle").isNotNull() & (F.col("n") >= max(threshold, -(-total // most)))).select("shingle").toPandas()
    return np.sort(kept["shingle"].to_numpy(np.int64).view(np.uint64))


def described(docs: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """(id, n, set, sketch, first): the set's hash, and its prefix, or for sets that may be light all of it."""
    kind = docs.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        often = sent.value
        for batch in steps(batches, "text"):
            sets = shingle_sets(*utf8(batch.column("text")), size)
            first = []
            whole = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            late = often[np.minimum(np.searchsorted(often, whole), len(often) - 1)] == whole if len(often) else np.zeros(len(whole), bool)
            at = 0
            for x in sets:
                n = len(x)
                own = late[at : at + n]
                at += n
                ordered = np.concatenate([x[~own], x[own]])
                first.append((ordered if n <= LIGHT_MAX else ordered[: prefix_size(n, percent)]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_hash(x) for x in sets], pa.int64()), pa.array([sketch(x) for x in sets], pa.binary()), pa.array(first, pa.binary())],
                ["id", "n", "set", "sketch", "first"],
            )

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n long, set long, sketch binary, first binary")


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The last light size, of least cost: subsets of the light sets against list places of the heavy ones."""

    def subsets(n):
        return sum(math.comb(n, k) for k in range(spare(n, percent) + 1))

    def price(last):
        return sum(c * (subsets(n) if n <= last else LIST_COST * prefix_size(n, percent)) for n, c in sizes.items() if n <= LIGHT_MAX)

    return min(range(1, LIGHT_MAX + 1), key=lambda last: (price(last), last))


def light_links(classes: DataFrame, last: int, percent: int) -> DataFrame:
    """(u, v): links among classes of up to `last` shingles, enough to connect all that are linked."""

    def enumerate_(batches):
        for batch in batches:
            keys, node, n, m = [], [], [], []
            for k, x in zip(batch.column("node").to_pylist(), batch.column("first").to_pylist(), strict=True):
                x = mix(np.frombuffer(x, np.uint64))
                total = x.sum(dtype=np.uint64)
                for gone in range(spare(len(x), percent) + 1):
                    picks = np.array(list(combinations(range(len(x)), gone)), int).reshape(math.comb(len(x), gone), gone)
                    sums = total - x[picks].sum(1, dtype=np.uint64)
                    keys.append(mix(sums + np.uint64(len(x) - gone)))
                    node.append(np.full(len(sums), k))
                    n.append(np.full(len(sums), len(x)))
                    m.append(np.full(len(sums), len(x) - gone))
            if keys:
                yield pa.RecordBatch.from_arrays([longs(np.concatenate(keys)), *[pa.array(np.concatenate(z).astype(np.int64)) for z in (node, n, m)]], ["key", "node", "n", "m"])

    subsets = classes.where(F.col("n").between(1, last)).select("node", "first").mapInArrow(enumerate_, "key long, node long, n long, m long")
    # the smallest set of a bucket links with every other that links at all, so each needs it alone
    center = stored(subsets.groupBy("key").agg(F.min(F.struct("n", "node")).alias("c"), F.max("node").alias("most"), F.min("node").alias("least")).where("most > least").select("key", F.col("c.n").alias("cn"), F.col("c.node").alias("v")))
    return subsets.join(center, "key").where((F.col("node") != F.col("v")) & (100 * F.col("m") >= percent * (F.col("n") + F.col("cn") - F.col("m")))).select(F.col("node").alias("u"), "v").distinct()


def listed(classes: DataFrame, least: int, percent: int, common: np.ndarray) -> DataFrame:
    """(list, node): classes that share a prefix shingle; lists of one smallest member are joined.

    Frequent shingles never meet in one task: their smallest members are found by a partial aggregation and, being as
    many as those shingles at most, sent to where the classes are. Other lists stream through a sorted partition.
    """
    often = classes.sparkSession.sparkContext.broadcast(common)

    def posted(batches):
        """Shingles and nodes of the prefixes, and whether the shingles are frequent."""
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                first = [np.frombuffer(x, np.uint64)[: prefix_size(n, percent)] for x, n in zip(part.column("first").to_pylist(), part.column("n").to_pylist(), strict=True)]
                key, node = np.concatenate(first), np.repeat(part.column("node").to_numpy(), [len(x) for x in first])
                at = np.minimum(np.searchsorted(often.value, key), max(0, len(often.value) - 1))
                yield key, node, at, often.value[at] == key if len(often.value) else np.zeros(len(key), bool)

    def rare(batches):
        for key, node, _, hot in posted(batches):
            yield pa.RecordBatch.from_arrays([longs(key[~hot]), pa.array(node[~hot])], ["shingle", "node"])

    def gather(batches):
        last, low = None, 0
        for batch in batches:
            key, node = batch.column("shingle").to_numpy(), batch.column("node").to_numpy()
            if not len(key):
                continue
            opens = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
            lows = np.concatenate([[low], node[opens]])[np.cumsum(opens)]  # nodes come in order: a list's first is its smallest
            last, low = key[-1], lows[-1]
            yield _pairs(lows[~opens], node[~opens])

    def lowest(batches):
        size = len(often.value)
        n, low = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
        for _, node, at, hot in posted(batches):
            np.add.at(n, at[hot], 1)
            np.minimum.at(low, at[hot], node[hot])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([longs(often.value[some]), pa.array(low[some]), pa.array(n[some])], ["shingle", "low", "n"])

    rows = classes.where(F.col("n") >= least).select("node", "n", "first")
    lists = rows.mapInArrow(rare, "shingle long, node long").repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(gather, "list long, node long")
    if len(common):
        found = rows.mapInArrow(lowest, "shingle long, low long, n long").groupBy("shingle").agg(F.min("low").alias("low"), F.sum("n").alias("n")).where("n > 1").toPandas()
        low = np.zeros(len(common), np.int64)
        shared = np.zeros(len(common), bool)
        at = np.searchsorted(common, found["shingle"].to_numpy(np.int64).view(np.uint64))
        low[at], shared[at] = found["low"].to_numpy(np.int64), True
        sent = classes.sparkSession.sparkContext.broadcast((low, shared))

        def named(batches):
            low, shared = sent.value
            for _, node, at, hot in posted(batches):
                hot[hot] = shared[at[hot]]
                yield _pairs(low[at[hot]], node[hot])

        lists = lists.unionByName(rows.mapInArrow(named, "list long, node long"))
    return lists.distinct()


def _pairs(low: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs of a list's name and a member, the one that it is named by among them."""
    pairs = np.unique(np.stack([np.concatenate([low, low]), np.concatenate([node, low])], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["list", "node"])


def _sketches(rows: list[bytes], bits: int) -> np.ndarray:
    """Sketches of `bits` bits or twice as many as rows of `bits`."""
    out = np.empty((len(rows), bits // 64), np.uint64)
    for k, row in enumerate(rows):
        x = np.frombuffer(row, np.uint64)
        out[k] = x if len(x) == bits // 64 else x[: len(x) // 2] ^ x[len(x) // 2 :]
    return out


def _near(n_a, a, n_b, b, percent):
    """Pairs of a block that sizes and sketches allow, with the bits they differ in; linked sizes are under twice each other."""
    bits_a, bits_b = (np.array([8 * len(x) for x in z], np.int64) for z in (a, b))
    for high in np.unique(np.concatenate([bits_a, bits_b])):
        for p, q in ((high, high), (high, high // 2), (high // 2, high)):
            at, bt = np.flatnonzero(bits_a == p), np.flatnonzero(bits_b == q)
            if not len(at) or not len(bt):
                continue
            x, y = _sketches([a[i] for i in at], min(p, q)), _sketches([b[i] for i in bt], min(p, q))
            nx, ny = n_a[at], n_b[bt]
            for k in range(0, len(at), 64):
                some = nx[k : k + 64, None]
                i, j = np.nonzero(100 * np.minimum(some, ny) >= percent * np.maximum(some, ny))
                width = max(1, (1 << 19) // x.shape[1])
                for s in range(0, len(i), width):
                    u, v = i[s : s + width] + k, j[s : s + width]
                    bits = np.bitwise_count(x[u] ^ y[v]).sum(1, dtype=np.int64)
                    good = (100 + percent) * bits <= (100 - percent) * (nx[u] + ny[v])
                    yield at[u[good]], bt[v[good]], bits[good]


def _block(block, key):
    """Rows of the block's two parts, nodes, sizes, sketches."""
    own, node, n = (block.column(c).to_numpy() for c in ("own", "node", "n"))
    order = np.lexsort((node, own))
    return [order[own[order] == k.as_py()] for k in key[-2:]], node, n, block.column("sketch").to_pylist()


def candidates(groups: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that connect all classes of a list that sizes and sketches allow."""

    def compare(key, block):
        (a, b), node, n, sk = _block(block, key)
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = []
        for p, q, _ in _near(n[a], [sk[i] for i in a], n[b], [sk[i] for i in b], percent):
            p, q = node[a[p]], node[b[q]]
            held.append((p[p != q], q[p != q]))
            if sum(len(x) for x, _ in held) > 500_000:
                held = [forest(*(np.concatenate(z) for z in zip(*held, strict=True)))]
        if held:
            u, v = forest(*(np.concatenate(z) for z in zip(*held, strict=True)))
        return pa.table({"u": u, "v": v})

    def near(n, sketch, others, shingles):
        return np.unique(np.concatenate([q for _, q, _ in _near(np.array([n]), [sketch], np.array([x for x, _ in others]), [x for _, x in others], percent)] or [np.zeros(0, int)]))

    return _in_blocks(groups, "list", compare, near)


def _in_blocks(groups: DataFrame, key: str, compare, near, load=None) -> DataFrame:
    """(u, v): links of all groups from `compare` on pairs of blocks; `load` adds what it needs to rows of groups.

    In groups of over a block, each member is first held against the one that the group is named by, its center. Those
    that `near` tells to be linked with it are linked with each other through it, so their blocks need not meet: a large
    group of copies takes time in proportion to its size, times the blocks of members that are far from its center.
    """
    counts = stored(groups.groupBy(key).agg(F.count("*").alias("n")))
    large = counts.where(F.col("n") > BLOCK).select(key)
    whole = load or (lambda rows: rows)
    if large.isEmpty():
        return blocked(whole(groups), key, "node", BLOCK, counts).groupBy(key, "i", "j").applyInArrow(compare, "u long, v long")
    rest = whole(groups.join(large, key, "left_anti"))
    groups = stored(whole(groups.join(large, key)))
    columns = groups.columns
    extra = "shingles" if "shingles" in columns else "sketch"
    center = groups.where(F.col("node") == F.col(key)).select(key, F.col("n").alias("_n"), F.col("sketch").alias("_sketch"), F.col(extra).alias("_extra"))

    def mark(batches):
        for batch in batches:
            keys = batch.column(key).to_numpy()
            loose = np.ones(batch.num_rows, bool)
            for k in np.unique(keys):
                rows = np.flatnonzero(keys == k)
                part = batch.take(pa.array(rows))
                others = list(zip(part.column("n").to_pylist(), part.column("sketch").to_pylist(), strict=True))
                first = part.slice(0, 1)
                loose[rows[near(first.column("_n")[0].as_py(), first.column("_sketch")[0].as_py(), others, (first.column("_extra")[0].as_py(), part.column(extra).to_pylist()))]] = False
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(loose)], [*columns, "loose"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.select(columns).schema)
    marked = stored(groups.join(center, key).mapInArrow(mark, f"{schema}, loose boolean"))
    stars = marked.where(~F.col("loose") & (F.col("node") != F.col(key))).select(F.col("node").alias("u"), F.col(key).alias("v"))
    pairs = blocked(marked, key, "node", BLOCK, loose="loose").drop("loose").unionByName(blocked(rest, key, "node", BLOCK, counts.where(F.col("n") <= BLOCK)))
    return pairs.groupBy(key, "i", "j").applyInArrow(compare, "u long, v long").unionByName(stars)


def verified(groups: DataFrame, load, percent: int) -> DataFrame:
    """(u, v): true links that connect all linked classes of a group, from rows (root, node, n, sketch); `load` adds shingles to rows."""

    def compare(key, block):
        (a, b), node, n, sk = _block(block, key)
        sets = block.column("shingles").to_pylist()
        near = [x for x in _near(n[a], [sk[i] for i in a], n[b], [sk[i] for i in b], percent)]
        p, q, bits = (np.concatenate(z) for z in zip(*near, strict=True)) if near else (np.zeros(0, int),) * 3
        order = np.argsort(bits, kind="stable")
        root = {}

        def find(x):
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        opened = {}

        def shingles(k):
            if k not in opened:
                opened[k] = np.frombuffer(sets[k], np.uint64)
            return opened[k]

        out = []
        for x, y in zip(a[p[order]].tolist(), b[q[order]].tolist(), strict=True):
            u, v = int(node[x]), int(node[y])
            if (r := find(u)) == (s := find(v)):
                continue
            both = np.concatenate([shingles(x), shingles(y)])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(both) - common):
                root[max(r, s)] = min(r, s)
                out.append((u, v))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    def near(n, sketch, others, shingles):
        center, sets = np.frombuffer(shingles[0], np.uint64), [np.frombuffer(x, np.uint64) for x in shingles[1]]
        common = np.array([np.isin(x, center, assume_unique=True).sum() for x in sets], np.int64)
        return np.flatnonzero(100 * common >= percent * (len(center) + np.array([len(x) for x in sets], np.int64) - common))

    return _in_blocks(groups, "root", compare, near, load)


#: Bits of the map that tells which documents take part in the exact comparison; others are only read more.
MAP_BITS = 26


def _marked(nodes: DataFrame) -> np.ndarray:
    """A bit map of fixed size with the bits of all values of `h` set."""
    h = F.pmod(F.col("h"), F.lit(1 << MAP_BITS))
    cells = nodes.select(F.call_function("shiftright", h, F.lit(5)).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), (h % 32).cast("int")).alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << MAP_BITS - 5, np.uint32)
    out[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64)
    return out


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, h, shingles) of documents whose id's hash h stands in `nodes` or shares a bit with one that does; a task gives a pair of node and h once."""
    sent = docs.sparkSession.sparkContext.broadcast(_marked(nodes))

    def run(batches):
        marks = sent.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            h = batch.column("h").to_numpy() % (1 << MAP_BITS)
            taken = (marks[h >> 5] >> (h & 31).astype(np.uint32)) & np.uint32(1)
            for part in steps(iter([batch.filter(pa.array(taken.astype(bool)))]), "text"):
                sets = shingle_sets(*utf8(part.column("text")), size)
                new = []
                for k, own in enumerate(zip(map(set_hash, sets), part.column("h").to_pylist(), strict=True)):
                    if own not in seen:
                        seen.add(own)
                        new.append((*own, sets[k].tobytes()))
                node, at, held = zip(*new, strict=True) if new else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(at, pa.int64()), pa.array(held, pa.binary())], ["node", "h", "shingles"])

    return docs.select("h", "text").mapInArrow(run, "node long, h long, shingles binary")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row; a component is what links reach, named by its smallest id that isn't null."""
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    common = frequent(docs, size, FREQUENT, FREQUENT_MAX)
    every = stored(described(docs, size, percent, common))
    # a class is a node by its set's hash; the row of the smallest h stands for it where its shingles are needed
    classes = stored(
        every.where("n > 0").withColumn("h", F.xxhash64("id")).groupBy(F.col("set").alias("node"))
        .agg(F.min("n").alias("n"), F.min("h").alias("h"), F.min("id").alias("least"), F.min(F.struct("sketch", "first")).alias("c")).select("node", "n", "h", "least", "c.sketch", "c.first")
    )
    sizes = {r["n"]: r["c"] for r in classes.where(F.col("n") <= LIGHT_MAX).groupBy("n").agg(F.count("*").alias("c")).collect()}
    last = boundary(sizes, percent)
    lists = stored(listed(classes, -(-percent * (last + 1) // 100), percent, common).join(classes.select("node", "n", "sketch"), "node"))
    roots = components(candidates(lists, percent))
    told = stored(roots.join(classes.select("node", "h", "n", "sketch"), "node"))

    def load(rows):
        return rows.join(sets_of(docs, rows, size).groupBy("node", "h").agg(F.first("shingles").alias("shingles")), ["node", "h"]).drop("h")

    found = stored(components(verified(told, load, percent).unionByName(light_links(classes, last, percent))).join(classes.select("node", "least"), "node"))
    names = found.groupBy("root").agg(F.min("least").alias("component_id"))
    ends = classes.select("node", "least").join(found.join(names, "root").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    rows = every.where("n > 0").select("id", "n", F.col("set").alias("node")).join(ends, "node").select("id", "n", "component_id")
    rows = rows.unionByName(every.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The op9 contract."""
    return join(docs)


#: Every pair of documents with a common shingle, compared.
ORACLE = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {SHINGLE} THEN [len(w) || ':' || array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' '))) END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM g),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT u, v FROM pairs WHERE 100 * common >= {PERCENT} * (n + m - common)),
e AS (SELECT u, v FROM linked UNION ALL SELECT v, u FROM linked),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
SELECT doc_id, len(g)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE a = doc_id) AS component_id FROM g"""
