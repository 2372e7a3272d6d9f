"""MinHash near copies against exact similarity of all pairs."""

import itertools
import random

import numpy as np
import pytest

from logdistill.llm import graph, minhash
from logdistill.llm.queries import REGISTRY

SCHEMA = "doc_id long, text string, node string"


def brute_sets(texts, n=3):
    out = []
    for text in texts:
        ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        out.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} or ({tuple(ws)} if ws else set()))
    return out


def groups(sets, percent=85):
    """Index of each set's group: equal and linked sets, never empty ones."""
    where, root = {}, list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    posting = {}
    for i, s in enumerate(sets):
        for x in s:
            posting.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in posting[x]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    del where
    return [find(i) for i in range(len(sets))]


def expected(rows):
    sets = brute_sets([r[1] for r in rows])
    of = groups(sets)
    least = {}
    for r, g in zip(rows, of, strict=True):
        least[g] = min((i for i in (least.get(g), r[0]) if i is not None), default=None)
    return sorted(str((r[0], len(s), least[g], r[0] == least[g])) for r, s, g in zip(rows, sets, of, strict=True))


def got(df):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in df.collect())


def edited(rng, words, share):
    return [f"n{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def test_query_on_given_tables(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(REGISTRY["op12_minhash_dedup"](spark, sf_dir)) == expected(rows)


def test_groups_near_the_threshold(spark):
    """Pairs on both sides of 0.85, chains, and a family whose members differ in part; whole and in small chunks."""
    rng = random.Random(3)
    rows, k = [], 0
    for _ in range(40):
        base = [f"w{rng.randrange(9000)}" for _ in range(rng.choice([40, 100, 400]))]
        for share in (0, rng.choice([0.01, 0.02, 0.03]), 0.03):
            rows.append((k, " ".join(edited(rng, base, share)), "x"))
            k += 1
    base = [f"w{i}" for i in range(200)]
    for i in range(120):  # a chain: neighbours are linked, ends are not
        rows.append((k + i, " ".join(base), "x"))
        base[rng.randrange(200)] = f"c{i}"
    family = [f"f{i}" for i in range(150)]
    rows += [(1000 + i, " ".join(edited(rng, family, 0.02)), "y") for i in range(150)]
    want = expected([r[:2] for r in rows])
    df = spark.createDataFrame(rows, SCHEMA)
    assert len({w.split(", ")[2] for w in want}) < len(rows) - 150
    assert got(minhash.report(df)) == want
    small = minhash.grouped(df, chunk=16)
    assert got(small.withColumn("kept", small["doc_id"] == small["component_id"])) == want


def test_buckets_hold_linked_pairs():
    """Of 2,000 drawn pairs at exactly 0.85, all share a band and pass by signature."""
    rng = np.random.default_rng(5)
    missed = failed = 0
    for _ in range(2_000):
        common = rng.integers(0, 2**63, 170, dtype=np.uint64)
        a, b = (np.r_[common, rng.integers(0, 2**63, 15, dtype=np.uint64)] for _ in range(2))
        sign = minhash.signatures(np.r_[a, b], np.array([0, len(a)]))
        missed += not (minhash.bands(sign[:1]) == minhash.bands(sign[1:])).any()
        failed += np.count_nonzero(sign[0] == sign[1]) < minhash.AGREE
    assert missed == failed == 0


def test_partners_and_forest():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(80)]
    label = rng.integers(0, 30, 80).tolist()
    pairs = [
        (i, j) for i, j in itertools.combinations(range(80), 2)
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))
    ]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    def joined(links):
        root.clear()
        for i, j in links:
            root[find(("g", label[i]))] = find(("g", label[j]))
        return [find(("g", x)) for x in label]

    def same(a):
        return [a.index(x) for x in a]

    assert same(joined(pairs)) == same(joined(minhash.forest(sets, label, 60)))
    sign = rng.integers(0, 3, (60, minhash.ROWS * minhash.BANDS)).astype(np.uint16)
    kind = rng.integers(0, 4, 60)
    want = [any(np.count_nonzero(sign[i] == sign[j]) >= 70 for j in range(60) if kind[i] != kind[j]) for i in range(60)]
    assert minhash.partnered(sign, kind, 70).tolist() == want


def test_odd_rows(spark):
    long = "so it goes on and on " * 30_000
    rows = [
        (1, None, "a"), (2, "", "b"), (3, " \t", None), (4, "one two", "c"), (5, "ONE  two", "d"), (5, "ONE  two", "d"),
        (None, "one two", "e"), (None, "lone words here now", "f"), (7, long, "g"), (8, long + "end", "h"), (8, "x y z w", "i"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(minhash.report(df)) == expected([r[:2] for r in rows])
    kept = minhash.deduplicated(df)
    assert kept.schema == df.schema
    assert sorted(str(r["node"]) for r in kept.collect()) == ["None", "a", "b", "c", "f", "g", "i"]
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.report(empty).count() == 0 == minhash.deduplicated(empty).count()


@pytest.mark.parametrize("share", [2, 400])
def test_components_with_hubs(spark, monkeypatch, share):
    monkeypatch.setattr(graph, "HUB_SHARE", share)
    monkeypatch.setattr(graph, "HUB_LEAST", 8 if share > 2 else 10**9)
    rng = random.Random(9)
    edges = [(1000, i) for i in range(300)] + [(rng.randrange(300, 999), 2000 + rng.randrange(400)) for _ in range(300)]
    edges += [(i, 5) for i in range(5000, 5200)] + [(i, i + 1) for i in range(6000, 6060)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root}
