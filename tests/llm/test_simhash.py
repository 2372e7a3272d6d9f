import itertools

import numpy as np
from xxhash import xxh64_intdigest

from logdistill.llm import simhash


def brute(rows):
    prints = []
    for _, text in rows:
        ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        shingles = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
        hs = [xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return prints, labels([r[0] for r in rows], prints)


def labels(ids, prints):
    group = list(range(len(ids)))
    for i, j in itertools.combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    return [min((ids[k] for k in range(len(ids)) if group[k] == g and ids[k] is not None), default=None) for g in group]


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(100_001, None), (100_002, ""), (100_003, "one two"), (100_004, "ONE  two"), (None, "one two")]
    rows += [(rows[5][0], rows[5][1]), (100_005, rows[7][1]), (100_006, "Ä b c d " * 9000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, fp string, component string")
    prints, comps = brute(rows)
    want = sorted((str(r[0]), f"{p:016x}", str(c)) for r, p, c in zip(rows, prints, comps, strict=True))
    got = sorted((str(r[0]), r[1], str(r[2])) for r in simhash.report(df).collect())
    assert got == want


def test_dense_cluster_in_chunks(spark):
    """Random walks of close fingerprints and lone ones; small chunks, several thresholds."""
    rng = np.random.default_rng(7)
    prints = [int(x) for x in rng.integers(0, 2**63, 60)]
    center = prints[0]
    for _ in range(300):
        center ^= 1 << int(rng.integers(0, 64)) ^ (1 << int(rng.integers(0, 64)))
        prints.append(center)
    prints = sorted({p & (2**63 - 1) for p in prints})
    nodes = spark.createDataFrame([(p, p) for p in prints], "fp long, least long")
    want = labels(prints, prints)
    for parts in (3, 4, 5):
        edges = [(r["a"], r["b"]) for r in simhash.links(nodes, parts=parts, chunk=16).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in edges)
        root = {p: p for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert [find(p) for p in prints] == want


def test_thresholds_sum_and_prefer_even_parts():
    rng = np.random.default_rng(1)
    even = np.bincount(rng.integers(0, 256, 5000), minlength=256)
    hot = np.zeros(256, int)
    hot[3] = 5000
    got = simhash.thresholds([even, hot, even, even], [8] * 4)
    assert sum(got) == 0 and got[1] == -1


def test_empty_and_stage(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert simhash.report(empty).count() == 0
    docs = spark.createDataFrame(
        [(3, "a b c d e", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "y"), (9, "other words are here", "z")],
        "doc_id long, text string, lang string",
    )
    assert sorted(tuple(r) for r in simhash.deduplicated(docs).collect()) == [
        (1, "a b c d e", "y"), (9, "other words are here", "z"),
    ]
