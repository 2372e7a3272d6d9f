import re

import numpy as np
import pytest

from logdistill.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size long, src string"


def targets(sizes, weights=(1, 2, 3)):
    """Shares by weight, the excess over three times a source dealt again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, heavy = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / heavy for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check(spark, docs, tolerance=1):
    size = {}
    for i, t, s in docs.select("doc_id", "text", "source").collect():
        n = len(WORD.findall(t or ""))
        size.setdefault(s, []).append((i, n))
    want = targets({s: sum(n for _, n in v) for s, v in size.items()})
    source = {i: s for s, v in size.items() for i, _ in v}
    rows = mixing.report(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(i), n) for v in size.values() for i, n in v)
    taken = dict.fromkeys(want, 0)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sum(n for _, n in size[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= tolerance, s
    again = sorted((str(r["doc_id"]), r["taken"]) for r in mixing.report(docs).collect())
    assert again == sorted((str(r["doc_id"]), r["taken"]) for r in rows)


def test_given_documents(spark, sf_dir):
    # ten documents a source: few sums can be met to the word
    check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tolerance=60)


def test_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(i, "w " * (i % 7 + 1), "a", 1, "x") for i in range(300)]
    rows += [(1000 + i, "w w w", None, None, None) for i in range(400)]
    rows += [(2000, None, "empty", 0, ""), (2001, "  \n", "empty", 0, ""), (2002, "x " * 9000, "é", 2, "")]
    rows += [(2003, "one", "", 2, ""), (2004, "two two", "=a", 2, ""), (2005, "three", "null", 2, "")]
    check(spark, spark.createDataFrame(rows, SCHEMA), tolerance=9000)
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.mixture(docs)
    assert set(docs.columns) <= set(mix.columns) and mix.where("copies < 1 or copies > 3").count() == 0


def test_empty_and_repeated(spark):
    assert mixing.report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c", "s", 1, "")] * 3 + [(None, "a", "s", 1, "")]
    got = mixing.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["taken"] for r in got) == 10 and len(got) == 4
    assert mixing.report(spark.createDataFrame([(1, None, None, 1, "")], SCHEMA)).first()["taken"] == 0


def test_fill_meets_the_budget():
    rng = np.random.default_rng(4)
    for _ in range(40):
        lengths = np.unique(rng.integers(0, 60, rng.integers(1, 12)))
        counts = rng.integers(1, 30, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        for words in (16, 65_536):
            got = mixing.fill(lengths, counts, budget, words)
            assert (got >= 0).all() and (got <= counts).all()
            total = int((got * lengths).sum())
            assert total <= max(budget, 0)
            best = {0}
            for size, n in zip(lengths, counts, strict=True):
                best = {b + size * k for b in best for k in range(n + 1) if b + size * k <= budget}
            if words > 16 and (lengths * counts).sum() <= words:
                # the proportional part is kept, so the sum may miss the optimum by a little
                assert max(best) - total <= lengths.max()
