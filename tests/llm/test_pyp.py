import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from logdistill.llm import pyp


def exact_mean_tables(c, h, d, theta):
    """Mean tables of one dish of c customers alone in its restaurant, by recursion."""
    ways = {1: 1.0}  # generalised Stirling numbers
    for n in range(1, c):
        fresh = Counter()
        for t, x in ways.items():
            fresh[t] += x * (n - d * t)
            fresh[t + 1] += x
        ways = fresh
    weight = {t: x * h**t * math.prod(theta + d * k for k in range(t)) for t, x in ways.items()}
    return sum(t * x for t, x in weight.items()) / sum(weight.values())


def test_gibbs_reaches_the_posterior():
    n = 4000
    for c, h in ((2, 0.3), (5, 0.2), (12, 0.6)):
        s = pyp.Seating(
            np.full(n, c), np.arange(n), np.full(n, h), n, np.random.default_rng(3), moves=400
        )
        mean, tables = s.sampled(200, 200)
        assert abs(mean.mean() - exact_mean_tables(c, h, pyp.DISCOUNT, pyp.STRENGTH)) < 0.05
        assert (s.sizes.sum() == n * c) and np.allclose(tables, mean)


def test_seats_add_up():
    rng = np.random.default_rng(0)
    c = rng.integers(1, 2000, 500)
    ctx = rng.integers(0, 20, 500)
    s = pyp.Seating(c, ctx, rng.random(500) * 0.1, 20, rng)
    s.sampled()
    assert s.sizes.sum() == c[c > 1].sum()
    assert (np.bincount(ctx, s.t, 20) == s.tables).all()
    tables = np.add.reduceat(s.sizes > 0, s.off)
    assert (tables == s.t[s.moving]).all()


def test_dishes_of_one_customer_take_no_room_in_a_move():
    n = 300_000
    c = np.ones(n, np.int64)
    c[::100] = 5
    s = pyp.Seating(c, np.arange(n) // 50, np.full(n, 1e-5), n // 50, np.random.default_rng(6))
    tracemalloc.start()
    s.move()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n  # less than one number a dish
    assert (s.tables == np.bincount(s.ctx, s.t)).all()


def exact_tables(c, x, d):
    """Mean and variance of t with weights x**t times the ways to seat c at t tables."""
    logs = pyp._log_ways(d, c)[c, 1 : c + 1] + math.log(x) * np.arange(1, c + 1)
    weight = np.exp(logs - logs.max())
    t, weight = np.arange(1, c + 1), weight / weight.sum()
    mean = (t * weight).sum()
    return mean, (t * t * weight).sum() - mean * mean


def test_every_customer_of_a_dish_is_moved():
    """Samples of a frequent dish spread as the posterior does, and leave the start behind."""
    n, c, h = 2000, 400, 0.3
    s = pyp.Seating(np.full(n, c), np.arange(n), np.full(n, h), n, np.random.default_rng(4))
    s.t[:] = 1
    s.tables = s.t.astype(float)
    s.sampled(20, 1)
    t = np.arange(1, c + 1)
    lgamma = np.vectorize(math.lgamma)
    logs = pyp._log_ways(pyp.DISCOUNT, c)[c, 1 : c + 1] + t * math.log(h * pyp.DISCOUNT)
    logs = logs + lgamma(pyp.STRENGTH / pyp.DISCOUNT + t)
    weight = np.exp(logs - logs.max())
    weight /= weight.sum()
    mean = (t * weight).sum()
    deviation = math.sqrt((t * t * weight).sum() - mean * mean)
    assert abs(s.t.mean() - mean) < 5 * deviation / math.sqrt(n)
    assert 0.9 < s.t.std() / deviation < 1.1


def test_more_customers_than_are_tabulated():
    for d in (pyp.DISCOUNT, pyp.PARENT_DISCOUNT):
        for x in (1e-9, 1e-3, 0.05, 0.5, 3.0, 30.0, 1000.0):
            n, c = 4000, 1500
            s = pyp.Seating(np.full(n, c), np.arange(n), np.full(n, 0.5), n, np.random.default_rng(5), d=d)
            got = s._many(np.full(n, float(c)), np.full(n, math.log(x)))
            mean, variance = exact_tables(c, x, d)
            assert abs(got.mean() - mean) < 5 * math.sqrt(variance / n) + 0.002 * mean, (d, x)
            assert abs(got.var() - variance) < 0.15 * variance + 0.05, (d, x)


def test_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(
        [(-1, None), (-2, ""), (None, "The THE the"), (-3, "zzzz-unseen " * 5), (-3, "zzzz-unseen " * 5)],
        "doc_id long, text string",
    )
    docs = docs.unionByName(odd).selectExpr("*", "1 as shard", "'x' as block")
    rows = docs.collect()
    token = {}
    for r in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        token.setdefault((r["doc_id"], r["text"]), [*low.encode().split(), None])

    def learns(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1

    count = Counter()
    for r in rows:
        if learns(r["doc_id"]):
            count.update(token[r["doc_id"], r["text"]])
    n, v = sum(count.values()), len(count)
    want = sorted(
        (
            str(r["doc_id"]), not learns(r["doc_id"]), len(ts), sum(count[t] > 0 for t in ts), n,
            round(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 5),
        )
        for r in rows
        for ts in [token[r["doc_id"], r["text"]]]
    )
    scored = pyp.scores(docs)
    got = scored.collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 5)) for r in got) == want
    again = sorted((str(r["doc_id"]), r["score"]) for r in pyp.scores(docs).collect())
    assert sorted((str(r["doc_id"]), r["score"]) for r in got) == again
    held = [r for r in pyp.perplexity(scored).collect() if r["held_out"]][0]
    assert held["perplexity"] < held["base_perplexity"]


def test_probabilities_sum_to_one(spark):
    """Texts of one word, held out, one for each known word and an unknown: p(word | start)."""
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1]
    words = [f"w{k}" for k in range(12)]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(words[min(int(x), 11)] for x in rng.geometric(0.3, 6) - 1)) for i in train]
    seen = sorted({w for _, t in rows for w in t.split()})
    probe = [*seen, "unseen-word"]
    rows += [(i, w) for i, w in zip(held, probe, strict=False)]
    got = {r["doc_id"]: r for r in pyp.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # p(word | start) * p(end | word) summed over words is below 1, p(end | word) is known from pairs
    total = sum(10 ** got[i]["score"] for i, _ in zip(held, probe, strict=False))
    assert 0 < total < 1


def test_empty(spark):
    assert pyp.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
