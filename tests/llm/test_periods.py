"""Periodic runs against a plain scan of every lag of every text."""

import hashlib
import random
import zlib

import numpy as np

from logdistill.llm import periods
from logdistill.llm.queries import REGISTRY


def brute(ws, least=24, times=3):
    """(start, length, period) of all runs, by start, then period."""
    n, seen, out = len(ws), set(), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(text):
    return (text or "").encode().split()


def looped(doc_id, text):
    ws = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(ws)
    if h % 10 or not n:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def expected(doc_id, ws):
    found = brute(ws)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for s, n, q in found:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest(),
    )


def test_words_of_few_letters():
    rng = random.Random(11)
    texts = []
    for _ in range(400):
        letters = [bytes([97 + i]) for i in range(rng.choice([1, 2, 3, 8]))]
        ws = [rng.choice(letters) for _ in range(rng.randrange(160))]
        for _ in range(rng.randrange(3)):  # loops, some of them inside loops
            at, p = rng.randrange(len(ws) + 1), rng.randrange(1, 40)
            ws[at:at] = (ws[at : at + p] or [b"z"]) * rng.randrange(2, 9)
        texts.append(ws)
    for least, times in ((24, 3), (6, 3), (10, 4)):
        got = periods.runs_of(texts, least, times)
        for ws, found in zip(texts, got, strict=True):
            assert [tuple(r) for r in found.tolist()] == brute(ws, least, times)
    assert sum(map(len, got)) > 300


def test_fibonacci_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 1500:
        a, b = b, b + a
    got = periods.runs_of([b, [b"x"] * 3000, b[::-1]])
    assert [tuple(r) for r in got[0].tolist()] == brute(b)
    assert got[1].tolist() == [[0, 3000, 1]]
    assert [tuple(r) for r in got[2].tolist()] == brute(b[::-1])


def test_splits_keep_runs_whole():
    """Rare words inside a segment split it again and again."""
    code, rows = [], []
    for k in range(40):
        code += [k, k, 1000 + k % 20]
    starts, ends = periods.split(np.array(code), np.zeros(len(code), np.int64), 6, 3)
    assert not len(starts)
    for k in range(5):
        rows += [2000 + k] + [1, 2, 3] * 10
    starts, ends = periods.split(np.array(rows), np.zeros(len(rows), np.int64), 24, 3)
    assert sorted(zip(starts.tolist(), ends.tolist(), strict=True)) == [(31 * k + 1, 31 * k + 31) for k in range(5)]


def test_work_grows_with_the_text():
    """A long text of one word and one of a long loop: rows scanned stay near n log n."""
    for ws in ([b"x"] * 100_000, [f"w{i % 30_000}".encode() for i in range(100_000)]):
        (found,) = periods.runs_of([ws])
        assert found.tolist() == [[0, 100_000, 1 if ws[1] == b"x" else 30_000]]


def test_query_on_given_tables(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [expected(i, looped(i, t)) for i, t in rows]
    got = [tuple(r) for r in REGISTRY["op13_periodic_runs"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 10


def test_odd_rows(spark):
    loop = "a  b\tc\n" * 9
    rows = [
        (1, None, "x", 1), (2, "", "y", 2), (None, loop, None, 3), (4, loop, "r", 4), (4, loop, "r", 4),
        (5, "Ä é ß " * 30, "s", 5), (6, "one two", None, None), (7, "go on " * 20_000 + "end", "t", 7),
    ]
    schema = "doc_id long, text string, runs string, `a.row` int"
    df = spark.createDataFrame(rows, schema)
    got = {str(r["row"]["doc_id"]): r for r in periods.runs(df).collect()}
    assert [tuple(r) for r in got["None"]["runs"]] == [(0, 27, 3)] and got["None"]["collapsed"] == "a b c"
    assert [tuple(r) for r in got["5"]["runs"]] == [(0, 60, 2)]
    assert [tuple(r) for r in got["7"]["runs"]] == [(0, 40_000, 2)] and got["7"]["collapsed"] == "go on end"
    assert got["1"]["runs"] == got["2"]["runs"] == got["6"]["runs"] == []
    short = periods.collapsed(df)
    assert short.schema == df.schema
    assert sorted(str(r["text"]) for r in short.collect()) == sorted(
        ["None", "", "a b c", "a b c", "a b c", "Ä é ß", "one two", "go on end"]
    )
    assert sorted(str(tuple(r)) for r in periods.report(df).collect() if r["doc_id"] != 7) == sorted(
        str(expected(r[0], words(r[1]))) for r in rows if r[0] != 7
    )
    empty = spark.createDataFrame([], schema)
    assert periods.report(periods.looped(empty)).count() == 0 == periods.collapsed(empty).count()


def test_ties(spark):
    ws = ["a"] * 24 + ["m"] + ["b"] * 24 + ["n"] + ["c", "d"] * 24
    df = spark.createDataFrame([(1, " ".join(ws))], "doc_id long, text string")
    (r,) = periods.report(df).collect()
    assert (r["n_runs"], r["start"], r["length"], r["period"]) == (3, 0, 24, 1)
    assert r["exponent_milli"] == 24_000
