import hashlib
import random

from logdistill.llm import repeats


def brute(rows):
    first = {}
    split = [(t or "").encode().split() for _, t in rows]
    for (i, _), ws in zip(rows, split, strict=True):
        for k in range(len(ws) - 12):
            win = tuple(ws[k : k + 13])
            first[win] = min(first.get(win, repeats.LAST), repeats.LAST if i is None else i)
    out = []
    for (i, _), ws in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(ws) - 12):
            if first[tuple(ws[k : k + 13])] < (repeats.LAST if i is None else i):
                gone |= set(range(k, k + 13))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((str(i), len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", b"y") for r in rows], "doc_id long, text string, block string, data binary")


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in repeats.report(df).collect())


def test_passages_across_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats.blocks, "__defaults__", (2_000,))
    monkeypatch.setattr(repeats, "AUTOMATON_WORDS", 60)
    rng = random.Random(3)
    word = [f"w{k}" for k in range(40)]

    def text(n):
        return [rng.choice(word) for _ in range(n)]

    shared = [text(n) for n in (12, 13, 14, 30, 200)]
    rows = []
    for i in rng.sample(range(1000), 160):
        ws = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(0, max(1, len(p) - 12))
            ws += p[a : a + rng.randrange(12, 60)] + text(rng.randrange(0, 5))
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(ws)))
    rows += [(5000, None), (5001, ""), (None, rows[3][1]), (None, rows[4][1]), rows[7], rows[7]]
    rows += [(5002, "same " * 400), (5003, "same " * 14), (-4, "the same " * 30)]
    assert got(table(spark, rows)) == brute(rows)


def test_texts_and_empty_table(spark):
    rows = [(1, " ".join("abcdefghijklmn")), (2, "x " + " ".join("abcdefghijklm") + " y")]
    kept = {r["doc_id"]: r["kept"] for r in repeats.removed(table(spark, rows)).collect()}
    assert kept == {1: " ".join("abcdefghijklmn"), 2: "x y"}
    assert repeats.report(table(spark, [])).count() == 0
