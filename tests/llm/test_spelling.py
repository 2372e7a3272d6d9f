"""Spelling variants against a dictionary of deletions."""

import itertools
import random
import re
import zlib
from collections import Counter

from logdistill.llm import spelling
from logdistill.llm.queries import REGISTRY

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def is_near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def expected(n):
    by_gap, around = {}, {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            by_gap.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    for gap, some in by_gap.items():
        some = some | ({gap} & n.keys())
        for u, v in itertools.combinations(some, 2):
            if is_near(u, v):
                around[u].add(v)
                around[v].add(u)
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n.get(form[w])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


def test_query_on_given_tables(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = expected(counted(rows))
    assert rows_of(REGISTRY["op11_spelling_variants"](spark, sf_dir)) == want
    assert any(w[1] for w in want)


def test_dense_words_and_split_partitions(spark):
    """Few letters, many repeats and both ends alike; tiny partitions are split to single letters."""
    rng = random.Random(4)
    n = {"".join(rng.choice("ab") for _ in range(rng.choice([7, 7, 8, 9]))): rng.randint(2, 3000) for _ in range(500)}
    n |= {"xxxxxxxxxx" + "".join(rng.choice("xyz") for _ in range(5)) + "xxxxxx": rng.randint(2, 90) for _ in range(150)}
    n |= {"é" * k: 2 * 12**k // 12**7 for k in range(7, 13)}
    words = spark.createDataFrame(sorted(n.items()), "word string, n long")
    want = expected(n)
    assert max(w[4] for w in want) > 10 and any(w[1] not in (None, w[2]) for w in want)
    for limit in (4, 5_000):
        assert rows_of(spelling.variants(words, limit=limit)) == want


def test_partitions_are_bounded(spark):
    n = [(f"{'a' * 20}{x}{y}{z}", 2) for x, y, z in itertools.product("abcdefghij", repeat=3)]
    words = spark.createDataFrame(n, "word string, n long")
    sizes = [r["count"] for r in spelling.partitions(words, 40).groupBy("key").count().collect()]
    assert max(sizes) <= 40
    assert rows_of(spelling.variants(words, limit=40)) == expected(dict(n))


def test_machine():
    rng = random.Random(2)
    strings = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in range(150)})
    found = list(spelling.OneEdit(strings).pairs())
    assert len(found) == len({frozenset(p) for p in found})
    assert {frozenset(p) for p in found} == {frozenset(p) for p in itertools.combinations(strings, 2) if is_near(*p)}
    # all words of five letters out of three: six states, however many words
    full = ["".join(p) for p in itertools.product("abc", repeat=5)]
    a = spelling.Acceptor(full)
    seen, stack = {0}, [0]
    while stack:
        for state in a.arcs[stack.pop()].values():
            if state not in seen:
                seen.add(state)
                stack.append(state)
    assert len(seen) == 6


def test_odd_rows(spark):
    schema = "doc_id long, text string, word string, n string"
    rows = [
        (1, None, "a", "b"), (2, "", None, "c"), (None, "Straßen straßen STRAßEN strassen", "d", "e"),
        (3, "naïveté naïveté ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ àÀÀÀÀÀÀ àÀÀÀÀÀÀ " * 40, "f", "g"), (3, "naïvete naïvete", "h", "i"),
        (4, "short words; seven77letters " * 3, "j", None), (5, " ".join(("z" * 9_000, "z" * 9_001, "y" * 9_000, "y" * 8_000 + "x" + "y" * 999, "")) * 2, "k", "l"),
    ]
    want = expected(counted([r[:2] for r in rows]))
    assert rows_of(spelling.report(spark.createDataFrame(rows, schema))) == want
    assert spelling.report(spark.createDataFrame([], schema)).count() == 0


def test_ties(spark):
    n = [("wordsab", 100), ("wordsac", 100), ("wordsad", 10), ("wordsae", 9)]
    words = spark.createDataFrame(n, "word string, n long")
    assert rows_of(spelling.variants(words))[2:] == [
        ("wordsad", "wordsab", "wordsab", 10, 3, 100), ("wordsae", "wordsab", "wordsab", 9, 3, 100)
    ]
