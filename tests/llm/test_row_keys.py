"""Rows with null or repeated ids: only near copies, contaminated rows and unpicked rows go."""

from logdistill.llm import mixing, simhash, templates

ITEM = "the quick red train went along the old river to the far market at noon"
SCHEMA = "doc_id long, text string, source string"


def texts(df):
    return sorted(r["text"] for r in df.collect())


def test_null_and_repeated_ids(spark):
    own = [f"text {i} of words that no other row has {i * 7} {i + 100}" for i in range(40)]
    rows = [(None, t, "s") for t in own] + [(1, "one thing here entirely", "s"), (1, "another thing there altogether", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert texts(simhash.deduplicated(docs)) == sorted(r[1] for r in rows)
    tainted = spark.createDataFrame([*rows, (None, f"so {ITEM} it was", "s")], SCHEMA)
    bench = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    assert texts(templates.clean(tainted, bench)) == sorted(r[1] for r in rows)
    tainted = spark.createDataFrame([*rows, (1, f"so {ITEM} it was", "s")], SCHEMA)
    assert texts(templates.clean(tainted, bench)) == sorted(r[1] for r in rows)


def test_rows_that_agree_in_id_and_text(spark):
    rows = [(1, "a b c d e", None), (1, "a b c d e", "t"), (1, "a b c d e", "s"), (None, None, "x"), (None, "", "w")]
    for some in (rows, rows[::-1]):
        kept = simhash.deduplicated(spark.createDataFrame(some, SCHEMA)).collect()
        assert sorted(str(r["source"]) for r in kept) == ["s", "w"]


def test_mix_of_null_ids(spark):
    rows = [(None, f"n{i} a b c", "big") for i in range(60)] + [(2, f"r{i} a b c", "big") for i in range(20)]
    rows += [(3, "same text of five", "big")] * 5
    rows += [(100 + i, f"z{i} a", "small") for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for r in mixing.mixed(docs).collect():
        want[r["src"]] = want.get(r["src"], 0) + r["taken"]
    mix, got = mixing.mixture(docs).collect(), {}
    for r in mix:
        got["=" + r["source"]] = got.get("=" + r["source"], 0) + r["copies"] * r["size"]
    assert got == want
    assert 10 < len({r["text"] for r in mix if r["doc_id"] is None}) < 60
