from logdistill.llm import templates

ITEM = "A train leaves Paris at 12 km speed and later Anna walks 30 minutes to the market with Bob and Anna again"


def verdicts(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, h string, pattern string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"] for r in templates.contaminated(d, b, **options).collect()}, d, b


def test_reparameterised_questions(spark):
    filler = "lorem ipsum dolor sit amet " * 50
    other = ITEM.replace("Paris", "Rome").replace("12", "4,500").replace("Anna", "Eve").replace("30", "7")
    broken = ITEM.replace("Anna walks", "Eve walks").replace("minutes", "hours")
    broken = " ".join(broken.split()[8:])  # only windows that hold both of the names
    docs = [
        (1, filler + ITEM + " " + filler, "", ""),
        (2, filler + other, "", ""),
        (3, ITEM.upper(), "", ""),
        (4, filler, "", ""),
        (5, None, "", ""),
        (6, "", "", ""),
        (7, " ".join(ITEM.split()[:12]), "", ""),
        (None, other.replace(" ", "\n\t "), "", ""),
        (1, filler, "", ""),
        (8, "Short item of five words.", "", ""),
        (9, "12 13 14 15 16 17 18 19 20 21 22 23 24 25 26", "", ""),
    ]
    items = [(10, ITEM), (11, None), (12, ""), (13, "short item of FIVE words"), (14, "1 2 3 4 5 6 7 8 9 10 11 12 13 14")]
    for limit in (templates.INDEX_LIMIT, 0):  # index in the tasks, or all windows joined
        got, d, b = verdicts(spark, docs, items, limit=limit)
        assert got == {1, 2, 3, None, 8}
    kept = templates.clean(d, b)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7, 9]
    got, _, _ = verdicts(spark, [(1, broken, "", "")], [(10, ITEM)])
    assert got == set()


def test_planted_items_in_given_tables(spark, sf_dir):
    """Brute force: any thirteen plain words of an item in a row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")

    def norm(t):
        return [w.strip(".,;:!?").lower() for w in (t or "").split()]

    grams = set()
    for r in bench.collect():
        ws = norm(r["text"])
        grams |= {tuple(ws[i : i + 13]) for i in range(len(ws) - 12)}
    want = set()
    for r in docs.collect():
        ws = norm(r["text"])
        if any(tuple(ws[i : i + 13]) in grams for i in range(len(ws) - 12)):
            want.add(r["doc_id"])
    rows = templates.report(docs, bench).collect()
    got = {r["doc_id"] for r in rows if r["contaminated"]}
    assert len(rows) == docs.select("doc_id").distinct().count()
    assert want and want <= got
    assert len(got - want) <= 2  # short items, matched whole


def test_empty(spark):
    got, d, b = verdicts(spark, [], [])
    assert got == set() and templates.report(d, b).count() == 0
