import random

from logdistill.llm import tokens


def test_trees_against_full_encoding():
    enc = tokens.encoder()
    rng = random.Random(5)
    pieces = ["word", " ", "  ", "\n", "don't", "12,5", "é", "日本", "!!", " the", "\t", "x" * 40, " a b c d e f "]
    for _ in range(60):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 900)))
        tree = tokens.grow(text, enc, leaf=64)
        assert tree.total == len(enc.encode_ordinary(text))
        for _ in range(6):
            start, length = rng.randrange(0, len(text) + 5), rng.randrange(0, 30)
            put = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 5)))
            want = text[:start] + put + text[start + length :]
            text, tree, _, _ = tokens.apply_edit(tree, text, start, length, put, enc)
            assert text == want
            assert tree.total == len(enc.encode_ordinary(text)) == sum(tree.counts)
            assert tree.ends[-1] == len(text)
            assert all(tree.prefix(i) == sum(tree.counts[:i]) for i in range(len(tree.counts) + 1))


def test_one_edit_encodes_little():
    enc = tokens.encoder()
    text = "some plain words here " * 5000
    tree = tokens.grow(text, enc)
    _, tree, encoded, sums = tokens.apply_edit(tree, text, 50_000, 5, "other", enc)
    assert encoded < 4 * tokens.LEAF and sums < 64


def test_report_against_full_encoding(spark, sf_dir):
    enc = tokens.encoder()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame(
        [(-1, None, "x"), (-2, "", "x"), (None, "a b", "x"), (-3, "long " * 30_000, None), (-3, "long " * 30_000, None)],
        "doc_id long, text string, lang string",
    )
    docs = docs.unionByName(odd).withColumnRenamed("lang", "ends")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_tokens_edited"]) for r in tokens.report(docs).collect())
    want = []
    for r in docs.collect():
        text = r["text"] or ""
        n, i = len(text), "" if r["doc_id"] is None else str(r["doc_id"])
        new = text[: n // 2] + f" number {i}. " + text[n // 2 + 7 :]
        new = new[: n // 10] + new[n // 10 + 50 :]
        new = "Revised: " + new
        want.append((str(r["doc_id"]), len(enc.encode_ordinary(text)), len(enc.encode_ordinary(new))))
    assert got == sorted(want)
    assert tokens.report(docs.limit(0)).count() == 0


def test_edits_table(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "same")], "doc_id long, text string")
    edits = spark.createDataFrame(
        [(1, [(4, 3, "2"), (100, 5, "!"), (0, 0, None)])],
        "doc_id long, edits array<struct<start: int, length: int, put: string>>",
    )
    rows = {r["doc_id"]: r for r in tokens.edited(tokens.grown(docs), edits).collect()}
    assert rows[1]["text"] == "one 2 three!" and rows[2]["text"] == "same"
    assert rows[2]["n_encoded"] == 0 and rows[2]["n_tokens"] == rows[2]["n_before"]
