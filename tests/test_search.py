"""Stemming, postings and BM25 against brute force in plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from logdistill.functions.stem import MAX_REWRITTEN, porter
from logdistill.operators import search as S

# Published input/output pairs of the algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit",
    "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile",
    "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous",
    "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr",
    "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
    "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ",
    "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "is": "is", "yyb": "yyb", "connections": "connect", "timed": "time", "timeout": "timeout",
    "errors": "error", "x" * 65: "x" * 65,
}
DOCS = [
    (1, "s1", "Connection timed out, retrying the connection", "", "stdout"),
    (2, "s1", "connected to host 10.0.0.1", "retry table", "stdout"),
    (3, "s2", "card_token missing; token card", "", "stderr"),
    (4, "s2", "Card token: card token", "connection", "stdout"),
    (5, "s3", "nothing here at all", "", "stdout"),
    (6, "s3", "café CAFÉ naïve", "", "stdout"),
]


def python_stem(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    return {r.w: r.s for r in rows.select("w", porter(F.col("w")).alias("s")).collect()}


def test_porter(spark):
    assert python_stem(spark, STEMS) == STEMS


def test_stem_keeps_all_but_its_last_letters(spark, sf_dir):
    words = (
        spark.read.parquet(f"{sf_dir}/documents.parquet")
        .select(F.explode(S.tokens(F.col("text"))).alias("w")).distinct()
    )
    keep = F.greatest(F.length("s") - MAX_REWRITTEN, F.lit(1))
    bad = words.select("w", porter(F.col("w")).alias("s")).where(
        ~F.startswith(F.col("w"), F.substring("s", F.lit(1), keep))
    )
    assert bad.count() == 0


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(
        DOCS, "id long, session_id string, raw_content string, compressed_summary string, entry_type string"
    )


def brute(spark, leaves, holds):
    """Score every document with explicit loops."""
    docs = {d[0]: [[w for w in S._words(x)] for x in d[2:]] for d in DOCS}
    stems = python_stem(spark, sorted({w for cols in docs.values() for c in cols for w in c}
                                      | {w for p in leaves for w in p.words}))
    def tf(cols, p):
        n = 0
        for c in cols:
            for i in range(len(c) - len(p.words) + 1):
                ok = True
                for j, w in enumerate(p.words):
                    a, b = stems[c[i + j]], stems[w]
                    ok &= a.startswith(b) if p.prefix and j == len(p.words) - 1 else a == b
                n += ok
        return n
    size = {i: sum(map(len, cols)) for i, cols in docs.items()}
    avg = sum(size.values()) / len(size)
    out = {}
    for i, cols in docs.items():
        counts = [tf(cols, p) for p in leaves]
        if not holds(counts):
            continue
        score = 0.0
        for p, f in zip(leaves, counts):
            df = sum(tf(c, p) > 0 for c in docs.values())
            idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
            score += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[i] / avg))
        out[i] = round(-score, 9)
    return out


CASES = [
    (S.term("connect"), lambda c: c[0]),
    (S.term("CARD_TOKEN"), lambda c: c[0]),
    (S.phrase("token card"), lambda c: c[0]),
    (S.prefix("conn"), lambda c: c[0]),
    (S.prefix("card tok"), lambda c: c[0]),
    (S.any_of(S.term("retry"), S.term("token")), lambda c: c[0] or c[1]),
    (S.all_of(S.term("retry"), S.term("connections")), lambda c: c[0] and c[1]),
    (S.none_of(S.term("stdout"), S.term("connection")), lambda c: c[0] and not c[1]),
    (S.term("café"), lambda c: c[0]),
    (S.term("absent"), lambda c: c[0]),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_scores(spark, entries, i):
    expr, holds = CASES[i]
    expected = brute(spark, S._leaves(expr), holds)
    direct = S.rank_entries(entries, expr)
    assert {r.entry_id: round(r["rank"], 9) for r in direct.collect()} == expected
    indexed = S.rank_postings(S.build_postings(entries), S.document_lengths(entries), expr)
    assert {r.entry_id: round(r["rank"], 9) for r in indexed.collect()} == expected


def test_session_filter_keeps_whole_index_statistics(spark, entries):
    expr = S.term("connection")
    every = {r.id: r["rank"] for r in S.search_entries(entries, expr).collect()}
    mine = {r.id: r["rank"] for r in S.search_entries(entries, expr, session_id="s2").collect()}
    assert mine == {4: every[4]}
    assert [r.id for r in S.search_entries(entries, expr, limit=1).collect()] == [min(every, key=every.get)]


def test_written_index(spark, entries, tmp_path):
    S.write_index(entries, str(tmp_path))
    p, d = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("postings", "documents"))
    got = S.search(p, d, entries, S.term("token"), limit=5)
    assert {r.id for r in got.collect()} == {3, 4}
    assert {r.id for r in S.search(p, d, entries, S.term("token"), session_id="s1").collect()} == set()
    counts = S._counts_in_postings(p, S._leaves(S.term("token")))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,token)" in plan


def test_words_of_separators_only_find_nothing(spark):
    entries = spark.createDataFrame(
        [(1, "a -- b", "", "s", "stdout")],
        "id long, raw_content string, compressed_summary string, session_id string, entry_type string",
    )
    assert S.search_entries(entries, S.term("--")).count() == 0


def _scanned(df):
    """Rows that the scan of a plan without adaptive execution gave to Spark."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "RANGES", 8)


def _stored(spark, path, rows, commits=2):
    """An index of ``rows(id, text)`` in several commits, with maxima."""
    entries = spark.createDataFrame(
        [(i, t, "", "stdout") for i, t in rows], "id long, raw_content string, compressed_summary string, entry_type string"
    )
    for c in range(commits):
        S.write_index(entries.where(F.col("id") % commits == c), path, commit=str(c))
        S.write_maxima(spark, path, str(c))


def _texts(n):
    """One frequent word; its count and the length of the text rise only here and there."""
    return [
        (i, " ".join(["error"] * (1 + 5 * (i % 331 == 7)) + ["line"] * (i % 3) + (["disk"] if i % 50 == 0 else []) + ["pad"] * 9))
        for i in range(1, n + 1)
    ]


def test_best_entries_by_maxima_are_those_of_the_full_ranking(spark, tmp_path, small_blocks):
    path, error, disk, line = str(tmp_path), S.term("errors"), S.term("disk"), S.term("line")
    _stored(spark, path, _texts(700))

    def compare(*exprs, limit=20):
        for e in exprs:
            want = S.top(S.rank_postings(*S.read_index(spark, path), e), limit).collect()
            got = S.top_entries(spark, path, e, limit).collect()
            assert [r.entry_id for r in got] == [r.entry_id for r in want], e
            assert [r.rank for r in got] == pytest.approx([r.rank for r in want])

    compare(S.any_of(error, disk), S.all_of(error, disk), S.none_of(error, line))
    compare(S.all_of(disk, S.term("absent")), S.phrase("error line"))
    # the best ones and an id that was never there go; what they held no longer counts
    gone = spark.createDataFrame([(7,), (338,), (50,), (10**6,)], "id long")
    gone.write.parquet(f"{path}/deleted/commit=x")
    compare(S.any_of(error, disk), limit=2)


def test_postings_of_weak_blocks_are_not_read(spark, tmp_path, small_blocks):
    path, error = str(tmp_path), S.term("error")
    _stored(spark, path, _texts(1500), commits=1)
    ranges, _ = S.best_ranges(spark, path, error, 3)
    # matches lie in five of 94 blocks
    assert len(ranges) <= 5 and sum(b - a + 1 for a, b in ranges) <= 5
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = spark.read.parquet(f"{path}/postings").where("term = 'error'").select("entry_id", "tf")
        assert _scanned(read.where(S._in_ranges(ranges))) < _scanned(read) / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_maxima_of_an_empty_index(spark, tmp_path, small_blocks):
    _stored(spark, str(tmp_path), [], commits=1)
    assert S.top_entries(spark, str(tmp_path), S.term("error")).collect() == []


def test_words_are_stemmed_once_per_entry(spark, monkeypatch):
    """Counts by entry are those of the index, and repeated words go through one stem each."""
    rows = [(1, "timed out, TIMED  out " * 40, "a"), (2, "warnings warning out timed", "warned"), (3, None, ""), (4, "", None), (1, "out", "b")]
    entries = spark.createDataFrame(rows, "id long, raw_content string, entry_type string")
    columns = ("raw_content", "entry_type")
    leaves = [S.term("WARNINGS"), S.phrase("timed out"), S.prefix("warn")]
    grouped = []
    real = S._stemmed
    monkeypatch.setattr(S, "_stemmed", lambda tagged: grouped.append(1) or real(tagged))
    got = S._counts_in_entries(entries, leaves, columns).select("entry_id", "doc_len", "c0", "c1", "c2")
    assert grouped == [1]
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 2, 0, 0, 0), (1, 161, 0, 80, 0), (2, 5, 3, 0, 3), (3, 0, 0, 0, 0), (4, 0, 0, 0, 0)
    ]


def test_postings_of_a_task_stem_each_different_word_once(monkeypatch):
    import pyarrow as pa

    from logdistill.functions import words

    seen = []
    plain = words.porter_word
    monkeypatch.setattr(words, "porter_word", lambda w: seen.append(w) or plain(w))
    monkeypatch.setattr(words, "SLICE_BYTES", 64)
    texts = ["Connections timed out, connection", None, "", "timed TIMED connections"] * 50
    schema = pa.schema(
        [("term", pa.string()), ("entry_id", pa.int64()), ("doc_len", pa.int64()), ("tf", pa.int32()),
         ("positions", pa.list_(pa.int32()))]
    )
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts), pa.array(["out"] * 200)], ["id", "a", "b"])
    out = [r for b in words.postings_of(schema, lengths=True)(iter([batch])) for r in b.to_pylist()]
    assert sorted(seen) == ["connection", "connections", "out", "timed"]
    first = {r["term"]: (r["doc_len"], r["tf"], r["positions"]) for r in out if r["entry_id"] == 0}
    assert first == {
        "connect": (5, 2, [0, 3]), "time": (5, 1, [1]), "out": (5, 2, [2, 5]), None: (5, 0, []),
    }
    assert {r["entry_id"]: r["doc_len"] for r in out if r["term"] is None} == {
        i: (5, 1, 1, 4)[i % 4] for i in range(200)
    }


def test_postings_are_those_of_the_column_expressions(spark, sf_dir):
    from logdistill.functions.words import porter_word

    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang")
    odd = spark.createDataFrame(
        [(1, "éed éing at ed yyb Hopping", "ties"), (None, None, None), (1, " --", ""), (2, "a..b", "x\x85ed")],
        texts.schema,
    )
    for entries in (texts, odd):
        columns = ("text", "lang")
        words = entries.select(F.explode(S.tokens(F.concat_ws(" ", *columns))).alias("w")).distinct()
        for r in words.select("w", porter(F.col("w")).alias("s")).collect():
            assert porter_word(r.w) == r.s
        tagged = S._tagged(S._all_tokens(columns))
        old = entries.select("id", F.explode(S.runs(F.array_sort(S._stemmed(tagged)))).alias("p"))
        new = S.build_postings(entries, columns)
        assert sorted(map(repr, old.select("id", "p.key", "p.n", "p.at").collect())) == sorted(
            repr(r).replace("entry_id=", "id=").replace("term=", "key=").replace("tf=", "n=").replace("positions=", "at=")
            for r in new.select("entry_id", "term", "tf", "positions").collect()
        )
        lengths = S.document_lengths(entries, columns).collect()
        size = entries.select("id", (F.size(S._all_tokens(columns)) - 2).alias("n")).collect()
        assert sorted(map(repr, [tuple(r) for r in lengths])) == sorted(map(repr, [tuple(r) for r in size]))
