"""The pipeline against brute force, stage by stage on what the one before kept."""

from collections import Counter

import corpus_pipeline
from logdistill.llm import quality, templates
from tests.llm.test_mixing import targets
from tests.llm.test_simhash import brute
from tests.llm.test_small_operators import expected_spans


def test_stages_on_given_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, states = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
        states.append(docs.collect())
        if name != "source mix":
            assert docs.columns == columns
    all_, good, single, clean, safe, mix = states
    verdict = {r["doc_id"]: r["kept"] for r in quality.report(spark.createDataFrame(all_)).collect()}
    assert sorted(r["doc_id"] for r in good) == sorted(i for i, ok in verdict.items() if ok)
    _, group = brute([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in single) == sorted(set(group))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = {r["doc_id"] for r in templates.contaminated(spark.createDataFrame(single), bench).collect()}
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in single if r["doc_id"] not in hit)
    before = {r["doc_id"]: r["text"] for r in clean}
    assert len(safe) == len(clean)
    for r in safe:
        same = r["text"] == before[r["doc_id"]]
        assert same == (not expected_spans(before[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    sizes, largest = Counter(), Counter()
    for r in safe:
        sizes[r["source"]] += len(r["text"].split())
        largest[r["source"]] = max(largest[r["source"]], len(r["text"].split()))
    want, got = targets(dict(sizes)), Counter()
    for r in mix:
        got[r["source"]] += r["copies"] * r["size"]
        assert 1 <= r["copies"] <= 3
    assert all(abs(got[s] - t) <= largest[s] for s, t in want.items())


def test_odd_documents(spark, tmp_path):
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    text = "the cat of the house is on the mat and it was seen by all who came to look at it in the rain"
    rows = [(1, text, "en", None, 3, "x"), (1, text, "en", None, 3, "x"), (2, None, None, None, None, None), (None, text + " again", "en", "s", 1, "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert sorted(str(r["doc_id"]) for r in docs.collect()) in ([], ["1"], ["1", "None"])
