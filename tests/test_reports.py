"""The published benchmark figures, from our generators and our summaries."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from logdistill.operators import benchmark as B
from logdistill.operators import prune as P
from logdistill.sources import corpora
from logdistill.sources.report import write_report


@pytest.fixture(scope="module")
def items(spark):
    return B.item_result(B.summarised(corpora.all_suites(spark)))


@pytest.fixture(scope="module")
def report(items):
    return B.suite_report(items)


def test_published_figures(report):
    got = {r.suite: r for r in report.collect()}
    assert {s: r.n_items for s, r in got.items()} == {"traceback": 10, "build": 7, "flood": 5, "mixed": 6}
    percent = {s: round(r.overall_compression * 100) for s, r in got.items()}
    assert percent == {"traceback": 93, "build": 91, "flood": 99, "mixed": 80}
    assert all(r.mean_fidelity == r.min_fidelity == 1.0 for r in got.values())


def test_published_totals(report):
    total = B.global_summary(report, B.suite_assertions(report)).first()
    assert total.total_naked_tokens == 66_158
    assert total.total_naked_tokens - total.total_pruned_tokens == 62_772
    assert round(total.global_compression, 2) == 0.95 and total.global_fidelity == 1.0
    assert total.passed is True


def test_assertions_fail_where_they_should(report):
    rows = B.suite_assertions(report, compression=0.85).collect()
    assert len(rows) == 20
    failed = {(r.suite, r.check) for r in rows if not r.passed}
    assert ("mixed", "overall_compression") in failed and ("flood", "overall_compression") not in failed


def test_no_signature_is_missing(spark):
    assert B.missing_signatures(B.summarised(corpora.all_suites(spark))).count() == 0


def test_percentiles_interpolate(spark):
    rng = random.Random(1)
    groups = {"many": [rng.choice([0.5, 0.5, rng.random(), -3 * rng.random()]) for _ in range(997)],
              "two": [0.1, 0.9], "one": [0.25], "same": [0.5] * 40}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r for r in B.percentiles(df, "k", "v", (0.1, 0.5, 0.9)).collect()}
    for k, vs in groups.items():
        for p in (10, 50, 90):
            vs = sorted(vs)
            at = p / 100 * (len(vs) - 1)
            lo = int(at)
            want = vs[lo] + (at - lo) * (vs[min(lo + 1, len(vs) - 1)] - vs[lo])
            assert got[k][f"p{p}"] == pytest.approx(want, abs=1e-12), (k, p)


def test_deviation_of_one_item_is_zero(spark, items):
    one = items.where("name = 'chained_2x'")
    assert B.suite_report(one).first().std_compression == 0.0
    ratios = [r.compression_ratio for r in items.where("suite = 'flood'").collect()]
    got = B.suite_report(items.where("suite = 'flood'")).first()
    assert got.std_compression == pytest.approx(statistics.stdev(ratios))


def test_needles(spark):
    needles = corpora.needle_corpus(spark)
    archive = needles.select("name", F.col("raw").alias("raw_content"))
    report = B.recall_report(B.recall_arms(needles, archive))
    r = report.first()
    assert (r.recovery_a, r.recovery_b, r.recovery_c) == (1.0, 0.0, 1.0)
    assert round(r.saving_c_vs_a, 1) == 0.8
    assert all(x.passed for x in B.recall_assertions(report).collect())
    lost = B.recall_arms(needles, archive.where("name != 'rust_span_note'"))
    assert not lost.where("name = 'rust_span_note' and arm = 'C'").first().needle_recovered


def test_report_is_written_as_json(spark, items, report, tmp_path):
    checks = B.suite_assertions(report)
    docs = B.suite_documents(report, checks)
    write_report(docs, items, str(tmp_path), B.global_summary(report, checks))
    rows = [json.loads(x) for f in (tmp_path / "suites").glob("*.json") for x in f.read_text().splitlines()]
    assert {r["suite"] for r in rows} == {"traceback", "build", "flood", "mixed"}
    assert all(r["passed"] and len(r["checks"]) == 5 for r in rows)
    assert spark.read.json(f"{tmp_path}/items").count() == 28


def test_ratio_floors(spark):
    """Floors per kind: 20 and 50 frames, a Rust wall of 8 x 4, a GCC wall of 5 x 6, a flood of 300."""
    tb = corpora.traceback_corpus(
        spark, [("traceback", 1, 15, "ValueError", "bad"), ("massive", 2, 46, "KeyError", "'k'")]
    )
    walls = corpora.build_corpus(spark, [("rust", 8, 4)], [("gcc", 5, 6)])
    floods = corpora.flood_corpus(spark, [("flood", 300, 3)])
    got = {
        r.name: r.compression_ratio
        for r in B.item_result(B.summarised(tb.unionByName(walls).unionByName(floods))).collect()
    }
    floors = {"traceback": 0.6, "massive": 0.8, "rust": 0.6, "gcc": 0.6, "flood": 0.8}
    assert {k: v for k, v in got.items() if k in floors and v < floors[k]} == {}
    assert set(floors) <= set(got)


class Shout(P.Pruner):
    name = "shout"

    def compress(self, c):
        return F.when(c.contains("!"), F.lit("!"))


def test_pruner_chain_goes_on_after_a_weak_summary(spark):
    weak = P.python_pruner(lambda t: True, lambda t: t[: len(t) * 9 // 10], "weak")
    broken = P.python_pruner(lambda t: True, lambda t: 1 / 0, "broken")
    df = spark.createDataFrame(
        [(1, "!\n" + "\n".join(f"line {i}" for i in range(40))), (2, "!"), (3, "\n".join(map(str, range(40))))],
        "id long, raw_content string",
    )
    for chain in ([Shout()], [weak, broken, Shout()]):
        got = {r.id: (r.was_pruned, r.pruner_name, r.compressed_summary) for r in P.prune(df, chain).collect()}
        assert got == {1: (True, "shout", "!"), 2: (False, None, ""), 3: (False, None, "")}
    assert not any(r.was_pruned for r in P.prune(df, [weak]).collect())
    assert not any(r.was_pruned for r in P.prune(df, []).collect())
    assert str(Shout()).startswith("shout v0.1.0")


def test_python_pruners_stop_at_the_first_hit(spark, tmp_path):
    def noted(t):
        with open(tmp_path / "seen", "a") as f:
            f.write(t[0])
        return True

    texts = [(i, f"{mark}\n" + "x\n" * 40) for i, mark in enumerate("aab")]
    df = spark.createDataFrame(texts, "id long, raw_content string").coalesce(1)
    first = P.python_pruner(lambda t: t[0] == "a", lambda t: "short", "first")
    second = P.python_pruner(noted, lambda t: "last", "second")
    got = {r.id: r.pruner_name for r in P.prune(df, [first, second]).collect()}
    assert got == {0: "first", 1: "first", 2: "second"}
    assert (tmp_path / "seen").read_text() == "b"


def test_injection(spark):
    df = spark.createDataFrame(
        [(42, "s", "s" * 8, 80, True), (None, "s", "s" * 8, 80, True), (7, "raw", "", 3, False)],
        "id long, raw_content string, compressed_summary string, line_count int, was_pruned boolean",
    )
    shown = lambda **k: [r.shown for r in P.render_injection(df, "LD", **k).collect()]
    s = "s" * 8
    assert shown(color=False) == [
        f"[LD] Compressed 80 lines → 1 lines  (recall: ld #42)\n{s}\n",
        f"[LD] Compressed 80 lines → 1 lines  (full log not archived)\n{s}\n", "raw",
    ]
    assert shown(color=False, hint="arch recall")[0].endswith("(full log: arch recall 42)\n" + s + "\n")
    assert shown(annotate=False)[0] == f"\x1b[36m{s}\x1b[0m\n"
