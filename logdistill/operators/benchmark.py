"""Reports: compression, signature fidelity and needle recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.arrays import bind
from ..functions.signatures import extract_signatures
from ..functions.steps import with_once
from ..shared import written
from .prune import OutputPruner, Pruner

# --- fixed values -----------------------------------------------------------
COMPRESSION, FIDELITY = 0.60, 0.95
P10_FLOOR, P10_SLACK = 0.30, 0.30
MIN_FLOOR, MIN_SLACK = 0.80, 0.15
TURNS = 8
ARMS = (("A", "keep-everything"), ("B", "prune-and-lose"), ("C", "prune-and-recall"))
# ----------------------------------------------------------------------------


def summarised(logs: DataFrame, pruner: Pruner | None = None) -> DataFrame:
    """Adds ``summary`` (null if none fits) to ``logs(name, text, …)``: no gates here."""
    return with_once(logs, "summary", (pruner or OutputPruner()).compress(F.col("text")))


def item_result(summaries: DataFrame) -> DataFrame:
    """Sizes, compression and fidelity per item of ``summarised``; one projection."""
    keys = [c for c in summaries.columns if c not in ("text", "summary")]
    shown = F.coalesce("summary", "text")
    counted = bind(
        extract_signatures(F.col("text")),
        lambda naked: F.struct(
            F.size(naked).cast("bigint").alias("naked_sigs"),
            F.size(F.array_intersect(naked, extract_signatures(shown)))
            .cast("bigint")
            .alias("preserved_sigs"),
        ),
    )
    sized = with_once(summaries, "_sigs", counted).select(
        *keys,
        F.length("text").cast("bigint").alias("naked_chars"),
        F.length(shown).cast("bigint").alias("proxied_chars"),
        text.token_estimate(F.col("text"), 1).alias("naked_tokens"),
        text.token_estimate(shown, 1).alias("proxied_tokens"),
        "_sigs.naked_sigs",
        "_sigs.preserved_sigs",
        F.col("summary").isNotNull().alias("pruner_fired"),
    )
    return sized.withColumns(
        {
            "compression_ratio": text.compression_ratio(
                F.col("naked_tokens"), F.col("proxied_tokens")
            ),
            "fidelity_ratio": F.when(
                F.col("naked_sigs") > 0, F.col("preserved_sigs") / F.col("naked_sigs")
            ).otherwise(1.0),
        }
    )


def missing_signatures(summaries: DataFrame) -> DataFrame:
    """One row per signature that a summary lost."""
    keys = [c for c in summaries.columns if c not in ("text", "summary")]
    lost = F.array_except(
        extract_signatures(F.col("text")),
        extract_signatures(F.coalesce("summary", "text")),
    )
    return summaries.select(*keys, F.explode(lost).alias("signature"))


def percentiles(
    df: DataFrame, key: str, value: str, ps: tuple[float, ...], width: float = 1e-4
) -> DataFrame:
    """Exact, linearly interpolated percentiles without one task seeing a whole group.

    Equal values are counted map-side; cumulative counts over bins of ``width``
    find the bins of the wanted ranks, and only those bins are ordered.
    """
    counts = (
        df.groupBy(key, F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin", F.floor(F.col("v") / width).cast("bigint"))
    )
    sizes = counts.groupBy(key, "bin").agg(F.sum("n").alias("m"))
    across = Window.partitionBy(key).orderBy("bin")
    placed = sizes.select(
        key,
        "bin",
        (F.sum("m").over(across) - F.col("m")).alias("lo"),
        F.sum("m").over(across).alias("hi"),
        F.sum("m").over(Window.partitionBy(key)).alias("total"),
    )
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("p"), F.lit(side).alias("side"), rank.alias("rank"),
                         (_place(p) - F.floor(_place(p))).alias("frac"))
                for i, p in enumerate(ps)
                for side, rank in enumerate(_ranks(p))
            ]
        )
    )
    targets = (
        placed.select("*", wanted.alias("w"))
        .where((F.col("w.rank") >= F.col("lo")) & (F.col("w.rank") < F.col("hi")))
        .select(key, "bin", "lo", "w.*")
    )
    within = Window.partitionBy(key, "bin").orderBy("v")
    needed = counts.join(targets.select(key, "bin").distinct(), [key, "bin"], "left_semi")
    ordered = needed.withColumn("upto", F.sum("n").over(within))
    hit = ordered.join(targets, [key, "bin"]).where(
        (F.col("rank") >= F.col("lo") + F.col("upto") - F.col("n"))
        & (F.col("rank") < F.col("lo") + F.col("upto"))
    )
    part = F.when(F.col("side") == 0, F.col("v") * (1 - F.col("frac"))).otherwise(
        F.col("v") * F.col("frac")
    )
    return hit.groupBy(key).agg(
        *[F.sum(F.when(F.col("p") == i, part)).alias(f"p{round(p * 100)}") for i, p in enumerate(ps)]
    )


def _place(p: float) -> Column:
    return F.lit(p) * (F.col("total") - 1)


def _ranks(p: float) -> tuple[Column, Column]:
    low = F.floor(_place(p))
    return low, F.least(low + 1, F.col("total") - 1)


def suite_report(items: DataFrame) -> DataFrame:
    """One row per suite of ``item_result`` with a ``suite`` column.

    The measures are written once, without text: mean and percentiles each need
    them, and the items are to be pruned only once.
    """
    measures = ("suite", "compression_ratio", "fidelity_ratio", "naked_tokens", "proxied_tokens")
    items = written(items.select(*measures), "measures")
    ratio = F.col("compression_ratio")
    base = items.groupBy("suite").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg(ratio).alias("mean_compression"),
        F.coalesce(F.stddev_samp(ratio), F.lit(0.0)).alias("std_compression"),
        F.avg("fidelity_ratio").alias("mean_fidelity"),
        F.min("fidelity_ratio").alias("min_fidelity"),
        F.sum("naked_tokens").alias("total_naked_tokens"),
        F.sum("proxied_tokens").alias("total_pruned_tokens"),
    )
    cuts = percentiles(items.select("suite", "compression_ratio"), "suite",
                       "compression_ratio", (0.1, 0.5, 0.9))
    return base.join(cuts, "suite").select(
        "suite",
        "n_items",
        "mean_compression",
        "std_compression",
        F.col("p10").alias("p10_compression"),
        F.col("p50").alias("p50_compression"),
        F.col("p90").alias("p90_compression"),
        "mean_fidelity",
        "min_fidelity",
        "total_naked_tokens",
        "total_pruned_tokens",
        text.compression_ratio(
            F.col("total_naked_tokens"), F.col("total_pruned_tokens")
        ).alias("overall_compression"),
    )


def suite_assertions(
    report: DataFrame, compression: float = COMPRESSION, fidelity: float = FIDELITY
) -> DataFrame:
    """Five checks per suite, each with its actual value, threshold and verdict."""
    checks = (
        ("mean_compression", compression),
        ("p10_compression", max(P10_FLOOR, compression - P10_SLACK)),
        ("overall_compression", compression),
        ("mean_fidelity", fidelity),
        ("min_fidelity", max(MIN_FLOOR, fidelity - MIN_SLACK)),
    )
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("check"), F.col(n).alias("actual"), F.lit(t).alias("threshold"))
            for n, t in checks
        ]
    )
    return (
        report.select("suite", F.explode(rows).alias("c"))
        .select("suite", "c.*")
        .withColumn("passed", F.col("actual") >= F.col("threshold"))
    )


def global_summary(report: DataFrame, assertions: DataFrame | None = None) -> DataFrame:
    """Token totals of all suites and the plain mean of their fidelities."""
    naked, pruned = F.sum("total_naked_tokens"), F.sum("total_pruned_tokens")
    out = report.agg(
        naked.alias("total_naked_tokens"),
        pruned.alias("total_pruned_tokens"),
        ((naked - pruned) / F.greatest(naked, F.lit(1))).alias("global_compression"),
        F.avg("mean_fidelity").alias("global_fidelity"),
    )
    if assertions is None:
        return out
    verdict = assertions.agg(F.bool_and("passed").alias("passed"))
    return out.withColumn("passed", verdict.scalar())


def suite_documents(report: DataFrame, assertions: DataFrame) -> DataFrame:
    """One row per suite with its five checks nested, for the JSON report.

    Items are not nested: a suite may be as large as the data.
    """
    verdicts = assertions.groupBy("suite").agg(
        F.bool_and("passed").alias("passed"),
        F.sort_array(F.collect_list(F.struct("check", "actual", "threshold", "passed"))).alias(
            "checks"
        ),
    )
    return report.join(verdicts, "suite")


# --- needle recovery ----------------------------------------------------------
def recall_arms(
    needles: DataFrame, archive: DataFrame, turns: int = TURNS, pruner: Pruner | None = None
) -> DataFrame:
    """One row per item and arm of ``needles(name, raw, needle)``.

    Arm C pages the log back from ``archive(name, raw_content)``.
    """
    shown = F.coalesce((pruner or OutputPruner()).compress(F.col("raw")), F.col("raw"))
    needle = F.col("needle")
    # Only the needle and two sizes travel to the archived logs, not the raw texts.
    kept = with_once(needles, "_shown", shown).select(
        "name",
        "needle",
        F.col("raw").contains(needle).alias("in_raw"),
        text.token_estimate(F.col("raw"), 1).alias("raw_tokens"),
        F.col("_shown").contains(needle).alias("in_summary"),
        text.token_estimate(F.col("_shown"), 1).alias("summary_tokens"),
    )
    paged = archive.select("name", F.col("raw_content").alias("_back"))
    joined = kept.join(paged, "name", "left").withColumn("_back", F.coalesce("_back", F.lit("")))

    def arm(i: int, seen: Column, resident: str, recall: Column) -> Column:
        return F.struct(
            F.lit(ARMS[i][0]).alias("arm"),
            F.lit(ARMS[i][1]).alias("label"),
            seen.alias("needle_recovered"),
            F.col(resident).alias("resident_tokens"),
            recall.cast("bigint").alias("recall_tokens"),
        )

    arms = F.array(
        arm(0, F.col("in_raw"), "raw_tokens", F.lit(0)),
        arm(1, F.col("in_summary"), "summary_tokens", F.lit(0)),
        arm(2, F.col("_back").contains(needle), "summary_tokens",
            text.token_estimate(F.col("_back"), 1)),
    )
    return (
        joined.select("name", F.explode(arms).alias("a"))
        .select("name", "a.*")
        .withColumn("total_tokens", F.col("resident_tokens") * turns + F.col("recall_tokens"))
    )


def recall_report(arms: DataFrame) -> DataFrame:
    """Recovery rate and tokens per arm, side by side, and C's saving over A."""
    def of(arm: str, c: Column) -> Column:
        return F.when(F.col("arm") == arm, c)

    names = [a.lower() for a, _ in ARMS]
    out = arms.agg(
        *[
            F.avg(of(n.upper(), F.col("needle_recovered").cast("double"))).alias(f"recovery_{n}")
            for n in names
        ],
        *[F.sum(of(n.upper(), F.col("total_tokens"))).alias(f"total_{n}_tokens") for n in names],
    )
    a, c = F.col("total_a_tokens"), F.col("total_c_tokens")
    return out.withColumn("saving_c_vs_a", F.when(a > 0, (a - c) / a).otherwise(0.0))


def recall_assertions(report: DataFrame) -> DataFrame:
    """Four checks: C finds every needle, more than B, as many as A, for fewer tokens."""
    a, b, c = (F.col(f"recovery_{n}") for n in "abc")
    checks = (
        ("C recovers every needle", c == 1.0),
        ("C recovers what B loses", c > b),
        ("C matches A on recovery", c >= a),
        ("C processes fewer tokens than A", F.col("total_c_tokens") < F.col("total_a_tokens")),
    )
    rows = F.array(*[F.struct(F.lit(n).alias("check"), t.alias("passed")) for n, t in checks])
    return report.select(F.explode(rows).alias("x")).select("x.*")
