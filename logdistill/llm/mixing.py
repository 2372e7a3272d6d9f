"""Mixing sources to target weights, exact to a few words.

Sizes are exact word counts. A source's target is its share of all words by
weight, at most ``MOST`` times its own words; what a source cannot hold goes to
the others by weight. The mix takes whole passes of a source, then fills the
remaining budget from its table of lengths: the same part of every length, and
the rest by dynamic programming over lengths with their counts (a bounded
knapsack), so the taken words meet the budget. Which documents of a length are
taken follows a seeded hash of their id, or of their text if that is null.

Null texts have no words; a null source is a source, ordered last. Rows that
repeat an id are separate documents. Nothing per document meets in one task:
hot lengths are cut into hash buckets whose counts place the last one taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .common import WORD, packed, row_key, text_of

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 42
DP_WORDS = 65_536  # budget left to dynamic programming; larger rests shrink by whole lengths first
BUCKET_ROWS = 4_096


def _src() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``src`` (a key that is never null), ``row_key``, ``size``."""
    d = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), text=text_of(), row_key=row_key())
    return d.select(
        "doc_id", "source", _src().alias("src"), "row_key",
        F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("size"),
    )


def targets(lengths: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``src``, ``source_size``, ``target`` from the table of lengths.

    The excess of capped sources raises one level that all others share by
    weight; sources ordered by the level at which they fill up give it in one
    pass. The windows hold one row per source.
    """
    per = lengths.groupBy("src", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    per = per.withColumn("cap", F.col("source_size") * float(most))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / heavy)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    per = per.withColumn("shared", F.max(fits).over(everything))
    target = F.least(F.col("cap"), F.coalesce("shared", F.lit(0.0)) * F.col("weight"))
    return per.select("src", "source_size", target.alias("target"))


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take for a total of ``budget`` or just below."""
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return taken
    if budget >= total:
        return counts.copy()
    taken = np.array([int(n) * budget // total for n in counts], np.int64)
    rest = budget - int((taken * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if rest <= dp_words or size <= 0:
            break
        more = min(int(counts[i] - taken[i]), (rest - dp_words) // size)
        taken[i] += more
        rest -= more * size
    reach = np.zeros(rest + 1, bool)
    reach[0] = True
    by = np.full(rest + 1, -1, np.int64)  # the item that first reached a sum
    items: list[tuple[int, int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        size, free, step = int(lengths[i]), int(counts[i] - taken[i]), 1
        if size <= 0 or size > rest:
            continue
        free = min(free, rest // size)
        while free > 0 and not reach[rest]:
            some = min(step, free)
            weight = some * size
            fresh = reach[:-weight] & ~reach[weight:]
            by[weight:][fresh] = len(items)
            reach[weight:][fresh] = True
            items.append((i, some, weight))
            free -= some
            step *= 2
        if reach[rest]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, some, weight = items[by[at]]
        taken[i] += some
        at -= weight
    return taken


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's lengths: passes over all, and documents of each length once more."""
    pdf = pdf.sort_values("size")
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, goal = int((lengths * counts).sum()), int(round(float(pdf["target"].iloc[0])))
    passes = goal // total if total else 0
    extra = fill(lengths, counts, goal - passes * total) if total else np.zeros(len(pdf), np.int64)
    return pd.DataFrame(
        {
            "src": pdf["src"], "size": lengths, "n": counts, "passes": passes, "extra": extra,
            "source_size": pdf["source_size"], "target": pdf["target"],
        }
    )


PLAN = "src string, size long, n long, passes long, extra long, source_size long, target double"


def plan(lengths: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    goal = targets(lengths, weights, most)
    return lengths.select("src", "size", "n").join(goal, "src").groupBy("src").applyInPandas(_plan, PLAN)


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """``doc_id``, ``src``, ``row_key``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` per document."""
    base = written(sized(docs), "sizes")
    lengths = written(
        base.groupBy("src", "source", "size").agg(F.count("*").alias("n")), "lengths"
    )
    steps = written(plan(lengths, weights, most), "mix-plan")
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "row_key")).otherwise(
        F.xxhash64(F.lit(seed), "doc_id")
    )
    buckets = F.ceil(F.col("n") / F.lit(BUCKET_ROWS))
    place = F.floor(F.pmod(F.col("key"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * buckets)
    d = base.withColumn("key", key).join(steps, ["src", "size"]).withColumn("bucket", place)
    some = d.where("extra > 0 and extra < n")
    counts = some.groupBy("src", "size", "bucket").agg(F.count("*").alias("m"))
    ahead = Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "src", "size", "bucket", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("ahead")
    )
    rank = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("key", "doc_id", "row_key"))
    ranked = some.withColumn("rank", rank).join(offsets, ["src", "size", "bucket"])
    picked = ranked.withColumn("once", (F.col("ahead") + F.col("rank") <= F.col("extra")).cast("bigint"))
    even = d.where("extra = 0 or extra = n").withColumn("once", (F.col("extra") > 0).cast("bigint"))
    columns = ["doc_id", "src", "row_key", "size", "source_size", "target", "passes", "once"]
    out = picked.select(*columns).unionByName(even.select(*columns))
    copies: Column = F.col("passes") + F.col("once")
    return out.select(
        "doc_id", "src", "row_key", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def report(docs: DataFrame) -> DataFrame:
    return mixed(docs).drop("src", "row_key")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each with its number of ``copies``, by id and text.

    Rows that share source, id and text share their copies as evenly as can be.
    """
    chosen = mixed(docs, **options).groupBy("src", "row_key").agg(
        F.sum("copies").alias("total"), F.count("*").alias("m"),
        F.first("size").alias("size"), F.first("target").alias("target"),
    )
    d = packed(docs, src=_src(), row_key=row_key()).join(chosen, ["src", "row_key"])
    place = F.row_number().over(Window.partitionBy("src", "row_key").orderBy(F.lit(1)))
    more_ = F.when(place <= F.col("total") % F.col("m"), 1).otherwise(0)
    shared = (F.floor(F.col("total") / F.col("m")) + F.when(F.col("m") > 1, more_).otherwise(0)).cast("bigint")
    d = d.withColumn("copies", shared).where("copies > 0")
    names = {f.lower() for f in docs.columns}
    more = [F.col(c) for c in ("copies", "size", "target") if c not in names]
    return d.select("row.*", *more)
