"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


#: A hub has more than one in so many of all links, and more than so many.
HUB_SHARE, HUB_LEAST = 400, 1_000


def _with_lowest(links: DataFrame, n_links: int) -> DataFrame:
    """Each of ``n_links`` links (or fewer) with ``low``, the least of ``a`` and all it is linked to.

    Links of hubs stay where they are and hubs are broadcast: there are fewer than
    ``HUB_SHARE`` of them, and none at all in a small table.
    """
    lowest = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"), F.count("*").alias("n"))
    limit = max(n_links // HUB_SHARE, HUB_LEAST)
    if n_links <= limit:
        return links.join(lowest.select("a", "low"), "a")
    hubs = F.broadcast(lowest.where(F.col("n") > limit).select("a", "low"))
    rest = lowest.where(F.col("n") <= limit).select("a", "low")
    marked = links.join(hubs, "a", "left")
    near = marked.where("low is not null")
    return near.unionByName(marked.where("low is null").drop("low").join(rest, "a"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of ``edges`` (a, b).

    Star contraction: large stars move a node's larger neighbours to its least
    neighbour, small stars the smaller ones, until every tree is a star. Each
    round is two joins and two aggregations that combine before they shuffle,
    written once to the shared folder; rounds grow with the logarithm of the
    number of nodes. Loops are dropped; isolated nodes are the caller's.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    clean = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    state = written(
        clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    mark = _mark(state)
    while mark[0]:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            _with_lowest(both, 2 * mark[0]).where("b > a and b <> low")
            .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        small = (
            _with_lowest(large, 2 * mark[0])
            .select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.low").alias("b")).where("a <> b").distinct()
        )
        state = written(small, name)
        before, mark = mark, _mark(state)
        if mark == before:
            break
    if not mark[0]:
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _mark(state: DataFrame) -> tuple[int, object]:
    """Number and order-free hash of the edges: alike iff a round changed nothing."""
    row = state.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]
