"""Paging archived entries back into view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..functions.text import sanitize, strip
from ..shared import written
from . import search

PREVIEW_CHARS = 300
COMMAND_CHARS = 40
CLOCK = "yyyy-MM-dd HH:mm:ss"


def recall_by_id(entries: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """Entries by handle; a table of handles keeps its misses as null rows."""
    if isinstance(ids, DataFrame):
        # The inner join can broadcast few handles and leave the entries where they
        # are; an outer join would have to shuffle all of them.
        found = entries.join(ids.select("id").distinct(), "id")
        return ids.join(found, "id", "left")
    return entries.where(F.col("id").isin(list(ids)))


def latest_session(sessions: DataFrame) -> Column:
    """Id of the session started last, as a scalar subquery."""
    newest = F.min(F.struct((-F.col("started_at")).alias("t"), "session_id"))
    return sessions.agg(newest.alias("s")).select("s.session_id").scalar()


def recall_scope(
    requests: DataFrame, sessions: DataFrame, all_sessions: bool = False
) -> DataFrame:
    """Adds ``scope`` to requests with ``explicit`` and ``current`` session ids.

    The explicit session, else the current one if it exists, else the latest;
    null stands for all sessions.
    """
    if all_sessions:
        return requests.withColumn("scope", F.col("explicit"))
    known = sessions.select(F.col("session_id").alias("_known"))
    return (
        requests.join(known, F.col("current") == F.col("_known"), "left")
        .withColumn("scope", F.coalesce("explicit", "_known", latest_session(sessions)))
        .drop("_known")
    )


def recall_scope_at(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """``recall_scope`` for requests that carry ``requested_at``, in seconds.

    In place of the latest session stands the latest one started by then (of those
    started at one time the least id); null if there was none. A null time has none.
    """
    known = sessions.select(F.col("session_id").alias("_known"))
    scoped = newest_started(requests, sessions).join(
        known, F.col("current") == F.col("_known"), "left"
    )
    return scoped.withColumn("scope", F.coalesce("explicit", "_known", "_newest")).drop(
        "_known", "_newest"
    )


def newest_started(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds ``_newest``, the session started last at each request's time.

    Starts and requests are laid in one order and cut into ranges; a range looks
    back within itself and else takes the last start of the ranges before it, one
    row per range. So neither a hot second nor the table's length is one task.
    """
    asked = F.struct(*requests.columns)
    rows = requests.select(
        F.col("requested_at").cast("double").alias("t"), F.lit(1).alias("kind"),
        F.lit(None).cast("string").alias("started"), F.xxhash64(F.to_json(asked)).alias("deal"),
        asked.alias("asked"),
    )
    starts = sessions.where(F.col("started_at").isNotNull()).select(
        F.col("started_at").cast("double").alias("t"), F.lit(0).alias("kind"),
        F.col("session_id").alias("started"), F.lit(0).cast("bigint").alias("deal"),
        F.lit(None).cast(rows.schema["asked"].dataType).alias("asked"),
    )
    order = ("t", "kind", F.desc("started"), "deal")
    # Written, so that both passes see the same ranges even if an executor is lost.
    laid = written(
        rows.unionByName(starts).repartitionByRange(*order).withColumn("part", F.spark_partition_id()),
        "starts",
    )
    last = F.last("started", ignorenulls=True)
    so_far = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = laid.where("kind = 0").groupBy("part").agg(
        F.min_by("started", F.struct((-F.col("t")).alias("t"), "started")).alias("end")
    )
    # One row per range: bounded by the number of partitions.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = laid.select("part").distinct().join(ends, "part", "left").select(
        "part", F.last("end", ignorenulls=True).over(earlier).alias("carried")
    )
    return (
        laid.withColumn("mine", last.over(so_far))
        .where("kind = 1")
        .join(F.broadcast(carried), "part")
        .select("asked.*", F.when(F.col("t").isNotNull(), F.coalesce("mine", "carried")).alias("_newest"))
    )


def in_scope(
    entries: DataFrame,
    sessions: DataFrame,
    explicit: str | None = None,
    current: str | None = None,
    all_sessions: bool = False,
) -> DataFrame:
    """Entries that a recall by query may return."""
    if explicit is not None:
        return entries.where(F.col("session_id") == explicit)
    if all_sessions:
        return entries
    known = sessions.where(F.col("session_id") == F.lit(current)).agg(
        F.max("session_id").alias("session_id")
    )
    scope = F.coalesce(known.scalar(), latest_session(sessions))
    return entries.where(F.col("session_id") == scope)


def recall_by_query(
    entries: DataFrame,
    sessions: DataFrame,
    expr: search.Expr,
    explicit: str | None = None,
    current: str | None = None,
    all_sessions: bool = False,
    limit: int = 1,
    columns: tuple[str, ...] = search.COLUMNS,
) -> DataFrame:
    """The best matches within the scope; ranks still come from the whole index."""
    ranked = search.rank_entries(entries, expr, columns)
    mine = in_scope(ranked, sessions, explicit, current, all_sessions)
    return search.with_entry(search.top(mine.select("entry_id", "rank"), limit), entries)


def _clock(seconds: Column) -> Column:
    """UTC whatever the session's time zone is."""
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.date_format(F.timestamp_add("SECOND", F.floor(seconds), epoch), CLOCK)


def preview(df: DataFrame, n: int = PREVIEW_CHARS) -> DataFrame:
    """Adds ``preview``: the summary, or the raw text of an entry without one."""
    shown = F.when(F.col("compressed_summary") != "", F.col("compressed_summary")).otherwise(
        F.col("raw_content")
    )
    cut = bind(
        sanitize(shown),
        lambda c: F.concat(
            strip(F.substring(c, 1, n)), F.when(F.length(c) > n, "\n  …").otherwise("")
        ),
    )
    return df.withColumn("preview", cut)


def session_view(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "session_id",
        _clock(F.col("started_at")).alias("started"),
        F.substring(sanitize(F.col("agent_command")), 1, COMMAND_CHARS).alias("command"),
        F.when(F.col("ended_at").isNotNull() & (F.col("ended_at") != 0), "✓")
        .otherwise("…")
        .alias("state"),
    )


def recall_view(entries: DataFrame, raw: bool = False) -> DataFrame:
    content = F.col("raw_content")
    return entries.select(
        "id",
        F.substring("session_id", 1, 8).alias("session"),
        _clock(F.col("timestamp")).alias("time"),
        "was_pruned",
        (content if raw else sanitize(content)).alias("content"),
    )
