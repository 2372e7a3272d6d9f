"""The archive: sessions and entries, their upkeep and their statistics."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Sequence
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..settings import USD_PER_MILLION_TOKENS
from ..shared import create_once, file_names, scratch, written
from ..sources.tables import read_entries
from . import search

ENTRY_COLUMNS = [f.split()[0] for f in schemas.ENTRY.split(", ")]


# --- writing entries --------------------------------------------------------
def _placed(new: DataFrame, order: tuple[str, ...], folder: str | None = None) -> DataFrame:
    """Rows written in order, each with its partition and its place there."""
    order = order or ("timestamp", "session_id", "seq")
    return written(
        new.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        # The lower 33 bits number the rows of a partition.
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "placed",
        folder,
    )


def _numbered(placed: DataFrame, base: Column | int) -> DataFrame:
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: bounded by the partition count, not by the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    start = F.lit(base) if isinstance(base, int) else base
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("id", start + F.col("_offset") + F.col("_row") + 1)
        .drop("_part", "_row", "_offset")
    )


def assign_ids(new: DataFrame, base: Column | int = 0, order: tuple[str, ...] = ()) -> DataFrame:
    """Number rows base+1, base+2, … in the given order, without one global sort task.

    Range partitioning on the full order splits any hot session or second. The
    placed rows are written once, at call time, so counting and numbering see the
    same partitions even if an executor is lost between the two jobs.
    """
    return _numbered(_placed(new, order), base)


def append_entries(
    new: DataFrame, path: str, commit: str | None = None, index: Sequence[str] | None = None
) -> DataFrame:
    """Append one batch under its own commit folder and return it with its ids.

    ``index`` names text columns whose words go to the archive's search index.

    Writing a commit again replaces it whole, with the same ids if it has not
    grown, so a retried micro-batch leaves no duplicates. Ids continue behind
    those that other commits claimed; writers may append at the same time.
    """
    spark = new.sparkSession
    commit = commit or uuid.uuid4().hex
    target = f"{path}/entries/commit={commit}"
    with scratch(spark, "append") as folder:
        # Range partitioning samples its input first: written, the batch is computed once.
        placed = _placed(written(new, "batch", folder), (), folder)
        numbered = _numbered(placed, claim_ids(spark, path, commit, placed.count()))
        known = [c for c in ENTRY_COLUMNS if c in numbered.columns]
        # Within a file by session, with Bloom filters: a lookup by session or by handle
        # skips the files, row groups and pages that lack it.
        clustered = numbered.select(*known).sortWithinPartitions("session_id", "timestamp", "id")
        _with_blooms(clustered.write.mode("overwrite"), "session_id", "id").parquet(target)
    if index:
        search.write_index(spark.read.schema(schemas.ENTRY).parquet(target), path, tuple(index), commit)
    # Totals come last: a commit is repeated whole if it is lost before they are there.
    _totals(spark.read.schema(schemas.ENTRY).parquet(target)).write.mode("overwrite").parquet(
        f"{path}/totals/commit={commit}"
    )
    return spark.read.parquet(target)


def _with_blooms(writer: DataFrameWriter, *columns: str) -> DataFrameWriter:
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer = writer.option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
    return writer


#: Ids kept free behind a claim whose size is not (or never) told.
UNTOLD = 1 << 33
_claiming = threading.Lock()


def claim_ids(spark: SparkSession, path: str, commit: str, count: int) -> int:
    """The base of ``count`` ids that are this commit's alone.

    Claims are empty files in ``{path}/ids`` named by their base; creating one is
    exclusive, and a second file tells its size and commit. A writer lost between
    the two leaves a gap of ``UNTOLD`` ids and no other harm. No entry is read,
    but once in an archive that was written before it had claims.
    """
    folder = f"{path}/ids"
    with _claiming:  # only so that threads of one driver leave no gaps
        while True:
            claims = _claims(spark, folder)
            for base, (n, owner) in sorted(claims.items()):
                if owner == commit and n >= count:
                    return base
            if claims:
                last = max(claims)
                base = last + claims[last][0]
            else:
                base = _largest_id(spark, path)
                if _claims(spark, folder):  # someone began while the entries were read
                    continue
            if count == 0:
                return base
            if create_once(spark, f"{folder}/{base:020d}"):
                create_once(spark, f"{folder}/{base:020d}.{count}.{quote(commit, safe='')}")
                return base


def _claims(spark: SparkSession, folder: str) -> dict[int, tuple[int, str | None]]:
    """Size and commit of every claim by its base."""
    found: dict[int, tuple[int, str | None]] = {}
    for name in file_names(spark, folder):
        if name[:20].isdigit():
            base, *told = name.split(".", 2)
            if told:
                found[int(base)] = (int(told[0]), unquote(told[1]))
            else:
                found.setdefault(int(base), (UNTOLD, None))
    return found


def _largest_id(spark: SparkSession, path: str) -> int:
    """The largest id of the archive; reads the id column only."""
    try:
        entries = read_entries(spark, path, deleted=True)  # their ids stay taken
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise
    return entries.agg(F.max("id")).first()[0] or 0


# --- sessions ---------------------------------------------------------------
def create_sessions(commands: DataFrame, deterministic: bool = False) -> DataFrame:
    """New session rows for ``(agent_command, started_at)``."""
    key = (
        F.sha2(F.concat_ws("|", "agent_command", F.col("started_at").cast("string")), 256)
        if deterministic
        else F.expr("uuid()")
    )
    return commands.select(
        key.alias("session_id"),
        "agent_command",
        "started_at",
        F.lit(None).cast("double").alias("ended_at"),
        F.lit(0).cast("bigint").alias("total_tokens_saved"),
    )


def ensure_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` plus the sessions of ``new`` it lacks; the earliest command wins."""
    first = F.min(F.struct("started_at", "agent_command")).alias("f")
    missing = (
        new.groupBy("session_id")
        .agg(first)
        .join(old.select("session_id"), "session_id", "left_anti")
        .select(
            "session_id",
            F.col("f.agent_command").alias("agent_command"),
            F.col("f.started_at").alias("started_at"),
            F.lit(None).cast("double").alias("ended_at"),
            F.lit(0).cast("bigint").alias("total_tokens_saved"),
        )
    )
    return old.unionByName(missing)


def append_sessions(new: DataFrame, path: str, commit: str | None = None) -> None:
    """Add those sessions of ``new`` that the archive's session table lacks.

    A commit written again replaces itself. A deleted session stays deleted.
    """
    spark = new.sparkSession
    commit = commit or uuid.uuid4().hex
    names = [f.split()[0] for f in schemas.SESSION.split(", ")]
    rows = new.select(*names)
    if any(n != f"commit={commit}" for n in file_names(spark, f"{path}/sessions")):
        stored = spark.read.schema("session_id STRING, commit STRING").parquet(f"{path}/sessions")
        others = stored.where(F.col("commit") != commit)
        rows = rows.join(others.select("session_id"), "session_id", "left_anti").select(*names)
    first = F.min(F.struct("started_at", *[n for n in names[1:] if n != "started_at"])).alias("f")
    rows = rows.groupBy("session_id").agg(first)
    rows.select("session_id", *[F.col(f"f.{n}").alias(n) for n in names[1:]]).write.mode(
        "overwrite"
    ).parquet(f"{path}/sessions/commit={commit}")


def close_sessions(sessions: DataFrame, closes: DataFrame) -> DataFrame:
    """Set end time and net tokens saved from ``(session_id, ended_at, tokens_saved)``.

    The latest close of a session counts; closes of unknown sessions do nothing.
    """
    last = closes.groupBy("session_id").agg(
        F.max(F.struct("ended_at", "tokens_saved")).alias("c")
    )
    return sessions.join(last, "session_id", "left").select(
        "session_id",
        "agent_command",
        "started_at",
        F.coalesce(F.col("c.ended_at"), F.col("ended_at")).alias("ended_at"),
        F.coalesce(F.col("c.tokens_saved"), F.col("total_tokens_saved")).alias(
            "total_tokens_saved"
        ),
    )


def append_session_events(events: DataFrame, path: str, commit: str | None = None) -> None:
    """Append openings and closings to the session log, one folder per commit."""
    names = [f.split()[0] for f in schemas.SESSION_EVENT.split(", ")]
    target = f"{path}/session_log/commit={commit or uuid.uuid4().hex}"
    events.select(*names).write.mode("overwrite").parquet(target)


def fold_sessions(events: DataFrame) -> DataFrame:
    """Session rows from the log: the first opening and the last closing count.

    One partial aggregate per task and session, so nothing is updated in place
    and a session with many events is no hot spot.
    """
    opens, closes = F.col("kind") == "open", F.col("kind") == "close"
    return (
        events.groupBy("session_id")
        .agg(
            F.min(F.when(opens, F.struct("event_ts", "agent_command"))).alias("o"),
            F.max(F.when(closes, F.struct("event_ts", "tokens_saved"))).alias("c"),
        )
        .where(F.col("o").isNotNull())
        .select(
            "session_id",
            F.col("o.agent_command").alias("agent_command"),
            F.col("o.event_ts").alias("started_at"),
            F.col("c.event_ts").alias("ended_at"),
            F.coalesce("c.tokens_saved", F.lit(0).cast("bigint")).alias("total_tokens_saved"),
        )
    )


# --- deleting and integrity -------------------------------------------------
def mark_deleted(ids: DataFrame, path: str, commit: str | None = None) -> None:
    """Delete the entries ``id`` of an archive for its readers and its index.

    Nothing is rewritten: the ids are noted, and never given to another entry. With an
    id goes what it counted for, so that kept totals need no entries to leave it out.
    """
    spark = ids.sparkSession
    target = f"{path}/deleted/commit={commit or uuid.uuid4().hex}"
    gone = ids.select(F.col("id").cast("bigint")).distinct()
    names = [f.split()[0] for f in schemas.DELETED.split(", ")]
    if file_names(spark, f"{path}/entries"):
        counted = read_entries(spark, path, deleted=True).select(*names)
        # The inner join can broadcast few ids and leave the entries where they are.
        gone = gone.join(gone.join(counted, "id"), "id", "left").select(*names)
    gone.write.mode("overwrite").parquet(target)


def delete_sessions(ids: DataFrame, path: str, commit: str | None = None) -> None:
    """Delete sessions of an archive, and all entries they have so far, for its readers.

    Entries and index leave out the entries, session table and log the sessions. The
    entries go first: run again under its name, a deletion that was cut short is whole.
    """
    spark = ids.sparkSession
    commit = commit or uuid.uuid4().hex
    gone = ids.select("session_id").where(F.col("session_id").isNotNull()).distinct()
    if file_names(spark, f"{path}/entries"):
        held = read_entries(spark, path, deleted=True).select("id", "session_id")
        mark_deleted(held.join(gone, "session_id", "left_semi"), path, commit)
    gone.write.mode("overwrite").parquet(f"{path}/deleted_sessions/commit={commit}")


def delete_entries(
    entries: DataFrame, postings: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Entries and index postings without the given ids."""
    gone = ids.select("id").distinct()
    return (
        entries.join(gone, "id", "left_anti"),
        postings.join(gone.withColumnRenamed("id", "entry_id"), "entry_id", "left_anti"),
    )


def fk_orphans(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Entries whose session does not exist.

    The session ids are made distinct map-side first, so the anti join sees one
    row per session however hot it is; the entries are then only semi-joined.
    """
    unknown = (
        entries.select("session_id").distinct().join(sessions, "session_id", "left_anti")
    )
    return entries.join(unknown, "session_id", "left_semi")


def check_fk(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """The entries themselves, or an error if one names an unknown session."""
    unknown = entries.select("session_id").distinct().join(
        sessions, "session_id", "left_anti"
    )
    if not unknown.isEmpty():
        raise ValueError("entries name sessions that do not exist")
    return entries


def delete_session_cascade(
    entries: DataFrame, sessions: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Entries and sessions without the given sessions."""
    gone = ids.select("session_id").distinct()
    return (
        entries.join(gone, "session_id", "left_anti"),
        sessions.join(gone, "session_id", "left_anti"),
    )


# --- reading ----------------------------------------------------------------
def session_stats(entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Counts and token sums of every session, zeros for an empty one.

    Aggregated before the join and without touching the text columns.
    """
    return _of_sessions(_totals(entries), sessions)


TOTALS = [f.split()[0] for f in schemas.TOTALS.split(", ")][1:]


def _totals(entries: DataFrame) -> DataFrame:
    """Counts and token sums per session."""
    pruned = F.col("was_pruned")
    return entries.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.sum(pruned.cast("bigint")).alias("pruned_entries"),
        F.sum("token_estimate").alias("raw_tokens"),
        F.sum(F.when(pruned, F.col("token_estimate")).otherwise(0)).alias("pruned_raw_tokens"),
    )


def _of_sessions(per: DataFrame, sessions: DataFrame) -> DataFrame:
    return (
        sessions.select("session_id")
        .join(per, "session_id", "left")
        .select("session_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in TOTALS])
    )


def stored_stats(spark: SparkSession, path: str, sessions: DataFrame) -> DataFrame:
    """``session_stats`` of a written archive from the totals that its commits keep.

    Reads one row per commit and session and one per deleted entry, however often it
    was deleted, but no entries.
    """
    kept = spark.read.schema(schemas.TOTALS).parquet(f"{path}/totals").select("session_id", *TOTALS)
    if file_names(spark, f"{path}/deleted"):
        noted = spark.read.schema(schemas.DELETED).parquet(f"{path}/deleted")
        gone = _totals(noted.where(F.col("session_id").isNotNull()).dropDuplicates(["id"]))
        kept = kept.unionByName(gone.select("session_id", *[(-F.col(n)).alias(n) for n in TOTALS]))
    return _of_sessions(kept.groupBy("session_id").agg(*[F.sum(n).alias(n) for n in TOTALS]), sessions)


def session_cost(
    stats: DataFrame, counters: DataFrame, usd_per_million: float = USD_PER_MILLION_TOKENS
) -> DataFrame:
    """Net tokens saved, their share of the pruned output and their price."""
    saved = F.coalesce(F.col("tokens_saved"), F.lit(0))
    raw = F.col("pruned_raw_tokens")
    return (
        stats.where(F.col("total_entries") > 0)
        .join(counters.select("session_id", "tokens_saved"), "session_id", "left")
        .select(
            "session_id",
            F.col("total_entries").alias("chunks"),
            F.col("pruned_entries").alias("pruned"),
            saved.alias("net_tokens_saved"),
            F.when(raw > 0, saved / raw * 100).otherwise(0.0).alias("saved_pct"),
            (saved / 1_000_000 * usd_per_million).alias("saved_usd"),
        )
    )


def list_sessions(sessions: DataFrame, limit: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc("started_at"), "session_id").limit(limit)


def recent_entries(
    entries: DataFrame, session_id: str | None = None, limit: int = 50
) -> DataFrame:
    """The newest entries of one session, or of each if none is named.

    Per session this is a row_number filter, which Spark trims to ``limit`` rows
    per session and task before the shuffle.
    """
    if session_id is not None:
        mine = entries.where(F.col("session_id") == session_id)
        return mine.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    newest = Window.partitionBy("session_id").orderBy(F.desc("timestamp"), F.desc("id"))
    return (
        entries.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)
    )
