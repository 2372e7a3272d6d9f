"""Sinks: the archive fed by micro-batches, and counters that follow a stream."""

from __future__ import annotations

import json
import logging
import threading
from collections import defaultdict
from collections.abc import Sequence

from pyspark.errors import AnalysisException, PySparkException, PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from ..functions.text import decode_bytes
from ..operators import prune as P
from ..operators.archive import append_entries
from ..settings import MIN_LINES

log = logging.getLogger(__name__)


def entries_of(segments: DataFrame) -> DataFrame:
    """Segments as entries without ids: decoded, in the order of their end."""
    return segments.select(
        "session_id",
        F.col("seg_no").alias("seq"),
        (F.unix_micros("last_ts") / 1_000_000).alias("timestamp"),
        F.lit("stdout").alias("entry_type"),
        decode_bytes(F.col("data")).alias("raw_content"),
    )


def unpruned(entries: DataFrame) -> DataFrame:
    """Entries as they would be if no pruner fitted."""
    return P.prune(entries, pruners=[])


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the query of this checkpoint: the same after every restart."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _pruner_failed(e: PySparkException) -> bool:
    """Whether an expression or a Python pruner failed, and not storage or an executor."""
    if isinstance(e, (PythonException, AnalysisException)):
        return True
    said = f"{e.getCondition()} {e}"
    return any(x in said for x in ("USER_RAISED_EXCEPTION", "PythonException", "ARITHMETIC_OVERFLOW", "DIVIDE_BY_ZERO"))


def archive_sink(
    segments: DataFrame,
    path: str,
    checkpoint: str,
    pruners: Sequence[P.Pruner] | None = None,
    min_lines: int = MIN_LINES,
    cap: int | None = None,
    index: Sequence[str] | None = None,
) -> DataStreamWriter:
    """Prune and archive every micro-batch.

    A batch is one commit named by its query and number: run again it replaces
    itself, so each segment is archived exactly once, and streams that share an
    archive keep out of each other's commits. A text that a pruner fails on stays
    raw; if Spark cannot even plan a pruner, the raw texts of the whole batch are
    archived. Other faults stop the stream, which repeats the batch when it starts
    again. ``index`` names the columns whose
    words go to the search index along with the batch.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        entries = entries_of(batch)
        commit = f"{_query_id(batch.sparkSession, checkpoint)}-{batch_id:012d}"
        try:
            pruned = P.prune(entries, pruners, min_lines)
            append_entries(P.archived(pruned, cap), path, commit, index)
        except PySparkException as e:
            if not _pruner_failed(e):
                raise
            log.exception("batch %s is archived without pruning", batch_id)
            append_entries(P.archived(unpruned(entries), cap), path, commit, index)

    return segments.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def live_stats(entries: DataFrame, tag: str, min_lines: int = MIN_LINES) -> DataFrame:
    """Running counters per session of a stream of entries."""
    shown = P.render_injection(
        P.prune(entries.withColumn("id", F.lit(0)), min_lines=min_lines), tag, color=False
    )
    return P.pipeline_counters(shown)


def follow(counters: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write each batch's changed counters to its own folder, by query."""

    def store(batch: DataFrame, batch_id: int) -> None:
        query = _query_id(batch.sparkSession, checkpoint)
        batch.write.mode("overwrite").parquet(f"{path}/query={query}/batch={batch_id}")

    return (
        counters.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
    )


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest counters of every session written by ``follow``."""
    seen = spark.read.parquet(path)
    names = [c for c in seen.columns if c not in ("session_id", "batch", "query")]
    newest = F.max(F.struct("batch", *names)).alias("x")
    return seen.groupBy("session_id").agg(newest).select("session_id", *[f"x.{c}" for c in names])


class LateRows(StreamingQueryListener):
    """Counts the chunks that came too late, over every progress report of a run.

    Register it with ``spark.streams.addListener`` before the stream starts.
    """

    def __init__(self) -> None:
        self._counts: dict[str, int] = defaultdict(int)
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._counts[str(event.progress.runId)] += sum(
            op.numRowsDroppedByWatermark for op in event.progress.stateOperators
        )

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def of(self, q: StreamingQuery, patience: float = 60.0) -> int:
        """The count so far; of a run that ended, once its last report is in."""
        run = str(q.runId)
        if not q.isActive and not self._ended[run].wait(patience):
            raise TimeoutError("the end of the stream was not reported")
        return self._counts[run]


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Run a stream over all there is now and wait for it."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q
