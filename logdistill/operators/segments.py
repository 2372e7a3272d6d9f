"""Cutting a table of output chunks into segments.

One session may hold much of the data, all of it in one second perhaps, so no step
hands a whole session to one task. Chunks are sorted into ranges of (session, time,
number) of about equal size; a range is cut into blocks of a bounded number of
chunks. Each block is summarised on its own. Summaries can be joined, so those of
one session and range become one, and only these, one per range at most, are
chained; each range's blocks and each block's chunks are then numbered from the
state they start in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import decode_bytes
from ..settings import PipePolicy
from ..shared import written

MICROS = 1_000_000
KEY = "session_id"


#: Chunks of a block, which is one row.
BLOCK_CHUNKS = 20_000


def _meta(chunks: DataFrame) -> DataFrame:
    """Chunk positions and sizes without the payload.

    A column ``n_bytes``, if there is one, spares reading the payload.
    """
    size = F.col("n_bytes") if "n_bytes" in chunks.columns else F.octet_length("data")
    # like the stream, without end marks and empty chunks
    return chunks.where(size > 0).select(
        KEY, "seq", F.unix_micros("ts").alias("us"), size.cast("bigint").alias("n_bytes")
    )


def _ranges(df: DataFrame, parts: int | None, *order: str) -> DataFrame:
    """Rows dealt into sorted ranges of (session, order), which cut hot sessions anywhere."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, KEY, *order)


# --- silence only: built-in windows -----------------------------------------
def _runs(
    spans: DataFrame, apart: Callable[[Column], Column], parts: int | None, *order: str
) -> DataFrame:
    """Adds ``run_no`` (from 1) to rows with ``first`` and ``last``, which do not overlap.

    A new run begins where the time since the ``last`` before is ``apart``. Inside
    a range that comes from a window over (session, range); before a range from
    one row per session and range.
    """
    # Written once, so that both branches see the same ranges.
    dealt = written(_ranges(spans, parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(KEY, "part").orderBy(*order)
    marked = dealt.withColumn("prev", F.lag("last").over(inside)).withColumn(
        "opens", F.coalesce(apart(F.col("first") - F.col("prev")).cast("bigint"), F.lit(0))
    )
    counted = marked.withColumn("opened", F.sum("opens").over(inside))
    ends = counted.groupBy(F.col(KEY).alias("of"), F.col("part").alias("at")).agg(
        F.min("first").alias("begins"), F.max("last").alias("ends"), F.sum("opens").alias("inner")
    )
    chain = Window.partitionBy("of").orderBy("at")  # one row per range at most
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    edge = ends.withColumn(
        "edge", F.coalesce(apart(F.col("begins") - F.lag("ends").over(chain)).cast("bigint"), F.lit(1))
    )
    passed = F.coalesce(F.sum(F.col("inner") + F.col("edge")).over(before), F.lit(0))
    base = edge.select("of", "at", (passed + F.col("edge")).alias("base"))
    same = F.col(KEY).eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))
    return counted.join(base, same).select(
        *spans.columns, (F.col("base") + F.col("opened")).alias("run_no")
    )


def segment_silence(chunks: DataFrame, silence: float, parts: int | None = None) -> DataFrame:
    """Adds ``run_no`` (from 1): a new run begins when the gap is ``silence`` or more.

    ``parts`` is the number of ranges, that of shuffle partitions by default.
    """
    gap = int(silence * MICROS)
    spans = _meta(chunks).withColumns({"first": F.col("us"), "last": F.col("us")})
    return _runs(spans, lambda d: d >= gap, parts, "us", "seq").select(
        KEY, "seq", F.timestamp_micros("us").alias("ts"), "n_bytes", "run_no"
    )


def session_windows(chunks: DataFrame, gap: str, parts: int | None = None) -> DataFrame:
    """Silence-only segments as Spark's own session window gives them, also on a stream.

    Spark merges a chunk that comes exactly at the gap; ``segment_silence`` cuts there.
    A table is first summed up by slices of time no longer than the gap, whose
    chunks belong together, before anything is shuffled; slices are then merged by
    ranges, so that no task gets a whole session.
    """
    sums = {
        "n_chunks": F.count(F.lit(1)),
        "n_bytes": F.sum(F.octet_length("data").cast("bigint")),
    }
    if chunks.isStreaming:
        edges = {"first_ts": F.min("ts"), "last_ts": F.max("ts")}
        grouped = chunks.groupBy(KEY, F.session_window("ts", gap).alias("w"))
        return grouped.agg(*[c.alias(n) for n, c in (edges | sums).items()]).drop("w")
    length = F.lit(0) + _micros_of(chunks.sparkSession, gap)
    us = F.unix_micros("ts")
    slices = (
        chunks.where("ts is not null").withColumn("us", us)
        .groupBy(KEY, F.floor(F.col("us") / length).alias("slice"))
        .agg(F.min("us").alias("first"), F.max("us").alias("last"), *[c.alias(n) for n, c in sums.items()])
        .drop("slice")
    )
    return _runs(slices, lambda d: d > length, parts, "first").groupBy(KEY, "run_no").agg(
        F.timestamp_micros(F.min("first")).alias("first_ts"),
        F.timestamp_micros(F.max("last")).alias("last_ts"),
        F.sum("n_chunks").alias("n_chunks"),
        F.sum("n_bytes").alias("n_bytes"),
    ).drop("run_no")


def _micros_of(spark: SparkSession, gap: str) -> int:
    """Microseconds of an interval of days and less, as Spark reads it."""
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    later = F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + interval '{gap}'")
    row = spark.range(1).select(F.timestamp_diff("MICROSECOND", at, later).alias("us")).first()
    return row["us"]


# --- the full rule: silence, longest hold, size cap --------------------------
class Cutter:
    """The segment rule over the sorted times and sizes of consecutive chunks."""

    def __init__(self, us: np.ndarray, size: np.ndarray, policy: PipePolicy) -> None:
        self.us = us
        self.before = np.concatenate([[0], np.cumsum(size)])
        self.silence = int(policy.silence * MICROS)
        self.hold = int(policy.max_hold * MICROS)
        self.cap = policy.max_bytes
        self.gaps = np.flatnonzero(np.diff(us) >= self.silence) + 1

    def next_starts(self) -> tuple[np.ndarray, np.ndarray]:
        """For a segment starting at each chunk: where the next one starts, and
        whether it is still open when the chunks end."""
        n = len(self.us)
        at = np.arange(n)
        by_hold = np.maximum(np.searchsorted(self.us, self.us + self.hold), at + 1)
        by_gap = np.append(self.gaps, n)[np.searchsorted(self.gaps, at, side="right")]
        by_size = np.maximum(np.searchsorted(self.before, self.before[:-1] + self.cap), at + 1)
        return np.minimum(np.minimum(by_hold, by_gap), by_size), by_size > n

    def first_cut(self, state: tuple[int, int, int] | None) -> int:
        """Where the first segment starts, given the open one: (first, last, bytes)."""
        n = len(self.us)
        if state is None or self.us[0] - state[1] >= self.silence:
            return 0
        by_hold = int(np.searchsorted(self.us, state[0] + self.hold))
        by_gap = int(self.gaps[0]) if len(self.gaps) else n
        by_size = int(np.searchsorted(self.before, self.cap - state[2]))
        return min(by_hold, by_gap, by_size, n)

    def starts(self, p: int, nxt: np.ndarray) -> list[int]:
        out = []
        while p < len(self.us):
            out.append(p)
            p = int(nxt[p])
        return out


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Times, sequence numbers and sizes of each block (row) of an Arrow batch."""
    rows = batch.column("rows")
    bounds = rows.offsets.to_numpy()
    us, seq, size = (f.to_numpy(zero_copy_only=False) for f in rows.values.flatten())
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield us[a:b], seq[a:b], size[a:b]


def _pass_over(us: np.ndarray, size: np.ndarray, policy: PipePolicy) -> dict:
    """What the chain needs to know to pass over a block.

    The open segment began before the block, so it is cut within ``max_hold`` and
    ``max_bytes`` of the block's first chunk; only those chunks are listed, each
    with the state the block ends in if a segment starts there.
    """
    n = len(us)
    if n == 1:  # quiet sessions: most of their blocks hold one chunk
        at, held = int(us[0]), int(size[0])
        return {
            "n": 1, "first": at, "last": at, "bytes": held, "widest": 1, "head_us": [at],
            "head_before": [0], "begun": [1], "end_first": [at], "end_bytes": [held],
            "end_open": [held < policy.max_bytes],
        }
    cutter = Cutter(us, size, policy)
    nxt, open_at_end = cutter.next_starts()
    last = np.where(nxt < n, nxt, np.arange(n))
    begun = (nxt < n).astype(np.int64)
    while True:  # pointer doubling: the last segment reached from each start
        further = last[last]
        if np.array_equal(further, last):
            break
        begun, last = begun + begun[last], further
    # A segment opened by the block's own first chunk is cut last of all.
    widest = cutter.first_cut((int(us[0]), int(us[0]), 0))
    heads = np.arange(min(widest, n - 1) + 1)
    ends = last[heads]
    return {
        "n": n,
        "first": int(us[0]),
        "last": int(us[-1]),
        "bytes": int(cutter.before[-1]),
        "widest": widest,
        "head_us": us[heads].tolist(),
        "head_before": cutter.before[heads].tolist(),
        "begun": (begun[heads] + 1).tolist(),
        "end_first": us[ends].tolist(),
        "end_bytes": (cutter.before[-1] - cutter.before[ends]).tolist(),
        "end_open": open_at_end[ends].tolist(),
    }


_PASS = (
    "n bigint, first bigint, last bigint, bytes bigint, widest bigint, head_us array<bigint>, "
    "head_before array<bigint>, begun array<bigint>, end_first array<bigint>, "
    "end_bytes array<bigint>, end_open array<boolean>"
)
_STATE = "is_open boolean, first bigint, last bigint, bytes bigint, seg_no bigint"
_STATE_COLUMNS = [c.split()[0] for c in _STATE.split(", ")]
_NUMBERED = f"{KEY} string, seq bigint, us bigint, n_bytes bigint, seg_no bigint"
_PLACE = f"{KEY} string, part bigint, block bigint"
_ROWS = "rows array<struct<us: bigint, seq: bigint, n_bytes: bigint>>"


def _blocked(limit: int):
    """Blocks of up to ``limit`` consecutive chunks of a session, from sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        held: pa.RecordBatch | None = None

        def packed(rows: pa.RecordBatch, starts: np.ndarray, end: int) -> pa.RecordBatch:
            nonlocal block
            numbers = pa.array(np.arange(block, block + len(starts)))
            block += len(starts)
            values = pa.StructArray.from_arrays([rows[c] for c in ("us", "seq", "n_bytes")], ["us", "seq", "n_bytes"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, end).astype(np.int32)), values)
            return pa.RecordBatch.from_arrays(
                [rows[KEY].take(pa.array(starts)), pa.array(np.full(len(starts), part)), numbers, lists],
                names=[KEY, "part", "block", "rows"],
            )

        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if not rows.num_rows:
                continue
            names = np.array(rows[KEY].to_pylist(), object)
            edge = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]])
            pieces = -(-np.diff(edge) // limit)
            within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts = np.repeat(edge[:-1], pieces) + limit * within
            if len(starts) > 1:
                yield packed(rows, starts[:-1], int(starts[-1]))
            held = rows.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            rows = pa.concat_batches([held])
            yield packed(rows, np.zeros(1, np.int64), rows.num_rows)

    return run


def _summaries(policy: PipePolicy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_pass_over(us, size, policy) for us, _, size in _blocks_of(batch)]
            if found:
                names = list(found[0])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in (KEY, "part", "block")],
                     *[pa.array([f[n] for f in found]) for n in names]],
                    [KEY, "part", "block", *names],
                )

    return run


def _cut(r: dict, state: tuple[int, int, int] | None, policy: PipePolicy) -> int:
    """Where the first segment starts in what ``r`` sums up, given the open one; n if nowhere."""
    if state is None or r["first"] - state[1] >= int(policy.silence * MICROS):
        return 0
    by_hold = int(np.searchsorted(r["head_us"], state[0] + int(policy.max_hold * MICROS)))
    by_size = int(np.searchsorted(r["head_before"], policy.max_bytes - state[2]))
    listed = min(by_hold, by_size)
    if listed < len(r["head_us"]):
        return listed
    return min(r["widest"], r["n"])


def _joined(a: dict, b: dict, policy: PipePolicy) -> dict:
    """The summary of what ``a`` and, right behind it, ``b`` sum up: the joining is associative."""
    begun, firsts, sizes, opens = [], [], [], []
    known: dict[tuple, int] = {}
    for i in range(len(a["head_us"])):
        state = (a["end_first"][i], a["last"], a["end_bytes"][i]) if a["end_open"][i] else None
        if state not in known:
            known[state] = _cut(b, state, policy)
        p = known[state]
        if p < b["n"]:
            begun.append(a["begun"][i] + b["begun"][p])
            firsts.append(b["end_first"][p])
            sizes.append(b["end_bytes"][p])
            opens.append(b["end_open"][p])
        else:
            begun.append(a["begun"][i])
            firsts.append(a["end_first"][i])
            sizes.append(a["end_bytes"][i] + b["bytes"])
            opens.append(sizes[-1] < policy.max_bytes)
    out = {
        "n": a["n"] + b["n"], "first": a["first"], "last": b["last"], "bytes": a["bytes"] + b["bytes"],
        "widest": a["widest"], "head_us": list(a["head_us"]), "head_before": list(a["head_before"]),
    }
    if a["widest"] >= a["n"]:  # a segment may pass over all of ``a``
        whole = (a["first"], a["last"], a["bytes"])
        p = _cut(b, whole if a["bytes"] < policy.max_bytes else None, policy)
        out["widest"] = a["n"] + p
        some = slice(0, min(p, len(b["head_us"]) - 1) + 1)
        out["head_us"] += b["head_us"][some]
        out["head_before"] += [a["bytes"] + x for x in b["head_before"][some]]
        begun += b["begun"][some]
        firsts += b["end_first"][some]
        sizes += b["end_bytes"][some]
        opens += b["end_open"][some]
    return out | {"begun": begun, "end_first": firsts, "end_bytes": sizes, "end_open": opens}


def _together(policy: PipePolicy):
    """One summary per session and range, from sorted ones of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        schema: pa.Schema | None = None
        for batch in batches:
            schema, done = batch.schema, []
            for r in batch.to_pylist():
                if now is None or (r[KEY], r["part"]) != (now[KEY], now["part"]):
                    if now is not None:
                        done.append(now)
                    now = r
                else:
                    now = {KEY: r[KEY], "part": r["part"], "block": r["block"]} | _joined(now, r, policy)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now], schema=schema)

    return run


def _chain(policy: PipePolicy, *keys: str):
    """The state each of the sorted summaries starts in, within equal ``keys``.

    The first one starts in the state of its columns ``in_…``, if it has any. One
    state is kept, so a session of any length passes in constant memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: tuple[int, int, int] | None = None
        seg_no = 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if tuple(r[k] for k in keys) != now:
                    now = tuple(r[k] for k in keys)
                    seg_no = r.get("in_seg_no") or 0
                    state = (r["in_first"], r["in_last"], r["in_bytes"]) if r.get("in_is_open") else None
                first, last, size = state or (0, 0, 0)
                out.append(
                    {KEY: r[KEY], "part": r["part"], "block": r["block"], "is_open": state is not None,
                     "first": first, "last": last, "bytes": size, "seg_no": seg_no}
                )
                p = _cut(r, state, policy)
                if p < r["n"]:
                    seg_no += r["begun"][p]
                    still, first, size = r["end_open"][p], r["end_first"][p], r["end_bytes"][p]
                else:
                    size += r["bytes"]
                    still = size < policy.max_bytes
                state = (first, r["last"], size) if still else None
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return run


def _number(policy: PipePolicy):
    """Segment numbers of each block's chunks from the state the block starts in."""

    silence, hold = int(policy.silence * MICROS), int(policy.max_hold * MICROS)

    def passed(us: np.ndarray, size: np.ndarray, e: dict) -> np.ndarray:
        """Segments that start in the block, up to each of its chunks."""
        if len(us) == 1:
            at = int(us[0])
            starts = not e["is_open"] or at - e["last"] >= silence or at - e["first"] >= hold
            return np.array([int(starts)], dtype=np.int64)
        cutter = Cutter(us, size, policy)
        nxt, _ = cutter.next_starts()
        state = (e["first"], e["last"], e["bytes"]) if e["is_open"] else None
        starts = np.array(cutter.starts(cutter.first_cut(state), nxt), dtype=np.int64)
        return np.searchsorted(starts, np.arange(len(us)), side="right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry = batch.select(_STATE_COLUMNS).to_pylist()
            found = [
                e["seg_no"] + passed(us, size, e)
                for (us, _, size), e in zip(_blocks_of(batch), entry, strict=True)
            ]
            if found:
                us, seq, size = (np.concatenate(x) for x in zip(*_blocks_of(batch), strict=True))
                owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(KEY).take(pa.array(owner)), pa.array(seq), pa.array(us),
                     pa.array(size), pa.array(np.concatenate(found))],
                    [c.split()[0] for c in _NUMBERED.split(", ")],
                )

    return run


def blocks(chunks: DataFrame, limit: int = BLOCK_CHUNKS, parts: int | None = None) -> DataFrame:
    """Times, numbers and sizes of the chunks, in rows of up to ``limit`` chunks of a session."""
    order = ("us", "seq")
    dealt = _ranges(_meta(chunks), parts, *order).sortWithinPartitions(KEY, *order, "n_bytes")
    return dealt.mapInArrow(_blocked(limit), f"{_PLACE}, {_ROWS}")


def segment_batch(
    chunks: DataFrame, policy: PipePolicy | None = None, limit: int = BLOCK_CHUNKS, parts: int | None = None
) -> DataFrame:
    """Adds ``seg_no`` (from 1 in each session) by silence, longest hold and size.

    Only times and sizes travel; the payload is joined later by ``segment_bytes``.
    A block is one row of up to ``limit`` chunks, whatever the session's rate;
    ``parts`` is the number of ranges, that of shuffle partitions by default.
    """
    policy = policy or PipePolicy()
    # A fixed number of tasks: the rows are few bytes but cost Python time, so
    # merging partitions by their size would leave most cores idle.
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: summaries and numbering need the same blocks, and the payload's
    # sizes are to be read only once.
    cut = written(blocks(chunks, limit, parts), "blocks")
    summaries = written(cut.mapInArrow(_summaries(policy), f"{_PLACE}, {_PASS}"), "summaries")
    by_range = (
        summaries.repartition(tasks, KEY, "part")
        .sortWithinPartitions(KEY, "part", "block")
        .mapInArrow(_together(policy), summaries.schema)
    )
    start = (
        by_range.repartition(tasks, KEY)
        .sortWithinPartitions(KEY, "part")
        .mapInArrow(_chain(policy, KEY), f"{_PLACE}, {_STATE}")
        .select(KEY, "part", *[F.col(c).alias(f"in_{c}") for c in _STATE_COLUMNS])
    )
    entry = (
        summaries.join(start, [KEY, "part"])
        .repartition(tasks, KEY, "part")
        .sortWithinPartitions(KEY, "part", "block")
        .mapInArrow(_chain(policy, KEY, "part"), f"{_PLACE}, {_STATE}")
    )
    numbered = cut.join(entry, [KEY, "part", "block"]).mapInArrow(_number(policy), _NUMBERED)
    return numbered.select(
        KEY, "seq", F.timestamp_micros("us").alias("ts"), "n_bytes", "seg_no"
    )


def segments(numbered: DataFrame) -> DataFrame:
    """Extent and size of every segment."""
    return numbered.groupBy(KEY, "seg_no").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum("n_bytes").alias("n_bytes"),
    )


def segment_bytes(chunks: DataFrame, numbered: DataFrame) -> DataFrame:
    """The joined payload of every segment, which the size cap keeps small."""
    parts = numbered.select(KEY, "seq", "seg_no").join(chunks, [KEY, "seq"])
    return parts.groupBy(KEY, "seg_no").agg(
        F.expr("listagg(data) within group (order by ts, seq)").alias("data"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n_chunks"),
    )


# --- characters cut in two ---------------------------------------------------
# Hex of one to three bytes that begin an unfinished UTF-8 character.
UNFINISHED = "(?:[C-F].|[EF].[89AB].|F.[89AB].[89AB].)$"
LOOK_BACK = 6


def utf8_carry(segs: DataFrame) -> DataFrame:
    """Move the bytes of an unfinished character to the next segment's front.

    Every segment sends its last bytes to the three segments behind it, so one
    grouping on (session, segment) decides what each holds back and receives; no
    task sees a whole session. A session's last segment holds nothing back.
    """
    tail = F.hex(F.substring("data", -LOOK_BACK // 2, LOOK_BACK // 2))
    rest = [c for c in segs.columns if c not in (KEY, "seg_no", "data")]
    own = F.struct("data", *rest)

    def send(d: int) -> Column:
        # The payload goes along once, to the segment itself.
        return F.struct(
            F.lit(d).alias("d"),
            (tail if d >= 0 else F.lit("")).alias("tail"),
            F.when(F.lit(d == 0), own).alias("own"),
        )

    sent = F.explode(F.array(*[send(d) for d in range(-1, 4)]))
    grouped = (
        segs.select(KEY, "seg_no", sent.alias("s"))
        .groupBy(KEY, (F.col("seg_no") + F.col("s.d")).alias("seg_no"))
        .agg(
            F.max("s.own").alias("own"),
            F.max(F.col("s.d") == -1).alias("has_next"),
            F.sort_array(F.collect_list(F.struct("s.d", "s.tail")), asc=False).alias("tails"),
        )
        .where(F.col("own").isNotNull())
    )

    def held(nearest: int) -> Column:
        parts = F.filter("tails", lambda s: (s["d"] >= nearest) & (s["d"] < nearest + 3))
        stream = F.right(F.array_join(parts["tail"], ""), F.lit(LOOK_BACK))
        return F.regexp_extract(stream, UNFINISHED, 0)

    return (
        grouped.select(
            KEY,
            "seg_no",
            F.concat(held(1), F.hex("own.data")).alias("hex"),
            F.when(F.col("has_next"), F.length(held(0))).otherwise(0).alias("kept"),
            *[F.col(f"own.{c}").alias(c) for c in rest],
        )
        .select(
            KEY,
            "seg_no",
            F.unhex(
                F.substring("hex", F.lit(1), F.length("hex") - F.col("kept"))
            ).alias("data"),
            *rest,
        )
        .where(F.octet_length("data") > 0)
    )


def segment_text(segs: DataFrame) -> DataFrame:
    """Decoded text of every segment."""
    return utf8_carry(segs).withColumn("text", decode_bytes(F.col("data"))).drop("data")
