"""Streams fed in several micro-batches give what the batch operators give."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logdistill import schemas
from logdistill.operators import prune as P
from logdistill.operators import segments as G
from logdistill.settings import PipePolicy, TerminalPolicy
from logdistill.sources.tables import read_entries
from logdistill.streaming import segments as S
from logdistill.streaming import sinks

START = datetime(2024, 1, 1)
HDR = "Traceback (most recent call last):\n"


def rows(session, spec):
    """(seconds, bytes) pairs; data None marks the end."""
    return [
        (session, i, START + timedelta(seconds=t), d, d is None) for i, (t, d) in enumerate(spec)
    ]


class Replay:
    """A folder of files, a stream over it, and one run per file."""

    def __init__(self, spark, tmp_path, policy, watermark="0 seconds", forget=S.FORGET):
        self.spark, self.root = spark, tmp_path
        (tmp_path / "in").mkdir()
        source = spark.readStream.schema(schemas.CHUNK).parquet(f"{tmp_path}/in")
        self.cut = S.segment_stream(source, policy, watermark, forget)
        self.late = sinks.LateRows()

    def feed(self, data):
        df = self.spark.createDataFrame(data, schemas.CHUNK)
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        return self.run()

    def run(self):
        writer = self.cut.writeStream.format("parquet").option("path", f"{self.root}/out")
        self.spark.streams.addListener(self.late)
        q = sinks.drain(writer.option("checkpointLocation", f"{self.root}/state"))
        self.dropped = self.late.of(q)
        self.spark.streams.removeListener(self.late)
        reports = [op for p in q.recentProgress for op in p.stateOperators]
        self.kept = reports[-1].numRowsTotal if reports else None
        return self.segments()

    def segments(self):
        out = self.spark.read.schema(schemas.SEGMENT).parquet(f"{self.root}/out")
        return {(r.session_id, r.seg_no): bytes(r.data) for r in out.collect()}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    policy = PipePolicy(2.0, 5.0, 60)
    spec = {}
    for s in "abc":
        t, chunks = 0.0, []
        for _ in range(40):
            t += rng.choice([0.0, 0.25, 0.5, 1.0, 2.0, 6.0])
            chunks.append((t, bytes(rng.choice(b"xyz") for _ in range(rng.randint(1, 25)))))
        spec[s] = chunks
    full = [r for s, c in spec.items() for r in rows(s, c)]
    replay = Replay(spark, tmp_path, policy, "1000 seconds")
    for part in (lambda r: r[1] < 13, lambda r: 13 <= r[1] < 30, lambda r: r[1] >= 30):
        replay.feed([r for r in full if part(r)])
    ends = [(s, 99, START + timedelta(seconds=c[-1][0]), None, True) for s, c in spec.items()]
    got = replay.feed(ends)
    chunks = spark.createDataFrame(full, schemas.CHUNK)
    whole = G.segment_bytes(chunks, G.segment_batch(chunks, policy, 4))
    assert got == {(r.session_id, r.seg_no): bytes(r.data) for r in whole.collect()}


@pytest.mark.parametrize("policy", [PipePolicy(2.0, 5.0, 60), TerminalPolicy(2.0, 4, 400)])
def test_order_of_arrival_does_not_matter_within_the_watermark(spark, tmp_path, policy):
    rng = random.Random(11)
    words = ("caf\u00e9\n", "\U0001f600 x\n", "a\n b\n", "go? [Y/n] ", HDR, "KeyError: 1\n")
    spec, t = {}, 0.0
    for s in "ab":
        text = "".join(rng.choice(words) for _ in range(60)).encode()
        chunks, at, t = [], 0, 0.0
        while at < len(text):
            t += rng.choice([0.0, 0.25, 0.5, 1.0, 2.0])
            n = rng.randint(1, 9)
            chunks.append((t, text[at : at + n]))
            at += n
        spec[s] = chunks
    full = [r for s, c in spec.items() for r in rows(s, c)]
    ends = [(s, 999, START + timedelta(seconds=c[-1][0]), None, True) for s, c in spec.items()]
    sides = {}
    for name in ("sorted", "mixed"):
        (tmp_path / name).mkdir()
        replay = Replay(spark, tmp_path / name, policy, "8 seconds")
        # chunks may come up to 6 seconds late, over many micro-batches
        late = {id(r): (r[2] - START).total_seconds() + (name == "mixed") * rng.uniform(0, 6) for r in full}
        came = sorted(full, key=lambda r: late[id(r)])
        step = len(came) // 4 + 1
        for i in range(0, len(came), step):
            replay.feed(came[i : i + step])
            assert replay.dropped == 0
        sides[name] = replay.feed(ends)
    assert sides["mixed"] == sides["sorted"]
    if isinstance(policy, PipePolicy):
        chunks = spark.createDataFrame(full, schemas.CHUNK)
        whole = G.utf8_carry(G.segment_bytes(chunks, G.segment_batch(chunks, policy, 4)))
        assert sides["mixed"] == {(r.session_id, r.seg_no): bytes(r.data) for r in whole.collect()}


def test_idle_sessions_leave_the_state(spark, tmp_path):
    replay = Replay(spark, tmp_path, PipePolicy(), "1 second", forget=10.0)
    for hour in range(3):
        names = [f"h{hour}-{i}" for i in range(10)]
        replay.feed([(s, 0, START + timedelta(hours=hour), b"x\xe2", False) for s in names])
        assert replay.kept == 20  # a row and a list of waiting chunks each
    got = replay.feed([("end", 0, START + timedelta(hours=9), b"z", False)])
    assert replay.kept == 2
    # the unfinished character goes out as its session is forgotten
    assert got[("h0-0", 1)] == b"x" and got[("h0-0", 2)] == b"\xe2" and len(got) == 60


def test_numbers_begin_again_after_the_time_to_forget(spark, tmp_path):
    """Whether the session left the state in between or not."""
    at = [0, 20, 30, 61, 64, 70]
    data = [("a", i, START + timedelta(seconds=t), b"%d" % t, False) for i, t in enumerate(at)]
    tail = [("a", 9, START + timedelta(seconds=70), None, True)]
    seen = []
    for name, parts in (("once", [data + tail]), ("many", [data[:2], data[2:4], data[4:] + tail])):
        (tmp_path / name).mkdir()
        replay = Replay(spark, tmp_path / name, PipePolicy(), "1 second", forget=15.0)
        for part in parts:
            replay.feed(part)
        out = spark.read.schema(schemas.SEGMENT).parquet(f"{tmp_path}/{name}/out").collect()
        seen.append(sorted((r.first_ts, r.seg_no, bytes(r.data)) for r in out))
    assert seen[0] == seen[1]
    assert [r[1] for r in seen[0]] == [1, 1, 2, 1, 2, 3]


def test_a_chunk_after_the_end_has_a_number_of_its_own(spark, tmp_path):
    replay = Replay(spark, tmp_path, PipePolicy(), "20 seconds")
    assert replay.feed(rows("a", [(10, b"one"), (11, None)])) == {("a", 1): b"one"}
    got = replay.feed([("a", 9, START + timedelta(seconds=5), b"late", False)])
    got = replay.feed([("b", 0, START + timedelta(seconds=90), b"on", False)])
    assert got == {("a", 1): b"one", ("a", 2): b"late"}


def test_silence_flushes_without_a_further_chunk(spark, tmp_path):
    replay = Replay(spark, tmp_path, PipePolicy())
    assert replay.feed(rows("a", [(0, b"one"), (1, b"two")])) == {}
    # Another session moves the watermark on; the next trigger flushes the first.
    replay.feed(rows("b", [(60, b"later")]))
    assert replay.run().get(("a", 1)) == b"onetwo"


def test_late_chunks_are_dropped(spark, tmp_path):
    replay = Replay(spark, tmp_path, PipePolicy())
    replay.feed(rows("a", [(100, b"now")]))
    replay.feed(rows("b", [(1, b"late")]))
    assert replay.dropped == 1
    replay.feed([("b", 9, START + timedelta(seconds=300), None, True)])
    assert not any(k[0] == "b" for k in replay.segments())


def test_characters_are_not_cut(spark, tmp_path):
    replay = Replay(spark, tmp_path, PipePolicy(), "100 seconds")
    got = replay.feed(rows("a", [(0, b"ok \xf0\x9f"), (9, b"\x98\x80 done"), (20, b"tail\xe2"), (21, None)]))
    assert got == {("a", 1): b"ok ", ("a", 2): "\U0001f600 done".encode(), ("a", 3): b"tail\xe2"}


def test_terminal_rule(spark, tmp_path):
    policy = TerminalPolicy(silence=0.15, min_lines=3, max_bytes=400)
    open_tb = HDR.encode() + b'  File "a.py", line 1, in f\n    x()\n'
    spec = {
        "prompt": [(0, b"a\n"), (0.01, b"go? [Y/n] "), (0.02, b"b\n"), (0.03, None)],
        "lines": [(0, b"1\n2\n"), (0.1, b"3\n"), (0.11, b"4\n"), (0.12, None)],
        "quiet": [(0, b"1\n"), (0.15, b"2\n"), (0.29, b"3\n"), (0.3, None)],
        "tb": [(0, open_tb), (0.01, open_tb[len(HDR):]), (0.02, b"KeyError: 1\n"), (0.03, b"x\n"), (0.04, None)],
        "cap": [(0, open_tb), (0.01, open_tb[len(HDR):] * 10), (0.02, b"x\n"), (0.03, None)],
    }
    replay = Replay(spark, tmp_path, policy, "100 seconds")
    got = replay.feed([r for s, c in spec.items() for r in rows(s, c)])
    by = lambda s: [got[k] for k in sorted(got) if k[0] == s]
    assert by("prompt") == [b"a\ngo? [Y/n] ", b"b\n"]
    assert by("lines") == [b"1\n2\n3\n", b"4\n"]
    assert by("quiet") == [b"1\n", b"2\n3\n"]
    assert by("tb") == [open_tb + open_tb[len(HDR):] + b"KeyError: 1\n", b"x\n"]
    assert by("cap") == [open_tb + open_tb[len(HDR):] * 10, b"x\n"]


class Memory:
    """One session's states in memory, counting the bytes that go in and out of the lists."""

    def __init__(self):
        self.value, self.rows, self.timers, self.moved, self.reads = None, [], set(), 0, 0

    getValueState = getListState = lambda self, name, schema: self if name == "open" else Listed(self)
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    registerTimer = lambda self, at: self.timers.add(at)
    deleteTimer = lambda self, at: self.timers.discard(at)

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Listed:
    def __init__(self, memory):
        self.memory, self.rows = memory, []

    def get(self):
        self.memory.moved += sum(len(r[-1]) for r in self.rows)
        self.memory.reads += 1
        return iter(list(self.rows))

    def put(self, rows):
        self.rows = []
        self.appendList(rows)

    def appendList(self, rows):
        self.memory.moved += sum(len(r[-1]) for r in rows)
        self.rows += rows

    def appendValue(self, row):
        self.appendList([row])

    def clear(self):
        self.rows = []


@pytest.mark.parametrize("policy", [PipePolicy(9.0, 1e6, 10**9), TerminalPolicy(9.0, 10**9, 10**9)])
def test_an_open_segment_costs_what_each_batch_brings(policy):
    """10,000 chunks of one open segment in 100 batches: each byte moves a few times, not once a batch."""
    from pyspark.sql.streaming.stateful_processor import TimerValues

    memory = Memory()
    cutter = S.Segments(policy)
    cutter.init(memory)
    chunk = b"a line of output\n"
    at = 0
    for batch in range(100):
        times = [START + timedelta(seconds=at + i) for i in range(100)]
        at += 100
        pdf = pd.DataFrame({"seq": range(batch * 100, batch * 100 + 100), "ts": times, "data": [chunk] * 100, "eof": False})
        now = TimerValues(-1, int((times[-1] - datetime(1970, 1, 1)).total_seconds() * 1000) - 3_000)
        assert not list(cutter.handleInputRows(("s",), iter([pdf]), now))
        assert len(memory.timers) == 1 and sum(map(len, map(str, memory.value))) < 300
    assert memory.moved < 4 * 10_000 * len(chunk)
    late = TimerValues(-1, now.getCurrentWatermarkInMs() + 60_000)
    (out,) = cutter.handleInputRows(("s",), iter([]), late)
    assert out["n_chunks"].tolist() == [10_000] and out["data"][0] == chunk * 10_000
    assert memory.moved < 5 * 10_000 * len(chunk)


@pytest.fixture()
def segment_files(spark, tmp_path):
    flood = b"same line again\n" * 40
    data = [
        ("a", 1, START, START, 1, len(flood), flood),
        ("a", 2, START, START + timedelta(seconds=9), 1, 4, b"caf\xe9"),
        ("b", 1, START, START + timedelta(seconds=5), 1, 9, b"z" * 2000),
    ]
    spark.createDataFrame(data, schemas.SEGMENT).write.parquet(f"{tmp_path}/segments")
    return spark.readStream.schema(schemas.SEGMENT).parquet(f"{tmp_path}/segments")


def test_archive_sink(spark, tmp_path, segment_files):
    path = f"{tmp_path}/archive"
    writer = sinks.archive_sink(segment_files, path, f"{tmp_path}/state", cap=1000)
    sinks.drain(writer)
    got = {r.id: r for r in read_entries(spark, path).orderBy("id").collect()}
    assert [(r.session_id, r.was_pruned) for r in got.values()] == [("a", True), ("a", False)]
    assert got[1].compressed_summary.startswith("[Repetitive output: 40 total") and got[2].raw_content == "café"
    assert got[1].token_estimate == 160 and list(got) == [1, 2]
    # Another stream into the same archive: both keep their entries.
    sinks.drain(sinks.archive_sink(segment_files, path, f"{tmp_path}/other", cap=1000))
    both = read_entries(spark, path)
    assert both.count() == 4 and both.select("id").distinct().count() == 4
    # The first one goes on where it was: nothing is archived twice.
    sinks.drain(sinks.archive_sink(segment_files, path, f"{tmp_path}/state", cap=1000))
    assert read_entries(spark, path).count() == 4


class Broken(P.Pruner):
    name = "broken"

    def compress(self, c):
        return F.raise_error(F.lit("no"))


def test_a_failing_pruner_leaves_the_raw_text(spark, tmp_path, segment_files):
    path = f"{tmp_path}/archive"
    sinks.drain(sinks.archive_sink(segment_files, path, f"{tmp_path}/state", pruners=[Broken()]))
    got = read_entries(spark, path).collect()
    assert len(got) == 3 and not any(r.was_pruned for r in got)


class Picky(P.Pruner):
    """Fails for texts with an ``é``."""

    name = "picky"

    def compress(self, c):
        return F.when(c.contains("é"), F.raise_error(F.lit("no"))).otherwise(F.lit("short"))


def test_only_the_failing_texts_of_a_batch_stay_raw(spark, tmp_path):
    at = datetime(2024, 1, 1)
    data = [
        ("a", 1, at, at, 1, 9, b"line\n" * 40),
        ("a", 2, at, at, 1, 9, "é\n".encode() * 40),
        ("b", 1, at, at, 1, 9, b"other\n" * 40),
    ]
    spark.createDataFrame(data, schemas.SEGMENT).coalesce(1).write.parquet(f"{tmp_path}/segments")
    stream = spark.readStream.schema(schemas.SEGMENT).parquet(f"{tmp_path}/segments")
    path = f"{tmp_path}/archive"
    sinks.drain(sinks.archive_sink(stream, path, f"{tmp_path}/state", pruners=[Picky()]))
    got = {(r.raw_content[:1], r.was_pruned, r.compressed_summary) for r in read_entries(spark, path).collect()}
    assert got == {("l", True, "short"), ("é", False, ""), ("o", True, "short")}


def test_a_failure_ends_the_chain_and_none_does_not(spark):
    rows = [(1, "é\n" * 40), (2, "line\n" * 40), (3, None), (4, ""), (5, "few")]
    texts = spark.createDataFrame(rows, "id int, raw_content string")

    class Mute(P.Pruner):
        name = "mute"

        def compress(self, c):
            return F.lit(None).cast("string")

    python = P.python_pruner(lambda t: True, lambda t: "py", "py")
    for chain, want in (
        ([Picky(), P.OutputPruner()], {1: None, 2: "picky", 3: None, 4: None, 5: None}),
        ([Mute(), P.OutputPruner()], {1: "output", 2: "output", 3: None, 4: None, 5: None}),
        ([Picky(), python], {1: None, 2: "picky", 3: None, 4: None, 5: None}),
        ([Mute(), python], {1: "py", 2: "py", 3: None, 4: None, 5: None}),
    ):
        got = {r.id: r for r in P.prune(texts, chain).collect()}
        assert {i: r.pruner_name for i, r in got.items()} == want
        assert all(r.was_pruned == (r.pruner_name is not None) for r in got.values())


def test_live_counters_add_up_over_batches(spark, tmp_path):
    schema = "session_id string, raw_content string"
    flood = "same line again\n" * 40
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for part in ([("a", flood), ("b", "x")], [("a", flood), ("a", "yy")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        writer = sinks.follow(sinks.live_stats(stream, "LD"), f"{tmp_path}/out", f"{tmp_path}/state")
        sinks.drain(writer)
    got = {r.session_id: r for r in sinks.latest(spark, f"{tmp_path}/out").collect()}
    assert (got["a"].bytes_read, got["a"].pruner_hits) == (2 * len(flood) + 2, 2)
    assert (got["b"].bytes_read, got["b"].pruner_hits, got["b"].tokens_saved) == (1, 0, 0)
    assert got["a"].tokens_saved == 2 * ((len(flood) - len("[Repetitive output: 40 total line(s), 1 unique]\n  ×    40  same line again")) // 4)


def test_rows_are_cut_as_frames_are_without_making_any(monkeypatch):
    """Chunks as rows, two micro-batches a session, give what the same chunks as frames give."""
    from datetime import timezone

    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import TimerValues

    chunk = Row("seq", "ts", "data", "eof")
    spec = [[(0, b"a\xc3"), (1, b"\xa9b")], [(9, b""), (9, None), (20, b"c"), (21, None)]]
    batches = [
        [chunk(i, START + timedelta(seconds=t), d, d is None and t > 20) for i, (t, d) in enumerate(part)] for part in spec
    ]
    now = int((START - datetime(1970, 1, 1)).total_seconds() * 1000)
    frames, by_frames = Memory(), S.Segments(PipePolicy())
    by_frames.init(frames)
    want = []
    for at, part in zip((2, 30), batches, strict=True):
        pdf = pd.DataFrame([r.asDict() for r in part])
        for out in by_frames.handleInputRows(("s",), iter([pdf]), TimerValues(-1, now + at * 1000)):
            want += [tuple(r)[:2] + tuple(r)[4:] for r in out.itertuples(index=False)]
    monkeypatch.delattr(pd, "DataFrame")
    plain, by_rows, got = Memory(), S.RowSegments(PipePolicy()), []
    by_rows.init(plain)
    for at, part in zip((2, 30), batches, strict=True):
        aware = [chunk(r.seq, r.ts.replace(tzinfo=timezone.utc), r.data, r.eof) for r in part]
        told = list(by_rows.handleInputRows(("s",), iter(aware), TimerValues(-1, now + at * 1000)))
        assert all(r.first_ts.tzinfo and r.first_ts <= r.last_ts for r in told)
        got += [tuple(r)[:2] + tuple(r)[4:] for r in told]
    assert got == want and [r[-1] for r in got] == ["aéb".encode(), b"c"]
    assert plain.value == frames.value and plain.timers == frames.timers


def test_the_zone_of_the_session_does_not_move_chunks(spark, tmp_path):
    """Five hours behind UTC a chunk waits for the watermark all the same."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        replay = Replay(spark, tmp_path, PipePolicy(), "100 seconds")
        assert replay.feed(rows("a", [(0, b"one"), (1, b"two")])) == {}
        assert replay.feed(rows("a", [(50, b"three")])) == {}
        assert replay.feed(rows("a", [(2, b"late")]) + rows("a", [(60, None)])) == {
            ("a", 1): b"onetwolate", ("a", 2): b"three"
        }
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
