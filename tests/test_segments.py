"""Batch segmentation against a row-by-row loop, for blocks and ranges of many sizes."""

import codecs
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logdistill.operators import segments as G
from logdistill.settings import PipePolicy

START = datetime(2024, 1, 1)


def loop(times, sizes, policy):
    """The rule as stated, one chunk after the other."""
    out, seg, first, last, held = [], 0, None, None, 0
    for t, n in zip(times, sizes):
        if first is None or t - last >= policy.silence or t - first >= policy.max_hold:
            seg, first, held = seg + 1, t, 0
        out.append(seg)
        last, held = t, held + n
        if held >= policy.max_bytes:
            first = None
    return out


@pytest.fixture(scope="module")
def feed(spark):
    rng = random.Random(7)
    rows, plain = [], {}
    for s, (n, step) in {"hot": (1500, 2), "calm": (60, 9), "busy": (300, 1), "one": (1, 1)}.items():
        t, times, sizes = 0.0, [], []
        for _ in range(n):
            t += rng.choice([0, 0.25, 0.5, 1, step, 2.0 if rng.random() < 0.2 else 0.25])
            times.append(t)
            sizes.append(rng.choice([1, 5, 20, 100]))
        plain[s] = (times, sizes)
        rows += [(s, i, START + timedelta(seconds=x), bytes(b), False) for i, (x, b) in enumerate(zip(times, sizes))]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "session_id string, seq long, ts timestamp, data binary, eof boolean"), plain


@pytest.mark.parametrize("limit,parts", [(1, 3), (7, 8), (100_000, 2)])
@pytest.mark.parametrize(
    "policy", [PipePolicy(2.0, 5.0, 10**9), PipePolicy(2.0, 5.0, 150), PipePolicy(9.5, 1e6, 90), PipePolicy(1e5, 30.0, 10**9)]
)
def test_greedy(spark, feed, limit, parts, policy):
    chunks, plain = feed
    got = {}
    for r in G.segment_batch(chunks, policy, limit, parts).collect():
        got.setdefault(r.session_id, {})[r.seq] = r.seg_no
    for s, (times, sizes) in plain.items():
        assert [got[s][i] for i in range(len(times))] == loop(times, sizes, policy), (s, limit)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_silence(spark, feed, parts):
    chunks, plain = feed
    got = {}
    for r in G.segment_silence(chunks, 2.0, parts).collect():
        got.setdefault(r.session_id, {})[r.seq] = r.run_no
    for s, (times, sizes) in plain.items():
        want = loop(times, sizes, PipePolicy(2.0, 1e9, 10**12))
        assert [got[s][i] for i in range(len(times))] == want


def test_a_burst_of_one_session_is_split(spark):
    """A third of the table in one second of one session: blocks and ranges stay small."""
    times = [i / 20_000 for i in range(10_000)]
    rows = [("burst", i, START + timedelta(seconds=t), b"x" * (1 + i % 9), False) for i, t in enumerate(times)]
    rows += [(f"s{i % 700}", i, START + timedelta(seconds=i), b"y", False) for i in range(20_000)]
    chunks = spark.createDataFrame(rows, "session_id string, seq long, ts timestamp, data binary, eof boolean").repartition(4)
    cut = G.blocks(chunks, 500, 16)
    sizes = cut.select("session_id", "part", F.size("rows").alias("n")).collect()
    assert max(r["n"] for r in sizes) <= 500 and sum(r["n"] for r in sizes) == 30_000
    assert len({r["part"] for r in sizes if r["session_id"] == "burst"}) > 4
    policy = PipePolicy(0.5, 0.1, 4_000)
    got = {r.seq: r.seg_no for r in G.segment_batch(chunks, policy, 500, 16).where("session_id = 'burst'").collect()}
    assert [got[i] for i in range(10_000)] == loop(times, [1 + i % 9 for i in range(10_000)], policy)
    assert G.segment_silence(chunks, 0.5, 16).where("session_id = 'burst'").agg(F.max("run_no")).first()[0] == 1


def test_session_windows_are_those_of_spark(spark, feed):
    chunks, _ = feed
    nulls = spark.createDataFrame(
        [(None, 1, START, b"a", False), (None, 2, START, None, True), ("calm", 0, None, b"b", False)], chunks.schema
    )
    chunks = chunks.unionByName(nulls)
    for gap in ("1 second", "2 seconds", "1500 milliseconds", "1 day"):
        spans = chunks.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_chunks"),
            F.sum(F.octet_length("data").cast("bigint")).alias("n_bytes"),
        ).drop("w")
        got = G.session_windows(chunks, gap, 5)
        assert got.columns == spans.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, spans.collect()))


def carry_loop(parts):
    """What the standard library's incremental decoder keeps back after each part."""
    out, held = [], b""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for p in parts:
        decoder.decode(p)
        data = held + p
        keep = decoder.getstate()[0]
        # bytes that no character starts with wait for their followers as well
        keep = keep or (data[-1:] if data[-1:] >= b"\xc0" else b"")
        if p is parts[-1]:
            keep = b""
        out.append(data[: len(data) - len(keep)])
        held = keep
    return out


def test_utf8_carry(spark):
    cases = {
        "emoji": [b"ok \xf0\x9f", b"\x98\x80 done"],
        "drops": [b"\xf0", b"\x9f", b"\x98", b"\x80", b"x"],
        "end": [b"a", b"b\xe2\x82"],
        "stray": [b"\xe2\x82\xac", b"\x80", b"\xff\xfe", b"z"],
        "plain": [b"abc", b"def"],
    }
    rng = random.Random(3)
    for k in range(20):
        raw = "aé€🙂z".encode() * 3
        cuts = sorted(rng.sample(range(1, len(raw)), 9))
        cases[f"r{k}"] = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
    rows = [(s, i + 1, p) for s, parts in cases.items() for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "session_id string, seg_no long, data binary")
    got = {(r.session_id, r.seg_no): bytes(r.data) for r in G.utf8_carry(df).collect()}
    for s, parts in cases.items():
        want = {(s, i + 1): p for i, p in enumerate(carry_loop(parts)) if p}
        assert {k: v for k, v in got.items() if k[0] == s} == want, s


def test_segment_text(spark):
    rows = [("s", i, START + timedelta(seconds=t), d, False)
            for i, (t, d) in enumerate([(0, b"a\xf0\x9f"), (1, b"\x98\x80b"), (9, b"caf\xe9"), (20, b"end")])]
    chunks = spark.createDataFrame(rows, "session_id string, seq long, ts timestamp, data binary, eof boolean")
    numbered = G.segment_batch(chunks, PipePolicy())
    text = G.segment_text(G.segment_bytes(chunks, numbered))
    got = [r.text for r in text.orderBy("seg_no").collect()]
    # The unfinished last byte of "caf\xe9" goes to the next segment.
    assert got == ["a\U0001f600b", "caf", "éend"]
    assert G.segments(numbered).count() == 3


def test_session_window_merges_at_the_gap(spark):
    rows = [("s", i, START + timedelta(seconds=t), b"x", False) for i, t in enumerate([0, 2, 5])]
    chunks = spark.createDataFrame(rows, "session_id string, seq long, ts timestamp, data binary, eof boolean")
    assert G.session_windows(chunks, "2 seconds").count() == 2
    assert G.segment_silence(chunks, 2.0).agg(F.max("run_no")).first()[0] == 3


def test_end_marks_and_empty_chunks_have_no_part(spark):
    rows = [("a", 1, 1.0, b"x", False), ("a", 2, 1.5, b"", False), ("a", 3, 2.0, b"y", False), ("a", 4, 9.0, None, True)]
    chunks = spark.createDataFrame(rows, "session_id string, seq long, t double, data binary, eof boolean").selectExpr(
        "session_id", "seq", "timestamp_micros(cast(t * 1000000 as bigint)) as ts", "data", "eof"
    )
    got = G.segment_silence(chunks, 2.0).collect()
    assert sorted((r.seq, r.run_no) for r in got) == [(1, 1), (3, 1)]
    assert G.segment_batch(chunks, PipePolicy(2.0, 100.0, 1000)).count() >= 1
