"""Sessions, entries, integrity and recall on small tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from logdistill import schemas
from logdistill.operators import archive as A
from logdistill.operators import search
from logdistill.operators import commands, lines, recall
from logdistill.shared import create_once, shared_dir
from logdistill.sources.tables import read_entries, read_session_log, read_sessions


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame(
        [("old", "make", 1000.0, 1010.0, 5), ("new", "pytest \x1b[1m-q", 2000.0, None, 0), ("tie", "ls", 2000.0, 0.0, 0)],
        schemas.SESSION,
    )


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(
        [
            (1, "old", 1001.0, "stdout", "needle \x1b[31mone\x1b[0m", "", 100, False),
            (2, "old", 1002.0, "stdout", "x" * 400, "sum", 80, True),
            (3, "new", 2001.0, "stdout", "needle two", "", 20, False),
        ],
        schemas.ENTRY,
    )


def test_append_numbers_on_and_a_repeated_commit_replaces_itself(spark, tmp_path):
    path = str(tmp_path)
    batch = lambda n, t: spark.createDataFrame(
        [("s", i, float(t + i % 3), "stdout", f"text {t} {i}", "", 1, False) for i in range(n)],
        "session_id string, seq long, timestamp double, entry_type string, raw_content string, "
        "compressed_summary string, token_estimate long, was_pruned boolean",
    )
    A.append_entries(batch(50, 0), path, "a")
    A.append_entries(batch(25, 100), path, "b")
    first = {r.id: r.raw_content for r in read_entries(spark, path).collect()}
    assert sorted(first) == list(range(1, 76))
    A.append_entries(batch(25, 100), path, "b")
    assert {r.id: r.raw_content for r in read_entries(spark, path).collect()} == first
    ordered = [first[i] for i in range(1, 51)]
    assert ordered == [f"text 0 {i}" for i in sorted(range(50), key=lambda i: (i % 3, i))]


def _lines(spark, writer, n):
    return spark.range(n).select(
        F.lit(writer).alias("session_id"),
        F.col("id").alias("seq"),
        F.col("id").cast("double").alias("timestamp"),
        F.lit("stdout").alias("entry_type"),
        F.concat(F.lit(f"{writer} "), "id").alias("raw_content"),
    )


@pytest.mark.parametrize("n", [50, 25])
def test_writers_at_the_same_time_share_no_id(spark, tmp_path, n):
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda w: A.append_entries(_lines(spark, f"w{w}", n), str(tmp_path)), range(8)))
    got = read_entries(spark, str(tmp_path)).collect()
    assert sorted(r.id for r in got) == list(range(1, 8 * n + 1))
    assert {r.raw_content for r in got} == {f"w{w} {i}" for w in range(8) for i in range(n)}


def test_a_lost_writer_and_an_archive_without_claims(spark, tmp_path):
    path = str(tmp_path)
    old = _lines(spark, "old", 3).withColumn("id", F.col("seq") + 5)
    old.drop("seq").write.parquet(f"{path}/entries/commit=old")
    assert A.claim_ids(spark, path, "new", 4) == 7
    assert A.claim_ids(spark, path, "next", 2) == 11
    assert A.claim_ids(spark, path, "new", 4) == 7  # again, the same ids
    assert A.claim_ids(spark, path, "new", 5) == 13  # grown: new ones
    assert create_once(spark, f"{path}/ids/{18:020d}")  # lost before it told its size
    assert not create_once(spark, f"{path}/ids/{18:020d}")
    assert A.claim_ids(spark, path, "after", 1) == 18 + A.UNTOLD


def test_append_leaves_no_scratch(spark, tmp_path):
    before = set(os.listdir(shared_dir(spark)))
    A.append_entries(_lines(spark, "w", 5), str(tmp_path))
    assert set(os.listdir(shared_dir(spark))) == before


def test_hot_session_is_numbered_by_many_tasks(spark):
    df = spark.range(20_000).select(
        F.lit("hot").alias("session_id"), (F.col("id") % 7).cast("double").alias("timestamp"), F.col("id").alias("seq")
    )
    got = A.assign_ids(df).cache()
    assert got.select("id").distinct().count() == 20_000
    assert got.agg(F.min("id"), F.max("id")).first()[:] == (1, 20_000)
    first = got.orderBy("id").first()
    assert (first.timestamp, first.seq) == (0.0, 0)
    got.unpersist()


def test_sessions_read_back(spark, sessions, tmp_path):
    sessions.write.parquet(f"{tmp_path}/sessions")
    assert read_sessions(spark, str(tmp_path)).count() == 3


def test_create_sessions(spark):
    cmds = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "agent_command string, started_at double")
    assert A.create_sessions(cmds).select("session_id").distinct().count() == 2
    one, two = (A.create_sessions(cmds, deterministic=True).collect() for _ in range(2))
    assert one == two and one[0].total_tokens_saved == 0 and one[0].ended_at is None


def test_ensure_keeps_the_first_command(spark, sessions):
    new = spark.createDataFrame(
        [("old", "other", 1.0), ("fresh", "second", 9.0), ("fresh", "first", 8.0)],
        "session_id string, agent_command string, started_at double",
    )
    got = {r.session_id: r.agent_command for r in A.ensure_sessions(sessions, new).collect()}
    assert got == {"old": "make", "new": "pytest \x1b[1m-q", "tie": "ls", "fresh": "first"}


def test_close_takes_the_latest(spark, sessions):
    closes = spark.createDataFrame(
        [("new", 2100.0, 7), ("new", 2200.0, 9), ("ghost", 1.0, 1)], "session_id string, ended_at double, tokens_saved long"
    )
    got = {r.session_id: (r.ended_at, r.total_tokens_saved) for r in A.close_sessions(sessions, closes).collect()}
    assert got == {"old": (1010.0, 5), "new": (2200.0, 9), "tie": (0.0, 0)}


def test_session_log(spark, tmp_path):
    events = [
        ("s", "open", 5.0, "second", None), ("s", "open", 1.0, "first", None), ("s", "close", 9.0, None, 4),
        ("s", "close", 8.0, None, 3), ("t", "open", 2.0, "only", None), ("ghost", "close", 1.0, None, 1),
    ]
    for commit, part in (("a", events[:3]), ("b", events[3:]), ("b", events[3:])):
        A.append_session_events(spark.createDataFrame(part, schemas.SESSION_EVENT), str(tmp_path), commit)
    got = {r.session_id: tuple(r)[1:] for r in A.fold_sessions(read_session_log(spark, str(tmp_path))).collect()}
    assert got == {"s": ("first", 1.0, 9.0, 4), "t": ("only", 2.0, None, 0)}


def test_stats_with_zeros_for_an_empty_session(entries, sessions):
    got = {r.session_id: tuple(r)[1:] for r in A.session_stats(entries, sessions).collect()}
    assert got == {"old": (2, 1, 180, 80), "new": (1, 0, 20, 0), "tie": (0, 0, 0, 0)}


def test_kept_totals_equal_a_rescan(spark, sessions, tmp_path):
    path = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(
        [(s, i, float(i), "stdout", "x", "", n, p) for i, (s, n, p) in enumerate(r)],
        "session_id string, seq int, " + ", ".join(schemas.ENTRY.split(", ")[2:]),
    )
    note = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id bigint")

    def agree():
        rescan = A.session_stats(read_entries(spark, path), sessions).collect()
        assert sorted(A.stored_stats(spark, path, sessions).collect()) == sorted(rescan)

    A.append_entries(rows(("old", 5, True), ("old", 7, False), ("new", None, None), (None, 3, True)), path, "a")
    agree()
    A.append_entries(rows(("old", 11, True), ("stray", 2, True)), path, "b")
    A.append_entries(rows(("old", 11, True), ("new", 2, True)), path, "b")  # replaces itself
    agree()
    A.mark_deleted(note(1, 4, 5, 99), path, "x")
    A.mark_deleted(note(1, 4, 5, 99), path, "x")
    agree()
    A.mark_deleted(note(1, 2), path, "y")  # 1 is gone already
    agree()
    A.mark_deleted(note(), path, "z")
    agree()
    A.append_entries(rows(("old", 13, True)), path, "c")
    agree()


def test_sessions_deleted_in_the_archive(spark, sessions, entries, tmp_path):
    path = str(tmp_path)
    A.append_sessions(sessions.where("session_id = 'old'"), path, "a")
    A.append_sessions(sessions.unionByName(sessions), path, "b")
    A.append_sessions(sessions.unionByName(sessions), path, "b")
    assert sorted(read_sessions(spark, path).collect()) == sorted(sessions.collect())
    events = sessions.select(
        "session_id", F.lit("open").alias("kind"), F.col("started_at").alias("event_ts"), "agent_command",
        F.lit(0).cast("bigint").alias("tokens_saved"),
    )
    A.append_session_events(events, path, "a")
    A.append_entries(entries.drop("id").withColumn("seq", F.lit(1)), path, "a", index=("raw_content",))
    gone = spark.createDataFrame([("old",), ("ghost",), (None,)], "session_id string")
    for _ in range(2):
        A.delete_sessions(gone, path, "d")
    for table in (read_entries(spark, path), read_sessions(spark, path), read_session_log(spark, path)):
        assert "old" not in {r.session_id for r in table.collect()} and not table.isEmpty()
    postings, documents = search.read_index(spark, path)
    assert {r.entry_id for r in postings.collect()} == {r.entry_id for r in documents.collect()} == {3}
    A.append_sessions(sessions, path, "c")
    assert {r.session_id for r in read_sessions(spark, path).collect()} == {"new", "tie"}
    assert A.fk_orphans(read_entries(spark, path), read_sessions(spark, path)).isEmpty()


def test_cost(spark, entries, sessions):
    counters = spark.createDataFrame([("old", 60)], "session_id string, tokens_saved long")
    got = {r.session_id: r for r in A.session_cost(A.session_stats(entries, sessions), counters).collect()}
    assert set(got) == {"old", "new"}
    assert got["old"].saved_pct == 75.0 and got["old"].saved_usd == pytest.approx(60 / 1e6 * 3)
    assert got["new"].net_tokens_saved == 0 and got["new"].saved_pct == 0.0


def test_integrity(entries, sessions):
    assert A.check_fk(entries, sessions) is entries
    known = sessions.where("session_id <> 'new'")
    assert [r.id for r in A.fk_orphans(entries, known).collect()] == [3]
    with pytest.raises(ValueError, match="sessions"):
        A.check_fk(entries, known)


def test_deletes(spark, entries, sessions):
    ids = spark.createDataFrame([(1,), (99,)], "id long")
    postings = spark.createDataFrame([("needle", 1), ("needle", 3)], "term string, entry_id long")
    e, p = A.delete_entries(entries, postings, ids)
    assert {r.id for r in e.collect()} == {2, 3} and {r.entry_id for r in p.collect()} == {3}
    gone = spark.createDataFrame([("old",)], "session_id string")
    e, s = A.delete_session_cascade(entries, sessions, gone)
    assert {r.id for r in e.collect()} == {3} and {r.session_id for r in s.collect()} == {"new", "tie"}


def test_index_follows_appends_and_deletes(spark, tmp_path):
    path = str(tmp_path)
    columns = ("raw_content", "compressed_summary")
    schema = "session_id string, seq long, timestamp double, raw_content string, compressed_summary string"

    def append(commit, *texts):
        rows = [("s", i, float(i), t, "") for i, t in enumerate(texts)]
        A.append_entries(spark.createDataFrame(rows, schema), path, commit, columns)

    def found(word):
        ranked = search.rank_postings(*search.read_index(spark, path), search.term(word))
        return {r.entry_id: round(r["rank"], 9) for r in ranked.collect()}

    def direct(word):
        ranked = search.rank_entries(read_entries(spark, path), search.term(word), columns)
        return {r.entry_id: round(r["rank"], 9) for r in ranked.collect()}

    append("one", "lost needle", "hay", "more hay and hay")
    append("two", "needle", "straw")
    append("two", "needle", "straw")  # again: it replaces itself
    assert set(found("needle")) == {1, 4} and found("needle") == direct("needle")
    A.mark_deleted(spark.createDataFrame([(4,), (5,), (99,)], "id long"), path)
    A.mark_deleted(read_entries(spark, path).where("raw_content = 'hay'").select("id"), path)
    assert {r.id for r in read_entries(spark, path).collect()} == {1, 3}
    assert set(found("needle")) == {1} and found("hay") == direct("hay") and set(found("hay")) == {3}
    append("three", "new")  # a deleted id is not given again
    assert {r.id for r in read_entries(spark, path).collect()} == {1, 3, 6}


def test_lists(entries, sessions):
    assert [r.session_id for r in A.list_sessions(sessions).collect()] == ["new", "tie", "old"]
    assert [r.id for r in A.recent_entries(entries, "old", 1).collect()] == [2]
    assert {r.id for r in A.recent_entries(entries, limit=1).collect()} == {2, 3}


def test_stats_scan_reads_no_text(spark, entries, sessions, tmp_path):
    entries.write.parquet(f"{tmp_path}/e")
    stored = spark.read.parquet(f"{tmp_path}/e")
    plan = A.session_stats(stored, sessions)._jdf.queryExecution().executedPlan().toString()
    assert "raw_content" not in plan


def test_lookups_skip_files(spark, tmp_path):
    """Sessions named around the wanted one are in every file, itself only in one."""
    path = str(tmp_path)
    rows = spark.range(20_000).select(
        F.when(F.col("id") == 7_000, "m").otherwise(F.concat(F.lit("m"), F.col("id") % 500)).alias("session_id"),
        F.col("id").alias("seq"), F.col("id").cast("double").alias("timestamp"), F.lit("stdout").alias("entry_type"),
        F.lit("text").alias("raw_content"),
    )
    rows = rows.withColumn("session_id", F.when(F.col("seq") % 500 == 1, "a").otherwise(F.col("session_id")))
    small = "spark.sql.adaptive.coalescePartitions.enabled"  # keep the small ranges apart
    spark.conf.set(small, "false")
    try:
        A.append_entries(rows, path, "all")
    finally:
        spark.conf.unset(small)
    files = len([f for f in os.listdir(f"{path}/entries/commit=all") if f.endswith(".parquet")])
    assert files > 4

    def read(df):
        got = df.collect()
        return got, df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()

    stored = read_entries(spark, path)
    got, n = read(stored.where("session_id = 'm'"))
    assert [r.id for r in got] == [7_001] and n < 20_000 / files * 2
    got, n = read(recall.recall_by_id(stored, [3, 19_000]))
    assert {r.id for r in got} == {3, 19_000} and n < 20_000 / files * 3
    recent = A.recent_entries(stored, "m3").select("id").collect()
    assert [r.id for r in recent] == [i for i in range(20_000, 0, -1) if i % 500 == 4][:50]


def test_recall(spark, entries, sessions):
    handles = spark.createDataFrame([(1,), (50,)], "id long")
    got = {r.id: r.raw_content for r in recall.recall_by_id(entries, handles).collect()}
    assert got == {1: "needle \x1b[31mone\x1b[0m", 50: None}
    assert [r.id for r in recall.recall_by_id(entries, [3]).collect()] == [3]
    clean, raw = (recall.recall_view(entries, raw=x).where("id = 1").first() for x in (False, True))
    assert clean.content == "needle one" and raw.content == "needle \x1b[31mone\x1b[0m"
    assert clean.time == "1970-01-01 00:16:41" and clean.session == "old"


def test_scope(spark, entries, sessions):
    scope = lambda **k: {r.session_id for r in recall.in_scope(entries, sessions, **k).collect()}
    assert scope() == {"new"}
    assert scope(explicit="old", current="new") == {"old"}
    assert scope(current="old") == {"old"} and scope(current="ghost") == {"new"}
    assert scope(all_sessions=True) == {"old", "new"}
    requests = spark.createDataFrame(
        [(1, "x", "old"), (2, None, "old"), (3, None, "ghost"), (4, None, None)], "id int, explicit string, current string"
    )
    got = {r.id: r.scope for r in recall.recall_scope(requests, sessions).collect()}
    assert got == {1: "x", 2: "old", 3: "new", 4: "new"}


def test_scope_at_the_time_of_the_request(spark):
    """Against a scan over all sessions, with ties, nulls, repeats and a hot second."""
    starts = [(f"s{i % 37}-{i}", float(i % 50 * 10)) for i in range(300)] + [("void", None)]
    sessions = spark.createDataFrame(starts, "session_id string, started_at double")
    asks = [(i, float(i * 7 % 520 - 10) if i % 3 else 250.0, "me" if i % 11 == 0 else None,
             starts[i % 90][0] if i % 5 == 0 else "ghost") for i in range(900)]
    asks += [(900, None, None, None), (901, 250.0, None, None), (901, 250.0, None, None)]
    requests = spark.createDataFrame(asks, "id int, requested_at double, explicit string, current string")
    known = {s for s, _ in starts}

    def expected(t, explicit, current):
        before = [] if t is None else sorted((-at, s) for s, at in starts if at is not None and at <= t)
        return explicit or (current if current in known else None) or (before[0][1] if before else None)

    got = sorted((r.id, r.scope) for r in recall.recall_scope_at(requests, sessions).collect())
    assert got == sorted((i, expected(*rest)) for i, *rest in asks)
    ranges = recall.newest_started(requests, sessions)
    assert ranges.columns == [*requests.columns, "_newest"]
    assert recall.recall_scope_at(requests.limit(0), sessions).count() == 0
    assert {r.scope for r in recall.recall_scope_at(requests.where("id = 901"), sessions.limit(0)).collect()} == {None}


def test_views(entries, sessions):
    got = {r.session_id: r for r in recall.session_view(sessions).collect()}
    assert got["new"].command == "pytest -q" and got["new"].state == "…" and got["old"].state == "✓"
    assert got["old"].started == "1970-01-01 00:16:40" and got["tie"].state == "…"
    shown = {r.id: r.preview for r in recall.preview(entries).collect()}
    assert shown[1] == "needle one" and shown[2] == "sum"
    long = entries.where("id = 2").withColumn("compressed_summary", F.lit(""))
    assert recall.preview(long).first().preview == "x" * 300 + "\n  …"


def test_commands(spark):
    cases = {
        "source snapshot-zsh-1 && eval 'x' && pwd -P >| f": (True, False, "zsh"),
        " eval x": (False, False, "/bin/sh"),
        "cd /a; arch recall 3": (False, True, "/bin/sh"),
        "'/usr/bin/arch' search 'x y'": (False, True, "/bin/sh"),
        "march recall 3": (False, False, "/bin/sh"),
        "arch recalled": (False, False, "/bin/sh"),
        "snapshot-bash-9; (arch search)": (False, False, "bash"),
    }
    df = spark.createDataFrame([(s,) for s in cases], "script string")
    got = {r.script: (r.is_tool, r.is_reader, r.shell) for r in commands.route_command(df, "arch").collect()}
    assert got == cases


def test_line_tables_do_not_shuffle(entries):
    for f in (lines.line_table, lines.line_frequency, lines.top_k_lines, lines.traceback_blocks):
        plan = f(entries, ["id"])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, f.__name__


def test_logs_are_pruned_once_for_all_commits(spark, sf_dir, monkeypatch):
    """Three appends, two of the same rows: every log is built and pruned one time."""
    from logdistill.plans import queries

    seen, pruned = spark.sparkContext.accumulator(0), queries._pruned

    def counted(spark, sf):
        @F.udf("bigint")
        def note(i):
            seen.add(1)
            return i

        return pruned(spark, sf).withColumn("id", note("id"))

    monkeypatch.setattr(queries, "_pruned", counted)
    rows = queries.session_stats_stored(spark, sf_dir).collect()
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert seen.value == n and 0 < sum(r.total_entries for r in rows) < n
