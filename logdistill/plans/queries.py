"""Every registered query: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, signatures, stem, summaries, text
from ..operators import (
    archive,
    benchmark,
    commands,
    lines,
    needles,
    prune,
    recall,
    search,
    segments,
    symbols,
)
from .. import schemas
from ..settings import EXEC_ARCHIVE_CAP, PipePolicy, TerminalPolicy
from ..shared import fresh_path, written
from ..sources import tables
from ..sources.report import write_report
from ..streaming import segments as stream_segments
from ..streaming import sinks
from . import inputs

TAG = "LD"
POLICY = PipePolicy(silence=43_200.0, max_hold=129_600.0, max_bytes=60)
BYTES_POLICY = PipePolicy(max_bytes=1000)
TEXT_COLUMNS = ("raw_content", "entry_type")
PHRASE, PREFIX = "of the", "tion"
DELETED = "contains(raw_content, 'that')"

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def long(c):
    return c.cast("bigint")


# --- lines and floods ---------------------------------------------------------
@query
def line_table(spark, sf):
    return lines.line_table(inputs.documents(spark, sf), ["id"]).withColumn("pos", long(F.col("pos")))


@query
def line_counts(spark, sf):
    d = inputs.documents(spark, sf)
    return d.select("id", long(text.line_count(F.col("raw_content"))).alias("line_count"))


@query
def token_estimates(spark, sf):
    c = F.col("raw_content")
    return inputs.documents(spark, sf).select(
        "id", text.token_estimate(c).alias("tokens"), text.token_estimate(c, 1).alias("tokens_floor_1")
    )


@query
def line_frequency(spark, sf):
    d = lines.line_frequency(inputs.documents(spark, sf), ["id"])
    return d.select("id", "line", long(F.col("n")).alias("n"), long(F.col("first_pos")).alias("first_pos"))


@query
def top_lines(spark, sf):
    d = lines.top_k_lines(inputs.documents(spark, sf), ["id"])
    return d.select("id", "line", long(F.col("n")).alias("n"), long(F.col("rank")).alias("rank"))


@query
def first_seen_lines(spark, sf):
    return lines.first_seen(inputs.documents(spark, sf), ["id"]).withColumn("ord", long(F.col("ord")))


@query
def flood_flag(spark, sf):
    c = F.col("raw_content")
    return inputs.documents(spark, sf).select(
        "id",
        detect.is_repetitive(c).alias("repetitive"),
        detect.is_repetitive(c, 0.3).alias("repetitive_at_30"),
    )


@query
def flood_summary(spark, sf):
    d = inputs.documents(spark, sf)
    c = F.col("raw_content")
    return d.select(
        "id",
        summaries.summarize_flood(c).alias("summary"),
        summaries.summarize_flood(c, share=0.3).alias("summary_at_30"),
    )


@query
def flood_log_summary(spark, sf):
    d = inputs.order_text(spark, sf, inputs.flood("spark"))
    return d.select("id", summaries.summarize_flood(F.col("raw_content")).alias("summary"))


# --- gates and escapes ----------------------------------------------------------
@query
def prompt_flag(spark, sf):
    pages = inputs.table(spark, sf, "pages", "page_id", "html")
    a = pages.select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("t"))
    b = inputs.logs(spark, sf).select(F.lit("log").alias("origin"), "id", F.col("raw_content").alias("t"))
    return a.unionByName(b).select(
        "origin",
        "id",
        text.is_prompt(F.col("t")).alias("is_prompt"),
        text.chunk_is_prompt(F.encode("t", "UTF-8")).alias("tail_is_prompt"),
    )


@query
def small_output_gate(spark, sf):
    return prune.small_output(inputs.documents(spark, sf)).select(
        "id", long(text.line_count(F.col("raw_content"))).alias("line_count")
    )


@query
def ansi_stripped(spark, sf):
    d = inputs.order_text(spark, sf, inputs.ANSI)
    return d.select("id", text.strip_ansi(F.col("raw_content")).alias("clean"))


@query
def sanitized(spark, sf):
    d = inputs.order_text(spark, sf, inputs.ANSI)
    return d.select("id", text.sanitize(F.col("raw_content")).alias("clean"))


@query
def decoded_output(spark, sf):
    """Texts cut into bytes: whole ones are UTF-8, halved ones fall back to latin-1."""
    d = inputs.documents(spark, sf)
    raw = F.encode("raw_content", "UTF-8")
    half = F.substring(raw, F.lit(1), F.floor(F.octet_length(raw) / 2).cast("int"))
    both = F.array(F.struct(F.lit("whole").alias("part"), raw.alias("data")),
                   F.struct(F.lit("half").alias("part"), half.alias("data")))
    cut = d.select("id", F.explode(both).alias("x")).select("id", "x.*")
    return tables.decode_output(cut).select(
        "id", "part", "text", F.octet_length("data").cast("bigint").alias("n_bytes")
    )


@query
def class_gate(spark, sf):
    c = F.col("raw_content")
    return inputs.logs(spark, sf).select("id", "kind", detect.classify(c).alias("class"))


@query
def incomplete_traceback(spark, sf):
    d = inputs.order_text(spark, sf, inputs.TRACEBACK)
    return d.select("id", detect.is_incomplete_traceback(F.col("raw_content")).alias("incomplete"))


@query
def command_routes(spark, sf):
    return commands.route_command(inputs.scripts(spark, sf), reader="arch").drop("script")


# --- summaries --------------------------------------------------------------------
def _tracebacks(spark, sf):
    return inputs.order_text(spark, sf, inputs.TRACEBACK)


@query
def traceback_blocks(spark, sf):
    b = lines.traceback_blocks(_tracebacks(spark, sf), ["id"])
    n = ("block_no", "n_blocks", "start_pos", "exception_pos", "n_frames")
    return b.select("id", *[long(F.col(c)).alias(c) for c in n], "kept", "exception")


@query
def traceback_frames(spark, sf):
    f = lines.traceback_frames(_tracebacks(spark, sf), ["id"])
    n = ("block_no", "frame_no")
    return f.select("id", *[long(F.col(c)).alias(c) for c in n], "frame", "is_library")


@query
def context_parts(spark, sf):
    return lines.context_parts(_tracebacks(spark, sf), ["id"])


def _summary(fn, expr):
    def run(spark, sf):
        d = inputs.order_text(spark, sf, expr)
        return d.select("id", fn(F.col("raw_content")).alias("summary"))

    return run


REGISTRY["traceback_summary"] = _summary(
    lambda c: summaries.summarize_tracebacks(text.strip_ansi(c)), inputs.TRACEBACK
)
REGISTRY["rust_summary"] = _summary(summaries.summarize_rust, inputs.rust("spark"))
REGISTRY["gcc_summary"] = _summary(summaries.summarize_gcc, inputs.gcc("spark"))


# --- the prune chain ---------------------------------------------------------------
def _pruned(spark, sf):
    return prune.prune(inputs.logs(spark, sf))


@query
def prune_pipeline(spark, sf):
    return _pruned(spark, sf).select(
        "id", "kind", "compressed_summary", "was_pruned", "net_tokens_saved",
        long(F.col("line_count")).alias("line_count"), "token_estimate",
    )


@query
def prune_documents(spark, sf):
    return prune.prune(inputs.documents(spark, sf), min_lines=10).select(
        "id", "compressed_summary", "was_pruned", "net_tokens_saved", "token_estimate"
    )


@query
def python_pruner_chain(spark, sf):
    """A user's Python pruner behind the built-in one: head and tail of chatter."""
    def chatty(t: str) -> bool:
        return t.startswith("step ")

    def ends(t: str) -> str:
        rows = t.splitlines()
        return f"{rows[0]}\n...\n{rows[-1]}"

    chain = [prune.OutputPruner(), prune.python_pruner(chatty, ends, "ends")]
    return prune.prune(inputs.logs(spark, sf), chain).select(
        "id", "was_pruned", "pruner_name", "compressed_summary"
    )


class Ends(prune.Pruner):
    """First and last line of chatter; an error for every fourth order."""

    name = "ends"

    def compress(self, c):
        order = F.regexp_extract(c, r"of order (\d+)", 1).cast("bigint")
        short = F.concat_ws("\n...\n", F.substring_index(c, "\n", 1), F.substring_index(c, "\n", -1))
        failing = F.when(order % 4 == 0, F.raise_error(F.lit("not this order"))).otherwise(short)
        return F.when(c.startswith("step "), failing)


@query
def prune_fail_open(spark, sf):
    """A native pruner that fails for some texts: those stay raw, all others are pruned."""
    return prune.prune(inputs.logs(spark, sf), [Ends(), prune.OutputPruner()]).select(
        "id", "was_pruned", "pruner_name", "compressed_summary"
    )


@query
def archive_cap(spark, sf):
    kept = prune.archived(_pruned(spark, sf), cap=1_000)
    return kept.select("id", "was_pruned", F.octet_length("raw_content").cast("bigint").alias("n_bytes"))


@query
def archive_cap_documents(spark, sf):
    kept = prune.archived(prune.prune(inputs.documents(spark, sf)), cap=EXEC_ARCHIVE_CAP)
    return kept.select("id", "was_pruned")


@query
def tokens_saved(spark, sf):
    return _pruned(spark, sf).groupBy("kind").agg(
        F.sum("net_tokens_saved").alias("net_tokens_saved"),
        F.sum("token_estimate").alias("raw_tokens"),
        F.sum(long(F.col("was_pruned"))).alias("pruned"),
    )


def _shown(spark, sf):
    return prune.render_injection(_pruned(spark, sf), TAG, color=False)


@query
def injection_text(spark, sf):
    return _shown(spark, sf).select("id", "shown")


@query
def injection_hint(spark, sf):
    d = prune.render_injection(_pruned(spark, sf), TAG, hint="arch recall --db a.db", color=True)
    return d.where("was_pruned").select("id", "shown")


# --- the archive ----------------------------------------------------------------------
def _archive(spark, sf):
    return _pruned(spark, sf)


@query
def session_stats(spark, sf):
    return archive.session_stats(_archive(spark, sf), inputs.sessions(spark, sf))


@query
def session_stats_stored(spark, sf):
    """Statistics from the totals that commits keep: two, one written twice, and deletions."""
    path = fresh_path(spark, "archive")
    # Written, so that the logs are built and pruned once and not for every commit.
    rows = written(_pruned(spark, sf).withColumn("seq", F.col("id")).drop("id"), "pruned")
    some = F.col("kind").isin("traceback", "flood")
    archive.append_entries(rows.where(some), path, "some")
    archive.append_entries(rows.where(~some), path, "rest")
    archive.append_entries(rows.where(~some), path, "rest")
    gone = tables.read_entries(spark, path).where("contains(raw_content, 'CRITICAL')").select("id")
    archive.mark_deleted(gone, path, "critical")
    archive.mark_deleted(gone, path, "again")
    return archive.stored_stats(spark, path, inputs.sessions(spark, sf))


@query
def pipeline_counters(spark, sf):
    return prune.pipeline_counters(_shown(spark, sf))


@query
def live_compression(spark, sf):
    c = prune.live_compression(prune.pipeline_counters(_shown(spark, sf)))
    return c.select("session_id", F.round("compression", 6).alias("compression"))


@query
def session_cost(spark, sf):
    keep = ("session_id", "was_pruned", "token_estimate", "net_tokens_saved")
    pruned = written(_archive(spark, sf).select(*keep), "pruned")
    stats = archive.session_stats(pruned, inputs.sessions(spark, sf))
    counters = pruned.groupBy("session_id").agg(F.sum("net_tokens_saved").alias("tokens_saved"))
    return archive.session_cost(stats, counters).select(
        "session_id", "chunks", "pruned", "net_tokens_saved",
        F.round("saved_pct", 6).alias("saved_pct"), F.round("saved_usd", 6).alias("saved_usd"),
    )


@query
def list_sessions(spark, sf):
    return archive.list_sessions(inputs.sessions(spark, sf)).select("session_id", "started_at")


@query
def session_view(spark, sf):
    return recall.session_view(inputs.sessions(spark, sf))


@query
def recent_entries(spark, sf):
    d = archive.recent_entries(inputs.documents(spark, sf), limit=5)
    return d.select("session_id", "id", long(F.col("rank")).alias("rank"))


@query
def recent_of_one_session(spark, sf):
    return archive.recent_entries(inputs.documents(spark, sf), "src7").select("session_id", "id")


def _turns(spark, sf):
    return inputs.table(spark, sf, "conversations", "conv_id", "turn", "role", "text").select(
        F.expr("'conv-' || cast(conv_id as string)").alias("session_id"),
        F.col("turn").alias("seq"),
        F.expr("cast(conv_id % 9 * 100 + turn as double)").alias("timestamp"),
        F.col("role").alias("entry_type"),
        F.col("text").alias("raw_content"),
    )


@query
def append_entries(spark, sf):
    return archive.assign_ids(_turns(spark, sf), base=1000).select("session_id", "seq", "id")


@query
def archive_commits(spark, sf):
    """Two commits, the second one written twice, and the archive read back."""
    path = fresh_path(spark, "archive")
    shared = ("session_id", "seq", "timestamp", "entry_type", "raw_content")
    docs = inputs.documents(spark, sf).withColumn("seq", F.col("id")).select(*shared)
    archive.append_entries(_turns(spark, sf), path, "turns")
    archive.append_entries(docs, path, "documents")
    archive.append_entries(docs, path, "documents")
    return tables.read_entries(spark, path).select("id", "session_id", "raw_content")


@query
def create_sessions(spark, sf):
    made = _turns(spark, sf).select(
        F.col("raw_content").alias("agent_command"), F.col("timestamp").cast("bigint").alias("started_at")
    )
    return archive.create_sessions(made, deterministic=True).select("session_id", "started_at")


@query
def ensure_sessions(spark, sf):
    """Every document's source and every customer of an order becomes a session."""
    new = inputs.log_keys(spark, sf).select(
        "session_id", F.col("kind").alias("agent_command"), F.col("timestamp").alias("started_at")
    ).unionByName(
        inputs.documents(spark, sf).select(
            "session_id", F.col("entry_type").alias("agent_command"),
            F.col("timestamp").alias("started_at"),
        )
    )
    old = inputs.sessions(spark, sf).where("ended_at is null")
    out = archive.ensure_sessions(old, new)
    return out.select("session_id", "started_at", "total_tokens_saved",
                      "agent_command")


@query
def close_sessions(spark, sf):
    closes = inputs.log_keys(spark, sf).select(
        "session_id", F.col("timestamp").alias("ended_at"), F.col("id").alias("tokens_saved")
    )
    out = archive.close_sessions(inputs.sessions(spark, sf), closes)
    return out.select("session_id", "ended_at", "total_tokens_saved")


@query
def session_log(spark, sf):
    """Sessions from a log of openings (customers) and closings (their orders)."""
    none = F.lit(None)
    opened = inputs.sessions(spark, sf).select(
        "session_id", F.lit("open").alias("kind"), F.col("started_at").alias("event_ts"),
        "agent_command", none.cast("bigint").alias("tokens_saved"),
    )
    closed = inputs.log_keys(spark, sf).select(
        "session_id", F.lit("close").alias("kind"), F.col("timestamp").alias("event_ts"),
        none.cast("string").alias("agent_command"), F.col("id").alias("tokens_saved"),
    )
    out = archive.fold_sessions(opened.unionByName(closed))
    return out.select("session_id", "started_at", "ended_at", "total_tokens_saved")


@query
def delete_entries(spark, sf):
    d = inputs.documents(spark, sf)
    kept, _ = archive.delete_entries(d, _no_postings(d), d.where(DELETED).select("id"))
    return kept.select("id", "session_id")


def _no_postings(d):
    return d.select(F.col("id").alias("entry_id"))


@query
def delete_postings(spark, sf):
    """The index after deleting entries."""
    d = inputs.documents(spark, sf)
    built = search.build_postings(d, TEXT_COLUMNS)
    _, kept = archive.delete_entries(d, built, d.where(DELETED).select("id"))
    return kept.select("term", "entry_id", "doc_len", long(F.col("tf")).alias("tf"))


@query
def delete_session_cascade(spark, sf):
    gone = inputs.sessions(spark, sf).where("ended_at is null").select("session_id")
    kept, _ = archive.delete_session_cascade(
        inputs.log_keys(spark, sf), inputs.sessions(spark, sf), gone
    )
    return kept.select("id", "session_id")


@query
def archive_session_cascade(spark, sf):
    """Sessions deleted in a written archive: table, log, entries and index read back."""
    path = fresh_path(spark, "archive")
    known = inputs.sessions(spark, sf)
    archive.append_sessions(known, path, "customers")
    archive.append_session_events(
        known.select("session_id", F.lit("open").alias("kind"), F.col("started_at").alias("event_ts"),
                     "agent_command", F.lit(None).cast("bigint").alias("tokens_saved")),
        path, "customers",
    )
    rows = inputs.log_keys(spark, sf).select(
        "session_id", F.col("id").alias("seq"), "timestamp", "entry_type", F.col("kind").alias("raw_content")
    )
    archive.append_entries(rows, path, "orders", index=("raw_content",))
    archive.delete_sessions(known.where("ended_at is null").select("session_id"), path, "open")
    entries = tables.read_entries(spark, path)
    postings_, _ = search.read_index(spark, path)
    held = postings_.groupBy(F.col("entry_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    per = entries.select("id", "session_id").join(held, "id", "full").groupBy("session_id").agg(
        F.count("id").alias("n_entries"), F.sum("n").alias("n_postings")
    )
    events = tables.read_session_log(spark, path).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_events"))
    counts = ("n_entries", "n_postings", "n_events")
    return (
        tables.read_sessions(spark, path).select("session_id", "started_at")
        .join(per, "session_id", "full").join(events, "session_id", "full")
        .select("session_id", "started_at", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])
    )


@query
def fk_orphans(spark, sf):
    open_ = inputs.sessions(spark, sf).where("ended_at is not null")
    return archive.fk_orphans(inputs.log_keys(spark, sf), open_).select("id", "session_id")


# --- recall -----------------------------------------------------------------------------
@query
def recall_by_id(spark, sf):
    """A table of handles, every other one of which is a miss."""
    handles = inputs.table(spark, sf, "documents", "doc_id").select((F.col("doc_id") * 2).alias("id"))
    return recall.recall_by_id(inputs.documents(spark, sf), handles).select(
        "id", "session_id", "raw_content"
    )


@query
def recall_scope(spark, sf):
    requests = inputs.table(spark, sf, "orders", "o_orderkey", "o_custkey").select(
        F.col("o_orderkey").alias("id"),
        F.expr("case when o_orderkey % 3 = 0 then 'asked-' || cast(o_custkey as string) end").alias("explicit"),
        F.expr("'cust-' || cast(o_custkey * 2 as string)").alias("current"),
    )
    return recall.recall_scope(requests, inputs.sessions(spark, sf)).select("id", "scope")


@query
def recall_scope_at(spark, sf):
    """The same for requests that were made at a time of their own."""
    requests = inputs.table(spark, sf, "orders", "o_orderkey", "o_custkey").select(
        F.col("o_orderkey").alias("id"),
        F.expr("cast(o_orderkey * 37 % 100000 - 500 as double)").alias("requested_at"),
        F.expr("case when o_orderkey % 3 = 0 then 'asked-' || cast(o_custkey as string) end").alias("explicit"),
        F.expr("'cust-' || cast(o_custkey * 2 as string)").alias("current"),
    )
    return recall.recall_scope_at(requests, inputs.sessions(spark, sf)).select("id", "scope")


@query
def recall_view(spark, sf):
    return recall.recall_view(_archive(spark, sf))


@query
def recall_latest_session(spark, sf):
    """The best match from the session that a recall without handle searches."""
    mine = recall.in_scope(inputs.log_keys(spark, sf), inputs.sessions(spark, sf))
    return mine.select("id", "session_id")


@query
def entry_preview(spark, sf):
    return recall.preview(_archive(spark, sf)).select("id", "preview")


@query
def needle_lookup(spark, sf):
    """All words and whole texts of the benchmark, looked for in all documents."""
    docs = inputs.documents(spark, sf)
    text_ = inputs.table(spark, sf, "benchmark", "text")
    words = text_.select(F.explode(F.split("text", " ")).alias("needle"))
    asked = words.unionByName(text_.select(F.col("text").alias("needle"))).where("needle <> ''").distinct()
    held = needles.needle_lookup(asked, docs, needles.gram_postings(docs))
    per = held.groupBy("needle").agg(F.count(F.lit(1)).alias("n_entries"), F.min("id").alias("first_id"))
    return asked.join(per, "needle", "left").select(
        "needle", F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"), "first_id"
    )


# --- search --------------------------------------------------------------------------------
THE, AND, OF, IN = (search.term(w) for w in ("the", "AND", "of", "ING"))
SEARCHES: dict[str, search.Expr] = {
    "search_term": THE,
    "search_any": search.any_of(THE, search.term("et")),
    "search_all": search.all_of(THE, AND),
    "search_none": search.none_of(AND, IN, search.term("tion")),
    "search_prefix": search.prefix(PREFIX),
    "search_phrase": search.phrase(PHRASE),
    "search_type": search.all_of(search.term("en"), OF),
}


def _search(expr):
    def run(spark, sf):
        ranked = search.rank_entries(inputs.documents(spark, sf), expr, TEXT_COLUMNS)
        return ranked.select("entry_id", F.round("rank", 6).alias("rank"))

    return run


for _name, _expr in SEARCHES.items():
    REGISTRY[_name] = _search(_expr)


@query
def search_top_k(spark, sf):
    d = inputs.documents(spark, sf)
    return search.search_entries(d, SEARCHES["search_any"], limit=20, columns=TEXT_COLUMNS).select(
        "id", "session_id", F.round("rank", 6).alias("rank")
    )


@query
def search_in_session(spark, sf):
    d = inputs.documents(spark, sf)
    return search.search_entries(d, THE, session_id="src3", limit=20, columns=TEXT_COLUMNS).select(
        "id", "session_id", F.round("rank", 6).alias("rank")
    )


@query
def search_index(spark, sf):
    """The same ranking from the postings table."""
    d = inputs.documents(spark, sf)
    ranked = search.rank_postings(
        search.build_postings(d, TEXT_COLUMNS),
        search.document_lengths(d, TEXT_COLUMNS),
        SEARCHES["search_none"],
    )
    return ranked.select("entry_id", F.round("rank", 6).alias("rank"))


@query
def postings(spark, sf):
    d = search.build_postings(inputs.documents(spark, sf), TEXT_COLUMNS)
    return d.select("term", "entry_id", "doc_len", long(F.col("tf")).alias("tf"))


@query
def term_frequencies(spark, sf):
    return search.term_frequencies(
        search.build_postings(inputs.documents(spark, sf), TEXT_COLUMNS)
    )


@query
def corpus_stats(spark, sf):
    d = search.corpus_stats(search.document_lengths(inputs.documents(spark, sf), TEXT_COLUMNS))
    return d.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query
def porter_vocab(spark, sf):
    words = inputs.documents(spark, sf).select(
        F.explode(F.array_distinct(search.tokens(F.col("raw_content")))).alias("word")
    )
    return words.distinct().select("word", stem.porter(F.col("word")).alias("stem"))


@query
def search_stored_index(spark, sf):
    """The index written, read back and searched within one session."""
    d = inputs.documents(spark, sf)
    path = fresh_path(spark, "index")
    search.write_index(d, path, TEXT_COLUMNS)
    stored, docs = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "documents"))
    best = search.search(stored, docs, d, SEARCHES["search_any"], session_id="src3", limit=20)
    return best.select("id", "session_id", F.round("rank", 6).alias("rank"))


@query
def search_after_delete(spark, sf):
    """An index that grew with two commits of its archive, then lost entries."""
    path = fresh_path(spark, "archive")
    d = inputs.documents(spark, sf).withColumn("seq", F.col("id")).drop("id")
    archive.append_entries(_turns(spark, sf), path, "turns", TEXT_COLUMNS)
    archive.append_entries(d, path, "documents", TEXT_COLUMNS)
    archive.mark_deleted(tables.read_entries(spark, path).where(DELETED).select("id"), path)
    ranked = search.rank_postings(*search.read_index(spark, path), SEARCHES["search_any"])
    return ranked.select("entry_id", F.round("rank", 6).alias("rank"))


@query
def search_best_stored(spark, sf):
    """The best 20 of an index of two commits and deletions, by the maxima of its blocks."""
    path = fresh_path(spark, "archive")
    d = inputs.documents(spark, sf).withColumn("seq", F.col("id")).drop("id")
    for name, rows in (("turns", _turns(spark, sf)), ("documents", d)):
        archive.append_entries(rows, path, name, TEXT_COLUMNS)
        search.write_maxima(spark, path, name)
    archive.mark_deleted(tables.read_entries(spark, path).where(DELETED).select("id"), path)
    best = search.top_entries(spark, path, SEARCHES["search_any"])
    return best.select("entry_id", F.round("rank", 6).alias("rank"))


@query
def recall_by_query(spark, sf):
    """The best log about a timeout from the session started last."""
    expr = search.any_of(search.term("WARNINGS"), search.phrase("timed out"))
    best = recall.recall_by_query(
        inputs.logs(spark, sf), inputs.sessions(spark, sf), expr, limit=3, columns=TEXT_COLUMNS
    )
    return best.select("id", "session_id", F.round("rank", 6).alias("rank"))


# --- reports ---------------------------------------------------------------------------------
def _summarised(spark, sf):
    logs = inputs.logs(spark, sf).select(
        F.col("kind").alias("suite"), F.col("id").alias("name"), F.col("raw_content").alias("text")
    )
    return benchmark.summarised(logs)


@query
def signature_table(spark, sf):
    d = inputs.logs(spark, sf)
    return d.select("id", F.explode(signatures.extract_signatures(F.col("raw_content"))).alias("signature"))


@query
def signature_fidelity(spark, sf):
    r = benchmark.item_result(_summarised(spark, sf))
    return r.select(
        "suite", "name", "naked_chars", "proxied_chars", "naked_tokens", "proxied_tokens",
        "naked_sigs", "preserved_sigs", "pruner_fired",
        F.round("compression_ratio", 6).alias("compression_ratio"),
        F.round("fidelity_ratio", 6).alias("fidelity_ratio"),
    )


@query
def missing_signatures(spark, sf):
    return benchmark.missing_signatures(_summarised(spark, sf))


def _report(spark, sf):
    return benchmark.suite_report(benchmark.item_result(_summarised(spark, sf)))


@query
def suite_report(spark, sf):
    r = _report(spark, sf)
    exact = ("n_items", "total_naked_tokens", "total_pruned_tokens")
    return r.select(
        "suite", *exact,
        *[F.round(c, 6).alias(c) for c in r.columns if c not in ("suite", *exact)],
    )


@query
def suite_assertions(spark, sf):
    return benchmark.suite_assertions(_report(spark, sf)).select(
        "suite", "check", F.round("actual", 6).alias("actual"), "threshold", "passed"
    )


@query
def json_report(spark, sf):
    """The report written as JSON and read back."""
    # Written: the report and the items' own file need them, the texts are pruned once.
    items = written(benchmark.item_result(_summarised(spark, sf)), "items")
    report = benchmark.suite_report(items)
    checks = benchmark.suite_assertions(report)
    path = fresh_path(spark, "report")
    write_report(benchmark.suite_documents(report, checks), items, path)
    shape = "suite string, n_items bigint, total_naked_tokens bigint, passed boolean, checks array<struct<check:string>>"
    rows = spark.read.schema("suite string, name bigint, pruner_fired boolean").json(f"{path}/items")
    fired = rows.groupBy("suite").agg(F.sum(long(F.col("pruner_fired"))).alias("n_fired"))
    return spark.read.schema(shape).json(f"{path}/suites").join(fired, "suite").select(
        "suite", "n_items", "total_naked_tokens", "passed",
        long(F.size("checks")).alias("n_checks"), "n_fired",
    )


@query
def global_summary(spark, sf):
    r = benchmark.global_summary(_report(spark, sf))
    return r.select(
        "total_naked_tokens", "total_pruned_tokens",
        F.round("global_compression", 6).alias("global_compression"),
        F.round("global_fidelity", 6).alias("global_fidelity"),
    )


def _arms(spark, sf):
    """Every log goes to an archive; arm C pages it back by its handle there."""
    logs = inputs.logs(spark, sf)
    path = fresh_path(spark, "archive")
    archive.append_entries(logs.drop("needle").withColumn("seq", F.col("id")), path)
    kept = tables.read_entries(spark, path)
    handles = kept.select((F.col("timestamp") / 10).cast("bigint").alias("name"), "id")
    needles = logs.select(F.col("id").alias("name"), F.col("raw_content").alias("raw"), "needle")
    return benchmark.recall_arms(needles, recall.recall_by_id(kept, handles).select("name", "raw_content"))


@query
def recall_arms(spark, sf):
    return _arms(spark, sf)


@query
def recall_report(spark, sf):
    r = benchmark.recall_report(_arms(spark, sf))
    return r.select(
        *[F.round(f"recovery_{a}", 6).alias(f"recovery_{a}") for a in "abc"],
        *[f"total_{a}_tokens" for a in "abc"],
        F.round("saving_c_vs_a", 6).alias("saving_c_vs_a"),
    )


@query
def recall_assertions(spark, sf):
    return benchmark.recall_assertions(benchmark.recall_report(_arms(spark, sf)))


# --- segments -----------------------------------------------------------------------------------
@query
def segments_silence(spark, sf):
    d = segments.segment_silence(inputs.chunks(spark, sf), POLICY.silence)
    return d.groupBy("session_id", "run_no").agg(
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.unix_micros(F.min("ts")).alias("first_us"),
        F.unix_micros(F.max("ts")).alias("last_us"),
    )


def _numbered(spark, sf):
    return segments.segment_batch(inputs.chunks(spark, sf), POLICY)


def _extent(d):
    return d.select(
        "session_id", "seg_no", "n_chunks", "n_bytes",
        F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"),
    )


@query
def segments_greedy(spark, sf):
    return _extent(segments.segments(_numbered(spark, sf)))


@query
def segment_text(spark, sf):
    parts = segments.segment_bytes(inputs.chunks(spark, sf), _numbered(spark, sf))
    return segments.segment_text(parts).select("session_id", "seg_no", "text")


@query
def segment_text_cut_characters(spark, sf):
    """Texts as output in pieces of bytes, which cut characters in two."""
    chunks = inputs.byte_chunks(spark, sf)
    parts = segments.segment_bytes(chunks, segments.segment_batch(chunks, BYTES_POLICY))
    return segments.segment_text(parts).select("session_id", "seg_no", "text")


@query
def session_windows(spark, sf):
    d = segments.session_windows(inputs.chunks(spark, sf), "43200 seconds")
    return d.select(
        "session_id", "n_chunks", "n_bytes",
        F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"),
    )


# --- symbols ---------------------------------------------------------------------------------------
@query
def source_files(spark, sf):
    d = symbols.distinct_content(tables.describe_files(inputs.sources(spark, sf)))
    return d.select("path", "language", "file_hash", long(F.col("line_count")).alias("line_count"))


@query
def symbol_ranges(spark, sf):
    d = symbols.symbol_ranges(inputs.sources(spark, sf))
    n = ("ord", "start_line", "end_line")
    return d.select("path", *[long(F.col(c)).alias(c) for c in n], "name", "kind", "docstring", "parent")


@query
def symbol_children(spark, sf):
    d = symbols.symbol_children(symbols.symbol_ranges(inputs.sources(spark, sf)))
    n = ("class_line", "method_line")
    return d.select("path", "parent", "method", *[long(F.col(c)).alias(c) for c in n])


@query
def symbol_outline(spark, sf):
    return symbols.symbol_outline(inputs.sources(spark, sf)).select("path", "outline")


@query
def symbols_cached(spark, sf):
    """Two runs over one cache: the second finds every content of its files there."""
    path = fresh_path(spark, "symbols")
    files = inputs.sources(spark, sf)
    copies = files.select(F.concat(F.lit("copy/"), "path").alias("path"), "content")
    symbols.cached_symbols(files, path, "first")
    d = symbols.cached_symbols(files.unionByName(copies), path, "second")
    n = ("ord", "start_line", "end_line")
    return d.select("path", *[long(F.col(c)).alias(c) for c in n], "name", "kind", "docstring", "parent")


# --- streams, replayed over a table -------------------------------------------------------------------
PARTS = 3
TEN_YEARS = 3_653 * 86_400.0


def _ends(rows):
    """One end mark per session."""
    return rows.groupBy("session_id").agg(
        (F.max("seq") + 1).alias("seq"), F.max("ts").alias("ts")
    ).select("session_id", "seq", "ts", F.lit(None).cast("binary").alias("data"), F.lit(True).alias("eof"))


def _feed(spark, rows, ends):
    """The feed as a folder a stream can read."""
    path = fresh_path(spark, "feed")
    rows.unionByName(ends).write.parquet(path)
    return spark.readStream.schema(schemas.CHUNK).parquet(path)


def _replayed(spark, sf, policy):
    """The feed in three spans of time, a run for each: open segments pass from run to run.

    Sessions end in the last run; a mark older than the watermark is late, and
    silence has closed its session by then.
    """
    feed, out, state = (fresh_path(spark, n) for n in ("feed", "segments", "state"))
    rows = inputs.chunks(spark, sf)
    ends = _ends(rows)
    at = F.unix_micros("ts")
    first, last = rows.agg(F.min(at), F.max(at)).first()
    if first is None:
        return spark.createDataFrame([], schemas.SEGMENT)
    part = F.floor((at - first) * PARTS / (last - first + 1))
    for i in range(PARTS):
        new = rows.where(part == i)
        (new.unionByName(ends) if i == PARTS - 1 else new).write.mode("append").parquet(feed)
        source = spark.readStream.schema(schemas.CHUNK).parquet(feed)
        # numbered over the whole table, as the batch operator does
        cut = stream_segments.segment_stream(source, policy, forget=TEN_YEARS)
        writer = cut.writeStream.format("parquet").option("path", out)
        sinks.drain(writer.option("checkpointLocation", state))
    return spark.read.schema(schemas.SEGMENT).parquet(out)


@query
def stream_segments_replay(spark, sf):
    d = _replayed(spark, sf, POLICY)
    return _extent(d.withColumn("n_bytes", F.octet_length("data").cast("bigint")))


@query
def stream_terminal_replay(spark, sf):
    """Terminal rule: three lines, or twelve hours of silence."""
    d = _replayed(spark, sf, TerminalPolicy(silence=POLICY.silence, min_lines=3))
    return _extent(d)


@query
def stream_archive_replay(spark, sf):
    """Segments of the stream, pruned and archived with ids by the sink."""
    path = fresh_path(spark, "archive")
    rows = inputs.chunks(spark, sf)
    cut = stream_segments.segment_stream(_feed(spark, rows, _ends(rows)), POLICY, forget=TEN_YEARS)
    sinks.drain(sinks.archive_sink(cut, path, fresh_path(spark, "state")))
    return tables.read_entries(spark, path).select(
        "id", "session_id", "raw_content", "token_estimate", "was_pruned"
    )


@query
def stream_archive_logs(spark, sf):
    """Logs as segments of a stream, pruned, archived and read back."""
    path = fresh_path(spark, "archive")
    at = F.timestamp_seconds(F.col("timestamp") + 1)  # a watermark starts at 0, and 0 is late then
    key = ("session_id", F.col("id").alias("seq"), at.alias("ts"))
    rows = inputs.logs(spark, sf).select(
        *key, F.encode("raw_content", "UTF-8").alias("data"), F.lit(False).alias("eof")
    )
    feed = _feed(spark, rows, _ends(inputs.log_keys(spark, sf).select(*key)))
    cut = stream_segments.segment_stream(feed, PipePolicy(), forget=TEN_YEARS)
    sinks.drain(sinks.archive_sink(cut, path, fresh_path(spark, "state")))
    return tables.read_entries(spark, path).select(
        "id", "session_id", "raw_content", "compressed_summary", "token_estimate", "was_pruned"
    )


@query
def live_stats_replay(spark, sf):
    """Counters over a stream of the orders' logs."""
    orders = (
        spark.readStream.schema("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string")
        .option("pathGlobFilter", "orders.parquet").parquet(sf)
    )
    path = fresh_path(spark, "counters")
    counters = sinks.live_stats(inputs.logs_of(orders), TAG)
    sinks.drain(sinks.follow(counters, path, fresh_path(spark, "state")))
    return sinks.latest(spark, path)
