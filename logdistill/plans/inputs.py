"""The given tables in the roles of entries, sessions, chunks and source files.

Every text is built from every row of its table. The expressions are SQL that
Spark and DuckDB read alike; only a numbered list differs between the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..functions.steps import with_once
from ..sources.tables import dealt, spread

NL = "chr(10)"
KINDS = ("traceback", "flood", "rust", "gcc", "chatter", "prompt")


def numbered(dialect: str, n: str, body: str) -> str:
    """n lines, ``body`` of i = 0, 1, …"""
    if dialect == "spark":
        return f"array_join(transform(sequence(0L, {n} - 1), i -> {body}), {NL})"
    return f"array_to_string(list_transform(range(0, {n}), lambda i: {body}), {NL})"


def text_of(x: str) -> str:
    return f"cast({x} as string)"


KEY = text_of("o_orderkey")


def _lines(*parts: str) -> str:
    return " || ".join(f"{p} || {NL}" for p in parts)


TRACEBACK = " || ".join(
    [
        "case when o_orderkey % 4 = 0 then repeat('WARNING retrying' || chr(10), 20) "
        "when o_orderkey % 4 = 1 then '  starting worker' || chr(10) else '' end",
        "case when o_orderkey % 13 = 0 then chr(27) || '[31m' else '' end",
        "'Traceback (most recent call last):' || chr(10)",
        f"'  File \"/app/src/mod_' || {text_of('o_orderkey % 7')} || '.py\", line ' || "
        f"{text_of('10 + o_orderkey % 90')} || ', in handle' || chr(10)",
        f"'    run(order=' || {KEY} || ')' || chr(10)",
        "repeat('  File \"/app/src/core.py\", line 7, in step' || chr(10) || '    step()' || "
        "chr(10), cast(o_orderkey % 5 as int))",
        "repeat('  File \"/usr/lib/python3.12/asyncio/base_events.py\", line 200, in _run_once' "
        "|| chr(10) || '    handle._run()' || chr(10), cast(5 + o_orderkey % 20 as int))",
        "case when o_orderkey % 9 = 8 then '' else "
        "'KeyError: ' || chr(39) || o_orderpriority || chr(39) || chr(10) end",
        "case when o_orderkey % 5 = 2 then chr(10) || "
        "'During handling of the above exception, another exception occurred:' || chr(10) || "
        "chr(10) || 'Traceback (most recent call last):' || chr(10) || "
        "'  File \"/app/src/api.py\", line 3, in call' || chr(10) || '    raise Failed' || "
        f"chr(10) || 'ServiceError: order ' || {KEY} || chr(10) else '' end",
        "case when o_orderkey % 2 = 0 then '2 failed, 3 passed' || chr(10) else '' end",
    ]
)


def flood(dialect: str) -> str:
    decoys = numbered(dialect, "12", f"'DEBUG cache miss on shard ' || {text_of('i % 11')}")
    return (
        "repeat('WARNING connection timed out, retrying' || chr(10), "
        f"cast(30 + o_orderkey % 50 as int)) || {decoys} || chr(10) || "
        f"'CRITICAL: order=' || {KEY} || chr(10)"
    )


def rust(dialect: str) -> str:
    line = (
        f"'error[E' || {text_of('3000 + i % (1 + o_orderkey % 35)')} || ']: mismatched types at ' "
        f"|| {text_of('i')} || chr(10) || '  --> src/order_' || {KEY} || '.rs:' || {text_of('i')} "
        "|| chr(10) || 'warning[W001]: unused'"
    )
    return numbered(dialect, "(5 + o_orderkey % 40)", line)


def gcc(dialect: str) -> str:
    line = (
        f"'src/m_' || {text_of('i % 3')} || '.cpp:' || {text_of('i % (1 + o_orderkey % 23)')} || "
        "':8: ' || case when i % 4 = 3 then 'warning' else 'error' end || ': bad symbol s_' || "
        f"{text_of('i % 2')} || chr(10) || '  order ' || {KEY}"
    )
    return numbered(dialect, "(8 + o_orderkey % 40)", line)


def chatter(dialect: str) -> str:
    return numbered(
        dialect, "(20 + o_orderkey % 30)",
        f"'step ' || {text_of('i')} || ' of order ' || {KEY} || ' done'",
    )


PROMPT = (
    "repeat('preparing' || chr(10), cast(30 + o_orderkey % 9 as int)) || "
    f"'remove order ' || {KEY} || '? [Y/n] '"
)
ANSI = (
    "chr(27) || '[31m' || o_orderstatus || chr(27) || '[0m' || chr(27) || ']0;title' || chr(7) "
    "|| chr(27) || '[?25l' || o_orderpriority || chr(8) || chr(9) || chr(27) || 'M.' || chr(10)"
)
KIND = "case " + " ".join(
    f"when o_orderkey % {len(KINDS)} = {i} then '{k}'" for i, k in enumerate(KINDS)
) + " end"


def log_text(dialect: str) -> str:
    texts = (TRACEBACK, flood(dialect), rust(dialect), gcc(dialect), chatter(dialect), PROMPT)
    whens = " ".join(
        f"when o_orderkey % {len(KINDS)} = {i} then {t}" for i, t in enumerate(texts)
    )
    return f"case {whens} end"


NEEDLE = (
    f"case when o_orderkey % 6 = 0 then 'order=' || {KEY} || ')' "
    f"when o_orderkey % 6 = 1 then 'CRITICAL: order=' || {KEY} "
    f"when o_orderkey % 6 = 2 then 'src/order_' || {KEY} || '.rs' "
    f"when o_orderkey % 6 = 3 then '  order ' || {KEY} else 'order ' || {KEY} end"
)
SOURCE = " || ".join(
    [
        "'import os' || chr(10) || 'def top_' || cast(p_partkey as string) || '(x):' || chr(10)",
        "'    return x' || chr(10)",
        "'class Part_' || cast(p_partkey % 7 as string) || ':' || chr(10)",
        "'    def area(self):' || chr(10) || '        return ' || cast(p_size as string) || chr(10)",
        "repeat('    def name(self):' || chr(10), cast(p_size % 4 as int))",
        "'async def later():' || chr(10)",
        "case when p_size % 2 = 0 then 'class Other(Part_' || cast(p_partkey % 7 as string) || "
        "'):' || chr(10) || '  def price(self): pass' || chr(10) else '' end",
        "case when p_size % 5 = 0 then 'class Part_' || cast(p_partkey % 7 as string) || "
        "':' || chr(10) || '    def again(self): pass' || chr(10) else '' end",
        "'def main(): pass' || chr(10)",
    ]
)
PATH = "'src/' || replace(p_type, ' ', '_') || '/part_' || cast(p_partkey as string) || '.py'"
SCRIPT = (
    "case when o_orderkey % 4 = 0 then 'source /tmp/snapshot-zsh-1.sh && eval ' || chr(39) || "
    "'ls' || chr(39) || ' && pwd -P >| /tmp/cwd' when o_orderkey % 4 = 1 then "
    f"'cd /app; arch recall ' || {KEY} when o_orderkey % 4 = 2 then "
    "'/usr/bin/arch' || chr(39) || ' search ' || o_orderpriority else "
    "'bash -c search recall; . snapshot-bash-2; archive recall 3' end"
)


# --- Spark side ---------------------------------------------------------------
def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """documents as archive entries."""
    raw = spread(table(spark, sf, "documents", "doc_id", "source", "lang", "text"))
    return raw.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("session_id"),
        F.col("doc_id").cast("double").alias("timestamp"),
        F.col("lang").alias("entry_type"),
        F.col("text").alias("raw_content"),
        F.lit("").alias("compressed_summary"),
    )


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(
        table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    )


def order_text(spark: SparkSession, sf: str, expr: str) -> DataFrame:
    """One text per order."""
    built = with_once(_orders(spark, sf), "raw_content", F.expr(expr))
    return built.select(F.col("o_orderkey").alias("id"), "raw_content")


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """One log per order, of six kinds, in the session of its customer."""
    return logs_of(_orders(spark, sf))


def logs_of(orders: DataFrame) -> DataFrame:
    built = with_once(orders, "raw_content", F.expr(log_text("spark")))
    return built.select(*_log_keys(), "raw_content", F.expr(NEEDLE).alias("needle"))


def log_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The logs without their texts, which are not even built."""
    return _orders(spark, sf).select(*_log_keys())


def _log_keys() -> list[Column]:
    return [
        F.col("o_orderkey").alias("id"),
        F.expr("'cust-' || cast(o_custkey as string)").alias("session_id"),
        F.expr("cast(o_orderkey * 10 as double)").alias("timestamp"),
        F.lit("stdout").alias("entry_type"),
        F.expr(KIND).alias("kind"),
    ]


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey").select(
        F.expr("'cust-' || cast(c_custkey as string)").alias("session_id"),
        F.expr("'run ' || chr(27) || '[1m' || c_name || ' --segment ' || c_mktsegment || ' --all'").alias(
            "agent_command"
        ),
        F.expr("cast(c_custkey % 97 * 1000 as double)").alias("started_at"),
        F.expr("case when c_nationkey < 20 then cast(c_custkey % 97 * 1000 + 60 as double) end").alias(
            "ended_at"
        ),
        F.lit(0).cast("bigint").alias("total_tokens_saved"),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """events as the output chunks of one session per user."""
    since = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
    return table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props").select(
        F.expr("'user-' || cast(user_id as string)").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.expr(f"timestamp_micros({since})").alias("ts"),
        F.expr("encode(event_type || ' ' || props || chr(10), 'UTF-8')").alias("data"),
        F.lit(False).alias("eof"),
    )


#: Bytes of a piece of ``byte_chunks``: no multiple of a character's length.
PIECE = 61


def byte_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """documents as output of one session each, a piece of ``PIECE`` bytes every millisecond."""
    def pieces(data: Column) -> Column:
        last = F.floor((F.octet_length(data) - 1) / PIECE)
        return F.when(
            F.octet_length(data) > 0,
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), last),
                lambda i: F.struct(
                    i.alias("seq"),
                    F.substring(data, (i * PIECE + 1).cast("int"), F.lit(PIECE)).alias("data"),
                ),
            ),
        )

    docs = spread(table(spark, sf, "documents", "doc_id", "text"))
    session = F.expr("'doc-' || cast(doc_id as string)").alias("session_id")
    cut = docs.select(session, F.explode(bind(F.encode("text", "UTF-8"), pieces)).alias("p"))
    return cut.select(
        "session_id", "p.seq", F.timestamp_millis("p.seq").alias("ts"), "p.data", F.lit(False).alias("eof")
    )


def sources(spark: SparkSession, sf: str) -> DataFrame:
    parts = dealt(table(spark, sf, "part", "p_partkey", "p_type", "p_size"))
    built = with_once(parts, "content", F.expr(f"encode({SOURCE}, 'UTF-8')"))
    return built.select(F.expr(PATH).alias("path"), "content")


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select(
        F.col("o_orderkey").alias("id"), F.expr(SCRIPT).alias("script")
    )
