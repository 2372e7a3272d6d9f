"""Generated corpora for the reports, as DataFrames ``(name, text)``.

A small table of parameters drives column expressions, so a corpus can be made
as large as wished by passing another table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the shapes and texts of the published benchmark --------------
HEADER = "Traceback (most recent call last):"
USER_FRAME = (
    '  File "/app/src/module_%d.py", line %d, in handler_%d',
    "    result = self._process(payload)",
)
VENV_FRAME = (
    '  File "/home/user/.venv/lib/python3.13/site-packages/pkg_%d/core.py", line %d, in __call__',
    "    return self.handler(event)",
)
STDLIB_FRAME = (
    '  File "/usr/lib/python3.13/asyncio/base_events.py", line %d, in _run_once',
    "    handle._run()",
)
DEFAULT_ERROR = ("ValueError", "invalid literal for int() with base 10: 'abc'")
CHAIN = (
    ("sqlite3.OperationalError", "unable to open database file"),
    ("ConnectionError", "DB pool exhausted after 30s timeout"),
    ("HTTPException", "503 Service Unavailable — upstream DB down"),
)
CHAIN_LINK = "During handling of the above exception, another exception occurred:"
TRACEBACKS = (
    ("shallow_traceback_5f", 2, 3, *DEFAULT_ERROR),
    ("medium_traceback_20f", 3, 17, *DEFAULT_ERROR),
    ("deep_traceback_40f", 3, 37, *DEFAULT_ERROR),
    ("massive_traceback_60f", 4, 56, *DEFAULT_ERROR),
    ("keyerror_traceback", 3, 15, "KeyError", "'user_id'"),
    ("attributeerror_traceback", 3, 15, "AttributeError", "'NoneType' object has no attribute 'id'"),
    ("typeerror_traceback", 3, 15, "TypeError", "unsupported operand type(s) for +: 'int' and 'str'"),
    ("importerror_traceback", 3, 15, "ImportError", "cannot import name 'BaseModel' from 'pydantic'"),
)
CHAINS = (("chained_2x", 2), ("chained_3x", 3))
RUST_WALLS = (
    ("rust_small_5u_3r", 5, 3), ("rust_medium_10u_4r", 10, 4), ("rust_large_15u_5r", 15, 5),
    ("rust_massive_20u_6r", 20, 6),
)
RUST_HEAD = (
    "   Compiling workspace_crate v0.1.0 (/workspace)",
    "   Compiling shared_types v0.2.1 (/workspace/shared)",
)
RUST_ERROR = (
    "error[E%04d]: mismatched types in `process_batch_%d` (crate replica %d)",
    "  --> src/processors/batch_%d.rs:%d:12",
    "   |",
    "%d |     let count: u64 = get_item_count();",
    "   |                   ^^^^  expected `u64`, found `i32`",
    "   |",
    "   = note: consider using `as u64`",
)
RUST_TAIL = (
    "error: aborting due to %d previous errors",
    "For more information, try `rustc --explain E3000`.",
    "error: could not compile `workspace_crate`",
)
GCC_WALLS = (("gcc_small_3tu_4e", 3, 4), ("gcc_medium_6tu_7e", 6, 7), ("gcc_large_10tu_8e", 10, 8))
GCC_HEAD = "make[1]: Entering directory '/workspace/build'"
GCC_ERROR = (
    "src/module_%d.cpp:%d:%d: error: 'undefined_symbol_%d' was not declared in this scope",
    "   %d |     auto result = undefined_symbol_%d(input);",
    "       |                  %s^",
)
GCC_TAIL = ("make[1]: *** [CMakeFiles/app.dir/all] Error 1", "make: *** [all] Error 2")
FLOODS = (
    ("flood_100l_2u", 100, 2), ("flood_200l_3u", 200, 3), ("flood_300l_2u", 300, 2),
    ("flood_500l_3u", 500, 3), ("flood_1000l_2u", 1000, 2),
)
FLOOD_LINES = (
    "WARNING:app.db:Connection timed out, retrying in 5 seconds...",
    "DEBUG:app.cache:Cache miss — fetching from upstream DB",
    "INFO:app.worker:Queue depth: 14523 messages waiting",
)
MIXED_HEAD = (
    "[agent] Reading file: src/services/payment.py",
    "[agent] Running: pytest tests/test_payment.py -v",
    "tests/test_payment.py::test_charge_user PASSED",
    "tests/test_payment.py::test_refund_user FAILED",
    "SHORT TEST SUMMARY INFO",
    "FAILED tests/test_payment.py::test_refund_user - %d exception(s)",
)
MIXED_ERROR = ("AssertionError", "assert charge_amount == refund_amount: 99.99 != 100.00")
MIXED_ITEMS = 6
ALERT = "CRITICAL:app.billing:cust_id=4821 double-charged tok_live_9c8f2a"
ALERT_FLOOD = "WARNING:app.db:Connection timed out, retrying in 5s..."
ALERT_DECOY = "DEBUG:app.cache:cache miss on shard %d"
TOKEN = "token='tok_live_NEEDLE7h2k'"
NOTE = "= note: `AccountId` is defined in crate `billing_core`, not `shared`"
# ----------------------------------------------------------------------------------


def _each(n: Column | int, body) -> Column:
    """Flattened ``body(i)`` for i = 0 … n-1; nothing for n = 0."""
    count = F.lit(n) if isinstance(n, int) else n
    index = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.flatten(F.transform(index, body))


def _rows(*lines: Column | str) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])


def _join(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), "\n")


def python_traceback(n_user: Column, n_stdlib: Column, error: Column) -> Column:
    """User, five library and standard-library frames, then the exception."""
    return F.concat(
        _join(
            _rows(HEADER),
            _each(n_user, lambda i: _rows(F.format_string(USER_FRAME[0], i, i * 7 + 10, i), USER_FRAME[1])),
            _each(5, lambda i: _rows(F.format_string(VENV_FRAME[0], i, i + 30), VENV_FRAME[1])),
            _each(n_stdlib, lambda i: _rows(F.format_string(STDLIB_FRAME[0], i + 200), STDLIB_FRAME[1])),
            F.array(error),
        ),
        F.lit("\n"),
    )


def chained_tracebacks(n: Column) -> Column:
    blocks = [
        python_traceback(F.lit(2), F.lit(8), F.lit(f"{cls}: {message}")) for cls, message in CHAIN
    ]
    return F.array_join(F.slice(F.array(*blocks), F.lit(1), n), f"\n{CHAIN_LINK}\n\n")


def traceback_corpus(spark: SparkSession, items=TRACEBACKS, chains=CHAINS) -> DataFrame:
    single = spark.createDataFrame(
        list(items), "name string, n_user int, n_stdlib int, cls string, message string"
    )
    error = F.concat_ws(": ", "cls", "message")
    chained = spark.createDataFrame(list(chains), "name string, n int")
    return single.select(
        "name", python_traceback(F.col("n_user"), F.col("n_stdlib"), error).alias("text")
    ).unionByName(chained.select("name", chained_tracebacks(F.col("n")).alias("text")))


def rust_wall(codes: Column, replicas: Column) -> Column:
    def error(i: Column, r: Column) -> Column:
        line = r + 20
        return _rows(
            F.format_string(RUST_ERROR[0], i + 3000, i, r),
            F.format_string(RUST_ERROR[1], i, line),
            RUST_ERROR[2],
            F.format_string(RUST_ERROR[3], line),
            *RUST_ERROR[4:],
        )

    return _join(
        _rows(*RUST_HEAD),
        _each(codes, lambda i: _each(replicas, lambda r: error(i, r))),
        _rows(F.format_string(RUST_TAIL[0], codes * replicas), *RUST_TAIL[1:]),
    )


def gcc_wall(units: Column, errors: Column) -> Column:
    def error(u: Column, e: Column) -> Column:
        return _rows(
            F.format_string(GCC_ERROR[0], u, e + 15, e * 4 + 8, e),
            F.format_string(GCC_ERROR[1], e + 15, e),
            F.format_string(GCC_ERROR[2], F.repeat(F.lit("~"), F.length(e.cast("string")) + 17)),
        )

    return _join(
        _rows(GCC_HEAD), _each(units, lambda u: _each(errors, lambda e: error(u, e))), _rows(*GCC_TAIL)
    )


def build_corpus(spark: SparkSession, rust=RUST_WALLS, gcc=GCC_WALLS) -> DataFrame:
    shape = "name string, a int, b int"
    walls = [
        spark.createDataFrame(list(rows), shape).select(
            "name", wall(F.col("a"), F.col("b")).alias("text")
        )
        for rows, wall in ((rust, rust_wall), (gcc, gcc_wall))
    ]
    return walls[0].unionByName(walls[1])


def log_flood(n: Column, kinds: Column) -> Column:
    """Three lines of four are the first kind; the others go round all kinds."""
    lines = F.array(*[F.lit(x) for x in FLOOD_LINES])
    return _join(
        _each(n, lambda i: F.array(F.when((kinds == 1) | (i % 4 != 0), FLOOD_LINES[0]).otherwise(
            F.get(lines, i % kinds))))
    )


def flood_corpus(spark: SparkSession, items=FLOODS) -> DataFrame:
    rows = spark.createDataFrame(list(items), "name string, n int, kinds int")
    return rows.select("name", log_flood(F.col("n"), F.col("kinds")).alias("text"))


def mixed_corpus(spark: SparkSession, n: int = MIXED_ITEMS) -> DataFrame:
    tb = python_traceback(F.lit(2), F.lit(12), F.lit(": ".join(MIXED_ERROR)))
    head = _join(_rows(*MIXED_HEAD[:-1], F.format_string(MIXED_HEAD[-1], F.col("id"))))
    return spark.range(n).select(
        F.format_string("mixed_realistic_%d", "id").alias("name"),
        F.concat(head, F.lit("\n"), tb).alias("text"),
    )


def all_suites(spark: SparkSession) -> DataFrame:
    """The four corpora as ``(suite, name, text)``."""
    corpora = {
        "traceback": traceback_corpus, "build": build_corpus, "flood": flood_corpus,
        "mixed": mixed_corpus,
    }
    out = None
    for suite, make in corpora.items():
        part = make(spark).select(F.lit(suite).alias("suite"), "name", "text")
        out = part if out is None else out.unionByName(part)
    return out


def needle_corpus(spark: SparkSession) -> DataFrame:
    """Three logs ``(name, raw, needle)`` whose summary drops the needle."""
    dominant = lambda n: _each(n, lambda i: _rows(ALERT_FLOOD))
    flood = _join(
        dominant(150), _rows(ALERT), dominant(150),
        _each(12, lambda d: F.array_repeat(F.format_string(ALERT_DECOY, d), 3)),
    )
    traceback = F.concat(
        _join(
            _rows(HEADER),
            _each(6, lambda i: _rows(
                F.format_string('  File "/app/src/service_%d.py", line %d, in step_%d', i, i + 40, i),
                f"    charge(amount=99.99, {TOKEN})")),
            _each(12, lambda i: _rows(F.format_string(STDLIB_FRAME[0], i + 200), STDLIB_FRAME[1])),
            _rows("PaymentError: gateway declined charge"),
        ),
        F.lit("\n"),
    )
    rust = _join(
        _rows("   Compiling billing_core v0.3.1 (/workspace/billing)"),
        _each(12, lambda i: F.concat(
            _rows(
                F.format_string("error[E%04d]: mismatched types in `settle_batch_%d`", i + 3000, i),
                F.format_string("  --> src/settle/batch_%d.rs:%d:14", i, i + 20)),
            F.when(i == 7, _rows(f"   {NOTE}")).otherwise(F.array().cast("array<string>")))),
        _rows("error: aborting due to 12 previous errors", "error: could not compile `billing_core`"),
    )
    one = spark.range(1)
    logs = (("flood_buried_alert", flood, ALERT), ("traceback_dropped_value", traceback, TOKEN),
            ("rust_span_note", rust, NOTE))
    out = None
    for name, raw, needle in logs:
        part = one.select(F.lit(name).alias("name"), raw.alias("raw"), F.lit(needle).alias("needle"))
        out = part if out is None else out.unionByName(part)
    return out
