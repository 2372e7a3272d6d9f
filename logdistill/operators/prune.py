"""The prune chain: gates, ordered pruners, what is archived and what is shown."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect, summaries, text
from ..functions.arrays import bind
from ..functions.steps import with_once
from ..settings import MIN_LINES, SUMMARY_RATIO

# --- fixed values -----------------------------------------------------------
BANNER = "%s[%s] Compressed %d lines → %d lines  (%s)%s\n"
NOT_ARCHIVED = "full log not archived"
HINTED = "full log: %s %d"
HANDLE = "recall: %s #%d"
DIM, CYAN, RESET = "\x1b[2m", "\x1b[36m", "\x1b[0m"
# ----------------------------------------------------------------------------


class Pruner:
    """A named summariser. ``compress`` gives null where ``matches`` is false."""

    name = "pruner"
    description = ""
    version = "0.1.0"

    def matches(self, c: Column) -> Column:
        return self.compress(c).isNotNull()

    def compress(self, c: Column) -> Column:
        raise NotImplementedError

    def __repr__(self) -> str:
        return f"{type(self).__name__}(name={self.name!r})"

    def __str__(self) -> str:
        return f"{self.name} v{self.version} — {self.description}"


class OutputPruner(Pruner):
    """Tracebacks, Rust and GCC walls and log floods."""

    name = "output"
    description = "Collapses tracebacks, compiler walls and repetitive output"

    def __init__(
        self,
        dedup_threshold: float = detect.FLOOD_SHARE,
        max_rust_errors: int = summaries.RUST_ROWS,
    ) -> None:
        self.dedup_threshold = dedup_threshold
        self.max_rust_errors = max_rust_errors

    def matches(self, c: Column) -> Column:
        return detect.matches(c, self.dedup_threshold)

    def compress(self, c: Column) -> Column:
        return summaries.summarize(c, self.dedup_threshold, self.max_rust_errors)


class PythonPruner(Pruner):
    """Plain Python functions, run on Arrow batches; an error leaves the text as it is."""

    def __init__(
        self,
        name: str,
        matches: Callable[[str], bool],
        compress: Callable[[str], str | None],
        description: str = "",
    ) -> None:
        self.name, self.description = name, description

        def attempt(value: str | None) -> str | None:
            try:
                return compress(value) if value is not None and matches(value) else None
            except Exception:  # noqa: BLE001 - output must get through whatever a plug-in does
                return None

        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            return values.map(attempt)

        self._run = run

    def compress(self, c: Column) -> Column:
        return self._run(c)


def python_pruner(
    matches: Callable[[str], bool], compress: Callable[[str], str | None], name: str = "python"
) -> PythonPruner:
    return PythonPruner(name, matches, compress)


def small_output(df: DataFrame, min_lines: int = MIN_LINES, col: str = "raw_content") -> DataFrame:
    """Entries that pass through because they are short."""
    return df.where(text.line_count(F.col(col)) < min_lines)


def prune(
    entries: DataFrame,
    pruners: Sequence[Pruner] | None = None,
    min_lines: int = MIN_LINES,
    ratio: float = SUMMARY_RATIO,
) -> DataFrame:
    """Summarise ``raw_content``; the first pruner that saves enough wins.

    Adds ``compressed_summary``, ``was_pruned``, ``pruner_name``,
    ``net_tokens_saved``, ``line_count`` and ``token_estimate``. With native
    pruners this is one projection: no shuffle, no Python. A text on which a
    native pruner raises an error stays unpruned; the others are not touched.
    """
    pruners = [OutputPruner()] if pruners is None else list(pruners)
    raw = F.col("raw_content")
    df = entries.drop(*_PRUNED_COLUMNS)
    df = with_once(df, "line_count", text.line_count(raw))
    gate = (F.col("line_count") >= min_lines) & ~text.is_prompt(raw)

    native = all(not isinstance(p, PythonPruner) for p in pruners)
    if not native:
        # A Python UDF inside a lambda is not possible, so each candidate gets a
        # column of its own; the gate keeps texts from Python that need not go.
        # A text that has its summary goes to no further pruner.
        df = with_once(df, "_left0", F.when(gate, raw))
        for i, p in enumerate(pruners):
            left = F.col(f"_left{i}")
            if isinstance(p, PythonPruner):
                df = df.withColumn(f"_s{i}", p.compress(left))
                pick = _if_accepted(F.col(f"_s{i}"), p.name, raw, ratio)
            else:
                pick = F.when(left.isNotNull(), _candidate(p, left, raw, ratio))
            df = with_once(df, f"_pick{i}", pick)
            df = df.withColumn(
                f"_left{i + 1}", F.when(F.col(f"_pick{i}").isNull(), F.col(f"_left{i}"))
            )
        picks = [F.col(f"_pick{i}") for i in range(len(pruners))]
        df = df.withColumn("_pick", F.coalesce(*picks, _nothing()))
    else:
        candidates = [_candidate(p, raw, raw, ratio) for p in pruners]
        df = with_once(df, "_pick", F.when(gate, F.coalesce(*candidates, _nothing())))
    pick = F.col("_pick")
    return df.select(
        *[c for c in entries.columns if c not in _PRUNED_COLUMNS],
        F.coalesce(pick["summary"], F.lit("")).alias("compressed_summary"),
        pick["summary"].isNotNull().alias("was_pruned"),
        pick["pruner"].alias("pruner_name"),
        F.coalesce(
            text.net_tokens_saved(raw, pick["summary"]), F.lit(0).cast("bigint")
        ).alias("net_tokens_saved"),
        F.col("line_count"),
        text.token_estimate(raw).alias("token_estimate"),
    )


_PRUNED_COLUMNS = (
    "compressed_summary", "was_pruned", "pruner_name", "net_tokens_saved", "line_count",
    "token_estimate",
)


def _accept(name: str, raw: Column, ratio: float) -> Callable[[Column], Column]:
    return lambda summary: _if_accepted(summary, name, raw, ratio)


def _candidate(p: Pruner, c: Column, raw: Column, ratio: float) -> Column:
    """The pruner's accepted summary; an empty pick, which ends the chain, if it failed."""
    if type(p) is OutputPruner:
        return bind(p.compress(c), _accept(p.name, raw, ratio))
    accept = _accept(p.name, raw, ratio)
    empty = F.struct(F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("pruner"))
    return bind(
        _attempt(p.compress(c)),
        lambda x: F.when(x.isNull(), empty).when(
            x.startswith("="), bind(F.substr(x, F.lit(2)), accept)
        ),
    )


def _attempt(summary: Column) -> Column:
    """``=`` and the summary, ``-`` if there is none, null if its expression failed.

    Spark's ``try_`` functions turn an error of theirs or their argument into null for
    that row alone, so one bad text costs neither its task nor its micro-batch.
    """
    told = F.coalesce(F.concat(F.lit("="), summary.cast("string")), F.lit("-"))
    return F.try_to_binary(told, F.lit("utf-8")).cast("string")


def _nothing() -> Column:
    return F.lit(None).cast("struct<summary:string,pruner:string>")


def _if_accepted(summary: Column, name: str, raw: Column, ratio: float) -> Column:
    return F.when(
        text.saves_enough(summary, raw, ratio),
        F.struct(summary.alias("summary"), F.lit(name).alias("pruner")),
    )


def archived(pruned: DataFrame, cap: int | None = None) -> DataFrame:
    """What the archive keeps: pruned entries, and others up to ``cap`` bytes."""
    size = F.octet_length("raw_content")
    return pruned.where(text.archive_cap(F.col("was_pruned"), size, cap))


def injection(
    summary: Column,
    n_lines: Column,
    handle: Column,
    tag: str,
    hint: str | None = None,
    annotate: bool = True,
    color: bool = True,
) -> Column:
    """The summary as shown in place of the output, under a banner naming the handle."""
    cyan, dim, reset = (CYAN, DIM, RESET) if color else ("", "", "")
    body = F.concat(F.lit(cyan), summary, F.lit(reset + "\n"))
    if not annotate:
        return body
    recall = (
        F.format_string(HINTED, F.lit(hint), handle)
        if hint
        else F.format_string(HANDLE, F.lit(tag.lower()), handle)
    )
    banner = F.format_string(
        BANNER,
        F.lit(dim),
        F.lit(tag),
        n_lines,
        text.line_count(summary),
        F.when(handle.isNull(), NOT_ARCHIVED).otherwise(recall),
        F.lit(reset),
    )
    return F.concat(banner, body)


def render_injection(
    pruned: DataFrame,
    tag: str,
    hint: str | None = None,
    annotate: bool = True,
    color: bool = True,
) -> DataFrame:
    """Adds ``shown``: the injection of a pruned entry, the raw text of any other."""
    text_in = injection(
        F.col("compressed_summary"), F.col("line_count"), F.col("id"), tag, hint, annotate, color
    )
    return pruned.withColumn(
        "shown", F.when(F.col("was_pruned"), text_in).otherwise(F.col("raw_content"))
    )


def pipeline_counters(pruned: DataFrame) -> DataFrame:
    """Per session: bytes read, bytes injected, pruner hits, net tokens saved.

    Expects ``shown`` from ``render_injection``. The sums combine map-side, so a
    hot session costs one partial row per task. Works on a stream as well.
    """
    hit = F.col("was_pruned")
    return pruned.groupBy("session_id").agg(
        F.sum(F.octet_length("raw_content").cast("bigint")).alias("bytes_read"),
        F.sum(F.when(hit, F.octet_length("shown").cast("bigint")).otherwise(0)).alias(
            "bytes_injected"
        ),
        F.sum(hit.cast("bigint")).alias("pruner_hits"),
        F.sum("net_tokens_saved").alias("tokens_saved"),
    )


def live_compression(counters: DataFrame) -> DataFrame:
    """Tokens saved over a quarter of the bytes read; 0 when nothing was read."""
    read = F.floor(F.col("bytes_read") / 4)
    ratio = F.when(F.col("bytes_read") > 0, F.col("tokens_saved") / F.greatest(read, F.lit(1)))
    return counters.withColumn("compression", F.coalesce(ratio, F.lit(0.0)))
