"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over one document; the table of
thresholds becomes one array expression of the rules that a document breaks.
No shuffle, no user function: the whole operator is one narrow stage.

Null texts count as empty (0 words, so ``base_failed``). Repeated rows are
judged one by one; extra columns travel inside ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..functions.steps import with_once
from .common import packed, text_of, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as are from by at this have or not he his "
    "der die das und ist den von zu mit dem ein eine nicht im auch auf sich des "
    "de la le les et en un une du que est pour dans qui par sur au ne se pas "
    "el los las y es por con una del al lo como para su"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= part / whole <= high``; a whole of nothing breaks no rule."""

    name: str
    part: str
    whole: str
    low: float = 0.0
    high: float = float("inf")

    def broken(self, m: Column) -> Column:
        ratio = m[self.part].cast("double") / m[self.whole].cast("double")
        tests = []
        if self.low > 0:
            tests.append(ratio < F.lit(self.low))
        if self.high != float("inf"):
            tests.append(ratio > F.lit(self.high))
        test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        return (m[self.whole] > 0) & test


TABLE = (
    Rule("word_length", "word_chars", "n_words", low=2.5, high=12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.04),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("line_length", "n_words", "n_lines", low=1.5),
)
MIN_WORDS, REPEATED_PERCENT, WINDOW = 20, 30, 8


def _long(c: Column) -> Column:
    return c.cast("bigint")


def repeated_words(ws: Column, n: int = WINDOW) -> Column:
    """Words inside windows of ``n`` words found twice or more in the text.

    A window is known by the hash of its words' hashes. Only texts with a
    repeated window sort theirs, to find the places to mark.
    """

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(hashes) - (n - 1)),
            lambda i: F.xxhash64(F.slice(hashes, i, F.lit(n))),
        )

    def places(sorted_windows: Column) -> Column:
        def alike(k: Column, h: Column) -> Column:
            return F.coalesce(F.get(sorted_windows, k)["h"] == h, F.lit(False))

        marked = F.transform(
            sorted_windows,
            lambda s, k: F.when(alike(k - 1, s["h"]) | alike(k + 1, s["h"]), s["i"]),
        )
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        fresh = F.transform(
            at, lambda i, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - i, F.lit(n)))
        )
        return F.aggregate(fresh, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def of(wins: Column) -> Column:
        pairs = F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        repeats = F.size(F.array_distinct(wins)) < F.size(wins)
        return F.when(
            repeats, bind(F.sort_array(pairs), lambda s: bind(places(s), covered))
        ).otherwise(F.lit(0).cast("bigint"))

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) >= n, bind(hashes, lambda h: bind(windows(h), of))).otherwise(
        F.lit(0).cast("bigint")
    )


def judged(docs: DataFrame, table: tuple[Rule, ...] = TABLE) -> DataFrame:
    """``row`` (the input row) and ``quality``: measures, broken rules and verdict."""
    d = with_once(packed(docs, text=text_of()), "words", words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ws = F.col("words")
    stop = F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS)))
    counts = [
        _long(F.size(ws)).alias("n_words"),
        _long(F.length(F.array_join(ws, ""))).alias("word_chars"),
        _long(F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        bind(
            lines,
            lambda x: F.struct(
                _long(F.size(x)).alias("n"), _long(F.size(F.array_distinct(x))).alias("distinct")
            ),
        ).alias("lines"),
        _long(stop).alias("n_stop_words"),
        repeated_words(ws).alias("n_repeat_words"),
    ]
    d = with_once(d, "c", F.struct(*counts)).select(
        "row",
        F.struct(
            "c.n_words", "c.word_chars", "c.n_symbols",
            (F.col("c.lines.n") - F.col("c.lines.distinct")).alias("n_dup_lines"),
            "c.n_repeat_words", F.col("c.lines.n").alias("n_lines"), "c.n_stop_words",
        ).alias("m"),
    )
    m = F.col("m")
    base = (m["n_words"] < MIN_WORDS) | (
        F.lit(100) * m["n_repeat_words"] > F.lit(REPEATED_PERCENT) * m["n_words"]
    )
    broken = F.filter(
        F.array(*[F.when(r.broken(m), F.lit(r.name)) for r in table]), lambda r: r.isNotNull()
    )
    d = d.select("row", "m", base.alias("base_failed"), broken.alias("broken"))
    kept = ~F.col("base_failed") & (F.size("broken") == 0)
    return d.select("row", F.struct("m.*", "base_failed", "broken", kept.alias("kept")).alias("quality"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the measures and the verdict."""
    return judged(docs).select(
        "row.doc_id",
        "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines",
        "quality.n_repeat_words", "quality.n_lines", "quality.n_stop_words",
        "quality.base_failed", "quality.kept",
        F.array_join("quality.broken", ",").alias("broken_rules"),
    )


def kept(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they were."""
    return with_once(judged(docs), "ok", F.col("quality.kept")).where("ok").select("row.*")
