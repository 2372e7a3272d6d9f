"""Secret scans: trigram index first, regular expressions on what it leaves.

For each rule the regular expression is turned into a Boolean query over
trigrams that every match must contain (in lower case). The inverted index
holds the postings (trigram, document) of the trigrams that occur in a query;
a rule's candidates come from intersecting postings, and only candidates are
searched. A rule without a mandatory trigram searches every text.

Offsets count code points; ends are exclusive. Null texts count as empty and
have no spans. Rows that share a document id are searched if any of them is a
candidate, each in its own text; a null id is a key like any other.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..functions.steps import with_once
from ..shared import written
from .common import packed, running_sums, text_of


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# The patterns. Runs below their least length are not matched one by one.
BASE = (
    Rule(
        "assign",
        r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
        r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?"""
        r"""([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE

# --- Boolean trigram queries ---------------------------------------------------
Clause = frozenset[frozenset[str]]  # any of these sets of trigrams, each of them whole
MAX_EXACT = 64  # strings followed side by side


def _clause(strings: set[str]) -> Clause | None:
    """What one of ``strings`` in the text implies, or None if nothing."""
    if any(len(s) < 3 for s in strings):
        return None
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return frozenset(s for s in sets if not any(o < s for o in sets))


def _strings(op: object, arg) -> set[str] | None:
    """The lower-case strings one pattern element stands for, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN" and not any(str(o) in ("NEGATE", "CATEGORY") for o, _ in arg):
        chars: set[str] = set()
        for o, a in arg:
            chars |= {chr(a)} if str(o) == "LITERAL" else {chr(c) for c in range(a[0], a[1] + 1)}
        chars = {c.lower() for c in chars}
        return chars if len(chars) <= 4 else None
    if name == "SUBPATTERN":
        return _sequence_strings(arg[-1])
    if name == "BRANCH":
        parts = [_sequence_strings(b) for b in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if name == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1:
        inner = _sequence_strings(arg[2])
        return inner | {""} if inner is not None else None
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        some = _strings(op, arg)
        if some is None or len(out) * len(some) > MAX_EXACT:
            return None
        out = {a + b for a, b in itertools.product(out, some)}
    return out


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that all hold for a lower-case text with a match; none: no bound."""
    clauses: list[Clause | None] = []
    run = {""}
    for op, arg in re._parser.parse(pattern):
        some = _strings(op, arg)
        if some is not None and len(run) * len(some) <= MAX_EXACT:
            run = {a + b for a, b in itertools.product(run, some)}
            continue
        clauses.append(_clause(run))
        run = some if some is not None else {""}
    clauses.append(_clause(run))
    return list(dict.fromkeys(c for c in clauses if c))


# --- Index and candidates ------------------------------------------------------
def postings(docs: DataFrame, trigrams: list[str], key: str = "doc_id") -> DataFrame:
    """The inverted index: one row per trigram and document that holds it."""
    terms = F.array(*[F.lit(t) for t in trigrams])
    held = bind(F.lower("text"), lambda low: F.filter(terms, lambda t: F.contains(low, t)))
    return (
        packed(docs, key=F.col(key), text=text_of())
        .select("key", F.explode(held).alias("trigram"))
        .distinct()
    )


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``key`` and the kinds of the rules it may match, from the index alone."""
    wanted = [
        (rule.kind, len(query), c, a, len(grams), g)
        for rule in rules
        for query in [trigram_query(rule.pattern)]
        for c, clause in enumerate(query)
        for a, grams in enumerate(sorted(clause, key=sorted))
        for g in sorted(grams)
    ]
    terms = index.sparkSession.createDataFrame(
        wanted, "kind string, clauses int, clause int, side int, size int, trigram string"
    )
    by = ["key", "kind", "clauses", "clause"]
    return (
        index.join(F.broadcast(terms), "trigram")  # bounded by the rules
        .groupBy(*by, "side", "size").agg(F.count("*").alias("n")).where("n = size")
        .select(*by).distinct()
        .groupBy("key", "kind", "clauses").agg(F.count("*").alias("n")).where("n = clauses")
        .groupBy("key").agg(F.collect_set("kind").alias("kinds"))  # no more than rules
    )


# --- Spans ---------------------------------------------------------------------
def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost matches that do not overlap, as structs that sort by place, then rule."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))

    def placed(matches: Column) -> Column:
        between = F.transform(F.split(text, rule.pattern, -1), F.length)
        lengths = F.transform(matches, F.length)

        def cut(gaps: Column, sizes: Column, kept: Column) -> Column:
            spans = F.transform(
                matches,
                lambda _, k: F.struct(
                    (F.get(gaps, k + 1) + F.get(sizes, k)).alias("start"),
                    F.lit(order).alias("rank"),
                    (F.get(gaps, k + 1) + F.get(sizes, k + 1)).alias("end"),
                    F.lit(rule.kind).alias("kind"),
                ),
            )
            return F.filter(spans, lambda _, k: F.length(F.get(kept, k)) >= rule.least)

        return bind(
            running_sums(between),
            lambda g: bind(
                running_sums(lengths), lambda s: bind(held, lambda h: cut(g, s, h))
            ),
        )

    return bind(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array()))


def found(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """``row`` (the input row), ``text`` and ``spans`` sorted by start, then rule."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({g for q in queries.values() for c in q for s in c for g in s})
    indexed = tuple(r for r in rules if queries[r.kind])
    index = written(postings(docs, trigrams, key), "postings")
    may = candidates(index, indexed)
    d = packed(docs, key=F.col(key), text=text_of())
    d = d.join(may, d["key"].eqNullSafe(may["key"]), "left").select("row", "text", "kinds")
    empty = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string>>")
    parts = [
        F.when(F.array_contains("kinds", r.kind), _spans(F.col("text"), r, i)).otherwise(empty)
        if queries[r.kind]
        else _spans(F.col("text"), r, i)
        for i, r in enumerate(rules)
    ]
    return with_once(d, "spans", F.sort_array(F.concat(empty, *parts))).select("row", "text", "spans")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    spans = F.col("spans")
    base = [r.kind for r in BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    of_base = F.filter(spans, lambda s: s["kind"].isin(base))
    return found(docs, rules, key).select(
        F.col(f"row.{key}").alias(key),
        *[count(k) for k in base],
        F.sha2(listed(of_base), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every span, overlapping ones as one, replaced by ``mark``.

    ``n_chars``, where the input has it, counts the new text.
    """
    d = found(docs, rules)

    def joined(spans: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            first = (acc["at"] == 0) & (acc["out"] == "")
            gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
            return F.struct(
                F.when(fresh & ((s["start"] > acc["at"]) | first), F.concat(acc["out"], gap, F.lit(mark)))
                .otherwise(acc["out"]).alias("out"),
                F.greatest(acc["at"], s["end"]).alias("at"),
            )

        return F.aggregate(spans, start, step)

    rest = F.substring(F.col("text"), (F.col("cut.at") + 1).cast("int"), F.length("text"))
    clean = F.concat(F.col("cut.out"), rest)
    changed = F.size("spans") > 0
    # the whole row passes the steps: Spark would take it apart below them
    d = with_once(d.select("row", "text", "spans", joined(F.col("spans")).alias("cut")), "made", F.struct(
        *[
            F.when(changed, clean).otherwise(F.col("row.text")).alias(f.name) if f.name == "text"
            else F.when(changed, F.length(clean).cast(f.dataType)).otherwise(F.col("row.n_chars")).alias(f.name)
            if f.name == "n_chars"
            else F.col(f"row.`{f.name}`").alias(f.name)
            for f in docs.schema.fields
        ]
    ))
    return d.select("made.*")
