"""Ranked full-text search over raw text, summary and entry type.

An index is two tables: ``postings(term, entry_id, doc_len, tf, positions)`` and
``documents(entry_id, doc_len)``. Positions count over the columns laid end to
end with a gap between them, so a phrase never spans two columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.arrays import bind, runs
from ..functions.steps import with_once
from ..functions.stem import MAX_REWRITTEN, porter
from ..functions.words import postings_of
from ..shared import file_names, scratch, written
from ..sources.tables import without_deleted

# --- fixed values -----------------------------------------------------------
COLUMNS = ("raw_content", "compressed_summary", "entry_type")
SEPARATORS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K1, B = 1.2, 0.75
MIN_IDF = 1e-6
# ----------------------------------------------------------------------------

#: Entries whose postings of a term share one row of maxima.
BLOCK = 1024
#: Ranges of entries in the filter of a scan, at most.
RANGES = 64


# --- query combinators ------------------------------------------------------
@dataclass(frozen=True)
class Phrase:
    """Adjacent words of one column; with ``prefix`` the last one may go on."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Match:
    """``all``, ``any`` or ``none`` (the first part without the others)."""

    kind: str
    parts: tuple[Phrase | Match, ...]


Expr = Phrase | Match


def _words(s: str) -> tuple[str, ...]:
    folded = s.translate(str.maketrans(UPPER, LOWER))
    return tuple(w for w in re.split(SEPARATORS, folded) if w)


def term(word: str) -> Phrase:
    """One word; a word with separators in it is the phrase of its pieces."""
    return Phrase(_words(word))


def phrase(text: str) -> Phrase:
    return Phrase(_words(text))


def prefix(start: str) -> Phrase:
    return Phrase(_words(start), prefix=True)


def all_of(*parts: Expr) -> Match:
    return Match("all", parts)


def any_of(*parts: Expr) -> Match:
    return Match("any", parts)


def none_of(keep: Expr, *drop: Expr) -> Match:
    return Match("none", (keep, *drop))


def _leaves(e: Expr) -> list[Phrase]:
    return [e] if isinstance(e, Phrase) else [x for p in e.parts for x in _leaves(p)]


def _holds(e: Expr, count: dict[Phrase, Column]) -> Column:
    if isinstance(e, Phrase):
        return count[e] > 0
    tests = [_holds(p, count) for p in e.parts]
    out = tests[0]
    for t in tests[1:]:
        out = out & t if e.kind == "all" else out | t if e.kind == "any" else out & ~t
    return out


# --- tokens -----------------------------------------------------------------
def tokens(c: Column) -> Column:
    """ASCII letters and digits and all non-ASCII characters form words."""
    parts = F.split(F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(parts, lambda t: t != "")


def _all_tokens(columns: tuple[str, ...]) -> Column:
    gap = F.array(F.lit(""))
    arrays: list[Column] = []
    for name in columns:
        arrays += [tokens(F.col(name)), gap]
    return F.concat(*arrays)


def _tagged(toks: Column) -> Column:
    return F.filter(
        F.transform(toks, lambda t, i: F.struct(t.alias("key"), i.alias("pos"))),
        lambda x: x["key"] != "",
    )


def _stemmed(tagged: Column) -> Column:
    """Stem each distinct word of an entry once and sort the words again."""
    spread = F.transform(
        runs(F.array_sort(tagged)),
        lambda r: bind(
            porter(r["key"]),
            lambda s: F.transform(r["at"], lambda p: F.struct(s.alias("key"), p.alias("pos"))),
        ),
    )
    return F.flatten(spread)


def _doc_len(toks: Column, columns: tuple[str, ...]) -> Column:
    """Words among the tokens, which hold one gap per column."""
    return (F.size(toks) - len(columns)).cast("bigint")


def build_postings(
    entries: DataFrame, columns: tuple[str, ...] = COLUMNS
) -> DataFrame:
    """The index: words are grouped, stemmed and counted inside the entry's task.

    No shuffle; a word costs one row per entry however often it occurs there, and is
    stemmed once per task.
    """
    return _postings(entries, columns)


def _postings(entries: DataFrame, columns: tuple[str, ...], lengths: bool = False) -> DataFrame:
    """``build_postings``; with ``lengths`` also a row without a term for every entry."""
    rows = entries.select(F.col("id").alias("entry_id"), *[F.col(c).cast("string") for c in columns])
    schema = StructType.fromDDL(schemas.POSTING)
    schema["entry_id"].dataType = rows.schema["entry_id"].dataType
    schema["positions"].dataType.containsNull = False
    return rows.mapInArrow(postings_of(to_arrow_schema(schema), lengths), schema)


def document_lengths(entries: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Words of every entry: the pieces between separators, less empty ones at the ends."""
    def words(c: Column) -> Column:
        first, last = F.element_at(c, 1), F.element_at(c, -1)
        return F.size(c) - F.when((F.size(c) == 1) & (first == ""), 1).otherwise(
            (first == "").cast("int") + (last == "").cast("int")
        )

    n = F.lit(0)
    for name in columns:
        n = n + bind(F.split(F.coalesce(F.col(name), F.lit("")), SEPARATORS), words)
    return entries.select(F.col("id").alias("entry_id"), n.cast("bigint").alias("doc_len"))


def write_index(
    entries: DataFrame,
    path: str,
    columns: tuple[str, ...] = COLUMNS,
    commit: str | None = None,
) -> None:
    """Range-partitioned on (term, entry): a hot term spreads over many files, and
    the sorted files let a search skip all row groups without its terms.

    A commit has folders of its own, so an index grows with its archive; written
    again, it replaces itself. Without one the whole index is replaced.
    """
    order = ("term", "entry_id")
    part = f"/commit={commit}" if commit else ""
    with scratch(entries.sparkSession, "index") as folder:
        # Range partitioning samples its input first: written, it is built once, and the
        # texts are read once for words and lengths.
        built = written(_postings(entries, columns, lengths=True), "postings", folder)
        (
            built.where(F.col("term").isNotNull())
            .repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .write.mode("overwrite")
            .option("parquet.page.row.count.limit", BLOCK)  # a range of entries skips pages
            .parquet(f"{path}/postings{part}")
        )
        built.where(F.col("term").isNull()).select("entry_id", "doc_len").write.mode(
            "overwrite"
        ).parquet(f"{path}/documents{part}")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and document lengths of an archive without its deleted entries."""
    postings, documents = (
        without_deleted(spark.read.schema(schema).parquet(f"{path}/{name}"), path, "entry_id")
        for name, schema in (("postings", schemas.POSTING), ("documents", schemas.DOCUMENT))
    )
    return postings, documents


def term_frequencies(postings: DataFrame) -> DataFrame:
    """Per term: entries that hold it and occurrences in all."""
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    )


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: number of entries and their mean length in words."""
    return documents.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len")
    )


# --- counting hits ----------------------------------------------------------
def _phrase_count(slots: list[Column]) -> Column:
    """Occurrences of a phrase from the positions of its words."""
    def moved(s: Column, by: int) -> Column:
        return F.transform(s, lambda p: p - by)

    if not slots:  # separators only: no word, no occurrence
        return F.lit(0)
    found = slots[0]
    for i, s in enumerate(slots[1:], start=1):
        found = F.array_intersect(found, moved(s, i))
    return F.coalesce(F.size(found), F.lit(0))


def _stems(spark: SparkSession, leaves: list[Phrase]) -> dict[str, str]:
    """Stems of the query's words: a local relation, folded without a job."""
    words = sorted({w for p in leaves for w in p.words})
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    return {r.word: r.stem for r in rows.select("word", porter(F.col("word")).alias("stem")).collect()}


def _hit(key: Column, p: Phrase, i: int, stems: dict[str, str]) -> Column:
    stem = stems[p.words[i]]
    return key.startswith(stem) if p.prefix and i == len(p.words) - 1 else key == stem


def _counts_in_entries(
    entries: DataFrame, leaves: list[Phrase], columns: tuple[str, ...]
) -> DataFrame:
    """Hits per entry straight from the text, in one projection.

    Only words that could have a wanted stem are stemmed, each once per entry: a
    stem keeps all but its last ``MAX_REWRITTEN`` letters of the word.
    """
    stem_of = _stems(entries.sparkSession, leaves)
    starts = sorted({s[: max(len(s) - MAX_REWRITTEN, 1)] for s in stem_of.values()})

    def candidate(key: Column) -> Column:
        found = F.lit(False)
        for start in starts:
            found = found | key.startswith(start)
        return found

    def slot(stems: Column, p: Phrase, i: int) -> Column:
        return F.filter(stems, lambda x: _hit(x["key"], p, i, stem_of))["pos"]

    def count(stems: Column) -> list[Column]:
        return [
            _phrase_count([slot(stems, p, i) for i in range(len(p.words))]).alias(f"c{j}")
            for j, p in enumerate(leaves)
        ]

    def whole(t: Column) -> Column:
        found = F.transform(
            t, lambda w, i: F.when(candidate(w), F.struct(w.alias("key"), i.alias("pos")))
        )
        stems = _stemmed(F.filter(found, lambda x: x.isNotNull()))
        return bind(stems, lambda s: F.struct(_doc_len(t, columns).alias("doc_len"), *count(s)))

    found = bind(_all_tokens(columns), whole)
    keep = [c for c in ("session_id",) if c in entries.columns]
    rows = entries.select(F.col("id").alias("entry_id"), *keep, *columns)
    return with_once(rows, "x", found).select("entry_id", *keep, "x.*")


def _counts_in_postings(postings: DataFrame, leaves: list[Phrase]) -> DataFrame:
    """Hits per entry from the index; the term filter reaches the Parquet scan."""
    key = F.col("term")
    stem_of = _stems(postings.sparkSession, leaves)
    wanted = F.lit(False)
    for p in leaves:
        for i in range(len(p.words)):
            wanted = wanted | _hit(key, p, i, stem_of)

    def slot(p: Phrase, i: int) -> Column:
        # One row per exact term and entry; a prefix gathers its terms' positions,
        # which are bounded by the length of the entry.
        mine = F.when(_hit(key, p, i, stem_of), F.col("positions"))
        return F.flatten(F.collect_list(mine))

    slots = {(j, i): f"s{j}_{i}" for j, p in enumerate(leaves) for i in range(len(p.words))}
    per = postings.where(wanted).groupBy("entry_id").agg(
        F.max("doc_len").alias("doc_len"),
        *[slot(leaves[j], i).alias(name) for (j, i), name in slots.items()],
    )
    return per.select(
        "entry_id",
        "doc_len",
        *[
            _phrase_count([F.col(slots[j, i]) for i in range(len(p.words))]).alias(f"c{j}")
            for j, p in enumerate(leaves)
        ],
    )


def _rank(counts: DataFrame, documents: DataFrame, leaves: list[Phrase]) -> Column:
    """Negated BM25; statistics always cover the whole index."""
    corpus = corpus_stats(documents).select(F.struct("n_docs", "avg_len").alias("s")).scalar()
    holding = [F.count(F.when(F.col(f"c{j}") > 0, 1)).alias(f"d{j}") for j in range(len(leaves))]
    hits = counts.agg(F.struct(*holding).alias("d")).scalar()
    tfs = [F.col(f"c{j}") for j in range(len(leaves))]
    dfs = [hits[f"d{j}"] for j in range(len(leaves))]
    return -_score(tfs, dfs, [F.col("doc_len")] * len(leaves), corpus["n_docs"], corpus["avg_len"])


def _score(
    tfs: list[Column], dfs: list[Column], lengths: list[Column], n_docs: Column, avg_len: Column
) -> Column:
    total = F.lit(0.0)
    for tf, df, doc_len in zip(tfs, dfs, lengths, strict=True):
        idf = F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(MIN_IDF))
        length = F.lit(1 - B) + F.lit(B) * doc_len / avg_len
        total = total + idf * (tf * (K1 + 1)) / (tf + F.lit(K1) * length)
    return total


def _ranked(
    counts: DataFrame, documents: DataFrame, expr: Expr, leaves: list[Phrase]
) -> DataFrame:
    by_leaf = {p: F.col(f"c{j}") for j, p in enumerate(leaves)}
    return counts.where(_holds(expr, by_leaf)).withColumn(
        "rank", _rank(counts, documents, leaves)
    )


def rank_entries(
    entries: DataFrame, expr: Expr, columns: tuple[str, ...] = COLUMNS
) -> DataFrame:
    """All matching entries with their rank (smaller is better), without an index."""
    leaves = _leaves(expr)
    # Counts without text, written once: statistics and scores both need them,
    # and the texts are to be read only once.
    counts = written(_counts_in_entries(entries, leaves, columns), "hits")
    keep = [c for c in ("session_id",) if c in counts.columns]
    return _ranked(counts, counts, expr, leaves).select("entry_id", *keep, "rank")


def rank_postings(postings: DataFrame, documents: DataFrame, expr: Expr) -> DataFrame:
    """All matching entries with their rank, from a written index."""
    leaves = _leaves(expr)
    counts = written(_counts_in_postings(postings, leaves), "hits")
    return _ranked(counts, documents, expr, leaves).select("entry_id", "rank")


def top(ranked: DataFrame, limit: int = 20) -> DataFrame:
    return ranked.orderBy("rank", "entry_id").limit(limit)


def search_entries(
    entries: DataFrame,
    expr: Expr,
    session_id: str | None = None,
    limit: int = 20,
    columns: tuple[str, ...] = COLUMNS,
) -> DataFrame:
    """Best entries for ``expr``; the session filter applies after ranking."""
    ranked = rank_entries(entries, expr, columns)
    if session_id is not None:
        ranked = ranked.where(F.col("session_id") == session_id)
    return with_entry(top(ranked.select("entry_id", "rank"), limit), entries)


def search(
    postings: DataFrame,
    documents: DataFrame,
    entries: DataFrame,
    expr: Expr,
    session_id: str | None = None,
    limit: int = 20,
) -> DataFrame:
    """The same from an index written by ``write_index``."""
    ranked = rank_postings(postings, documents, expr)
    if session_id is not None:
        mine = entries.where(F.col("session_id") == session_id).select(
            F.col("id").alias("entry_id")
        )
        ranked = ranked.join(mine, "entry_id", "left_semi")
    return with_entry(top(ranked, limit), entries)


def with_entry(best: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries of a top-k list with their ranks."""
    # Spark broadcasts a short list by itself: the entries are scanned where they lie.
    return entries.join(best, F.col("id") == F.col("entry_id")).drop("entry_id")


# --- the best entries without reading whole posting lists --------------------------------
def write_maxima(spark: SparkSession, path: str, commit: str | None = None) -> None:
    """Per term and block of entries: how many hold it, how often at most, the shortest.

    No score of the block is above that of its most frequent, shortest entry, whatever
    the mean length will be when the archive has grown. Call it after ``write_index``
    with the same commit; lengths are kept as one row per commit.
    """
    part = f"/commit={commit}" if commit else ""
    postings = spark.read.schema(schemas.POSTING).parquet(f"{path}/postings{part}")
    documents = spark.read.schema(schemas.DOCUMENT).parquet(f"{path}/documents{part}")
    (
        postings.groupBy("term", _block().alias("block"))
        .agg(
            F.count(F.lit(1)).alias("df"), F.max("tf").alias("most"), F.min("doc_len").alias("shortest")
        )
        .sortWithinPartitions("term", "block")
        .write.mode("overwrite")
        .parquet(f"{path}/maxima{part}")
    )
    documents.agg(
        F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("n_words")
    ).write.mode("overwrite").parquet(f"{path}/lengths{part}")


def _block() -> Column:
    return F.floor(F.col("entry_id") / BLOCK)


def _may_hold(e: Expr, there: dict[Phrase, Column]) -> Column:
    """Whether a block can have a match: words that must be missing tell nothing."""
    if isinstance(e, Phrase):
        return there[e]
    tests = [_may_hold(p, there) for p in e.parts]
    out = tests[0]
    for t in tests[1:]:
        out = out & t if e.kind == "all" else out | t if e.kind == "any" else out
    return out


@dataclass(frozen=True)
class _Statistics:
    """What scores need to know of an index, numbers only."""

    n_docs: int
    avg_len: float
    stems: list[str]
    dfs: list[int]

    def score(self, tfs: list[Column], lengths: list[Column]) -> Column:
        dfs = [F.lit(d) for d in self.dfs]
        return _score(tfs, dfs, lengths, F.lit(self.n_docs), F.lit(self.avg_len))


def _statistics(spark: SparkSession, path: str, maxima: DataFrame, stems: list[str]) -> _Statistics:
    """From the kept sums; of deleted entries, what they held is taken off again."""
    df = {r.term: r.n for r in maxima.groupBy("term").agg(F.sum("df").alias("n")).collect()}
    lengths = spark.read.schema("n_docs BIGINT, n_words BIGINT").parquet(f"{path}/lengths")
    n_docs, n_words = lengths.agg(F.sum("n_docs"), F.sum("n_words")).first()
    if file_names(spark, f"{path}/deleted"):
        gone = spark.read.schema("id BIGINT").parquet(f"{path}/deleted").distinct()
        here = F.col("entry_id") == F.col("id")
        postings = spark.read.schema(schemas.POSTING).parquet(f"{path}/postings")
        lost = postings.where(F.col("term").isin(stems)).join(gone, here, "left_semi")
        for r in lost.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():
            df[r.term] -= r.n
        documents = spark.read.schema(schemas.DOCUMENT).parquet(f"{path}/documents")
        lost_docs, lost_words = (
            documents.join(gone, here, "left_semi")
            .agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_len"), F.lit(0)))
            .first()
        )
        n_docs, n_words = n_docs - lost_docs, n_words - lost_words
    return _Statistics(n_docs or 0, n_words / n_docs if n_docs else 1.0, stems, [df.get(s, 0) for s in stems])


def _in_ranges(ranges: list[tuple[int, int]]) -> Column:
    """Entries of the blocks from .. to .., as a filter that reaches the scan."""
    found = F.lit(False)
    for first, last in ranges:
        found = found | F.col("entry_id").between(first * BLOCK, last * BLOCK + BLOCK - 1)
    return found


def _ranges(blocks: DataFrame) -> list[tuple[int, int]]:
    """All the blocks in up to ``RANGES`` ranges, which may hold others too."""
    low, high = blocks.agg(F.min("block"), F.max("block")).first()
    if low is None:
        return []
    stretch = (high - low) // RANGES + 1
    rows = (
        blocks.groupBy(F.floor((F.col("block") - low) / stretch).alias("stretch"))
        .agg(F.min("block").alias("first"), F.max("block").alias("last"))
        .collect()
    )
    return sorted((r["first"], r["last"]) for r in rows)


def best_ranges(
    spark: SparkSession, path: str, expr: Expr, limit: int = 20
) -> tuple[list[tuple[int, int]], _Statistics]:
    """Ranges of blocks that hold the best ``limit`` matches, ties included, by maxima.

    The matches of the ``limit`` blocks with the largest bounds give a score to reach;
    only blocks whose bound reaches it are left. Without that many matches all are.
    """
    leaves = _leaves(expr)
    stem_of = _stems(spark, leaves)
    stems = [stem_of[p.words[0]] for p in leaves]
    schema = "term STRING, block BIGINT, df BIGINT, most INT, shortest BIGINT"
    stored = spark.read.schema(schema).parquet(f"{path}/maxima").where(F.col("term").isin(stems))
    stats = _statistics(spark, path, stored, stems)
    by_leaf = [F.col("term") == s for s in stems]
    merged = stored.groupBy("block").agg(
        *[F.max(F.when(t, F.col("most"))).alias(f"t{j}") for j, t in enumerate(by_leaf)],
        *[F.min(F.when(t, F.col("shortest"))).alias(f"l{j}") for j, t in enumerate(by_leaf)],
    )
    most = [F.coalesce(f"t{j}", F.lit(0)) for j in range(len(leaves))]
    shortest = [F.coalesce(f"l{j}", F.lit(0)) for j in range(len(leaves))]
    there = {p: F.col(f"t{j}").isNotNull() for j, p in enumerate(leaves)}
    bounds = written(
        merged.where(_may_hold(expr, there)).select("block", stats.score(most, shortest).alias("bound")),
        "bounds",
    )
    first = bounds.orderBy(F.desc("bound"), "block").limit(limit)
    ranges = [(r.block, r.block) for r in first.collect()]
    reached = _best_in(spark, path, expr, ranges, stats, limit).agg(F.count(F.lit(1)), F.max("rank")).first()
    if reached[0] == limit:
        # Bounds and scores are sums in the same order, but for the last bit.
        bounds = bounds.where(F.col("bound") >= -reached[1] * (1 - 1e-12))
    return _ranges(bounds), stats


def _best_in(
    spark: SparkSession, path: str, expr: Expr, ranges: list[tuple[int, int]], stats: _Statistics, limit: int
) -> DataFrame:
    leaves = _leaves(expr)
    postings, _ = read_index(spark, path)
    counts = (
        postings.where(F.col("term").isin(stats.stems) & _in_ranges(ranges))
        .groupBy("entry_id")
        .agg(
            F.max("doc_len").alias("doc_len"),
            *[
                F.coalesce(F.max(F.when(F.col("term") == s, F.col("tf"))), F.lit(0)).alias(f"c{j}")
                for j, s in enumerate(stats.stems)
            ],
        )
    )
    tfs = {p: F.col(f"c{j}") for j, p in enumerate(leaves)}
    score = stats.score([F.col(f"c{j}") for j in range(len(leaves))], [F.col("doc_len")] * len(leaves))
    return top(counts.where(_holds(expr, tfs)).select("entry_id", (-score).alias("rank")), limit)


def top_entries(spark: SparkSession, path: str, expr: Expr, limit: int = 20) -> DataFrame:
    """The best entries of a stored index with maxima: those of ``top(rank_postings(…))``.

    Postings of blocks that cannot hold one of them are not read. Phrases and prefixes,
    whose counts no maxima tell, are ranked in full.
    """
    if any(len(p.words) != 1 or p.prefix for p in _leaves(expr)):
        return top(rank_postings(*read_index(spark, path), expr), limit)
    ranges, stats = best_ranges(spark, path, expr, limit)
    return _best_in(spark, path, expr, ranges, stats, limit)
