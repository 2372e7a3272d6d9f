"""Benchmark decontamination by templates.

A text becomes a sequence of tokens: words in lower case without outer
punctuation, with numbers, units after a number, and names (capitalised inside
a sentence) replaced by typed placeholders. Windows of ``WINDOW`` tokens are
hashed; documents and benchmark items that share a window's template are joined
on the hash. A re-parameterised question fills the slots differently but as a
function of the item's: slots that were equal stay equal, of the same types;
different ones may become equal by chance. Which slots are equal is a pattern
next to the hash, checked after the join on the hash. There are four ``FORMS``: names as slots
inside sentences; names as slots wherever they stand, also at the start of a
sentence; names as words, which makes the match blind to case; and exact, where
every token stands for itself and no slot exists.

Items shorter than a window are matched whole, down to ``SHORTEST`` tokens, or
to one token in the exact form. Windows of the other forms need ``MIN_LITERAL``
tokens that are not slots, or half of a short one; exact windows need none.
Null texts are empty; null ids travel as they are; rows that repeat an id are
one document in the report.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .common import packed, row_key, text_of
from .wordhash import STEP, mix

WINDOW, SHORTEST, MIN_LITERAL = 13, 5, 6
INDEX_LIMIT = 2_000_000  # benchmark windows held by each task; beyond, all windows are joined
CACHE_WORDS = 300_000

# Units that may follow a number.
UNITS = frozenset(
    "% mm cm m km in inch inches ft feet foot yd yards mi mile miles mg g kg t lb lbs oz ml l liter "
    "liters litre litres s sec secs second seconds min mins minute minutes h hr hrs hour hours day days "
    "week weeks month months year years $ € £ usd eur gbp dollar dollars euro euros pound pounds cent "
    "cents kmh km/h mph hz khz mhz ghz w kw v kv a j kj cal kcal pa kpa b kb mb gb tb k c f °c °f "
    "degrees degree percent people persons items pieces".split()
)
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/-]*[%$€£]?(?:[A-Za-z°/]{1,4})?$")
_EDGE = re.compile(r"^[^\w$€£%°+-]+|[^\w$€£%°]+$")
LITERAL, NUMBER, UNIT, NAME, EMPTY, FIRST = range(6)  # FIRST: a name that opens a sentence
INSIDE, ANYWHERE, BLIND, EXACT = FORMS = range(4)


class Vocabulary(dict):
    """Word to its row in the property lists; forgotten as a whole when too long."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.clear()
        self.literal: list[int] = []
        self.kind: list[int] = []
        self.unit: list[bool] = []
        self.stops: list[bool] = []
        self.closes: list[bool] = []  # no unit is read after it
        self.value: list[int] = []

    def __missing__(self, word: str) -> int:
        core = _EDGE.sub("", word)
        low = core.lower()
        kind = LITERAL
        if not core:
            kind = EMPTY
        elif _NUMBER.match(core):
            kind = NUMBER
        elif core[0].isupper() and core[1:].islower():
            kind = NAME
        at = self[word] = len(self.kind)
        self.kind.append(kind)
        self.literal.append(xxhash.xxh64_intdigest(low.encode()))
        self.value.append(self.literal[-1])
        self.unit.append(low in UNITS)
        self.stops.append(word[-1] in ".!?:;…\"”»" or not core)
        self.closes.append(self.stops[-1] or word[-1] in ")]")
        return at


_SLOT = {NUMBER: 0x4E554D31, UNIT: 0x554E4954, NAME: 0x4E414D45}


class Templates:
    """Tokens of ``texts`` with their kind and the text each belongs to."""

    def __init__(self, texts: list[str], vocabulary: Vocabulary):
        if len(vocabulary) > CACHE_WORDS:
            vocabulary.reset()
        split = [t.split() for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        at = np.fromiter(
            (i for ws in split for i in map(vocabulary.__getitem__, ws)), np.int64, len(doc)
        )
        kind = np.array(vocabulary.kind, np.int8)[at] if len(at) else np.zeros(0, np.int8)
        stops = np.array(vocabulary.stops, bool)[at] if len(at) else np.zeros(0, bool)
        closes = np.array(vocabulary.closes, bool)[at] if len(at) else np.zeros(0, bool)
        unit = np.array(vocabulary.unit, bool)[at] if len(at) else np.zeros(0, bool)
        literal = np.array(vocabulary.literal, np.uint64)[at] if len(at) else np.zeros(0, np.uint64)
        first = np.ones(len(at), bool)  # of its sentence
        first[1:] = stops[:-1] | (doc[1:] != doc[:-1])
        after = np.zeros(len(at), bool)
        after[1:] = (kind[:-1] == NUMBER) & ~closes[:-1] & (doc[1:] == doc[:-1])
        kind = np.where((kind == NAME) & first, FIRST, kind)
        kind = np.where(after & unit & (kind != NUMBER) & (kind != EMPTY), UNIT, kind)
        full = np.flatnonzero(kind != EMPTY)
        self.doc, self.kind, self.literal = doc[full], kind[full], literal[full]

    def kinds(self, form: int) -> np.ndarray:
        """What each token is in a form: of names, ``FIRST`` ones become words or names."""
        if form == EXACT:
            return np.full(len(self.kind), LITERAL, self.kind.dtype)
        kind = np.where(self.kind == FIRST, NAME if form == ANYWHERE else LITERAL, self.kind)
        return np.where(kind == NAME, LITERAL, kind) if form == BLIND else kind

    def windows(self, n: int, form: int, known: np.ndarray | None):
        """Start, template hash of the windows of ``n`` tokens, those in ``known`` only if given."""
        kind = self.kinds(form)
        token = self.literal.copy()
        for k, mark in _SLOT.items():
            token[kind == k] = mark
        count = max(len(token) - n + 1, 0)
        h = np.full(count, n * len(FORMS) + form, np.uint64)
        for i in range(n):
            h = h * STEP + token[i : i + count]
        before = np.r_[0, np.cumsum(kind == LITERAL)]
        literals = before[n : n + count] - before[:count]
        h = mix(h)
        fit = (literals >= min(MIN_LITERAL, -(-n // 2))) & (self.doc[:count] == self.doc[n - 1 :][:count])
        at = np.flatnonzero(fit)
        if known is not None:
            place = np.minimum(np.searchsorted(known, h[at]), max(len(known) - 1, 0))
            at = at[known[place] == h[at]] if len(known) else at[:0]
        return at, h[at], kind

    def pattern(self, start: int, n: int, kind: np.ndarray) -> str:
        """Which slots of a window are equal: ``0,1,0`` for first and third alike."""
        seen: dict[tuple[int, int], int] = {}
        out = []
        for i in range(start, start + n):
            if kind[i] != LITERAL:
                slot = (int(kind[i]), int(self.literal[i]))
                out.append(str(seen.setdefault(slot, len(seen))))
        return ",".join(out)


HITS = "id {}, h bigint, pattern string, n bigint"


def _scan(df: DataFrame, lengths: list[int], items: bool = False, shared=None) -> DataFrame:
    """``id``, window hash, slot pattern and number of such windows, of ``id, text``.

    Of benchmark items, short ones give their whole and others windows of full length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        index = shared.value if shared is not None else None
        for batch in batches:
            ids, texts = batch["id"].to_pylist(), batch["text"].to_pylist()
            at, size = 0, 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1])
                if size < 2_000_000 and end < len(texts):
                    continue
                t = Templates(texts[at:end], vocabulary)
                found: dict[tuple, int] = {}
                sizes = np.minimum(np.bincount(t.doc, minlength=end - at), WINDOW)
                for n in lengths:
                    for form in FORMS if n >= SHORTEST else (EXACT,):
                        start, h, kind = t.windows(n, form, index)
                        if items:
                            own = sizes[t.doc[start]] == n
                            start, h = start[own], h[own]
                        for s, x in zip(start.tolist(), h.view(np.int64).tolist(), strict=True):
                            key = (ids[at + int(t.doc[s])], x, t.pattern(s, n, kind))
                            found[key] = found.get(key, 0) + 1
                rows = list(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], batch["id"].type), pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.string()), pa.array(list(found.values()), pa.int64()),
                    ],
                    names=["id", "h", "pattern", "n"],
                )
                at, size = end, 0

    return df.mapInArrow(run, HITS.format(df.schema["id"].dataType.simpleString()))


def _lengths(items: DataFrame) -> list[int]:
    """Window lengths in use: ``WINDOW``, and the whole of shorter items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, found = Vocabulary(), set()
        for batch in batches:
            texts = batch["text"].to_pylist()
            sizes = np.bincount(Templates(texts, vocabulary).doc, minlength=len(texts))
            found |= set(np.minimum(sizes, WINDOW).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["n"])

    rows = items.mapInArrow(run, "n int").where("n > 0").distinct().collect()
    return sorted(r["n"] for r in rows)  # thirteen values at most


def _follows(asked: Column, pattern: Column) -> Column:
    """Whether slots that are equal in the item are equal in the document."""
    a, p = F.split(asked, ","), F.split(pattern, ",")
    mapped = F.size(F.array_distinct(F.arrays_zip(a.alias("a"), p.alias("p")))) == F.size(F.array_distinct(a))
    return (asked == pattern) | mapped


def matches(
    docs: DataFrame, benchmark: DataFrame, limit: int = INDEX_LIMIT, by: Column | None = None
) -> DataFrame:
    """``doc_id`` (or the key ``by``), ``item_id`` and ``n`` windows in common with consistent slots."""
    by = F.col("doc_id").cast("bigint") if by is None else by
    spark = docs.sparkSession
    items = packed(benchmark, id=F.col("item_id").cast("bigint"), text=text_of()).select("id", "text")
    texts = packed(docs, id=by, text=text_of()).select("id", "text")
    lengths = _lengths(items)
    index = written(
        _scan(items, lengths, items=True)
        .select("h", F.col("pattern").alias("asked"), F.col("id").alias("item_id")).distinct(),
        "templates",
    )
    size = index.select("h").distinct().count()
    shared = None
    if size <= limit:
        rows = index.select("h").distinct().toPandas()["h"].to_numpy(np.int64)  # at most ``limit`` longs
        shared = spark.sparkContext.broadcast(np.sort(rows.view(np.uint64)))
    hits = _scan(texts, lengths, shared=shared)
    return (
        hits.join(index, "h").where(_follows(F.col("asked"), F.col("pattern")))
        .groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.sum("n").alias("n"))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = INDEX_LIMIT) -> DataFrame:
    """``doc_id``, ``n_windows`` and ``n_items`` of the documents that hold benchmark templates."""
    return matches(docs, benchmark, limit).groupBy("doc_id").agg(
        F.sum("n").alias("n_windows"), F.count("*").alias("n_items"), F.min("item_id").alias("first_item")
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document id with its verdict."""
    found = contaminated(docs, benchmark)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    joined = ids.join(found.withColumnRenamed("doc_id", "hit"), F.col("doc_id").eqNullSafe(F.col("hit")), "left")
    return joined.select(
        "doc_id", F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item",
        F.col("n_items").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark templates, with their columns as they were.

    Rows are known by id and text, so a clean row stays whatever other rows its id has.
    """
    found = written(
        matches(docs, benchmark, by=row_key()).select(F.col("doc_id").alias("key")).distinct(), "contaminated"
    )
    return packed(docs, key=row_key()).join(found, "key", "left_anti").select("row.*")
