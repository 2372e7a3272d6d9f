"""Runs of words that repeat with a period.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal), at least max(``LEAST``, ``TIMES`` * q) long, that no neighbouring word
extends. So each of its words comes ``TIMES`` times or more in it. Texts are split
at words that come too rarely within the current segment; stretches under
``LEAST`` words go, and what changed is looked at again until nothing does. Runs
never lie across such a split.

Surviving segments are scanned at lags. In a run of period q, s <= q < 2s, the
words that equal those q later are a stretch of 2s or more, which holds a block of
s words that begins at a multiple of s. So for each power s only the lags below 2s
at which such a block comes again are scanned, to both ends of the stretch. Blocks
are compared by exact ranks of their words, doubled from length to length, and the
same ranks make the scans jump. That costs n log n rows in a segment of n words,
also in one with a period of one word.

Each text is judged alone, in one narrow step; a batch of texts is ranked at once.
Null texts have no words. Rows with null or repeated ids are rows like any other,
and extra columns are carried along whatever their names; an empty table stays
empty. Of runs with equal exponents the first, then the shorter period, is best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import bind
from .common import packed, text_of, words

LEAST, TIMES = 24, 3
BATCH = 1_000_000  # letters ranked at a time, or one text
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def stretches(keep: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of ``keep`` that lie in one segment."""
    edge = np.ones(len(keep) + 1, bool)
    edge[1:-1] = (keep[1:] != keep[:-1]) | (segment[1:] != segment[:-1])
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    return starts[keep[starts]], ends[keep[starts]]


def split(code: np.ndarray, segment: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments (starts, ends) all of whose words come ``times`` times or more in them."""
    starts, ends = stretches(np.ones(len(code), bool), segment)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        sizes = ends - starts
        owner = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        _, kind, count = np.unique(owner * (int(code.max()) + 1) + code[place], return_inverse=True, return_counts=True)
        often = count[kind] >= times
        stable = np.bincount(owner, weights=~often, minlength=len(starts)) == 0
        done.append((starts[stable], ends[stable]))
        rest = ~stable[owner]
        a, b = stretches(often[rest], owner[rest])
        place = place[rest]
        starts, ends = place[a], place[b - 1] + 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(d[0] for d in done)]), np.concatenate([none, *(d[1] for d in done)])


def _alike(rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the blocks at ``i`` and ``j`` are equal; those that would leave a segment never are."""
    inside = (i >= 0) & (j >= 0) & (i < len(rank)) & (j < len(rank))
    out = np.zeros(len(i), bool)
    left = rank[i[inside]]
    out[inside] = (left >= 0) & (left == rank[j[inside]])
    return out


def scan(code: np.ndarray, left: np.ndarray, right: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of the runs inside the segments ``left`` to ``right``, by start."""
    sizes = right - left
    gap = np.cumsum(sizes + 1) - (sizes + 1)  # one free place behind each segment
    n = int((sizes + 1).sum())
    rank = np.full(n, -1, np.int64)
    end = np.repeat(gap + sizes, sizes + 1)  # of each place's segment
    origin = np.repeat(left - gap, sizes + 1)
    within = np.arange(n) - np.repeat(gap, sizes + 1)
    body = np.arange(n) < end
    rank[body] = code[(np.arange(n) + origin)[body]]
    longest = int(sizes.max(initial=0))
    ranks, at, lag = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    s = 1
    while times * s <= longest:
        ranks.append(rank)
        whole = np.flatnonzero(rank >= 0)
        order = whole[np.argsort(rank[whole], kind="stable")]
        keys = rank[order] * n + order
        first = whole[within[whole] % s == 0]
        low = np.searchsorted(keys, rank[first] * n + first + s)
        high = np.searchsorted(keys, rank[first] * n + np.minimum(first + 2 * s, end[first]))
        many = np.maximum(high - low, 0)
        row = np.repeat(np.arange(len(first)), many)
        met = order[np.repeat(low, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
        at.append(first[row])
        lag.append(met - first[row])
        longer = np.full(n, -1, np.int64)
        two = np.flatnonzero((rank >= 0) & (np.arange(n) + 2 * s <= end))
        if len(two):
            longer[two] = np.unique(rank[two] * (int(rank.max()) + 1) + rank[two + s], return_inverse=True)[1]
        rank, s = longer, 2 * s
    while (rank >= 0).any():  # scans of long runs jump further than lags reach
        ranks.append(rank)
        longer = np.full(n, -1, np.int64)
        two = np.flatnonzero((rank >= 0) & (np.arange(n) + 2 * s <= end))
        if len(two):
            longer[two] = np.unique(rank[two] * (int(rank.max()) + 1) + rank[two + s], return_inverse=True)[1]
        rank, s = longer, 2 * s
    c, q = np.concatenate(at), np.concatenate(lag)
    start, stop = c.copy(), c + q  # words start..stop - q equal those q later
    for k in range(len(ranks) - 1, -1, -1):
        step = _alike(ranks[k], stop - q, stop)
        stop += step.astype(np.int64) << k
    for k in range(len(ranks) - 1, -1, -1):
        step = _alike(ranks[k], start - (1 << k), start - (1 << k) + q)
        start -= step.astype(np.int64) << k
    fits = stop - start >= np.maximum(least, times * q)
    start, stop, q = start[fits], stop[fits], q[fits]
    order = np.lexsort((q, stop, start))
    start, stop, q = start[order], stop[order], q[order]
    smallest = np.ones(len(q), bool)  # of the periods of one stretch
    smallest[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, q = start[smallest], stop[smallest], q[smallest]
    out = np.stack([start + origin[start], stop - start, q], axis=1)
    return out[np.lexsort((q, start))]


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """The runs of each text, given as its words; ``times`` is 3 at least."""
    if times < 3:
        raise ValueError("two periods need not hold a whole block of either")
    sizes = np.array([len(t) for t in texts], np.int64)
    every = [w for t in texts for w in t]
    none = np.zeros((0, 3), np.int64)
    if not every:
        return [none] * len(texts)
    code = pd.factorize(np.array(every, object))[0]
    starts, ends = split(code, np.repeat(np.arange(len(texts)), sizes), least, times)
    order = np.argsort(starts)
    found = scan(code, starts[order], ends[order], least, times) if len(starts) else none
    first = np.cumsum(sizes) - sizes
    cut = np.searchsorted(found[:, 0], first)
    out = np.split(found, cut[1:])
    for f, a in zip(out, first.tolist(), strict=True):
        f[:, 0] -= a
    return out


def _batches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for end, more in enumerate(sizes):
        if size and size + more > BATCH:
            yield at, end
            at, size = end, 0
        size += more
    if at < len(sizes):
        yield at, len(sizes)


def runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The rows as ``row``, their ``runs`` by start, then period, and the text ``collapsed``:
    without the words that a run holds after its first period, joined by one space."""
    d = packed(docs, text=text_of(f"`{text}`"))
    kind = T.StructType().add(d.schema["row"]).add("runs", T.ArrayType(RUN)).add("collapsed", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in _batches([len(t) for t in texts]):
                held = [t.encode().split() for t in texts[a:b]]
                found = runs_of(held, least, times)
                kept = []
                for ws, f in zip(held, found, strict=True):
                    mark = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(mark, f[:, 0] + f[:, 2], 1)
                    np.add.at(mark, f[:, 0] + f[:, 1], -1)
                    keep = np.cumsum(mark[:-1]) == 0
                    kept.append(b" ".join(w for w, k in zip(ws, keep.tolist(), strict=True) if k).decode())
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                all_ = np.concatenate(found)
                fields = [pa.array(all_[:, i]) for i in range(3)]
                list_ = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"])
                )
                yield pa.RecordBatch.from_arrays(
                    [batch["row"].slice(a, b - a), list_, pa.array(kept, pa.string())],
                    names=["row", "runs", "collapsed"],
                )

    return d.mapInArrow(run, kind)


def collapsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows as they were, but for the text, whose runs are cut to their first period.

    Texts without a run stay as they are, white space too.
    """
    found = runs(docs, text)
    short = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(f"row.`{text}`"))
    return found.select(
        *[(short if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )


def best(runs_: Column) -> Column:
    """The run of greatest length / period, exactly; ties: smallest start, then period."""

    def better(a: Column, b: Column) -> Column:
        left, right = b["length"] * a["period"], a["length"] * b["period"]
        earlier = (b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))
        return (left > right) | ((left == right) & earlier)

    start = F.get(runs_, F.lit(0))
    return F.aggregate(runs_, start, lambda a, b: F.when(better(a, b), b).otherwise(a))


def looped(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Every tenth document by the CRC-32 of its id ends in a loop over some of its own words.

    With h the checksum, g = h // 10 and n words, the words from a = g % n on are
    those from a to a + p over and over, p = 1 + (n - a) // (3 + g % 8). Texts with
    a null id stay as they are.
    """

    def loop(w: Column) -> Column:
        n = F.size(w)
        h = F.crc32(F.col(f"`{id_}`").cast("bigint").cast("string"))
        g = F.floor(h / 10).cast("bigint")
        a = F.pmod(g, n.cast("bigint")).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        made = F.concat(F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), n - a))
        chosen = (F.pmod(h, F.lit(10)) == 0) & (n > 0)
        return F.when(chosen, F.array_join(made, " ")).otherwise(F.col(f"`{text}`"))

    return docs.withColumn(text, bind(words(text_of(f"`{text}`")), loop))


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of its runs, the best run and digests of all runs and of what stays."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = runs(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").cast("bigint").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        best(F.col("runs")).alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return found.select(
        "doc_id", "n_runs",
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )
