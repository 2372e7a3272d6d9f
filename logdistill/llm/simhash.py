"""SimHash near-dedup by the generalised pigeonhole principle.

Two 64-bit fingerprints within ``RADIUS`` bits of each other agree, in at least
one of m parts of the bits, up to that part's threshold, if the thresholds sum
to RADIUS - m + 1. Bits that go together share a part; a dynamic program over
the parts' histograms gives each part the threshold (or none at all) that makes
the fewest candidates. Every distinct fingerprint probes, per part, the values
within its threshold; fingerprints that meet are compared bit by bit, and a
spanning forest of the links found goes on to connected components.

Equal fingerprints are one node, so copies never meet in pairs. A value with
many fingerprints is cut into chunks that meet two by two; no task holds more
than two chunks, and each group returns fewer links than it has members.

Null texts count as empty and have fingerprint zero, like texts without words.
Rows that repeat an id are members like any other; a null id never is the least
of its group unless all are null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..shared import written
from .common import other_columns, packed, row_key, text_of
from .graph import components

SHINGLE, SEED, RADIUS, PARTS, CHUNK = 3, 42, 3, 4, 4_096
SMALL = 48  # groups up to this size are compared side by side


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 of every shingle, repeats included."""
    ws = text.lower().split()
    if not ws:
        return 0
    if len(ws) < n:
        hashes = [xxh64_intdigest(b" ".join(ws), SEED)]
    else:
        joined = b" ".join(ws)
        sizes = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: len(ws) - n + 1].tolist()
        hashes = [
            xxh64_intdigest(joined[a:b], SEED)
            for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)
        ]
    found = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 65_536):
        bits = np.unpackbits(found[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)[0])


def _printed(texts: DataFrame) -> DataFrame:
    """The other columns of a table with ``text``, and ``fp``, its fingerprint as a signed long."""
    names = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.encode()) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in names], pa.array(prints.view(np.int64))], names=[*names, "fp"]
            )

    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names)
    return texts.mapInArrow(run, f"{schema}, fp bigint")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``."""
    d = packed(docs, doc_id=F.col("doc_id").cast("bigint"), text=text_of())
    return _printed(d.select("doc_id", "text"))


# --- Parts and thresholds ------------------------------------------------------
def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def together(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for every two bits, how many have both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        n = 0
        for batch in batches:
            bits = _bits(batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.r_[total.ravel(), n])], names=["k", "v"]
            )

    rows = nodes.select("fp").mapInArrow(run, "k int, v bigint").groupBy("k").agg(F.sum("v").alias("v"))
    got = {r["k"]: r["v"] for r in rows.collect()}  # 4,097 sums, whatever the input
    return got.get(4096, 0), np.array([got.get(k, 0) for k in range(4096)], float).reshape(64, 64)


def grouped_bits(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Bits in ``parts`` groups of equal size, each grown around correlated bits."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, out = set(range(64)), []
    size = -(-64 // parts)
    while free:
        order = sorted(free)
        group = [max(order, key=lambda b: (tie[b, order].sum(), -b))]
        free -= set(group)
        while free and len(group) < size:
            best = max(sorted(free), key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def part_values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for i, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return out


def ball(width: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` of ``width`` bits."""
    return [
        sum(1 << b for b in some) for r in range(radius + 1) for some in itertools.combinations(range(width), r)
    ]


def candidates(histogram: np.ndarray, width: int, radius: int) -> float:
    """Pairs that meet in a part at this threshold, and the probes it takes."""
    if radius < 0:
        return 0.0
    at = np.arange(len(histogram))
    h = histogram.astype(float)
    masks = ball(width, radius)
    met = sum(float((h * h[at ^ m]).sum()) for m in masks)
    return met / 2 + float(h.sum()) * len(masks)


def thresholds(histograms: list[np.ndarray], widths: list[int], radius: int = RADIUS) -> list[int]:
    """Per part a threshold of -1 (left out) to ``radius``; they sum to radius - parts + 1."""
    goal = radius + 1  # of threshold + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for h, w in zip(histograms, widths, strict=True):
        cost = [candidates(h, w, t) for t in range(-1, radius + 1)]
        fresh: dict[int, tuple[float, list[int]]] = {}
        for spent, (total, chosen) in best.items():
            for t in range(-1, radius + 1):
                s = spent + t + 1
                if s <= goal and (s not in fresh or total + cost[t + 1] < fresh[s][0]):
                    fresh[s] = (total + cost[t + 1], [*chosen, t])
        best = fresh
    return best[goal][1]


# --- Links ---------------------------------------------------------------------
def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fps``: breadth first from each tree's root."""
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            near = np.zeros(len(rest), bool)
            source = np.zeros(len(rest), np.uint64)
            for at in range(0, len(frontier), 256):
                open_ = np.flatnonzero(~near)
                if not len(open_):
                    break
                some = frontier[at : at + 256]
                close = np.bitwise_count(some[:, None] ^ rest[open_][None, :]) <= radius
                hit = close.any(axis=0)
                near[open_[hit]] = True
                source[open_[hit]] = some[close[:, hit].argmax(axis=0)]
            left.append(source[near])
            right.append(rest[near])
            frontier, rest = rest[near], rest[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _small_links(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forests of many small groups at once; rows are sorted by group."""
    pairs_a, pairs_b = [], []
    for step in range(1, SMALL):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        at = np.flatnonzero(same)
        close = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= radius]
        pairs_a.append(close)
        pairs_b.append(close + step)
    a = np.concatenate([np.zeros(0, np.int64), *pairs_a])
    b = np.concatenate([np.zeros(0, np.int64), *pairs_b])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            keep[k] = True
    return fps[a[keep]], fps[b[keep]]


def links(nodes: DataFrame, radius: int = RADIUS, parts: int = PARTS, chunk: int = CHUNK) -> DataFrame:
    """``a``, ``b``: links whose components are those of all links within ``radius``.

    The histograms have at most 2 ** 16 values a part; of wider parts, the first
    16 bits stand for all.
    """
    n, both = together(nodes)
    groups = grouped_bits(n, both, parts)
    widths = [min(len(g), 16) for g in groups]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << w, np.int64) for w in widths]
        for batch in batches:
            fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for p, (g, w) in enumerate(zip(groups, widths, strict=True)):
                counts[p] += np.bincount(part_values(fps, g[:w]), minlength=1 << w)
        for p, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), p, np.int32)), pa.array(at), pa.array(c[at])], names=["part", "value", "n"]
            )

    counted = nodes.select("fp").mapInArrow(values, "part int, value bigint, n bigint")
    pdf = counted.groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()  # at most parts * 2 ** 16 rows
    histograms = []
    for p, w in enumerate(widths):
        h = np.zeros(1 << w, np.int64)
        own = pdf[pdf["part"] == p]
        h[own["value"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
        histograms.append(h)
    chosen = thresholds(histograms, widths, radius)
    masks = [ball(len(g), t) if t >= 0 else [] for g, t in zip(groups, chosen, strict=True)]
    cuts = []  # chunks of each value of a part: members by the histogram, probes from all around
    for h, w, g, t in zip(histograms, widths, groups, chosen, strict=True):
        at = np.arange(1 << w)
        met = sum((h[at ^ m] for m in ball(w, max(t, 0))), np.zeros(1 << w, np.int64))
        cuts.append(np.maximum(1, -(-met // chunk)))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for p, (g, w) in enumerate(zip(groups, widths, strict=True)):
                home = part_values(fps, g)
                for m in masks[p]:
                    key = home ^ m
                    chunks = cuts[p][key & ((1 << w) - 1)]
                    own = ((fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % chunks
                    row = np.repeat(np.arange(len(fps)), chunks)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                    low, high = np.minimum(own[row], other), np.maximum(own[row], other)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(row), p, np.int32)), pa.array(key[row]),
                            pa.array(low << 32 | high), pa.array(fps[row].view(np.int64)),
                        ],
                        names=["part", "key", "chunks", "fp"],
                    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def linked(table: pa.Table) -> pa.RecordBatch:
            columns = [table[c].to_numpy() for c in ("part", "key", "chunks", "fp")]
            fps = columns[3].view(np.uint64)
            fresh = np.zeros(len(fps), bool)
            for c in columns[:3]:
                fresh[1:] |= c[1:] != c[:-1]
            group = np.cumsum(fresh)
            sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
            small = (sizes <= SMALL)[group] if len(group) else np.zeros(0, bool)
            found = [_small_links(group[small], fps[small], radius)]
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(sizes > SMALL):
                found.append(forest(fps[ends[k] - sizes[k] : ends[k]], radius))
            a = np.concatenate([f[0] for f in found]).view(np.int64)
            b = np.concatenate([f[1] for f in found]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            n_rows = table.num_rows
            if not n_rows:
                continue
            last = np.ones(n_rows, bool)
            for c in ("part", "key", "chunks"):
                v = table[c].to_numpy()
                last &= v == v[-1]
            cut = n_rows - int(last.sum())
            if cut:
                yield linked(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield linked(held)

    met = nodes.select("fp").mapInArrow(probes, "part int, key bigint, chunks bigint, fp bigint")
    near = met.repartition("part", "key", "chunks").sortWithinPartitions("part", "key", "chunks")
    return near.mapInArrow(verify, "a bigint, b bigint")


def grouped(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id``: the least id reachable over links."""
    prints = written(fingerprints(docs), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    label = components(links(nodes, radius, parts, chunk), "simhash-components")
    of = nodes.join(label, nodes["fp"] == label["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return grouped(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(
    docs: DataFrame, radius: int = RADIUS, parts: int = PARTS, chunk: int = CHUNK
) -> DataFrame:
    """One row per group with its columns as they were: that with the least id, a null id last.

    Rows are known by all they hold, so null and repeated ids lose nothing but near
    copies; ties in the id go to the least hash of id and text, then to the other
    columns as JSON. An empty table stays empty; extra columns may have any name.
    """
    d = packed(docs, doc_id=F.col("doc_id").cast("bigint"), text=text_of(), key=row_key(), tie=other_columns(docs))
    found = written(_printed(d.select("doc_id", "key", "tie", "text")), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key", "tie")
    nodes = written(found.groupBy("fp").agg(F.min(order).alias("first")), "simhash-row-nodes")
    label = components(links(nodes, radius, parts, chunk), "simhash-row-groups")
    of = nodes.join(label, nodes["fp"] == label["node"], "left")
    first = of.groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min("first").alias("first"))
    stay = written(first.select("first.key", "first.tie"), "simhash-kept")
    kept = d.select("row", "key", "tie").join(stay, ["key", "tie"], "left_semi")
    return kept.dropDuplicates(["key", "tie"]).select("row.*")  # these are equal rows
