"""Near copies by MinHash: banded minima, verified signatures, stars.

A text's set holds its distinct shingles of ``SHINGLE`` words (A-Z in lower case);
a shorter text is one shingle, a text without words or a null has none and is
linked with nothing. Texts are linked if 100 * common >= ``PERCENT`` * union.

Equal sets are one node. A node's signature are the minima of ``BANDS`` * ``ROWS``
universal hash functions; nodes that agree in all rows of a band share a bucket,
which a linked pair does with probability 1 - (1 - 0.85 ** 6) ** 32, all but 3 in
10 million. Buckets with the same members are one. No pairs are listed:

1. Each bucket has three leaders, of three orders of its nodes. A node is compared
   with the leader it shares most buckets with, once for each order: signature
   first, then whole sets. Alternating stars join what is linked.
2. Buckets whose members are still in several groups compare members of different
   groups, in chunks that meet two by two: signatures tell which nodes have a
   partner at all, and only their whole sets meet, for a spanning forest.

So each pair in a bucket is either in one group or compared. A signature passes
from ``AGREE`` equal minima, 4.7 standard deviations below what 0.85 gives.

Rows with null or repeated ids are members like any other; a null id is never the
least of its group unless all are null. Texts are read whole. An empty table stays
empty, and extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .common import other_columns, packed, row_key, text_of
from .graph import components
from .wordhash import STEP, Words, mix

SHINGLE, PERCENT, ROWS, BANDS, AGREE = 3, 85, 6, 32, 140
SIGNATURES, SETS, SET_SHINGLES = 4_096, 512, 1_000_000  # members of a chunk, and what their sets hold
BATCH = 1_000_000  # letters

_random = np.random.default_rng(20250612)
_TIMES = _random.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)


# --- sets and signatures ---------------------------------------------------------
def shingles(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ordered by text, and how many each text has."""
    w = Words(texts, lower=True)
    grams, count = w.grams(n), max(len(w.hash) - n + 1, 0)
    inside = w.doc[:count] == w.doc[n - 1 :][:count]
    found, of = [grams[inside]], [w.doc[:count][inside]]
    sizes = np.bincount(w.doc, minlength=len(texts))
    ends = np.cumsum(sizes)
    for k in np.flatnonzero((sizes > 0) & (sizes < n)).tolist():
        whole = np.full(1, int(sizes[k]), np.uint64)
        for x in w.hash[ends[k] - sizes[k] : ends[k]]:
            whole = whole * STEP + x
        found.append(mix(whole))
        of.append(np.full(1, k))
    all_, owner = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((all_, owner))
    all_, owner = all_[order], owner[order]
    fresh = np.ones(len(all_), bool)
    fresh[1:] = (all_[1:] != all_[:-1]) | (owner[1:] != owner[:-1])
    return all_[fresh], np.bincount(owner[fresh], minlength=len(texts))


def signatures(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16 bits of each minimum of the sets that begin at ``starts``."""
    out = np.zeros((len(starts), ROWS * BANDS), np.uint16)
    if len(starts):
        for r in range(ROWS * BANDS):
            out[:, r] = mix(np.minimum.reduceat(found * _TIMES[r] + _PLUS[r], starts)).astype(np.uint16)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One key per row and band."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = key * STEP + rows[:, :, r] + np.uint64(1)
    return mix(key)


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for end, text in enumerate(texts):
        if size and size + len(text) > BATCH:
            yield at, end
            at, size = end, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def _prints(texts: DataFrame, n: int) -> DataFrame:
    """The columns of a table with ``text``, but for the text: ``node`` (a hash of the set),
    ``size`` and ``signature`` are new."""
    names = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch["text"].to_pylist()
            for a, b in _batches(held):
                found, sizes = shingles([t.encode() for t in held[a:b]], n)
                some = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[some]
                node = np.zeros(b - a, np.uint64)
                sign = np.zeros((b - a, ROWS * BANDS), np.uint16)
                if len(some):
                    node[some] = mix(np.add.reduceat(mix(found ^ STEP), starts) + sizes[some].astype(np.uint64))
                    sign[some] = signatures(found, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch[c].slice(a, b - a) for c in names], pa.array(node.view(np.int64)),
                        pa.array(sizes.astype(np.int64)), pa.array([s.tobytes() for s in sign], pa.binary()),
                    ],
                    names=[*names, "node", "size", "signature"],
                )

    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names)
    return texts.mapInArrow(run, f"{schema}, node bigint, size bigint, signature binary")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """``node``, ``size``, ``signature`` and ``held``, the set's hashes in order, of the given texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = batch["text"].to_pylist()
            for a, b in _batches(texts_):
                found, sizes = shingles([t.encode() for t in texts_[a:b]], n)
                ends = np.cumsum(sizes)
                held = [found[e - s : e].tobytes() for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part["node"], part["size"], part["signature"], pa.array(held, pa.binary())],
                    names=["node", "size", "signature", "held"],
                )

    return texts.select("node", "size", "signature", "text").mapInArrow(
        run, "node bigint, size bigint, signature binary, held binary"
    )


# --- buckets ---------------------------------------------------------------------
def _rows(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sign = np.array([np.frombuffer(s, np.uint16) for s in batch["signature"].to_pylist()])
            if len(sign):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch["node"].to_numpy(), BANDS)), pa.array(bands(sign).ravel().view(np.int64))],
                    names=["node", "bucket"],
                )

    return nodes.select("node", "signature").mapInArrow(run, "node bigint, bucket bigint")


def members(nodes: DataFrame) -> DataFrame:
    """``bucket``, ``node``, the bucket's leaders, its number of nodes ``n`` and of bands ``w``."""
    rows = _rows(nodes)
    other = F.struct(F.xxhash64("node").alias("h"), "node")
    found = rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("node").alias("one"), F.max("node").alias("two"),
        F.min(other)["node"].alias("three"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("same"),
    )
    buckets = (
        found.where("n > 1").groupBy("one", "two", "three", "n", "same")
        .agg(F.min("bucket").alias("bucket"), F.count("*").alias("w")).drop("same")
    )
    return rows.join(buckets, "bucket")


def _led(member: DataFrame) -> DataFrame:
    """``node`` and ``lead``: for each order of leaders the one that shares most bands with the node."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("lead")) for k, c in enumerate(_LEADS)]))
    shared = member.select("node", "w", each.alias("l")).select("node", "l.k", "l.lead", "w").where("lead <> node")
    weight = shared.groupBy("node", "k", "lead").agg(F.sum("w").alias("w"))
    best = weight.groupBy("node", "k").agg(F.max(F.struct("w", "lead"))["lead"].alias("lead"))
    return best.select("node", "lead").distinct()


_LEADS = ("one", "two", "three")


# --- verification ----------------------------------------------------------------
def linked(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * common >= percent * (a + b - common)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, agree: int) -> DataFrame:
    """The pairs (``node``, ``lead``) that are linked, as ``a`` and ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            columns = [batch[c].to_pylist() for c in ("signature", "held", "lead_signature", "lead_held")]
            for i, (s, x, t, y) in enumerate(zip(*columns, strict=True)):
                if np.count_nonzero(np.frombuffer(s, np.uint16) == np.frombuffer(t, np.uint16)) >= agree:
                    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    keep[i] = linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent)
            part = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part["node"], part["lead"]], names=["a", "b"])

    own = sets.select("node", "signature", "held")
    lead = sets.select(
        F.col("node").alias("lead"), F.col("signature").alias("lead_signature"), F.col("held").alias("lead_held")
    )
    return pairs.join(own, "node").join(lead, "lead").mapInArrow(run, "a bigint, b bigint")


def meetings(rows: DataFrame, chunks: Column, key: str = "bucket") -> DataFrame:
    """Each row once for every meeting ``low``, ``high`` of its chunk with the chunks of its ``key``."""
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = rows.withColumn("chunks", chunks.cast("int")).withColumn("own", own).withColumn("other", other)
    met = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    return met.drop("own", "other", "chunks").repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")


def _by_meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one meeting at a time."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("bucket", "low", "high")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            key = tuple(keys[a].tolist())
            if held and key != now:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def partnered(sign: np.ndarray, label: np.ndarray, agree: int) -> np.ndarray:
    """Which signatures agree with one of another group; the largest group waits for the others."""
    out = np.zeros(len(sign), bool)
    names, kind = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return out
    hot = np.bincount(kind).argmax()
    for i in np.flatnonzero(kind != hot).tolist():
        ahead = np.flatnonzero(((kind == hot) | (np.arange(len(sign)) > i)) & (kind != kind[i]))
        near = ahead[np.count_nonzero(sign[ahead] == sign[i], axis=1) >= agree]
        out[near] = True
        out[i] |= len(near) > 0
    return out


def forest(sets: list[np.ndarray], label: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that join all groups of ``label`` that links between the sets join."""
    sizes = np.array([len(s) for s in sets], np.int64)
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(at, kind="stable")]
    share = np.bincount(at, minlength=len(names))
    first = np.cumsum(share) - share
    ends = np.cumsum(sizes)
    group = np.unique(label, return_inverse=True)[1]
    open_ = np.ones(len(sets), bool)
    out = []
    for root in range(len(sets)):
        if not open_[root]:
            continue
        queue = np.flatnonzero(group == group[root]).tolist()
        open_[queue] = False
        while queue and open_.any():
            k = queue.pop()
            own = at[ends[k] - sizes[k] : ends[k]]
            own = own[share[own] > 1]
            many = share[own]
            place = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            common = np.bincount(owner[place], minlength=len(sets))
            near = np.flatnonzero(open_ & (common > 0) & linked(common, sizes, sizes[k], percent))
            for j in near.tolist():
                if open_[j]:
                    out.append((k, j))
                    more = np.flatnonzero(group == group[j])
                    open_[more] = False
                    queue += more.tolist()
    return out


def _rest(member: DataFrame, sets: DataFrame, label: DataFrame, percent: int, agree: int, chunk: int) -> DataFrame:
    """Links between groups of one bucket, enough to join all that are linked."""
    own = member.select("bucket", "node", "n").join(label, "node", "left").withColumn(
        "label", F.coalesce("component", "node")
    )
    mixed = own.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    open_ = own.join(mixed, "bucket", "left_semi").select("bucket", "node", "n", "label")
    signed = open_.join(sets.select("node", "signature"), "node")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _by_meeting(batches):
            sign = np.array([np.frombuffer(s, np.uint16) for s in met["signature"].to_pylist()])
            part = met.filter(pa.array(partnered(sign, met["label"].to_numpy(), agree)))
            yield pa.RecordBatch.from_arrays([part[c] for c in ("bucket", "node", "label")], names=["bucket", "node", "label"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _by_meeting(batches):
            names = met["node"].to_pylist()
            held = [np.frombuffer(h, np.uint64) for h in met["held"].to_pylist()]
            pairs = forest(held, met["label"].to_pylist(), percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[p[i]] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

    met = meetings(signed, F.ceil(F.col("n") / chunk))
    near = written(
        met.mapInArrow(look, "bucket bigint, node bigint, label bigint").distinct(), "minhash-open"
    )
    sized = near.join(sets.select("node", "size"), "node").groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("size").alias("total")
    )
    wide = F.ceil(F.greatest(F.col("n") / min(chunk, SETS), F.col("total") / SET_SHINGLES))
    whole = near.join(sized, "bucket").join(sets.select("node", "held"), "node")
    return meetings(whole, wide).mapInArrow(join, "a bigint, b bigint")


def links(
    nodes: DataFrame, texts: DataFrame, n: int = SHINGLE, percent: int = PERCENT, agree: int = AGREE,
    chunk: int = SIGNATURES,
) -> DataFrame:
    """``a``, ``b``: links of nodes whose components are those of all links in common buckets.

    ``nodes`` has node, key, size and signature; ``texts`` key and text.
    """
    member = written(members(nodes), "minhash-members")
    wanted = nodes.join(member.select("node").distinct(), "node", "left_semi")
    text = texts.join(wanted, "key").dropDuplicates(["node"])
    sets = written(_sets(text, n), "minhash-sets")
    first = written(_compared(_led(member), sets, percent, agree), "minhash-led")
    label = written(components(first, "minhash-groups"), "minhash-labels")
    return first.unionByName(_rest(member, sets, label, percent, agree, chunk))


def _found(docs: DataFrame, n: int, percent: int, agree: int, chunk: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """The prints of all rows with the columns ``more``, and ``node``, ``component`` of nodes with links."""
    d = packed(
        docs, doc_id=F.col("doc_id").cast("bigint"), text=text_of(), key=row_key(), tie=other_columns(docs)
    )
    found = written(_prints(d.select("doc_id", "key", *more, "text"), n), "minhash-prints")
    of = F.min(F.struct("key", "size", "signature")).alias("of")
    nodes = written(found.where("size > 0").groupBy("node").agg(of).select("node", "of.*"), "minhash-nodes")
    label = components(links(nodes, d.select("key", "text"), n, percent, agree, chunk), "minhash-components")
    return found, written(label, "minhash-component-labels")


def grouped(
    docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, agree: int = AGREE, chunk: int = SIGNATURES
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the least id reachable over links."""
    found, label = _found(docs, n, percent, agree, chunk)
    some = found.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    of = some.join(label, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(least, "component").select("node", "component_id")
    full = found.where("size > 0").select("doc_id", "node", "size").join(named, "node")
    none = found.where("size = 0").select("doc_id", "node", "size", F.col("doc_id").alias("component_id"))
    return full.unionByName(none).select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def report(docs: DataFrame) -> DataFrame:
    return grouped(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per group with its columns as they were: that with the least id, a null id last.

    Ties go to the least hash of id and text, then to the other columns as JSON.
    Texts without words all stay, but for rows equal in every column.
    """
    found, label = _found(docs, n, percent, AGREE, SIGNATURES, "tie")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key", "tie")
    of = found.where("size > 0").groupBy("node").agg(F.min(order).alias("first")).join(label, "node", "left")
    first = of.groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("first").alias("first"))
    stay = first.select("first.key", "first.tie").unionByName(found.where("size = 0").select("key", "tie"))
    d = packed(docs, key=row_key(), tie=other_columns(docs))
    kept = d.join(written(stay.distinct(), "minhash-kept"), ["key", "tie"], "left_semi")
    return kept.dropDuplicates(["key", "tie"]).select("row.*")  # these are equal rows
