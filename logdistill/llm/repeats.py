"""Substring dedup: words inside passages that an earlier document has too.

A window is ``WINDOW`` consecutive words. Its *anchor* is the least hash among
the shorter word groups inside it, so two documents that share a window share
its anchor. The work runs over blocks of documents:

1. Each block asks, per shard of the hash space, which of its anchors another
   document has (a sorted array of short hashes); the answer is one bit each.
2. For windows with such an anchor it asks the same with the full 64-bit hash
   of the window and the smallest document id it has; the bit says whether
   another block has the window in a smaller document.
3. Confirmed passages (runs of windows with an earlier copy) become
   Aho-Corasick automata over word numbers, cut into shards of bounded size.
   All documents of the block stream through them, and an occurrence counts
   where each of its windows has a copy in a smaller document.

A block combines all copies of a window before anything moves, so a passage
that every document has costs one entry per block: no group of rows can grow
hot. Blocks, shards and automata are bounded; no text leaves its block.

Null texts have no words. A null id comes after all others. Rows that repeat an
id never remove words from each other. Windows are told apart by 64-bit hashes;
among n windows a mistaken one is expected n * n / 2**65 times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .common import packed, text_of
from .wordhash import Words, mix

WINDOW, ANCHOR = 13, 6
BLOCK_BYTES = 4_000_000
AUTOMATON_WORDS = 400_000
LAST = np.iinfo(np.int64).max

BLOCK = "block string, ids binary, sizes binary, data binary"
ASK = "shard int, block string, keys binary, ids binary"
ANSWER = "block string, shard int, bits binary"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def blocks(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """Documents in blocks of about ``limit`` bytes, written once, named by their content."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            id_bytes = np.array(ids, np.int64).tobytes()
            data = b" ".join(texts)
            name = hashlib.blake2b(id_bytes + data, digest_size=12).hexdigest()
            sizes = np.array([len(t) for t in texts], np.int64)
            return pa.RecordBatch.from_pydict(
                {
                    "block": [name], "ids": [id_bytes], "sizes": [_pack(sizes)],
                    "data": [zstandard.ZstdCompressor(level=3).compress(data)],
                }
            )

        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = text.encode()
                ids.append(LAST if i is None else i)
                texts.append(raw)
                size += len(raw) + 1
                if size >= limit:
                    yield block()
                    ids, texts, size = [], [], 0
        if ids:
            yield block()

    d = packed(docs, doc_id=F.col("doc_id").cast("bigint"), text=text_of()).select("doc_id", "text")
    # blocks with the same documents and texts are told apart, so that no answer is shared
    named = d.mapInArrow(build, BLOCK).withColumn("block", F.concat("block", F.lit("-"), F.monotonically_increasing_id()))
    return written(named, "blocks")


class Block:
    """The words of one block, its windows and their anchors."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        raw = zstandard.ZstdDecompressor().decompress(data)
        ends = np.cumsum(_unpack(sizes, np.int64) + 1)
        self.words = Words([raw[e - s - 1 : e - 1] for e, s in zip(ends, _unpack(sizes, np.int64), strict=True)])
        doc, n = self.words.doc, WINDOW
        count = max(len(doc) - n + 1, 0)
        self.at = np.flatnonzero(doc[:count] == doc[n - 1 :][:count])  # where a window starts
        self.owner = self.ids[doc[self.at]]
        least = self.words.grams(ANCHOR)
        reach = WINDOW - ANCHOR + 1
        span = 1
        while span < reach:  # least of the groups inside each window
            step = min(span, reach - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        self.anchor = mix(least[self.at])

    def windows(self, some: np.ndarray) -> np.ndarray:
        return self.words.grams(WINDOW)[self.at[some]]


def _least_owner(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the least and greatest owner of each, and each row's key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(fresh)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(fresh) - 1
    if not len(first):
        return keys, owner, owner, back
    low = np.minimum.reduceat(owner[order], first)
    high = np.maximum.reduceat(owner[order], first)
    return ordered[first], low, high, back


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key in order of the keys: equal parts of the hash space."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _parts(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    shard = _shard(keys, shards)
    cuts = np.flatnonzero(np.diff(shard)) + 1
    bounds = [0, *cuts.tolist(), len(keys)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            yield int(shard[a]), slice(a, b)


def _frames(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields)
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _bits(row: dict, keys: np.ndarray, shards: int) -> np.ndarray:
    """The answers of all shards, in the order of the keys asked for."""
    got = {a["shard"]: a["bits"] for a in row["answers"] or ()}
    out = np.zeros(len(keys), bool)
    for shard, part in _parts(keys, shards):
        n = part.stop - part.start
        out[part] = np.unpackbits(np.frombuffer(got[shard], np.uint8), count=n).astype(bool)
    return out


def _short(keys: np.ndarray, shards: int) -> np.ndarray:
    """What tells keys of one shard apart in the first question: 32 bits below the shard's."""
    wide = (keys >> np.uint64(32)) * np.uint64(shards)
    low = (keys & np.uint64(0xFFFFFFFF)) * np.uint64(shards) >> np.uint64(32)
    return ((wide + low) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _answer(pdf: pd.DataFrame, short: bool) -> pd.DataFrame:
    """One shard: bit per asked key, from every block's keys.

    For anchors: another block has it. For windows: another block has it in a
    smaller document.
    """
    kind = np.uint32 if short else np.uint64
    asked = [_unpack(k, kind) for k in pdf["keys"]]
    sizes = [len(k) for k in asked]
    keys = np.concatenate(asked)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    runs = np.diff(np.r_[first, len(keys)])
    bit = np.zeros(len(keys), bool)
    if short:
        bit[order] = np.repeat(runs > 1, runs)
    else:
        owner = np.concatenate([_unpack(i, np.int64) for i in pdf["ids"]])
        low = np.minimum.reduceat(owner[order], first)
        bit[order] = owner[order] > np.repeat(low, runs)
    ends = np.cumsum(sizes)
    return pd.DataFrame(
        {
            "block": pdf["block"],
            "shard": pdf["shard"],
            "bits": [np.packbits(bit[e - s : e]).tobytes() for e, s in zip(ends, sizes, strict=True)],
        }
    )


def _asked(questions: DataFrame, short: bool, name: str) -> DataFrame:
    """Answers per block, one row each."""
    answers = questions.groupBy("shard").applyInPandas(lambda pdf: _answer(pdf, short), ANSWER)
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("answers"))
    return written(by_block, name)  # one bit per distinct key of the block


def _covered(block: Block, doomed: np.ndarray) -> np.ndarray:
    """Words inside occurrences of confirmed passages.

    ``doomed`` marks the windows with a copy in a smaller document. Runs of
    them are the passages; distinct passages go into automata in shards.
    """
    out = np.zeros(len(block.words.hash), bool)
    if not doomed.any():
        return out
    at = block.at[doomed]
    breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(block.words.doc[at]) > 0)) + 1
    starts, ends = at[np.r_[0, breaks]], at[np.r_[breaks - 1, len(at) - 1]] + WINDOW
    _, number = np.unique(block.words.hash, return_inverse=True)
    passages = sorted({number[a:b].tobytes() for a, b in zip(starts, ends, strict=True)})
    bad = np.zeros(len(out) + 1, np.int64)
    flags = np.zeros(len(out), bool)
    flags[at] = True
    bad[1:] = np.cumsum(~flags)  # windows before a place that stay
    edges = np.r_[0, np.flatnonzero(np.diff(block.words.doc)) + 1, len(out)]
    marks = np.zeros(len(out) + 1, np.int64)
    while passages:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        held = 0
        while passages and (held == 0 or held < AUTOMATON_WORDS):
            passage = np.frombuffer(passages.pop(), np.int64).tolist()
            automaton.add_word(tuple(passage), len(passage))
            held += len(passage)
        automaton.make_automaton()
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a < WINDOW:
                continue
            for last, size in automaton.iter(tuple(number[a:b].tolist())):
                start = a + last - size + 1
                if bad[a + last - WINDOW + 2] == bad[start]:
                    marks[start] += 1
                    marks[a + last + 1] -= 1
    out[:] = np.cumsum(marks[:-1]) > 0
    return out


def removed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by spaces)."""
    return _removed(docs, "kept string", lambda kept: kept.decode())


def report(docs: DataFrame) -> DataFrame:
    return _removed(docs, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _removed(docs: DataFrame, column: str, made) -> DataFrame:
    base = blocks(docs)
    # a shard's keys grow with the words per block, not with their number
    shards = max(8, base.count() // 2)

    def anchors(batches):
        for r in _rows(batches):
            b = Block(r["ids"], r["sizes"], r["data"])
            keys, low, high, _ = _least_owner(b.anchor, b.owner)
            yield _frames(
                [(s, r["block"], _pack(_short(keys[p], shards)), b"") for s, p in _parts(keys, shards)], ASK
            )

    def candidates(b: Block, row: dict) -> np.ndarray:
        keys, low, high, back = _least_owner(b.anchor, b.owner)
        seen = _bits({"answers": row["first"]}, keys, shards) | (low < high)
        return np.flatnonzero(seen[back]) if len(keys) else np.zeros(0, np.int64)

    def windows(batches):
        for r in _rows(batches):
            b = Block(r["ids"], r["sizes"], r["data"])
            some = candidates(b, r)
            keys, low, _, _ = _least_owner(b.windows(some), b.owner[some])
            yield _frames(
                [(s, r["block"], _pack(keys[p]), _pack(low[p])) for s, p in _parts(keys, shards)], ASK
            )

    def finish(batches):
        for r in _rows(batches):
            b = Block(r["ids"], r["sizes"], r["data"])
            some = candidates(b, r)
            keys, low, _, back = _least_owner(b.windows(some), b.owner[some])
            elsewhere = _bits({"answers": r["second"]}, keys, shards)
            doomed = np.zeros(len(b.at), bool)
            if len(keys):
                doomed[some] = elsewhere[back] | (low[back] < b.owner[some])
            gone = _covered(b, doomed)
            w = b.words
            edges = np.searchsorted(w.doc, np.arange(len(b.ids) + 1))
            rows = []
            for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                stay = np.flatnonzero(~gone[x:y]) + x
                spans = zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)
                kept = b" ".join([w.buffer[s:e] for s, e in spans])
                doc = None if b.ids[i] == LAST else int(b.ids[i])
                rows.append((doc, int(y - x), int(y - x - len(stay)), made(kept)))
            yield _frames(rows, out)

    out = f"doc_id bigint, n_words bigint, n_removed bigint, {column}"
    first = _asked(base.mapInArrow(anchors, ASK), True, "anchor-bits")
    both = base.join(first.withColumnRenamed("answers", "first"), "block", "left")
    second = _asked(both.mapInArrow(windows, ASK), False, "window-bits")
    both = both.join(second.withColumnRenamed("answers", "second"), "block", "left")
    return both.mapInArrow(finish, out)
