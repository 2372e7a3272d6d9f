"""Edit-aware token counts.

A document's text is cut into leaves of about ``LEAF`` characters at places
where every pre-token ends: before a single space between two other characters.
Byte-pair merges never cross a pre-token, so a text has the sum of its leaves'
tokens, and a segment tree over the leaves has those sums. An edit changes the
leaves it touches; they are encoded again together with the boundary context
around them, up to the next cut that the old and the new text share, and only
the sums above them change.

``grown`` builds the trees, ``edited`` applies edits to them. Null texts count
as empty: one empty leaf. Rows that repeat an id are separate documents with the
same edits. Edits are in characters of the text they meet, applied in order;
those that reach beyond its end are cut off there, null replacements are empty.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, text_of

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF = 512
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def encoder(path: str | None = None) -> tiktoken.Encoding:
    """The tokenizer whose ranks lie at ``path``; by default a public one on this machine."""
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODERS[path]


class Tree:
    """Leaves of a text with their token counts, and a Fenwick tree of the sums."""

    def __init__(self, ends: list[int], counts: list[int]):
        self.ends, self.counts = ends, counts
        self.sums = [0, *counts]
        for i in range(1, len(self.sums)):
            parent = i + (i & -i)
            if parent < len(self.sums):
                self.sums[parent] += self.sums[i]

    @property
    def total(self) -> int:
        return self.prefix(len(self.counts))

    def prefix(self, leaves: int) -> int:
        out = 0
        while leaves:
            out += self.sums[leaves]
            leaves -= leaves & -leaves
        return out

    def add(self, leaf: int, change: int) -> int:
        """Adds to a leaf and the sums above it; returns how many sums changed."""
        self.counts[leaf] += change
        at, n = leaf + 1, 0
        while at < len(self.sums):
            self.sums[at] += change
            at += at & -at
            n += 1
        return n


def cuts(text: str, start: int = 0, stop: int | None = None, leaf: int = LEAF) -> list[int]:
    """Ends of the leaves of ``text[start:stop]``; the last is ``stop``."""
    stop = len(text) if stop is None else stop
    out, at = [], start
    while stop - at > leaf:
        found = _CUT.search(text, at + leaf, min(stop + 1, len(text)))
        if found is None or found.start() >= stop:
            break
        at = found.start()
        out.append(at)
    out.append(stop)
    return out


def grow(text: str, enc: tiktoken.Encoding, leaf: int = LEAF) -> Tree:
    ends = cuts(text, leaf=leaf)
    starts = [0, *ends[:-1]]
    return Tree(ends, [len(enc.encode_ordinary(text[a:b])) for a, b in zip(starts, ends, strict=True)])


def apply_edit(
    tree: Tree, text: str, start: int, length: int, put: str, enc: tiktoken.Encoding
) -> tuple[str, Tree, int, int]:
    """The new text and tree, the characters encoded again and the sums updated.

    Leaves whose cuts lie outside the edit and its neighbouring characters keep
    their counts. If their number stays, the tree is updated in place; a changed
    number of leaves renumbers the sums from kept counts, with nothing encoded.
    """
    start = max(0, min(start, len(text)))
    stop = min(len(text), start + max(0, length))
    new = text[:start] + put + text[stop:]
    shift = len(put) - (stop - start)
    ends = tree.ends
    # a cut at c rests on the characters c - 1 to c + 1
    first = int(np.searchsorted(ends, start - 1, side="left"))  # leaves before end before the edit
    last = int(np.searchsorted(ends, stop + 1, side="left"))
    last = min(last, len(ends) - 1)
    a = ends[first - 1] if first else 0
    b = ends[last] + shift
    fresh_ends = cuts(new, a, b)
    fresh = [len(enc.encode_ordinary(new[x:y])) for x, y in zip([a, *fresh_ends[:-1]], fresh_ends, strict=True)]
    moved = [e + shift for e in ends[last + 1 :]]
    if len(fresh) == last + 1 - first:
        changed = sum(tree.add(first + i, c - tree.counts[first + i]) for i, c in enumerate(fresh))
        tree.ends = ends[:first] + fresh_ends + moved
        return new, tree, b - a, changed
    made = Tree(ends[:first] + fresh_ends + moved, tree.counts[:first] + fresh + tree.counts[last + 1 :])
    return new, made, b - a, len(made.counts) - first


TREE = "ends array<int>, counts array<int>, n_tokens bigint"


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch["text"].to_pylist()


def grown(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``text``, and its tree: leaf ``ends``, leaf ``counts``, ``n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            trees = [grow(t, enc) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["text"],
                    pa.array([t.ends for t in trees], pa.list_(pa.int32())),
                    pa.array([t.counts for t in trees], pa.list_(pa.int32())),
                    pa.array([t.total for t in trees], pa.int64()),
                ],
                names=["doc_id", "text", "ends", "counts", "n_tokens"],
            )

    d = packed(docs, doc_id=F.col("doc_id").cast("bigint"), text=text_of()).select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id bigint, text string, {TREE}")


EDITED = (
    f"doc_id bigint, text string, {TREE}, n_before bigint, n_leaves bigint, n_chars bigint, "
    "n_encoded bigint, n_sums bigint"
)


def edited(trees: DataFrame, edits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Trees after the ``edits`` array<struct<start, length, put>> of each document.

    ``edits`` has one row per ``doc_id``; documents without one stay as they are.
    ``n_encoded`` counts the characters encoded again, ``n_sums`` the sums updated.
    """
    wanted = edits.select(F.col("doc_id").cast("bigint").alias("id"), "edits")
    both = trees.join(wanted, trees["doc_id"].eqNullSafe(wanted["id"]), "left").drop("id")
    return edited_rows(both, vocabulary)


def edited_rows(trees: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """As ``edited``, with the edits in a column of the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, tree = r["text"], Tree(r["ends"], r["counts"])
                encoded = sums = 0
                for e in r["edits"] or ():
                    text, tree, chars, changed = apply_edit(
                        tree, text, e["start"] or 0, e["length"] or 0, e["put"] or "", enc
                    )
                    encoded, sums = encoded + chars, sums + changed
                rows.append(
                    (r["doc_id"], text, tree.ends, tree.counts, tree.total, r["n_tokens"], len(tree.ends), len(text), encoded, sums)
                )
            names = [f.split()[0] for f in EDITED.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.int64()] * 6
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

    return trees.select("doc_id", "text", "ends", "counts", "n_tokens", "edits").mapInArrow(run, EDITED)


def report(docs: DataFrame) -> DataFrame:
    """Token counts of all texts before and after three edits each.

    The edits come from the rows: the id is written into the middle, fifty
    characters go at a tenth, and the source is put in front.
    """
    n = F.length("text")

    def edit(start, length, put):
        return F.struct(
            start.cast("int").alias("start"), length.cast("int").alias("length"), put.alias("put")
        )

    # the trees need the text alone; edits are derived from them, row by row
    source = docs.select("doc_id", "text")
    edits = F.array(
        edit(F.floor(n / 2), F.lit(7), F.concat(F.lit(" number "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(". "))),
        edit(F.floor(n / 10), F.lit(50), F.lit("")),
        edit(F.lit(0), F.lit(0), F.lit("Revised: ")),
    )
    out = edited_rows(grown(source).withColumn("edits", edits))
    return out.select(
        "doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"),
        "n_leaves", "n_chars", "n_encoded", "n_sums",
    )
