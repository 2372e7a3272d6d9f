"""Words of texts by Arrow batch: cut, stemmed and grouped with numpy inside a task.

The same words and stems as ``search.tokens`` and ``stem.porter`` give; an array
expression pays for every word, these helpers for every different one of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .stem import (
    HAS_VOWEL, MAX_BYTES, MEASURE_1_UP, MEASURE_2_UP, MIN_BYTES, STEP_2, STEP_3, STEP_4, _C,
)

#: Bytes of text that are cut at a time; a longer text is cut alone.
SLICE_BYTES = 4 << 20
#: Words whose stems a task keeps.
KEPT_STEMS = 200_000

# Java's $ also stands before a line separator that ends the word.
_END = "(?=[\x85\u2028\u2029]?\\Z)"
_has_vowel, _one_up, _two_up = (re.compile(p) for p in (HAS_VOWEL, MEASURE_1_UP, MEASURE_2_UP))
_short = re.compile(rf"^{_C}[aeiouy](?![aeiouwxy])[\x00-\x7f]{_END}")
_doubled = re.compile(rf"(?![aeioulsz])([\x00-\x7f])\1{_END}")
_wants_e = re.compile(rf"(?:at|bl|iz){_END}")


def _tidy(w: str) -> str:
    if _wants_e.search(w):
        return w + "e"
    if _doubled.search(w):
        return w[:-1]
    return w + "e" if _short.search(w) else w


def _by_ends(table: dict[str, str]) -> dict[str, list[str]]:
    """Suffixes by their last letter, the longest first."""
    ends: dict[str, list[str]] = {}
    for s in sorted(table, key=len, reverse=True):
        ends.setdefault(s[-1], []).append(s)
    return ends


_ENDS_2, _ENDS_3, _ENDS_4 = _by_ends(STEP_2), _by_ends(STEP_3), _by_ends(dict.fromkeys(STEP_4, ""))


def _suffix(w: str, ends: dict[str, list[str]]) -> str | None:
    for s in ends.get(w[-1:], ()):
        if w.endswith(s):
            return s
    return None


def porter_word(w: str) -> str:
    """``stem.porter`` of one lower-case word, step by step."""
    if not MIN_BYTES <= len(w.encode("utf-8", "surrogateescape")) <= MAX_BYTES:
        return w
    if w.endswith("s"):
        if w.endswith("sses") and len(w) > 4 or w.endswith("ies") and len(w) > 3:
            w = w[:-2]
        elif not w.endswith("ss"):
            w = w[:-1]
    if w.endswith("eed") and len(w) > 3:
        w = w[:-1] if _one_up.search(w[:-3]) else w
    elif w.endswith("ed") and _has_vowel.search(w[:-2]):
        w = _tidy(w[:-2])
    elif w.endswith("ing") and len(w) > 3 and _has_vowel.search(w[:-3]):
        w = _tidy(w[:-3])
    if w.endswith("y") and _has_vowel.search(w[:-1]):
        w = w[:-1] + "i"
    for table, ends in ((STEP_2, _ENDS_2), (STEP_3, _ENDS_3)):
        s = _suffix(w, ends)
        if s is not None and _one_up.search(w[: len(w) - len(s)]):
            w = w[: len(w) - len(s)] + table[s]
    s = _suffix(w, _ENDS_4)
    if s is not None:
        stem = w[: len(w) - len(s)]
        if (s != "ion" or stem.endswith(("s", "t"))) and _two_up.search(stem):
            w = stem
    if w.endswith("e"):
        stem = w[:-1]
        if _two_up.search(stem) or _one_up.search(stem) and not _short.search(stem):
            w = stem
    if w.endswith("ll") and _two_up.search(w[:-1]):
        w = w[:-1]
    return w


# Lower-case form of every byte of a word, 0 for a separator.
_FOLDED = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _FOLDED[_b] = _b
_FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)


def _spread_out(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts and where each begins; a null is empty."""
    texts = values.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _cut(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts, and the row that each is of."""
    raw, at = _spread_out(values)
    folded = _FOLDED[raw]
    inside = folded != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < len(raw)]
    first[begins] |= inside[begins]
    where = np.flatnonzero(first)
    ends = np.append(np.cumsum(inside)[where] - 1, np.count_nonzero(inside)).astype(np.int32)
    words = pa.Array.from_buffers(
        pa.binary(), len(where), [None, pa.py_buffer(ends), pa.py_buffer(folded[inside])]
    )
    return words, np.searchsorted(at, where, side="right") - 1


def _stems(words: pa.Array, known: dict[bytes, bytes]) -> pa.Array:
    if len(known) > KEPT_STEMS:
        known.clear()
    out = []
    for w in words.to_pylist():
        s = known.get(w)
        if s is None:
            s = known[w] = porter_word(w.decode("utf-8", "surrogateescape")).encode(
                "utf-8", "surrogateescape"
            )
        out.append(s)
    return pa.array(out, pa.binary())


def _grouped(
    batch: pa.RecordBatch, known: dict[bytes, bytes], schema: pa.Schema, lengths: bool
) -> Iterator[pa.RecordBatch]:
    """Postings of the rows of ``batch``: ids first, then the text columns."""
    ids, *columns = batch.columns
    base = np.zeros(len(ids), np.int64)
    words, rows, places = [], [], []
    n_words = np.zeros(len(ids), np.int64)
    for c in columns:
        w, row = _cut(c)
        counts = np.bincount(row, minlength=len(ids))
        before = np.cumsum(counts) - counts
        places.append(np.arange(len(row)) - before[row] + base[row])
        base += counts + 1  # a gap: no phrase spans two columns
        n_words += counts
        words.append(w)
        rows.append(row)
    row, place = np.concatenate(rows), np.concatenate(places)
    coded = pa.concat_arrays(words).dictionary_encode()
    stems = _stems(coded.dictionary, known).dictionary_encode()
    stem = stems.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    key = row * max(len(stems.dictionary), 1) + stem
    order = np.argsort(key, kind="stable")  # positions of a key stay in order
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    cuts = np.append(first, len(key)).astype(np.int32)
    mine = row[order][first]
    terms = stems.dictionary.take(pa.array(stem[order][first]))
    arrays = [
        terms.view(pa.string()),
        ids.take(pa.array(mine)),
        pa.array(n_words[mine]),
        pa.array(np.diff(cuts).astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(cuts), pa.array(place[order].astype(np.int32))),
    ]
    yield _as_batch(arrays, schema)
    if lengths:
        none = pa.nulls(len(ids), pa.string())
        no_places = pa.ListArray.from_arrays(pa.array(np.zeros(len(ids) + 1, np.int32)), pa.array([], pa.int32()))
        yield _as_batch([none, ids, pa.array(n_words), pa.array(np.zeros(len(ids), np.int32)), no_places], schema)


def _as_batch(arrays: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    cast = [a.cast(f.type) for a, f in zip(arrays, schema, strict=True)]
    return pa.RecordBatch.from_arrays(cast, schema=schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``SLICE_BYTES`` of text, so that no array depends on the batch's size."""
    size = np.cumsum(sum(np.diff(_spread_out(c)[1]) for c in batch.columns[1:]))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        upto = max(int(np.searchsorted(size, done + SLICE_BYTES, side="right")), at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def postings_of(schema: pa.Schema, lengths: bool = False):
    """A function for ``mapInArrow`` over (id, texts …): a row per stem and row of its own.

    ``lengths`` adds a row without a term for every row, which tells its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for part in _slices(batch):
                yield from _grouped(part, known, schema, lengths)

    return run
