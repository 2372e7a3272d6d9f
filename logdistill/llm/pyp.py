"""Scores of a hierarchical Pitman-Yor bigram model.

Every word is the context of the next: a restaurant whose customers are the
words that follow, and whose tables are customers of one parent restaurant that
all contexts share. Its base is uniform over the words of the training texts
and one unknown. Seating is sampled by Gibbs in blocks: all customers of a dish
leave their tables and sit down again, at tables of their own or with each other.
Probabilities are averages of the predictive ones over samples.

The work is dealt by context, so a restaurant is whole in one shard; contexts
that hold a notable part of all words are dealt by context and word instead,
and their totals exchanged. Blocks of texts combine equal pairs before anything
moves. Three rounds over the texts:

1. words that are notable in a block, for the list of heavy contexts (bounded by
   their least share) and the number of shards;
2. pairs, with their counts in the training texts: each shard seats its contexts under a parent of
   its own, and sends the parent tables by word. Shards of words seat the parent
   over all contexts and answer each shard for its words;
3. pairs of all texts: the same restaurants are seated again under the common
   parent, sampled, and every text's pairs looked up.

Every move seats all customers anew, those of a dish together; heavy contexts
keep the totals of round 2. Words are
known by 64-bit hashes of their lower-case bytes: among n different words a
mistaken pair is expected n * n / 2**65 times.

Null texts are empty (one token, the end). A null id counts as the empty text in
the choice of training texts. Rows that repeat an id are separate documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .common import packed, text_of
from .wordhash import STEP, Words, mix

DISCOUNT, STRENGTH = 0.8, 1.0  # of contexts
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 1.0
BURN_IN, SAMPLES = 2, 3
#: Customers of a dish up to which the ways to seat them are tabulated.
TABULATED = 1024
#: Tables of a dish with more customers up to which each number has its own weight.
FEW = 96
#: Terms of an expansion in powers.
POWERS = 150
#: Numbers that one step of a draw holds.
ROOM = 1 << 17
BLOCK_BYTES = 6_000_000
#: Texts of an Arrow batch that are taken out of it at a time.
SLICE = 256
SHARD_TOKENS = 2_500_000
FOLDS, HELD_OUT = 5, 1
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


# --- Seating -------------------------------------------------------------------
def _log_ways(d: float, most: int) -> np.ndarray:
    """Logs of the weights of seating c customers of a dish at t tables, for c up to ``most``.

    The weight of a seating is the product of (1 - d)(2 - d) … (n - 1 - d) over its
    tables of n: generalised Stirling numbers, by their recursion.
    """
    held = _WAYS.get(d)
    if held is None or len(held) <= most:
        held = np.full((most + 1, most + 1), -np.inf)
        held[1, 1] = 0.0
        for c in range(1, most):
            t = np.arange(1, c + 1)
            held[c + 1, 1 : c + 1] = np.logaddexp(held[c, :c], np.log(c - d * t) + held[c, 1 : c + 1])
            held[c + 1, c + 1] = 0.0
        _WAYS[d] = held
    return held


_WAYS: dict[float, np.ndarray] = {}


def _powers(c: np.ndarray, d: float, most: int) -> np.ndarray:
    """Of (1 - z)**(j * d), j from 1 to ``most``: c! times the coefficient of z**c,
    times c**((j - 1) * d), over gamma(c - d); by Stirling's series, for c far above j."""
    a = np.arange(1, most + 1) * d
    over = [0.0 if float(x).is_integer() else 1 / math.gamma(-x) for x in a.tolist()]

    def part(a: np.ndarray | float) -> np.ndarray:
        z = c[:, None] - a
        return (z - 0.5) * np.log1p(-a / c[:, None]) + a + 1 / (12 * z) - 1 / (360 * z**3)

    return np.exp(part(a) - part(d)) * over


def _log_sum(log_x: np.ndarray, c: np.ndarray, d: float, few: np.ndarray) -> np.ndarray:
    """Log of the sum of x**t * ways(c, t) over t, but for a term of c alone.

    The sum is c! times a coefficient of exp(x * (1 - (1 - z)**d) / d). With tables ``few``
    against c**d its expansion in powers of (1 - z)**d converges soon; else by saddle point.
    """
    out = np.empty(len(c))
    out[~few] = _saddle(log_x[~few], c[~few], d)
    short = np.flatnonzero(few)
    rows = max(1, ROOM // POWERS)
    for at in (short[i : i + rows] for i in range(0, len(short), rows)):
        x = np.exp(log_x[at]) / d
        factors = np.cumprod(-(x * c[at] ** -d)[:, None] / np.arange(1, POWERS + 1), axis=1)
        out[at] = x + np.log((factors * _powers(c[at], d, POWERS)).sum(1))
    return out


def _saddle(log_x: np.ndarray, c: np.ndarray, d: float) -> np.ndarray:
    log_c = np.log(c)
    high = np.minimum((log_x - log_c) / (1 - d), 0.0)
    low = high - 60.0
    for _ in range(70):  # the point, as log(1 - z)
        v = (low + high) / 2
        with np.errstate(divide="ignore"):
            above = log_x - log_c + np.log(-np.expm1(v)) - (1 - d) * v > 0
        low, high = np.where(above, v, low), np.where(above, high, v)
    v = low
    x, z = np.exp(log_x), -np.expm1(v)
    spread = z * np.exp((d - 1) * v) + z * z * (1 - d) * np.exp((d - 2) * v)
    return -x * np.expm1(d * v) / d - c * np.log(z) - 0.5 * (log_x + np.log(spread))


def _few(log_x: np.ndarray, c: np.ndarray, d: float) -> np.ndarray:
    """Logs of x**t * ways(c, t) for t up to ``FEW``, c far above, by their finite sum."""
    j = np.arange(1, FEW + 1)
    falls = _powers(c, d, FEW) * (-1.0) ** j * np.exp(-np.outer(np.log(c), (j - 1) * d))
    choose = np.array([[math.comb(t, k) for t in j.tolist()] for k in j.tolist()], float)
    fixed = np.array([math.lgamma(t + 1) + t * math.log(d) for t in j.tolist()])
    return np.log(np.maximum(falls @ choose, 1e-300)) - fixed + log_x[:, None] * j


def _picked(logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column of every row, counted from 1, by the logs of its weights."""
    upto = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
    drawn = rng.random(len(logs)) * upto[:, -1]
    return np.minimum((upto <= drawn[:, None]).sum(1) + 1, logs.shape[1])


class Seating:
    """Customers ``c`` per dish in restaurants ``ctx``, under parent probabilities ``h``.

    ``more_tables`` are tables of each restaurant that other shards hold. Only the
    numbers of tables ``t`` count for probabilities, so they are the state. It starts
    at the expected numbers. A move seats all customers anew, whatever their number,
    so ``moves`` needs no room of its own.
    """

    def __init__(self, c, ctx, h, n_ctx, rng, d=DISCOUNT, theta=STRENGTH, moves=BURN_IN + SAMPLES, more_tables=None):
        self.c, self.ctx, self.h, self.rng, self.d, self.theta = c, ctx, h, rng, d, theta
        self.more = np.zeros(n_ctx) if more_tables is None else more_tables
        t = np.ones(len(c))
        for _ in range(2):
            self.tables = np.bincount(ctx, t, n_ctx) + self.more
            t = self._expected()
        self.t = np.minimum(np.maximum(np.rint(t), 1), c).astype(np.int64)
        self.moving = np.flatnonzero(c > 1)
        self.alone = np.bincount(ctx[c <= 1], minlength=n_ctx)  # tables of dishes that stay at theirs
        self._count()
        by_size = self.moving[np.argsort(c[self.moving], kind="stable")]
        cuts = np.flatnonzero(np.diff(np.minimum(c[by_size], TABULATED + 1))) + 1
        self.alike = [part for part in np.split(by_size, cuts) if len(part)]

    def _count(self) -> None:
        """Tables per restaurant; whole numbers, so the order of adding does not tell."""
        seats = np.bincount(self.ctx[self.moving], self.t[self.moving], len(self.more))
        self.tables = self.alone + seats + self.more

    def _expected(self, steps: int = 16) -> np.ndarray:
        t = np.ones(len(self.c))
        big = np.flatnonzero(self.c > 1)
        a = (self.theta + self.d * self.tables[self.ctx[big]]) * self.h[big]
        c, n, x = self.c[big].astype(float), np.ones(len(big)), np.ones(len(big))
        for k in range(1, steps + 1):
            to = c ** (k / steps)
            x = x + (to - n) * a / (n - self.d * x + a)
            x, n = np.minimum(x, to), to
        t[big] = x
        return t

    def move(self) -> None:
        """All customers of every dish leave and sit down again.

        A gamma variable per restaurant, drawn given its tables, makes its dishes
        independent: t tables of a dish then weigh x**t times the ways to seat its
        customers there. That is drawn from as it is, but for dishes with more than
        ``TABULATED`` customers and many tables, whose number is nearly normal.
        """
        if not len(self.moving):
            return
        gamma = self.rng.gamma(self.theta / self.d + self.tables)

        def log_x(at: np.ndarray) -> np.ndarray:
            with np.errstate(divide="ignore"):
                return np.log(self.h[at]) + np.log(self.d * gamma[self.ctx[at]])

        most = min(TABULATED, int(self.c.max()))
        for part in self.alike:
            size = int(self.c[part[0]])
            if size > TABULATED:
                self.t[part] = self._many(self.c[part].astype(float), log_x(part))
                continue
            tables = np.arange(1, size + 1)
            ways = _log_ways(self.d, most)[size, 1 : size + 1]
            rows = max(1, ROOM // size)
            for at in (part[i : i + rows] for i in range(0, len(part), rows)):
                self.t[at] = _picked(ways + log_x(at)[:, None] * tables, self.rng)
        self._count()

    def _many(self, c: np.ndarray, log_x: np.ndarray) -> np.ndarray:
        """Tables of dishes with many customers."""
        step = 0.01
        low = log_x - self.d * np.log(c) <= (1 - self.d) * math.log(8)
        less, here, more = (_log_sum(log_x + k * step, c, self.d, low) for k in (-1, 0, 1))
        mean = (more - less) / (2 * step)
        spread = np.sqrt(np.maximum((more - 2 * here + less) / step**2, 0.0))
        t = np.rint(mean + spread * self.rng.standard_normal(len(c)))
        few = np.flatnonzero(mean <= FEW / 3)
        rows = max(1, ROOM // FEW)
        for at in (few[i : i + rows] for i in range(0, len(few), rows)):
            t[at] = _picked(_few(log_x[at], c[at], self.d), self.rng)
        return np.clip(t, 1, c).astype(np.int64)

    @property
    def off(self) -> np.ndarray:
        """Where the tables of each dish with more than one customer begin in ``sizes``."""
        mine = self.t[self.moving]
        return np.cumsum(mine) - mine

    @property
    def sizes(self) -> np.ndarray:
        """A seating with these numbers of tables: one large, the others for one."""
        out = np.ones(int(self.t[self.moving].sum()), np.int64)
        out[self.off] = self.c[self.moving] - self.t[self.moving] + 1
        return out

    def sampled(self, burn_in=BURN_IN, samples=SAMPLES) -> tuple[np.ndarray, np.ndarray]:
        """Mean tables per dish and per restaurant; ``t`` and ``tables`` hold the last sample."""
        for _ in range(burn_in):
            self.move()
        t, tables = np.zeros(len(self.t)), np.zeros(len(self.tables))
        for _ in range(samples):
            self.move()
            t += self.t
            tables += self.tables
        return t / samples, tables / samples


# --- Blocks of texts -----------------------------------------------------------
def _freeze(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a.tobytes()) for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays))


def _thaw(data: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Ids, training marks and texts in blocks of about ``BLOCK_BYTES``."""
    ids, train, texts, size = [], [], [], 0
    for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
        for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            learns = zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS != HELD_OUT
            ids.append(i)
            train.append(learns)
            texts.append(text.encode())
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield ids, train, texts
                ids, train, texts, size = [], [], [], 0
    if ids:
        yield ids, train, texts


def _pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and text of every token, the end of each text included."""
    words = Words(texts, lower=True)
    n = np.bincount(words.doc, minlength=len(texts))
    ends = np.cumsum(n + 1) - 1
    w = np.full(int((n + 1).sum()), END, np.uint64)
    inside = np.ones(len(w), bool)
    inside[ends] = False
    w[inside] = words.hash
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[ends - n] = START
    return u, w, np.repeat(np.arange(len(texts)), n + 1)


def _shard(u: np.ndarray, w: np.ndarray, heavy: np.ndarray, shards: int) -> np.ndarray:
    key = u
    if len(heavy):
        place = np.minimum(np.searchsorted(heavy, u), len(heavy) - 1)
        key = np.where(heavy[place] == u, mix(u * STEP + w), u)
    return ((mix(key) >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), part


def _coded(u: np.ndarray, w: np.ndarray, *more: np.ndarray) -> bytes:
    """Pairs in order of context, words by their place among the different ones."""
    different, place = np.unique(w, return_inverse=True)
    contexts, runs = np.unique(u, return_counts=True)
    kind = np.uint16 if len(different) < 65_536 else np.uint32
    return _freeze(
        np.array([np.dtype(kind).itemsize], np.int64), contexts, runs.astype(np.uint32), different,
        place.astype(kind).view(np.uint8), *more,
    )


def _decoded(data: bytes, *kinds) -> list[np.ndarray]:
    width, contexts, runs, different, place, *more = _thaw(
        data, np.int64, np.uint64, np.uint32, np.uint64, np.uint8, *kinds
    )
    place = place.view(np.uint16 if width[0] == 2 else np.uint32)
    return [np.repeat(contexts, runs), different[place], *more]


def _distinct(u: np.ndarray, w: np.ndarray, n: np.ndarray, doc: np.ndarray | None = None):
    """Equal rows as one with their sum, in order of context, word (and text)."""
    order = np.lexsort((w, u) if doc is None else (doc, w, u))
    u, w, n = u[order], w[order], n[order]
    fresh = np.ones(len(u), bool)
    fresh[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    if doc is not None:
        doc = doc[order]
        fresh[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(fresh)
    sums = np.add.reduceat(n, first) if len(first) else n
    return u[first], w[first], sums, (None if doc is None else doc[first])


def _joined(parts: list[list[np.ndarray]]) -> Iterator[np.ndarray]:
    """Each column of all ``parts``, which are emptied on the way."""
    for _ in range(len(parts[0])):
        yield np.concatenate([p.pop(0) for p in parts])


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with a notable part of a block, and all tokens (word null)."""
    for _, _, texts in _blocks(batches):
        u, _, _ = _pairs(texts)
        values, n = np.unique(u, return_counts=True)
        much = n * 4096 >= len(u)  # 4,096 words a block at most
        rows = [(int(v), int(k)) for v, k in zip(values[much].view(np.int64), n[much], strict=True)]
        yield _batch(["w", "n"], [pa.int64(), pa.int64()], [*rows, (None, len(u))])


SENT = "kind int, target int, shard int, data binary"
REPLY = "shard int, part int, data binary, n bigint, v bigint, customers bigint, tables double"
PARTIAL = "block string, ids binary, sums binary"
SCORE = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def _contexts(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of ``u``, which is sorted, and the place of each row among them."""
    fresh = np.ones(len(u), bool)
    fresh[1:] = u[1:] != u[:-1]
    return u[fresh], np.cumsum(fresh) - 1


def _first_parent(w: np.ndarray) -> np.ndarray:
    """A parent from one shard: words by the number of its contexts they follow."""
    different, place, n = np.unique(w, return_inverse=True, return_counts=True)
    return ((n + 0.5) / (n.sum() + 0.5 * (len(different) + 1)))[place]


def scores(docs: DataFrame) -> DataFrame:
    """Tokens, base score and model score (log10) of every text."""
    spark = docs.sparkSession
    texts = packed(docs, doc_id=F.col("doc_id").cast("bigint"), text=text_of()).select("doc_id", "text")

    # Round 1: bounded by 1 / the least share of a heavy context
    found = written(texts.mapInArrow(_heavy, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")), "heavy")
    total = (found.where("w is null").first() or {"n": 0})["n"]
    shards = max(8, -(-total // SHARD_TOKENS))
    least = max(1, total // (4 * shards))
    rows = found.where(F.col("w").isNotNull() & (F.col("n") >= least)).select("w").collect()
    heavy = np.sort(np.array([r["w"] for r in rows], np.int64).view(np.uint64))

    # Round 2
    def train(batches):
        for _, learns, block in _blocks(batches):
            u, w, doc = _pairs(block)
            u, w, n, _ = _distinct(u, w, np.array(learns, np.int64)[doc])
            for s, part in _by_shard(_shard(u, w, heavy, shards)):
                data = _coded(u[part], w[part], n[part].astype(np.uint32))
                yield _batch(["shard", "data"], [pa.int32(), pa.binary()], [(s, data)])

    def seat(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_decoded(d, np.uint32) for d in pdf["data"]]
        u, w, n = _joined(parts)
        del parts
        u, w, c, _ = _distinct(u, w, n.astype(np.int64))
        del n
        values, ctx = _contexts(u)
        rng = np.random.default_rng([1, int(key[0])])
        seated = np.flatnonzero(c > 0)  # the others are asked for by held-out texts
        s = Seating(c[seated], ctx[seated], _first_parent(w[seated]), len(values), rng)
        s.sampled()
        different, place = np.unique(w, return_inverse=True)
        words = np.bincount(place, c, len(different)).astype(np.int64)
        tables = np.bincount(place[seated], s.t, len(different)).astype(np.int64)
        to = _range(different, shards)
        rows = [
            (0, t, int(key[0]), _freeze(different[p], words[p], tables[p])) for t, p in _by_shard(to)
        ]
        own = np.flatnonzero(np.isin(values, heavy))
        if len(own):
            many = np.bincount(ctx, c, len(values)).astype(np.int64)
            rows.append((1, 0, int(key[0]), _freeze(values[own], many[own], s.tables[own])))
        return pd.DataFrame(rows, columns=["kind", "target", "shard", "data"])

    pairs = texts.mapInArrow(train, "shard int, data binary")
    sent = written(pairs.groupBy("shard").applyInPandas(seat, SENT), "seated")
    totals: dict[int, list[float]] = {}
    for r in sent.where("kind = 1").select("data").toLocalIterator():  # heavy contexts only
        for v, c, t in zip(*(x.tolist() for x in _thaw(r["data"], np.uint64, np.int64, np.float64)), strict=True):
            held = totals.setdefault(v, [0, 0.0])
            held[0], held[1] = held[0] + c, held[1] + t

    def parent(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_thaw(d, np.uint64, np.int64, np.int64) for d in pdf["data"]]
        w = np.concatenate([p[0] for p in parts])
        different, place = np.unique(w, return_inverse=True)
        c = np.bincount(place, np.concatenate([p[1] for p in parts]), len(different)).astype(np.int64)
        t = np.bincount(place, np.concatenate([p[2] for p in parts]), len(different)).astype(np.int64)
        rng = np.random.default_rng([2, int(key[0])])
        seated = np.flatnonzero(t > 0)
        size = len(seated)
        h = np.full(size, 1.0 / (size * shards + 1))
        # the parent's other words are in other shards, about as many tables in each
        more = np.array([float(size) * (shards - 1)])
        s = Seating(
            t[seated], np.zeros(size, np.int64), h, 1, rng, PARENT_DISCOUNT, PARENT_STRENGTH, more_tables=more
        )
        at_seats, tables = s.sampled()
        mean = np.zeros(len(t))
        mean[seated] = at_seats
        ends = np.cumsum([len(p[0]) for p in parts])
        rows = []
        for i, (e, p) in enumerate(zip(ends, parts, strict=True)):
            at = place[e - len(p[0]) : e]
            data = _freeze(different[at], c[at], t[at] - PARENT_DISCOUNT * mean[at])
            sums = (int(c.sum()), size, int(t.sum()), float(tables[0] - more[0])) if i == 0 else (0, 0, 0, 0.0)
            rows.append((int(pdf["shard"].iloc[i]), int(key[0]), data, *sums))
        return pd.DataFrame(rows, columns=["shard", "part", "data", "n", "v", "customers", "tables"])

    replies = written(sent.where("kind = 0").groupBy("target").applyInPandas(parent, REPLY), "parents")
    sums = replies.agg(F.sum("n"), F.sum("v"), F.sum("customers"), F.sum("tables")).first()
    tokens, vocabulary, customers, parent_tables = (x or 0 for x in sums)
    rest = (PARENT_STRENGTH + PARENT_DISCOUNT * parent_tables) / (vocabulary + 1)
    norm = PARENT_STRENGTH + customers

    # Round 3
    def occur(batches):
        task = TaskContext.get().partitionId()
        for k, (ids, learns, block) in enumerate(_blocks(batches)):
            u, w, doc = _pairs(block)
            u, w, n, doc = _distinct(u, w, np.ones(len(u), np.int64), doc)
            head = _freeze(
                np.array([-1 if i is None else i for i in ids], np.int64),
                np.array([i is None for i in ids], bool), np.array(learns, bool),
            )
            for s, p in _by_shard(_shard(u, w, heavy, shards)):
                data = _coded(u[p], w[p], doc[p].astype(np.uint32), n[p].astype(np.uint32))
                yield _batch(
                    ["shard", "block", "ids", "data"], [pa.int32(), pa.string(), pa.binary(), pa.binary()],
                    [(s, f"{task}-{k}", head, data)],
                )

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [_decoded(d, np.uint32, np.uint32) for d in left["data"]]
        heads = [_thaw(i, np.int64, bool, bool) for i in left["ids"]]
        learns = np.concatenate([h[2][p[2]] for h, p in zip(heads, parts, strict=True)])
        ends = np.cumsum([len(p[2]) for p in parts])
        u, w, doc, n = _joined(parts)
        del parts
        order = np.lexsort((w, u))
        u = u[order]
        w = w[order]
        fresh = np.ones(len(u), bool)
        fresh[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        u, w = u[fresh], w[fresh]
        pair = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
        pair[order] = np.cumsum(fresh) - 1
        del order, fresh
        c = np.bincount(pair, np.where(learns, n, 0), len(u)).astype(np.int64)
        del learns
        known = [_thaw(d, np.uint64, np.int64, np.float64) for d in right["data"]]
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
        kw, kc, kt = (np.concatenate([none[i], *[x[i] for x in known]]) for i in range(3))
        by_word = np.argsort(kw)
        kw, kc, kt = kw[by_word], kc[by_word], kt[by_word]
        place = np.minimum(np.searchsorted(kw, w), max(len(kw) - 1, 0))
        hit = kw[place] == w if len(kw) else np.zeros(len(w), bool)
        words = np.where(hit, kc[place] if len(kw) else 0, 0)
        h = (np.where(hit, kt[place] if len(kw) else 0.0, 0.0) + rest) / norm
        base = np.log10((words + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
        seen = words > 0
        del w, kw, kc, kt, by_word, place, hit, words
        values, ctx = _contexts(u)
        many = np.bincount(ctx, c, len(values))
        more_c, more_t = np.zeros(len(values)), np.zeros(len(values))
        for i in np.flatnonzero(np.isin(values, heavy)):
            total_c, total_t = totals.get(int(values[i]), (0, 0.0))
            more_c[i] = max(total_c - many[i], 0)
            more_t[i] = total_t * more_c[i] / max(total_c, 1)
        seated = np.flatnonzero(c > 0)
        rng = np.random.default_rng([3, int(key[0])])
        s = Seating(c[seated], ctx[seated], h[seated], len(values), rng, more_tables=more_t)
        t, tables = s.sampled()
        del s
        p = (STRENGTH + DISCOUNT * tables[ctx]) * h
        p[seated] += c[seated] - DISCOUNT * t
        p /= (STRENGTH + many + more_c)[ctx]
        del t, h, c, ctx, seated
        log_p = np.log10(p, out=p)
        rows = []
        for i, (a, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            at, k, of, size = pair[a:e], n[a:e].astype(np.int64), doc[a:e], len(heads[i][0])
            sums = [
                np.bincount(of, k, size).astype(np.uint32),
                np.bincount(of, k * seen[at], size).astype(np.uint32),
                np.bincount(of, k * base[at], size),
                np.bincount(of, k * log_p[at], size),
            ]
            rows.append((left["block"].iloc[i], left["ids"].iloc[i], _freeze(*sums)))
        return pd.DataFrame(rows, columns=["block", "ids", "sums"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, null, learns = _thaw(pdf["ids"].iloc[0], np.int64, bool, bool)
        # sums in order of the shards: the same to the last bit in every run
        parts = sorted(pdf["sums"])
        got = [_thaw(x, np.uint32, np.uint32, np.float64, np.float64) for x in parts]
        sums = [sum(x[i].astype(np.int64 if i < 2 else np.float64) for x in got) for i in range(4)]
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if z else i for i, z in zip(ids.tolist(), null, strict=True)], dtype="Int64"),
                "held_out": ~learns, "n_tokens": sums[0], "n_known": sums[1],
                "train_tokens": np.full(len(ids), tokens, np.int64), "base_score": sums[2], "score": sums[3],
            }
        )

    all_pairs = texts.mapInArrow(occur, "shard int, block string, ids binary, data binary")
    both = all_pairs.groupBy("shard").cogroup(replies.select("shard", "part", "data").groupBy("shard"))

    def score_all(key, left, right):
        if not len(left):
            return pd.DataFrame({"block": [], "ids": [], "sums": []})
        return score(key, left, right)

    return both.applyInPandas(score_all, PARTIAL).groupBy("block").applyInPandas(gather, SCORE)


def _range(values: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a word as a member of the parent."""
    return ((values >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def perplexity(scored: DataFrame) -> DataFrame:
    """Of the held-out and the training texts: tokens and perplexity per token."""
    return scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"),
    )
