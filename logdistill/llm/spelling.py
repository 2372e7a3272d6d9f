"""Spelling variants of a vocabulary by composition of finite-state machines.

Two words are near if one inserted, deleted or replaced code point tells them
apart. The acceptor of the vocabulary, minimised, is composed with the transducer
of one edit and with the acceptor again; what that accepts are the near pairs.

The composition is cut by its initial state. Of two near words the longer has L
code points; either their first L // 2 agree, or what follows those of the longer
does. So a word goes to the partitions of its beginning and of its end, for L its
length and one more, and in each a minimised acceptor of the parts that are left
open is composed. A partition of more than ``LIMIT`` words is cut again, by halves
of the open part, until it is small; one open letter leaves no more words than
there are letters. Every pair belongs to the partition in which its edit lies (as
far right as it can be), so each is accepted once, and a partition returns for
each word the number of its near words and the best of them, not pairs.

Words without near words have none; ties go to the smallest word in code-point
order. Null texts have no words, a null id changes none; rows with repeated ids
count like any other. Extra columns may have any name; an empty table gives an
empty one. Texts are read whole; words may be as long as a text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .common import ascii_lower, packed, text_of

RUN = r"[A-Za-zÀ-ÿ]+"
SHORTEST, SEEN, TIMES, LIMIT = 7, 2, 10, 5_000


# --- machines --------------------------------------------------------------------
class Acceptor:
    """The minimal deterministic acceptor of sorted, distinct strings; state 0 is the initial one."""

    def __init__(self, strings: list[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []  # of the last string: state, letter, next state
        last = ""

        def settle(depth: int) -> None:
            while len(path) > depth:
                state, letter, child = path.pop()
                shape = (self.final[child], *self.arcs[child].items())
                self.arcs[state][letter] = known.setdefault(shape, child)

        for s in strings:
            same = 0
            while same < min(len(s), len(last)) and s[same] == last[same]:
                same += 1
            settle(same)
            at = path[-1][2] if path else 0
            for letter in s[same:]:
                self.arcs.append({})
                self.final.append(False)
                path.append((at, letter, len(self.arcs) - 1))
                at = len(self.arcs) - 1
            self.final[at] = True
            last = s
        settle(0)


class OneEdit:
    """The acceptor composed with the transducer of one edit and the acceptor again.

    A state of the composition is (p, edited, q). Before the edit p = q, as the
    acceptor is deterministic; behind it only equal letters lead on, so what two
    states still accept is the meet of their right languages, kept per two states.
    """

    def __init__(self, strings: list[str]) -> None:
        self.a = Acceptor(strings)
        self.meets: dict[tuple[int, int], tuple[bool, list[tuple[str, tuple[int, int]]]]] = {}

    def _meet(self, p: int, q: int) -> tuple[int, int]:
        """Two states as a key of ``meets``: whether both are final, and the arcs by which both
        still lead to a final state."""
        top = (min(p, q), max(p, q))
        stack = [top]
        while stack:
            two = stack[-1]
            if two in self.meets:
                stack.pop()
                continue
            few, many = sorted((self.a.arcs[two[0]], self.a.arcs[two[1]]), key=len)
            ahead = [(c, (min(s, many[c]), max(s, many[c]))) for c, s in few.items() if c in many]
            open_ = [k for _, k in ahead if k not in self.meets]
            if open_:
                stack += open_
                continue
            useful = [(c, k) for c, k in ahead if self.meets[k][0] or self.meets[k][1]]
            self.meets[two] = self.a.final[two[0]] and self.a.final[two[1]], useful
        return top

    def common(self, p: int, q: int, but: str = "") -> Iterator[str]:
        """The strings that lead from both states to a final one and do not begin with ``but``."""
        path: list[str] = []
        stack = [(self._meet(p, q), 0, "")]
        while stack:
            two, depth, letter = stack.pop()
            path[max(depth - 1, 0) :] = [letter]
            final, ahead = self.meets[two]
            if final:
                yield "".join(path)
            stack += [(k, depth + 1, c) for c, k in ahead if depth or c != but]

    def edits(self, p: int) -> list[tuple[str, str]]:
        """What follows a common beginning that leads to ``p``, if the next letter is the edit.

        A deleted letter is told from the one behind it, so that the edit lies as
        far right as it can.
        """
        arcs = sorted(self.a.arcs[p].items())
        out = []
        for i, (letter, state) in enumerate(arcs):
            out += [(letter + s, s) for s in self.common(state, p, but=letter)]
            for other, beside in arcs[i + 1 :]:
                out += [(letter + s, other + s) for s in self.common(state, beside)]
        return out

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All accepted pairs, once each."""
        held: dict[int, list[tuple[str, str]]] = {}
        path: list[str] = []
        stack = [(0, 0, "")]
        while stack:
            p, depth, letter = stack.pop()
            path[max(depth - 1, 0) :] = [letter]
            if p not in held:
                held[p] = self.edits(p)
            if held[p]:
                begun = "".join(path)
                for x, y in held[p]:
                    yield begun + x, begun + y
            stack += [(state, depth + 1, c) for c, state in self.a.arcs[p].items()]


# --- partitions ------------------------------------------------------------------
def _halves(length: Column, name: Column) -> Column:
    """The two partitions of a word's open part ``word[at : at + open]`` whose longer fellows
    have ``length`` open code points: by its beginning, its end left open, and the reverse."""
    h = F.floor(length / 2).cast("int")
    at, open_, word = F.col("at"), F.col("open"), F.col("word")
    first = F.substring(word, at + 1, h)
    last = F.substring(word, at + open_ - (length - h) + 1, length - h)

    def key(side: str, held: Column) -> Column:
        return F.sha2(F.concat_ws(":", name, F.lit(side), length, held), 256)

    return F.array(
        F.struct(key("p", first).alias("key"), (at + h).alias("at"), (open_ - h).alias("open"), (length - h).alias("long")),
        F.struct(key("s", last).alias("key"), at.alias("at"), (open_ - (length - h)).alias("open"), h.alias("long")),
    )


_PLACE = ("key", "word", "n", "at", "open", "long")


def _placed(rows: DataFrame, parts: Column) -> DataFrame:
    return rows.select("word", "n", F.explode(parts).alias("p")).select("p.key", "word", "n", "p.at", "p.open", "p.long")


def partitions(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows (key, word, n, at, open, long): the words of each partition and their open parts."""
    whole = words.select("word", "n", F.lit(0).alias("at"), F.length("word").alias("open"))
    both = F.concat(_halves(F.col("open"), F.lit("")), _halves(F.col("open") + 1, F.lit("")))
    rows, done = _placed(whole, both), None
    while True:
        hot = written(rows.groupBy("key").count().where(F.col("count") > limit).select("key"), "spelling-hot")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        cool = rows.join(hot, "key", "left_anti").select(*_PLACE)
        done = cool if done is None else done.unionByName(cool)
        rows = written(
            _placed(rows.join(hot, "key", "left_semi"), _halves(F.col("long"), F.col("key"))), "spelling-halves"
        )


def near(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (n, word) of the words (word, n) that have near ones."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch[c].to_pylist() for c in _PLACE), strict=True):
                if row[0] != now:
                    out += _near_in(group)
                    now, group = row[0], []
                group.append(row[1:])
            yield _found(out)
        yield _found(_near_in(group))

    rows = partitions(words, limit)
    fellows = Window.partitionBy("key")  # ``limit`` words at most
    many = rows.withColumn("fellows", F.count("*").over(fellows)).where("fellows > 1").select(*_PLACE)
    found = many.sortWithinPartitions("key").mapInArrow(
        compose, "word string, n_near bigint, best_n bigint, best string"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.struct((-F.col("b.n")).alias("n"), F.col("b.word").alias("word")).alias("best")
    )


def _near_in(group: list[tuple[str, int, int, int, int]]) -> list[tuple]:
    """Per word of a partition the number of its near words there and the best."""
    if len(group) < 2:
        return []
    at, long = group[0][2], group[0][4]
    of = {word[at : at + open_]: (word, n) for word, n, _, open_, _ in group}
    found: dict[str, list] = {}
    for x, y in OneEdit(sorted(of)).pairs():
        if max(len(x), len(y)) < long:
            continue  # both are one shorter: they have a partition of their own
        pair = of[x], of[y]
        if len(x) != len(y) and _common(pair[0][0], pair[1][0]) >= at + long:
            continue  # the deleted letter can be moved behind the open part
        for (word, _), (other, n) in (pair, pair[::-1]):
            mine = found.setdefault(word, [0, 0, ""])
            mine[0] += 1
            if (-n, other) < (-mine[1], mine[2]) or not mine[1]:
                mine[1:] = [n, other]
    return [(word, *rest) for word, rest in found.items()]


def _common(u: str, v: str) -> int:
    i = 0
    while i < min(len(u), len(v)) and u[i] == v[i]:
        i += 1
    return i


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "best_n", "best"]
    )


# --- words and forms -------------------------------------------------------------
def runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` (as text) and ``run``: every maximal run of letters, A-Z in lower case."""
    d = packed(docs, doc_id=F.col("doc_id").cast("bigint").cast("string"), text=ascii_lower(text_of()))
    return d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))


def mistyped(runs_: DataFrame) -> DataFrame:
    """``run`` without one code point where 31 divides h, the CRC-32 of ``<doc_id>:<run>``: the
    one numbered h % length."""
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs_.withColumn("h", h).select(F.when(F.pmod("h", F.lit(31)) == 0, short).otherwise(F.col("run")).alias("run"))


def vocabulary(runs_: DataFrame, shortest: int = SHORTEST, seen: int = SEEN) -> DataFrame:
    """``word`` and ``n``: the runs of ``shortest`` code points or more that come ``seen`` times or more."""
    long = runs_.where(F.length("run") >= shortest)
    return long.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def variants(words: DataFrame, times: int = TIMES, limit: int = LIMIT) -> DataFrame:
    """Each word with ``n``, ``n_near``, its ``form``, ``form_n`` and ``root``.

    The form is the near word of largest n, if that is ``times`` the word's n or
    more. So n grows from form to form, and the way to the root is short.
    """
    words = written(words, "spelling-words")
    found = words.join(near(words, limit), "word", "left")
    fits = F.col("best.n") >= times * F.col("n")
    with_form = written(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"),
            F.when(fits, F.col("best.n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    most = words.agg(F.max("n")).first()[0] or 1
    ahead = with_form.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(math.log(most, times) + 1))):  # twice as far each time
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = written(
            ahead.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots"
        )
    return with_form.join(ahead, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def report(docs: DataFrame) -> DataFrame:
    return variants(vocabulary(mistyped(runs(docs))))
