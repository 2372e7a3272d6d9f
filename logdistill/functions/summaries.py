"""Deterministic summaries of one text, as Column expressions.

Each works inside the row that holds the text: lines, blocks and counts are
arrays, so pruning a table needs no shuffle and runs unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import after, bind, first_position, head, last_n, occurrences, positions, spans
from .detect import (
    FLOOD_SHARE,
    is_frame,
    is_gcc_diagnostics,
    is_library_frame,
    is_rust_errors,
    is_traceback,
    is_traceback_line,
    may_repeat,
    parse_frame,
    top_share,
)
from .text import content_lines, is_plain, split_lines, strip, strip_ansi

# --- fixed values -----------------------------------------------------------
FLOOD_TITLE = "[Repetitive output: %d total line(s), %d unique]"
FLOOD_ROW = "  × %5d  %s"
FLOOD_REST = "  … and %d more unique line(s)"
RUST_TITLE = "[Rust build: %d error(s), %d warning(s) → %d unique error(s)]"
RUST_REST = "  … and %d more unique error(s)"
GCC_TITLE = "[C/C++ build: %d error(s), %d warning(s) → %d unique diagnostic(s)]"
GCC_REST = "  … and %d more"
BLOCK_TITLE = "── Traceback ──"
BLOCK_TITLE_OF = "── Traceback %d/%d ──"
BLOCK_FRAME = "  at "
BLOCK_EXCEPTION = "\n  ↳ "
FLOOD_ROWS = 8
FLOOD_WIDTH = 120
FEW_KINDS = 32
RUST_ROWS = 30
GCC_ROWS = 15
FRAMES_KEPT = 3
# ----------------------------------------------------------------------------


def _listing(title: Column, rows: Column, rest: Column) -> Column:
    return F.array_join(F.concat(F.array(title), rows, F.array(rest)), "\n")


def _rest(pattern: str, total: Column, shown: int) -> Column:
    """The closing line, or null (which array_join leaves out)."""
    return F.when(total > shown, F.format_string(pattern, total - shown))


# --- floods -----------------------------------------------------------------
def top_lines(counts: Column, k: int = FLOOD_ROWS) -> Column:
    """The k commonest of ``occurrences``; ties keep first-seen order."""
    ranked = F.sort_array(
        F.transform(
            counts,
            lambda x: F.struct((-x["n"]).alias("rank"), x["first"], x["key"], x["n"]),
        )
    )
    return F.slice(ranked, 1, k)


def _flood_table(counts: Column, lines: Column, k: int, width: int) -> Column:
    def row(x: Column) -> Column:
        shown = F.concat(
            F.substring(x["key"], 1, width),
            F.when(F.length(x["key"]) > width, "…").otherwise(""),
        )
        return F.format_string(FLOOD_ROW, x["n"], shown)

    return _listing(
        F.format_string(FLOOD_TITLE, F.size(lines), F.size(counts)),
        F.transform(top_lines(counts, k), row),
        _rest(FLOOD_REST, F.size(counts), k),
    )


def _counted(lines: Column, kinds: Column) -> Column:
    """Each of the different lines ``kinds`` with its number, in an order of first sight.

    Up to ``FEW_KINDS`` are counted one after another, which needs no sort and stays
    linear; more are cut from the sorted lines.
    """
    def one(key: Column, i: Column) -> Column:
        n = F.size(lines) - F.size(F.array_remove(lines, key))
        return F.struct(key.alias("key"), n.alias("n"), i.alias("first"))

    many = F.transform(occurrences(lines), lambda x: F.struct(x["key"], x["n"], x["first"]))
    return F.when(F.size(kinds) <= FEW_KINDS, F.transform(kinds, one)).otherwise(many)


def flood_of_lines(
    lines: Column, share: float = FLOOD_SHARE, k: int = FLOOD_ROWS, width: int = FLOOD_WIDTH
) -> Column:
    """Frequency table of stripped non-blank lines, or null if not repetitive."""
    def table(kinds: Column) -> Column:
        return F.when(
            may_repeat(lines, share, kinds),
            bind(
                _counted(lines, kinds),
                lambda occ: F.when(
                    top_share(occ, lines) >= F.lit(share), _flood_table(occ, lines, k, width)
                ),
            ),
        )

    return bind(F.array_distinct(lines), table)


def summarize_flood(
    c: Column, share: float = FLOOD_SHARE, k: int = FLOOD_ROWS, width: int = FLOOD_WIDTH
) -> Column:
    def whole(plain: Column) -> Column:
        lines = content_lines(split_lines(c, plain), plain)
        return bind(lines, lambda ls: flood_of_lines(ls, share, k, width))

    return bind(is_plain(c), whole)


def condense_context(lines: Column, share: float = FLOOD_SHARE) -> Column:
    """Lines around a traceback: a frequency table if repetitive, else as they are."""
    return _condensed(lines, share, None)


def _condensed(lines: Column, share: float, plain: Column | None) -> Column:
    return bind(
        content_lines(lines, plain),
        lambda ls: F.coalesce(
            flood_of_lines(ls, share), strip(F.array_join(lines, "\n"))
        ),
    )


# --- tracebacks -------------------------------------------------------------
def _closes_block(line: Column) -> Column:
    return (line != "") & ~line.startswith(" ") & ~line.startswith("\t") & ~is_frame(line)


def traceback_blocks(lines: Column) -> Column:
    """``array<struct<start, end, frames, exception>>`` in order.

    ``start`` is the header's position, ``end`` the exception's (null while
    open); frames are those between the two.
    """
    def block(start: Column, length: Column) -> Column:
        body = F.slice(lines, start + 2, length - 1)
        return bind(
            body,
            lambda b: bind(
                first_position(b, _closes_block),
                lambda e: F.struct(
                    start.alias("start"),
                    (start + 1 + e).cast("int").alias("end"),
                    F.transform(
                        F.filter(head(b, F.coalesce(e, F.size(b)).cast("int")), is_frame),
                        parse_frame,
                    ).alias("frames"),
                    F.coalesce(strip(F.get(b, e.cast("int"))), F.lit("")).alias("exception"),
                ),
            ),
        )

    return bind(
        positions(lines, is_traceback_line),
        lambda starts: spans(starts, F.size(lines), block),
    )


def deepest_user_frames(frames: Column, n: int = FRAMES_KEPT) -> Column:
    """The last n frames outside libraries, or the last n of all if there are none."""
    return bind(
        F.filter(frames, lambda f: ~is_library_frame(f)),
        lambda own: last_n(F.when(F.size(own) > 0, own).otherwise(frames), n),
    )


def preamble(lines: Column, blocks: Column) -> Column:
    return head(lines, F.get(blocks, F.lit(0))["start"])


def postamble(lines: Column, blocks: Column) -> Column:
    """Lines after the last closed block; none if no block was closed."""
    return bind(
        F.array_max(blocks["end"]),
        lambda e: F.when(e.isNull(), F.array().cast("array<string>")).otherwise(after(lines, e)),
    )


def summarize_tracebacks(
    c: Column, frames: int = FRAMES_KEPT, share: float = FLOOD_SHARE
) -> Column:
    def render(blocks: Column) -> Column:
        total = F.size(blocks)

        def part(b: Column, k: Column) -> Column:
            title = F.when(
                total > 1, F.format_string(BLOCK_TITLE_OF, k + 1, total)
            ).otherwise(BLOCK_TITLE)
            shown = F.transform(
                deepest_user_frames(b["frames"], frames),
                lambda f: F.concat(F.lit(BLOCK_FRAME), f),
            )
            return F.concat(
                title, F.lit("\n"), F.array_join(shown, "\n"), F.lit(BLOCK_EXCEPTION), b["exception"]
            )

        return F.transform(blocks, part)

    def whole(lines: Column, plain: Column) -> Column:
        def joined(blocks: Column) -> Column:
            around = F.transform(
                F.array(preamble(lines, blocks), postamble(lines, blocks)),
                lambda part: _condensed(part, share, plain),
            )
            parts = bind(
                around,
                lambda a: F.concat(
                    F.array(F.get(a, F.lit(0))), render(blocks), F.array(F.get(a, F.lit(1)))
                ),
            )
            return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")

        return bind(traceback_blocks(lines), joined)

    return bind(
        is_plain(c), lambda plain: bind(split_lines(c, plain), lambda ls: whole(ls, plain))
    )


# --- compiler walls ---------------------------------------------------------
def _indented(rows: Column) -> Column:
    return F.transform(rows, lambda x: F.concat(F.lit("  "), x))


def summarize_rust(c: Column, cap: int = RUST_ROWS) -> Column:
    """The first line of every error code, in order, up to ``cap``."""
    def render(lines: Column, errors: Column) -> Column:
        codes = F.transform(errors, lambda x: F.substring_index(x, ":", 1))
        warnings = F.size(F.filter(lines, lambda x: x.startswith("warning[")))
        return bind(
            codes,
            lambda cs: bind(
                F.array_distinct(cs),
                lambda kinds: _listing(
                    F.format_string(RUST_TITLE, F.size(errors), warnings, F.size(kinds)),
                    _indented(
                        F.transform(
                            F.slice(kinds, 1, cap),
                            lambda k: F.element_at(errors, F.array_position(cs, k).cast("int")),
                        )
                    ),
                    _rest(RUST_REST, F.size(kinds), cap),
                ),
            ),
        )

    return bind(
        split_lines(c),
        lambda ls: bind(
            F.filter(ls, is_rust_errors), lambda errors: render(ls, errors)
        ),
    )


def summarize_gcc(c: Column, cap: int = GCC_ROWS) -> Column:
    """Distinct diagnostic lines in order, up to ``cap``."""
    def count(rows: Column, kind: str) -> Column:
        return F.size(F.filter(rows, lambda x: x.contains(f": {kind}:")))

    return bind(
        F.filter(split_lines(c), is_gcc_diagnostics),
        lambda rows: bind(
            F.array_distinct(rows),
            lambda kinds: _listing(
                F.format_string(
                    GCC_TITLE, count(rows, "error"), count(rows, "warning"), F.size(kinds)
                ),
                _indented(F.slice(kinds, 1, cap)),
                _rest(GCC_REST, F.size(kinds), cap),
            ),
        ),
    )


def summarize(
    c: Column, share: float = FLOOD_SHARE, max_rust_errors: int = RUST_ROWS
) -> Column:
    """Summary by the first kind that fits, or null if the text is none of them."""
    return bind(
        strip_ansi(c),
        lambda t: F.when(is_traceback(t), summarize_tracebacks(t, share=share))
        .when(is_rust_errors(t), summarize_rust(t, max_rust_errors))
        .when(is_gcc_diagnostics(t), summarize_gcc(t))
        .otherwise(summarize_flood(t, share)),
    )
