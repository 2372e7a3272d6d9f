"""What kind of output a text is: tracebacks, compiler walls, log floods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind, occurrences
from .text import contains_any, content_lines, split_lines, strip, strip_ansi

# --- fixed values -----------------------------------------------------------
# (?U) gives \s, \S and \d their Unicode meaning, \x1c-\x1f complete the white
# space; (?md) lets ^ match after "\n" only. A leading blank run is kept within
# its line, which finds the same texts without rescanning runs of blank lines.
TRACEBACK_TEXT = r"(?mdU)^[\s\x1c-\x1f&&[^\n]]*Traceback \(most recent call last\):"
TRACEBACK_LINE = r"(?U)^[\s\x1c-\x1f]*Traceback \(most recent call last\):"
FRAME_LINE = r'(?U)^[\s\x1c-\x1f]+File "([^"]+)", line (\d+), in (.+)$'
HEADER_TEXT = "Traceback (most recent call last):"
FRAME_MARK = 'File "'
RUST_MARK = "error[E"
GCC_MARKS = (": error:", ": warning:", ": note:")
FRAME_TEXT = "$1:$2 in $3"
RUST_ERROR = r"(?mdU)^error\[E\d+\]:"
GCC_DIAGNOSTIC = (
    r"(?mdU)^[^\s\x1c-\x1f]+\.(?:c|cpp|cc|cxx|h|hpp):\d+:\d+: (?:error|warning|note):"
)
LIBRARY_MARKS = ("site-packages", "/lib/python", "<frozen", "/lib64/python", "distlib")
FLOOD_SHARE = 0.6
FLOOD_LINES = 10
# ----------------------------------------------------------------------------


# Each test looks for a literal first: a byte search spares most lines the regex.
def is_traceback(c: Column) -> Column:
    return c.contains(HEADER_TEXT) & c.rlike(TRACEBACK_TEXT)


def is_traceback_line(line: Column) -> Column:
    return line.contains(HEADER_TEXT) & line.rlike(TRACEBACK_LINE)


def is_rust_errors(c: Column) -> Column:
    return c.contains(RUST_MARK) & c.rlike(RUST_ERROR)


def is_gcc_diagnostics(c: Column) -> Column:
    return contains_any(c, GCC_MARKS) & c.rlike(GCC_DIAGNOSTIC)


def is_frame(line: Column) -> Column:
    return line.contains(FRAME_MARK) & line.rlike(FRAME_LINE)


def parse_frame(line: Column) -> Column:
    """``  File "f", line n, in fn`` as ``f:n in fn``."""
    return F.regexp_replace(line, FRAME_LINE, FRAME_TEXT)


def is_library_frame(frame: Column) -> Column:
    """The test covers the whole formatted frame, the function name included."""
    return contains_any(frame, LIBRARY_MARKS)


def may_repeat(lines: Column, share: float, kinds: Column | None = None) -> Column:
    """Cheap necessary test for a flood: few enough different lines (``kinds``).

    With n lines and u different ones, the commonest has at most n - u + 1.
    """
    n = F.size(lines)
    kinds = F.array_distinct(lines) if kinds is None else kinds
    return (n >= FLOOD_LINES) & ((n - F.size(kinds) + 1) / n >= F.lit(share))


def top_share(counts: Column, lines: Column) -> Column:
    return F.array_max(F.transform(counts, lambda x: x["n"])) / F.size(lines)


def is_repetitive(c: Column, share: float = FLOOD_SHARE) -> Column:
    """One stripped line makes up at least ``share`` of ten or more lines."""
    return bind(
        content_lines(split_lines(c)),
        lambda ls: F.when(
            may_repeat(ls, share),
            bind(occurrences(ls), lambda occ: top_share(occ, ls) >= F.lit(share)),
        ).otherwise(False),
    )


def classify(c: Column, share: float = FLOOD_SHARE) -> Column:
    """``traceback``, ``rust``, ``gcc``, ``flood`` or null; the first that fits."""
    return bind(
        strip_ansi(c),
        lambda t: F.when(is_traceback(t), "traceback")
        .when(is_rust_errors(t), "rust")
        .when(is_gcc_diagnostics(t), "gcc")
        .when(is_repetitive(t, share), "flood"),
    )


def matches(c: Column, share: float = FLOOD_SHARE) -> Column:
    return classify(c, share).isNotNull()


def is_incomplete_traceback(c: Column) -> Column:
    """A traceback whose last non-blank line is still a header or a frame."""
    def pending(t: Column) -> Column:
        solid = F.filter(split_lines(t), lambda x: strip(x) != "")
        return bind(
            F.try_element_at(solid, F.lit(-1)),
            lambda last: F.coalesce(
                is_traceback_line(last) | last.rlike(r"(?U)^[\s\x1c-\x1f]"), F.lit(False)
            ),
        )

    return bind(
        strip_ansi(c),
        lambda t: F.when(is_traceback(t), pending(t)).otherwise(False),
    )
