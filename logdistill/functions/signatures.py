"""Error signatures that a summary has to keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind
from .text import contains_any, rstrip, strip

# --- fixed values -----------------------------------------------------------
# A match may start at a word's first character or where the last one ended;
# this equals a plain left-to-right search but visits every word only once.
PYTHON_ERROR = (
    r"(?dU)(?:\G|(?<![\p{L}\p{N}_]))[\p{L}\p{N}_]+(?:Error|Exception|Warning):"
    r"[\s\x1c-\x1f]*.{1,60}"
)
RUST_CODE = r"(?U)error\[E\d+\]:"
GCC_ERROR = (
    r"(?dU)(?:\G|(?<![^\s\x1c-\x1f]))[^\s\x1c-\x1f]+\.(?:c|cpp):\d+:\d+: error: .{1,60}"
)
PYTHON_MARKS = ("Error:", "Exception:", "Warning:")
RUST_MARKS = ("error[E",)
GCC_MARKS = (": error: ",)
MESSAGE_CHARS = 40
# ----------------------------------------------------------------------------


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _message(c: Column) -> Column:
    return F.substring(strip(c), 1, MESSAGE_CHARS)


def _python(hit: Column) -> Column:
    name = F.substring_index(hit, ":", 1)
    return F.concat(name, F.lit(":"), _message(F.substr(hit, F.length(name) + 2)))


def _gcc(hit: Column) -> Column:
    message = F.regexp_extract(hit, r"(?dU)^[^\s\x1c-\x1f]+: error: (.*)$", 1)
    return F.concat(F.lit("gcc:"), _message(message))


def _in_lines(lines: Column, marks: tuple[str, ...], pattern: str) -> Column:
    """Matches in the lines that hold one of ``marks``; others are never searched."""
    marked = F.filter(lines, lambda x: contains_any(x, marks))
    return F.flatten(F.transform(marked, lambda x: _all(x, pattern)))


def _headline_ends(line: Column) -> Column:
    """The error's message, if any, stands on a later line."""
    end = rstrip(line)
    return end.endswith("Error:") | end.endswith("Exception:") | end.endswith("Warning:")


def extract_signatures(c: Column) -> Column:
    """The set of signatures in a text, as an array of distinct strings.

    A match lies within one line, but for an error whose message follows on a
    later one; only a text with such a line is searched as a whole. Equal lines
    are searched once.
    """
    def whole(t: Column) -> Column:
        def found(lines: Column) -> Column:
            python = F.when(
                F.exists(lines, _headline_ends), _all(t, PYTHON_ERROR)
            ).otherwise(_in_lines(lines, PYTHON_MARKS, PYTHON_ERROR))
            return F.array_distinct(
                F.concat(
                    F.transform(python, _python),
                    F.transform(
                        _in_lines(lines, RUST_MARKS, RUST_CODE), lambda h: F.rtrim(h, F.lit(":"))
                    ),
                    F.transform(_in_lines(lines, GCC_MARKS, GCC_ERROR), _gcc),
                )
            )

        return bind(F.array_distinct(F.split(t, "\n")), found)

    return bind(c, whole)
