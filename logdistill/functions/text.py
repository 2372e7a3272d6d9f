"""Scalar text functions over raw command output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind

# --- fixed values -----------------------------------------------------------
# Characters that str.strip() and str.isspace() treat as white space.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680])
) + "".join(map(chr, [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Line boundaries of str.splitlines().
LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
RARE_BREAKS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
# White space of one byte, but for the blank and the newline.
ODD_BLANKS = ("\t", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f")
# Terminal colour and cursor codes, removed before matching.
ESCAPE = "\x1b"
ANSI_CODE = r"\x1b\[[0-9;]*[mGKHFJA-Z]"
# Everything removed before stored text is shown, in this order.
TERMINAL_NOISE = (
    r"\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)",
    r"\x1b\[[0-9;?]*[ -/]*[@-~]",
    r"\x1b[@-Z\\-_]",
    r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]",
)
PROMPT_TOKENS = ("[Y/n]", "[y/N]", "[Y/N]", "[yes/no]", "(y/n)", "(yes/no)", "? ")
PROMPT_ENDINGS = ("?", ":", ">")
PROMPT_TAIL = 200
PROMPT_LINE = 120
# ----------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """``str.strip()``: SQL trim knows only the blank."""
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def is_plain(c: Column) -> Column:
    """ASCII without white space but blanks and newlines: lines end and are stripped simply."""
    return (F.octet_length(c) == F.length(c)) & ~contains_any(c, ODD_BLANKS)


def split_lines(c: Column, plain: Column | None = None) -> Column:
    """``str.splitlines()`` as an array: no entry after a final line break.

    A text with no break but the newline, as most are, needs no regex: a few
    byte searches tell, or ``plain``, its ``is_plain``, where that is known.
    """
    def cut(t: Column) -> Column:
        rare = contains_any(t, RARE_BREAKS)
        rare = rare if plain is None else ~plain & rare
        return F.when(rare, F.split(t, LINE_BREAK)).otherwise(F.split(t, "\n"))

    parts = bind(c, cut)
    return bind(
        parts,
        lambda p: F.when(
            F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)
        ).otherwise(p),
    )


def line_count(c: Column) -> Column:
    return F.size(split_lines(c))


def content_lines(lines: Column, plain: Column | None = None) -> Column:
    """Stripped non-blank lines of an array of lines, from a text that ``is_plain`` or not.

    ``trim`` takes a tenth of the time of ``strip``, but knows only the blank.
    """
    stripped = F.transform(lines, strip)
    if plain is not None:
        stripped = F.when(plain, F.transform(lines, lambda x: F.trim(x))).otherwise(stripped)
    return F.filter(stripped, lambda x: x != "")


def strip_ansi(c: Column) -> Column:
    return bind(
        c,
        lambda t: F.when(t.contains(ESCAPE), F.regexp_replace(t, ANSI_CODE, "")).otherwise(t),
    )


def sanitize(c: Column) -> Column:
    def escapes(t: Column) -> Column:
        out = t
        for pattern in TERMINAL_NOISE[:-1]:
            out = F.regexp_replace(out, pattern, "")
        return F.when(t.contains(ESCAPE), out).otherwise(t)

    return F.regexp_replace(bind(c, escapes), TERMINAL_NOISE[-1], "")


def decode_bytes(b: Column) -> Column:
    """UTF-8 if the whole value is valid, else latin-1."""
    as_text = b.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(b, "ISO-8859-1"))


def token_estimate(c: Column, floor: int = 0) -> Column:
    """A quarter of the characters; floor 0 in the archive, 1 in the reports."""
    return tokens_of(F.length(c), floor)


def tokens_of(n_chars: Column, floor: int = 0) -> Column:
    return F.greatest(F.lit(floor).cast("bigint"), F.floor(n_chars / 4).cast("bigint"))


def saves_enough(summary: Column, text: Column, ratio: float = 0.75) -> Column:
    return F.length(summary) <= F.lit(ratio) * F.length(text)


def net_tokens_saved(text: Column, summary: Column) -> Column:
    return tokens_of(F.length(text) - F.length(summary))


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | c.contains(n)
    return found


def is_prompt(c: Column) -> Column:
    """The text ends in a short line waiting for an answer, or its tail asks one."""
    def ends_waiting(r: Column) -> Column:
        last_line = F.substring_index(r, "\n", -1)
        return F.right(r, F.lit(1)).isin(*PROMPT_ENDINGS) & (F.length(last_line) <= PROMPT_LINE)

    def near_end(tail: Column) -> Column:
        # The tail decides unless it is almost all white space.
        enough = F.length(tail) < 2 * PROMPT_TAIL
        return bind(
            rstrip(tail),
            lambda r: F.when(enough | (F.length(r) > PROMPT_LINE), ends_waiting(r)).otherwise(
                ends_waiting(rstrip(c))
            ),
        )

    waiting = bind(F.right(c, F.lit(2 * PROMPT_TAIL)), near_end)
    return waiting | bind(F.right(c, F.lit(PROMPT_TAIL)), lambda t: contains_any(t, PROMPT_TOKENS))


def chunk_is_prompt(b: Column) -> Column:
    """One of the prompt tokens lies in the last bytes of a chunk."""
    tail = F.substring(b, -PROMPT_TAIL, PROMPT_TAIL)
    found = F.lit(False)
    for t in PROMPT_TOKENS:
        found = found | F.contains(tail, F.lit(t.encode()))
    return found


def compression_ratio(before: Column, after: Column) -> Column:
    return (before - after) / before


def archive_cap(was_pruned: Column, n_bytes: Column, cap: int | None) -> Column:
    """Keep pruned entries always, others only up to ``cap`` bytes."""
    return F.lit(True) if cap is None else was_pruned | (n_bytes <= cap)
