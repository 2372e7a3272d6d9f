"""The Porter stemmer (Porter 1980) over one token, as a Column expression.

The published algorithm, applied as full-text indexes do: only to tokens of 3 to
64 bytes, with every byte that is no ASCII vowel counting as a consonant.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind

# --- fixed values -----------------------------------------------------------
# Consonant and vowel runs; y is a vowel after a consonant. The possessive
# quantifiers leave exactly one way to read a word.
_C = r"(?:[^aeiou][^aeiouy]*+)"
_V = r"(?:[aeiouy][aeiou]*+)"
HAS_VOWEL = rf"^{_C}?+[aeiouy]"
MEASURE_1_UP = rf"^{_C}?+{_V}[^aeiou]"
MEASURE_2_UP = rf"^{_C}?+{_V}{_C}{_V}[^aeiou]"
SHORT = rf"^{_C}[aeiouy][\x00-\x7f&&[^aeiouwxy]]$"
DOUBLED = r"([\x00-\x7f&&[^aeioulsz]])\1$"
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
MIN_BYTES, MAX_BYTES = 3, 64
# Every rule keeps what stands before the suffix and at least all but two
# letters of what it puts in its place.
MAX_REWRITTEN = 2
# ----------------------------------------------------------------------------


def _drop(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _suffix(w: Column, suffixes: Iterable[str]) -> Column:
    """The longest of ``suffixes`` that ends the word, or null."""
    found = F.when(F.lit(False), "")
    for s in sorted(suffixes, key=len, reverse=True):
        found = found.when(w.endswith(s), s)
    return found


def _replace(w: Column, suffixes: dict[str, str], measure: str) -> Column:
    """Replace the longest of ``suffixes`` if the rest has the measure."""
    table = F.create_map(*[F.lit(x) for pair in suffixes.items() for x in pair])

    def apply(suffix: Column) -> Column:
        stem = F.substring(w, F.lit(1), F.length(w) - F.length(suffix))
        fits = suffix.isNotNull() & stem.rlike(measure)
        return F.when(fits, F.concat(stem, F.element_at(table, suffix))).otherwise(w)

    return bind(_suffix(w, suffixes), apply)


def _plural(w: Column) -> Column:
    return (
        F.when(w.endswith("sses") & (F.length(w) > 4), _drop(w, 2))
        .when(w.endswith("ies") & (F.length(w) > 3), _drop(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss"), _drop(w, 1))
        .otherwise(w)
    )


def _tidy(w: Column) -> Column:
    """After -ed or -ing went: restore an e or undouble a consonant."""
    return (
        F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e")))
        .when(w.rlike(DOUBLED), _drop(w, 1))
        .when(w.rlike(SHORT), F.concat(w, F.lit("e")))
        .otherwise(w)
    )


def _past(w: Column) -> Column:
    long_enough = F.length(w) > 3
    return (
        F.when(
            w.endswith("eed") & long_enough,
            F.when(_drop(w, 3).rlike(MEASURE_1_UP), _drop(w, 1)).otherwise(w),
        )
        .when(w.endswith("ed") & _drop(w, 2).rlike(HAS_VOWEL), bind(_drop(w, 2), _tidy))
        .when(
            w.endswith("ing") & long_enough & _drop(w, 3).rlike(HAS_VOWEL),
            bind(_drop(w, 3), _tidy),
        )
        .otherwise(w)
    )


def _final_y(w: Column) -> Column:
    return F.when(
        w.endswith("y") & _drop(w, 1).rlike(HAS_VOWEL), F.concat(_drop(w, 1), F.lit("i"))
    ).otherwise(w)


def _bare(w: Column) -> Column:
    """Drop a suffix of step 4; -ion only behind s or t."""
    def apply(suffix: Column) -> Column:
        stem = F.substring(w, F.lit(1), F.length(w) - F.length(suffix))
        fits = suffix.isNotNull() & ((suffix != "ion") | stem.endswith("s") | stem.endswith("t"))
        return F.when(fits & stem.rlike(MEASURE_2_UP), stem).otherwise(w)

    return bind(_suffix(w, STEP_4), apply)


def _final_e(w: Column) -> Column:
    stem = _drop(w, 1)
    short_enough = stem.rlike(MEASURE_1_UP) & ~stem.rlike(SHORT)
    return F.when(
        w.endswith("e") & (stem.rlike(MEASURE_2_UP) | short_enough), stem
    ).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & _drop(w, 1).rlike(MEASURE_2_UP), _drop(w, 1)).otherwise(w)


def porter(token: Column) -> Column:
    """Stem of a lower-case token."""
    steps = (
        _plural,
        _past,
        _final_y,
        lambda w: _replace(w, STEP_2, MEASURE_1_UP),
        lambda w: _replace(w, STEP_3, MEASURE_1_UP),
        _bare,
        _final_e,
        _final_l,
    )

    def through(w: Column, rest: tuple) -> Column:
        return w if not rest else bind(rest[0](w), lambda x: through(x, rest[1:]))

    return bind(
        token,
        lambda t: F.when(
            F.octet_length(t).between(MIN_BYTES, MAX_BYTES), through(t, steps)
        ).otherwise(t),
    )
