"""Tables of lines, blocks and frames behind the summaries.

All are exploded from arrays computed inside the entry's row, so none of them
shuffles however long one entry or how common one line is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect, summaries, text
from ..functions.arrays import bind, occurrences
from ..functions.steps import with_once


def line_table(df: DataFrame, keys: Sequence[str], col: str = "raw_content") -> DataFrame:
    """One row per line: ``pos`` counts from 0."""
    return df.select(*keys, F.posexplode(text.split_lines(F.col(col))).alias("pos", "line"))


def _counts(c: Column) -> Column:
    return bind(text.content_lines(text.split_lines(c)), occurrences)


def line_frequency(df: DataFrame, keys: Sequence[str], col: str = "raw_content") -> DataFrame:
    """Count and first position of every stripped non-blank line of an entry."""
    return df.select(*keys, F.explode(_counts(F.col(col))).alias("c")).select(
        *keys,
        F.col("c.key").alias("line"),
        F.col("c.n").alias("n"),
        F.col("c.first").alias("first_pos"),
    )


def top_k_lines(
    df: DataFrame, keys: Sequence[str], k: int = summaries.FLOOD_ROWS, col: str = "raw_content"
) -> DataFrame:
    """The k commonest lines of an entry; ties keep first-seen order."""
    top = bind(_counts(F.col(col)), lambda c: summaries.top_lines(c, k))
    return df.select(*keys, F.posexplode(top).alias("i", "c")).select(
        *keys,
        (F.col("i") + 1).alias("rank"),
        F.col("c.key").alias("line"),
        F.col("c.n").alias("n"),
    )


def first_seen(df: DataFrame, keys: Sequence[str], col: str = "raw_content") -> DataFrame:
    """Distinct lines of an entry in the order they first appear."""
    lines = F.array_distinct(text.split_lines(F.col(col)))
    return df.select(*keys, F.posexplode(lines).alias("ord", "line"))


def _with_blocks(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    clean = with_once(df.select(*keys, col), "_t", text.strip_ansi(F.col(col)))
    both = bind(
        text.split_lines(F.col("_t")),
        lambda ls: F.struct(
            ls.alias("lines"), summaries.traceback_blocks(ls).alias("blocks")
        ),
    )
    found = clean.where(detect.is_traceback(F.col("_t")))
    return with_once(found, "_b", both).select(*keys, "_b")


def traceback_blocks(
    df: DataFrame, keys: Sequence[str], col: str = "raw_content", frames: int = 3
) -> DataFrame:
    """One row per traceback block, numbered from 1."""
    exploded = _with_blocks(df, keys, col).select(
        *keys,
        F.size("_b.blocks").alias("n_blocks"),
        F.posexplode("_b.blocks").alias("i", "b"),
    )
    return exploded.select(
        *keys,
        (F.col("i") + 1).alias("block_no"),
        "n_blocks",
        F.col("b.start").alias("start_pos"),
        F.col("b.end").alias("exception_pos"),
        F.size("b.frames").alias("n_frames"),
        F.array_join(summaries.deepest_user_frames(F.col("b.frames"), frames), "|").alias("kept"),
        F.col("b.exception").alias("exception"),
    )


def traceback_frames(
    df: DataFrame, keys: Sequence[str], col: str = "raw_content"
) -> DataFrame:
    """One row per frame of every block."""
    blocks = _with_blocks(df, keys, col).select(*keys, F.posexplode("_b.blocks").alias("i", "b"))
    frames = blocks.select(
        *keys, (F.col("i") + 1).alias("block_no"), F.posexplode("b.frames").alias("j", "frame")
    )
    return frames.select(
        *keys,
        "block_no",
        (F.col("j") + 1).alias("frame_no"),
        "frame",
        detect.is_library_frame(F.col("frame")).alias("is_library"),
    )


def context_parts(
    df: DataFrame, keys: Sequence[str], col: str = "raw_content"
) -> DataFrame:
    """What surrounds the tracebacks of an entry, condensed."""
    lines, blocks = F.col("_b.lines"), F.col("_b.blocks")
    around = F.transform(
        F.array(summaries.preamble(lines, blocks), summaries.postamble(lines, blocks)),
        summaries.condense_context,
    )
    return with_once(_with_blocks(df, keys, col), "_a", around).select(
        *keys,
        F.get("_a", F.lit(0)).alias("preamble"),
        F.get("_a", F.lit(1)).alias("postamble"),
    )
