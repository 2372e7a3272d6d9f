"""Words, rows and folded sums that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind

WORD = r"[^\x20\x09-\x0D]+"


def packed(docs: DataFrame, **needed: Column) -> DataFrame:
    """The input row as one struct ``row``, next to the columns an operator needs.

    Whatever else the input holds, and however it is called, cannot clash with
    a name the operator uses inside.
    """
    return docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in needed.items()])


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(id_: str = "doc_id", text: str = "text") -> Column:
    """32 bytes that tell rows apart by id and text, null ids too; exact copies share them."""
    id_text = F.coalesce(F.col(id_).cast("bigint").cast("string"), F.lit("null"))
    return F.unhex(F.sha2(F.concat(id_text, F.lit(":"), text_of(text)), 256))


def other_columns(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> Column:
    """What a row holds besides id and text, as JSON: orders rows that agree in both."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_, text)]
    return F.to_json(F.struct(*rest)) if rest else F.lit("")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_sums(values: Column, block: int = 256) -> Column:
    """Sums of the values before each element, then of all: n + 1 longs.

    Sums are folded within blocks and over block totals, so a long array costs
    far less than one fold whose result is copied for each element.
    """

    def folded(arr: Column, start: Column) -> Column:
        return F.aggregate(
            arr,
            F.array(start.cast("bigint")),
            lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.cast("bigint"))),
        )

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint"))

    def by_block(arr: Column) -> Column:
        n = F.ceil(F.size(arr) / F.lit(block)).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda b: F.slice(arr, b * block + 1, F.lit(block)),
        )
        return bind(
            blocks,
            lambda bs: bind(
                folded(F.transform(bs, total), F.lit(0)),
                lambda at: F.concat(
                    F.flatten(
                        F.transform(
                            bs,
                            lambda b, i: bind(
                                folded(b, F.get(at, i)),
                                lambda s: F.slice(s, F.lit(1), F.size(s) - 1),
                            ),
                        )
                    ),
                    F.array(F.element_at(at, -1)),
                ),
            ),
        )

    return bind(values, by_block)
