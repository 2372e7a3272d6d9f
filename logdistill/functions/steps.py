"""Steps between projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is evaluated once per row whatever follows.

    Filters on a plain computed column are pushed below it, and its fields are
    taken apart below it, each with a copy of the whole expression. Exploding a
    one-element array is a narrow step that neither happens across.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
