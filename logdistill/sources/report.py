"""Machine-readable reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(
    report: DataFrame, items: DataFrame, path: str, whole: DataFrame | None = None
) -> None:
    """JSON lines: one object per suite, its items in a folder keyed by suite."""
    report.write.mode("overwrite").json(f"{path}/suites")
    items.write.mode("overwrite").partitionBy("suite").json(f"{path}/items")
    if whole is not None:
        whole.write.mode("overwrite").json(f"{path}/summary")
