"""The registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shared import fresh_path
from . import minhash, mixing, periods, pyp, quality, repeats, secrets, simhash, spelling, templates, tokens, urls, warc

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op6_quality_rules(spark, sf):
    return quality.report(table(spark, sf, "documents"))


@query
def op8_secret_scan(spark, sf):
    return secrets.report(table(spark, sf, "documents"))


@query
def op1_url_filter(spark, sf):
    return urls.report(table(spark, sf, "pages"))


@query
def op5_mixing(spark, sf):
    return mixing.report(table(spark, sf, "documents"))


@query
def op10_warc_archive(spark, sf):
    """The pages as records of an archive, read back from its header and payload tables."""
    path = fresh_path(spark, "warc")
    warc.write_archive(table(spark, sf, "pages"), path)
    return warc.read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op9_repeated_passages(spark, sf):
    return repeats.report(table(spark, sf, "documents"))


@query
def op7_simhash_dedup(spark, sf):
    return simhash.report(table(spark, sf, "documents"))


@query
def op3_edited_token_counts(spark, sf):
    return tokens.report(table(spark, sf, "documents"))


@query
def op4_benchmark_templates(spark, sf):
    return templates.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op2_pitman_yor_scores(spark, sf):
    return pyp.scores(table(spark, sf, "documents"))


@query
def op13_periodic_runs(spark, sf):
    return periods.report(periods.looped(table(spark, sf, "documents")))


@query
def op12_minhash_dedup(spark, sf):
    return minhash.report(table(spark, sf, "documents"))


@query
def op11_spelling_variants(spark, sf):
    return spelling.report(table(spark, sf, "documents"))
