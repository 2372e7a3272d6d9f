"""Readers of the archive, of chunk tables and of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import decode_bytes, line_count
from ..shared import file_names


def read_entries(
    spark: SparkSession, path: str, with_commit: bool = False, deleted: bool = False
) -> DataFrame:
    """The entry table; its schema is fixed, so no file is opened to infer one.

    Deleted entries are left out unless ``deleted`` asks for them too.
    """
    schema = schemas.ENTRY + (", commit STRING" if with_commit else "")
    df = spark.read.schema(schema).parquet(f"{path}/entries")
    if not deleted:
        df = without_deleted(df, path)
    return df if with_commit else df.select(*[f.split()[0] for f in schemas.ENTRY.split(", ")])


def without_deleted(df: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Rows of an archive's table whose entry ``key`` has not been deleted there."""
    return _without(df, f"{path}/deleted", "id BIGINT", key)


def _without(df: DataFrame, noted: str, schema: str, key: str) -> DataFrame:
    spark = df.sparkSession
    if not file_names(spark, noted):
        return df
    gone = spark.read.schema(schema + ", commit STRING").parquet(noted).drop("commit").distinct()
    return df.join(gone, df[key] == gone[gone.columns[0]], "left_anti")


def without_deleted_sessions(df: DataFrame, path: str) -> DataFrame:
    """Rows of an archive's table whose session has not been deleted there."""
    return _without(df, f"{path}/deleted_sessions", "session_id STRING", "session_id")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The session table without deleted sessions."""
    stored = spark.read.schema(schemas.SESSION + ", commit STRING").parquet(f"{path}/sessions")
    return without_deleted_sessions(stored.drop("commit"), path)


def read_session_log(spark: SparkSession, path: str) -> DataFrame:
    """The session log without the events of deleted sessions."""
    log = spark.read.schema(schemas.SESSION_EVENT + ", commit STRING").parquet(f"{path}/session_log")
    return without_deleted_sessions(log.drop("commit"), path)


def decode_output(df: DataFrame, col: str = "data", out: str = "text") -> DataFrame:
    """Bytes to text: UTF-8, or latin-1 for a value that is not valid UTF-8."""
    return df.withColumn(out, decode_bytes(F.col(col)))


def describe_files(files: DataFrame) -> DataFrame:
    """Adds content hash and line count to ``files(path, content)``."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(
        "path",
        "content",
        F.lit("python").alias("language"),
        F.substring(F.sha2("content", 256), 1, 16).alias("file_hash"),
        line_count(text).alias("line_count"),
    )


def read_source_files(spark: SparkSession, path: str, glob: str = "*.py") -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return describe_files(files)


#: Partitions to deal the input tables to; unset, they are read as they lie.
INPUT_PARTITIONS = "spark.logdistill.input.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal a table anew if the session asks for it, whatever the table's size.

    Meant for one machine whose tables are single files. On a cluster a table has
    many splits: leave ``INPUT_PARTITIONS`` unset and no text is shuffled.
    """
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


#: Rows of a narrow table that one task makes long texts of.
TASK_ROWS = 20_000


def dealt(df: DataFrame) -> DataFrame:
    """Deal a table of short rows, each to become a long text, by its number of rows.

    Splits follow the bytes of the files, and a file of a few MB, one split or two,
    may stand for gigabytes of text. Its short rows cost little to shuffle, before
    any text is made. ``INPUT_PARTITIONS`` sets another number.
    """
    if df.sparkSession.conf.get(INPUT_PARTITIONS, None):
        return spread(df)
    n = -(-df.count() // TASK_ROWS)
    return df.repartition(n) if n > 1 else df
