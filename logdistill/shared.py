"""Tables written to the cluster's shared folder between jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may do without it, and gets a folder that goes when it
    ends: one machine's folder is of no use to the executors of a cluster.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_DIR, None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="logdistill-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """Hadoop's file system of ``path``, and the path in its terms."""
    sc = spark.sparkContext
    there = sc._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(sc._jsc.hadoopConfiguration()), there


def create_once(spark: SparkSession, path: str) -> bool:
    """Create an empty file, or return False if it exists: one of many writers wins.

    Needs a file system with exclusive creation, as local disks and HDFS have.
    """
    fs, there = file_system(spark, path)
    try:
        if fs.getScheme() == "file":  # Hadoop's own local create looks first and writes then
            fs.mkdirs(there.getParent())
            open(there.toUri().getPath(), "x").close()
        else:
            fs.create(there, False).close()
    except FileExistsError:
        return False
    except Py4JJavaError:
        if fs.exists(there):
            return False
        raise
    return True


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder; none if there is no such folder."""
    fs, there = file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(there)] if fs.exists(there) else []


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of the shared folder that goes when the block ends."""
    path = fresh_path(spark, name)
    try:
        yield path
    finally:
        fs, there = file_system(spark, path)
        fs.delete(there, True)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write once, read back: a computed table that several plans share."""
    spark = df.sparkSession
    path = f"{folder}/{name}" if folder else fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
