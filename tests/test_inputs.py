from pyspark.sql import functions as F

from logdistill.plans import inputs, queries
from logdistill.sources import tables


def orders(spark, path, n):
    rows = spark.range(n).select(
        F.when(F.col("id") % 1000 != 7, F.col("id")).alias("o_orderkey"),
        (F.col("id") % 11).alias("o_custkey"),
        F.lit("O").alias("o_orderstatus"),
        F.lit("1-URGENT").alias("o_orderpriority"),
    )
    rows.union(rows.limit(5)).coalesce(1).write.parquet(f"{path}/orders.parquet")
    return spark.read.parquet(f"{path}/orders.parquet")


def test_small_files_of_many_rows_are_dealt(spark, tmp_path):
    n = 3 * tables.TASK_ROWS
    stored = orders(spark, tmp_path, n)
    logs = inputs.logs(spark, str(tmp_path))
    sizes = [r[0] for r in logs.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 4 and max(sizes) <= tables.TASK_ROWS and sum(sizes) == n + 5
    got = logs.groupBy("id").count()
    assert got.exceptAll(stored.groupBy(F.col("o_orderkey").alias("id")).count()).isEmpty()
    few = tables.dealt(stored.limit(10))
    assert few.count() == 10


def test_items_of_the_json_report_are_pruned_once(spark, tmp_path, monkeypatch):
    orders(spark, tmp_path, 60)
    pruned = []
    real = queries.written

    def seen(df, name, *more):
        pruned.append(name)
        return real(df, name, *more)

    monkeypatch.setattr(queries, "written", seen)
    made = queries.REGISTRY["json_report"](spark, str(tmp_path))
    assert pruned == ["items"]
    assert sum(r["n_items"] for r in made.collect()) == 64  # a log without a key is of no suite
