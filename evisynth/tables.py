"""Tables between steps: the folder that all executors share, tables written there, places and sums over a whole order, joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Places in which a row of the smaller side of a salted join stands.
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or in local mode a new temporary one; an error on clusters that name none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return made


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so lost executors cost no recomputation and later jobs read it again cheaply."""
    spark = df.sparkSession
    df.write.parquet(path := new_folder(spark, tag))
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """df, written, with `_range`: the number of the range of the order that a row lies in."""
    spark = df.sparkSession
    n = partitions(spark, spark.sparkContext.defaultParallelism)
    return written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """df with `rank` (from 0) in a total order of all its rows, and for each name in sums the sum of that column over all rows before.

    Ranges of the order are dealt out and written; only a row a range is ordered in one task."""
    rows = in_ranges(df, order)
    wanted = {"rank": F.count(F.lit(1)), **{name: F.sum(c) for name, c in (sums or {}).items()}}
    totals = rows.groupBy("_range").agg(*(x.alias(f"_{name}") for name, x in wanted.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in wanted))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = {name: F.col(f"_{name}") + F.coalesce(x.over(inside), F.lit(0)) for name, x in wanted.items()}
    return rows.join(totals, "_range").withColumns(at).drop("_range", *(f"_{name}" for name in wanted))


def ranked_in_groups(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """df with `rank` (from 0) of each row in its group, by ranges of the order of all rows: a hot group's rows lie in many tasks. Nulls are a group."""
    rows = written(running(df, [c for g in group for c in (F.col(g).isNotNull(), F.col(g))] + order), "ranked")
    first = rows.groupBy(*group).agg(F.min("rank").alias("_first")).select(*(F.col(g).alias(f"_{g}") for g in group), "_first")
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    return rows.join(first, same).withColumn("rank", F.col("rank") - F.col("_first")).drop("_first", *(f"_{g}" for g in group))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """left joined to right, which has a row a key: each of right's rows meets left's rows in SALTS places, so no key of left meets in one task."""
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [key, "_salt"]).drop("_salt")
