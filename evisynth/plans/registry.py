"""Queries by name, with the SQL that gives the same rows, and the views of the tables that they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL for column t with character references resolved.
UNESCAPED = "t"
for _name, _plain in T.ENTITIES.items():
    UNESCAPED = f"replace({UNESCAPED}, '{_name}', {'chr(39)' if _plain == chr(39) else repr(_plain) if _plain.isascii() else f'chr({ord(_plain)})'})"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as bibliographic records: the title is the text up to its first full stop."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.trim(F.split_part("text", F.lit("."), F.lit(1))).alias("title"),
        F.col("text").alias("abstract"),
        "source",
        (1990 + F.col("doc_id") % 30).cast("int").alias("year"),
        F.col("n_chars").alias("citations"),
    )


PAPERS = """papers AS (SELECT doc_id AS ord, trim(split_part(text, '.', 1)) AS title, text AS abstract, source,
  CAST(1990 + doc_id % 30 AS INT) AS year, n_chars AS citations FROM documents)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as scored claims: two raters' scores from 0 to 5 and whether the claim supports."""
    scores = [F.col(c).cast("int") % 6 for c in ("l_quantity", "l_extendedprice")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", scores[0].alias("a"), scores[1].alias("b"))


CLAIMS = """claims AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey, CAST(trunc(l_quantity) AS INT) % 6 AS a, CAST(trunc(l_extendedprice) AS INT) % 6 AS b FROM lineitem)"""


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as study effects: a study is a supplier under a condition (return flag), its effect the mean discount."""
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("study"), F.col("l_returnflag").alias("condition"))
    return by.agg(F.avg("l_discount").alias("y"), (F.var_samp("l_discount") / F.count("*")).alias("v"), F.count("*").alias("n")).where("n > 2 AND v > 0")


EFFECTS = """effects AS (SELECT l_suppkey AS study, l_returnflag AS condition, avg(l_discount) AS y, var_samp(l_discount) / count(*) AS v, count(*) AS n
  FROM lineitem GROUP BY ALL HAVING count(*) > 2 AND var_samp(l_discount) > 0)"""
