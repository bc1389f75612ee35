"""Streams that are stopped, lost and resumed."""

import pytest
from pyspark.sql import functions as F

from evisynth.streaming import runs as V

SCHEMA = "id long, key string, abstract string"


def _put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def _table(spark, folder):
    return sorted((r["id"], r["key"]) for r in spark.read.schema(SCHEMA).parquet(str(folder)).collect())


def test_additive_resumes(spark, tmp_path):
    """A second run goes on where the first stopped; keys of earlier batches stay out, and so do records without an abstract."""
    src, out, state = (tmp_path / n for n in ("in", "out", "state"))

    def run(broken=None):
        like = spark.createDataFrame([], SCHEMA)
        stream = V.source(spark, str(src), like)
        if broken:
            stream = stream.withColumn("key", F.when(F.col("key") == broken, F.raise_error(F.lit("lost"))).otherwise(F.col("key")))
        V.additive(stream, "key", "id", str(out), str(state), F.col("abstract") != "").awaitTermination()

    _put(spark, src, [(3, "a", "x"), (2, "a", "x"), (1, "a", ""), (4, "b", "x"), (5, None, "x"), (6, None, "x")])
    run()
    assert _table(spark, out) == [(2, "a"), (4, "b"), (5, None)]
    run()
    assert _table(spark, out) == [(2, "a"), (4, "b"), (5, None)]
    _put(spark, src, [(0, "a", "x"), (7, "c", "x"), (8, "d", "x")])
    with pytest.raises(Exception, match="lost"):
        run(broken="d")
    assert _table(spark, out) == [(2, "a"), (4, "b"), (5, None)]
    run()
    assert _table(spark, out) == [(2, "a"), (4, "b"), (5, None), (7, "c"), (8, "d")]


def test_until_stops_at_a_small_yield():
    found = [9, 5, 1, 7]
    assert V.until(lambda i: found[i - 1], 4, 2) == 3 and V.until(lambda i: found[i - 1], 2, 2) == 2


def test_drain(spark, tmp_path):
    _put(spark, tmp_path / "in", [(1, "a", "x")])
    V.drain(V.source(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert _table(spark, tmp_path / "out") == [(1, "a")]
