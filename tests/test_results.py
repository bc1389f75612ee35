"""Results read text by text: dealt out over tasks, and as plain expressions would read them."""

import re

from pyspark.sql import functions as F

from evisynth.operators import extract as X

from .test_extract import one

TEXT = "Cohen's d = 0.5; t(3) = 2. 5 and F(1, 2) = 3, chi-square (4) = 6, χ²(1) = 2, zr = 4, z = −1.9, p<.05. A b c vs d e versus f g h vs. k l m compared to n o, N = 12, 30 mice 2001 rats, 95% CI [1, 2], g = 3."


def test_one_file_is_dealt_out(spark):
    """All texts of a file of one row group were read in one task."""
    df = spark.range(400).select("id", F.lit("as t(3) = 2.5").alias("text")).coalesce(1)
    for rows in (X.results(df, "id", "text"), X.review_flags(df, "id", "text")):
        got = rows.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(got) >= 4


def test_only_some_columns(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id long, text string")
    every = X.results(df, "id", "text").select("id", "test", "p_values").collect()
    assert sorted(map(str, every)) == sorted(map(str, X.results(df, "id", "text", ["test", "p_values"]).collect())) and len(every) > 5


def test_readers_as_expressions(spark):
    """Looking only where a sign or a comparing word is finds what looking all over finds."""
    signs = X._signs(TEXT)
    for _, pattern, words in X._TESTS:
        assert [m.span() for m in X._matches_at(pattern, TEXT, words, signs)] == [m.span() for m in pattern.finditer(TEXT)]
    every = [f"{m[1].strip()} vs {m[2].strip()}" for m in re.finditer(X.COMPARISON, TEXT)]
    assert X._read_comparisons(TEXT) == [c for c in every if len(c) <= 100][:3]
    r = one(spark, TEXT, X.test_spans(F.col("text")).alias("t"), X.comparisons(F.col("text")).alias("c"), X.subjects(F.col("text")).alias("s"), X.effect_sizes(F.col("text")).alias("e"), X.intervals(F.col("text")).alias("i"))
    assert [(n, *m.span()) for n, m in X._read_tests(TEXT, signs)] == [(t["test"], t["start"], t["end"]) for t in r["t"]]
    assert X._read_comparisons(TEXT) == r["c"] and X._read_subjects(TEXT, signs) == [s.asDict() for s in r["s"]]
    assert X._read_effects(TEXT, signs) == [e.asDict() for e in r["e"]] and X._read_intervals(TEXT) == [i.asDict() for i in r["i"]]
