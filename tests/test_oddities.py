"""Queries whose rows differed from their SQL on odd letters, blanks, orders of files or large groups."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evisynth.functions import text as T
from evisynth.operators import scoring as S

from .test_queries import plain

TEXTS = [
    "Aquel noñra citam la failé que", "the keitÄß. Erst und die ungß er", "that İSTANBUL is not here; supporté", "zzzz",
    " 　", "  keit lackß und  ", "the\x0bque ΑΣ ΣΣ and nó more", "İİ that is ᾀﬁ ŉe",
    "and confirmís que no.", "no İİİ zzzz", " never ", "consistent  with\tthe\n that",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables of odd texts, the documents in files whose later ones hold the lower ids."""
    d = tmp_path_factory.mktemp("odd")
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t)) for i, t in enumerate(TEXTS * 3)]
    for part in (rows[24:], rows[12:24], rows[:12]):
        spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, len(rows), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.range(1, 401).select(F.col("id").alias("c_custkey"), F.lit("AUTO").alias("c_mktsegment"), F.lit(3).alias("c_nationkey")).write.parquet(f"{d}/customer.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["j01_evidence_links", "a06_alignment", "a27_caveats", "a27_cluster_support", "f22_quote_spans", "v01_additive_corpus", "w07_s21_citation_keys", "f19_span_audit", "j15_seed_match"])
def test_as_sql(spark, odd, name):
    got = entry.queries()[name](spark, odd).toPandas()
    con = duckdb.connect()
    for t in ("documents", "customer", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    pd.testing.assert_frame_equal(plain(got), plain(con.sql(entry.oracle_sql()[name]).df()))


def test_letters_as_duckdb(spark):
    """Case and blanks of every letter of the first plane, but of those that DuckDB's older tables leave out."""
    rows = spark.range(1, 0x10000).where("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32").alias("c"))
    a = F.concat(F.lit("a"), "c", F.lit("a"))
    got = {r[0]: tuple(r)[1:] for r in rows.select("id", T.lower(a), T.upper(a), T.trimmed(F.col("c"))).collect()}
    want = {r[0]: r[1:] for r in duckdb.sql("SELECT i, lower('a' || chr(i::INT) || 'a'), upper('a' || chr(i::INT) || 'a'), trim(chr(i::INT)) FROM range(1, 65536) r(i) WHERE i NOT BETWEEN 55296 AND 57343").fetchall()}
    assert {hex(i) for i in want if got[i] != want[i]} <= {hex(i) for i in (0x19B, 0x264, 0x1C89, 0x1C8A, 0xA7CB, 0xA7CC, 0xA7CD, 0xA7DA, 0xA7DB, 0xA7DC)}


def test_span_audit_in_place(spark):
    """A row's similarities need no other row: terms were exploded and shuffled."""
    rows = spark.createDataFrame([(1, "the cat", "the cat and the dog"), (2, " ", "x"), (3, "", "x"), (4, "zz", "yy"), (5, None, "x")], "id long, s string, t string")
    got = S.audit_spans(rows, ["id"], "s", "t")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["id"], round(r["token_similarity"], 6), round(r["tfidf_similarity"], 6), r["priority"]) for r in got.orderBy("id").collect()] == [(1, 0.5, 0.709053, "P3"), (2, 0.0, 0.0, "P1"), (4, 0.0, 0.0, "P1")]


def test_seed_match_of_repeated_ids(spark, tmp_path, odd):
    """An id that stands for several papers is still a pair once; pairs of a hot key are made in many tasks."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    docs.union(docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("x"), "text"))).union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{odd}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = entry.queries()["j15_seed_match"](spark, str(tmp_path)).toPandas()
    pd.testing.assert_frame_equal(plain(got), plain(con.sql(entry.oracle_sql()["j15_seed_match"]).df()))


def test_seed_match_deals_out_a_hot_key(spark, tmp_path):
    """The pairs of one key's papers were made in one task, and grouped again."""
    spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("one same title "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = entry.queries()["j15_seed_match"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
        assert "Aggregate" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 100 * 299 and rows.select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
