"""A corpus pipeline over documents: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes what the one before has kept, written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisynth import session
from evisynth.llm import mixing, near_dups, packing, quality, secrets
from evisynth.llm.common import table, written

TOKENIZER = "word_bpe_49k.json"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules or the cascade reject go: null and empty texts too, as they are short. Rows without an id, repeated rows and very long texts are judged like others; an empty table stays empty."""
    session.ship(spark)
    return quality.keep_good(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more. Rows without words stay, and one of equal rows; ids that stand for several texts join nothing; an empty table stays empty."""
    session.ship(spark)
    return near_dups.one_of_each(docs, percent=80)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mask; n_chars follows. Null and empty texts stay as they are; rows without an id, repeated rows and very long texts are scanned whole; an empty table stays empty."""
    found = secrets.found_secrets(docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc")))
    hit = F.size("secrets") > 0
    rows = found.withColumn("masked", F.when(hit, secrets.masked(F.col("text"), F.col("secrets"))))
    fresh = {"text": F.coalesce("masked", "text"), "n_chars": F.coalesce(F.char_length("masked").cast("bigint"), "doc.n_chars")}
    return rows.select(*(fresh.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its target of words: whole documents, repeated where the mix takes more, and parts of documents. Rows without words give nothing; rows without an id or a source take part; an empty table stays empty."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, sequence and offset. A null text is one end id; rows without an id, repeated rows and very long texts are packed like others; an empty table gives no rows."""
    session.ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [("quality rules", good), ("near duplicates", unlike), ("secrets", masked), ("mixing", mixed), ("packing", packed)]
#: SQL has neither the tokenizer nor the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
