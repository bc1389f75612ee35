"""Token counts of whole texts by a two-tier lookup on the map side: no pre-token is shuffled for counting.

Pre-tokens are looked up in chunks, the runs between white space (cut as tokens.py says), which are one pre-token or a
few. Tier one is a compact table of frequent chunks and their numbers of tokens, made from a bounded sample and
broadcast once; `frequent` and the greatest length bound its size. Tier two is each worker's own cache of encoded misses.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, table
from .tokens import ChunkEncoder

#: Chunks in the broadcast table, their greatest length in bytes, rows that it is made from (about), the seed of their choice.
FREQUENT, LONGEST, SAMPLE, SEED = 1 << 16, 64, 20_000, 42
#: Chunks that a task counts at a time.
COUNTED = 1 << 18


def frequent_chunks(docs: DataFrame, text: str = "text", most: int = FREQUENT, sample: int = SAMPLE, seed: int = SEED) -> list[bytes]:
    """The chunks of up to LONGEST bytes that occur most often in about `sample` of the rows, at most `most`.

    A chunk that is left out costs time, never a wrong count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["chunk", "n"])

        for batch in batches:
            for t in bytes_of(batch.column(0)):
                seen.update(c for c in t.split() if len(c) <= LONGEST)
                if len(seen) > COUNTED:
                    yield rows()
                    seen.clear()
        yield rows()

    share = min(1.0, sample / max(docs.count(), 1))
    picked = docs.select(text).sample(False, share, seed) if share < 1 else docs.select(text)
    found = picked.mapInArrow(count, "chunk binary, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))
    return [bytes(r["chunk"]) for r in found.orderBy(F.desc("n"), "chunk").limit(most).collect()]


def _packed(encoder: ChunkEncoder, chunks: list[bytes]) -> tuple[bytes, bytes]:
    """Chunks joined by line ends, which no chunk holds, and a byte for each length; longer ones are left to the workers."""
    lengths = encoder.encode(chunks)
    fit = [(c, n) for c, n in zip(chunks, lengths, strict=True) if n < 256]
    return b"\n".join(c for c, _ in fit), bytes(n for _, n in fit)


@functools.lru_cache(maxsize=2)
def _encoder(path: str, chunks: bytes, lengths: bytes) -> ChunkEncoder:
    return ChunkEncoder(path, lengths_only=True, frequent=dict(zip(chunks.split(b"\n"), lengths, strict=True)) if lengths else None)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """One row for each row of docs: id_col, n_bytes (UTF-8), n_tokens as the tokenizers file at `path` gives them without added special tokens, over_limit.

    A null text counts as empty: no bytes, no tokens. Very long texts are counted whole. Null and repeated ids stay, each
    with its own row; an empty table gives no rows; other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    first = ChunkEncoder(path, lengths_only=True)
    shared = spark.sparkContext.broadcast(_packed(first, frequent_chunks(chosen, "text", frequent)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, *shared.value)
        for batch in batches:
            texts = bytes_of(batch.column(1))
            n = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return chosen.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("doc_id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
