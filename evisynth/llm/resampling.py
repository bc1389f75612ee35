"""Importance resampling towards a target: log-ratio weights from hashed features, perturbed scores, and the best of them
by a distributed quickselect.

Features fall into a fixed number of buckets, so the corpus and the target are two arrays of counts however large they
are, and so is the gain that each bucket is worth; every document is scored by looking its buckets up in that array. The
draw needs the k-th of all composite keys (score, id, content, place): random keys of the range still open are the pivots,
one pass counts the rows below, at and above each, and the range between two pivots that holds the k-th stays open. Only
counts and pivots reach the driver. Rows at or above the k-th key are the winners, and only those are sorted and ranked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, running, slices, table, written

BUCKETS = 10_000
#: Pivots of a round, about; a range of at most twice as many rows is settled by its own keys.
PIVOTS = 32
#: Bytes of text that a worker splits at once, and features whose buckets it keeps.
GROUP_BYTES, KEPT = 1 << 22, 300_000
#: A-Z become a-z; a-z, 0-9 and all bytes of other letters stay; the others part words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Buckets(dict):
    """The bucket of each feature, computed once; emptied when full."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def _features(text: bytes, most: int) -> tuple[int, list[bytes]]:
    """The number of words, and all runs of one to `most` consecutive words joined by one blank."""
    words = text.translate(_WORDS).split()
    found = list(words)
    for n in range(2, most + 1):
        found += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), found


def bucket_counts(texts: DataFrame, text: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how many features of all texts fall into it. Each task hands on a row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            rows = bytes_of(batch.column(0))
            for at, end in slices(rows, GROUP_BYTES):
                found = [bucket_of[f] for t in rows[at:end] for f in _features(t, most)[1]]
                total += np.bincount(np.array(found, np.int64), minlength=buckets)
            pa.default_memory_pool().release_unused()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return texts.select(text).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: float = 1000.0) -> np.ndarray:
    """The gain of each bucket: floor(scale * ln of the target's smoothed share over the source's). An array of fixed size."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    counts = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").join(every, "bucket", "right")
    counts = counts.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).toPandas().sort_values("bucket")
    s, t = (counts[c].to_numpy(np.float64) for c in ("s", "t"))
    return np.floor(scale * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, most: int = 1) -> DataFrame:
    """docs (doc_id, content, text) as doc_id, content, n_words, n_features, weight: the floored mean gain of its features, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        bucket_of = _Buckets(len(gain))
        for batch in batches:
            rows = bytes_of(batch.column(2))
            words, features, weights = [], [], []
            for at, end in slices(rows, GROUP_BYTES):
                lengths, found = [], []
                for t in rows[at:end]:
                    n, some = _features(t, most)
                    words.append(n)
                    lengths.append(len(some))
                    found += [bucket_of[f] for f in some]
                n = np.array(lengths)
                upto = np.concatenate([[0], np.cumsum(gain[np.array(found, np.int64)])])
                ends = np.cumsum(n)
                weights.append(np.where(n > 0, (upto[ends] - upto[ends - n]) // np.maximum(n, 1), 0))
                features.append(n)
            columns = [pa.array(words, pa.int64()), *(pa.array(np.concatenate(x or [np.zeros(0, np.int64)])) for x in (features, weights))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "content", "n_words", "n_features", "weight"])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(score, "doc_id bigint, content bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_col: Column, seed: int = 2024, scale: float = 1000.0) -> Column:
    """floor(-scale * ln(-ln u)) for the u that the seed and the id give; an id that is null counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-scale) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def key_columns(rows: DataFrame) -> list[Column]:
    """The composite key whose ascending order is the order of the draw: higher scores, then smaller ids, rows without an id last."""
    return [(-F.col("score")).alias("k0"), F.col("doc_id").isNull().alias("k1"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("k2"), F.coalesce("content", F.lit(0)).alias("k3"), F.col("place").alias("k4")]


def _literal(key: tuple) -> Column:
    return F.struct(*(F.lit(v).cast("boolean" if isinstance(v, bool) else "bigint").alias(f"k{i}") for i, v in enumerate(key)))


def _between(key: Column, pivots: list[tuple]) -> Column:
    """2 * i below pivot i and above the one before, 2 * i + 1 at pivot i; by halves."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(2 * low)
        mid = (low + high) // 2
        here = _literal(pivots[mid])
        return F.when(key < here, search(low, mid)).when(key == here, F.lit(2 * mid + 1)).otherwise(search(mid + 1, high))

    return search(0, len(pivots))


def kth_key(rows: DataFrame, k: int, seed: int = 0) -> tuple | None:
    """The k-th least composite key (k0 to k4, none of them null, no two rows alike) of rows; None if k is not from 1 to their number.

    Each round takes about PIVOTS random keys of the open range and counts the rows below, at and above each of them in
    one pass with partial counts, so a round leaves about a PIVOTS-th of the range open, whatever its keys are."""
    left, low, high = rows.count(), None, None
    if not 1 <= k <= left:
        return None
    key = F.struct("k0", "k1", "k2", "k3", "k4")
    turn = 0
    while True:
        turn += 1
        some = rows
        if low is not None:
            some = some.where((F.col("k0") >= low[0]) & (key > _literal(low)))
        if high is not None:
            some = some.where((F.col("k0") <= high[0]) & (key < _literal(high)))
        if left > 2 * PIVOTS:
            drawn = F.xxhash64(F.lit(seed), F.lit(turn), "k2", "k3", "k4")
            picked = some.where(F.shiftrightunsigned(drawn, 11) < int(2**53 * PIVOTS / left))
        else:
            picked = some
        pivots = sorted(tuple(r) for r in picked.select("k0", "k1", "k2", "k3", "k4").collect())
        if not pivots:
            continue
        counts = {r["part"]: r["count"] for r in some.groupBy(_between(key, pivots).alias("part")).count().collect()}
        for part in sorted(counts):
            if k <= counts[part]:
                break
            k -= counts[part]
        if part % 2:
            return pivots[part // 2]
        left = counts[part]
        low, high = (pivots[part // 2 - 1] if part else low), (pivots[part // 2] if part // 2 < len(pivots) else high)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """A row for each row of docs: id_col, n_words, n_features, weight, score, rank.

    Of the N rows with `least_words` words or more the floor(percent * N / 100) highest scores are drawn and get ranks 1,
    2, 3, ...; ties go to the smaller id. Words are lower case in A-Z only; features are runs of 1 to `most` words, with
    repeats. A null text has no words, as an empty one; then the weight is 0. A null id is hashed as an empty one and loses
    ties. Repeated rows are rows of their own: they have one score, and of equal ones as many are drawn as there is room
    for. Very long texts count whole. An empty table gives no rows, an empty target gives smoothed shares; other columns
    are ignored, so their names may clash."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    gains = bucket_gains(bucket_counts(rows, "text", most, buckets), bucket_counts(target, target_text, most, buckets), buckets)
    scored = weighed(rows, gains, most).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("place", F.monotonically_increasing_id())
    scored = written(scored.select("doc_id", "n_words", "n_features", "weight", "score", *key_columns(scored)), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    last = kth_key(able, percent * able.count() // 100, seed)
    plain = ["doc_id", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    if last is None:
        return scored.select(*plain, none).withColumnRenamed("doc_id", id_col)
    won = (F.col("n_words") >= least_words) & (F.struct("k0", "k1", "k2", "k3", "k4") <= _literal(last))
    winners = running(scored.where(won), [F.col(f"k{i}") for i in range(5)]).select(*plain, (F.col("rank") + 1).cast("bigint").alias("rank"))
    return winners.unionByName(scored.where(~won).select(*plain, none)).withColumnRenamed("doc_id", id_col)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents towards the benchmark's texts: single words, 10,000 buckets, a tenth of the documents of 20 words or more."""
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


#: DuckDB has no crc32: eight shifts a byte over each distinct word.
OP11_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
t AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
words AS (SELECT DISTINCT word FROM (SELECT word FROM w UNION ALL SELECT word FROM t)),
crcs AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS INT), 2))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 10000 AS bucket FROM words),
s AS (SELECT bucket, count(*) AS s FROM w JOIN crcs USING (word) GROUP BY bucket), tt AS (SELECT bucket, count(*) AS t FROM t JOIN crcs USING (word) GROUP BY bucket),
gains AS (SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM tt), 0) + 10000))))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN tt USING (bucket)),
d AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN crcs USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN d USING (doc_id)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM k) THEN rank END AS rank, n_features AS n_words FROM r LEFT JOIN k USING (doc_id)
"""
