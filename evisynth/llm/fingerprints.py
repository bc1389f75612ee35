"""Document fingerprints by winnowing, in DataFrame functions only.

A text becomes units (words; characters of scripts without spaces stand alone), each K-gram of units a rolling hash, and
of every window of W grams the least hash is kept, the rightmost of equal ones. So two texts that share W + K - 1 units
in a row share at least one fingerprint, and its position in each shows where.

A gram is one number: its hash in the upper 31 bits, and 2**32 - 1 less its position below, so that the least number of
a window is its rightmost least hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, id_bounds, let, partitions, table

#: Units of a gram and grams of a window: matches of K + W - 1 = 12 units are found for sure.
K, W = 5, 8
#: Bytes of text in a bucket of documents that follow each other, about.
BUCKET_BYTES = 128 << 20
_ALONE = r"⺀-鿿가-힯豈-﫿"
UNIT = rf"[{_ALONE}]|[^\x20\x09-\x0D{_ALONE}]+"
_LOW = (1 << 32) - 1


def _turned(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _joined(grams: Column, apart: int) -> Column:
    """Hashes of grams `apart` units longer, from each gram and the one that begins `apart` units later: a cyclic polynomial, so longer grams reuse shorter ones."""
    n = F.size(grams) - apart
    return F.zip_with(F.slice(grams, F.lit(1), n), F.slice(grams, F.lit(apart + 1), n), lambda x, y: _turned(x, apart).bitwiseXOR(y))


def gram_hashes(text: Column, k: int = K) -> Column:
    """The rolling hash of every k-gram of units, in order; of a shorter text, of all its units as one; of no unit, none."""

    def grams(h: Column, size: int = 1) -> Column:
        if size == k:
            return h
        step = min(size, k - size)
        return let(h, lambda d: grams(_joined(d, step), size + step))

    hashes = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))
    whole = lambda h: F.array(F.aggregate(h, F.lit(0).cast("bigint"), lambda acc, x: _turned(acc, 1).bitwiseXOR(x)))
    return let(hashes, lambda h: F.when(F.size(h) >= k, grams(h)).when(F.size(h) > 0, whole(h)).otherwise(F.array().cast("array<bigint>")))


def _least(grams: Column, w: int) -> Column:
    """The least of every w numbers in a row, by doubling: least ones of 1, 2, 4, ... numbers, then of two such runs that overlap."""

    def grown(d: Column, size: int = 1) -> Column:
        if size == w:
            return d
        step = min(size, w - size)
        pairs = lambda x, n: F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(step + 1), n), lambda p, q: F.least(p, q))
        return let(d, lambda x: grown(pairs(x, F.size(x) - step), size + step))

    return grown(grams)


def winnowed(text: Column, k: int = K, w: int = W) -> Column:
    """The fingerprint: kept grams in order of position, as numbers that hold hash and position."""
    number = lambda h, i: F.shiftleft(F.xxhash64(h).bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(F.lit(_LOW) - i.cast("bigint"))
    kept = lambda g: F.when(F.size(g) >= w, F.array_distinct(_least(g, w))).when(F.size(g) > 0, F.array(F.array_min(g))).otherwise(g)
    return let(F.transform(gram_hashes(text, k), number), kept)


def hash_of(number: Column) -> Column:
    return F.shiftright(number, 32)


def position_of(number: Column) -> Column:
    return (F.lit(_LOW) - number.bitwiseAND(F.lit(_LOW))).cast("int")


def as_string(fingerprint: Column) -> Column:
    """hash:position pairs in hexadecimal and decimal, joined by blanks."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(hash_of(x))), F.lit(":"), position_of(x).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes, by sets; 1 if neither has any."""
    sets = F.transform(F.array(a, b), lambda x: F.array_distinct(F.transform(x, hash_of)))
    return let(sets, lambda s: let(F.size(F.array_intersect(s[0], s[1])), lambda n: F.when(F.size(s[0]) + F.size(s[1]) == 0, 1.0).otherwise(n / (F.size(s[0]) + F.size(s[1]) - n))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """id_col and grams: an array of (hash, position), position in units from 0, a row for each row of docs.

    A null or empty text has no grams; a text of fewer than k units has one for all of them, one of fewer than k + w - 1
    has the least of its grams. Equal texts have equal grams. Other columns are ignored."""
    return docs.select(id_col, F.transform(winnowed(F.col(text), k, w), lambda x: F.struct(hash_of(x).alias("hash"), position_of(x).alias("position"))).alias("grams"))


def with_next(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs (doc_id, text) in buckets of ascending doc_id, and the column that tells the rows that only close a bucket.

    The first row of each bucket stands once more at the end of the one before, the first of all at the end of the last,
    so lead() within buckets gives every row the next document; no row needs the whole table in one task. Rows without
    doc_id have buckets of their own by their text, below 0."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(4 * partitions(spark, spark.sparkContext.defaultParallelism), -(-size // BUCKET_BYTES))
    bounds = id_bounds(docs, "doc_id", n)
    keyed = docs.withColumn("first", F.xxhash64("text"))
    apart = -1 - F.pmod("first", F.lit(n)).cast("int")
    if not bounds:  # no ids, or no rows
        return keyed.withColumns({"bucket": apart, "closes": F.lit(False), "wraps": F.lit(0)}), F.col("closes")
    keyed = keyed.withColumn("bucket", F.when(F.col("doc_id").isNull(), apart).otherwise(bucket_of(F.col("doc_id"), bounds)))
    last = len(bounds) - 1
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("closes"), F.lit(0).alias("wraps"))
    again = F.struct(F.when(F.col("bucket") == 0, last).otherwise(F.col("bucket") - 1).alias("bucket"), F.lit(True).alias("closes"), F.when(F.col("bucket") == 0, 1).otherwise(0).alias("wraps"))
    rows = keyed.withColumn("copy", F.explode(F.when(F.col("doc_id").isin(bounds), F.array(own, again)).otherwise(F.array(own))))
    return rows.select("doc_id", "text", "first", "copy.*"), F.col("closes")


def edited(text: Column, following: Column) -> Column:
    """text with its last half (rounded down, in code points) replaced by as many first ones of the following text, or all it has."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document. Of repeated doc_ids, which follows which is settled by the texts' hashes; a document without doc_id has no place in the order: its own text follows it, and it follows none.

    Null texts are empty; an empty text's fingerprint and edited text are empty, and two empty fingerprints are alike (1).
    Very long texts are taken whole; the last document is followed by the first, an only one by itself; an empty table
    gives no rows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, closes = with_next(docs)
    order = Window.partitionBy("bucket").orderBy("wraps", "doc_id", "first", "closes")
    follows = lambda c: F.coalesce(F.when(F.col("doc_id").isNotNull(), F.lead(c).over(order)), F.col(c))
    rows = rows.withColumn("next", follows("text"))
    rows = rows.withColumns({"grams": winnowed(F.col("text")), "edited": edited(F.col("text"), F.col("next")), "n_chars": F.char_length("text").cast("bigint")})
    rows = rows.withColumn("next_grams", follows("grams")).where(~closes)
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "grams", "next_grams", winnowed(F.col("edited")).alias("edited_grams"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("grams")).alias("fingerprint"), as_string(F.col("edited_grams")).alias("edited_fingerprint"), likeness(F.col("grams"), F.col("edited_grams")).alias("near_edited"), likeness(F.col("grams"), F.col("next_grams")).alias("near_next"))
