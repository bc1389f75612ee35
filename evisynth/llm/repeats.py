"""Substring dedup by sliding spans of sentences: every run of several sentences is hashed, equal runs are found over all
documents, and sentences that a repeated run other than its first covers are removed.

The runs that are hashed are those of SENTENCES sentences from every place of every text, however short the sentences are:
a longer run repeats exactly where all of its runs of SENTENCES sentences repeat in order, so these cover whatever any
run of several sentences covers, at one hash a sentence. Single sentences are left alone. Runs are known by 128-bit
hashes. Only hashes, ids and sentence numbers are shuffled until documents are rewritten.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, slices, table, written
from .tokens import GROUP_BYTES

#: Sentences of a run.
SENTENCES = 2
_BETWEEN = re.compile(rb"(?<=[.!?])[ \t\r\x0b\x0c]+|\s*\n\s*")


def sentences(text: bytes) -> list[tuple[int, int]]:
    """(start, end) of each, in bytes; white space between them belongs to none."""
    out, at = [], len(text) - len(text.lstrip())
    for m in _BETWEEN.finditer(text, at):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    end = len(text.rstrip())
    return [*out, (at, end)] if at < end else out


def runs(text: bytes, length: int = SENTENCES) -> list[bytes]:
    """The hash of the run of `length` sentences from each sentence that has as many behind it. White space within sentences does not count."""
    import xxhash

    raw = b"".join([xxhash.xxh3_128_digest(b" ".join(text[a:b].split())) for a, b in sentences(text)])
    return [xxhash.xxh3_128_digest(raw[i : i + 16 * length]) for i in range(0, len(raw) - 16 * (length - 1), 16)]


def all_runs(docs: DataFrame, length: int = SENTENCES) -> DataFrame:
    """docs (doc_id, content, text) as a row for each run: hash, doc_id, content, first (the number of its first sentence)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch.column(2))
            for at, end in slices(texts, GROUP_BYTES):
                found = [runs(t, length) for t in texts[at:end]]
                sizes = np.array([len(f) for f in found])
                times = pa.array(np.repeat(np.arange(at, end), sizes))
                first = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array([h for f in found for h in f], pa.binary()), batch.column(0).take(times), batch.column(1).take(times), pa.array(first, pa.int32())], ["hash", "doc_id", "content", "first"])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(cut, "hash binary, doc_id bigint, content bigint, first int")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = SENTENCES) -> DataFrame:
    """A row for each row of docs: id_col, n_sentences, n_removed, removed (first-last sentence numbers from 0, joined by commas), text as it stays.

    The first of equal runs is that of the least id, and in a document the earliest; it stays, but for sentences that a
    later run covers too. Removed sentences go with the white space behind them. A null text stays null and has no
    sentences, as an empty one has; rows without an id are left as they are and are nobody's first. Rows that repeat
    both id and text are one document and are cut alike. Very long texts are cut whole. An empty table gives no rows;
    other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    found = written(all_runs(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"), length), "all-runs")
    # both sides of each large join are dealt out for it alone, so that a common hash's rows can be split over tasks
    again = written(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeated")
    repeated = written(found.join(again.hint("merge"), "hash"), "runs")
    place = F.struct("doc_id", "content", "first")
    firsts = written(repeated.groupBy("hash").agg(F.min(place).alias("keep")), "firsts")
    later = repeated.join(firsts.hint("merge"), "hash").where(place != F.struct("keep.doc_id", "keep.content", "keep.first"))
    cuts = later.groupBy("doc_id", "content").agg(F.collect_set("first").alias("cuts")).withColumnRenamed("doc_id", "cut_id").withColumnRenamed("content", "cut_content")
    cuts = written(cuts, "cuts")
    joined = rows.join(cuts.hint("merge"), (F.col("doc_id") == F.col("cut_id")) & (F.col("content") == F.col("cut_content")), "left")
    joined = joined.select("doc_id", "text", F.col("cuts").alias("firsts"))

    def cleaned(t: bytes, firsts: list[int]) -> tuple[int, int, str, bytes]:
        spans = sentences(t)
        gone = np.zeros(len(spans) + 1, bool)
        for i in firsts:
            gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        ranges = list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))
        parts, at = [], 0
        for i, j in ranges:
            parts.append(t[at : spans[i][0]])
            at = spans[j + 1][0] if j + 1 < len(spans) else len(t)
        return len(spans), int(gone.sum()), ",".join(f"{i}-{j}" for i, j in ranges), b"".join([*parts, t[at:]]) if ranges else t

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            texts = bytes_of(batch.column(1))
            for at, end in slices(texts, GROUP_BYTES):
                some = batch.slice(at, end - at)
                present = some.column(1).is_valid().to_pylist()
                out = [cleaned(t, a or []) for t, a in zip(texts[at:end], some.column(2).to_pylist(), strict=True)]
                columns = [pa.array([r[i] if i < 3 or ok else None for r, ok in zip(out, present, strict=True)], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns[:3], columns[3].cast(pa.string())], ["doc_id", "n_sentences", "n_removed", "removed", "text"])
            pa.default_memory_pool().release_unused()

    return joined.mapInArrow(remove, "doc_id bigint, n_sentences bigint, n_removed bigint, removed string, text string").withColumnRenamed("doc_id", id_col)


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, every run of two or more sentences; nulls, repeats and empty tables as in `without_repeats`."""
    return without_repeats(table(spark, sf_dir, "documents"))
