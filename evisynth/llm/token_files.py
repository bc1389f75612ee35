"""Token ids as binary files: ids ranked by frequency, each rank in one to four bytes, its length in a separate control byte.

The text is dealt out in ranges of ascending document id, and every task encodes and writes the files of its range, so ids are
made once and never shuffled. A file stands alone: magic, counts, the ids of its ranks in order of frequency, a table
of its documents, control bytes (four 2-bit lengths each), data bytes. The decoder is a numpy table lookup.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Publisher, bytes_of, filesystem, new_folder, partitions, slices, table, written
from .tokens import GROUP_BYTES, id_encoder

MAGIC, HEAD = b"RANKVB01", struct.Struct("<8sQQQQ")
#: Text bytes that a file holds, about; a writer keeps the ids of one file in memory.
FILE_BYTES = 32 << 20
#: Files that a task writes, about, where there is more text than tasks that run at once.
FILES_A_TASK = 8
#: Chunks that a writer's encoder keeps: more than usual, as a writer holds little else than one file.
KEPT = 1_000_000
#: Ids that are coded at a time, a multiple of four.
SLICE = 1 << 20
#: For each control byte the lengths of its four ranks.
LENGTHS = np.array([[((c >> (2 * k)) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes), made slice by slice so that masks stay small."""
    control, data = [], []
    for at in range(0, len(ranks), SLICE):
        part = ranks[at : at + SLICE]
        codes = (part > 0xFF).astype(np.uint8) + (part > 0xFFFF) + (part > 0xFFFFFF)
        four = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
        four[: len(codes)] = codes
        control.append((four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes())
        data.append(part.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]].tobytes())
    return b"".join(control), b"".join(data)


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    out, at = np.zeros((n, 4), np.uint8), 0
    data = np.frombuffer(data, np.uint8)
    for first in range(0, n, SLICE):
        few = min(SLICE, n - first)
        lengths = LENGTHS[np.frombuffer(control, np.uint8, -(-few // 4), first // 4)].reshape(-1)[:few]
        size = int(lengths.sum(dtype=np.int64))
        out[first : first + few][np.arange(4) < lengths[:, None]] = data[at : at + size]
        at += size
    return out.reshape(-1).view("<u4")


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids by falling frequency, ties by id; the rank of every id). Counts are a table over ids where ids are small."""
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    if (top := int(ids.max())) < 1 << 22:
        counts = np.bincount(ids, minlength=top + 1)
        used = np.flatnonzero(counts)
        order = used[np.argsort(-counts[used], kind="stable")]
        rank = np.zeros(top + 1, np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return order.astype(np.uint32), rank[ids]
    used, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(used), np.uint32)
    rank[order] = np.arange(len(used), dtype=np.uint32)
    return used[order], rank[place]


def write_file(uri: str, ids: list[bytes], doc_ids: list[int | None]) -> int:
    """The number of ids. Their ranks follow from how often each id occurs in the file, ties by id."""
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    every = np.frombuffer(b"".join(ids), "<u4")
    used, ranks = ranked(every)
    control, data = encode_ranks(ranks)
    with Publisher(uri) as out:
        out.write(HEAD.pack(MAGIC, len(doc_ids), len(every), len(used), len(data)))
        out.write(used.astype("<u4").tobytes())
        out.write(np.array([x is None for x in doc_ids], np.uint8).tobytes())
        out.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
        out.write(lengths.astype("<i8").tobytes())
        out.write(control)
        out.write(data)
    return len(every)


def read_file(uri: str) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, number of ids of each, all ids)"""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as f:
        raw = f.read()
    magic, docs, n, used, size = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError(f"{uri} is no file of ranked ids")
    view, at = memoryview(raw), HEAD.size
    vocabulary = np.frombuffer(raw, "<u4", used, at)
    nulls = np.frombuffer(raw, np.uint8, docs, at := at + 4 * used)
    doc_ids = np.frombuffer(raw, "<i8", docs, at := at + docs)
    lengths = np.frombuffer(raw, "<i8", docs, at := at + 8 * docs)
    at += 8 * docs
    data = view[at + -(-n // 4) :]
    if len(data) != size:
        raise ValueError(f"{uri} is cut short")
    ids = vocabulary[decode_ranks(view[at : at + -(-n // 4)], data, n)] if n else np.zeros(0, "<u4")
    return [None if z else int(x) for z, x in zip(nulls, doc_ids, strict=True)], lengths, ids


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all texts of docs as ids, each with end_id behind it, in ascending id_col order (null first, equal ids by the hash of their text) to files in `folder`.

    Returns file (ascending as the ids are), path, n_docs, n_ids and start (ids in all files before it), a row a file. A
    null text is empty: only its end id is written. A very long text is one document of one file. Rows of one id, or of
    none, are spread over tasks by their text; repeated rows stay. An empty table writes no file. Other columns are
    ignored."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    tasks = max(2 * partitions(spark, spark.sparkContext.defaultParallelism), -(-total // (FILES_A_TASK * file_bytes)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end, part = id_encoder(path, KEPT), struct.pack("<I", end_id), TaskContext.get().partitionId()
        number, size, ids, doc_ids = 0, 0, [], []

        def closed() -> pa.RecordBatch:
            uri = f"{folder}/ids-{part:08d}-{number:06d}.rvb"
            row = {"file": part << 32 | number, "path": uri, "n_docs": len(doc_ids), "n_ids": write_file(uri, ids, doc_ids)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), bytes_of(batch.column(1))
            for a, b in slices(texts, GROUP_BYTES):
                ids += [x + end for x in encoder.encode(texts[a:b])]
                doc_ids += keys[a:b]
                size += sum(map(len, texts[a:b]))
                if size >= file_bytes:
                    yield closed()
                    number, size, ids, doc_ids = number + 1, 0, [], []
        if ids:
            yield closed()

    rows = chosen.repartitionByRange(tasks, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    files = written(rows.mapInArrow(write, "file bigint, path string, n_docs bigint, n_ids bigint"), "token-files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file, not a document
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32, in the files' order of ids."""
    spark = files.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, lengths, ids = read_file(uri)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "start").repartition(partitions(spark, spark.sparkContext.defaultParallelism), "path").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "ids")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder))
