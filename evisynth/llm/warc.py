"""WARC archives: writing them as one gzip stream a file, and normalising such files so that every record can be read alone.

The normaliser inflates a whole-file stream once, rewrites each record as its own gzip member and writes a sidecar of
offsets. Files are dealt out by page, one task a file; what is read back comes from the rewritten archives.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Publisher, bytes_of, filesystem, new_folder, partitions, table, written

#: Shorter payloads are never revisits. Payload bytes of a file, about. Salts for digests that many pages share.
LEAST, FILE_BYTES, SALTS = 100, 64 << 20, 16
#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
WHEN, LEVEL = "2024-01-01T00:00:00Z", 6


def record(payload: bytes, page_id: int | None, url: str | None, digest: str, refers_to: int | None) -> bytes:
    """One record; with refers_to a revisit, which leaves the payload out."""
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Date": WHEN}
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    head |= {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload))}
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to), "X-Refers-To-Page-Id": str(refers_to)}
    block = HTTP + (payload if refers_to is None else b"")
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    return b"%b\r\n%b\r\n%b\r\n\r\n" % (VERSION, lines, block)


def parse(raw: bytes | memoryview) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = bytes(raw).partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION:
        raise ValueError("no WARC record")
    fields = dict(x.decode().split(": ", 1) for x in lines)
    return fields, rest[: int(fields["Content-Length"])]


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """A gzip stream of one or more members, inflated piece by piece."""
    member = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            if member.eof:
                member = zlib.decompressobj(31)
            yield member.decompress(chunk)
            chunk = member.unused_data
    if not member.eof:
        raise ValueError("the gzip stream is cut short")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, each whole; only one is kept at a time."""
    held, need = bytearray(), None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields = dict(x.split(b": ", 1) for x in bytes(held[:end]).split(b"\r\n")[1:])
                need = end + 4 + int(fields[b"Content-Length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the last record is cut short")


def normalise(uri: str, out_uri: str, index_uri: str, keep: bool = True) -> int:
    """Rewrites a whole-stream archive with one member a record, and its sidecar: a JSON line with offset and length for each. The number of records.

    With keep=False the stream goes once both are in place; a later attempt then finds it gone and counts the sidecar."""
    from pyarrow import fs as pafs

    fs, path = filesystem(uri)
    if not keep and fs.get_file_info(path).type == pafs.FileType.NotFound:
        with fs.open_input_stream(filesystem(index_uri)[1]) as f:
            return f.read().count(b"\n")
    lines, at = [], 0
    with fs.open_input_stream(path, compression=None) as source, Publisher(out_uri) as out:
        for raw in records(inflated(iter(lambda: source.read(1 << 20), b""))):
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = packer.compress(raw) + packer.flush()
            fields = parse(raw)[0]
            lines.append(json.dumps({"id": fields["WARC-Record-ID"], "type": fields["WARC-Type"], "offset": at, "length": len(member)}))
            out.write(member)
            at += len(member)
    with Publisher(index_uri) as out:
        out.write("".join(x + "\n" for x in lines).encode())
    if not keep:
        fs.delete_file(path)
    return len(lines)


def with_first(pages: DataFrame, n_files: int, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) with digest and refers_to: the least page_id of equal payloads of at least `least` bytes, null for itself.

    Dealt out to n_files partitions by page and digest, which is the only time that payloads are shuffled."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    key = F.concat_ws("|", F.col("page_id").cast("string"), F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("string")).alias("key")  # pages without an id are many keys
    rows = pages.select("page_id", key, F.octet_length(payload).alias("n"), F.sha2(payload, 256).alias("digest"))
    equal = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    salted = equal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    later = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"])
    later = later.where(~F.col("page_id").eqNullSafe(F.col("first"))).select("key", "digest", F.col("first").alias("refers_to"))
    all_pages = pages.select("page_id", "url", "html", key, F.sha2(payload, 256).alias("digest"))
    return all_pages.repartition(n_files, "key", "digest").join(later.repartition(n_files, "key", "digest"), ["key", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes every page as a WARC record, payload its html in UTF-8 (null: empty), into files of one gzip stream each: file, path, n_records."""
    spark = pages.sparkSession
    total = pages.agg(F.sum(F.octet_length("html"))).head()[0] or 0
    n_files = max(partitions(spark, spark.sparkContext.defaultParallelism), -(-total // file_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, part, packer, out, publisher = 0, TaskContext.get().partitionId(), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), None, None
        uri = f"{folder}/raw-{part:06d}.warc.gz"
        try:
            for batch in batches:
                ids, urls, payloads, digests, refers = batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()
                for i, u, p, d, r in zip(ids, urls, payloads, digests, refers, strict=True):
                    if publisher is None:
                        publisher = Publisher(uri)
                        out = publisher.__enter__()
                    out.write(packer.compress(record(p, i, u, d, r)))
                    n += 1
        except BaseException as e:
            if publisher is not None:
                publisher.__exit__(type(e), e, None)
            raise
        if publisher is not None:
            out.write(packer.flush())
            publisher.__exit__(None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([uri]), pa.array([n], pa.int64())], ["file", "path", "n_records"])

    chosen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    rows = with_first(chosen, n_files).sortWithinPartitions("page_id", "digest", "url")
    return written(rows.mapInArrow(write, "file bigint, path string, n_records bigint"), "archives")


def normalise_archives(files: DataFrame, keep: bool = True) -> DataFrame:
    """Normalises each file of write_archives beside itself, a task a file: path and index of the new archives, n_records. keep=False removes the streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                base = uri.removesuffix(".warc.gz").replace("/raw-", "/records-")
                n = normalise(uri, f"{base}.warc.gz", f"{base}.cdxj", keep)
                yield pa.RecordBatch.from_arrays([pa.array([f"{base}.warc.gz"]), pa.array([f"{base}.cdxj"]), pa.array([n], pa.int64())], ["path", "index", "n_records"])

    spark = files.sparkSession
    return written(files.select("path").repartition(partitions(spark, spark.sparkContext.defaultParallelism), "path").mapInArrow(run, "path string, index string, n_records bigint"), "archives")


def read_archives(files: DataFrame) -> DataFrame:
    """A row for each record, found by its sidecar offset: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A response's size and digest are taken from its payload, and must be what its header says; a revisit's are in its header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_stream(filesystem(index)[1]) as f:
                    entries = [json.loads(x) for x in f.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(path) as f:
                    for e in entries:
                        fields, block = parse(zlib.decompress(f.read_at(e["length"], e["offset"]), 31))
                        n, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Type"] == "response":
                            payload = block[len(HTTP) :]
                            if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{e['id']} in {uri} is damaged")
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                        rows.append((number("X-Page-Id"), n, digest, fields["WARC-Type"], number("X-Refers-To-Page-Id"), fields.get("WARC-Target-URI")))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    spark = files.sparkSession
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
    return files.select("path", "index").repartition(partitions(spark, spark.sparkContext.defaultParallelism), "path").mapInArrow(read, schema)


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Writes, normalises and reads back all pages: one row a page row, as read_archives gives them.

    A null html is an empty payload, a null url writes no target; rows without a page_id are responses unless an equal
    payload has one; repeated rows with the least page_id are all responses. An empty table writes no file and gives no
    rows; other columns are ignored. The whole-stream files are scratch and go as they are rewritten."""
    return read_archives(normalise_archives(write_archives(pages, folder), keep=False))


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"), new_folder(spark, "warc")).drop("url")


OP5_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.payload_digest = f.payload_digest
"""
