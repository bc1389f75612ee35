"""Substring dedup on exact byte strings: external induced sorting over shards in which all equal strings meet.

The least hash of all K-byte pieces of a string of `least` bytes follows from the string alone, so equal strings share it.
A segment is a run of windows of a text with one such hash, with the bytes that they cover. Segments whose hash occurs in
one document only share nothing and stay where they are; of the others, the different texts of a pack of documents go to
the shard of their hash with the least and the greatest id that has them. A shard orders all suffixes of its different
segments with their common prefixes (suffixes.py): neighbours that share `least` bytes or more are one string, the least
id of all segments that have it is its first document, and runs of windows with one first document go back to the pack.
There every byte that a window with a smaller first document covers is removed.

A pack is some PACK_BYTES of texts, compressed, in a written table: later steps meet a pack with what they have found
about it. No step holds more than a pack, a part of the hashes or a shard, and what a hot passage brings to its shard is
one copy a pack, not one a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_dir
from .common import bytes_of, partitions, table, written
from .suffixes import Scratch, suffix_order

#: Bytes of texts in a pack, of texts whose hashes meet in a part, and of segments in a shard, about; bytes hashed at once.
PACK_BYTES, PART_BYTES, SHARD_BYTES, SLICE_BYTES = 1 << 22, 1 << 26, 1 << 22, 1 << 18
#: Shards of a task, about, where there are more than shuffle partitions.
TASK_SHARDS = 4
_ODD = 0x9E3779B97F4A7C15


def packs(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) as packs: number, ids, ends (of each text in the pack, in bytes), compressed texts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def pack() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts])
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["pack", "ids", "ends", "blob"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size >= PACK_BYTES:
                    yield pack()
                    number += 1
                    ids, texts, size = [], [], 0
        if ids:
            yield pack()

    return rows.mapInArrow(gather, "pack bigint, ids array<bigint>, ends array<bigint>, blob binary")


def _window_hashes(text: np.ndarray, least: int) -> np.ndarray:
    """The least hash of the pieces of each window of `least` bytes, along the last axis."""
    piece = 1 << (least // 3).bit_length() - 1
    hashes, width = text.astype(np.uint64), 1
    while width < piece:
        hashes = hashes[..., :-width] * np.uint64(pow(_ODD, width, 1 << 64)) + hashes[..., width:]
        width *= 2
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    window, width = least - piece + 1, 1
    while 2 * width <= window:
        hashes = np.minimum(hashes[..., :-width], hashes[..., width:])
        width *= 2
    if width < window:
        hashes = np.minimum(hashes[..., : width - window], hashes[..., window - width :])
    return hashes


class Pack:
    """A pack's row, opened: ids (with present: whether there is one), ends and text, and its segments."""

    def __init__(self, row: dict):
        import zstandard

        self.number = row["pack"]
        self.present = np.array([i is not None for i in row["ids"]], bool)
        self.ids = np.array([i or 0 for i in row["ids"]], np.int64)
        self.ends = np.array(row["ends"], np.int64)
        self.text = zstandard.ZstdDecompressor().decompress(row["blob"]) if self.ends[-1] else b""

    def segments(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """hash, first window, end of the windows and document of each segment of documents with an id."""
        found, first, size = [], 0, np.diff(self.ends, prepend=0)
        for last in range(len(self.ends)):
            begin = int(self.ends[first] - size[first])
            if self.ends[last] - begin < SLICE_BYTES and last + 1 < len(self.ends):
                continue
            found.append(self._slice(first, last + 1, begin, least))
            first = last + 1
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _slice(self, first: int, last: int, begin: int, least: int) -> tuple[np.ndarray, ...]:
        end = int(self.ends[last - 1])
        none = np.zeros(0, np.int64)
        if end - begin < least:
            return none.astype(np.uint64), none, none, none
        hashes = _window_hashes(np.frombuffer(self.text, np.uint8, end - begin, begin), least)
        ends = self.ends[first:last] - begin
        starts = np.concatenate([[0], ends[:-1]])
        inside = np.zeros(len(hashes) + 1, np.int64)  # windows that lie within a document that has an id
        there = (ends - starts >= least) & self.present[first:last]
        np.add.at(inside, starts[there], 1)
        np.add.at(inside, ends[there] - least + 1, -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]))
        if not len(at):
            return none.astype(np.uint64), none, none, none
        value = hashes[at]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at)) - 1
        return value[heads], at[heads] + begin, at[tails] + begin + 1, np.searchsorted(ends, at[heads], "right") + first


def _parted(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The different (part, 32-bit key) of hashes in order, as one number each, and where each hash is among them."""
    return np.unique(((hashes >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF)), return_inverse=True)


def shared_hashes(packed: DataFrame, least: int, parts: int) -> DataFrame:
    """pack, part, bits: which of the pack's different keys of the part, in order, occur in two documents or more (or are taken for one that does, at a chance of a part's keys in 2**32)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pack = Pack(batch.slice(i, 1).to_pylist()[0])
                hashes, _, _, docs = pack.segments(least)
                if not len(hashes):
                    continue
                found, where = _parted(hashes, parts)
                low, high = np.full(len(found), len(pack.ids)), np.full(len(found), -1)
                np.minimum.at(low, where, docs)
                np.maximum.at(high, where, docs)
                of = (found >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                short, twice = found.astype(np.uint32), low < high
                spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)], strict=True))
                columns = [[int(of[a]) for a, _ in spans], [pack.number] * len(spans), [short[a:b].tobytes() for a, b in spans], [np.packbits(twice[a:b]).tobytes() for a, b in spans]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "pack", "keys", "twice"])

    def meet(group: pa.Table) -> pa.Table:
        lists = [np.frombuffer(k, np.uint32) for k in group["keys"].to_pylist()]
        marks = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)).astype(bool) for k, t in zip(lists, group["twice"].to_pylist(), strict=True)]
        every = np.sort(np.concatenate(lists))
        again = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(k[m] for k, m in zip(lists, marks, strict=True))]))
        bits = [np.packbits(_among(k, again)).tobytes() for k in lists]
        hits = [len(k) and int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for k, b in zip(lists, bits, strict=True)]
        return pa.table({"pack": group["pack"], "part": group["part"], "bits": pa.array(bits, pa.binary()), "hits": pa.array(hits, pa.int64())})

    found = packed.mapInArrow(keys, "part bigint, pack bigint, keys binary, twice binary")
    return found.groupBy("part").applyInArrow(meet, "pack bigint, part bigint, bits binary, hits bigint").where("hits > 0")


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _packed(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays of numbers of one length, and bytes behind them; compressed, and then with a byte 1 ahead, if that may pay."""
    import zstandard

    raw = b"".join([len(columns[0]).to_bytes(8, "little"), *(np.ascontiguousarray(c).tobytes() for c in columns), tail])
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) > 512 else b"\0" + raw


def _opened(payload: bytes, *kinds: type) -> tuple:
    """The arrays of _packed, and the bytes behind them."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload[1:]) if payload[0] else payload[1:]
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return (*out, raw[at:])


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owner of each and all of the numbers first, first + 1, ... of ranges of given sizes."""
    owner = np.repeat(np.arange(len(first)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def cut_segments(packed: DataFrame, bits: DataFrame, least: int, parts: int, shards: int) -> DataFrame:
    """For each pack with shared segments: a row a shard (its different segments with their least and greatest id) and one of a negative shard of its own (where each of the pack's segments stands)."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {"pack": [], "shard": [], "payload": []}
        if left.num_rows and right.num_rows:
            pack = Pack(left.to_pylist()[0])
            hashes, first, end, docs = pack.segments(least)
            found, where = _parted(hashes, parts)
            of, hit = (found >> np.uint64(32)).astype(np.int64), np.zeros(len(found), bool)
            for part, some in zip(right["part"].to_pylist(), right["bits"].to_pylist(), strict=True):
                a, b = np.searchsorted(of, [part, part + 1])
                hit[a:b] = np.unpackbits(np.frombuffer(some, np.uint8), count=int(b - a))
            keep = np.flatnonzero(hit[where])
            hashes, first, end, ids = hashes[keep], first[keep], end[keep], pack.ids[docs[keep]]
            shard = ((hashes * np.uint64(_ODD)) >> np.uint64(33)).astype(np.int64) % shards
            known: dict[bytes, int] = {}
            text = pack.text
            number = np.array([known.setdefault(text[a:b], len(known)) for a, b in zip(first.tolist(), (end + least - 1).tolist(), strict=True)], np.int64)
            low, high, home = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min), np.zeros(len(known), np.int64)
            np.minimum.at(low, number, ids)
            np.maximum.at(high, number, ids)
            home[number] = shard
            segments = list(known)
            sizes = np.array([len(s) for s in segments], np.int64)
            order = np.argsort(home, kind="stable")
            edges = np.flatnonzero(np.diff(home[order])) + 1
            for some in np.split(order, edges) if len(order) else []:
                rows["shard"].append(int(home[some[0]]))
                rows["payload"].append(_packed(some.astype(np.int32), sizes[some].astype(np.int32), low[some], high[some], tail=b"".join([segments[i] for i in some.tolist()])))
            rows["shard"].append(-1 - pack.number)
            rows["payload"].append(_packed(number.astype(np.int32), first))
            rows["pack"] = [pack.number] * len(rows["shard"])
        return pa.table([pa.array(rows["pack"], pa.int64()), pa.array(rows["shard"], pa.int64()), pa.array(rows["payload"], pa.binary())], ["pack", "shard", "payload"])

    return packed.groupBy("pack").cogroup(bits.groupBy("pack")).applyInArrow(cut, "pack bigint, shard bigint, payload binary")


def _met(segments: list[bytes], least: int) -> np.ndarray:
    """Which of different segments have a hash that another one has too; all windows of a segment have the hash of its first."""
    found, step = [], max(1, SLICE_BYTES // least)
    for begin in range(0, len(segments), step):
        some = b"".join([s[:least] for s in segments[begin : begin + step]])
        found.append(_window_hashes(np.frombuffer(some, np.uint8).reshape(-1, least), least)[:, 0])
    _, where, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    return count[where] > 1


def _firsts(text: bytes, sizes: np.ndarray, first: np.ndarray, least: int, folder: str) -> tuple[np.ndarray, ...]:
    """Segment, offset, windows and first id of the runs of windows of segments, joined in text, with one first id; first: each segment's own."""
    with Scratch(folder) as scratch:
        # segments end with a symbol of their own kind, the text with the least one
        whole = scratch.array(len(text) + len(sizes) + 1, np.uint16)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        owner, at = _ranges(starts, sizes)
        whole[at] = np.frombuffer(text, np.uint8)
        whole[at] += 2
        whole[starts + sizes] = 1
        del text
        window = at - starts[owner] + least <= sizes[owner]
        place, owner = at[window], owner[window]  # where windows begin, in order
        del at, window
        earliest = scratch.array(len(whole), np.int64)
        earliest[place] = first[owner]
        late = np.zeros(0, np.int64)  # the class that the last block has left open
        for positions, shared in suffix_order(scratch, whole, 257, least):
            positions = np.concatenate([late, positions.astype(np.int64)])
            new = np.concatenate([np.arange(len(late)) == 0, shared < least])
            heads = np.flatnonzero(new)
            size = np.diff(np.append(heads, len(positions)))
            late = positions[heads[-1] :]
            many = np.flatnonzero(size[:-1] > 1)
            _settle(earliest, positions, heads[many], size[many])
        if len(late) > 1:
            _settle(earliest, late, np.zeros(1, np.int64), np.array([len(late)]))
        value = earliest[place]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
        heads = np.flatnonzero(new)
        return owner[heads], place[heads] - starts[owner[heads]], np.diff(np.append(heads, len(place))), value[heads]


def first_documents(cut: DataFrame, least: int, folder: str) -> DataFrame:
    """For each pack and shard: runs of windows of the pack's segments that a document with a smaller id than the greatest one of the segment in the pack has (segment, offset, windows, first id). Rows of negative shards pass, so that segments are dealt out once and never written."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        lows, members = [], []
        for batch in batches:
            if batch.num_rows and batch.column(1)[0].as_py() < 0:
                yield batch
                continue
            for pack, shard, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                number, size, low, high, tail = _opened(payload, np.int32, np.int32, np.int64, np.int64)
                ends = np.cumsum(size.astype(np.int64))
                mine = np.array([known.setdefault(tail[a:b], len(known)) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)], np.int64)
                lows.append((mine, low))
                members.append((pack, shard, number, mine, high))
        if not members:
            return
        segments = list(known)
        known.clear()
        sizes = np.array([len(s) for s in segments], np.int64)
        first = np.full(len(sizes), np.iinfo(np.int64).max)
        for mine, low in lows:
            np.minimum.at(first, mine, low)
        del lows
        # a segment alone with its hash shares no window with another one, so its first document is that of all its windows
        met = _met(segments, least)
        alone, met = np.flatnonzero(~met), np.flatnonzero(met)
        text = b"".join([segments[i] for i in met.tolist()])
        del segments
        runs = [(alone, np.zeros(len(alone), np.int64), sizes[alone] - least + 1, first[alone])]
        if len(met):
            of, offset, count, value = _firsts(text, sizes[met], first[met], least, folder)
            runs.append((met[of], offset, count, value))
        of, offset, count, value = (np.concatenate(c) for c in zip(*runs, strict=True))
        order = np.argsort(of, kind="stable")
        of, offset, count, value = of[order], offset[order], count[order], value[order]
        edges = np.searchsorted(of, np.arange(len(sizes) + 1))
        for pack, shard, number, mine, high in members:
            who, run = _ranges(edges[mine], edges[mine + 1] - edges[mine])
            keep = value[run] < high[who]
            who, run = who[keep], run[keep]
            if len(run):
                payload = _packed(number[who], offset[run].astype(np.int32), count[run].astype(np.int32), value[run])
                yield pa.RecordBatch.from_arrays([pa.array([pack]), pa.array([shard]), pa.array([payload], pa.binary())], ["pack", "shard", "payload"])
        pa.default_memory_pool().release_unused()

    return cut.groupBy("shard").applyInArrow(sort, "pack bigint, shard bigint, payload binary")


def _settle(earliest: np.ndarray, positions: np.ndarray, heads: np.ndarray, size: np.ndarray) -> None:
    """All members of a class get the least value of any; classes of suffixes too short for a window do no harm."""
    if not len(heads):
        return
    owner, slot = _ranges(heads, size)
    value = earliest[positions[slot]]
    least = np.minimum.reduceat(value, np.cumsum(size) - size)
    earliest[positions[slot]] = least[owner]


def without_copied(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: id_col, n_bytes, removed (start and length of maximal runs of bytes), kept (the bytes that stay).

    A byte goes if a string of `least` bytes that covers it also starts in a document with a smaller id; strings lie
    within one document and are those of the input. Bytes are those of UTF-8, so a cut may part a character: kept is
    binary. A null text is an empty one; rows without an id lose nothing and are nobody's first; rows of the same id take
    nothing from each other. Texts shorter than `least` stay, very long ones are cut whole. An empty table gives no rows;
    other columns are ignored."""
    spark = docs.sparkSession
    packed = written(packs(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))), "packs")
    size = packed.agg(F.sum(F.element_at("ends", -1))).head()[0] or 0
    parts = partitions(spark, -(-size // PART_BYTES))
    bits = written(shared_hashes(packed, least, parts), "shared")
    hits = bits.agg(F.sum("hits")).head()[0] or 0
    shards = partitions(spark, -(-hits * (least + 20) // SHARD_BYTES))
    cut = cut_segments(packed, bits, least, parts, shards).repartition(partitions(spark, -(-shards // TASK_SHARDS)), "shard")
    told = written(first_documents(cut, least, shared_dir(spark)), "firsts")

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_bytes": [], "removed": [], "kept": []}
        for row in left.to_pylist():
            pack = Pack(row)
            gone = np.zeros(len(pack.text) + 1, np.int32)
            payloads = list(zip(right["shard"].to_pylist(), right["payload"].to_pylist(), strict=True))
            found = [_opened(p, np.int32, np.int32, np.int32, np.int64)[:4] for s, p in payloads if s >= 0]
            places = [_opened(p, np.int32, np.int64)[:2] for s, p in payloads if s < 0]
            if found and places:
                segment, offset, count, first = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.argsort(segment, kind="stable")
                segment, offset, count, first = segment[order], offset[order].astype(np.int64), count[order].astype(np.int64), first[order]
                number, at = places[0]
                ids = pack.ids[np.searchsorted(pack.ends, at, "right")]
                low, high = np.searchsorted(segment, number, "left"), np.searchsorted(segment, number, "right")
                who, run = _ranges(low, high - low)
                late = first[run] < ids[who]
                begin = at[who[late]] + offset[run[late]]
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + count[run[late]] + least - 1, -1)
                gone = np.cumsum(gone)
            start = 0
            for i, present, end in zip(pack.ids.tolist(), pack.present.tolist(), pack.ends.tolist(), strict=True):
                mask = gone[start:end] > 0
                whole = pack.text[start:end]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
                out["doc_id"].append(i if present else None)
                out["n_bytes"].append(end - start)
                out["removed"].append([{"start": a, "length": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
                out["kept"].append(np.frombuffer(whole, np.uint8)[~mask].tobytes() if len(edges) else whole)
                start = end
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], list(out))

    schema = "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,length:bigint>>, kept binary"
    return packed.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(remove, schema).withColumnRenamed("doc_id", id_col)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 50 bytes."""
    found = without_copied(table(spark, sf_dir, "documents"), 50)
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["length"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
