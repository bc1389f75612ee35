"""Packing documents into token sequences by patterns of lengths.

Only the histogram of piece lengths, at most `capacity` numbers, reaches the driver. There, patterns of a few lengths
that fill a sequence closely are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares and rounded to the nearest that is left, and the rest is packed best fit, longest first, whole counts of equal lengths at a time.
The plan says, for each length, which ranks go to which sequence and offset; ranks are given out over hashed shards, so
neither a common length nor a common document meets in one task.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, slices, table, written
from .tokens import GROUP_BYTES, id_encoder

Pattern = tuple[int, ...]
#: Lengths in a fitted pattern, second lengths tried for each first, unused share that a pattern may have, shards for ranks.
FEW, SECONDS, WASTE, SHARDS = 4, 12, 1 / 64, 256
#: Steps of the fit, patterns that come in at a step, rounds of a least squares solution, each at most.
STEPS, ENTER, SOLVE = 60, 64, 150


def patterns(lengths: list[int], capacity: int) -> list[Pattern]:
    """Close patterns of at most FEW of these ascending lengths: each first and a spread of second lengths, completed by the longest that fit."""
    found: set[Pattern] = set()
    for first in lengths:
        room = bisect.bisect_right(lengths, min(first, capacity - first))
        picks = {lengths[(room - 1) * i // max(SECONDS - 1, 1)] for i in range(SECONDS)} if room else set()
        for start in [(first,), *((first, s) for s in picks)]:
            left = capacity - sum(start)
            while len(start) < FEW and (at := bisect.bisect_right(lengths, left)):
                start += (lengths[at - 1],)
                left -= lengths[at - 1]
            if left <= capacity * WASTE:
                found.add(tuple(sorted(start, reverse=True)))
    return sorted(found, reverse=True)


def _least_squares(row: np.ndarray, col: np.ndarray, times: np.ndarray, wanted: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The counts that bring the columns (sparse: row, column, times) closest to `wanted`, by conjugate gradients from `start`."""
    of = lambda v: np.bincount(row, times * v[col], len(wanted))
    x, left = start.copy(), wanted - of(start)
    down = slope = np.bincount(col, times * left[row], len(x))
    size = first = float(slope @ slope)
    for _ in range(SOLVE):
        if size <= 1e-10 * first or size == 0:
            break
        moved = of(down)
        step = size / float(moved @ moved)
        x, left = x + step * down, left - step * moved
        slope = np.bincount(col, times * left[row], len(x))
        size, last = float(slope @ slope), size
        down = slope + size / last * down
    return x


def fit(found: list[Pattern], histogram: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths close to the histogram in the least squares sense, by an active set.

    At each step the patterns whose lengths are wanted most come in, no two of one length; of those that are in, the ones
    that a least squares fit puts at zero or below go out until none is. The closest fit of all steps is taken. So few
    more patterns than lengths are ever in, and their counts are large enough to be rounded."""
    sets = [sorted(set(p)) for p in found]
    col = np.repeat(np.arange(len(found)), [len(x) for x in sets])
    row = np.array([n for x in sets for n in x], np.int64)
    times = np.array([float(p.count(n)) for p, x in zip(found, sets, strict=True) for n in x])
    norm = np.sqrt(np.bincount(col, times * times, len(found)))
    wanted = np.asarray(histogram, float)
    x = best = np.zeros(len(found))
    closest = float(np.linalg.norm(wanted))
    for _ in range(STEPS if len(found) else 0):
        left = wanted - np.bincount(row, times * x[col], len(wanted))
        gain = np.bincount(col, times * left[row], len(found)) / norm
        gain[x > 0] = 0
        active, taken, fresh = x > 0, set(), 0
        for j in np.argsort(-gain, kind="stable")[: 4 * ENTER].tolist():
            if gain[j] > 1e-6 and fresh < ENTER and taken.isdisjoint(sets[j]):
                active[j] = True
                taken.update(sets[j])
                fresh += 1
        if not fresh:
            break
        while active.any():
            place = np.cumsum(active) - 1
            some = active[col]
            z = _least_squares(row[some], place[col[some]], times[some], wanted, x[active])
            low = z <= 0
            x = np.zeros(len(found))
            x[np.flatnonzero(active)[~low]] = z[~low]
            if not low.any():
                break
            active = x > 0
        off = float(np.linalg.norm(wanted - np.bincount(row, times * x[col], len(wanted))))
        if off < closest:
            closest, best = off, x
    return best


def best_fit(histogram: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing on counts: equal pieces that meet equal room move together, so the work depends on the number of lengths, not of pieces."""
    rooms: list[int] = []
    bins: dict[int, list[list]] = {}

    def add(room: int, pattern: Pattern, n: int) -> None:
        if room not in bins:
            bins[room] = []
            bisect.insort(rooms, room)
        bins[room].append([pattern, n])

    for length in range(capacity, 0, -1):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                for n, k in ((left // each, each), (1, left % each)):
                    if n and k:
                        add(capacity - k * length, (length,) * k, n)
                break
            room = rooms[at]
            group = bins[room][-1]
            n = min(left, group[1])
            left -= n
            if group[1] == n:
                bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                group[1] -= n
            add(room - length, (*group[0], length), n)
    return [(p, n) for groups in bins.values() for p, n in groups]


def plan(histogram: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """(lengths of a sequence, how many such sequences), covering the histogram exactly."""
    left = list(histogram)
    out: list[tuple[Pattern, int]] = [((capacity,), left[capacity])] if left[capacity] else []
    left[capacity] = 0
    present = [n for n in range(1, capacity) if left[n]]
    found = patterns(present, capacity)
    for x, p in sorted(zip(fit(found, np.array(left)).tolist(), found, strict=True), reverse=True):
        n = min([int(x + 0.5), *(left[k] // p.count(k) for k in set(p))])
        if n > 0:
            out.append((p, n))
            for k in p:
                left[k] -= n
    return out + best_fit(left, capacity)


def slots(planned: list[tuple[Pattern, int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Ascending (length and first rank as one key), first sequence and offset of each run of ranks."""
    given, base, rows = [0] * (capacity + 1), 0, []
    for pattern, n in planned:
        offset = 0
        for length in pattern:
            rows.append((length << 44 | given[length], base, offset))
            given[length] += n
            offset += length
        base += n
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The ids of each whole text and end_id behind them, cut only where they exceed `capacity`: doc_id, piece, start, length, ids_crc32 (and ids)."""
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, step = id_encoder(path), struct.pack("<I", end_id), 4 * capacity
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), bytes_of(batch.column(1))
            for a, b in slices(texts, GROUP_BYTES):  # so that a task holds the ids of one group at a time
                rows = [(k, i, at // 4, raw[at : at + step]) for k, x in zip(keys[a:b], encoder.encode(texts[a:b]), strict=True) for raw in (x + end,) for i, at in enumerate(range(0, len(raw), step))]
                columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([len(r[3]) // 4 for r in rows], pa.int64()), pa.array([zlib.crc32(r[3]) for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([r[3] for r in rows], pa.binary())] * with_ids, names)
            pa.default_memory_pool().release_unused()

    return chosen.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with doc_id, piece, start, length (1 to capacity), ids_crc32 and maybe ids, which is read twice.

    Sequences are filled from offset 0 without gaps and hold at most `capacity`. Repeated rows and ids are pieces of
    their own; an empty table stays empty."""
    spark = cut.sparkSession
    histogram = [0] * (capacity + 1)
    for r in cut.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[r["length"]] = r["count"]
    shared = spark.sparkContext.broadcast(slots(plan(histogram, capacity), capacity))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(SHARDS)).cast("int")
    rows = cut.withColumn("shard", shard)
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "shard").count().select("length", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.join(counts, ["length", "shard"]).withColumn("rank", F.col("base") + F.row_number().over(order) - 1)
    key = F.shiftleft(F.col("length"), 44).bitwiseOR(F.col("rank")).alias("key")
    names = [*cut.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, offset = shared.value
        for batch in batches:
            key = batch.column(0).to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(base[at] + key - keys[at]), pa.array(offset[at])], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.select(key, *cut.columns).mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, (ids, little-endian 4-byte integers,) sequence_id, offset.

    A null text is empty: its one piece is end_id. Null and repeated doc_ids stay, row by row. Very long texts become
    many pieces. An empty table gives no rows. Other columns are ignored, whatever their names."""
    return pack(written(pieces(docs, path, capacity, end_id, id_col, text, with_ids), "pieces"), capacity).withColumnRenamed("doc_id", id_col)


def sequences(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, and parts in order (offset, doc_id, piece, ids as little-endian 4-byte integers). What goes for pack_documents goes here."""
    part = F.struct("offset", "doc_id", "piece", "ids")
    return pack_documents(docs, path, capacity, end_id, with_ids=True).groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("parts"))


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
