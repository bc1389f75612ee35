"""Suffix order and common prefixes of a shard by induced sorting with disk-backed priority queues.

A suffix is of type L if it is greater than its successor and of type S otherwise; leftmost S suffixes (seeds) part the
text into short substrings. Their substrings are named in order, the text of names is sorted by recursion unless all
differ, and the seeds' order induces that of all others: scanning suffixes upwards, each pushes its predecessor if that is
an L suffix, and scanning downwards if it is an S suffix. Both scans are the same function on mirrored symbols.

A text of names that fits into memory (BASE) is ordered there by doubling prefixes instead of by a further recursion.

The queue holds tuples (symbol, position, common prefix) in order of symbol and then of arrival. Tuples are pushed and
popped in batches: a batch is the longest run of tuples at the front of the queue that no push of the same batch can come
before, so it is worked off with array operations. A pushed tuple carries its common prefix with the one pushed into the
same bucket before: one more than the least common prefix between the two popped suffixes. As common prefixes are counted
up to `most` only, the latest place of each value is enough to look that minimum up over any distance.

Sorted runs of the queue and sequences of suffixes go to files in the scratch folder once they are longer than `rows`.
Text, names and seeds are arrays; in a folder on a mounted file system arrays above ARRAY_BYTES are mapped files, so the
shard's size is bounded by the folder, not by memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

from .common import filesystem

#: Tuples that a run or a sequence keeps in memory; bytes of an array in memory.
ROWS, ARRAY_BYTES = 1 << 20, 1 << 28
#: Tuples in files are read in pieces of so many; runs in memory before they are merged.
PIECE, MANY_RUNS = 1 << 16, 48
#: Symbols of a text of names that is ordered in memory.
BASE = 1 << 21


def _stable(keys: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers; those of a narrow range are sorted by digits."""
    if len(keys) < 2:
        return np.zeros(len(keys), np.int64)
    low = int(keys.min())
    if int(keys.max()) - low < 1 << 16:
        return np.argsort((keys - low).astype(np.uint16), kind="stable")
    return np.argsort(keys, kind="stable")


def _in_kind(value: int, like: np.ndarray) -> np.generic:
    """value as a number of the array's own kind, or the greatest one, so that the array need not be converted."""
    return like.dtype.type(min(value, np.iinfo(like.dtype).max))


def _small(top: int) -> type:
    return np.int32 if top < 1 << 30 else np.int64


class Scratch:
    """Files of one shard, in a new folder under uri that is made when first needed and deleted in the end."""

    def __init__(self, uri: str, rows: int = ROWS, array_bytes: int = ARRAY_BYTES, base: int = BASE):
        self.uri, self.rows, self.array_bytes, self.base, self.fs = f"{uri}/scratch-{uuid.uuid4().hex}", rows, array_bytes, base, None

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        if self.fs is not None:
            self.fs.delete_dir(self.path)

    def new(self) -> str:
        if self.fs is None:
            self.fs, self.path = filesystem(self.uri)
            self.fs.create_dir(self.path, recursive=True)
        return f"{self.path}/{uuid.uuid4().hex}"

    def array(self, n: int, kind: type, fill: int | None = None) -> np.ndarray:
        """An array, in a mapped file where it is large and the folder is mounted."""
        from pyarrow import fs

        if n * np.dtype(kind).itemsize <= self.array_bytes or not isinstance(filesystem(self.uri)[0], fs.LocalFileSystem):
            return np.full(n, fill, kind) if fill else np.zeros(n, kind)
        found = np.memmap(self.new(), kind, "w+", shape=(n,))
        if fill:
            found[:] = fill
        return found


class Run:
    """Columns of equal length, all in memory or all in files, read by ranges."""

    def __init__(self, scratch: Scratch, columns: list[np.ndarray]):
        self.length, self.scratch, self.files = len(columns[0]), scratch, None
        self.columns = columns
        if self.length >= scratch.rows:
            paths = [scratch.new() for _ in columns]
            for path, column in zip(paths, columns, strict=True):
                with scratch.fs.open_output_stream(path) as out:
                    out.write(np.ascontiguousarray(column).data)
            self.kinds, self.columns = [c.dtype for c in columns], None
            self.files = [scratch.fs.open_input_file(p) for p in paths]
        self.at, self.head_at, self.head = 0, 0, None

    def read(self, begin: int, end: int) -> list[np.ndarray]:
        if self.columns is not None:
            return [c[begin:end] for c in self.columns]
        return [np.frombuffer(f.read_at((end - begin) * k.itemsize, begin * k.itemsize), k) for f, k in zip(self.files, self.kinds, strict=True)]

    def upto(self, limit: int, most: int) -> tuple[list[np.ndarray], bool]:
        """The tuples from `at` with a key of at most limit, no more than `most`; whether there may be more of them."""
        if self.columns is not None:
            limit = _in_kind(limit, self.columns[0])
            end = int(np.searchsorted(self.columns[0][self.at :], limit, "right")) + self.at
            return self.read(self.at, min(end, self.at + most)), end > self.at + most
        while True:
            if self.head is None or self.at >= self.head_at + len(self.head[0]):
                self.head_at, self.head = self.at, self.read(self.at, min(self.length, self.at + PIECE))
            skip = self.at - self.head_at
            keys = self.head[0][skip:]
            end = int(np.searchsorted(keys, _in_kind(limit, keys), "right"))
            whole = end < len(keys) or self.head_at + len(self.head[0]) >= self.length
            if whole or end >= most:
                return [c[skip : skip + min(end, most)] for c in self.head], end > most or not whole
            more = self.read(self.head_at + len(self.head[0]), min(self.length, self.head_at + len(self.head[0]) + PIECE))
            self.head = [np.concatenate([c[skip:], m]) for c, m in zip(self.head, more, strict=True)]
            self.head_at = self.at

    def first(self) -> int:
        if self.columns is None and (self.head is None or not self.head_at <= self.at < self.head_at + len(self.head[0])):
            self.head_at, self.head = self.at, self.read(self.at, min(self.length, self.at + PIECE))
        return int(self.columns[0][self.at]) if self.columns is not None else int(self.head[0][self.at - self.head_at])

    def close(self) -> None:
        for f in self.files or []:
            f.close()


class Queue:
    """Tuples (key, others) by key and then by arrival: sorted runs, older ones first, merged in memory while they are alike in length."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.runs, self.span, self.found = scratch, [], 1, None

    def push(self, keys: np.ndarray, *others: np.ndarray, ordered: bool = False) -> None:
        if not len(keys):
            return
        columns = [keys, *others]
        if not ordered:
            order = _stable(keys)
            columns = [c[order] for c in columns]
        self.runs.append(Run(self.scratch, columns))
        if len(self.runs) > MANY_RUNS and self.runs[-1].columns is not None:
            self._merge()

    def _merge(self) -> None:
        """The youngest runs in memory become one, as long as they are no longer than a run in memory may be."""
        first, total = len(self.runs), 0
        while first and (run := self.runs[first - 1]).columns is not None and total + run.length - run.at < self.scratch.rows:
            first, total = first - 1, total + run.length - run.at
        some = [r.read(r.at, r.length) for r in self.runs[first:]]
        if len(some) > 1:
            columns = [np.concatenate(c) for c in zip(*some, strict=True)]
            order = _stable(columns[0])
            self.runs[first:] = [Run(self.scratch, [c[order] for c in columns])] if total else []

    def front(self) -> list[np.ndarray] | None:
        """Tuples at the front in their order, about twice as many as the last batch; None at the end."""
        for run in [r for r in self.runs if r.at >= r.length]:
            run.close()
        self.runs = [r for r in self.runs if r.at < r.length]
        if not self.runs:
            return None
        limit = min(r.first() for r in self.runs) + self.span - 1
        parts, bound, upto = [], None, 0
        for i, run in enumerate(self.runs):
            part, more = run.upto(limit, self.scratch.rows)
            parts.append(part)
            if more and (bound is None or part[0][-1] < bound):
                bound, upto = int(part[0][-1]), i
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if len(parts) > 1 else parts[0]
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
        if self.span > 1 and len(parts) > 1:
            order = _stable(columns[0])
            columns, owner = [c[order] for c in columns], owner[order]
        if bound is not None:  # what a run did not show may come before the others' later tuples
            sure = int(np.argmin(np.append((columns[0] < bound) | ((columns[0] == bound) & (owner <= upto)), False)))
            columns, owner = [c[:sure] for c in columns], owner[:sure]
        self.found = owner
        return columns

    def take(self, count: int) -> None:
        """The first `count` tuples of the front are done."""
        for run, n in zip(self.runs, np.bincount(self.found[:count], minlength=len(self.runs)).tolist(), strict=True):
            run.at += n
        if 2 * count >= len(self.found):
            self.span = min(self.span * 2, 1 << 40)
        elif 4 * count < len(self.found):
            self.span = max(1, self.span // 2)


class Sequence:
    """Columns appended batch by batch and read back in either direction."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.runs, self.waiting, self.n = scratch, [], [], 0

    def append(self, *columns: np.ndarray) -> None:
        self.waiting.append(columns)
        self.n += len(columns[0])
        if self.n >= self.scratch.rows:
            self._close()

    def _close(self) -> None:
        if self.waiting:
            self.runs.append(Run(self.scratch, [np.concatenate(c) for c in zip(*self.waiting, strict=True)]))
            self.waiting, self.n = [], 0

    def backwards(self) -> Iterator[list[np.ndarray]]:
        """All columns from the last tuple to the first, in blocks."""
        self._close()
        for run in reversed(self.runs):
            for end in range(run.length, 0, -self.scratch.rows):
                yield [c[::-1] for c in run.read(max(0, end - self.scratch.rows), end)]


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at a and b share, up to most."""
    out = np.zeros(len(a), np.int64)
    active, n = np.flatnonzero(most > 0), 0
    here, there, limit = a[active].astype(np.int64), b[active].astype(np.int64), most[active]
    while len(active):
        same = text[here] == text[there]
        n += 1
        over = ~same | (limit <= n)
        ended = np.flatnonzero(over)
        if len(ended):
            out[active[ended]] = n - 1 + same[ended]
            going = np.flatnonzero(~over)
            active, here, there, limit = active[going], here[going], there[going], limit[going]
        here += 1
        there += 1
    return out


def _least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] of each query, first <= last, by tables of doubling width."""
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[first[here]], table[last[here] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def induced(scratch: Scratch, text: np.ndarray, top: int, down: bool, seeds: Iterator[tuple[np.ndarray, np.ndarray]], most: int, every: bool) -> Sequence:
    """The suffixes that seeds (position, common prefix with the one before, blocks in scanning order) induce, in scanning order: position and common prefix.

    Keys are symbols, or top less the symbol for the scan downwards. A suffix of a key stands before the seeds of that key.
    With every, seeds are among the result, and common prefixes are those with the suffix before in the whole order;
    else they are those with the suffix before that was induced, 0 for the first of a bucket."""
    queue, out = Queue(scratch), Sequence(scratch)
    kind, place_kind, count_kind = _small(top), _small(len(text)), np.uint8 if most < 255 else np.int32
    key_of = (lambda at: kind(top) - text[at].astype(kind)) if down else (lambda at: text[at].astype(kind))
    for at, shared in seeds:
        queue.push(2 * key_of(at) + 1, at.astype(place_kind), shared.astype(count_kind), ordered=True)
    last_push = scratch.array(top + 1, np.int64)  # the place after the one that pushed into a bucket last; 0 if none has
    latest = np.full(most + 1, -1, np.int64)  # latest[v]: the last place whose common prefix is v or less
    begin, before = 0, (-1, -1)
    while (front := queue.front()) is not None:
        key, at, own = front
        symbol, seed = key >> 1, (key & 1).astype(bool)
        previous = key_of(np.maximum(at - 1, 0))
        pushes = (at > 0) & ((previous > symbol) | ((previous == symbol) & ~seed))
        count = len(key)
        if key[0] != key[-1]:  # of one key all may go, as its pushes come behind it
            ahead = np.minimum.accumulate(np.where(pushes, 2 * previous, np.iinfo(kind).max))
            count = int(np.argmin(np.append(key[1:] <= ahead[:-1], False))) + 1
        queue.take(count)
        if count < len(key):
            key, at, own, symbol, seed, previous, pushes = (x[:count] for x in (key, at, own, symbol, seed, previous, pushes))
        # the common prefix with the suffix popped before: carried within a kind, nothing between buckets, counted where kinds meet
        if key[0] == key[-1]:
            full = own.copy()
            full[0] = own[0] if before[0] == key[0] else 0
            seam = np.flatnonzero([before[0] >> 1 == symbol[0] and before[0] != key[0]])
        else:
            former = np.empty_like(key)
            former[0], former[1:] = before[0], key[:-1]
            full = np.where(former == key, own, count_kind(0))
            seam = np.flatnonzero((former != key) & (former >> 1 == symbol) & (former >= 0))
        if len(seam):
            partner = np.where(seam > 0, at[seam - 1], before[1])
            full[seam] = common(text, at[seam], partner, np.full(len(seam), most))
        before = (int(key[-1]), int(at[-1]))
        if every:
            out.append(at, full)
        else:
            out.append(at[~seed], own[~seed])
        # pushes, by bucket and then in order
        who = np.flatnonzero(pushes)
        if len(who):
            order = _stable(previous[who])
            who, bucket = who[order], previous[who][order]
            first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            since = np.empty(len(who), np.int64)  # the pusher into the same bucket before, as a place
            since[1:] = who[:-1] + begin
            since[first] = last_push[bucket[first]] - 1
            shared = np.empty(len(who), count_kind)
            near = np.flatnonzero(since >= begin)
            shared[near] = _least_between(full, since[near] - begin + 1, who[near])
            far = np.flatnonzero(since < begin)
            past = np.minimum(np.searchsorted(latest, since[far], "right"), most).astype(count_kind)
            shared[far] = np.minimum(past, np.minimum.accumulate(full)[who[far]])
            shared = np.where(since < 0, count_kind(0), np.minimum(shared, most - 1) + count_kind(1))
            ends = np.append(first[1:], True)
            last_push[bucket[ends]] = who[ends] + begin + 1
            queue.push(2 * bucket, at[who] - 1, shared, ordered=True)
        place = np.full(most + 1, -1, np.int64)
        place[np.minimum(full, most)] = np.arange(begin, begin + count)
        latest = np.maximum(latest, np.maximum.accumulate(place))
        begin += count
    return out


def _seed_places(scratch: Scratch, text: np.ndarray) -> np.ndarray:
    """Where S suffixes follow L suffixes, the end included."""
    n, found, size = len(text), [], scratch.rows
    later = False  # the type of the suffix behind the block: the end counts as S, what stands before it is L
    for end in range(n - 1, 0, -size):
        begin = max(0, end - size)
        here = text[begin : end + 1]
        known = np.flatnonzero(np.append(here[1:] != here[:-1], True))
        # rising: S, falling: L, equal: like the next
        kind = np.repeat(np.append(here[1:] > here[:-1], later)[known], np.diff(known, prepend=-1))[:-1]
        ahead = np.append(kind, later if end < n - 1 else True)
        found.append(np.flatnonzero(~ahead[:-1] & ahead[1:]) + begin + 1)
        later = bool(kind[0])
    return np.concatenate(found[::-1]) if found else np.zeros(0, np.int64)


def _ordered(scratch: Scratch, keys: np.ndarray) -> np.ndarray:
    """An order of keys; beyond memory by sorted runs of the queue."""
    if len(keys) <= 2 * scratch.rows:
        return np.argsort(keys)
    queue, out, at = Queue(scratch), scratch.array(len(keys), np.int64), 0
    for begin in range(0, len(keys), scratch.rows):
        some = np.asarray(keys[begin : begin + scratch.rows])
        queue.push(some, np.arange(begin, begin + len(some)))
    while (front := queue.front()) is not None:
        out[at : at + len(front[1])] = front[1]
        at += len(front[1])
        queue.take(len(front[1]))
    return out


def _names(scratch: Scratch, text: np.ndarray, top: int, seeds: np.ndarray) -> tuple[np.ndarray, int]:
    """The name of each seed's substring, up to the next seed inclusive, in order; how many names there are.

    Substrings are compared by pieces that fit into a number, and only those still alike go on. One that ends while another
    goes on is the greater one, as its last symbol is of type S and the other's is not."""
    pad = top + 1
    bits = max(1, int(pad).bit_length())
    fits = max(1, 62 // bits)
    length = np.append(np.diff(seeds) + 1, 1)

    def piece(which: np.ndarray, offset: int) -> np.ndarray:
        key = np.zeros(len(which), np.int64)
        at, size = seeds[which], length[which]
        for o in range(offset, offset + fits):
            key = (key << bits) | np.where(o < size, text[np.minimum(at + o, len(text) - 1)], pad).astype(np.int64)
        return key

    keys = scratch.array(len(seeds), np.int64)
    for begin in range(0, len(seeds), scratch.rows):
        which = np.arange(begin, min(len(seeds), begin + scratch.rows))
        keys[which] = piece(which, 0)
    order = _ordered(scratch, keys)
    new = np.ones(len(order), bool)
    for begin in range(0, len(order), scratch.rows):
        some = keys[order[max(0, begin - 1) : begin + scratch.rows]]
        new[max(1, begin) : begin + len(some) - (begin > 0)] = some[1:] != some[:-1]
    offset = fits
    while True:
        alike = ~new
        alike[:-1] |= ~new[1:]
        alike &= length[order] >= offset
        slots = np.flatnonzero(alike)  # places of substrings that are alike so far and go on, or end just here
        if not len(slots):
            break
        group = np.cumsum(new)[slots]
        more = piece(order[slots], offset)
        inner = np.lexsort((more, group))
        order[slots] = order[slots][inner]
        more, group = more[inner], group[inner]
        new[slots[1:]] |= (more[1:] != more[:-1]) & (group[1:] == group[:-1])
        offset += fits
    names = scratch.array(len(seeds), np.int64)
    names[order] = np.cumsum(new) - 1
    return names, int(new.sum())


def _ordered_in_memory(names: np.ndarray, seeds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of names in order, and the common prefix of each with the one before, until `most` symbols of the text below are reached; by doubling prefixes of those still alike."""
    n = len(names)
    order = _stable(names)
    rank = np.empty(n, np.int64)
    here = names[order]
    new = np.concatenate([[True], here[1:] != here[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = 1
    while True:
        alike = ~new
        alike[:-1] |= ~new[1:]
        slots = np.flatnonzero(alike)
        if not len(slots):
            break
        some = order[slots]
        behind = rank[some + width]  # the last symbol is like no other, so suffixes that are alike do not reach it
        inner = np.argsort(rank[some] << 32 | behind)
        some, behind = some[inner], behind[inner]
        order[slots] = some
        apart = np.concatenate([[False], (behind[1:] != behind[:-1]) & (rank[some[1:]] == rank[some[:-1]])])
        new[slots] |= apart
        rank[some] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        width *= 2
    shared = np.zeros(n, np.int64)
    enough = np.searchsorted(seeds, seeds + most) - np.arange(n)
    shared[1:] = common(names, order[:-1], order[1:], enough[order[1:]])
    return order, shared


def suffix_order(scratch: Scratch, text: np.ndarray, top: int, most: int) -> Iterator[list[np.ndarray]]:
    """(positions, common prefixes with the next greater suffix, up to most) of all suffixes but the last, from the greatest down, in blocks.

    text has symbols from 0 to top, of which 0 is the last one and no other."""
    seeds = _seed_places(scratch, text)
    if not len(seeds):
        return
    names, n = _names(scratch, text, top, seeds)
    if n == len(seeds):
        order = scratch.array(n, np.int64)
        order[names] = np.arange(n)
        shared = scratch.array(n, np.int64)
    elif len(seeds) <= scratch.base:
        order, shared = _ordered_in_memory(names, seeds, most)
    else:
        order, shared = scratch.array(len(seeds), np.int64), scratch.array(len(seeds), np.int64)
        end = len(seeds)
        for places, prefix in suffix_order(scratch, names, n - 1, most):
            order[end - len(places) : end] = places[::-1]
            # a suffix's prefix with the greater one belongs to the greater one in ascending order
            shared[end - len(places) + 1 : end + 1] = prefix[::-1][: len(shared[end - len(places) + 1 : end + 1])]
            end -= len(places)
        order[0] = len(seeds) - 1

    def upwards() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Seeds in ascending order with their common prefixes in symbols of text."""
        for begin in range(0, len(order), scratch.rows):
            here = np.asarray(order[begin : begin + scratch.rows])
            former = np.asarray(order[begin - 1 : begin + len(here) - 1]) if begin else np.concatenate([here[:1], here[:-1]])
            names_shared = np.asarray(shared[begin : begin + scratch.rows])
            last = len(seeds) - 1
            a, b = seeds[np.minimum(here + names_shared, last)], seeds[np.minimum(former + names_shared, last)]
            base = np.minimum(a - seeds[here], most)
            total = np.minimum(base + common(text, a, b, np.where(here == former, 0, most - base)), most)
            yield seeds[here], total

    rising = induced(scratch, text, top, False, upwards(), most, every=False)

    def downwards() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        carried = 0
        for at, own in rising.backwards():
            yield at, np.concatenate([[carried], own[:-1]])
            carried = own[-1]

    falling = induced(scratch, text, top, True, downwards(), most, every=True)
    falling._close()
    for run in falling.runs:
        for begin in range(0, run.length, scratch.rows):
            yield run.read(begin, min(run.length, begin + scratch.rows))
