"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full shingle sets and union-find grouping.

SuperMinHash gives every shingle one permutation of the signature's slots, drawn step by step; the shingle's value in
slot p is its step plus a fraction, and a slot keeps the least value that any shingle has brought. As no slot can fall
below a step that all slots have reached, drawing stops early; values within a signature are correlated so that the
estimate varies less than that of independent hashes.

BANDS bands of ROWS slots each become bucket keys. Equal word sequences are one class before anything is compared.
Within a bucket, pairs are taken between members of different components only, first of a hub with the others, then, in
buckets that verified links have not made one component, of all that are left; so copies never become all pairs. The
large joins are sort-merge joins at every size, so that a plan which fits on a sample is the plan that runs on it all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, salted_join, table, written

#: A pair with Jaccard 0.85 shares no band with probability (1 - 0.85**6)**42, about 2e-9.
BANDS, ROWS = 42, 6
SLOTS = BANDS * ROWS
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, SLOTS + 1, dtype=np.uint64) * _ODD
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 65)], np.uint64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Word hashes that a worker keeps.
KEPT_WORDS = 200_000
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, k: int = 5) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the k-word shingles, A-Z lowered; of fewer words, the hash of them all; of none, nothing."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > KEPT_WORDS:
        _words.clear()
    known = list(map(_words.get, words))
    if None in known:
        for w, h in zip(words, known, strict=True):
            if h is None:
                _words[w] = xxhash.xxh3_64_intdigest(w)
        known = list(map(_words.get, words))
    h = np.array(known, np.uint64)
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = _mix(out * _ODD + h[i : len(h) - k + 1 + i])
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def super_minhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """For each slot the least value, as step << 32 | fraction, over all elements (64-bit hashes)."""
    values = np.full(slots, np.uint64(slots) << np.uint64(32), np.uint64)
    step_of = np.uint64(32)
    at = 0
    while at < len(elements):
        last = int(values.max() >> step_of)  # no later step can lower any slot
        part = elements[at : at + (1 << 16 if last == 0 else 512)]
        at += len(part)
        places = np.tile(np.arange(slots, dtype=np.int16), (len(part), 1)) if last else None
        rows = np.arange(len(part))
        for j in range(min(last + 1, slots)):
            if j > int(values.max() >> step_of):
                break
            drawn = _mix(part + _STEPS[j])
            pick = (j + (drawn >> step_of) % np.uint64(slots - j)).astype(np.int64)
            if places is None:
                slot = pick
            else:
                slot = places[rows, pick]
                places[rows, pick] = places[:, j]
            np.minimum.at(values, slot, (np.uint64(j) << step_of) | (drawn & np.uint64(0xFFFFFFFF)))
    return values


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, as signed integers."""
    rows = _mix(signature.reshape(BANDS, ROWS) * _POWERS[:ROWS]).sum(axis=1, dtype=np.uint64)
    return _mix(rows + np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD).view(np.int64)


def sketches(rows: DataFrame, k: int = 5) -> DataFrame:
    """missing, doc_id, content as they are; key (of the word sequence; null without words), n_shingles, bands of the text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, sizes, found = [], [], []
            for t in bytes_of(batch.column(3)):
                s = shingle_set(t, k)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(b" ".join(t.translate(_LOWER).split())) if len(s) else None)
                found.append(bands(super_minhash(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["missing", "doc_id", "content", "key", "n_shingles", "bands"])
            pa.default_memory_pool().release_unused()

    return rows.select("missing", "doc_id", "content", "text").mapInArrow(sketch, "missing boolean, doc_id bigint, content bigint, key binary, n_shingles bigint, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, k: int = 5) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' full shingle sets have 100 * intersection >= percent * union."""
    of = lambda end: texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")).hint("merge")
    both = pairs.join(of("b"), "b").join(of("a"), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for x, tx, ty in zip(a, bytes_of(batch.column(2)), bytes_of(batch.column(3)), strict=True):
                if x != hub:
                    hub, hub_set = x, shingle_set(tx, k)
                other = shingle_set(ty, k)
                joint = len(np.intersect1d(hub_set, other, assume_unique=True))
                keep.append(100 * joint >= percent * (len(hub_set) + len(other) - joint) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
            pa.default_memory_pool().release_unused()

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


class UnionFind:
    """Sets of numbers, each named by its least one."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def unite(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def rows(self) -> pa.RecordBatch:
        """(node, root) of every node that is not its own root: links of the same sets, fewer than nodes."""
        pairs = [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["node", "root"])


def forest(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges that a task holds, by union-find within the task; it links the same nodes with fewer rows."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = UnionFind()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sets.unite(a, b)
            if len(sets.parent) > 1_000_000:  # what a task keeps is bounded
                yield sets.rows()
                sets = UnionFind()
        yield sets.rows()

    return edges.mapInArrow(unite, "node bigint, root bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node reachable. Union-find within tasks, then rounds of least labels and pointer jumps across them, each written to the shared folder."""
    links = written(forest(edges), "links")
    labels = written(links.select(F.explode(F.array("node", "root")).alias("node"), F.least("node", "root").alias("label")).groupBy("node").agg(F.min("label").alias("label")), "labels")
    both = links.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links.select(F.col("root").alias("a"), F.col("node").alias("b")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("label").alias("near"))
        least = labels.join(near.withColumnRenamed("b", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = written(least.join(jump, "label", "left").select("node", "old", F.least("label", "jump").alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")


def joint_sizes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The exact size of each left set's intersection with each right set, by products of incidence matrices over slices of the shingles."""
    owner = np.repeat(np.arange(len(right)), [len(x) for x in right])
    every = np.concatenate([np.zeros(0, np.uint64), *right])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    distinct, place = np.unique(every, return_inverse=True)
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(distinct), 16_384):
        part = distinct[at : at + 16_384]
        a = np.zeros((len(left), len(part)), np.float32)
        for i, x in enumerate(left):
            cut = x[np.searchsorted(x, part[0]) : np.searchsorted(x, part[-1], "right")]
            k = np.searchsorted(part, cut)
            a[i, k[part[k] == cut]] = 1
        b = np.zeros((len(right), len(part)), np.float32)
        low, high = np.searchsorted(place, [at, at + len(part)])
        b[owner[low:high], place[low:high] - at] = 1
        total += a @ b.T
    return total.astype(np.int64)


def links_between(groups: DataFrame, texts: DataFrame, percent: int, k: int = 5, block: int = 192) -> DataFrame:
    """Links (a, b) that join the same nodes as all links between members of one hub's group that are in different components.

    groups: hub, rep, comp and core (whether comp is the hub's). Two core members need no comparison, so each block of
    the others meets each block of all; a task holds two blocks whatever the size of the group, and gives a forest of
    its links, fewer than its members."""
    sizes = groups.groupBy("hub").agg(F.count("*").alias("m"), F.count_if(~F.col("core")).alias("u")).where("u > 0")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    sized = salted_join(groups, sizes.select("hub", blocks("m").alias("nm"), blocks("u").alias("nu")), "hub", "rep").join(texts.select(F.col("node").alias("rep"), "text").hint("merge"), "rep")
    hashed = F.xxhash64("rep")
    right = sized.select("hub", "rep", "comp", "text", F.explode(F.sequence(F.lit(0), F.col("nu") - 1)).alias("i"), F.pmod(hashed, "nm").cast("int").alias("j"), F.lit(False).alias("left"))
    left = sized.where(~F.col("core")).select("hub", "rep", "comp", "text", F.pmod(hashed, "nu").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("j"), F.lit(True).alias("left"))

    def compare(rows: pa.Table) -> pa.Table:
        rep, comp, is_left = (rows.column(n).to_numpy() for n in ("rep", "comp", "left"))
        sets = [shingle_set(t, k) for t in bytes_of(rows.column("text").combine_chunks())]
        size = np.array([len(x) for x in sets])
        x, y = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        joint = joint_sizes([sets[i] for i in x], [sets[i] for i in y])
        near = (100 * joint >= percent * (size[x][:, None] + size[y] - joint)) & (comp[x][:, None] != comp[y])
        found = UnionFind()
        for i, j in np.argwhere(near).tolist():
            found.unite(int(rep[x[i]]), int(rep[y[j]]))
        return pa.Table.from_batches([found.rows()]).rename_columns(["a", "b"])

    return left.unionByName(right).groupBy("hub", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def handled(docs: DataFrame, id_col: Column, text: Column, content: Column) -> DataFrame:
    """Columns of the rows that grouping works on: missing and doc_id (0 if missing), content (a hash that tells rows of one id apart), text."""
    return docs.select(id_col.isNull().alias("missing"), F.coalesce(id_col.cast("bigint"), F.lit(0)).alias("doc_id"), content.alias("content"), text.alias("text"))


_HANDLE = ["missing", "doc_id", "content"]


def near_groups(rows: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """For each row (missing, doc_id, content, text): missing, doc_id, content, n_shingles, and least: the least (missing, doc_id, content) of its group, null without words.

    Equal word sequences are one class, a node of its own number; components of verified links between classes are the
    groups. So an id that stands for several texts joins nothing, and rows without an id come last in their group."""
    sketched = written(sketches(rows, k), "sketches")
    classes = sketched.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(*_HANDLE)).alias("least"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = keys.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = written(keys.join(hubs.hint("merge"), "bucket").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "least.*").hint("merge"), "node")
    known = written(rows.select(*_HANDLE, "text").join(asked.hint("merge"), _HANDLE).select("node", "text").dropDuplicates(["node"]), "near-texts")
    first = written(verified(pairs, known, percent, k), "links")
    labels = components(first)
    # documents that share a bucket share its hub's group
    comp = lambda c: F.coalesce(F.col("component"), F.col(c))
    at_hub = pairs.select("a").distinct().join(labels.withColumnRenamed("node", "a").hint("merge"), "a", "left").select("a", comp("a").alias("hub_comp"))
    members = salted_join(pairs.join(labels.withColumnRenamed("node", "b").hint("merge"), "b", "left").select("a", "b", comp("b").alias("comp")), at_hub, "a", "b")
    groups = written(members.select(F.col("a").alias("hub"), F.col("b").alias("rep"), "comp", (F.col("comp") == F.col("hub_comp")).alias("core")), "groups")
    second = written(links_between(groups, known, percent, k), "links")
    labels = written(classes.select("node", "key", "least").join(components(first.unionByName(second)).hint("merge"), "node", "left"), "labelled")
    grouped = labels.where("component IS NOT NULL")
    least = grouped.groupBy("component").agg(F.min("least").alias("all_least"))
    ends = salted_join(grouped.select("key", "node", "component"), least, "component", "node").select("key", F.col("all_least").alias("least"))
    ends = ends.unionByName(labels.where("component IS NULL").select("key", "least"))
    return sketched.select(*_HANDLE, "key", "n_shingles").join(ends.hint("merge"), "key", "left").drop("key")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: id_col, n_shingles, component_id (least id reachable over links), kept (it is that least id).

    Texts link if their sets of k-word shingles have 100 * intersection >= percent * union. Null and empty texts have no
    shingles and link with nothing: their component is their own id. Rows of one id with different texts are documents of
    their own, so unlike ones are in components of their own. A document without an id takes part in links, is never
    kept, and its component is null if none that it reaches has an id. Very long texts are compared whole. An empty table
    gives no rows; other columns are ignored."""
    found = near_groups(handled(docs, F.col(id_col), F.col(text), F.xxhash64(text)), percent, k)
    own = F.when(~F.col("missing"), F.col("doc_id"))
    component = F.when(F.col("least").isNull(), own).when(~F.col("least.missing"), F.col("least.doc_id"))
    return found.select(own.alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(own == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """docs with one row of each group of near duplicates; rows without text or words all stay. Columns stay as they are.

    The row of the least doc_id stays, of several such that of the least hash over all columns; rows without a doc_id
    come last. Equal rows are one. Very long texts are compared whole; an empty table stays empty."""
    content = F.xxhash64(*(docs[f"`{f.name}`"] for f in docs.schema if "map<" not in f.dataType.simpleString()))
    rows = handled(docs, F.col("doc_id"), F.col("text"), content)
    full = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").isNull().alias("missing"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_id"), content.alias("content"))  # so that no name of docs clashes
    stay = near_groups(rows, percent, k).where(F.col("least").isNull() | (F.struct(*_HANDLE) == F.col("least")))
    stay = stay.groupBy(*_HANDLE).agg(F.first(F.col("least").isNull()).alias("wordless"))
    number = F.row_number().over(Window.partitionBy(*_HANDLE).orderBy("wordless"))
    return full.join(stay.hint("merge"), _HANDLE).withColumn("number", number).where("wordless OR number = 1").select("doc.*")


def op9_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
