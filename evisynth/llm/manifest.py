"""A Merkle manifest of a dataset: leaves of rows, a tree a group, a tree over the groups' roots, and a proof for every row.

Leaves of a group stand in order at places 0, 1, 2, ...; runs of FAN nodes become their parent. FAN ** LEVELS consecutive
places are a block, and a block is a window partition of fixed size, so no group meets in one task however large it is.
In a block the node of level j lies in the row of its first leaf, FAN ** j places from the next one: lag and lead columns
of that fixed offset, masked by the node's slot in its run and by the run's length, are its siblings, and the row of the
first child hashes the parent. The rows of blocks' roots are the leaves of the next round, until one node a group remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running, table, written

#: Nodes of a run; levels of a round.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def digest(columns: dict[str, Column]) -> Column:
    """The lower-case hex SHA-256 of the values one behind the other: the count of UTF-8 bytes, a colon and the value, or a dash for null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, group, leaf, and tampered: the leaf of the row as it would be after tampering (A-Z of the text in lower case where 3 divides the id's crc32)."""
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col(id_col).cast("bigint").alias("doc_id"), F.col(group).cast("string").alias("group"), F.col(text).alias("whole"))
    given = {c: F.col(f"c{i}") for i, c in enumerate(columns)}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False)) & F.col("whole").rlike("[A-Z]")
    lowered = digest(given | {text: F.translate("whole", _UPPER, _LOWER)} if text in given else given)
    rows = rows.withColumn("leaf", digest(given))
    return rows.select("doc_id", "group", "leaf", F.when(hit, lowered).otherwise(F.col("leaf")).alias("tampered"))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (group and others) with place: their number in their group, from 0, and n: the group's rows. Nulls are a group, the first."""
    ranked = written(running(rows, [F.col("group").isNotNull(), F.col("group"), *order]), "placed")
    groups = ranked.groupBy("group").agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("n"))
    joined = ranked.alias("r").join(groups.alias("g"), F.col("r.group").eqNullSafe(F.col("g.group")))
    return joined.select("r.*", (F.col("rank") - F.col("_first")).alias("place"), "n").drop("rank")


def _nodes_left(n: Column, level: int) -> Column:
    """Nodes of a level whose group has n leaves."""
    return F.ceil(n / FAN**level).cast("bigint")


def _siblings(level: int, window, node: str) -> tuple[Column, Column]:
    """What stands before and behind the node of the row in its run, digests joined."""
    step = FAN**level
    slot = F.floor(F.col("place") / step) % FAN
    run = F.least(F.lit(FAN), _nodes_left(F.col("n"), level) - F.floor(F.col("place") / step) + slot)
    before = [F.when(slot >= d, F.lag(node, d * step).over(window)) for d in range(FAN - 1, 0, -1)]
    behind = [F.when(slot + d < run, F.lead(node, d * step).over(window)) for d in range(1, FAN)]
    return F.concat_ws("", *before), F.concat_ws("", *behind)


def _window() -> Window:
    return Window.partitionBy("group", "block").orderBy("place")


def raised(nodes: DataFrame) -> DataFrame:
    """nodes (group, place, n, node0 and others) with block and node1, node2, ...: the parents that each level of the round gives, in the rows of their first children."""
    rows = nodes.withColumn("block", F.floor(F.col("place") / BLOCK))
    for level in range(LEVELS):
        _, behind = _siblings(level, _window(), f"node{level}")
        parent = F.when(_nodes_left(F.col("n"), level) > 1, F.sha2(F.concat(F.col(f"node{level}"), behind), 256)).otherwise(F.col(f"node{level}"))
        rows = rows.withColumn(f"node{level + 1}", F.when(F.col("place") % FAN ** (level + 1) == 0, parent))
    return rows


def with_path(nodes: DataFrame) -> DataFrame:
    """What `raised` gives with path: for each level of the round that the group has, what stands before and behind the row's ancestor in its run."""
    rows, window = nodes, _window()
    for level in range(LEVELS):
        left, right = _siblings(level, window, f"node{level}")
        there = (F.col("place") % FAN**level == 0) & (_nodes_left(F.col("n"), level) > 1)
        rows = rows.withColumn(f"_at{level}", F.when(there, F.struct(left.alias("left"), right.alias("right"))))
    carried = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [F.last(f"_at{level}", ignorenulls=True).over(carried) for level in range(LEVELS)]
    path = F.array_compact(F.array(*own)).cast(_PATH)
    return rows.withColumn("path", path).drop(*(f"_at{level}" for level in range(LEVELS)))


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (group, place, n, node0 and others) as (nodes with path, roots).

    path holds all levels up to the group's root; roots has group and root. A round writes its nodes with the parents of
    its levels; paths are put together from the last round down, so a row meets one row of its block's root a round."""
    rounds, roots = [], []
    rows = nodes
    while True:
        kept = written(raised(rows), "nodes")
        rounds.append(kept)
        tops = kept.where(F.col("place") % BLOCK == 0).select("group", F.col("block").alias("place"), _nodes_left(F.col("n"), LEVELS).alias("n"), F.col(f"node{LEVELS}").alias("node0"))
        roots.append(tops.where("n = 1").select("group", F.col("node0").alias("root")))
        rows = tops.where("n > 1")
        if rows.isEmpty():
            break
    ends = roots[0]
    for more in roots[1:]:
        ends = ends.unionByName(more)
    above = None
    for kept in reversed(rounds):
        found = with_path(kept)
        if above is not None:
            upper = above.select(F.col("group").alias("_group"), F.col("place").alias("_block"), F.col("path").alias("_path"))
            found = found.join(upper, F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block")), "left")
            found = found.withColumn("path", F.concat("path", F.coalesce("_path", F.array().cast(_PATH)))).drop("_group", "_block", "_path")
        above = found.drop("block", *(f"node{level}" for level in range(1, LEVELS + 1)))
        if kept is not rounds[0]:
            above = written(above, "paths")
    return above, written(ends, "roots")


def folded(node: Column, path: Column) -> Column:
    """The root that follows from a node and its path."""
    return F.aggregate(path, node, lambda h, at: F.sha2(F.concat(at["left"], h, at["right"]), 256))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: id_col, leaf, subroot (its group's), root, proof_sha256, folded_root, verified.

    Leaves of a group are ordered by id, rows without an id first, rows of equal ids by leaf; repeated rows are leaves of
    their own. The rows without a group are a group, the first. proof_sha256 covers the siblings of all levels up to the
    root, nothing where there are none. folded_root follows from the tampered row's leaf and the original siblings, so it
    is the root again only where tampering changed nothing. Null values and very long texts are hashed whole. An empty
    table gives no rows; other columns are ignored, so their names may clash."""
    ordered = placed(leaves(docs, columns, group, id_col, text), [F.col("doc_id"), F.col("leaf")])
    rows, subroots = tree(ordered.withColumnRenamed("leaf", "node0"))
    named = subroots.select(F.col("group").alias("name"), F.lit("all").alias("group"), F.col("root").alias("node0"))
    ranked = running(named, [F.col("name").isNotNull(), F.col("name")]).withColumnRenamed("rank", "place")
    tops, roots = tree(ranked.withColumn("n", F.lit(subroots.count()).cast("bigint")))
    root = roots.head()
    tops = tops.select("name", F.col("node0").alias("subroot"), F.col("path").alias("_path"))
    rows = rows.join(tops, F.col("group").eqNullSafe(F.col("name"))).withColumn("path", F.concat("path", "_path"))
    siblings = F.array_join(F.transform("path", lambda at: F.concat(at["left"], at["right"])), "")
    rows = rows.select(F.col("doc_id").alias(id_col), F.col("node0").alias("leaf"), "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tree a language."""
    return manifest(table(spark, sf_dir, "documents"))


#: Trees by recursion over levels; crc32 by eight shifts a byte.
OP12_SQL = r"""
WITH RECURSIVE v AS (SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, CAST(i + 1 AS INT), 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 3 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text2 FROM documents),
p AS (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head FROM v),
leaves AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(text2)) || ':' || text2, '-')) AS tampered FROM p),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS place FROM (SELECT DISTINCT lang FROM documents)),
nodes AS (SELECT 0 AS level, place, pos, leaf AS h, count(*) OVER (PARTITION BY place) AS n FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang
  UNION ALL SELECT level + 1, place, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), count(*) OVER (PARTITION BY place) FROM nodes WHERE n > 1 GROUP BY level, place, pos // 8),
subroots AS (SELECT place, h AS subroot, level AS top FROM nodes WHERE n = 1),
uppers AS (SELECT 0 AS level, place AS pos, subroot AS h, count(*) OVER () AS n FROM subroots UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), count(*) OVER () FROM uppers WHERE n > 1 GROUP BY level, pos // 8),
steps AS (SELECT level, place, pos, coalesce(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY level, place, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY level, place, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes WHERE n > 1
  UNION ALL SELECT s.top + u.level, s.place, s.place // CAST(pow(8, u.level) AS BIGINT), u.l, u.r FROM subroots s JOIN (SELECT level, pos,
    coalesce(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM uppers WHERE n > 1) u ON u.pos = s.place // CAST(pow(8, u.level) AS BIGINT)),
fold AS (SELECT doc_id, leaf, place, top, 0 AS level, pos, tampered AS f, '' AS proof FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang JOIN subroots USING (place)
  UNION ALL SELECT doc_id, leaf, fold.place, top, fold.level + 1, CASE WHEN fold.level + 1 = top THEN fold.place ELSE (CASE WHEN fold.level = top THEN fold.place ELSE fold.pos END) // 8 END, sha256(l || f || r), proof || l || r
  FROM fold JOIN steps ON steps.level = fold.level AND steps.place = fold.place AND steps.pos = CASE WHEN fold.level = top THEN fold.place ELSE fold.pos END),
ends AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM uppers WHERE n = 1) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT h FROM uppers WHERE n = 1) AS verified FROM ends JOIN subroots USING (place)
"""
