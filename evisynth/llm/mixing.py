"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Target words follow from weights by water filling: no source is asked for more than `most` times its size, and what that
leaves over is shared out again by weight. The seats are blocks of equal numbers of words, and sources are given them by
highest quotients, none more than it can fill; the block is BLOCK words, or less where the smallest target would hold fewer
than PARTS of them, so every source comes within about a block of its target. A source's blocks are whole passes over it
and the blocks left over, which go to its shards (hashed documents) by highest quotients as whole numbers. In a shard,
documents lie end to end in seeded order and are cut into blocks; as many of those as its quota says are chosen, in a
seeded order. So what a document gives follows from its place alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, let, running, table, written

#: Words of a block at most; blocks that the smallest target holds at least; blocks of a shard, about.
BLOCK, PARTS, SHARD_BLOCKS = 1024, 256, 512
#: Primes above any number of blocks in a shard: j -> (prime * j + shift) mod n puts n blocks in another order.
_PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587, 2_147_483_579)
#: Doublings of the range in which a capped item's last seats are looked for.
_WIDER = 24


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sources (source, source_size), a row each, with weight (from the cycle, by code point, null last) and target.

    Let a source's cap be most * size. By ascending cap / weight the sources at their cap are the first ones: a source is
    at its cap if the share of what the earlier caps leave, by weight among it and the later ones, is above its cap.
    Places and sums over all sources are taken in ranges, so their number has no bound."""
    named = [F.col("source").isNull().asc(), F.col("source").asc()]
    weights = F.array(*(F.lit(float(w)) for w in cycle))
    rows = running(sources, named).withColumn("weight", F.element_at(weights, (F.pmod("rank", F.lit(len(cycle))) + 1).cast("int"))).drop("rank")
    rows = rows.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    rows = running(rows, [F.col("fill").asc(), *named], {"capped": "cap", "lighter": "weight"}).drop("rank")
    everything = rows.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).head()
    words, weight = float(everything["words"] or 0), float(everything["weight"] or 1)
    rows = rows.withColumn("level", (F.lit(words) - F.col("capped")) / (F.lit(weight) - F.col("lighter")))
    rows = rows.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    # the first source that is not full sets the level of all that are not
    first = rows.where("NOT full").agg(F.min(F.struct("fill", F.col("source").isNull(), "source", "level"))["level"].alias("level")).head()
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.lit(first["level"] or 0.0) * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined to right, null keys being equal; the keys come from left."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = left.alias("l").join(right.alias("r"), same, "left")
    return joined.select("l.*", *(F.col(f"r.{c}") for c in right.columns if c not in keys))


def apportioned(items: DataFrame, group: list[str], item: str, votes: str, seats: str, quota: str, most: str | None = None) -> DataFrame:
    """items with `quota`: whole seats of their group's `seats`, by the highest quotients votes / (2 * seats so far + 1), ties by item, no item more than its `most`.

    At a price of votes a seat, every item gets its votes over the price, rounded. With V votes and n items, the price
    V / (seats - n/2) gives out too few seats and V / (seats + n/2) enough (with `most`, after as many doublings of n as
    it takes), so only the quotients in between are compared: no more than a few for each item on average. A group
    of no votes gets no seats. With group [] all items are one group, whose quotients are ranked in ranges."""
    price_of = lambda wider: F.try_divide(F.col("_votes"), F.col("_seats") + wider * F.col("_n") / 2)
    capped = lambda n: F.least(n, F.col(most)) if most else n
    at = lambda wider: F.coalesce(capped(F.floor(F.try_divide(F.col(votes), price_of(wider)) + 0.5).cast("bigint")), F.lit(0)).cast("bigint")
    low = F.when(F.col("_seats") > F.col("_n") / 2, at(-1.0)).otherwise(F.lit(0).cast("bigint"))

    def with_totals(rows: DataFrame, **totals: Column) -> DataFrame:
        if group:
            return _matched(rows, rows.groupBy(*group).agg(*(x.alias(name) for name, x in totals.items())), group)
        found = rows.agg(*(x.alias(name) for name, x in totals.items()))
        kinds = {f.name: f.dataType for f in found.schema}
        only = found.head()
        return rows.withColumns({name: F.lit(only[name]).cast(kinds[name]) for name in totals})

    rows = with_totals(items, _votes=F.coalesce(F.sum(votes), F.lit(0)).cast("double"), _n=F.count(F.lit(1)), _seats=F.coalesce(F.max(seats), F.lit(0)).cast("bigint"))
    rows = rows.withColumn("_low", F.when(F.col("_votes") > 0, low).otherwise(0))
    sums = F.array(*(F.sum(F.greatest(at(float(1 << k)), F.col("_low"))) for k in range(_WIDER)))
    rows = with_totals(rows, _given=F.sum("_low"), _sums=sums)
    enough = F.coalesce(F.array_min(F.filter(F.transform("_sums", lambda s, k: F.when(s >= F.col("_seats"), k)), lambda k: k.isNotNull())), F.lit(_WIDER - 1))
    rows = rows.withColumn("_high", F.when(F.col("_votes") > 0, F.greatest(at(F.pow(F.lit(2.0), enough)), F.col("_low"))).otherwise(0)).drop("_sums")
    rows = written(rows, "quotas")
    tries = rows.where("_high > _low AND _seats > _given").select(*group, item, (F.col("_seats") - F.col("_given")).alias("_off"), (-F.col(votes)).alias("_worse"), F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_seat"))
    tries = tries.withColumn("_worse", F.col("_worse") / (2 * F.col("_seat") - 1))
    order = [F.col("_worse").asc(), F.col(item).isNull().asc(), F.col(item).asc(), F.col("_seat").asc()]
    tries = written(running(tries, [c for g in group for c in (F.col(g).isNull(), F.col(g))] + order), "tries")
    if group:
        tries = _matched(tries, tries.groupBy(*group).agg(F.min("rank").alias("_before")), group).withColumn("rank", F.col("rank") - F.col("_before"))
    won = tries.where("rank < _off").groupBy(*group, item).agg(F.count(F.lit(1)).alias("_won"))
    found = _matched(rows, won, [*group, item])
    return found.select(*items.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias(quota))


def _overlap(low: Column, high: Column, from_: Column, to: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(high, to) - F.greatest(low, from_))


def _place(j: Column) -> Column:
    """Where block j of a shard stands in the seeded order."""
    return F.pmod(F.col("prime") * j + F.col("shift"), F.col("n_blocks"))


def mixed(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each row of docs: id_col, size, source_size, target, taken, and where its words are taken from.

    taken is the number of words that the mix takes, repeats counted: `passes` times the whole document, and its `parts`,
    runs (start, words) of its words that chosen blocks cover. No document gives more than `most` times its size, and
    each source gives its target but for about a block (and, where nearly all of a source is asked for, for the words
    behind the last whole block of each shard).

    A null text has no words; documents without a source are a source of their own, last in order; a source without
    words has target 0. Repeated rows and null ids are documents of their own; a very long text lies in many blocks.
    Reruns agree, as places depend on hashes of the seed and the row alone (rows that are equal in all of id, source and
    text are alike). An empty table gives no rows; other columns are ignored."""
    sizes = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("content"))
    sizes = written(sizes.withColumn("line", F.xxhash64(F.lit(seed), "doc_id", "content")).drop("content"), "mix-sizes")
    targets = written(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, most), "targets")
    told = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("total"), F.coalesce(F.min(F.when(F.col("target") > 0, F.col("target"))), F.lit(1.0)).alias("least")).head()
    block = max(1, min(BLOCK, int(told["least"] / PARTS)))
    targets = targets.withColumns({"most_blocks": F.floor(most * F.col("source_size") / block).cast("bigint"), "all_blocks": F.lit(round(told["total"] / block)).cast("bigint")})
    quotas = apportioned(targets, [], "source", "target", "all_blocks", "source_blocks", "most_blocks")
    words = F.col("source_blocks") * block
    quotas = quotas.withColumn("passes", F.coalesce(F.floor(words / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("bigint"))
    quotas = quotas.withColumns({"rest": words - F.col("passes") * F.col("source_size"), "n_shards": F.greatest(F.lit(1), F.floor(F.col("source_size") / (block * SHARD_BLOCKS))).cast("bigint")})
    quotas = written(quotas.select("source", "source_size", "target", "passes", "rest", "n_shards"), "source-quotas")
    sizes = _matched(sizes, quotas.select("source", "n_shards"), ["source"]).withColumn("shard", F.pmod(F.xxhash64("line"), "n_shards")).drop("n_shards")
    shards = sizes.groupBy("source", "shard").agg(F.floor(F.sum("size") / block).cast("bigint").alias("n_blocks"))
    shards = written(shards, "mix-shards")
    quotas = _matched(quotas, shards.groupBy("source").agg(F.sum("n_blocks").alias("whole_blocks")), ["source"])
    # one more pass where that is nearer than all whole blocks
    full = (F.col("rest") - F.col("whole_blocks") * block > F.col("source_size") - F.col("rest")) & (F.col("passes") < most)
    quotas = quotas.withColumns({"passes": F.col("passes") + full.cast("int"), "run_blocks": F.when(full, 0).otherwise(F.least(F.round(F.col("rest") / block), F.col("whole_blocks"))).cast("bigint")})
    parts = _matched(shards, quotas.drop("n_shards", "rest", "whole_blocks"), ["source"])
    parts = apportioned(parts, ["source"], "shard", "n_blocks", "run_blocks", "run", "n_blocks")
    seeded = F.xxhash64(F.lit(seed), "source", "shard")
    prime = F.array(*(F.lit(p).cast("bigint") for p in _PRIMES))[F.pmod(F.shiftright(seeded, 40), F.lit(len(_PRIMES))).cast("int")]
    parts = parts.withColumns({"prime": prime, "shift": F.pmod(seeded, F.greatest(F.lit(1), "n_blocks"))})
    alone = F.when(F.col("size") == 0, F.xxhash64("line", "doc_id"))  # rows without words take no room, so they need not meet
    order = Window.partitionBy("source", "shard", alone).orderBy("line", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = _matched(sizes.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0))), parts, ["source", "shard"])

    def part(j: Column) -> Column:
        begin = j * block
        chosen = F.when((j < F.col("n_blocks")) & (_place(j) < F.col("run")), block).otherwise(0)
        words = _overlap(F.col("at"), F.col("at") + F.col("size"), begin, begin + chosen)
        return F.struct(F.greatest(begin - F.col("at"), F.lit(0)).alias("start"), words.alias("words"))

    blocks = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))
    every = F.filter(F.transform(blocks, part), lambda p: p["words"] > 0)
    rows = rows.withColumn("parts", F.when((F.col("size") > 0) & (F.col("run") > 0), every).otherwise(F.filter(F.array(part(F.lit(0).cast("bigint"))), lambda _: F.lit(False))))
    rows = rows.withColumn("part_words", F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["words"]))
    return rows.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part_words")).alias("taken"), "passes", "parts", "part_words", F.col("source").alias("mixed_source"), "line")


def mix_documents(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole pass of a document and for each of its parts, words with blanks between them and n_chars of their own.

    Parts that make up the whole document are one more pass. Rows without words, so null and empty texts too, give
    nothing; rows without an id or a source, repeated rows and very long texts are documents like others; an empty table
    stays empty."""
    shares = mixed(docs, cycle, most, seed)
    number = F.row_number().over(Window.partitionBy("line").orderBy("mixed_source", "taken"))
    shares = shares.where("taken > 0").withColumn("twin", number).select("line", "twin", "passes", "parts", "part_words", "size")
    rows = docs.select(F.struct(*docs.columns).alias("doc"))  # so that no name of docs clashes
    line = F.xxhash64(F.lit(seed), F.col("doc.doc_id").cast("bigint"), F.xxhash64("doc.text"))
    rows = rows.withColumn("line", line).withColumn("twin", F.row_number().over(Window.partitionBy("line").orderBy("doc.source")))
    rows = rows.join(shares, ["line", "twin"])
    covered = F.col("part_words") == F.col("size")
    none = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("words"))  # the text as it is
    whole = F.array_repeat(none, (F.col("passes") + covered.cast("int")).cast("int"))
    rows = rows.withColumn("part", F.explode(F.concat(whole, F.when(covered, F.slice("parts", 1, 0)).otherwise(F.col("parts")))))
    words = F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("part.start") + 1).cast("int"), F.col("part.words").cast("int")), " ")
    rows = rows.withColumn("cut", F.when(F.col("part.words") > 0, cut))
    fresh = {"text": F.coalesce("cut", "doc.text"), "n_chars": F.coalesce(F.char_length("cut").cast("bigint"), "doc.n_chars") if "n_chars" in docs.columns else None}
    return rows.select(*(fresh.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns))


def op2_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weights 1, 2, 3 in turn, at most three times a source; nulls, repeats and empty tables as in `mixed`."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")
