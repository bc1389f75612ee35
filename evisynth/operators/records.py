"""Single records: identifiers, ordered lists, ordinal scores, quote rescue and greedy batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..tables import running, written
from .corpus import lcs

#: Designs by tier of evidence; and the probability at which a model's score counts as relevant.
HIGH, MODERATE, LOW = ["systematic_review_meta_analysis", "randomized_controlled_trial"], ["cohort_observational", "case_control", "longitudinal", "cross_sectional"], ["case_report_case_series", "narrative_review", "preclinical_animal", "in_vitro_cellular", "methods_protocol"]
ANCHOR = 0.368


def identifier(ids: Column, kind: str) -> Column:
    return F.get(F.filter(ids, lambda x: F.lower(x["type"]) == kind), F.lit(0))["value"]


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def evidence_tier(design: Column) -> Column:
    return F.when(design.isin(HIGH), "high").when(design.isin(MODERATE), "moderate").when(design.isin(LOW), "low").otherwise("unknown")


def ordinal(p: Column) -> Column:
    """0 to 5, half up, with the anchor at 2.5."""
    x = F.when(p < ANCHOR, p / ANCHOR * 2.5).otherwise(2.5 + (p - ANCHOR) / (1 - ANCHOR) * 2.5)
    return F.least(F.lit(5), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("int")


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best Indel ratio of the shorter string with a window of its length in the longer."""

    def best(x: str, y: str) -> float:
        s, t = sorted((x or "", y or ""), key=len)
        if not s:
            return 100.0 if not t else 0.0
        if s in t:
            return 100.0
        return max(100.0 * lcs(s, t[i : i + len(s)]) / len(s) for i in range(len(t) - len(s) + 1))

    return pd.Series([best(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = [(" ".join(sorted((x or "").lower().split())), " ".join(sorted((y or "").lower().split()))) for x, y in zip(a, b, strict=True)]
    return pd.Series([200.0 * lcs(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in pairs])


def greedy_batches(rows: DataFrame, order: str, size: str, most: int, budget: int, block: int = 50_000) -> DataFrame:
    """order, batch: all rows as one sequence by `order` (unique), packed greedily: a row joins the running batch unless that would pass `most` rows or `budget`; an oversized row is a batch alone.

    The sequence is cut into blocks of equal numbers of rows. A batch that is open at the end of a block has begun in its
    last `most` rows, so a block can be entered at `most` places only; each block tells in its own task where it is left
    from each of them, and how many batches begin in it. Putting these short tables together in order says where every
    block is entered. The first rows of the next block are seen by each block too, as its last batch may reach into them.
    A null size counts as 0."""
    ranked = running(rows.select(F.col(order).alias("id"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("n")), [F.col("id")])
    n_blocks = F.floor(F.col("rank") / block)
    ahead = (F.col("rank") % block < most) & (n_blocks > 0)
    seen = F.array_compact(F.array(n_blocks, F.when(ahead, n_blocks - 1)))
    dealt = written(ranked.withColumn("block", F.explode(seen)), "blocks")

    def next_starts(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        """The block's rows in order with those it sees of the next one, where a batch that begins at each ends, and the block's own rows."""
        part = part.sort_values("rank", ignore_index=True)
        n = part["n"].to_numpy(np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(len(n))
        fits = np.searchsorted(upto, upto[:-1] + budget, "right") - 1
        own = int((part["rank"].to_numpy() // block == part["block"].iloc[0]).sum())
        return part, np.minimum(np.maximum(fits, at + 1), at + most), own

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part, jump, own = next_starts(part)
        left, begun = np.arange(own + most) - own, np.zeros(own + most, np.int64)
        for i in range(own - 1, -1, -1):
            j = min(int(jump[i]), own + most - 1)
            left[i], begun[i] = left[j], begun[j] + 1
        entries = np.arange(most)
        return pd.DataFrame({"block": part["block"].iloc[0], "entry": entries, "leaves": left[:most], "begun": begun[:most]})

    def chain(maps: pd.DataFrame) -> pd.DataFrame:
        out, entry, before = [], 0, 0
        for number, some in maps.sort_values(["block", "entry"]).groupby("block"):
            out.append((number, entry, before))
            leaves, begun = some["leaves"].to_numpy(), some["begun"].to_numpy()
            entry, before = int(leaves[entry]), before + int(begun[entry])
        return pd.DataFrame(out, columns=["block", "entry", "before"])

    maps = dealt.groupBy("block").applyInPandas(walk, "block bigint, entry int, leaves int, begun bigint")
    entered = written(maps.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(chain, "block bigint, entry int, before bigint"), "entries")

    def number(part: pd.DataFrame) -> pd.DataFrame:
        part, jump, own = next_starts(part)
        start = np.zeros(len(part), np.int64)
        i = int(part["entry"].iloc[0])
        while i < own:
            start[i] = 1
            i = int(jump[i])
        batch = part["before"].iloc[0] - 1 + np.cumsum(start)
        return pd.DataFrame({"id": part["id"], "batch": batch})[:own]

    kind = rows.select(F.col(order).alias("id")).schema["id"].dataType.simpleString()
    done = dealt.join(entered, "block").groupBy("block").applyInPandas(number, f"id {kind}, batch bigint")
    return done.withColumnRenamed("id", order)
