"""Bootstrap, split-half and permutation statistics over counts: the data are summed first, replicates are rows.

Replicates are dealt to tasks by number, each seeded by its own, so results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


def replicates(spark, n: int, partitions: int = 8) -> DataFrame:
    return spark.range(0, n, 1, partitions).withColumnRenamed("id", "replicate")


def bootstrap_means(rows: DataFrame, value: str, n: int = 10_000, seed: int = 42) -> DataFrame:
    """Mean of each of n resamples of an integer score: drawing rows with replacement is drawing a multinomial of the scores' counts."""
    counted = {r[value]: r["count"] for r in rows.where(F.col(value).isNotNull()).groupBy(value).count().collect()}  # a row a score
    scores, counts = np.array(sorted(counted), float), np.array([counted[k] for k in sorted(counted)], float)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(scores):
                continue
            total = int(counts.sum())
            means = [np.random.default_rng((seed, int(i))).multinomial(total, counts / total) @ scores / total for i in b["replicate"]]
            yield pd.DataFrame({"replicate": b["replicate"], "mean": means})

    return replicates(rows.sparkSession, n).mapInPandas(draw, "replicate bigint, mean double")


def interval(means: DataFrame, by: list[str] | None = None) -> DataFrame:
    p = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*(by or [])).agg(F.count("*").alias("replicates"), F.avg("mean").alias("mean"), p[0].alias("ci_lower"), p[1].alias("ci_upper"))


#: Rows that one hypergeometric draw may stand for (a limit of numpy's); more are drawn in equal parts.
DRAWN = 500_000_000


def _halved(counts: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores of one half, of the other, their table over random pairs) for counts of scores, each drawn exactly."""
    k = len(counts)
    table = np.zeros((k, k), np.int64)
    half = int(counts.sum()) // 2
    one = rng.multivariate_hypergeometric(counts, half, method="marginals")
    other = rng.multivariate_hypergeometric(counts - one, half, method="marginals")
    left = other.copy()
    for i in range(k):
        table[i] = rng.multivariate_hypergeometric(left, int(one[i]), method="marginals")
        left -= table[i]
    return one, other, table


def split_half(rows: DataFrame, value: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """(replicate, mean_1, mean_2, r): means of two random halves of scores, and Pearson's r over random pairs of them (null if a half does not vary).

    Halves depend on how often each score occurs and on nothing else, so they are drawn from those counts: a row a score
    is all that a task needs, and no replicate reads the data. Of an odd number of rows one is in neither half. Nulls
    are left out; fewer than four rows have no halves."""
    counted = {float(r[value]): r["count"] for r in rows.where(F.col(value).isNotNull()).groupBy(value).count().collect()}  # a row a score
    scores, counts = np.array(sorted(counted)), np.array([counted[k] for k in sorted(counted)], np.int64)
    total = int(counts.sum())
    parts = max(1, -(-total // DRAWN))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["replicate"] if total >= 4 else []:
                rng = np.random.default_rng((seed, int(i)))
                drawn = [_halved(counts // parts + (p < counts % parts), rng) for p in range(parts)]
                one, other, table = (sum(d[j] for d in drawn) for j in range(3))
                m1, m2 = one @ scores / one.sum(), other @ scores / other.sum()
                v1, v2 = one @ (scores - m1) ** 2, other @ (scores - m2) ** 2
                r = float((scores - m1) @ table @ (scores - m2) / np.sqrt(v1 * v2)) if v1 > 0 and v2 > 0 else None
                out.append((int(i), float(m1), float(m2), r))
            yield pd.DataFrame(out, columns=["replicate", "mean_1", "mean_2", "r"]).astype({"replicate": "int64", "r": "float64"})

    drawn = replicates(rows.sparkSession, n).mapInPandas(draw, "replicate bigint, mean_1 double, mean_2 double, r double")
    return drawn.withColumn("r", F.nanvl("r", F.lit(None).cast("double")))


def split_half_summary(rows: DataFrame, value: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """One row: correlation of half means over replicates; mean, standard deviation, least and greatest of the halves' own correlations; Kendall's tau and ICC(1,1) of half means; and the label. A few numbers for each replicate are all that it needs.

    Fewer than four rows have no halves: no splits, all zero and "poor"."""
    from .agreement import icc1, kendall

    means = written(split_half(rows, value, n, seed).withColumn("_g", F.lit(0)))
    over = means.groupBy("_g").agg(F.count("*").alias("n_splits"), F.coalesce(F.nanvl(F.corr("mean_1", "mean_2"), F.lit(0.0)), F.lit(0.0)).alias("means_correlation"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    long = means.select("_g", "replicate", F.explode(F.array("mean_1", "mean_2")).alias("x"))
    none = rows.sparkSession.range(1).select(F.lit(0).alias("_g"))
    one = none.join(over, "_g", "left").join(kendall(means, "mean_1", "mean_2", ["_g"]).select("_g", "tau"), "_g", "left").join(icc1(long, ["replicate"], "x", ["_g"]).select("_g", "icc"), "_g", "left")
    zero = lambda *c: F.coalesce(*(F.col(x) for x in c), F.lit(0.0))
    mean = zero("m", "means_correlation")
    label = F.when(mean > 0.8, "excellent").when(mean > 0.6, "good").when(mean > 0.4, "fair").otherwise("poor")
    return one.select(F.coalesce("n_splits", F.lit(0)).alias("n_splits"), zero("means_correlation").alias("means_correlation"), mean.alias("mean_correlation"), zero("s").alias("std_correlation"), zero("lo", "means_correlation").alias("min_correlation"), zero("hi", "means_correlation").alias("max_correlation"), zero("tau").alias("kendall_tau"), zero("icc").alias("icc"), label.alias("interpretation"))


def permutation_p(points: DataFrame, x: str, y: str, n: int = 10_000, seed: int = 42) -> DataFrame:
    """Two-sided share of shuffles of y whose Spearman correlation is as extreme as the observed. points: one row a group, few by nature."""
    rows = sorted((r[x], r[y]) for r in points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).collect())
    ranks = lambda v: pd.Series(v).rank().to_numpy()
    a, b = ranks([r[0] for r in rows]), ranks([r[1] for r in rows])
    seen = float(np.corrcoef(a, b)[0, 1]) if len(rows) > 2 and a.std() and b.std() else 0.0

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rho = [np.corrcoef(a, np.random.default_rng((seed, int(i))).permutation(b))[0, 1] if a.std() and b.std() else 0.0 for i in t["replicate"]]
            yield pd.DataFrame({"extreme": np.abs(rho) >= abs(seen) - 1e-12})

    out = replicates(points.sparkSession, n).mapInPandas(draw, "extreme boolean")
    return out.agg(F.lit(seen).alias("rho"), (F.count_if("extreme") / F.count("*")).alias("p"), F.count("*").alias("replicates"))
