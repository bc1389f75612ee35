"""Agreement of raters and of runs, over long rows of ratings; every statistic is a few sums by group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.special import f_quantile
from ..tables import running, written


def cohen_kappa(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Unweighted kappa of two raters' categories for each of `by`; 1 where chance agreement leaves no room."""
    cells = rows.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    side = lambda c, name: cells.groupBy(*by, F.col(c).alias("cat")).agg(F.sum("n").alias(name))
    chance = side(a, "na").join(side(b, "nb"), [*by, "cat"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("p"))
    j = total.join(chance, by, "left").withColumns({"po": F.col("same") / F.col("t"), "pe": F.coalesce(F.col("p"), F.lit(0)) / (F.col("t") * F.col("t"))})
    return j.select(*by, F.col("t").alias("n"), "po", "pe", F.when(F.abs(1 - F.col("pe")) < 1e-12, 1.0).otherwise((F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))).alias("kappa"))


def weighted_kappa(rows: DataFrame, a: str, b: str, by: list[str], top: int = 5) -> DataFrame:
    """Linear weights over scores 0 to top, which others are moved into."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(top), F.col(c)))
    cells = rows.select(*by, clamp(a).alias("x"), clamp(b).alias("y")).groupBy(*by, "x", "y").agg(F.count("*").alias("n"))
    seen = cells.groupBy(*by).agg(F.sum("n").alias("t"), (F.sum(F.abs(F.col("x") - F.col("y")) * F.col("n")) / top).alias("o"))
    xs, ys = (cells.groupBy(*by, c).agg(F.sum("n").alias(f"n{c}")) for c in ("x", "y"))
    expected = xs.join(ys, by).groupBy(*by).agg((F.sum(F.abs(F.col("x") - F.col("y")) * F.col("nx") * F.col("ny")) / top).alias("e"))  # at most top + 1 rows a side
    j = seen.join(expected, by).withColumn("e", F.col("e") / F.col("t"))
    return j.select(*by, F.col("t").alias("n"), F.when(F.col("e") < 1e-12, 1.0).otherwise(1 - F.col("o") / F.nullif(F.col("e"), F.lit(0.0))).alias("weighted_kappa"))


def fleiss_kappa(rows: DataFrame, subject: str, category: str) -> DataFrame:
    """One row over long ratings (subject, category), with the same number of ratings for each subject."""
    cells = rows.groupBy(subject, category).agg(F.count("*").alias("n"))
    per = cells.groupBy(subject).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("ss"))
    p = per.agg(F.count("*").alias("subjects"), F.max("r").alias("raters"), F.avg((F.col("ss") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("po"))
    share = cells.groupBy(category).agg(F.sum("n").alias("_n"))
    pe = share.agg((F.sum(F.col("_n") * F.col("_n")) / F.pow(F.sum("_n"), F.lit(2))).alias("pe"))
    j = p.crossJoin(pe)  # two one-row frames
    k = F.when(F.abs(1 - F.col("pe")) < 1e-12, 1.0).otherwise((F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0)))
    label = F.when(k > 0.8, "almost perfect").when(k > 0.6, "substantial").when(k > 0.4, "moderate").when(k > 0.2, "fair").when(k > 0, "slight").otherwise("poor")
    return j.select("subjects", "raters", "po", "pe", k.alias("kappa"), label.alias("label"))


def label_of(kappa: Column) -> Column:
    return F.when(kappa < 0.2, "poor").when(kappa < 0.4, "fair").when(kappa < 0.6, "moderate").when(kappa < 0.8, "substantial").otherwise("almost perfect")


def correlation(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson's r, 0 where a side does not vary."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.when((F.var_pop(x) == 0) | (F.var_pop(y) == 0), 0.0).otherwise(F.corr(x, y)).alias("r"))


def value_ranks(cells: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """(by, value, name): the average rank, from 1, of each value in its group of cells (by, value, n), from sums over all values in order; so no task sees a whole group."""
    counts = cells.groupBy(*by, value).agg(F.sum("n").alias("_m"))
    order = running(counts, [F.col(c).asc() for c in (*by, value)], {"_before": "_m"})
    first = order.groupBy(*by).agg(F.min("_before").alias("_first"))
    return order.join(first, by).select(*by, value, (F.col("_before") - F.col("_first") + (F.col("_m") + 1) / 2).alias(name))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """n and rho for each group of `by`, 0 where a side does not vary: ranks come from counts of values, and pairs of values are weighted by theirs. Rows without x or y are left out."""
    cells = written(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("n")), "cells")
    total = cells.groupBy(*by).agg(F.sum("n").alias("_t"))
    ranked = cells.join(value_ranks(cells, x, by, "_x"), [*by, x]).join(value_ranks(cells, y, by, "_y"), [*by, y]).join(total, by)
    middle = (F.col("_t") + 1) / 2
    ranked = ranked.withColumns({"_x": F.col("_x") - middle, "_y": F.col("_y") - middle})
    s = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    sums = ranked.groupBy(*by).agg(F.sum("n").alias("n"), s("_x", "_y").alias("xy"), s("_x", "_x").alias("xx"), s("_y", "_y").alias("yy"))
    d = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select(*by, "n", F.when(d > 0, F.col("xy") / F.nullif(d, F.lit(0.0))).otherwise(0.0).alias("rho"))


#: Blocks that the two orders of a rank correlation are cut into, at most.
GRID = 512


def inversions(place: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each element of a sequence of different whole numbers from 0, the weight of the greater ones before it: by halves of the numbers, from the highest bit down."""
    order, out = np.arange(len(place)), np.zeros(len(place), np.int64)
    for bit in range(max(1, int(place.max(initial=0)).bit_length()) - 1, -1, -1):
        half = place[order] >> bit
        group, high = half >> 1, half & 1
        before = np.cumsum(weight[order] * high)
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        base = np.repeat(before[heads] - (weight[order] * high)[heads], np.diff(np.append(heads, len(order))))
        out[order] += np.where(high == 0, before - base, 0)
        order = order[np.argsort(half, kind="stable")]
    return out


def _in_block(own: bool):
    """Inversions of a block of the first order (own), or of one of the second order between different blocks of the first."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("u", ignore_index=True)
        v, n = rows["v"].rank().to_numpy(np.int64) - 1, rows["n"].to_numpy(np.int64)
        found = inversions(v, n)
        if not own:  # those within one block of the first order are counted there
            for _, some in rows.groupby("ub").indices.items():
                found[some] -= inversions(np.argsort(np.argsort(v[some])), n[some])
        return pd.DataFrame({"g": rows["g"], "d": found * n}).groupby("g", as_index=False, dropna=False).sum()

    return count


def _corner(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the grid of blocks, for each cell the weight of cells in earlier blocks of the first order and later ones of the second."""
    grid = np.zeros((GRID + 1, GRID + 1), np.int64)
    np.add.at(grid, (rows["ub"].to_numpy() + 1, rows["vb"].to_numpy()), rows["n"].to_numpy(np.int64))
    upto = np.cumsum(grid, 0)[:-1]
    later = np.cumsum(upto[:, ::-1], 1)[:, ::-1]
    return rows.assign(above=later[rows["ub"].to_numpy(), rows["vb"].to_numpy() + 1])[["ub", "vb", "above"]]


def mahonian_p(n: int, inverted: int) -> float:
    """The exact two-sided p of that many discordant pairs, or as few concordant ones, among n different ranks."""
    c = min(inverted, n * (n - 1) // 2 - inverted)
    if 4 * c == n * (n - 1):
        return 1.0
    ways = [1] + [0] * c
    for k in range(2, n + 1):
        for j in range(c, 0, -1):
            ways[j] = sum(ways[max(0, j - k + 1) : j + 1])
    return min(1.0, 2.0 * sum(ways) / math.factorial(n))


@F.pandas_udf(DoubleType())
def _tau_p(n: pd.Series, discordant: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    exact = [t == 0 and (m <= 33 or min(d, m * (m - 1) // 2 - d) <= 1) for m, d, t in zip(n, discordant, ties, strict=True)]
    return pd.Series([1.0 if s != s else mahonian_p(int(m), int(d)) if e and m <= 170 else math.erfc(abs(s) / math.sqrt(2)) for m, d, s, e in zip(n, discordant, z, exact, strict=True)])


def kendall(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """n, tau (tau-b, 0 where a side does not vary), z and p_value for each group of `by`; rows without x or y are left out.

    Rows become cells of different (x, y). Discordant pairs are those that stand in one order in (x, y) and in the other
    in (y, x); both orders are taken in ranges and cut into at most GRID blocks of equal numbers of cells. A pair in one
    block of either order is counted in that block's task in n log n, all others by the grid of blocks, whose size is
    fixed. p_value is exact for at most 33 rows without ties, else that of the normal approximation with ties."""
    g = F.struct(*by) if by else F.lit(0)
    given = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = given.select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("g") if by else F.lit("").alias("g"), g.alias("_by"), F.col(x).alias("x"), F.col(y).alias("y")).groupBy("g", "_by", "x", "y").agg(F.count("*").alias("n"))
    cells = running(written(cells, "cells"), [F.col(c) for c in ("g", "x", "y")]).withColumnRenamed("rank", "u")
    cells = running(cells, [F.col(c) for c in ("g", "y", "x")]).withColumnRenamed("rank", "v")
    size = max(1, -(-cells.count() // GRID))
    cells = written(cells.withColumns({"ub": F.floor(F.col("u") / size).cast("int"), "vb": F.floor(F.col("v") / size).cast("int")}), "cells")
    within = [cells.select("g", "u", "v", "ub", "vb", "n").groupBy(b).applyInPandas(_in_block(b == "ub"), "g string, d bigint") for b in ("ub", "vb")]
    grid = cells.groupBy("ub", "vb").agg(F.sum("n").alias("n")).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_corner, "ub int, vb int, above bigint")
    far = cells.join(grid, ["ub", "vb"]).groupBy("g").agg(F.sum(F.col("n") * F.col("above")).alias("d"))
    discordant = within[0].unionByName(within[1]).unionByName(far).groupBy("g").agg(F.sum("d").alias("d"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2

    def ties(*on: str) -> DataFrame:
        m = cells.groupBy("g", *on).agg(F.sum("n").alias("m")).withColumn("m", F.col("m").cast("double"))
        many = F.col("m") * (F.col("m") - 1)
        return m.groupBy("g").agg(F.sum(many / 2).alias(f"t{''.join(on)}"), F.sum(many * (F.col("m") - 2)).alias(f"a{''.join(on)}"), F.sum(many * (2 * F.col("m") + 5)).alias(f"b{''.join(on)}"))

    j = cells.groupBy("g", "_by").agg(F.sum("n").alias("n")).join(discordant, "g").join(ties("x"), "g").join(ties("y"), "g").join(ties("x", "y"), "g")
    all_pairs = pairs("n")
    s = all_pairs - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d")
    scale = F.sqrt((all_pairs - F.col("tx")) * (all_pairs - F.col("ty")))
    n, m = F.col("n").cast("double"), F.col("n").cast("double") * (F.col("n") - 1)
    variance = (m * (2 * n + 5) - F.col("bx") - F.col("by_")) / 18 + 2 * F.col("tx") * F.col("ty") / F.nullif(m, F.lit(0.0)) + F.coalesce(F.col("ax") * F.col("ay") / F.nullif(9 * m * (n - 2), F.lit(0.0)), F.lit(0.0))
    j = j.withColumnRenamed("by", "by_").withColumn("z", F.when((scale > 0) & (variance > 0), s / F.sqrt(variance)))
    j = j.withColumn("p_value", _tau_p("n", "d", F.col("tx") + F.col("ty"), "z"))
    return j.select(*(F.col(f"_by.{c}").alias(c) for c in by), "n", F.when(scale > 0, s / F.nullif(scale, F.lit(0.0))).otherwise(0.0).alias("tau"), "z", "p_value")


@F.pandas_udf(StructType([StructField("lower", DoubleType()), StructField("upper", DoubleType())]))
def _icc_bounds(f: pd.Series, n: pd.Series, k: pd.Series) -> pd.DataFrame:
    """Bounds of ICC(1,1) at 95 % from F quantiles."""

    def bounds(f_: float, n_: float, k_: float) -> tuple[float | None, float | None]:
        if not f_ == f_ or n_ < 3 or k_ < 2:
            return None, None
        d1, d2 = n_ - 1, n_ * (k_ - 1)
        low, high = f_ / f_quantile(0.975, d1, d2), f_ * f_quantile(0.975, d2, d1)
        return (low - 1) / (low + k_ - 1), (high - 1) / (high + k_ - 1)

    return pd.DataFrame([bounds(*r) for r in zip(f.astype(float), n.astype(float), k.astype(float), strict=True)], columns=["lower", "upper"])


def icc1(rows: DataFrame, subject: list[str], rating: str, by: list[str]) -> DataFrame:
    """ICC(1,1) from one-way sums, for the same number of ratings k of each subject, with its 95 % interval (null where ratings of a subject do not differ); 0 below three subjects."""
    per = rows.groupBy(*by, *subject).agg(F.count("*").alias("k"), F.avg(rating).alias("m"), (F.var_pop(rating) * F.count("*")).alias("within"))
    a = per.groupBy(*by).agg(F.count("*").alias("n"), F.max("k").alias("k"), F.var_samp("m").alias("vm"), F.sum("within").alias("w"))
    msb, msw = F.col("k") * F.col("vm"), F.col("w") / (F.col("n") * (F.col("k") - 1))
    d = msb + (F.col("k") - 1) * msw
    icc = F.when((F.col("n") < 3) | (d <= 0), 0.0).otherwise((msb - msw) / F.nullif(d, F.lit(0.0)))
    bounds = _icc_bounds(F.when(msw > 0, msb / msw), F.col("n"), F.col("k"))
    return a.select(*by, "n", "k", icc.alias("icc"), bounds.alias("_b")).select(*by, "n", "k", "icc", F.col("_b.lower").alias("ci_lower"), F.col("_b.upper").alias("ci_upper"))
