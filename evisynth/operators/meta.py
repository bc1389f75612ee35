"""Meta-analysis: effect rows, random-effects pooling, subgroup pooling, multiplicity and publication-bias diagnostics.

Pooling is algebraic: sums by group, then the group's own sums joined back (a few numbers a group), then sums again. Only
distribution functions, on the pooled rows, run in Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import special
from ..tables import in_ranges, running, written

#: Fixed value: the two-sided 5 % point of the normal distribution, where it is not rounded to 1.96.
Z_HALF = 1.959963984540054


def se_from_ci(low: Column, high: Column) -> Column:
    return F.when(high > low, (high - low) / (2 * 1.96)).otherwise(0.0)


def se_from_n(effect: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(4.0 / F.nullif(n, F.lit(0)) + effect * effect / (2.0 * F.nullif(n, F.lit(0))))).otherwise(0.0)


def hedges(effect: Column, n: Column) -> Column:
    """Small-sample correction with n - 2 degrees of freedom; without any, the effect as it is."""
    return F.when(n > 2, effect * (1.0 - 3.0 / (4.0 * (n - 2) - 1.0))).otherwise(effect)


def effect_rows(studies: DataFrame) -> DataFrame:
    """studies (study, effects array, samples array, intervals array of (lower, upper)) as study, y, se, v, n.

    The first of each list counts; effects with a sample of more than two are corrected; the error comes from the
    interval, else from n, else from n = 50; studies without an effect or an error go."""
    first = lambda c: F.get(F.col(c), F.lit(0))
    rows = studies.select("study", first("effects").alias("d"), first("samples").alias("n"), first("intervals").alias("ci")).where("d IS NOT NULL")
    rows = rows.withColumn("y", hedges(F.col("d"), F.coalesce("n", F.lit(0))))
    by_ci, n = se_from_ci(F.col("ci.lower"), F.col("ci.upper")), F.when(F.coalesce("n", F.lit(0)) > 0, F.col("n")).otherwise(50)
    rows = rows.withColumn("se", F.when(F.coalesce(by_ci, F.lit(0.0)) > 0, by_ci).otherwise(se_from_n(F.col("y"), n)))
    return rows.where("se > 0").select("study", "y", "se", (F.col("se") * F.col("se")).alias("v"), "n")


def pooled(effects: DataFrame, by: list[str]) -> DataFrame:
    """Random-effects estimates (DerSimonian-Laird) of y with variance v for each group of `by` ([]: one row over all).

    k, mu, se, ci_lower, ci_upper, z, tau2, i2, q. Groups of one study give that study, without tau2. Variances of 0 or
    less count as 1e-10. Q is summed in centred form."""
    one = F.lit(0).alias("_g")
    rows = effects.select(*by, one, "y", F.when(F.col("v") > 0, F.col("v")).otherwise(1e-10).alias("v")).withColumn("w", 1 / F.col("v"))
    keys = [*by, "_g"]
    first = rows.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("y")).alias("swy"), F.sum(F.col("w") * F.col("w")).alias("sww"))
    first = first.withColumn("fixed", F.col("swy") / F.col("sw"))
    second = rows.join(first, keys).groupBy(*keys).agg(F.first("k").alias("k"), F.first("sw").alias("sw"), F.first("sww").alias("sww"), F.sum(F.col("w") * F.pow(F.col("y") - F.col("fixed"), F.lit(2))).alias("q"))
    c = F.col("sw") - F.col("sww") / F.col("sw")
    excess = F.col("q") - (F.col("k") - 1)
    second = second.withColumn("tau2", F.when((F.col("k") > 1) & (c > 0), F.greatest(F.lit(0.0), excess / F.nullif(c, F.lit(0.0)))).otherwise(0.0))
    third = rows.join(second.select(*keys, "k", "q", "tau2"), keys).withColumn("r", 1 / (F.col("v") + F.col("tau2")))
    out = third.groupBy(*keys).agg(F.first("k").alias("k"), F.first("q").alias("q"), F.first("tau2").alias("tau2"), F.sum("r").alias("sr"), F.sum(F.col("r") * F.col("y")).alias("sry"))
    out = out.withColumns({"mu": F.col("sry") / F.col("sr"), "se": F.sqrt(1 / F.col("sr"))})
    i2 = F.when((F.col("q") > 0) & (F.col("k") > 1), F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.nullif(F.col("q"), F.lit(0.0)) * 100)).otherwise(0.0)
    return out.select(*by, "k", "mu", "se", (F.col("mu") - 1.96 * F.col("se")).alias("ci_lower"), (F.col("mu") + 1.96 * F.col("se")).alias("ci_upper"), (F.col("mu") / F.col("se")).alias("z"), "tau2", i2.alias("i2"), "q")


def with_p(estimates: DataFrame) -> DataFrame:
    """Adds p, q_p and the prediction interval to pooled rows."""

    @F.pandas_udf("struct<p:double,q_p:double,t:double>")
    def tails(z: pd.Series, q: pd.Series, k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"p": [2 * (1 - special.normal_cdf(abs(x))) for x in z], "q_p": [1 - special.chi2_cdf(x, n - 1) if n > 1 else 1.0 for x, n in zip(q, k, strict=True)], "t": [special.t_quantile(0.975, n - 2) if n > 2 else 0.0 for n in k]})

    rows = estimates.withColumn("x", tails("z", "q", "k"))
    wide = F.col("x.t") * F.sqrt(F.col("se") * F.col("se") + F.col("tau2"))
    return rows.select(*estimates.columns, "x.p", "x.q_p", F.when(F.col("k") > 2, F.col("mu") - wide).otherwise(0.0).alias("pred_lower"), F.when(F.col("k") > 2, F.col("mu") + wide).otherwise(0.0).alias("pred_upper"))


def reml(effects: DataFrame, by: list[str], rounds: int = 50, tol: float = 1e-8) -> DataFrame:
    """tau2 by restricted maximum likelihood, Fisher scoring from the DerSimonian-Laird start, for groups of three or more.

    Each round is one aggregation over all groups; groups that have converged keep their value."""
    rows = effects.select(*by, "y", F.when(F.col("v") > 0, F.col("v")).otherwise(1e-10).alias("v"))
    state = pooled(effects, by).where("k >= 3").select(*by, "tau2", F.lit(False).alias("done"))
    for _ in range(rounds):
        w = rows.join(state, by).withColumn("w", 1 / (F.col("v") + F.col("tau2")))
        mean = w.groupBy(*by).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m"))
        w2 = F.col("w") * F.col("w")
        s = w.join(mean, by).groupBy(*by).agg(F.first("tau2").alias("tau2"), F.first("done").alias("done"), F.sum("w").alias("sw"), F.sum(w2).alias("sw2"), F.sum(w2 * F.pow(F.col("y") - F.col("m"), F.lit(2))).alias("swr"))
        step = 0.5 * (F.col("swr") - F.col("sw") + F.col("sw2") / F.col("sw")) / (0.5 * F.col("sw2"))
        new = F.when(F.col("done"), F.col("tau2")).otherwise(F.greatest(F.lit(0.0), F.col("tau2") + step))
        state = written(s.select(*by, new.alias("tau2"), (F.col("done") | (F.abs(new - F.col("tau2")) < tol)).alias("done")), "reml")
        if not state.where("NOT done").limit(1).count():
            break
    return state.select(*by, "tau2")


def benjamini_hochberg(tests: DataFrame, p: str = "p", ties: str = "name", alpha: float = 0.05) -> DataFrame:
    """Adds adjusted_p and significant. The tests of one correction are the rows of the frame; they are ordered in ranges, so their number has no bound."""
    m = tests.count()
    rows = running(tests, [F.col(p).asc(), F.col(ties).asc()])
    rows = in_ranges(rows.withColumn("_raw", F.col(p) * m / (F.col("rank") + 1)), [F.col("rank").asc()])
    later = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)  # a row a range
    beyond = rows.groupBy("_range").agg(F.min("_raw").alias("_least")).select("_range", F.min("_least").over(later).alias("_beyond"))
    here = F.min("_raw").over(Window.partitionBy("_range").orderBy("rank").rowsBetween(0, Window.unboundedFollowing))
    rows = rows.join(beyond, "_range").withColumn("_adj", F.least(here, F.col("_beyond"), F.lit(1.0)))
    return rows.withColumns({"adjusted_p": F.round("_adj", 10), "significant": F.col("_adj") < alpha}).drop("rank", "_raw", "_adj", "_range", "_beyond")


def egger(effects: DataFrame, by: list[str]) -> DataFrame:
    """Regression of y / se on 1 / se for each group of three or more: intercept, its error, t, and k."""
    rows = effects.where("v > 0").select(*by, (F.col("y") / F.sqrt("v")).alias("s"), (1 / F.sqrt("v")).alias("x"))
    a = rows.groupBy(*by).agg(F.count("*").alias("k"), F.regr_intercept("s", "x").alias("intercept"), F.regr_sxx("s", "x").alias("sxx"), F.regr_syy("s", "x").alias("syy"), F.regr_sxy("s", "x").alias("sxy"), F.avg("x").alias("mx")).where("k >= 3")
    mse = (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("k") - 2)
    a = a.withColumn("se", F.sqrt(mse * (1 / F.col("k") + F.col("mx") * F.col("mx") / F.col("sxx"))))
    return a.select(*by, "k", "intercept", "se", F.when(F.col("se") > 0, F.col("intercept") / F.col("se")).otherwise(0.0).alias("t"))


def fail_safe(effects: DataFrame, by: list[str]) -> DataFrame:
    """Rosenthal's number of null studies that would undo the pooled result, and the 5k + 10 threshold."""
    a = effects.groupBy(*by).agg(F.count("*").alias("k"), F.sum(F.when(F.col("v") > 0, F.col("y") / F.sqrt("v")).otherwise(0.0)).alias("z"))
    n = F.greatest(F.lit(0), F.floor(F.pow(F.col("z") / Z_HALF, F.lit(2)) - F.col("k"))).cast("bigint")
    return a.select(*by, "k", n.alias("failsafe_n"), (5 * F.col("k") + 10).alias("threshold"), (n > 5 * F.col("k") + 10).alias("robust"))


def trim_and_fill(effects: DataFrame, by: list[str], order: str = "study") -> DataFrame:
    """k, n_imputed, original and adjusted effect. Residuals are ranked within a group, ties by `order`; the studies with the
    largest residuals are left out for the centre and mirrored around it."""
    base = pooled(effects, by).select(*by, "k", F.round("mu", 6).alias("theta")).where("k >= 3")
    rows = effects.select(*by, order, "y", "v").join(base, by).withColumn("res", F.col("y") - F.col("theta"))
    own = Window.partitionBy(*by)
    rows = rows.withColumns({"rank": F.row_number().over(own.orderBy("res", order)), "far": F.row_number().over(own.orderBy(F.desc(F.abs("res")), order)), "pos": F.count_if(F.col("res") > 0).over(own), "neg": F.count_if(F.col("res") < 0).over(own)})
    counted = F.when((F.col("pos") > F.col("neg")) & (F.col("res") > 0), F.col("rank")).when((F.col("neg") > F.col("pos")) & (F.col("res") < 0), F.col("rank")).otherwise(0)
    k = F.col("k")
    t = F.sum(counted).over(own)
    fill = F.when(F.col("pos") == F.col("neg"), 0).otherwise(F.greatest(F.lit(0), F.bround((4.0 * t - k * (k + 1)) / (2.0 * k)))).cast("int")
    rows = rows.withColumn("n_imputed", fill)
    kept = rows.where((F.col("far") > F.col("n_imputed")) | (k - F.col("n_imputed") < 2))
    centre = pooled(kept, by).select(*by, F.round("mu", 6).alias("centre"))
    mirrored = rows.where(F.col("far") <= F.col("n_imputed")).join(centre, by).select(*by, F.round(2 * F.col("centre") - F.col("y"), 6).alias("y"), "v")
    filled = pooled(effects.select(*by, "y", "v").unionByName(mirrored), by).select(*by, "mu")
    head = rows.groupBy(*by).agg(F.first("k").alias("k"), F.max("n_imputed").alias("n_imputed"), F.first("theta").alias("original"))
    return head.join(filled, by).select(*by, "k", "n_imputed", "original", F.when(F.col("n_imputed") == 0, F.col("original")).otherwise(F.round("mu", 6)).alias("adjusted"))


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t, for pooled rows."""
    return pd.Series([2 * (1 - special.t_cdf(abs(x), n)) if n > 0 else 1.0 for x, n in zip(t, df, strict=True)])


def bias_tests(effects: DataFrame, by: list[str]) -> DataFrame:
    """Egger, trim-and-fill and fail-safe N for each group of three or more: k, t, p, n_imputed, original, adjusted, failsafe_n, threshold, and concerns in that order.

    Concerns: p below 0.05 ("egger") or 0.10 ("egger borderline"), any imputed study ("imputed"), a fail-safe N below 5 k + 10 ("fail-safe")."""
    e = egger(effects, by).select(*by, "k", "t", t_two_sided("t", F.col("k") - 2).alias("p"))
    j = e.join(trim_and_fill(effects, by).drop("k"), by).join(fail_safe(effects, by).drop("k", "robust"), by)
    signs = [F.when(F.col("p") < 0.05, "egger").when(F.col("p") < 0.10, "egger borderline"), F.when(F.col("n_imputed") > 0, "imputed"), F.when(F.col("failsafe_n") < F.col("threshold"), "fail-safe")]
    return j.withColumn("concerns", F.array_compact(F.array(*signs)))


def two_groups(rows: DataFrame, group: str, value: str, by: list[str], first: object, second: object) -> DataFrame:
    """Standardised difference of two groups' means for each of `by`: n1, n2, d, g, pooled_sd."""
    a = rows.groupBy(*by).agg(*(f(F.when(F.col(group) == x, F.col(value))).alias(f"{n}{i}") for i, x in ((1, first), (2, second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)))).where("n1 >= 2 AND n2 >= 2")
    sd = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    d = F.when(sd > 0, (F.col("m1") - F.col("m2")) / F.nullif(sd, F.lit(0.0))).otherwise(0.0)
    return a.select(*by, "n1", "n2", sd.alias("pooled_sd"), d.alias("d"), (d * (1 - 3 / (4 * (F.col("n1") + F.col("n2")) - 9))).alias("g"))
