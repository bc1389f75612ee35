"""Queries on meta-analysis and agreement, over lineitem as studies and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import grading as G
from ..operators import agreement as A
from ..operators import meta as M
from ..tables import ranked_in_groups
from .registry import CLAIMS, EFFECTS, Registry, claims, effects, table

R = Registry()


def pool_sql(source: str, by: str, name: str = "pool") -> str:
    """Two-pass pooling of `source` by the key columns `by`, as further CTEs that end in `name`."""
    k = by or "0"
    return f"""{name}_w AS (SELECT {k} AS key, y, v, 1 / v AS w FROM {source}),
{name}_1 AS (SELECT key, count(*) AS k, sum(w) AS sw, sum(w * y) / sum(w) AS fixed, sum(w * w) AS sww FROM {name}_w GROUP BY key),
{name}_2 AS (SELECT key, any_value(k) AS k, any_value(sw) AS sw, any_value(sww) AS sww, sum(w * (y - fixed) * (y - fixed)) AS q FROM {name}_w JOIN {name}_1 USING (key) GROUP BY key),
{name}_3 AS (SELECT *, CASE WHEN k > 1 AND sw - sww / sw > 0 THEN greatest(0.0, (q - (k - 1)) / (sw - sww / sw)) ELSE 0.0 END AS tau2 FROM {name}_2),
{name} AS (SELECT key, any_value(k) AS k, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS mu, sqrt(1 / sum(1 / (v + tau2))) AS se, any_value(tau2) AS tau2, any_value(q) AS q,
  CASE WHEN any_value(q) > 0 AND any_value(k) > 1 THEN greatest(0.0, (any_value(q) - (any_value(k) - 1)) / any_value(q) * 100) ELSE 0.0 END AS i2 FROM {name}_w JOIN {name}_3 USING (key) GROUP BY key)"""


def rounded(df, places: int, *names: str):
    return df.withColumns({n: F.round(n, places) for n in names})


@R.query("m01_m03_effect_parts", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0 THEN l_tax / (2 * 1.96) ELSE 0.0 END, 8) AS se_ci, round(sqrt(4.0 / l_quantity + l_discount * l_discount / (2.0 * l_quantity)), 8) AS se_n, round(CASE WHEN l_quantity > 2 THEN l_discount * (1 - 3 / (4 * (l_quantity - 2) - 1)) ELSE l_discount END, 8) AS g FROM lineitem")
def _(spark, d):
    x = table(spark, d, "lineitem")
    low, high, y, n = F.lit(0.0), F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    return rounded(x.select("l_orderkey", "l_linenumber", M.se_from_ci(low, high).alias("se_ci"), M.se_from_n(y, n).alias("se_n"), M.hedges(y, n).alias("g")), 8, "se_ci", "se_n", "g")


@R.query("m04_effect_rows", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount, trunc(l_quantity), l_tax) AS rn FROM lineitem),
o AS (SELECT l_orderkey AS study, l_discount AS d, CAST(trunc(l_quantity) AS INT) AS n, l_tax AS width FROM f WHERE rn = 1),
g AS (SELECT study, n, width, CASE WHEN n > 2 THEN d * (1.0 - 3.0 / (4.0 * (n - 2) - 1.0)) ELSE d END AS y FROM o),
s AS (SELECT study, n, y, CASE WHEN width > 0 THEN width / (2 * 1.96) ELSE sqrt(4.0 / n + y * y / (2.0 * n)) END AS se FROM g)
SELECT study, round(y, 8) AS y, round(se, 8) AS se, n FROM s""")
def _(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("study")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_discount", F.col("l_quantity").cast("int").alias("q"), "l_tax"))).alias("r"))
    studies = x.select("study", F.col("r.l_discount").alias("effects"), F.col("r.q").alias("samples"), F.transform("r", lambda s: F.struct((s["l_discount"] * 0).alias("lower"), s["l_tax"].alias("upper"))).alias("intervals"))
    return rounded(M.effect_rows(studies), 8, "y", "se").select("study", "y", "se", "n")


@R.query("m05_dl_pool", f"WITH {EFFECTS}, {pool_sql('effects', '')} SELECT k, round(mu, 6) AS mu, round(se, 6) AS se, round(tau2, 9) AS tau2, round(i2, 3) AS i2, round(q, 3) AS q FROM pool")
def _(spark, d):
    p = M.pooled(effects(spark, d), [])
    return rounded(rounded(rounded(p, 6, "mu", "se"), 9, "tau2"), 3, "i2", "q").select("k", "mu", "se", "tau2", "i2", "q")


@R.query("m07_dl_pool_by_condition", f"WITH {EFFECTS}, {pool_sql('effects', 'condition')} SELECT key AS condition, k, round(mu, 6) AS mu, round(se, 6) AS se, round(mu - 1.96 * se, 6) AS ci_lower, round(mu + 1.96 * se, 6) AS ci_upper, round(tau2, 9) AS tau2, round(i2, 3) AS i2, round(q, 3) AS q FROM pool")
def _(spark, d):
    p = M.pooled(effects(spark, d), ["condition"])
    return rounded(rounded(rounded(p, 6, "mu", "se", "ci_lower", "ci_upper"), 9, "tau2"), 3, "i2", "q").drop("z")


@R.query("a16_pool_all_groupings", f"""WITH {EFFECTS}, named AS (SELECT e.*, n_name AS component FROM effects e JOIN supplier ON s_suppkey = study JOIN nation ON n_nationkey = s_nationkey),
g AS (SELECT 'overall' AS grp, y, v FROM named UNION ALL SELECT 'condition:' || condition, y, v FROM named UNION ALL SELECT 'component:' || component, y, v FROM named), {pool_sql('g', 'grp')}
SELECT key AS grp, k, round(mu, 6) AS mu, round(se, 6) AS se FROM pool WHERE k >= 2""")
def _(spark, d):
    """Overall, by condition and by component at once: each study is a row of three groups."""
    nations = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("study"), F.col("n_name").alias("component"))
    rows = effects(spark, d).join(nations, "study")
    rows = rows.withColumn("grp", F.explode(F.array(F.lit("overall"), F.concat(F.lit("condition:"), "condition"), F.concat(F.lit("component:"), "component"))))
    return rounded(M.pooled(rows, ["grp"]).where("k >= 2"), 6, "mu", "se").select("grp", "k", "mu", "se")


@R.query("m05_pool_p_values")
def _(spark, d):
    return rounded(M.with_p(M.pooled(effects(spark, d), ["condition"])), 8, "mu", "p", "q_p", "pred_lower", "pred_upper").select("condition", "k", "mu", "p", "q_p", "pred_lower", "pred_upper")


@R.query("m06_reml")
def _(spark, d):
    return rounded(M.reml(effects(spark, d), ["condition"]), 10, "tau2")


@R.query("w04_m08_benjamini_hochberg", """WITH p AS (SELECT p_brand AS name, (hash_free % 1000) / 1000.0 AS p FROM (SELECT p_brand, sum(p_size * p_partkey) AS hash_free FROM part GROUP BY p_brand)),
r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS rk, count(*) OVER () AS m FROM p), a AS (SELECT *, p * m / rk AS raw FROM r),
b AS (SELECT name, p, least(min(raw) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING), 1.0) AS adj FROM a)
SELECT name, CAST(p AS DOUBLE) AS p, round(CAST(adj AS DOUBLE), 8) AS adjusted_p, adj < 0.05 AS significant FROM b""")
def _(spark, d):
    tests = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(((F.sum(F.col("p_size") * F.col("p_partkey")) % 1000) / 1000.0).alias("p"))
    return rounded(M.benjamini_hochberg(tests), 8, "adjusted_p")


@R.query("m09_egger", f"""WITH {EFFECTS}, r AS (SELECT condition, y / sqrt(v) AS s, 1 / sqrt(v) AS x FROM effects),
a AS (SELECT condition, count(*) AS k, regr_intercept(s, x) AS b, regr_sxx(s, x) AS sxx, regr_syy(s, x) AS syy, regr_sxy(s, x) AS sxy, avg(x) AS mx FROM r GROUP BY condition),
e AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / (k - 2) * (1.0 / k + mx * mx / sxx)) AS se FROM a WHERE k >= 3) SELECT condition, k, round(b, 5) AS intercept, round(se, 5) AS se, round(b / se, 5) AS t FROM e""")
def _(spark, d):
    return rounded(M.egger(effects(spark, d), ["condition"]), 5, "intercept", "se", "t")


@R.query("m11_fail_safe_n", f"WITH {EFFECTS}, a AS (SELECT condition, count(*) AS k, sum(y / sqrt(v)) AS z FROM effects GROUP BY condition), f AS (SELECT *, CAST(greatest(0, floor(pow(z / {M.Z_HALF}, 2) - k)) AS BIGINT) AS failsafe_n FROM a) SELECT condition, k, failsafe_n, 5 * k + 10 AS threshold, failsafe_n > 5 * k + 10 AS robust FROM f")
def _(spark, d):
    return M.fail_safe(effects(spark, d), ["condition"])


@R.query("m10_trim_and_fill")
def _(spark, d):
    return M.trim_and_fill(effects(spark, d), ["condition"])


@R.query("m15_two_group_effect", """WITH a AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS n1, count(*) FILTER (l_linestatus = 'F') AS n2, avg(l_quantity) FILTER (l_linestatus = 'O') AS m1, avg(l_quantity) FILTER (l_linestatus = 'F') AS m2, var_samp(l_quantity) FILTER (l_linestatus = 'O') AS v1, var_samp(l_quantity) FILTER (l_linestatus = 'F') AS v2 FROM lineitem GROUP BY l_returnflag),
s AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sd FROM a WHERE n1 >= 2 AND n2 >= 2) SELECT l_returnflag, n1, n2, round(sd, 6) AS pooled_sd, round((m1 - m2) / sd, 6) AS d, round((m1 - m2) / sd * (1 - 3.0 / (4 * (n1 + n2) - 9)), 6) AS g FROM s""")
def _(spark, d):
    return rounded(M.two_groups(table(spark, d, "lineitem"), "l_linestatus", "l_quantity", ["l_returnflag"], "O", "F"), 6, "pooled_sd", "d", "g")


@R.query("k01_cohen_kappa", f"""WITH {CLAIMS}, t AS (SELECT l_returnflag, count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po FROM claims GROUP BY ALL),
x AS (SELECT l_returnflag, a AS c, count(*) AS na FROM claims GROUP BY ALL), y AS (SELECT l_returnflag, b AS c, count(*) AS nb FROM claims GROUP BY ALL),
e AS (SELECT l_returnflag, sum(na * nb) AS p FROM x JOIN y USING (l_returnflag, c) GROUP BY ALL)
SELECT l_returnflag, n, round(po, 8) AS po, round(p / CAST(n * n AS DOUBLE), 8) AS pe, round((po - p / CAST(n * n AS DOUBLE)) / (1 - p / CAST(n * n AS DOUBLE)), 8) AS kappa FROM t JOIN e USING (l_returnflag)""")
def _(spark, d):
    return rounded(A.cohen_kappa(claims(spark, d), "a", "b", ["l_returnflag"]), 8, "po", "pe", "kappa")


@R.query("k02_weighted_kappa", f"""WITH {CLAIMS}, o AS (SELECT l_returnflag, count(*) AS n, sum(abs(a - b)) AS o FROM claims GROUP BY ALL),
x AS (SELECT l_returnflag, a, count(*) AS na FROM claims GROUP BY ALL), y AS (SELECT l_returnflag, b, count(*) AS nb FROM claims GROUP BY ALL),
e AS (SELECT l_returnflag, sum(abs(a - b) * na * nb) AS e FROM x JOIN y USING (l_returnflag) GROUP BY ALL) SELECT l_returnflag, n, round(1 - o / (e / CAST(n AS DOUBLE)), 8) AS weighted_kappa FROM o JOIN e USING (l_returnflag)""")
def _(spark, d):
    return rounded(A.weighted_kappa(claims(spark, d), "a", "b", ["l_returnflag"]), 8, "weighted_kappa")


@R.query("k03_fleiss_kappa", f"""WITH {CLAIMS}, r AS (SELECT l_orderkey * 10 + l_linenumber AS s, a AS c FROM claims UNION ALL SELECT l_orderkey * 10 + l_linenumber, b FROM claims),
n AS (SELECT s, c, count(*) AS n FROM r GROUP BY ALL), p AS (SELECT s, sum(n) AS r, sum(n * n) AS ss FROM n GROUP BY s), o AS (SELECT count(*) AS subjects, max(r) AS raters, avg((ss - r) / CAST(r * (r - 1) AS DOUBLE)) AS po FROM p),
e AS (SELECT sum(k * k) / CAST(pow(sum(k), 2) AS DOUBLE) AS pe FROM (SELECT sum(n) AS k FROM n GROUP BY c))
SELECT subjects, CAST(raters AS BIGINT) AS raters, round((po - pe) / (1 - pe), 8) AS kappa FROM o, e""")
def _(spark, d):
    s = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = claims(spark, d).select(s.alias("s"), F.explode(F.array("a", "b")).alias("c"))
    return rounded(A.fleiss_kappa(rows, "s", "c"), 8, "kappa").select("subjects", "raters", "kappa")


@R.query("k04_pearson", f"WITH {CLAIMS} SELECT l_suppkey, count(*) AS n, round(CASE WHEN var_pop(a) = 0 OR var_pop(b) = 0 THEN 0.0 ELSE corr(a, b) END, 8) AS r FROM claims GROUP BY l_suppkey")
def _(spark, d):
    return rounded(A.correlation(claims(spark, d), "a", "b", ["l_suppkey"]), 8, "r")


@R.query("k05_labels", f"WITH {CLAIMS}, k AS (SELECT l_suppkey, avg(CAST(abs(a - b) <= 1 AS DOUBLE)) AS x FROM claims GROUP BY l_suppkey) SELECT l_suppkey, round(x, 8) AS x, CASE WHEN x < 0.2 THEN 'poor' WHEN x < 0.4 THEN 'fair' WHEN x < 0.6 THEN 'moderate' WHEN x < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS label FROM k")
def _(spark, d):
    k = claims(spark, d).groupBy("l_suppkey").agg(F.avg((F.abs(F.col("a") - F.col("b")) <= 1).cast("double")).alias("x"))
    return k.withColumn("label", A.label_of(F.col("x"))).withColumn("x", F.round("x", 8))


@R.query("k06_k10_run_agreement", f"""WITH {CLAIMS} SELECT l_returnflag, count(*) AS n, round(avg(CAST(a = b AS DOUBLE)), 8) AS exact, round(avg(CAST(abs(a - b) <= 1 AS DOUBLE)), 8) AS within_1, round(avg(abs(a - b)), 8) AS mean_abs,
  round(avg(CAST((CASE WHEN a <= 2 THEN 0 WHEN a <= 4 THEN 1 ELSE 2 END) = (CASE WHEN b <= 2 THEN 0 WHEN b <= 4 THEN 1 ELSE 2 END) AS DOUBLE)), 8) AS same_bin FROM claims GROUP BY l_returnflag""")
def _(spark, d):
    bin_ = lambda c: F.when(F.col(c) <= 2, 0).when(F.col(c) <= 4, 1).otherwise(2)
    share = lambda x: F.round(F.avg(x.cast("double")), 8)
    gap = F.abs(F.col("a") - F.col("b"))
    return claims(spark, d).groupBy("l_returnflag").agg(F.count("*").alias("n"), share(gap == 0).alias("exact"), share(gap <= 1).alias("within_1"), share(gap).alias("mean_abs"), share(bin_("a") == bin_("b")).alias("same_bin"))


@R.query("w03_k07_spearman", f"""WITH {CLAIMS}, r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY a) + (count(*) OVER (PARTITION BY l_returnflag, a) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY b) + (count(*) OVER (PARTITION BY l_returnflag, b) - 1) / 2.0 AS y FROM claims)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 7) AS rho FROM r GROUP BY l_returnflag""")
def _(spark, d):
    return rounded(A.spearman(claims(spark, d), "a", "b", ["l_returnflag"]), 7, "rho")


@R.query("k08_kendall_tau", f"""WITH {CLAIMS}, c AS (SELECT l_returnflag, a, b, count(*) AS n FROM claims GROUP BY ALL),
s AS (SELECT x.l_returnflag, sum(sign(x.a - y.a) * sign(x.b - y.b) * x.n * y.n) AS s FROM c x JOIN c y ON x.l_returnflag = y.l_returnflag AND (x.a < y.a OR (x.a = y.a AND x.b < y.b)) GROUP BY ALL),
tx AS (SELECT l_returnflag, sum(m * (m - 1) / 2.0) AS t FROM (SELECT l_returnflag, a, count(*) AS m FROM claims GROUP BY ALL) GROUP BY ALL), ty AS (SELECT l_returnflag, sum(m * (m - 1) / 2.0) AS t FROM (SELECT l_returnflag, b, count(*) AS m FROM claims GROUP BY ALL) GROUP BY ALL),
n AS (SELECT l_returnflag, count(*) AS n FROM claims GROUP BY ALL)
SELECT l_returnflag, n, round(s / sqrt((n * (n - 1) / 2.0 - tx.t) * (n * (n - 1) / 2.0 - ty.t)), 8) AS tau FROM n JOIN s USING (l_returnflag) JOIN tx USING (l_returnflag) JOIN ty USING (l_returnflag)""")
def _(spark, d):
    return rounded(A.kendall(claims(spark, d), "a", "b", ["l_returnflag"]), 8, "tau").select("l_returnflag", "n", "tau")


@R.query("k08_kendall_fine", """WITH x AS (SELECT o_orderpriority AS g, CAST(round(o_totalprice) AS BIGINT) // 500 AS x, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + o_custkey AS y FROM orders),
s AS (SELECT p.g, sum(sign(p.x - q.x) * sign(p.y - q.y)) AS s FROM x p JOIN x q ON p.g = q.g AND (p.x < q.x OR (p.x = q.x AND p.y < q.y)) GROUP BY p.g), n AS (SELECT g, count(*)::DOUBLE AS n FROM x GROUP BY g),
tx AS (SELECT g, sum(m * (m - 1) / 2) AS t, sum(m * (m - 1) * (m - 2)) AS a, sum(m * (m - 1) * (2 * m + 5)) AS b FROM (SELECT g, x, count(*)::DOUBLE AS m FROM x GROUP BY ALL) GROUP BY g),
ty AS (SELECT g, sum(m * (m - 1) / 2) AS t, sum(m * (m - 1) * (m - 2)) AS a, sum(m * (m - 1) * (2 * m + 5)) AS b FROM (SELECT g, y, count(*)::DOUBLE AS m FROM x GROUP BY ALL) GROUP BY g)
SELECT g, n::BIGINT AS n, round(s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 8) AS tau, round(s / sqrt((n * (n - 1) * (2 * n + 5) - tx.b - ty.b) / 18 + 2 * tx.t * ty.t / (n * (n - 1)) + tx.a * ty.a / (9 * n * (n - 1) * (n - 2))), 6) AS z FROM n JOIN s USING (g) JOIN tx USING (g) JOIN ty USING (g)""")
def _(spark, d):
    """Prices against days shifted by customer, two sides of very many values."""
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400) + F.col("o_custkey")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.floor(F.round("o_totalprice").cast("bigint") / 500).alias("x"), day.alias("y"))
    return rounded(rounded(A.kendall(rows, "x", "y", ["g"]), 8, "tau"), 6, "z").select("g", "n", "tau", "z")


@R.query("k09_icc", f"""WITH {CLAIMS}, r AS (SELECT l_returnflag, l_orderkey, l_linenumber, unnest([a, b]) AS r FROM claims),
p AS (SELECT l_returnflag, l_orderkey, l_linenumber, count(*) AS k, avg(r) AS m, var_pop(r) * count(*) AS w FROM r GROUP BY ALL),
g AS (SELECT l_returnflag, count(*) AS n, max(k) AS k, max(k) * var_samp(m) AS msb, sum(w) / (count(*) * (max(k) - 1)) AS msw FROM p GROUP BY ALL)
SELECT l_returnflag, n, k, round((msb - msw) / (msb + (k - 1) * msw), 7) AS icc FROM g""")
def _(spark, d):
    rows = claims(spark, d).select("l_returnflag", "l_orderkey", "l_linenumber", F.explode(F.array("a", "b")).alias("r"))
    return rounded(A.icc1(rows, ["l_orderkey", "l_linenumber"], "r", ["l_returnflag"]), 7, "icc").drop("ci_lower", "ci_upper")


@R.query("w11_upper_median", f"WITH {CLAIMS}, r AS (SELECT l_suppkey, a, row_number() OVER (PARTITION BY l_suppkey ORDER BY a) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM claims) SELECT l_suppkey, a AS median FROM r WHERE rn = n // 2 + 1")
def _(spark, d):
    own = Window.partitionBy("l_suppkey")
    rows = claims(spark, d).withColumns({"rn": F.row_number().over(own.orderBy("a")), "n": F.count("*").over(own)})
    return rows.where(F.col("rn") == F.floor(F.col("n") / 2) + 1).select("l_suppkey", F.col("a").alias("median"))


@R.query("w05_residual_rank", f"WITH {EFFECTS} SELECT study, condition, CAST(row_number() OVER (PARTITION BY condition ORDER BY round(y, 9), study) AS INT) AS rank FROM effects")
def _(spark, d):
    rows = ranked_in_groups(effects(spark, d), ["condition"], [F.round("y", 9), F.col("study")])
    return rows.select("study", "condition", (F.col("rank") + 1).cast("int").alias("rank"))


@R.query("a24_threshold_sensitivity", f"WITH {CLAIMS}, t AS (SELECT unnest(range(1, 6)) AS t) SELECT t AS threshold, count(*) FILTER (a >= t) AS n_pass, round(100.0 * count(*) FILTER (a >= t) / count(*), 4) AS pct, round(avg(b) FILTER (a >= t), 6) AS mean_pass FROM claims, t GROUP BY t")
def _(spark, d):
    """Thresholds 1 to 5: every claim counts for those that its score passes, so rows are first counted by score."""
    by = claims(spark, d).groupBy("a").agg(F.count("*").alias("n"), F.sum("b").alias("s")).withColumn("threshold", F.explode(F.sequence(F.lit(1), F.lit(5)).cast("array<bigint>")))
    ok = F.col("a") >= F.col("threshold")
    out = by.groupBy("threshold").agg(F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("n_pass"), F.sum("n").alias("n"), F.sum(F.when(ok, F.col("s"))).alias("s"))
    return out.select("threshold", "n_pass", F.round(100.0 * F.col("n_pass") / F.col("n"), 4).alias("pct"), F.round(F.col("s") / F.col("n_pass"), 6).alias("mean_pass"))


@R.query("a25_two_group_rates", f"WITH {CLAIMS} SELECT l_returnflag = 'R' AS flagged, count(*) AS n, round(avg(CAST(a >= 3 AS DOUBLE)), 8) AS rate FROM claims GROUP BY ALL")
def _(spark, d):
    return claims(spark, d).groupBy((F.col("l_returnflag") == "R").alias("flagged")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") >= 3).cast("double")), 8).alias("rate"))


@R.query("a28_label_metrics", """WITH j AS (SELECT quality, n_chars % 101 >= 50 AS hit FROM documents JOIN labels USING (doc_id)) SELECT count(*) AS n, round(count(*) FILTER (hit AND quality = 1) / CAST(nullif(count(*) FILTER (quality = 1), 0) AS DOUBLE), 8) AS recall, round(count(*) FILTER (hit AND quality = 1) / CAST(nullif(count(*) FILTER (hit), 0) AS DOUBLE), 8) AS precision_high FROM j""")
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 101 >= 50).alias("hit")).join(table(spark, d, "labels"), "doc_id")
    both = F.count_if(F.col("hit") & (F.col("quality") == 1))
    ratio = lambda n: F.round(both / F.nullif(n, F.lit(0)), 8)
    return j.agg(F.count("*").alias("n"), ratio(F.count_if(F.col("quality") == 1)).alias("recall"), ratio(F.count_if("hit")).alias("precision_high"))


@R.query("e16_calibration_error", "WITH p AS (SELECT (n_chars % 101) / 100.0 AS p, quality AS y FROM documents JOIN labels USING (doc_id)), b AS (SELECT least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM p GROUP BY ALL) SELECT round(CAST(sum(n * abs(mp - my)) AS DOUBLE) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b")
def _(spark, d):
    p = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(((F.col("n_chars") % 101) / 100.0).alias("p"), "quality")
    b = p.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("quality").alias("my"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


@R.query("c03_regression_metrics", "WITH r AS (SELECT l_quantity AS y, l_extendedprice / 2000 AS p FROM lineitem) SELECT count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(corr(y, p), 6) AS r FROM r")
def _(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2000).alias("p"))
    e = F.col("y") - F.col("p")
    return r.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(1 - F.sum(e * e) / (F.var_pop("y") * F.count("*")), 6).alias("r2"), F.round(F.corr("y", "p"), 6).alias("r"))


@R.query("c05_feature_z_scores", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS z_size, CAST(p_retailprice > 1000 AS INT) AS costly FROM part")
def _(spark, d):
    x = table(spark, d, "part")
    s = x.agg(F.avg("p_size").alias("m"), F.stddev_samp("p_size").alias("s"))
    return x.join(F.broadcast(s)).select("p_partkey", F.round((F.col("p_size") - F.col("m")) / F.col("s"), 6).alias("z_size"), (F.col("p_retailprice") > 1000).cast("int").alias("costly"))


@R.query("a12_run_summary", f"WITH {CLAIMS} SELECT l_suppkey AS run, count(*) AS n, round(avg(a), 6) AS mean_score, {', '.join(f'count(*) FILTER (a = {i}) AS score_{i}' for i in range(6))}, round(avg(CASE WHEN b > 0 THEN CAST(b >= 3 AS DOUBLE) END), 6) AS rate FROM claims GROUP BY l_suppkey")
def _(spark, d):
    return claims(spark, d).groupBy(F.col("l_suppkey").alias("run")).agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_score"), *(F.count_if(F.col("a") == i).alias(f"score_{i}") for i in range(6)), F.round(F.avg(F.when(F.col("b") > 0, (F.col("b") >= 3).cast("double"))), 6).alias("rate"))


#: Bias tests in SQL: Egger's t with its two-sided p (the density summed by Simpson's rule), what trim-and-fill imputes, and the fail-safe N, for each condition.
BIAS = f"""{EFFECTS}, {pool_sql('effects', 'condition')}, r AS (SELECT condition, y / sqrt(v) AS s, 1 / sqrt(v) AS x FROM effects),
a AS (SELECT condition, count(*) AS k, regr_intercept(s, x) AS b, regr_sxx(s, x) AS sxx, regr_syy(s, x) AS syy, regr_sxy(s, x) AS sxy, avg(x) AS mx FROM r GROUP BY condition),
eg AS (SELECT condition, k, CAST(k - 2 AS DOUBLE) AS n, b / sqrt((syy - sxy * sxy / sxx) / (k - 2) * (1.0 / k + mx * mx / sxx)) AS t FROM a WHERE k >= 3),
pt AS (SELECT condition, any_value(k) AS k, any_value(t) AS t, 1 - 2 * sum(exp(lgamma((n + 1) / 2) - lgamma(n / 2)) / sqrt(n * pi()) * pow(1 + pow(abs(t) * i / 2000, 2) / n, -(n + 1) / 2) * CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * any_value(abs(t)) / 2000 / 3 AS p FROM eg, range(2001) q(i) GROUP BY condition),
res AS (SELECT condition, study, y - round(mu, 6) AS res FROM effects JOIN pool ON key = condition),
rk AS (SELECT condition, res, row_number() OVER (PARTITION BY condition ORDER BY res, study) AS rank, count(*) FILTER (res > 0) OVER (PARTITION BY condition) AS pos, count(*) FILTER (res < 0) OVER (PARTITION BY condition) AS neg, count(*) OVER (PARTITION BY condition) AS k FROM res),
tf AS (SELECT condition, CAST(CASE WHEN any_value(pos) = any_value(neg) THEN 0 ELSE greatest(0, round_even((4.0 * sum(CASE WHEN (pos > neg AND res > 0) OR (neg > pos AND res < 0) THEN rank ELSE 0 END) - any_value(k) * (any_value(k) + 1)) / (2.0 * any_value(k)), 0)) END AS INT) AS n_imputed FROM rk GROUP BY condition),
fs AS (SELECT condition, CAST(greatest(0, floor(pow(sum(y / sqrt(v)) / {M.Z_HALF}, 2) - count(*))) AS BIGINT) AS failsafe_n FROM effects GROUP BY condition),
bias AS (SELECT condition, pt.k, p, n_imputed, failsafe_n, 5 * pt.k + 10 AS threshold FROM pt JOIN tf USING (condition) JOIN fs USING (condition))"""


@R.query("m12_bias_verdict", f"WITH {BIAS} SELECT condition, k, round(p, 6) AS p, n_imputed, failsafe_n, array_to_string(list_filter([CASE WHEN p < 0.05 THEN 'egger' WHEN p < 0.10 THEN 'egger borderline' END, CASE WHEN n_imputed > 0 THEN 'imputed' END, CASE WHEN failsafe_n < threshold THEN 'fail-safe' END], lambda x: x IS NOT NULL), ',') AS concerns FROM bias")
def _(spark, d):
    """Egger's p with k - 2 degrees of freedom, any imputed study, and the fail-safe rule."""
    return M.bias_tests(effects(spark, d), ["condition"]).select("condition", "k", F.round("p", 6).alias("p"), "n_imputed", "failsafe_n", F.array_join("concerns", ",").alias("concerns"))


@R.query("g05_publication_bias", f"WITH {BIAS} SELECT condition, CASE WHEN p < 0.05 THEN 2 WHEN p < 0.10 OR (failsafe_n > 0 AND failsafe_n < threshold) THEN 1 ELSE 0 END AS downgrade FROM bias")
def _(spark, d):
    """The domain's downgrade from the bias tests of each condition. Effects lie between 0 and 0.1, so imputed studies cannot move them by 0.2."""
    b = M.bias_tests(effects(spark, d), ["condition"])
    down = G.publication_bias(F.col("k"), F.col("p"), F.col("n_imputed"), F.abs(F.col("original") - F.col("adjusted")), F.col("failsafe_n"))
    return b.select("condition", down.cast("int").alias("downgrade"))


@R.query("m13_analysis", f"WITH {BIAS} SELECT condition, pool.k AS k, round(mu, 6) AS mu, round(se, 6) AS se, round(i2, 3) AS i2, round(p, 6) AS egger_p, n_imputed, failsafe_n FROM pool JOIN bias ON pool.key = bias.condition")
def _(spark, d):
    """Pooled effect, heterogeneity and bias tests of every condition in one table."""
    e = effects(spark, d)
    j = M.pooled(e, ["condition"]).join(M.bias_tests(e, ["condition"]).select("condition", F.col("p").alias("egger_p"), "n_imputed", "failsafe_n"), "condition")
    return rounded(rounded(j, 6, "mu", "se", "egger_p"), 3, "i2").select("condition", "k", "mu", "se", "i2", "egger_p", "n_imputed", "failsafe_n")
