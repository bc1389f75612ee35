"""Queries on extraction, resampling, topics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import extract as X
from ..operators import resample as B
from ..operators import topics as P
from ..streaming import runs as V
from ..tables import in_ranges, new_folder, partitions
from .registry import CLAIMS, Registry, claims, papers, table

R = Registry()


KEYS = ["l_orderkey", "l_linenumber", "l_suppkey"]
K = ", ".join(KEYS)


def reports(spark, d):
    """lineitem as sentences that report results, from integers so that no number is formatted."""
    q, l, s = F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.col("l_suppkey")
    text = F.concat(F.lit("The trial included "), q + 2, F.lit(" participants; t("), q, F.lit(") = "), l, F.lit(". "), F.lpad((s % 100).cast("string"), 2, "0"), F.lit(", p < 0.0"), l, F.lit(", d = 0."), (q % 9) + 1, F.lit(", 95% CI 0."), l, F.lit(" to 0."), l + 2, F.lit(" at ("), q - 25, F.lit(", "), s % 60, F.lit(", 12)."))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", text.alias("text"))


REPORTS = """reports AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(trunc(l_quantity) AS INT) AS q, 'The trial included ' || (q + 2) || ' participants; t(' || q || ') = ' || l_linenumber || '. ' || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') || ', p < 0.0' || l_linenumber || ', d = 0.' || (q % 9 + 1) || ', 95% CI 0.' || l_linenumber || ' to 0.' || (l_linenumber + 2) || ' at (' || (q - 25) || ', ' || (l_suppkey % 60) || ', 12).' AS text FROM lineitem)"""


def studies(spark, d):
    """lineitem as paragraphs: odd lines report a study in full, even ones a bare statistic."""
    q, l, s = F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.col("l_suppkey")
    two, k = F.lpad((s % 100).cast("string"), 2, "0"), q % 9 + 1
    c = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    full = c("We enrolled ", q + 10, " patients and N = ", q + 60, ". Age mean ", l + 8, ".5 years, SD = 1.", l, ". Treated group versus control group: t(", q, ") = ", l, ".", two, ", p < 0.0", l, ". Later F(2, ", q, ") = ", l, ". ", k, ", p = 0. 0", l, "; OR = ", l, ".", k, ", r = -0.", k, ", 95% CI [0.", l, ", 0.", l + 2, "].")
    return table(spark, d, "lineitem").select(*KEYS, F.concat_ws("-", *KEYS).alias("id"), F.when(l % 2 == 1, full).otherwise(c("We saw a significant z = ", l, ".", k, " only.")).alias("text"))


STUDIES = """st AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_linenumber AS l, CAST(trunc(l_quantity) AS INT) AS q, CAST(trunc(l_quantity) AS INT) % 9 + 1 AS k, lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') AS two, l_linenumber % 2 = 1 AS whole FROM lineitem)"""


@R.query("x03_p_values", f"WITH {REPORTS} SELECT {K}, regexp_extract(text, 'p\\s*([<>=]+)', 1) AS operator, CAST(regexp_extract(text, 'p\\s*[<>=]+\\s*([0-9.]+)', 1) AS DOUBLE) AS value FROM reports")
def _(spark, d):
    return X.exploded(reports(spark, d), X.p_values(F.col("text")), "p").select(*KEYS, "p.operator", "p.value")


@R.query("x04_intervals", f"WITH {REPORTS} SELECT {K}, 95 AS level, CAST(regexp_extract(text, 'CI ([0-9.]+) to', 1) AS DOUBLE) AS lower, CAST(regexp_extract(text, 'CI [0-9.]+ to ([0-9.]+)', 1) AS DOUBLE) AS upper FROM reports")
def _(spark, d):
    return X.exploded(reports(spark, d), X.intervals(F.col("text")), "c").select(*KEYS, "c.*")


@R.query("x05_effect_sizes", f"WITH {STUDIES} SELECT {K}, 'or' AS type, CAST(l || '.' || k AS DOUBLE) AS value FROM st WHERE whole UNION ALL SELECT {K}, 'r', CAST('-0.' || k AS DOUBLE) FROM st WHERE whole")
def _(spark, d):
    return X.exploded(studies(spark, d), X.effect_sizes(F.col("text")), "e").select(*KEYS, "e.*")


@R.query("x06_subjects_and_age", f"WITH {STUDIES} SELECT {K}, q + 10 AS n, 'patients' AS label, CAST((l + 8) || '.5' AS DOUBLE) AS age_mean, CAST('1.' || l AS DOUBLE) AS age_sd FROM st WHERE whole UNION ALL SELECT {K}, q + 60, 'sample', CAST((l + 8) || '.5' AS DOUBLE), CAST('1.' || l AS DOUBLE) FROM st WHERE whole")
def _(spark, d):
    x = X.exploded(studies(spark, d).withColumn("a", X.age(F.col("text"))), X.subjects(F.col("text")), "s")
    return x.select(*KEYS, "s.*", F.col("a.mean").alias("age_mean"), F.col("a.sd").alias("age_sd"))


@R.query("x07_comparisons", f"WITH {STUDIES} SELECT {K}, 'Treated group vs control group' AS comparison FROM st WHERE whole")
def _(spark, d):
    return X.exploded(studies(spark, d), X.comparisons(F.col("text")), "comparison").select(*KEYS, "comparison")


@R.query("t09_nearest_p", f"WITH {STUDIES}, t AS (SELECT *, unnest(['t_test', 'f_test', 'odds_or_risk_ratio', 'correlation']) AS test FROM st WHERE whole) SELECT {K}, test, CASE WHEN test = 't_test' THEN '<' ELSE '=' END AS operator, CAST('0.0' || l AS DOUBLE) AS value FROM t")
def _(spark, d):
    """Each statistic's nearest p-value."""
    x = studies(spark, d).withColumn("key", F.struct(*KEYS))
    r = X.results(x, "key", "text", ["test", "p_values"]).where(F.size("p_values") > 0)
    return r.select("key.*", "test", F.get("p_values", F.lit(0)).alias("n")).select(*KEYS, "test", "n.*")


@R.query("x10_article_results", f"""WITH {STUDIES} SELECT l_orderkey, CAST(sum(CASE WHEN whole THEN 4 ELSE 1 END) AS BIGINT) AS n_results, count(*) FILTER (NOT whole) AS n_review, CAST(sum(CASE WHEN whole THEN 0 ELSE 4 END) AS BIGINT) AS n_missing, round(sum(CASE WHEN whole THEN CAST(l || '.' || two AS DOUBLE) + CAST(l || '.' || k AS DOUBLE) * 2 - CAST('0.' || k AS DOUBLE) ELSE CAST(l || '.' || k AS DOUBLE) END), 4) AS total FROM st GROUP BY l_orderkey""")
def _(spark, d):
    """Every statistic of an article's paragraphs with what is around it; counts of results, of those to review and of what they lack, and the sum of statistics."""
    x = studies(spark, d).withColumn("key", F.struct("l_orderkey", "id"))
    r = X.results(x, "key", "text", ["statistic", "missing_fields", "needs_review"]).groupBy("key.l_orderkey")
    return r.agg(F.count("*").alias("n_results"), F.count_if("needs_review").alias("n_review"), F.sum(F.size("missing_fields")).alias("n_missing"), F.round(F.sum("statistic"), 4).alias("total"))


@R.query("x09_review_flags", f"WITH {STUDIES} SELECT l_orderkey, 'partial_statistical_result' AS reason, 'p_value_or_ci,effect_size,subjects,comparison' AS missing, count(*) AS n FROM st WHERE NOT whole GROUP BY 1")
def _(spark, d):
    x = studies(spark, d).withColumn("key", F.struct("l_orderkey", "id"))
    return X.review_flags(x, "key", "text").groupBy("key.l_orderkey", "reason", F.array_join("missing_fields", ",").alias("missing")).agg(F.count("*").alias("n"))


@R.query("x11_repaired_rows", f"WITH {STUDIES} SELECT {K}, CASE WHEN whole THEN CAST(l || '.' || two AS DOUBLE) ELSE l END AS statistic, CASE WHEN whole THEN CAST('0.0' || l AS DOUBLE) ELSE 0.5 END AS p FROM st")
def _(spark, d):
    """Rows whose decimals were cut at a blank, read again from their context; others stay."""
    l, odd = F.col("l_linenumber"), F.col("l_linenumber") % 2 == 1
    two = F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0")
    spaced = F.concat(F.lit("as t("), F.col("l_quantity").cast("int"), F.lit(") = "), l, F.lit(". "), two, F.lit(", p = 0. 0"), l, F.lit(" shows"))
    rows = table(spark, d, "lineitem").select(*KEYS, F.lit("t_test").alias("test"), l.cast("double").alias("statistic"), F.array(F.struct(F.lit("=").alias("operator"), F.when(odd, 0.0).otherwise(0.5).alias("value"))).alias("p_values"), F.when(odd, spaced).otherwise("t(3) = 4.0").alias("context"))
    return X.repaired(rows).select(*KEYS, "statistic", F.get("p_values", F.lit(0))["value"].alias("p"))


def _values(spark, d, text, columns, fields):
    """Long rows (keys, kind, value) of array columns, structs by field."""
    x = table(spark, d, "lineitem").select(*KEYS, text.alias("text")).select(*KEYS, *columns)
    number = lambda c, f: F.transform(c, lambda v: F.struct(F.lit(c if f is None else f"{c}.{f}").alias("kind"), (v if f is None else v[f]).cast("double").alias("value")))
    return X.exploded(x, F.concat(*(number(c, f) for c, f in fields)), "v").select(*KEYS, "v.*")


@R.query("x13_full_text_metrics", f"""WITH {STUDIES}, v AS (SELECT *, unnest([{{'kind': 'effect_sizes.value', 'value': CAST('0.' || k || '5' AS DOUBLE)}}, {{'kind': 'effect_sizes.value', 'value': CAST('0.' || k || '2' AS DOUBLE)}}, {{'kind': 'effect_sizes.value', 'value': CAST(l || '.' || k AS DOUBLE)}},
  {{'kind': 'sample_sizes', 'value': CAST(q + 60 AS DOUBLE)}}, {{'kind': 'sample_sizes', 'value': CAST(1100 + q AS DOUBLE)}}, {{'kind': 'confidence_intervals.lower', 'value': CAST('0.' || l AS DOUBLE)}}, {{'kind': 'confidence_intervals.lower', 'value': CAST('0.' || l AS DOUBLE)}},
  {{'kind': 'confidence_intervals.upper', 'value': CAST('0.' || (l + 2) AS DOUBLE)}}, {{'kind': 'confidence_intervals.upper', 'value': CAST('0.' || (l + 1) AS DOUBLE)}}, {{'kind': 'p_values.value', 'value': CAST('0.0' || l AS DOUBLE)}}]) AS x FROM st) SELECT {K}, x.kind AS kind, x.value AS value FROM v""")
def _(spark, d):
    q, l = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    k = q % 9 + 1
    c = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    text = c("Cohen's d = 0.", k, "5, Hedges' g = 0.", k, "2, OR = ", l, ".", k, "; sample (N = ", q + 60, ") and a total of 1,", q + 100, " participants; 95% CI [0.", l, ", 0.", l + 2, "]; 90% CI 0.", l, " to 0.", l + 1, ". P < 0.0", l)
    fields = [("effect_sizes", "value"), ("sample_sizes", None), ("confidence_intervals", "lower"), ("confidence_intervals", "upper"), ("p_values", "value")]
    return _values(spark, d, text, X.metrics(F.col("text")), fields)


@R.query("x14_abstract_numbers", f"""WITH {STUDIES}, v AS (SELECT *, unnest([{{'kind': 'paper_counts', 'value': CAST(1200 + q AS DOUBLE)}}, {{'kind': 'percentages', 'value': CAST(q || '.5' AS DOUBLE)}}, {{'kind': 'kappa_values', 'value': CAST('0.' || k AS DOUBLE)}}, {{'kind': 'ci_values.lower', 'value': CAST('0.' || l AS DOUBLE)}}, {{'kind': 'ci_values.upper', 'value': CAST('0.' || (l + 2) AS DOUBLE)}},
  {{'kind': 'p_values.value', 'value': CAST('0.0' || l AS DOUBLE)}}, {{'kind': 'correlations', 'value': CAST('-0.' || k AS DOUBLE)}}, {{'kind': 'generic_counts', 'value': CAST(q AS DOUBLE)}}]) AS x FROM st) SELECT {K}, x.kind AS kind, x.value AS value FROM v""")
def _(spark, d):
    q, l = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    k = q % 9 + 1
    c = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    text = c("We read 1,", q + 200, " studies: ", q, ".5% agreed, Cohen's κ = 0.", k, ", CI [0.", l, ", 0.", l + 2, "], p < 0.0", l, ", r = -0.", k, "; ", q, " of these conditions.")
    fields = [("paper_counts", None), ("percentages", None), ("kappa_values", None), ("ci_values", "lower"), ("ci_values", "upper"), ("p_values", "value"), ("correlations", None), ("generic_counts", None)]
    return _values(spark, d, text, X.abstract_numbers(F.col("text")), fields)


@R.query("a17_article_metrics", f"WITH {REPORTS} SELECT l_orderkey, count(*) AS n_results, max(CAST(regexp_extract(text, '(\\d+) participants', 1) AS INT)) AS largest_n, count(DISTINCT regexp_extract(text, 'd = ([0-9.]+)', 1)) AS n_effects FROM reports GROUP BY l_orderkey")
def _(spark, d):
    r = reports(spark, d).select("l_orderkey", X.effects(F.col("text"))[0].alias("e"), F.array_max(X.sample_sizes(F.col("text"))).alias("n"))
    return r.groupBy("l_orderkey").agg(F.count("*").alias("n_results"), F.max("n").alias("largest_n"), F.count_distinct("e").alias("n_effects"))


@R.query("x02_test_statistics", f"WITH {REPORTS}, t AS (SELECT l_orderkey, l_linenumber, 't_test' AS test, CAST(l_linenumber || '.' || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS statistic FROM reports UNION ALL SELECT l_orderkey, l_linenumber, 'effect_size', CAST('0.' || (q % 9 + 1) AS DOUBLE) FROM reports) SELECT test, count(*) AS n, round(sum(statistic), 2) AS total FROM t GROUP BY test")
def _(spark, d):
    """Spans read by earlier patterns are left out by later ones; numbers may have blanks at their point."""
    r = reports(spark, d).select(F.col("l_orderkey").alias("id"), "text")
    return X.test_statistics(r, "id", "text").groupBy("test").agg(F.count("*").alias("n"), F.round(F.sum("statistic"), 2).alias("total"))


@R.query("x16_x17_coordinates", f"WITH {REPORTS}, c AS (SELECT {K}, CAST(q - 25 AS DOUBLE) AS x, CAST(l_suppkey % 60 AS DOUBLE) AS y FROM reports) SELECT {K}, round(x * 1.0101, 1) AS x, round(y * 1.0212, 1) AS y, round(CAST(12 AS DOUBLE) * 1.0760, 1) AS z FROM c")
def _(spark, d):
    c = X.exploded(reports(spark, d), X.coordinates(F.col("text")), "c")
    x, y, z = X.talairach_to_mni(F.col("c.x"), F.col("c.y"), F.col("c.z"))
    return c.select(*KEYS, x.alias("x"), y.alias("y"), z.alias("z"))


@R.query("s24_s25_coordinate_sets", f"WITH {REPORTS} SELECT l_suppkey AS study, count(*) AS foci, max(q + 2) AS n, string_agg(DISTINCT CAST(q - 25 AS VARCHAR), ',' ORDER BY CAST(q - 25 AS VARCHAR)) AS xs FROM reports GROUP BY l_suppkey")
def _(spark, d):
    c = reports(spark, d).select(F.col("l_suppkey").alias("study"), F.array_max(X.sample_sizes(F.col("text"))).alias("n"), F.explode(X.coordinates(F.col("text"))).alias("c"))
    return c.groupBy("study").agg(F.count("*").alias("foci"), F.max("n").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col("c.x").cast("int").cast("string"))), ",").alias("xs"))


@R.query("x15_number_verification", "WITH a AS (SELECT l_suppkey, count(*) AS actual FROM lineitem GROUP BY 1), c AS (SELECT l_suppkey, actual, CASE WHEN l_suppkey % 3 = 0 THEN actual + 1 WHEN l_suppkey % 3 = 1 THEN actual * 2 ELSE actual END AS claim FROM a) SELECT l_suppkey, claim, CASE WHEN l_suppkey % 7 = 0 THEN 'WARN' WHEN abs(claim - actual) <= 2 OR abs(claim - actual) <= 0.02 * actual THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c")
def _(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    i = F.col("l_suppkey")
    claim = F.when(i % 3 == 0, F.col("n") + 1).when(i % 3 == 1, F.col("n") * 2).otherwise(F.col("n"))
    return a.select("l_suppkey", claim.alias("claim"), X.verdict(claim, F.when(i % 7 != 0, F.col("n"))).alias("verdict"))


#: What is said in each report: a number of papers, a share, an agreement, an interval, a p-value, a correlation, a count of conditions.
_SAID = """said AS (SELECT doc_id, n_chars % 97 + 20 AS k, n_chars % 90 AS pct, n_chars % 9 + 1 AS a, regexp_replace(text, '[0-9%=<>]', '', 'g') AS prose FROM documents),
facts AS (SELECT count(*) AS n, 100.0 * count(*) FILTER (n_chars > 1500) / count(*) AS share, 100.0 * count(*) FILTER (lang = 'en') / count(*) AS en, count(DISTINCT lang) AS langs FROM documents)"""


def _report(spark, d):
    docs = table(spark, d, "documents")
    n = F.col("n_chars")
    k, pct, a = n % 97 + 20, n % 90, n % 9 + 1
    c = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    kind = F.when(a <= 3, c(pct, "% support the hypothesis")).when(a <= 6, c(pct, "% name a mechanism")).otherwise(c(pct, "% of something else"))
    prose = F.regexp_replace("text", "[0-9%=<>]", "")
    text = F.concat(c("We read ", k, " studies. Of all "), kind, F.lit(". "), F.substring(prose, 1, 10), c(" Raters: kappa = 0.", a, "; CI [0.", a, ", 9.", a, "], p < 0.0", a, ", r = 0.", a, " over ", a, " conditions. "), prose)
    facts = docs.agg(F.count("*").alias("n"), (100.0 * F.count_if(F.col("n_chars") > 1500) / F.count("*")).alias("share"), (100.0 * F.count_if(F.col("lang") == "en") / F.count("*")).alias("en"), F.countDistinct("lang").alias("langs"))
    return docs.select("doc_id", text.alias("text")).join(facts)


@R.query("x15_number_checks", f"""WITH {_SAID}, t AS (SELECT *, 'We read ' || k || ' studies. Of all ' || pct || CASE WHEN a <= 3 THEN '% support the hypothesis' WHEN a <= 6 THEN '% name a mechanism' ELSE '% of something else' END || '. ' || substr(prose, 1, 10) || ' Raters: kappa = 0.' || a || '; CI [0.' || a || ', 9.' || a || '], p < 0.0' || a || ', r = 0.' || a || ' over ' || a || ' conditions. ' || prose AS text FROM said),
p AS (SELECT doc_id, k, pct, a, lower(substr(text, greatest(0, instr(text, '%') - length(pct::VARCHAR) - 1 - 80) + 1, instr(text, '%') + 40 - greatest(0, instr(text, '%') - length(pct::VARCHAR) - 1 - 80))) AS around FROM t),
m AS (SELECT *, CASE WHEN regexp_matches(around, 'critical|e/i|excitat|inhibit|support') THEN 'criticality support' WHEN regexp_matches(around, 'mechanism|gaba|glutam') THEN 'mechanism' WHEN regexp_matches(around, 'agree|concordan') THEN 'agreement' END AS metric FROM p),
c AS (SELECT doc_id, 'paper_counts' AS kind, k::DOUBLE AS expected, NULL::DOUBLE AS expected_upper, n::DOUBLE AS actual, 'papers' AS metric FROM p, facts
  UNION ALL SELECT doc_id, 'percentages', pct, NULL, CASE metric WHEN 'criticality support' THEN share WHEN 'mechanism' THEN en END, metric FROM m, facts
  UNION ALL SELECT doc_id, 'kappa_values', a / 10.0, NULL, 0.55, 'kappa' FROM p UNION ALL SELECT doc_id, 'ci_values', a / 10.0, 9 + a / 10.0, 0.2, 'interval' FROM p
  UNION ALL SELECT doc_id, 'p_values', a / 100.0, NULL, 0.04, 'p' FROM p UNION ALL SELECT doc_id, 'correlations', a / 10.0, NULL, NULL, 'correlation' FROM p UNION ALL SELECT doc_id, 'generic_counts', a, NULL, langs, 'conditions' FROM p, facts)
SELECT doc_id, kind, metric, round(expected, 6) AS expected, round(expected_upper, 6) AS expected_upper, round(actual, 6) AS actual, CASE WHEN actual IS NULL THEN 'WARN' WHEN kind = 'p_values' THEN CASE WHEN actual <= expected THEN 'PASS' ELSE 'FAIL' END WHEN kind = 'ci_values' THEN CASE WHEN abs(expected_upper - 11.5) <= 2 OR abs(expected_upper - 11.5) <= 0.02 * expected_upper THEN 'PASS' ELSE 'FAIL' END
  WHEN abs(expected - actual) <= 2 OR abs(expected - actual) <= 0.02 * abs(expected) THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def _(spark, d):
    """Reports over whole documents, without their own digits, against what the corpus holds; a correlation is not known."""
    actual = {"papers": F.col("n"), "criticality support": F.col("share"), "mechanism": F.col("en"), "kappa": F.lit(0.55), "ci_lower": F.lit(0.2), "ci_upper": F.lit(11.5), "p": F.lit(0.04), "conditions": F.col("langs")}
    rows = X.number_checks(_report(spark, d), "doc_id", "text", actual)
    return rows.select("doc_id", "kind", "metric", *(F.round(c, 6).alias(c) for c in ("expected", "expected_upper", "actual")), "status")


@R.query("r02_bootstrap_mean")
def _(spark, d):
    return B.interval(B.bootstrap_means(claims(spark, d), "a")).withColumns({c: F.round(c, 6) for c in ("mean", "ci_lower", "ci_upper")})


@R.query("r03_split_half")
def _(spark, d):
    return B.split_half_summary(claims(spark, d), "a", 1000)


@R.query("r04_permutation_test")
def _(spark, d):
    r = claims(spark, d).groupBy("l_returnflag", (F.col("l_suppkey") % 3).alias("g")).agg(F.avg("a").alias("rate"), F.count("*").alias("n"))
    return B.permutation_p(r, "n", "rate", 10_000)


@R.query("r05_seeded_subset", f"WITH {CLAIMS} SELECT l_orderkey, l_linenumber, l_suppkey FROM claims WHERE substr(md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_suppkey), 1, 1) = '0'")
def _(spark, d):
    """A sixteenth of all rows by a seeded hash: a sampling operator."""
    h = F.md5(F.concat(F.lit("42:"), "l_orderkey", F.lit(":"), "l_linenumber", F.lit(":"), "l_suppkey"))
    return claims(spark, d).where(F.substring(h, 1, 1) == "0").select("l_orderkey", "l_linenumber", "l_suppkey")


@R.query("e14_kmeans")
def _(spark, d):
    return P.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


@R.query("c01_c04_topics")
def _(spark, d):
    p = papers(spark, d).select("ord", "citations", F.regexp_extract_all(F.lower("abstract"), F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0)).alias("tokens")).where(F.size("tokens") > 0)
    return P.topics_and_citations(p, "ord", "tokens", "citations")


@R.query("c06_ridge_folds")
def _(spark, d):
    return P.fit_quality(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@R.query("e16_isotonic_calibration")
def _(spark, d):
    r = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", ((F.col("n_chars") % 101) / 100).alias("score"), "quality")
    return P.isotonic(r, "score", "quality")


@R.query("e16_platt_calibration")
def _(spark, d):
    r = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", ((F.col("n_chars") % 101) / 100).alias("score"), "quality")
    return P.platt(r, "score", "quality")


#: Parts in which documents arrive.
ARRIVALS = 4


@R.query("v01_additive_corpus", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def _(spark, d):
    """Documents arrive in order of their ids, in ARRIVALS parts; the table keeps the first of each source. The stream is resumed for each part, which is one batch: its files have no order."""
    base = new_folder(spark, "stream")
    docs = table(spark, d, "documents").select("doc_id", "source")
    rows = in_ranges(docs, [F.col("doc_id").asc_nulls_last()])
    for i in range(ARRIVALS):
        n = partitions(spark, spark.sparkContext.defaultParallelism)
        part = rows.where(F.floor(F.col("_range") * ARRIVALS / n) == i)
        part.select("doc_id", "source").write.mode("append").parquet(f"{base}/in")
        V.additive(V.source(spark, f"{base}/in", docs, files_per_batch=2**31 - 1), "source", "doc_id", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(docs.schema).parquet(f"{base}/out").select("source", "doc_id")


@R.query("v04_latest_event", "SELECT event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM (SELECT event_type, event_id, ts FROM events WHERE (event_type, ts) IN (SELECT event_type, ts FROM events GROUP BY ALL HAVING count(*) = 1)) GROUP BY event_type")
def _(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", "ts")
    single = e.withColumn("c", F.count("*").over(Window.partitionBy("event_type", "ts"))).where("c = 1")
    return V.latest(single, "event_type", "ts", "event_id")


@R.query("v06_hourly_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    """Tumbling hours of the event stream with a watermark, in complete mode over what is there."""
    base = new_folder(spark, "stream")
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.write.parquet(f"{base}/in")
    counts = V.windowed_counts(V.source(spark, f"{base}/in", e), "ts", "event_type")
    V.complete(counts, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
