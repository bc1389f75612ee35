"""Queries that compare runs: three readings of documents, of whole texts and of their halves, as runs of one pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as I
from ..operators import runs as U
from .registry import Registry, papers

R = Registry()
#: What a reading looks for: words that begin with these letters stand for each kind of content.
_LETTERS = {"conditions": "ac", "mechanisms": "mn", "findings": "fh", "regions": "r"}


def readings(spark, d):
    """A record for each document and run whose part of the text has 60 characters or more; texts are read by halves for two of the runs, so papers drop out and contents differ."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    parts = {"first half": F.substring("text", F.lit(1), half), "second half": F.substring("text", half + 1, F.char_length("text")), "whole": F.col("text")}
    docs = papers(spark, d).select("ord", "title", "year", F.col("abstract").alias("text"))
    rows = docs.select("ord", "title", "year", F.explode(F.array(*(F.struct(F.lit(n).alias("run"), p.alias("part")) for n, p in parts.items()))).alias("x")).select("ord", "title", "year", "x.*").where(F.char_length("part") >= 60)
    none = F.lit(None).cast("string")
    critical = F.when(F.contains("part", F.lit(" the ")), True).when(F.contains("part", F.lit(" de ")), False)
    begin = lambda x: F.filter(F.regexp_extract_all(F.lower("part"), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: F.substring(w, 1, 1).isin(list(x)))
    contents = [begin(x).alias(f) for f, x in _LETTERS.items()]
    score = F.least(F.lit(5), F.floor(F.char_length("part") / 500)).cast("string")
    return rows.select("run", I.record_key(none, none, none, F.col("title"), F.col("year")).alias("key"), F.col("ord").alias("place"), score.alias("score"), critical.alias("critical"), *contents)


_READINGS = """parts AS (SELECT doc_id, trim(split_part(text, '.', 1)) AS title, 1990 + doc_id % 30 AS year, unnest([{'run': 'first half', 'part': substr(text, 1, length(text) // 2)}, {'run': 'second half', 'part': substr(text, length(text) // 2 + 1)}, {'run': 'whole', 'part': text}], recursive := true) FROM documents),
records AS (SELECT run, 'title:' || substr(lower(title), 1, 80) || '|' || year AS key, doc_id AS place, least(5, length(part) // 500) AS score, CASE WHEN contains(part, ' the ') THEN true WHEN contains(part, ' de ') THEN false END AS critical, lower(part) AS part FROM parts WHERE length(part) >= 60),
last AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY place DESC) = 1),
words AS (SELECT DISTINCT run, key, field, unnest(list_filter(regexp_extract_all(part, '[a-z]{3,}'), lambda w: contains(letters, w[1]))) AS value FROM last, (VALUES ('conditions', 'ac'), ('mechanisms', 'mn'), ('findings', 'fh'), ('regions', 'r')) v(field, letters)),
counts AS (SELECT run, key, field, count(*) AS n FROM words GROUP BY ALL),
shared AS (SELECT a.run AS run_a, b.run AS run_b, key, a.score AS a, b.score AS b, a.critical AS critical_a, b.critical AS critical_b FROM last a JOIN last b USING (key) WHERE a.run < b.run),
both_ AS (SELECT a.run AS run_a, b.run AS run_b, key, field, count(*) AS n FROM words a JOIN words b USING (key, field, value) WHERE a.run < b.run GROUP BY ALL),
jac AS (SELECT shared.run_a, shared.run_b, v.field, avg(CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 1.0 ELSE coalesce(z.n, 0)::DOUBLE / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(z.n, 0)) END) AS j
  FROM shared CROSS JOIN (VALUES ('conditions'), ('mechanisms'), ('findings'), ('regions')) v(field) LEFT JOIN counts x ON x.run = shared.run_a AND x.key = shared.key AND x.field = v.field LEFT JOIN counts y ON y.run = shared.run_b AND y.key = shared.key AND y.field = v.field
  LEFT JOIN both_ z ON z.run_a = shared.run_a AND z.run_b = shared.run_b AND z.key = shared.key AND z.field = v.field GROUP BY ALL),
jacs AS (SELECT run_a, run_b, max(j) FILTER (field = 'conditions') AS conditions_jaccard, max(j) FILTER (field = 'mechanisms') AS mechanisms_jaccard, max(j) FILTER (field = 'findings') AS findings_jaccard, max(j) FILTER (field = 'regions') AS regions_jaccard, avg(j) AS content_jaccard FROM jac GROUP BY ALL),
wk AS (SELECT run_a, run_b, CASE WHEN e < 1e-12 THEN 1.0 ELSE 1 - o / e END AS score_weighted_kappa FROM (SELECT run_a, run_b, avg(abs(a - b)) / 5 AS o FROM shared GROUP BY ALL) JOIN (SELECT x.run_a, x.run_b, avg(abs(x.a - y.b)) / 5 AS e FROM shared x JOIN shared y USING (run_a, run_b) GROUP BY ALL) USING (run_a, run_b)),
told AS (SELECT * FROM shared WHERE critical_a IS NOT NULL AND critical_b IS NOT NULL),
ck AS (SELECT run_a, run_b, avg((critical_a = critical_b)::INT) AS po, avg(critical_a::INT) AS pa, avg(critical_b::INT) AS pb FROM told GROUP BY ALL),
ckk AS (SELECT run_a, run_b, CASE WHEN abs(1 - (pa * pb + (1 - pa) * (1 - pb))) < 1e-12 THEN 1.0 ELSE (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END AS criticality_kappa FROM ck),
sizes AS (SELECT run, count(*) AS n FROM last GROUP BY run),
compared AS (SELECT x.run AS run_a, y.run AS run_b, x.n AS papers_a, y.n AS papers_b, coalesce(s.n, 0) AS shared, coalesce(s.n, 0)::DOUBLE / (x.n + y.n - coalesce(s.n, 0)) AS paper_jaccard, s.exact_agreement, s.within_1_agreement, score_weighted_kappa, criticality_kappa, conditions_jaccard, mechanisms_jaccard, findings_jaccard, regions_jaccard, content_jaccard
  FROM sizes x JOIN sizes y ON x.run < y.run LEFT JOIN (SELECT run_a, run_b, count(*) AS n, avg((a = b)::INT) AS exact_agreement, avg((abs(a - b) <= 1)::INT) AS within_1_agreement FROM shared GROUP BY ALL) s ON s.run_a = x.run AND s.run_b = y.run
  LEFT JOIN wk ON wk.run_a = x.run AND wk.run_b = y.run LEFT JOIN ckk ON ckk.run_a = x.run AND ckk.run_b = y.run LEFT JOIN jacs ON jacs.run_a = x.run AND jacs.run_b = y.run)"""
_RATES = ["paper_jaccard", "exact_agreement", "within_1_agreement", "score_weighted_kappa", "criticality_kappa", "conditions_jaccard", "mechanisms_jaccard", "findings_jaccard", "regions_jaccard", "content_jaccard"]
_MEANS = [c for c in _RATES if c not in ("conditions_jaccard", "mechanisms_jaccard", "findings_jaccard", "regions_jaccard")]


def _rounded(df, names, places=7):
    return df.withColumns({n: F.round(n, places) for n in names})


@R.query("k10_run_comparison", f"WITH {_READINGS} SELECT run_a, run_b, papers_a, papers_b, shared, {', '.join(f'round({c}, 7) AS {c}' for c in _RATES)} FROM compared")
def _(spark, d):
    return _rounded(U.compare_runs(readings(spark, d)), _RATES)


@R.query("k11_stability_score", f"""WITH {_READINGS}, m AS (SELECT count(*) AS n_pairs, {', '.join(f'avg({c}) AS {c}' for c in _MEANS)} FROM compared), s AS (SELECT *, (paper_jaccard + greatest(0, (score_weighted_kappa + 1) / 2) + exact_agreement + content_jaccard) / 4 AS stability FROM m)
SELECT n_pairs, {', '.join(f'round({c}, 7) AS {c}' for c in _MEANS)}, round(stability, 7) AS stability, CASE WHEN stability >= 0.9 THEN 'excellent stability' WHEN stability >= 0.75 THEN 'good stability' WHEN stability >= 0.5 THEN 'moderate stability' ELSE 'poor stability' END AS interpretation FROM s""")
def _(spark, d):
    return _rounded(U.stability(U.compare_runs(readings(spark, d))), [*_MEANS, "stability"])


@R.query("k06_rater_agreement", f"""WITH {_READINGS}, b AS (SELECT run_a, run_b, CASE WHEN a <= 2 THEN 0 WHEN a <= 4 THEN 1 ELSE 2 END AS x, CASE WHEN b <= 2 THEN 0 WHEN b <= 4 THEN 1 ELSE 2 END AS y FROM shared),
bk AS (SELECT run_a, run_b, po, pe FROM (SELECT run_a, run_b, avg((x = y)::INT) AS po FROM b GROUP BY ALL) JOIN (SELECT p.run_a, p.run_b, avg((p.x = q.y)::INT) AS pe FROM b p JOIN b q USING (run_a, run_b) GROUP BY ALL) USING (run_a, run_b)),
s AS (SELECT run_a, run_b, count(*) AS n_papers, avg(abs(a - b)) AS mean_difference, coalesce(corr(a, b), 0) AS correlation FROM shared GROUP BY ALL),
o AS (SELECT *, 0.5 * score_weighted_kappa + 0.5 * content_jaccard AS overall, CASE WHEN abs(1 - pe) < 1e-12 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM s JOIN bk USING (run_a, run_b) JOIN wk USING (run_a, run_b) JOIN jacs USING (run_a, run_b))
SELECT run_a, run_b, n_papers, round(mean_difference, 7) AS mean_difference, round(conditions_jaccard, 7) AS conditions_jaccard, round(mechanisms_jaccard, 7) AS mechanisms_jaccard, round(findings_jaccard, 7) AS findings_jaccard, round(regions_jaccard, 7) AS regions_jaccard, round(kappa, 7) AS kappa, round(score_weighted_kappa, 7) AS weighted_kappa, round(correlation, 7) AS correlation, round(overall, 7) AS overall,
  CASE WHEN overall < 0.2 THEN 'poor' WHEN overall < 0.4 THEN 'fair' WHEN overall < 0.6 THEN 'moderate' WHEN overall < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS interpretation FROM o""")
def _(spark, d):
    rows = U.rater_agreement(readings(spark, d))
    return _rounded(rows, ["mean_difference", *(c for c in _RATES if c.endswith("s_jaccard")), "kappa", "weighted_kappa", "correlation", "overall"])


@R.query("a12_run_summaries", f"""WITH {_READINGS}, w AS (SELECT run, count(DISTINCT value) FILTER (field = 'conditions') AS n_conditions, count(DISTINCT value) FILTER (field = 'mechanisms') AS n_mechanisms, count(DISTINCT value) FILTER (field = 'findings') AS n_findings, count(DISTINCT value) FILTER (field = 'regions') AS n_regions FROM words GROUP BY run)
SELECT run, count(*) AS papers, round(avg(score), 7) AS mean_score, {', '.join(f'count(*) FILTER (score = {i}) AS score_{i}' for i in range(6))}, count(*) FILTER (critical) AS critical, count(critical) AS critical_told, round(count(*) FILTER (critical) / nullif(count(critical), 0), 7) AS critical_rate, any_value(n_conditions) AS n_conditions, any_value(n_mechanisms) AS n_mechanisms, any_value(n_findings) AS n_findings, any_value(n_regions) AS n_regions FROM last LEFT JOIN w USING (run) GROUP BY run""")
def _(spark, d):
    return _rounded(U.summary(readings(spark, d)), ["mean_score", "critical_rate"])
