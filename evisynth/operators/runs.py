"""Comparison of whole runs: which papers they share, how far scores and contents agree, and how stable that makes them.

Records are rows of (run, key, place, score, critical, and an array a content field). Of rows with one key in a run the
last place counts. Shared papers are found by one join on the key, and everything else is sums by pair of runs, so no
paper and no run meets another one it does not share a key with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written
from . import agreement as A

CONTENTS = ("conditions", "mechanisms", "findings", "regions")
#: From which stability on a run is called what.
STABILITY = [(0.9, "excellent stability"), (0.75, "good stability"), (0.5, "moderate stability")]


def normal_set(values: Column) -> Column:
    """Different values, trimmed and in lower case, without empty ones; null as none."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull() & (v != "")))


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared values over all values of two sets; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def last_records(records: DataFrame, fields: tuple[str, ...] = CONTENTS) -> DataFrame:
    """A row a run and key: score (0 if null or no number), critical (null if not told) and the sets of its contents."""
    row = F.struct(F.coalesce(F.col("score").try_cast("double").cast("int"), F.lit(0)).alias("score"), "critical", *(normal_set(F.col(f)).alias(f) for f in fields))
    return records.groupBy("run", "key").agg(F.max_by(row, "place").alias("r")).select("run", "key", "r.*")


def _pairs(last: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """A row for each paper that two runs share: run_a before run_b, scores a and b, critical_a and critical_b, Jaccard of each field."""
    a, b = (last.select("key", *(F.col(c).alias(f"{c}_{s}") for c in last.columns if c != "key")) for s in ("a", "b"))
    both = a.join(b, "key").where("run_a < run_b")
    return both.select("run_a", "run_b", "key", F.col("score_a").alias("a"), F.col("score_b").alias("b"), "critical_a", "critical_b", *(set_jaccard(F.col(f"{f}_a"), F.col(f"{f}_b")).alias(f"{f}_jaccard") for f in fields))


def _mean_of(columns: list[Column]) -> Column:
    """The mean of those that are not null; null if all are."""
    n = reduce(lambda x, y: x + y, (c.isNotNull().cast("int") for c in columns))
    return reduce(lambda x, y: x + y, (F.coalesce(c, F.lit(0.0)) for c in columns)) / F.nullif(n, F.lit(0))


def compare_runs(records: DataFrame, fields: tuple[str, ...] = CONTENTS) -> DataFrame:
    """A row for each two runs: papers of each and shared, paper Jaccard, and over shared papers exact and within-1 agreement of scores,
    their weighted kappa, kappa of critical where both tell it, mean Jaccard of each field and of all; null where runs share nothing."""
    last = written(last_records(records, fields), "last")
    pairs = written(_pairs(last, fields), "pairs")
    runs = last.groupBy("run").agg(F.count("*").alias("papers"))
    every = runs.select(F.col("run").alias("run_a"), F.col("papers").alias("papers_a")).join(runs.select(F.col("run").alias("run_b"), F.col("papers").alias("papers_b")), F.col("run_a") < F.col("run_b"))
    gap = F.abs(F.col("a") - F.col("b"))
    share = lambda x: F.avg(x.cast("double"))
    by = ["run_a", "run_b"]
    sums = pairs.groupBy(*by).agg(F.count("*").alias("shared"), share(gap == 0).alias("exact_agreement"), share(gap <= 1).alias("within_1_agreement"), *(F.avg(f"{f}_jaccard").alias(f"{f}_jaccard") for f in fields))
    scored = A.weighted_kappa(pairs, "a", "b", by).select(*by, F.col("weighted_kappa").alias("score_weighted_kappa"))
    told = pairs.where("critical_a IS NOT NULL AND critical_b IS NOT NULL")
    critical = A.cohen_kappa(told, "critical_a", "critical_b", by).select(*by, F.col("kappa").alias("criticality_kappa"))
    rows = every.join(sums, by, "left").join(scored, by, "left").join(critical, by, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    rows = rows.withColumn("paper_jaccard", F.col("shared") / (F.col("papers_a") + F.col("papers_b") - F.col("shared")))
    return rows.withColumn("content_jaccard", _mean_of([F.col(f"{f}_jaccard") for f in fields]))


def stability(pairs: DataFrame) -> DataFrame:
    """One row: means over all pairs of runs, the stability score (the mean of paper Jaccard, weighted kappa moved to 0..1, exact agreement and content Jaccard, as far as there are any) and what it is called."""
    names = ("paper_jaccard", "score_weighted_kappa", "exact_agreement", "within_1_agreement", "criticality_kappa", "content_jaccard")
    row = pairs.agg(F.count("*").alias("n_pairs"), *(F.avg(n).alias(n) for n in names))
    kappa = F.greatest(F.lit(0.0), (F.col("score_weighted_kappa") + 1) / 2)
    kappa = F.when(F.col("score_weighted_kappa").isNotNull(), kappa)  # greatest() passes over nulls
    row = row.withColumn("stability", _mean_of([F.col("paper_jaccard"), kappa, F.col("exact_agreement"), F.col("content_jaccard")]))
    name = F.when(F.col("stability").isNull(), "insufficient data")
    for least, label in STABILITY:
        name = name.when(F.col("stability") >= least, label)
    return row.withColumn("interpretation", name.otherwise("poor stability"))


def rater_agreement(records: DataFrame, fields: tuple[str, ...] = CONTENTS, score_only: bool = False) -> DataFrame:
    """A row for each two raters (runs) that share papers: kappa of scores in bins 0-2, 3-4 and 5, weighted kappa, mean difference, correlation, mean Jaccard of each field, overall and its name.

    overall is half weighted kappa and half the mean of the Jaccards; with score_only, for raters without contents, weighted kappa alone, and the Jaccards are null."""
    pairs = written(_pairs(last_records(records, fields), fields), "pairs")
    by = ["run_a", "run_b"]
    bin_ = lambda c: F.when(F.col(c) <= 2, "low").when(F.col(c) <= 4, "mid").otherwise("high")
    jaccard = lambda f: F.lit(None).cast("double") if score_only else F.avg(f"{f}_jaccard")
    sums = pairs.groupBy(*by).agg(F.count("*").alias("n_papers"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_difference"), *(jaccard(f).alias(f"{f}_jaccard") for f in fields))
    binned = A.cohen_kappa(pairs.select(*by, bin_("a").alias("x"), bin_("b").alias("y")), "x", "y", by).select(*by, "kappa")
    rows = sums.join(binned, by).join(A.weighted_kappa(pairs, "a", "b", by).drop("n"), by).join(A.correlation(pairs, "a", "b", by).select(*by, F.col("r").alias("correlation")), by)
    overall = F.col("weighted_kappa") if score_only else 0.5 * F.col("weighted_kappa") + 0.5 * _mean_of([F.col(f"{f}_jaccard") for f in fields])
    return rows.withColumn("overall", overall).withColumn("interpretation", A.label_of(F.col("overall")))


def summary(records: DataFrame, fields: tuple[str, ...] = CONTENTS) -> DataFrame:
    """A row a run over its last records: papers, mean score, the papers of each score from 0 to 5, how many different values each content field has, and how many papers tell criticality and affirm it."""
    last = written(last_records(records, fields), "last")
    told = F.count("critical")
    sums = last.groupBy("run").agg(
        F.count("*").alias("papers"),
        F.avg("score").alias("mean_score"),
        *(F.count_if(F.col("score") == s).alias(f"score_{s}") for s in range(6)),
        F.count_if(F.col("critical")).alias("critical"),
        told.alias("critical_told"),
        (F.count_if(F.col("critical")) / F.nullif(told, F.lit(0))).alias("critical_rate"),
    )
    named = lambda f: F.transform(f, lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))
    values = F.explode(F.flatten(F.array(*map(named, fields))))
    seen = last.select("run", values.alias("v")).select("run", F.col("v.field").alias("field"), F.col("v.value").alias("value")).distinct().groupBy("run").pivot("field", list(fields)).count()
    seen = seen.select("run", *(F.col(f).alias(f"n_{f}") for f in fields))
    return sums.join(seen, "run", "left").na.fill(0, [f"n_{f}" for f in fields])
