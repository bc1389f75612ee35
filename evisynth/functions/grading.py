"""Certainty rules over aggregated evidence: domains as column expressions, studies of components, the table of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ["High", "Moderate", "Low", "Very Low"]


def risk_of_bias(low: Column, moderate: Column, flagged: Column, control: Column) -> Column:
    """Downgrades 0 to 2 from shares of low (or unknown) and moderate designs, of flagged rows, and of controlled ones."""
    base = F.when((low > 0.5) | (flagged > 0.4), 2).when((moderate > 0.5) | (low > 0.3), 1).otherwise(0)
    return F.least(F.lit(2), base + F.when((control < 0.3) & (base < 2), 1).otherwise(0))


def inconsistency(agreement: Column, spread: Column, stability: Column) -> Column:
    base = F.when(agreement.isNull(), 1).when(agreement < 0.4, 2).when(agreement < 0.7, 1).otherwise(0)
    base = F.when((spread > 0.3) & (base < 1), 1).otherwise(base)
    return F.least(F.lit(2), base + F.when(stability < 0.5, 1).otherwise(0))


def indirectness(match_rate: Column, n_claims: Column) -> Column:
    return F.when(n_claims == 0, 2).when(match_rate < 0.2, 2).when(match_rate < 0.5, 1).otherwise(0)


def imprecision(ci_width: Column, n_studies: Column) -> Column:
    base = F.when(ci_width > 0.5, 2).when(ci_width > 0.3, 1).otherwise(0)
    return F.when(n_studies < 3, 2).when(n_studies < 5, F.greatest(base, F.lit(1))).otherwise(base)


def publication_bias(n_studies: Column, egger_p: Column, n_imputed: Column, shift: Column, failsafe: Column) -> Column:
    """By Egger's p (below 0.05: 2, below 0.10: 1); else 1 if imputed studies move the effect by more than 0.2, or a fail-safe N above 0 is below 5 n + 10. Without a test, 1."""
    signal = ((n_imputed > 0) & (shift > 0.2)) | ((failsafe > 0) & (failsafe < 5 * n_studies + 10))
    tested = F.when(egger_p < 0.05, 2).when((egger_p < 0.10) | F.coalesce(signal, F.lit(False)), 1).otherwise(0)
    return F.when(egger_p.isNull(), 1).otherwise(tested)


#: The domains of a grade, and what their downgrades are called.
DOMAINS, CONCERNS = ["risk_of_bias", "inconsistency", "indirectness", "imprecision", "publication_bias"], ["No concern", "Serious", "Very serious"]


def findings_table(grades: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, domain, downgrade) as one row for each of `by`, a column a domain: what its downgrade is called."""
    names = F.array(*(F.lit(x) for x in CONCERNS))
    named = grades.withColumn("label", F.element_at(names, (F.least(F.lit(2), "downgrade") + 1).cast("int")))
    return named.groupBy(*by).pivot("domain", DOMAINS).agg(F.first("label"))


def studies_of_components(claims: DataFrame, components: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(component_id, article_id), each once: articles one of whose claims (article_id, findings, conditions) names the component's label or, failing that, one of its keywords, whatever the case."""
    text = F.lower(F.concat_ws(" ", "findings", "conditions"))
    names = lambda label, keywords: [x.lower() for x in (label, *keywords) if x]
    hits = F.array(*(F.when(F.exists(F.array(*(F.lit(w) for w in names(label, keywords))), lambda w: F.contains(F.col("_text"), w)), cid) for cid, label, keywords in components))
    rows = claims.where("article_id IS NOT NULL AND CAST(article_id AS STRING) <> ''").withColumn("_text", text)
    return rows.select(F.explode(F.array_compact(hits)).alias("component_id"), "article_id").distinct()


def certainty(starts_high: Column, downgrades: Column) -> Column:
    names = F.array(*(F.lit(x) for x in LEVELS))
    return F.element_at(names, (F.least(F.lit(3), F.when(starts_high, 0).otherwise(2) + downgrades) + 1).cast("int"))
