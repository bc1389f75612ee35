"""Known answers of extraction from text: statistics, report numbers, claims, answers of models."""

import pytest
from pyspark.sql import functions as F

from evisynth.operators import claims as C
from evisynth.operators import extract as X


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "text string").select(*columns).head()


@pytest.fixture(autouse=True)
def _text(spark):
    global T
    T = F.col("text")


def test_statistics_with_nearest_p_values(spark):
    text = "Group A differed, t(38) = 2. 41, p = .02, Cohen's d = 0.52. Much later F(2, 60) = 4.10, p < 0. 001; OR = 1.8, 95% CI [1.1, 2.9] in 120 patients versus healthy people, 80 controls."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    rows = {r["test"]: r for r in X.results(df, "id", "text").collect()}
    assert {k: r["statistic"] for k, r in rows.items()} == {"t_test": 2.41, "effect_size": 0.52, "f_test": 4.1, "odds_or_risk_ratio": 1.8}
    assert [(p["operator"], p["value"]) for p in rows["t_test"]["p_values"]] == [("=", 0.02), ("<", 0.001)]
    assert [(p["operator"], p["value"]) for p in rows["f_test"]["p_values"]] == [("<", 0.001), ("=", 0.02)]
    assert (rows["f_test"]["df1"], rows["f_test"]["df2"]) == (2, 60) and text[rows["f_test"]["start"] : rows["f_test"]["end"]] == rows["f_test"]["raw"] == "F(2, 60) = 4.10"
    assert [tuple(e) for e in rows["t_test"]["effect_sizes"]] == [("d", 0.52), ("or", 1.8)]
    assert [tuple(c) for c in rows["t_test"]["confidence_intervals"]] == [(95, 1.1, 2.9)]
    assert [tuple(s) for s in rows["t_test"]["sample_sizes"]] == [(120, "patients"), (80, "controls")]
    assert rows["t_test"]["missing_fields"] == [] and not rows["t_test"]["needs_review"]


def test_cut_decimals_are_no_numbers(spark):
    r = one(spark, "t(12) = 0. then p = 0. and p = 1. 5 and p < .05.", X.p_values(T).alias("p"), F.size(X.test_spans(T)).alias("n"))
    assert [tuple(x) for x in r["p"]] == [("<", 0.05)] and r["n"] == 0
    assert one(spark, "p = 0.", X.p_values(T).alias("p"))["p"] == []
    assert [tuple(x) for x in one(spark, "p = 1", X.p_values(T).alias("p"))["p"]] == [("=", 1.0)]


def test_effects_subjects_age_and_comparisons(spark):
    r = one(spark, "r = −.30, rho = 0.4, HR = 2, d = 9.5, d = 9.5; N = 45, 2001 patients, 1 mouse, 30 Mice, n = 45; age mean 8.5 years, SD = 1.2. Treated children versus untreated children. X vs Y", X.effect_sizes(T).alias("e"), X.subjects(T).alias("s"), X.age(T).alias("a"), X.comparisons(T).alias("c"), X.effects(T).alias("d"))
    assert [tuple(x) for x in r["e"]] == [("d", 9.5), ("hr", 2.0), ("r", -0.3), ("rho", 0.4)] and r["d"] == []
    assert [tuple(x) for x in r["s"]] == [(30, "mice"), (45, "sample")] and tuple(r["a"]) == (8.5, 1.2)
    assert r["c"] == ["Treated children vs untreated children"]


def test_repair_of_cut_rows(spark):
    kind = "test string, statistic double, p_values array<struct<operator:string,value:double>>, context string"
    rows = [("t_test", 2.0, [("=", 0.0)], "so t(30) = 2. 75, p = 0. 001 here"), ("t_test", 0.0, [("=", 0.0)], "t(30) = 0. , at 1. 5"), ("z_test", 1.0, [("<", 0.05)], "z = 1, p < 0.05"), ("z_test", 3.0, [], None)]
    got = [(r["statistic"], [tuple(p) for p in r["p_values"]]) for r in X.repaired(spark.createDataFrame(rows, kind)).collect()]
    assert got == [(2.75, [("=", 0.001)]), (None, []), (1.0, [("<", 0.05)]), (3.0, [])]


def test_review_flags(spark):
    df = spark.createDataFrame([(1, "We saw t(4) = 2.5."), (2, "A significant main effect."), (3, "Nothing here.")], "id long, text string")
    got = {(r["id"], r["reason"], tuple(r["missing_fields"])) for r in X.review_flags(df, "id", "text").collect()}
    assert got == {(1, "partial_statistical_result", ("p_value_or_ci", "effect_size", "subjects", "comparison")), (2, "result_context_without_parseable_statistic", ("statistical_test", "effect_size", "p_value_or_ci"))}


def test_full_text_metrics(spark):
    r = one(spark, "Hedges' g = 0.32; d = 7.00; eta squared = 0.12, OR = 2.30. Participants (N = 150), n = 5, N = 1999, a total of 1,234 participants. 95% CI [0.21, 0.68]; 90% CI 0.1 to 0.5. p<.05, P = .001, p = 0, p < 0.01", *X.metrics(T))
    assert [tuple(x) for x in r["effect_sizes"]] == [("g", 0.32), ("d", 0.12), ("eta_squared", 0.12), ("or", 2.3)] and r["sample_sizes"] == [150, 1234]
    assert [tuple(x) for x in r["confidence_intervals"]] == [(95, 0.21, 0.68), (90, 0.1, 0.5)]
    assert [(p["operator"], p["value"]) for p in r["p_values"]] == [("=", 1.0), ("<", 0.01)]  # a bare point is passed over


def test_abstract_numbers(spark):
    r = one(spark, "We read 1,245 papers; 78.5% agreed (κ = 0.72, CI [0.55, 0.89], p < 0.001, r = -0.83) across 12 brain regions.", *X.abstract_numbers(T))
    assert r["paper_counts"] == [1245] and r["percentages"] == [78.5] and r["kappa_values"] == [0.72] and r["correlations"] == [-0.83] and r["generic_counts"] == [12]
    assert [tuple(x) for x in r["ci_values"]] == [(0.55, 0.89)] and [tuple(x) for x in r["p_values"]] == [("<", 0.001)]


def test_heuristic_claims(spark):
    df = spark.createDataFrame([("We found altered GABA in ASD. No more! Seizures increased? fMRI of the hippocampus.", "Network of epilepsy"), (None, None)], "a string, t string")
    r, empty = df.select(*C.heuristic_claims(F.col("a"), F.col("t"))).collect()
    assert r["findings"] == ["We found altered GABA in ASD", "Seizures increased"] and r["key_quote"] == r["findings"][0]
    assert r["mechanisms"] == ["GABA"] and r["conditions"] == ["autism spectrum disorder", "epilepsy"] and r["brain_regions"] == ["hippocampus"]
    assert r["methodology"] == "fmri" and r["supports_criticality"] and r["network_effects_described"] and r["supports_primary_question"]
    assert empty["findings"] == [] and empty["methodology"] == "" and not empty["supports_primary_question"]


def test_entities_and_regions(spark):
    df = spark.createDataFrame([(1, "MDD and the dlPFC; default mode"), (2, "idle")], "id long, text string")
    assert {tuple(r) for r in C.entities(df, "id", "text").collect()} == {(1, "conditions", "Depression"), (1, "structural_regions", "Prefrontal Cortex"), (1, "functional_networks", "Default Mode")}
    r = one(spark, " DLPFC ", C.region(T).alias("a"), C.regions_match(T, F.lit("prefrontal  Cortex")).alias("m"), C.regions_match(T, F.lit("insula")).alias("n"), C.names_balance(F.lit("GABAergic tone")).alias("b"))
    assert r["a"] == "dorsolateral prefrontal cortex" and r["m"] and not r["n"] and r["b"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('Sure: {"score": 4, "quoted_span": " a b "}', (4, "a b")),
        ('{"score": 4, "quote": "q"}', (4, "q")),
        ('{"score": "4"} so I give this a 3', (3, "")),
        ('{"score": 9} quote: "z" rating: 2', (2, "z")),
        ("Relevance 7, well 4/5 then", (4, "")),
        ("5 out of 5", (5, "")),
        ("between 1 and 3 I think", (3, "")),
        ("no number", (None, "")),
        ("", (None, "")),
    ],
)
def test_relevance_answers(spark, text, want):
    assert tuple(one(spark, text, C.relevance_answer(T).alias("r"))["r"]) == want


def test_batched_and_extraction_answers(spark):
    got = one(spark, 'ok {"results": [{"id": " a ", "score": 3, "quote": "x"}, {"id": "b", "score": 7}, {"score": 1}, {"id": 9, "score": 0}]}', C.batched_answers(T).alias("r"))["r"]
    assert [tuple(x) for x in got] == [("a", 3, "x"), ("9", 0, "")]
    listed = one(spark, 'x [{"id": "c", "score": 5}, {"id": "d", "score": "4"}, {"id": "e", "score": 2}, {"id": "c", "score": 1}]', C.batched_answers(T).alias("r"))["r"]
    assert [tuple(x) for x in listed] == [("e", 2, ""), ("c", 1, "")]  # a score given as text goes, and the last of repeated ids stays
    assert one(spark, 'x [{"id": "c", "score": 5}]', C.batched_answers(T).alias("r"))["r"] == []  # its object can be read and has no results
    assert one(spark, "none", C.batched_answers(T).alias("r"))["r"] == []
    fenced = one(spark, '```json\n{"findings": ["f", ""], "methodology": "m", "supports_criticality": true}\n```', C.extraction_answer(T).alias("r"))["r"]
    assert fenced["findings"] == ["f"] and fenced["mechanisms"] == [] and fenced["methodology"] == "m" and fenced["supports_criticality"] and fenced["error"] is None
    inner = one(spark, 'Here: {"findings": ["g"], "x": {"y": 1}} done', C.extraction_answer(T).alias("r"))["r"]
    assert inner["findings"] == ["g"] and inner["error"] is None
    broken = one(spark, '{"findings": ["h", "i"], "key_quote": "k", "supports_criticality": TRUE, ', C.extraction_answer(T).alias("r"))["r"]
    assert broken["findings"] == ["h", "i"] and broken["key_quote"] == "k" and broken["supports_criticality"] and broken["error"] == "parse_failed"
