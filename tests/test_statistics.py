"""Known answers, re-derived by hand or numpy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evisynth.functions import special
from evisynth.operators import agreement as A
from evisynth.operators import meta as M


def test_distribution_table_values():
    assert special.normal_cdf(1.959963984540054) == pytest.approx(0.975, abs=1e-12)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert special.chi2_cdf(11.0705, 5) == pytest.approx(0.95, abs=1e-5)
    assert special.f_quantile(0.975, 4, 5) == pytest.approx(7.387886, abs=1e-5)


@pytest.mark.parametrize("p,adjusted", [((0.001, 0.01, 0.03, 0.15, 0.6), (0.005, 0.025, 0.05, 0.1875, 0.6)), ((0.5,), (0.5,)), ((0.9, 0.95), (0.95, 0.95))])
def test_benjamini_hochberg(spark, p, adjusted):
    rows = M.benjamini_hochberg(spark.createDataFrame([(chr(65 + i), x) for i, x in enumerate(p)], "name string, p double")).orderBy("name").collect()
    assert [r["adjusted_p"] for r in rows] == pytest.approx(adjusted)
    if len(p) == 5:  # 0.03 * 5 / 3 is just under 0.05 in doubles
        assert [r["significant"] for r in rows] == [True, True, True, False, False]


def pool(y, v):
    y, v = np.array(y), np.array(v)
    w = 1 / v
    fixed = (w * y).sum() / w.sum()
    q = (w * (y - fixed) ** 2).sum()
    c = w.sum() - (w**2).sum() / w.sum()
    tau2 = max(0.0, (q - len(y) + 1) / c) if c > 0 else 0.0
    r = 1 / (v + tau2)
    return (r * y).sum() / r.sum(), math.sqrt(1 / r.sum()), tau2, q


@pytest.mark.parametrize("y,v", [((0.5, 0.3, 0.7, 0.4, 0.6), (0.04, 0.05, 0.03, 0.06, 0.04)), ((0.5,) * 4, (0.04,) * 4), ((0.1, 0.5, 1.2, 0.8, 2.0), (0.04, 0.05, 0.03, 0.06, 0.04)), ((0.5,), (0.04,))])
def test_pooling(spark, y, v):
    r = M.pooled(spark.createDataFrame(list(zip(y, v, strict=True)), "y double, v double"), []).head()
    mu, se, tau2, q = pool(y, v)
    assert (r["mu"], r["se"], r["q"]) == pytest.approx((mu, se, q), abs=1e-9)
    assert r["tau2"] == pytest.approx(tau2 if len(y) > 1 else 0.0, abs=1e-9)
    assert 0 <= r["i2"] <= 100


def test_empty_pool_gives_no_row(spark):
    assert M.pooled(spark.createDataFrame([], "y double, v double"), []).count() == 0


def test_reml_is_a_stationary_point(spark):
    y, v = np.array([0.1, 0.5, 1.2, 0.8, 2.0]), np.array([0.04, 0.05, 0.03, 0.06, 0.04])
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(y, v, strict=True)], "g string, y double, v double")
    tau2 = M.reml(df, ["g"]).head()["tau2"]
    w = 1 / (v + tau2)
    m = (w * y).sum() / w.sum()
    assert 0.5 * ((w**2 * (y - m) ** 2).sum() - w.sum() + (w**2).sum() / w.sum()) == pytest.approx(0, abs=1e-4)


def test_two_groups(spark):
    df = spark.createDataFrame([(g, x) for g, xs in ((1, (1.0, 2, 3)), (2, (4.0, 5, 6))) for x in map(float, xs)], "g int, x double").withColumn("by", F.lit(0))
    r = M.two_groups(df, "g", "x", ["by"], 1, 2).head()
    assert (r["n1"], r["n2"]) == (3, 3) and r["d"] == pytest.approx(-3.0) and abs(r["g"]) < 3


def test_trim_and_fill_leaves_symmetry_alone(spark):
    df = spark.createDataFrame([("a", i, y, 0.04) for i, y in enumerate((0.1, 0.2, 0.3, 0.4, 0.5))], "g string, study int, y double, v double")
    r = M.trim_and_fill(df, ["g"]).head()
    assert r["n_imputed"] == 0 and r["original"] == r["adjusted"] == pytest.approx(0.3)


@pytest.mark.parametrize("x,y,tau", [((1, 2, 3), (1, 2, 3), 1.0), ((1, 2, 3), (3, 2, 1), -1.0), ((1, 3, 2, 5, 4), (2, 4, 1, 5, 3), 0.6)])
def test_kendall(spark, x, y, tau):
    df = spark.createDataFrame([(0, a, b) for a, b in zip(x, y, strict=True)], "g int, x int, y int")
    assert A.kendall(df, "x", "y", ["g"]).head()["tau"] == pytest.approx(tau)


@pytest.mark.parametrize("grid", [2, 7, 512])
def test_kendall_by_brute_force(spark, monkeypatch, grid):
    """Groups, ties, nulls and very many values, with few and with many blocks."""
    monkeypatch.setattr(A, "GRID", grid)
    r = random.Random(grid)
    rows = [(g, r.choice([None, r.randint(0, k)]) if k < 50 else r.randint(0, k), r.randint(0, k)) for g, k in ((None, 3), ("b", 40), ("c", 10_000), ("d", 0)) for _ in range(300)]
    got = {x["g"]: x for x in A.kendall(spark.createDataFrame(rows, "g string, x int, y int"), "x", "y", ["g"]).collect()}
    for g in (None, "b", "c", "d"):
        own = [(x, y) for h, x, y in rows if h == g and x is not None]
        n, sign = len(own), lambda a, b: (a > b) - (a < b)
        s = sum(sign(a, c) * sign(b, e) for i, (a, b) in enumerate(own) for c, e in own[:i])
        tied = lambda values: sum(m * (m - 1) / 2 for m in Counter(values).values())
        scale = ((n * (n - 1) / 2 - tied([x for x, _ in own])) * (n * (n - 1) / 2 - tied([y for _, y in own]))) ** 0.5
        assert got[g]["n"] == n and got[g]["tau"] == pytest.approx(s / scale if scale else 0.0)
        assert got[g]["p_value"] == 1.0 if g == "d" else 0 <= got[g]["p_value"] <= 1


def test_kendall_p_values(spark):
    """Known values: few ranks exactly, and a small table with ties by the normal approximation."""
    assert A.mahonian_p(3, 0) == pytest.approx(1 / 3) and A.mahonian_p(5, 2) == pytest.approx(2 * (1 + 4 + 9) / 120) and A.mahonian_p(5, 5) == 1.0
    df = spark.createDataFrame([(0, a, b) for a, b in zip((12, 2, 1, 12, 2), (1, 4, 7, 1, 0), strict=True)], "g int, x int, y int")
    row = A.kendall(df, "x", "y", ["g"]).head()
    assert row["tau"] == pytest.approx(-0.47140452079103173) and row["p_value"] == pytest.approx(0.2827454599327748)


def test_icc_interval(spark):
    """Six subjects by four judges, a textbook table: ICC(1,1) 0.17 with bounds -0.13 and 0.72."""
    m = [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]]
    df = spark.createDataFrame([(0, s, float(x)) for s, xs in enumerate(m) for x in xs], "g int, s int, r double")
    row = A.icc1(df, ["s"], "r", ["g"]).head()
    assert (round(row["icc"], 2), round(row["ci_lower"], 2), round(row["ci_upper"], 2)) == (0.17, -0.13, 0.72)


def test_kappas(spark):
    same = spark.createDataFrame([(0, i % 3, i % 3) for i in range(30)], "g int, a int, b int")
    assert A.cohen_kappa(same, "a", "b", ["g"]).head()["kappa"] == pytest.approx(1.0)
    assert A.weighted_kappa(same, "a", "b", ["g"]).head()["weighted_kappa"] == pytest.approx(1.0)
    one = spark.createDataFrame([(0, 1, 1)] * 5, "g int, a int, b int")
    assert A.cohen_kappa(one, "a", "b", ["g"]).head()["kappa"] == 1.0
    perfect = spark.createDataFrame([(s, s % 2) for s in range(6) for _ in range(4)], "s int, c int")
    assert A.fleiss_kappa(perfect, "s", "c").head()["kappa"] == pytest.approx(1.0)
    spread = spark.createDataFrame([(s, c) for s in range(4) for c in (0, 0, 1, 1, 2, 2)], "s int, c int")
    assert A.fleiss_kappa(spread, "s", "c").head()["kappa"] <= 0


def test_icc(spark):
    rows = lambda m: spark.createDataFrame([(0, s, float(x)) for s, xs in enumerate(m) for x in xs], "g int, s int, r double")
    assert A.icc1(rows([[1, 1], [3, 3], [5, 5]]), ["s"], "r", ["g"]).head()["icc"] > 0.99
    assert A.icc1(rows([[1, 2], [3, 4]]), ["s"], "r", ["g"]).head()["icc"] == 0


def test_split_halves_of_scores(spark):
    from evisynth.operators import resample as B

    scores = [0] * 40 + [1] * 30 + [5] * 31
    df = spark.createDataFrame([(x,) for x in scores] + [(None,)], "a int")
    rows = B.split_half(df, "a", 400).collect()
    mean = sum(scores) / len(scores)
    assert len(rows) == 400 and abs(sum(r["mean_1"] for r in rows) / 400 - mean) < 0.1
    # two halves leave out one of 101 rows: their sums and one score are all there is
    assert all(min(abs(50 * (r["mean_1"] + r["mean_2"]) - (sum(scores) - x)) for x in (0, 1, 5)) < 1e-6 for r in rows)
    assert all(-1 <= r["r"] <= 1 for r in rows) and abs(sum(r["r"] for r in rows) / 400) < 0.03
    assert rows == B.split_half(df, "a", 400).collect()
    s = B.split_half_summary(df, "a", 200).head()
    assert s["n_splits"] == 200 and s["means_correlation"] < -0.9 and s["kendall_tau"] < -0.8 and s["icc"] < 0 and s["interpretation"] == "poor"
    assert tuple(B.split_half_summary(df.limit(2), "a", 20).head())[:3] == (0, 0.0, 0.0)


def test_bootstrap_and_permutation(spark):
    from evisynth.operators import resample as B

    df = spark.createDataFrame([(i % 6,) for i in range(600)], "a int")
    r = B.interval(B.bootstrap_means(df, "a", 2000)).head()
    error = (35 / 12) ** 0.5 / 600**0.5
    assert r["replicates"] == 2000 and abs(r["mean"] - 2.5) < 0.01 and r["ci_lower"] == pytest.approx(2.5 - 1.96 * error, abs=0.02) and r["ci_upper"] == pytest.approx(2.5 + 1.96 * error, abs=0.02)
    points = spark.createDataFrame([(i, float(i)) for i in range(6)] + [(None, 1.0), (9, None)], "x long, y double")
    p = B.permutation_p(points, "x", "y", 4000).head()
    assert p["rho"] == 1.0 and p["p"] == pytest.approx(2 / 720, abs=0.003)


def test_isotonic_and_kmeans(spark):
    from evisynth.operators import topics as P

    rows = [(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1), (0.5, 1)]
    got = P.isotonic(spark.createDataFrame(rows, "score double, label int"), "score", "label").collect()
    assert [r["calibrated"] for r in sorted(got, key=lambda r: r["score"])] == pytest.approx([0, 0.5, 0.5, 1, 1])
    curve = [r["calibrated"] for r in sorted(P.platt(spark.createDataFrame(rows, "score double, label int"), "score", "label").collect(), key=lambda r: r["score"])]
    assert curve == sorted(curve) and 0 < curve[0] < curve[-1] < 1 and sum(curve) == pytest.approx(3, abs=1e-3)
    vectors = [(i, [float(i % 2) * 10 + i / 100, 0.0]) for i in range(20)]
    k = {r["id"]: r[1] for r in P.kmeans(spark.createDataFrame(vectors, "id long, v array<float>"), "id", "v", 2).collect()}
    assert len({k[i] for i in range(0, 20, 2)}) == 1 and len({k[i] for i in range(1, 20, 2)}) == 1 and k[0] != k[1]


def test_benjamini_hochberg_in_ranges(spark):
    import random

    from evisynth.operators import meta as M

    r = random.Random(1)
    tests = [(f"t{i}", r.random() ** 3) for i in range(200)]
    got = {x["name"]: x["adjusted_p"] for x in M.benjamini_hochberg(spark.createDataFrame(tests, "name string, p double")).collect()}
    ordered = sorted(tests, key=lambda x: (x[1], x[0]))
    least, want = 1.0, {}
    for i in range(len(ordered) - 1, -1, -1):
        least = min(least, ordered[i][1] * len(ordered) / (i + 1))
        want[ordered[i][0]] = least
    assert got == pytest.approx(want, abs=1e-9)


def test_bias_domain(spark):
    from pyspark.sql import functions as F

    from evisynth.functions import grading as G

    rows = [(20, 0.01, 0, 0.0, 500), (20, 0.07, 0, 0.0, 500), (20, 0.5, 0, 0.0, 500), (20, 0.5, 2, 0.3, 500), (20, 0.5, 0, 0.0, 50), (20, 0.5, 0, 0.0, 0), (20, None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, p double, i int, s double, f long")
    assert [r["d"] for r in df.select(G.publication_bias(*(F.col(c) for c in "kpisf")).alias("d")).collect()] == [2, 1, 0, 1, 1, 0, 1]
    claims = spark.createDataFrame([("a", ["Alpha waves"], ["x"]), ("b", ["none"], ["BETA"]), ("", ["alpha"], None), ("c", None, None)], "article_id string, findings array<string>, conditions array<string>")
    assert {tuple(r) for r in G.studies_of_components(claims, [("1", "alpha", []), ("2", "zz", ["beta"])]).collect()} == {("1", "a"), ("2", "b")}
