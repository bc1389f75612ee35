"""Importance resampling against a plain reading of its rule, and the quickselect alone."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evisynth.llm import resampling

from .test_operators import EDGE, SCHEMA


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def drawn(rows, target, percent=10, least=20):
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    s, t = (Counter(bucket(w) for x in texts for w in words(x)) for texts in ([x for _, x in rows], target))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000))))
    out = []
    for i, x in rows:
        w = words(x)
        weight = sum(gain(bucket(v)) for v in w) // len(w) if w else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, able[: percent * len(able) // 100]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else f"s{i % 3}", None, None, 1, 2, 3, "k") for i, t in enumerate(EDGE)]
    return spark.createDataFrame([*rows, rows[5], rows[7]], SCHEMA)


def test_against_the_rule(spark, sf, edge):
    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    target = [r["text"] for r in bench.collect()]
    for df, percent, least in ((docs, 10, 20), (edge, 60, 1), (edge, 100, 0)):
        got = resampling.resampled(df, bench, percent, least).collect()
        every, won = drawn([(r["doc_id"], r["text"]) for r in df.collect()], target, percent, least)
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted([(r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got], key=key) == sorted(every, key=key)
        ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(won) + 1))
        assert [(r["score"], r["doc_id"]) for r in ranked] == [(w[3], w[0]) for w in won]
    assert resampling.resampled(edge.limit(0), bench).count() == 0
    assert resampling.resampled(edge, bench.limit(0)).count() == len(EDGE) + 2
    assert resampling.resampled(edge, bench, 10, 10**6).where("rank IS NOT NULL").count() == 0


def test_runs_of_words():
    assert resampling._features(b"A b\xc3\xa9,c", 2) == (3, [b"a", b"b\xc3\xa9", b"c", b"a b\xc3\xa9", b"b\xc3\xa9 c"])


@pytest.mark.parametrize("alike", [1, 3, 10_000])
def test_kth_key(spark, alike):
    """Any rank, with few or no different scores."""
    r = random.Random(alike)
    rows = [(r.randrange(alike), r.choice([None, 1, 5, i]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "score long, doc_id long, place long").withColumn("content", F.lit(None).cast("long"))
    keys = df.select("place", *resampling.key_columns(df)[:4]).select("k0", "k1", "k2", "k3", F.col("place").alias("k4")).cache()
    order = sorted(tuple(x) for x in keys.collect())
    for k in (1, 2, 777, 2000):
        assert resampling.kth_key(keys, k, seed=k) == order[k - 1]
    assert resampling.kth_key(keys, 0) is None and resampling.kth_key(keys, 2001) is None
