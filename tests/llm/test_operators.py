"""The operators against brute force, exact round trips and the edge cases that their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evisynth.llm import fingerprints, mixing, near_dups, packing, quality, repeats, secrets, token_counts, token_files, tokens, warc
from evisynth.llm.common import bucket_of, id_bounds, new_folder

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, n long, size long, bucket long, key string"
rnd = random.Random(7)
LONG = " ".join(rnd.choice(["alpha", "beta,", "gamma.", "delta\n", "été", "日本語"]) for _ in range(20_000))
EDGE = [None, "", " \n\t ", "one", "a b c d", "same text here. And more of it!", "same text here. And more of it!", LONG, "🙂 " * 30, "x" * 5000, "tail\x1c\x85 end"]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns whose names the operators use inside."""
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else f"s{i % 3}", None, None, 1, 2, 3, "k") for i, t in enumerate(EDGE)]
    return spark.createDataFrame([*rows, rows[5], rows[-1]], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "x<|endoftext|>y  <|endoftext|> z", "don't I'll\n\n\nwe've 123", "ΑΣ ΣΑΣ. é é", "a\x1cb\x85d", "\ttab \n y\r\nz", "日本語 テキスト", "a" * 3000, "İstanbul ǅ", "　x 　 y", "a  b   c"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_encode_like_whole_texts(path, texts):
    alphabet = "ab '\n\t é1.<|\x1c　"
    every = ODD + list(texts.values()) + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))) for _ in range(500)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(every, add_special_tokens=False)]
    got = tokens.ChunkEncoder(path, False, kept=200).encode([t.encode() for t in every])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert tokens.ChunkEncoder(path, True).encode([t.encode() for t in every]) == [len(w) for w in want]


def test_token_counts(edge, spark):
    got = token_counts.token_counts(edge, WORD).collect()
    tok = Tokenizer.from_file(WORD)
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    want = sorted((len((r["text"] or "").encode()), count(r["text"]), count(r["text"]) > 2048) for r in edge.collect())
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert token_counts.token_counts(edge.limit(0), WORD).count() == 0


def test_ranked_codes_round_trip():
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = np.array([rnd.choice([0, 255, 256, 65_535, 65_536, 1 << 24, (1 << 32) - 1]) for _ in range(n)], np.uint32)
        control, data = token_files.encode_ranks(ranks)
        assert token_files.decode_ranks(control, data, n).tolist() == ranks.tolist()


def test_token_files(edge, spark):
    folder = new_folder(spark, "t")
    got = token_files.read_token_files(token_files.write_token_files(edge, BYTE, folder)).collect()
    tok = Tokenizer.from_file(BYTE)
    rows = sorted(edge.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    ids = [[*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in rows]
    starts = np.cumsum([0] + [len(x) for x in ids])[:-1].tolist()
    want = [(r["doc_id"], s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, s, x in zip(rows, starts, ids, strict=True)]
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.read_token_files(token_files.write_token_files(edge.limit(0), BYTE, new_folder(spark, "t"))).count() == 0


def test_patterns_place_most_of_a_small_table(docs):
    lengths = [min(r["length"], 2047) for r in packing.pieces(docs, WORD).select("length").collect()]
    h = np.bincount(lengths, minlength=2049)
    found = packing.patterns(np.flatnonzero(h).tolist(), 2048)
    x = packing.fit(found, h)
    assert x.min() >= 0 and (x > 0).sum() <= 1.2 * (h > 0).sum()  # few more patterns than lengths
    left = h.astype(float)
    for n, p in zip(x, found, strict=True):
        np.subtract.at(left, list(p), n)
    assert np.linalg.norm(left) < 0.5 * np.linalg.norm(h)
    planned = packing.plan(h.tolist(), 2048)
    assert sum(n for _, n in planned) <= -(-int((h * np.arange(2049)).sum()) // 2048) + 1


def test_plan_covers_the_histogram():
    for seed in range(5):
        r = np.random.default_rng(seed)
        h = np.bincount(np.clip(r.lognormal(4, 1.2, 5000).astype(int), 1, 256), minlength=257).tolist()
        back = [0] * 257
        planned = packing.plan(h, 256)
        for pattern, n in planned:
            assert sum(pattern) <= 256 and n > 0
            for k in pattern:
                back[k] += n
        assert back == h
        total = sum(i * n for i, n in enumerate(h))
        assert sum(n for _, n in planned) <= total / 256 * 1.01 + 1


def test_packing(edge, docs, spark):
    tok = Tokenizer.from_file(WORD)
    for df in (edge, docs):
        got = packing.pack_documents(df, WORD).collect()
        want = []
        for r in df.collect():
            x = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            want += [(r["doc_id"], i, a, len(x[a : a + 2048]), zlib.crc32(x[a : a + 2048].tobytes())) for i, a in enumerate(range(0, len(x), 2048))]
        order = lambda r: tuple((x is not None, x or 0) for x in r)
        assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(want, key=order)
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
    assert packing.pack_documents(edge.limit(0), WORD).count() == 0
    whole = packing.sequences(edge, WORD).collect()
    assert all(len(b"".join(bytes(p["ids"]) for p in s["parts"])) == 4 * s["n_tokens"] for s in whole)


def shingles(t):
    w = (t or "").encode().translate(near_dups._LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(sets, percent):
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = root(a), root(b)
                    low[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_duplicates_against_all_pairs(spark, texts):
    rows = dict(texts)
    base = [f"w{i}" for i in range(120)]
    for i in range(60):  # a family in which many links miss the threshold
        w = list(base)
        for j in rnd.sample(range(120), rnd.randint(0, 4)):
            w[j] = f"x{rnd.random()}"
        rows[20_000 + i] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = components({i: shingles(t) for i, t in rows.items()}, 85)
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(df).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) and r["n_shingles"] == len(shingles(rows[i])) for i, r in got.items())


def test_near_duplicates_edges(edge):
    got = near_dups.near_duplicates(edge).collect()
    assert len(got) == len(EDGE) + 2
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[0][0]["n_shingles"] == 0 and by[0][0]["component_id"] == 0 and by[0][0]["kept"]
    assert by[6][0]["component_id"] == 5 and not by[6][0]["kept"] and all(r["kept"] for r in by[5])
    assert by[None][0]["component_id"] is None and not by[None][0]["kept"]
    assert near_dups.near_duplicates(edge.limit(0)).count() == 0
    one = near_dups.one_of_each(edge)
    assert one.columns == edge.columns and one.where("text LIKE 'same text%'").count() == 1


def test_one_of_each_keeps_the_right_rows(spark, edge):
    a, b, c = "a b c d e f", "quite another text of some words", "and a third one that is unlike them all"
    long_a = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, 0), (1, None, 0), (1, a, 0), (2, a.upper(), 0), (3, b, 0), (3, c, 0), (None, c, 0), (None, "no id " * 9, 1), (None, "no id " * 9, 1), (4, "", 0), (-5, long_a, 0), (7, long_a + " x", 0), (None, long_a, 0), (9, long_a, 2), (9, long_a, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    want = [(1, None, 0), (1, None, 0), (1, a, 0), (3, b, 0), (3, c, 0), (None, "no id " * 9, 1), (4, "", 0), (-5, long_a, 0)]
    for parts in (1, 7):
        got = near_dups.one_of_each(df.repartition(parts)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(df).collect()}
    assert {(3, 2, 3, True), (3, 5, 3, True), (None, 5, 3, False), (2, 2, 1, False), (1, 0, 1, True), (None, 56, -5, False)} <= found
    kept = near_dups.one_of_each(edge).collect()
    every = {tuple(r) for r in edge.collect()}
    assert {tuple(r) for r in kept} == every - {r for r in every if r[0] == 6} and len(kept) == len(every) - 1


def test_super_minhash_estimates_and_slots():
    a = near_dups._mix(np.arange(2000, dtype=np.uint64))
    b = near_dups._mix(np.arange(500, 2500, dtype=np.uint64))
    same = np.mean([near_dups.super_minhash(a + np.uint64(k)) == near_dups.super_minhash(b + np.uint64(k)) for k in range(4)])
    assert abs(same - 0.6) < 0.08
    assert (near_dups.super_minhash(a[:1]) >> np.uint64(32)).tolist() != [0] * near_dups.SLOTS  # one element fills each slot in its own step
    assert sorted((near_dups.super_minhash(a[:1]) >> np.uint64(32)).tolist()) == list(range(near_dups.SLOTS))
    x, y = [a[:300], a[100:400]], [b[:50], a[:300]]
    x, y = [np.sort(v) for v in x], [np.sort(v) for v in y]
    assert near_dups.joint_sizes(x, y).tolist() == [[len(np.intersect1d(p, q)) for q in y] for p in x]


def test_winnowing(spark, docs, edge):
    rows = fingerprints.fingerprints(edge).collect()
    assert len(rows) == len(EDGE) + 2
    by = dict(zip([r["text"] for r in edge.collect()], [r["grams"] for r in rows], strict=True))
    assert by[None] == [] == by[""] and len(by["one"]) == 1 == len(by["a b c d"])
    # every window of W grams has its rightmost least gram, and nothing else is kept
    t = " ".join(rnd.choice("abcdef") for _ in range(300))
    full = spark.createDataFrame([(1, t)], "doc_id long, text string")
    every = full.select(F.transform(fingerprints.gram_hashes(F.col("text")), lambda h: F.xxhash64(h).bitwiseAND(F.lit(0x7FFFFFFF))).alias("h")).head()["h"]
    want = sorted({max(i for i in range(s, s + 8) if every[i] == min(every[s : s + 8])) for s in range(len(every) - 7)})
    got = fingerprints.fingerprints(full).head()["grams"]
    assert [g["position"] for g in got] == want and [g["hash"] for g in got] == [every[i] for i in want]
    # 12 words in common are found in both
    shared = " ".join(f"q{i}" for i in range(12))
    two = fingerprints.fingerprints(spark.createDataFrame([(1, f"a b {shared} c d e"), (2, f"z {shared} y x w v")], "doc_id long, text string")).collect()
    assert {g["hash"] for g in two[0]["grams"]} & {g["hash"] for g in two[1]["grams"]}


def test_edited_texts(spark, sf, texts):
    rows = fingerprints.op1_winnowing(spark, sf).collect()
    order = [texts[i] for i in sorted(texts)]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(order, order[1:] + order[:1], strict=True)]
    want = {i: (len(texts[i]), hashlib.sha256(e.encode()).hexdigest()) for i, e in zip(sorted(texts), edited, strict=True)}
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == want
    prints = defaultdict(set)
    for r in rows:
        prints[texts[r["doc_id"]]].add(r["fingerprint"])
    every = {r["doc_id"]: r for r in rows}
    hashes = lambda x: {p.split(":")[0] for p in x.split()}
    alike = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for a, b in zip(sorted(texts), sorted(texts)[1:] + sorted(texts)[:1], strict=True):
        own = hashes(every[a]["fingerprint"])
        assert every[a]["near_edited"] == pytest.approx(alike(own, hashes(every[a]["edited_fingerprint"])))
        assert every[a]["near_next"] == pytest.approx(alike(own, hashes(every[b]["fingerprint"])))
    assert all(len(x) == 1 for x in prints.values())


def water(sizes):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {x: (1, 2, 3)[i % 3] for i, x in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        over = [x for x in free if left * w[x] / sum(w[y] for y in free) > 3 * sizes[x]]
        if not over:
            break
        for x in over:
            target[x] = 3 * sizes[x]
            free.remove(x)
            left -= target[x]
    return target | {x: left * w[x] / sum(w[y] for y in free) for x in free}


def test_mixing(edge, docs):
    for df in (edge, docs):
        rows = mixing.mixed(df).collect()
        assert len(rows) == df.count()
        size, taken, target = defaultdict(int), defaultdict(int), {}
        for r in rows:
            size[r["mixed_source"]] += r["size"]
            taken[r["mixed_source"]] += r["taken"]
            target[r["mixed_source"]] = r["target"]
            assert 0 <= r["taken"] <= 3 * r["size"] and 0 <= r["part_words"] <= r["size"]
            assert all(0 <= p["start"] and p["words"] > 0 and p["start"] + p["words"] <= r["size"] for p in r["parts"])
        want = water(size)
        assert target == pytest.approx(want)
        block = max(1, min(1024, int(min((t for t in want.values() if t > 0), default=1) / 256)))
        assert all(abs(taken[s] - t) <= 1.5 * block + 1 for s, t in want.items())
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mixed(df).collect()), key=str)
    assert mixing.mixed(edge.limit(0)).count() == 0
    out = mixing.mix_documents(docs)
    words = out.select(F.sum(mixing.word_count(F.col("text")))).head()[0]
    assert words == mixing.mixed(docs).select(F.sum("taken")).head()[0] and out.columns == docs.columns


@pytest.mark.parametrize("small", [300, 5000])
def test_mixing_capped_source(spark, small):
    """A source whose target is three times its size, beside large ones: all words of all targets are taken."""
    sizes = [("a", 400)] * 4000 + [("b", 400)] * 4000 + [("c", 1 + k * 7 % 900) for k in range(small)]
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, n int").selectExpr("doc_id", "source", "repeat('w ', n) AS text")
    rows = mixing.mixed(df, cycle=(1, 1, 30)).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r["mixed_source"]] += r["taken"]
        target[r["mixed_source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert small == 5000 or target["c"] == 3 * sum(n for s, n in sizes if s == "c")
    assert all(abs(taken[s] - t) <= 1.5 * 1024 for s, t in target.items())


def test_mixing_many_sources(spark):
    """200,000 sources of one document each: no task sees them all, and no source is lost."""
    df = spark.range(200_000).selectExpr("id AS doc_id", "concat('s', id) AS source", "'one two three' AS text")
    got = mixing.mixed(df).selectExpr("count(*) AS n", "sum(taken) AS t", "sum(target) AS a", "max(abs(taken - target)) AS off", "count(DISTINCT target) AS k").head()
    assert got["n"] == 200_000 and got["t"] == 600_000 and got["a"] == pytest.approx(600_000) and got["off"] <= 1 and got["k"] == 3


@pytest.mark.parametrize("seed", range(6))
def test_sainte_lague_with_caps(spark, seed):
    r = random.Random(seed)
    votes = {f"i{k}": r.choice([1, 2, 3, 10, 50, 400]) for k in range(r.randint(2, 40))}
    total = r.randint(1, sum(votes.values()))
    df = spark.createDataFrame([(i, float(v), total, v) for i, v in votes.items()], "item string, votes double, seats long, most long")
    want = dict.fromkeys(votes, 0)
    for _ in range(total):
        want[min((i for i in votes if want[i] < votes[i]), key=lambda i: (-votes[i] / (2 * want[i] + 1), i))] += 1
    for group in ([], ["g"]):
        got = mixing.apportioned(df.withColumn("g", F.lit(None).cast("string")), group, "item", "votes", "seats", "quota", "most")
        assert {x["item"]: x["quota"] for x in got.collect()} == want


@pytest.mark.parametrize("seats", [1, 7, 50, 333])
def test_sainte_lague(spark, seats):
    votes = {f"i{k}": v for k, v in enumerate([1, 5, 5, 17, 100, 0, 3, 333])}
    df = spark.createDataFrame([(0, i, float(v), seats) for i, v in votes.items()], "g int, item string, votes double, seats long")
    got = {r["item"]: r["quota"] for r in mixing.apportioned(df, ["g"], "item", "votes", "seats", "quota").collect()}
    want = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min(votes, key=lambda i: (-votes[i] / (2 * want[i] + 1), i))
        want[best] += 1
    assert sum(got.values()) == seats and got == want


PATTERNS = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def test_secrets(spark, edge):
    bits = ["password", "PASSWD", "Secret", "toKen", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "=token=", "AKIA", "AKIA" + "A1" * 9, "deadbeef" * 4, "é", "🙂", "1f" * 11, "1f" * 13, "ghp_" + "a" * 36, "\n"]
    made = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(800)]
    df = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate([*made, None, "", "token=abcdefg " * 300])], "doc_id long, text string")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    for r in secrets.found_secrets(df).select("text", base.alias("b"), "secrets", secrets.masked(F.coalesce("text", F.lit("")), F.col("secrets")).alias("m")).collect():
        t = r["text"] or ""
        want = sorted((m.start(), i, m.end()) for i, (p, ok) in enumerate(PATTERNS) for m in p.finditer(t) if ok(m))
        assert [tuple(s) for s in r["b"]] == want
        left, at = "", 0
        for a, _, b in sorted(map(tuple, r["secrets"])):
            if a >= at:
                left += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert r["m"] == (left + t[at:])
    assert secrets.found_secrets(edge).count() == len(EDGE) + 2 and secrets.found_secrets(edge.limit(0)).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("abc(?:def|ghi)?x") == [frozenset({"abc"})]
    assert secrets.trigram_query("[0-9a-f]{24,}") == secrets.ALL
    assert secrets.trigram_query("(token|Secret)=") == sorted([frozenset({"tok", "oke", "ken"}), frozenset({"sec", "ecr", "cre", "ret"})], key=sorted)


def test_quality(edge, docs):
    rows = quality.judged(edge).collect()
    assert len(rows) == len(EDGE) + 2
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_words"] == by[1]["n_words"] == by[2]["n_words"] == 0 and by[0]["base_failed"] and not by[0]["kept"]
    assert quality.judged(edge.limit(0)).count() == 0
    order = quality.cascade_order(docs)
    assert sorted(order) == sorted(quality.RULES)
    kept = {r["doc_id"] for r in quality.judged(docs, order=order).where("kept").collect()}
    assert kept == {r["doc_id"] for r in quality.judged(docs, order=order[::-1]).where("kept").collect()}
    assert kept == {r["doc_id"] for r in quality.keep_good(docs).collect()}


def test_repeat_words_by_hand():
    p = quality.Profile(b"a b c d a b c e e e e e")
    w = p.words
    grams = defaultdict(list)
    for i in range(len(w) - 2):
        grams[tuple(w[i : i + 3])].append(i)
    assert p.n_repeat_words == len({j for v in grams.values() if len(v) > 1 for i in v for j in range(i, i + 3)})


def test_warc(spark):
    rows = [(i, None if i % 5 == 0 else f"http://x/{i}\n", h, 1, "clash") for i, h in enumerate([None, "", "short", "short", "L" * 200, "L" * 200, "é" * 60, "é" * 60, "M" * 300_000, "L" * 200])]
    pages = spark.createDataFrame([*rows, rows[4], (None, None, "L" * 200, 1, "x")], "page_id long, url string, html string, n long, digest string")
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived(pages, new_folder(spark, "w")).collect()), key=str)
    first = {}
    for r in sorted((x for x in pages.collect() if x["page_id"] is not None), key=lambda r: r["page_id"]):
        first.setdefault(r["html"] or "", r["page_id"])
    want = []
    for r in pages.collect():
        h = (r["html"] or "").encode()
        again = len(h) >= 100 and r["page_id"] != first[r["html"] or ""]
        want.append((r["page_id"] if r["page_id"] is not None else -1, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[r["html"] or ""] if again else None))
    assert got == sorted(want, key=str)
    assert warc.archived(pages.limit(0), new_folder(spark, "w")).count() == 0


def test_normalising_again_after_the_stream_is_gone(tmp_path):
    one = [warc.record(b"x" * n, n, None, "d", None) for n in range(5)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "raw.gz").write_bytes(z.compress(b"".join(one)) + z.flush())
    paths = [f"file://{tmp_path}/{n}" for n in ("raw.gz", "new.gz", "new.cdxj")]
    assert warc.normalise(*paths, keep=False) == 5 and not (tmp_path / "raw.gz").exists()
    assert warc.normalise(*paths, keep=False) == 5


def test_monolith_of_several_members_and_damage():
    one = warc.record(b"x" * 50, 1, "u", "d", None)
    packed = b"".join((lambda z: z.compress(one) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31)) for _ in range(3))
    cut = [packed[i : i + 7] for i in range(0, len(packed), 7)]
    assert list(warc.records(warc.inflated(iter(cut)))) == [one] * 3
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(iter(cut[:-2]))))


def test_repeats_against_brute_force(spark, texts, edge):
    passage = "First sentence of a passage that repeats over and over again here. Second one follows it with some more words in it. And the third ends it all at last, as every passage must."
    rows = {**{i: t for i, t in texts.items() if len(t) < 20_000}, 29_998: "It was cold. We went home. A was here.", 29_999: "B was here. It was cold.\nWe went home.", 30_000: f"Intro words. {passage} Outro is new.", 30_001: f"Quite other words\n{passage}\nand an end", 30_002: passage}
    got = {r["doc_id"]: r for r in repeats.without_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    where = defaultdict(list)  # every run of two sentences or more, of any length in words
    for i, t in rows.items():
        said = [" ".join(x.split()) for x in re.split(r"(?<=[.!?])[ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]*\n[ \t\n\r\x0b\x0c]*", t.strip(" \t\n\r\x0b\x0c"))]
        said = [x for x in said if x]
        for k in range(len(said)):
            for j in range(k + 1, min(len(said), k + 40)):
                where[tuple(said[k : j + 1])].append((i, k, j))
    gone = defaultdict(set)
    for found in where.values():
        for i, k, j in sorted(found)[1:]:
            gone[i].update(range(k, j + 1))
    assert {i: r["n_removed"] for i, r in got.items()} == {i: len(gone[i]) for i in rows}
    assert got[29_998]["n_removed"] == 0 and got[29_999]["text"] == "B was here. "
    assert passage in got[30_000]["text"] and "passage" not in got[30_001]["text"] and got[30_002]["text"] == ""
    assert got[30_001]["text"].split() == "Quite other words and an end".split()
    out = repeats.without_repeats(edge)
    assert out.count() == len(EDGE) + 2 and repeats.without_repeats(edge.limit(0)).count() == 0


def test_buckets(spark):
    df = spark.createDataFrame([(None,), (5,), (5,), (9,), (100,)] + [(i,) for i in range(200)], "k long")
    bounds = id_bounds(df, "k", 8)
    got = df.select("k", bucket_of(F.col("k"), bounds).alias("b")).collect()
    assert all(r["b"] == (0 if r["k"] is None else max(i for i, x in enumerate(bounds) if x <= r["k"])) for r in got)
    assert id_bounds(df.limit(0), "k", 8) == []
