"""The induced order of suffixes against sorting, and substring dedup against a table of all strings."""

import random

import numpy as np
import pytest

from evisynth.llm import copied, suffixes

from .test_operators import EDGE, SCHEMA


def sorted_suffixes(text, most):
    """(position, prefix shared with the next greater suffix), from the greatest down, without the last symbol."""
    order = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)[:-1]
    shared = lambda i, j: next(n for n in range(most + 1) if n == most or max(i, j) + n >= len(text) or text[i + n] != text[j + n])
    return [(i, shared(i, order[k - 1]) if k else 0) for k, i in enumerate(order)]


@pytest.mark.parametrize("base", [0, 25, 1 << 21])
@pytest.mark.parametrize("rows", [5, 64, 1 << 20])
def test_suffix_order(tmp_path, base, rows):
    """All depths of recursion, queues in memory and in files, mapped arrays."""
    r = random.Random(base + rows)
    for _ in range(60):
        k = r.choice([1, 2, 5, 30, 255])
        words = [[r.randint(1, k) for _ in range(r.randint(1, 6))] for _ in range(r.choice([3, 40]))]
        text = [x for _ in range(r.choice([0, 1, 10, 80])) for x in r.choice(words)] + [1] * r.choice([0, 0, 40])
        text = text + text[: r.randint(0, len(text))] + [0]
        most = r.choice([1, 7, 50])
        with suffixes.Scratch(str(tmp_path), rows, 64 if rows == 5 else 1 << 28, base) as scratch:
            got = [(int(i), int(n)) for places, shared in suffixes.suffix_order(scratch, np.array(text), max(text), most) for i, n in zip(places, shared, strict=True)]
        assert got == sorted_suffixes(text, most)
    assert not list(tmp_path.iterdir())


def expected(rows, least=50):
    first, texts = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - least + 1 if i is not None else 0):
            s = t[k : k + least]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in texts:
        gone, kept, at = [], b"", 0
        for k in range(len(t) - least + 1 if i is not None else 0):
            if first[t[k : k + least]] < i:
                if gone and k <= gone[-1][1]:
                    gone[-1][1] = k + least
                else:
                    gone.append([k, k + least])
        for a, b in gone:
            kept, at = kept + t[at:a], b
        out.append((i, len(t), tuple((a, b - a) for a, b in gone), kept + t[at:]))
    return sorted(out, key=str)


def got(df):
    return sorted([(r["doc_id"], r["n_bytes"], tuple((x["start"], x["length"]) for x in r["removed"]), bytes(r["kept"])) for r in copied.without_copied(df).collect()], key=str)


def test_against_all_strings(spark, sf):
    """Documents over several packs, with copies, shared passages at any place, periodic texts and strings that are just too short."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh é") for _ in range(r.randint(2, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (7, 9, 12, 40, 400)]
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()]
    rows += [(10_000 - i, word() + r.choice(passages)[r.randint(0, 9) :] + word() + r.choice(passages)) for i in range(150)]
    rows += [(20_000, "ab" * 400), (20_001, "ba" * 300), (20_002, "x" * 49), (20_003, "x" * 49), (20_004, "x" * 50), (20_005, "y" + "x" * 50), (20_006, "x" * 5000), (19_000, "é" * 60)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(df) == expected(rows)


def test_edges(spark):
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else f"s{i % 3}", None, None, 1, 2, 3, "k") for i, t in enumerate(EDGE)]
    long = next(t for t in EDGE if t and len(t) > 10_000)
    more = [rows[5], rows[7], (None, long, *rows[1][2:]), (40, long, *rows[1][2:])]
    df = spark.createDataFrame([*rows, *more], SCHEMA)
    plain = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert got(df.repartition(3)) == expected(plain)
    assert copied.without_copied(df.limit(0)).count() == 0
    assert copied.without_copied(df.where("doc_id = 3 OR text IS NULL")).count() == 1


def test_segments_alone_with_their_hash_are_not_sorted(spark, tmp_path, monkeypatch):
    """Copies of whole texts are one segment each and settle without an order; edges of passages in different texts need it."""
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    whole, passages = [text(600) for _ in range(20)], [text(200) for _ in range(10)]
    rows = [(i + 100 * k, t) for i, t in enumerate(whole) for k in (0, 1)]
    rows += [(1000 + i + 100 * k, text(150) + p + text(150)) for i, p in enumerate(passages) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == expected(rows)
    packed = copied.packs(df.coalesce(1)).cache()
    cut = copied.cut_segments(packed, copied.shared_hashes(packed, 50, 1), 50, 1, 1).where("shard = 0").toArrow()
    sizes = [copied._opened(p, np.int32, np.int32, np.int64, np.int64)[1].sum() for p in cut["payload"].to_pylist()]
    found = []
    monkeypatch.setattr(copied, "suffix_order", lambda scratch, text, *more: found.append(len(text)) or suffixes.suffix_order(scratch, text, *more))

    class Cut:
        def groupBy(self, *_):
            return self

        def applyInArrow(self, sort, _):
            return sort

    assert list(copied.first_documents(Cut(), 50, str(tmp_path))(iter(cut.to_batches())))
    assert 0 < sum(found) < sum(sizes) / 4
