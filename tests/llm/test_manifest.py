"""The Merkle manifest against a tree built in plain Python, in rounds of one level and more."""

import hashlib
import zlib

import pytest

from evisynth.llm import manifest

from .test_operators import EDGE, SCHEMA


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        run = nodes[i // 8 * 8 :][:8]
        out.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        i //= 8
    return out


def built(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    for n in names:
        groups[n].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {n: levels([leaf(r, r["text"]) for r in groups[n]]) for n in names}
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for i, r in enumerate(groups[n]):
            way = path(trees[n], i) + path(top, k)
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for left, right in way:
                node = h(left + node + right)
            out.append((r["doc_id"], trees[n][0][i], trees[n][-1][0], top[-1][0], h("".join(a + b for a, b in way)), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["edge", "documents", "deep", "many groups"])
def test_against_a_plain_tree(spark, sf, kind):
    if kind == "edge":
        rows = [(i if i != 3 else None, t, None if i % 4 == 0 else f"s{i % 3}", None if i % 2 else "é", None, 1, 2, 3, "k") for i, t in enumerate(EDGE)]
        df = spark.createDataFrame([*rows, rows[5], rows[5], rows[3]], SCHEMA)
    elif kind == "documents":
        df = spark.read.parquet(f"{sf}/documents.parquet")
    else:
        n, lang = (4200, "'l'") if kind == "deep" else (700, "CASE WHEN id % 3 = 0 THEN 'big' ELSE concat('l', id) END")  # more than two rounds, and more groups than one run
        df = spark.range(n).selectExpr("id * 7 - 50 AS doc_id", "'s' AS source", f"{lang} AS lang", "id AS n_chars", "concat('T', id) AS text", "1 AS `place`", "2 AS `group`", "3 AS `node0`", "4 AS `path`", "5 AS `n`")
    assert sorted(map(tuple, manifest.manifest(df).collect()), key=str) == built([r.asDict() for r in df.collect()])


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "s", "l", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest.manifest(df).head()
    assert got["leaf"] == got["subroot"] == got["root"] == got["folded_root"] and got["proof_sha256"] == h("") and got["verified"]
    assert manifest.manifest(df.limit(0)).count() == 0
