import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from evisynth.functions import text as T
from evisynth.operators import corpus as C
from evisynth.operators import extract as X
from evisynth.operators import graph as N
from evisynth.operators import scoring as S
from evisynth.plans.corpus import cut
from evisynth.sources import bibliography as B


def test_doi_and_year(spark):
    df = spark.createDataFrame([(" https://doi.org/10.1/A ", "2015-03"), ("DOI:10.2/b", "x"), ("", None), (None, "199")], "d string, y string")
    got = df.select(T.doi(F.col("d")).alias("d"), T.year(F.col("y")).alias("y")).collect()
    assert [tuple(r) for r in got] == [("10.1/a", 2015), ("10.2/b", None), (None, None), (None, None)]


def words(a):
    return set(a.lower().split())


def test_similar_titles_against_all_pairs(spark, sf):
    rows = [(r["ord"], r["title"]) for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS ord", "trim(split_part(text, '.', 1)) AS title").collect()]
    rows += [(10_000, "one two three four five six seven eight nine ten"), (10_001, "one two three four five six seven eight nine eleven"), (10_002, "")]
    got = {(r["a"], r["b"]) for r in C.similar_titles(spark.createDataFrame(rows, "ord long, title string"), 80).collect()}
    first = {}
    for o, t in sorted(rows):
        if t.strip():
            first.setdefault(t.strip().lower(), o)
    want = {(o, p) for t, o in first.items() for u, p in first.items() if o < p and 100 * len(words(t) & words(u)) >= 80 * len(words(t) | words(u))}
    assert got == want and (10_000, 10_001) in got


def test_keep_first_is_greedy(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    got = {r["id"]: (r["kept"], r["match"]) for r in C.keep_first(nodes, pairs, cut).collect()}
    assert got == {0: (True, None), 1: (False, 0), 2: (True, None), 3: (False, 2), 4: (True, None), 5: (False, 4)}
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 5), (4, 5)], "a long, b long")
    got = {r["id"]: (r["kept"], r["match"]) for r in C.keep_first(nodes, pairs, cut).collect()}
    assert got[5] == (False, 3) and got[3] == (True, None)


@pytest.mark.parametrize("a,b", [("kitten", "sitting"), ("", ""), ("abc", ""), ("aaa", "aa"), ("neural network", "network neural")])
def test_lcs_against_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert C.lcs(a, b) == t[-1][-1]


def test_merge_keeps_first_non_empty(spark):
    df = spark.createDataFrame([(1, "d", "", "x"), (2, "d", "t", "y"), (3, "d", "u", "x"), (4, None, "v", "z"), (5, None, "w", "z")], "ord long, doi string, title string, source string")
    got = sorted((r["ord"], r["title"], r["source"], r["n_merged"]) for r in C.merge_by_key(df, "doi", fields=("title",)).collect())
    assert got == [(1, "t", "x+y", 3), (4, "v", "z", 1), (5, "w", "z", 1)]


def test_statistics_in_text(spark):
    t = "The trial included 84 adults, t(82) = 2.41, p = .018, Cohen's d = 0.52, 95% CI 0.10 to 0.94. r = 0. 48, p < 0. 001, b = −0. 02"
    r = spark.createDataFrame([(t,)], "t string").select(X.p_values(F.col("t")).alias("p"), X.intervals(F.col("t")).alias("c"), X.sample_sizes(F.col("t")).alias("n"), X.effects(F.col("t")).alias("d")).head()
    assert [(p["operator"], p["value"]) for p in r["p"]] == [("=", 0.018), ("<", 0.001)]
    assert [tuple(c) for c in r["c"]] == [(95, 0.10, 0.94)] and r["n"] == [84] and r["d"] == [0.52]
    rows = X.test_statistics(spark.createDataFrame([(1, t)], "id long, t string"), "id", "t").orderBy("start").collect()
    assert [(r["test"], r["statistic"]) for r in rows] == [("t_test", 2.41), ("effect_size", 0.52), ("correlation", 0.48), ("regression_coefficient", -0.02)]


def test_communities_of_two_triangles(spark):
    e = spark.createDataFrame([("a0", "a1", 10), ("a1", "a2", 10), ("a0", "a2", 10), ("b0", "b1", 10), ("b1", "b2", 10), ("b0", "b2", 10), ("a2", "b0", 1)], "source string, target string, weight long")
    labels = N.label_communities(e, cut)
    by = {r["node"]: r["community"] for r in labels.collect()}
    assert by["a0"] == by["a1"] and by["b0"] == by["b1"] and by["a0"] != by["b0"]
    assert N.modularity(e, labels).head()["modularity"] > 0


def test_evidence_links_by_hand(spark):
    p = spark.createDataFrame([(1, "We confirm and support alpha. Alpha beta", 2000, 5), (2, "", 2001, 1)], "ord long, abstract string, year int, citations long")
    rows = {(r["ord"], r["component_id"]): r for r in S.evidence_links(p, [S.Component("x", ("alpha", "gamma")), S.Component("y", ("beta",))]).collect()}
    r = rows[1, "x"]
    kw = 0.6 * 0.5 + 0.4 * min(2 / 7 * 50, 1)
    assert r["kw_score"] == pytest.approx(kw) and r["cooc"] == pytest.approx(0.5) and r["direction"] == "supports"
    assert r["relevance"] == pytest.approx(0.5 * kw + 0.3 * 0.5 + 0.2)
    assert rows[2, "x"]["relevance"] == 0 and rows[2, "x"]["direction"] == "neutral"


ARTICLE = "<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>A</AbstractText><AbstractText>B</AbstractText></Abstract><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>1999 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"


def test_pubmed_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f"<S>{ARTICLE}</S>")
    assert tuple(B.pubmed_xml(spark, str(tmp_path / "a.xml")).head()) == ("7", "T", "A B", "J", 1999)
    df = spark.createDataFrame([(1, f"<S>{ARTICLE}{ARTICLE.replace('7', '8')}</S>"), (2, "no XML"), (3, None)], "id long, x string")
    got = sorted(tuple(r) for r in B.pubmed_strings(df, "id", "x").collect())
    assert got == [(1, "7", "T", "A B", "J", 1999, "10.1/x"), (1, "8", "T", "A B", "J", 1999, "10.1/x")]


def test_pubmed_bulk(spark, tmp_path):
    """Compressed and plain files, labels, groups, fallbacks of dates, records without abstracts."""
    import gzip

    from evisynth.sources import pubmed

    full = "<PubmedArticle><MedlineCitation><PMID>1</PMID><DateRevised><Year>2005</Year></DateRevised><Article><ArticleTitle>On <i>x</i></ArticleTitle><Abstract><AbstractText Label='AIM'>a</AbstractText><AbstractText NlmCategory='RESULTS'> b </AbstractText><AbstractText>c</AbstractText><AbstractText Label='NONE'/></Abstract><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName><Initials>I</Initials></Author><Author><CollectiveName>Group</CollectiveName></Author><Author><LastName>M</LastName><Initials>N</Initials></Author><Author/></AuthorList><Journal><Title>J</Title><ISOAbbreviation>Jj</ISOAbbreviation></Journal><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article><MeshHeadingList><MeshHeading><DescriptorName>D</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='pmc'>PMC1</ArticleId><ArticleId IdType='DOI'>10.1/y</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"
    bare = "<PubmedArticle><MedlineCitation><PMID>2</PMID><Article><ArticleTitle>T</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml.gz").write_bytes(gzip.compress(f"<S>{full}{bare}</S>".encode()))
    (tmp_path / "b.xml").write_text(f"<S>{ARTICLE}</S>")
    (tmp_path / "c.txt").write_text("no records")
    pubmed.register(spark)
    read = lambda **o: {r["pmid"]: r for r in spark.read.format("pubmed_bulk").options(path=str(tmp_path), **o).load().collect()}
    got = read()
    assert set(got) == {"1", "7"} and set(read(includeNoAbstract="true")) == {"1", "2", "7"}
    assert tuple(got["1"]) == ("1", "PMC1", "10.1/y", "On x", "AIM: a RESULTS: b c", ["L, F", "Group", "M, N"], 2005, "J", "Jj", ["Review"], ["D"], "PubMed", "a.xml.gz")
    assert (got["7"]["year"], got["7"]["abstract"], got["7"]["doi"]) == (1999, "A B", "10.1/x")


def test_bibtex_escapes(spark):
    r = spark.range(1).select(B.bibtex(F.lit("k1"), F.lit("a & b_c"), F.lit(2001), F.lit("J")).alias("x")).head()["x"]
    assert r.startswith("@article{k1,\n") and "a \\& b\\_c" in r and re.search(r"year = \{2001\}", r)


def test_indel_pairs(spark, monkeypatch):
    """Against all pairs: other years, early differences, equal titles, ratios between 85 and 90 with and without author and year."""
    monkeypatch.setattr(C, "BLOCK_TITLES", 20)
    made = random.Random(5)
    titles = ["".join(made.choice("abcde é日") for _ in range(made.randint(1, 45))).strip() for _ in range(60)]
    for t in titles[:60]:
        for share in (0.05, 0.1, 0.15):
            titles.append("".join(x for x in t if made.random() > share))
    titles += ["Xx" + titles[0][2:], titles[1].upper(), titles[1], "", " ", "a", "A"]
    rows = [(i, t, made.choice(["p", "q", "", None]), made.choice([1990, 1991, None])) for i, t in enumerate(titles)]
    got = [(r["a"], r["b"], round(r["ratio"], 6)) for r in C.indel_pairs(spark.createDataFrame(rows, "ord long, title string, author string, year int")).collect()]
    by = {}
    for i, t, author, year in rows:
        by.setdefault(t.strip().lower(), []).append((i, author, year))
    by.pop("", None)
    want = [(x[0][0], y[0], 100.0) for x in by.values() for y in x[1:]]
    for (t, x), (u, y) in itertools.combinations(by.items(), 2):
        row = [0] * (len(u) + 1)
        for c in t:
            last = 0
            for j, e in enumerate(u, 1):
                last, row[j] = row[j], last + 1 if c == e else max(row[j], row[j - 1])
        ratio = 200 * row[-1] / (len(t) + len(u))
        if ratio >= 90 or ratio >= 85 and {k[1:] for k in x if k[1] and k[2]} & {k[1:] for k in y}:
            want.append((min(x[0][0], y[0][0]), max(x[0][0], y[0][0]), round(ratio, 6)))
    assert sorted(got) == sorted(want) and any(r < 90 for *_, r in want)


def test_permutation_threshold(spark, sf, monkeypatch):
    """Against the same shuffles by hand, each place once a round; the query takes the 500 rounds of the reference's stage 9."""
    made = random.Random(3)
    rows = sorted({(p, made.choice("abc"), made.choice("xyz")) for p in range(60) for _ in range(3)})
    df = spark.createDataFrame(rows, "paper long, l string, r string")
    papers = df.select("paper").distinct()
    order = {k: [r["paper"] for r in papers.orderBy(F.xxhash64(F.lit(42), F.lit(k), "paper"), "paper").collect()] for k in range(21)}
    side = lambda i: {p: {x[i] for x in rows if x[0] == p} for p in order[0]}
    left, right = side(1), side(2)
    heaviest = sorted(max(sum(x in left[p] and y in right[q] for p, q in zip(order[0], order[k], strict=True)) for x in "abc" for y in "xyz") for k in range(1, 21))
    assert tuple(N.permutation_threshold(df, "paper", "l", "r", rounds=20).head()) == (heaviest[19], 20)
    assert tuple(N.permutation_threshold(df, "paper", "l", "r", rounds=20, alpha=0.5).head()) == (heaviest[10], 20)
    from evisynth.plans.corpus import R

    asked = {}
    monkeypatch.setattr(N, "permutation_threshold", lambda *a, **b: asked.update(b) or spark.createDataFrame([(1, 1)], "threshold long, rounds long"))
    R.queries["n02_n03_edge_threshold"](spark, sf)
    assert asked.get("rounds", 1000) >= 500


def test_first_by_keys_in_order(spark):
    made = random.Random(4)
    rows = [(i, made.choice([None, *"abcdefgh"]), made.choice([None, *"tuvwxyz"])) for i in range(60)]
    got = {r["id"]: r["root"] for r in C.first_by_keys(spark.createDataFrame(rows, "id long, d string, p string"), ["d", "p"], cut).collect()}
    dois, pmids, want = {}, {}, {}
    for i, d, p in rows:
        if d in dois or p in pmids:
            want[i] = dois[d] if d in dois else pmids[p]
            continue
        want[i] = i
        if d:
            dois[d] = i
        if p:
            pmids[p] = i
    assert got == want


def test_hard_mode_dedup_by_hand(spark):
    kind = "ord long, doi string, pmid string, title string, authors array<string>, year int, source string, hits array<struct<provider:string,family:string,query:string,rank:int>>, machine struct<score:int,tag:string>"
    hit = lambda *x: [x]
    long_title = "a very long title of a paper on many things"
    rows = [
        (1, "https://doi.org/10.1/A", None, long_title, ["P"], 2000, "x", hit("a", "f", "q", 1), (None, "m1")),
        (2, "10.1/a", "9", "something else entirely", ["Q"], 2001, "y", hit("a", "f", "q", 2), (3, "m2")),
        (3, None, "9", "third one of its own kind", [], None, "x", hit("b", "f", "q", 3), None),
        (4, None, None, long_title + "s", ["P"], 1999, "z", hit("b", "g", "q", 4), (5, "m4")),
        (5, None, "9", "", None, None, "z", [], (1, None)),
        (6, None, None, "", None, None, "z", [], None),
    ]
    got = {r["ord"]: r for r in C.dedupe_papers(spark.createDataFrame(rows, kind), ["title", "doi"], ["machine"], cut).collect()}
    assert {k: r["n_merged"] for k, r in got.items()} == {1: 3, 3: 2, 6: 1}
    assert got[1]["source"] == "x+y+z" and tuple(got[1]["machine"]) == (3, "m1") and [tuple(h) for h in got[1]["hits"]] == [("a", "f", "q", 1), ("b", "g", "q", 4)]
    assert tuple(got[3]["machine"]) == (1, None) and got[6]["hits"] == []


def test_word_error_rate_against_table(spark):
    made = random.Random(2)
    pairs = [(" ".join(made.choice("ab cd ef gh 日本 x".split()) for _ in range(made.randint(0, 12))), " ".join(made.choice("AB cd ef zz".split()) for _ in range(made.randint(0, 12)))) for _ in range(80)] + [(None, "a"), ("a", None), (None, None)]

    def wer(a, b):
        a, b = (a or "").lower().split(), (b or "").lower().split()
        if not a:
            return 1.0 if b else 0.0
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1] / len(a)

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a string, b string")
    got = {r["i"]: r["w"] for r in df.select("i", C.word_error_rate(F.col("a"), F.col("b")).alias("w")).collect()}
    assert got == pytest.approx({i: wer(*p) for i, p in enumerate(pairs)})


def _graphs():
    r = random.Random(5)
    clique = lambda nodes: [(a, b, 1.0) for i, a in enumerate(nodes) for b in nodes[:i]]
    yield clique([1, 2, 3]) + clique([4, 5, 6]) + [(3, 4, 1.0)]
    yield clique([1, 2, 3, 4]) + clique([5, 6, 7]) + [(4, 5, 0.5), (1, 7, 0.5)]
    for _ in range(2):
        yield [(a, b, float(r.randint(1, 5))) for a in range(1, 8) for b in range(1, a) if r.random() < 0.45] or [(1, 2, 1.0)]


def _partitions(nodes):
    if not nodes:
        yield []
        return
    for rest in _partitions(nodes[1:]):
        yield [[nodes[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [nodes[0], *rest[i]], *rest[i + 1 :]]


def _quality(edges, parts):
    of = {n: i for i, p in enumerate(parts) for n in p}
    m = sum(w for _, _, w in edges)
    inside = sum(w for a, b, w in edges if of[a] == of[b]) / m
    degree = {}
    for a, b, w in edges:
        degree[of[a]] = degree.get(of[a], 0) + w
        degree[of[b]] = degree.get(of[b], 0) + w
    return inside - sum((d / (2 * m)) ** 2 for d in degree.values())


@pytest.mark.parametrize("edges", list(_graphs()))
def test_louvain_on_small_graphs(spark, edges):
    """As good as the best of all partitions, and its modularity is what the query reports."""
    df = spark.createDataFrame(edges, "source long, target long, weight double")
    labels = N.louvain(df, cut)
    parts = {}
    for r in labels.collect():
        parts.setdefault(r["community"], []).append(r["node"])
    assert {c: min(p) for c, p in parts.items()} == {c: c for c in parts}
    best = max(_quality(edges, p) for p in _partitions(sorted({x for e in edges for x in e[:2]})))
    assert _quality(edges, list(parts.values())) == pytest.approx(best, abs=1e-9)
    assert N.modularity(df, labels).head()["modularity"] == pytest.approx(best, abs=1e-9)


def test_louvain_ring_of_cliques(spark):
    """Eight cliques of five in a ring are found, and label propagation is never better."""
    edges = [(10 * c + i, 10 * c + j, 1.0) for c in range(8) for i in range(5) for j in range(i)] + [(10 * c, 10 * ((c + 1) % 8) + 1, 1.0) for c in range(8)]
    df = spark.createDataFrame(edges, "source long, target long, weight double")
    labels = N.louvain(df, cut)
    assert {r["node"]: r["community"] for r in labels.collect()} == {10 * c + i: 10 * c for c in range(8) for i in range(5)}
    assert N.modularity(df, labels).head()["modularity"] >= N.modularity(df, N.label_communities(df, cut, 6)).head()["modularity"] - 1e-12


def test_two_hops(spark):
    e = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (3, 10), (4, 11), (10, 20)], "src long, dst long")
    got = {r["id"]: (r["hop"], r["via"], r["kind"]) for r in N.dive(spark.createDataFrame([(1,)], "id long"), e, 2, 2, cut).collect()}
    assert got == {1: (0, None, None), 10: (1, 1, "reference"), 11: (1, 1, "reference"), 2: (2, 10, "citation"), 20: (2, 10, "reference"), 4: (2, 11, "citation")}


def test_network_takes_top_papers_and_terms(spark):
    kind = "cluster string, paper string, title string, direction string, score double, citations long, year int, mechanisms array<string>, conditions array<string>, brain_regions array<string>, findings array<string>, methodology string"
    rows = [("c", "1", "T1", "supports", 2.0, 5, 2000, ["M  x", "rare"], None, None, None, "a/b, c,d,e"), ("c", "2", "T2", None, None, None, None, ["M  x"], None, None, ["f"], None), ("c", "3", "T3", "mixed", 9.0, 1, 1990, ["M  x"], None, None, None, None)]
    nodes, edges = N.evidence_network(spark.createDataFrame(rows, kind), cut, top_papers=2, top_terms=1)
    got = {(r["source"], r["target"], r["type"]): (r["weight"], r["evidence_count"]) for r in edges.collect()}
    assert got == {("paper:1", "cluster:c", "belongs_to"): (1.0, 1), ("paper:3", "cluster:c", "belongs_to"): (1.0, 1), ("paper:1", "cluster:c", "supports"): (2.0, 1), ("paper:1", "mechanism:m_x", "mentions"): (1.0, 1), ("paper:3", "mechanism:m_x", "mentions"): (1.0, 1), ("cluster:c", "mechanism:m_x", "cluster_theme"): (2.0, 2), ("paper:1", "method:a_b", "uses_method"): (1.0, 1)}
    assert {(r["id"], r["type"], r["count"]) for r in nodes.collect()} == {("cluster:c", "cluster", 3), ("paper:1", "paper", 1), ("paper:3", "paper", 1), ("mechanism:m_x", "mechanism", 3), ("method:a_b", "method", 1)}


def test_paragraphs_and_sections(spark):
    text = "\nMethods:\n\nWe did this\nand that.\n \n  Results\n\nIt worked. "
    rows = C.paragraph_blocks(spark.createDataFrame([(1, text), (2, None), (3, "Short one. " * 200)], "id long, t string"), "id", "t").collect()
    assert [tuple(r)[1:] for r in rows if r["id"] == 1] == [(0, 10, "Methods", "We did this and that."), (1, 45, "Results", "It worked.")]
    assert [r["text"] for r in rows if r["id"] == 3] == ["Short one. Short one. Short one. Short one."] * 50
    assert [r["start"] for r in rows if r["id"] == 3][:3] == [0, 43, 87] and not [r for r in rows if r["id"] == 2]


def test_quote_ratios(spark):
    from evisynth.operators import records

    df = spark.createDataFrame([("abc", "xxabcxx"), ("abd", "zzabczz"), ("", "x"), (None, None)], "a string, b string")
    got = [r["p"] for r in df.select(records.partial_ratio("a", "b").alias("p")).collect()]
    assert got == pytest.approx([100.0, 100 * 2 / 3, 0.0, 100.0])
    sets = spark.createDataFrame([("b a c", "C  a b"), ("a b", "a c")], "a string, b string")
    assert [r["p"] for r in sets.select(records.token_sort_ratio("a", "b").alias("p")).collect()] == pytest.approx([100.0, 200 * 2 / 6])


@pytest.mark.parametrize("block", [7, 64, 50_000])
def test_greedy_batches(spark, block):
    """10,000 rows as one sequence, whatever the blocks; oversized rows, nulls, an empty table."""
    from evisynth.operators import records

    r = random.Random(block)
    rows = [(3 * i, r.choice([None, 0, 1, 5, 30, 200])) for i in range(10_000 if block > 7 else 500)]
    df = spark.createDataFrame(rows, "id long, n long").repartition(5)
    got = {x["id"]: x["batch"] for x in records.greedy_batches(df, "id", "n", 4, 60, block).collect()}
    batch = n = total = 0
    for i, x in rows:
        if n and (n >= 4 or total + (x or 0) > 60):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + (x or 0)
        assert got.pop(i) == batch
    assert not got and records.greedy_batches(df.limit(0), "id", "n", 4, 60).count() == 0
