"""Queries on merging, joins, snapshots, graphs, grading and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import grading as G
from ..functions import text as T
from ..operators import claims as E
from ..operators import corpus as C
from ..operators import graph as N
from ..tables import ranked_in_groups, running, salted_join
from ..tables import written as cut
from .registry import PAPERS, UNESCAPED, Registry, papers, table

R = Registry()


def keyed(spark, d):
    """papers with a DOI that is their first word's, so that some share one."""
    return papers(spark, d).withColumn("doi", F.nullif(F.substring(T.normal(F.col("title")), 1, 12), F.lit("")))


KEYED = f"{PAPERS}, keyed AS (SELECT *, nullif(substr(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), 1, 12), '') AS doi FROM papers)"


@R.query("a01_doi_merge", f"""WITH {KEYED}, s AS (SELECT doi, CASE WHEN doi IS NULL THEN ord END AS alone, source, min(ord) AS o FROM keyed GROUP BY ALL),
l AS (SELECT doi, alone, string_agg(source, '+' ORDER BY o) AS source FROM s GROUP BY ALL), m AS (SELECT doi, CASE WHEN doi IS NULL THEN ord END AS alone, min(ord) AS ord, count(*) AS n_merged, arg_min(title, CASE WHEN title <> '' THEN ord END) AS title FROM keyed GROUP BY ALL)
SELECT m.doi, m.ord, n_merged, title, l.source FROM m JOIN l ON m.doi IS NOT DISTINCT FROM l.doi AND m.alone IS NOT DISTINCT FROM l.alone""")
def _(spark, d):
    return C.merge_by_key(keyed(spark, d), "doi", fields=("title",))


_PAIRS = f"""{PAPERS}, t AS (SELECT lower(trim(title)) AS t, min(ord) AS ord FROM papers WHERE trim(title) <> '' GROUP BY 1),
w AS (SELECT ord, list_distinct(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) AS w FROM t),
p AS (SELECT a.ord AS a, b.ord AS b, len(list_intersect(a.w, b.w)) AS n, len(a.w) AS na, len(b.w) AS nb FROM w a JOIN w b ON a.ord < b.ord AND 100 * least(len(a.w), len(b.w)) >= 70 * greatest(len(a.w), len(b.w)))"""


@R.query("j13_similar_titles", f"WITH {_PAIRS} SELECT a, b, round(100.0 * n / (na + nb - n), 6) AS similarity FROM p WHERE 100 * n >= 70 * (na + nb - n)")
def _(spark, d):
    return C.similar_titles(papers(spark, d), 70).withColumn("similarity", F.round("similarity", 6))


@R.query("a02_title_dedup")
def _(spark, d):
    """Titles in order: one is dropped if an earlier kept one is alike; equal titles follow their first."""
    p = papers(spark, d)
    first = Window.partitionBy(F.lower(F.trim("title")))
    rows = p.withColumn("rep", F.when(F.trim("title") == "", F.col("ord")).otherwise(F.min("ord").over(first)))
    reps = rows.where("ord = rep").select(F.col("ord").alias("id"))
    done = C.keep_first(reps, C.similar_titles(p, 90).select("a", "b"), cut)
    j = rows.select("ord", "rep").join(done.withColumnRenamed("id", "rep"), "rep")
    return j.select("ord", (F.col("kept") & (F.col("ord") == F.col("rep"))).alias("kept"))


@R.query("f14_j14_indel_ratio")
def _(spark, d):
    """Indel ratio of titles, 90 or more, or 85 with equal year and first author, for whom the source stands."""
    return C.indel_pairs(papers(spark, d), author="source").withColumn("ratio", F.round("ratio", 4))


@R.query("f17_word_error_rate")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))).where("before IS NOT NULL")
    return c.select("conv_id", "turn", F.round(C.word_error_rate("before", "text"), 6).alias("wer"))


@R.query("x08_paragraph_blocks")
def _(spark, d):
    return C.paragraph_blocks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "paragraph", "start", "section", F.length("text").alias("n"))


@R.query("j02_review_queue", """SELECT doc_id, CASE WHEN quality = 1 THEN 'relevant' WHEN quality = 0 THEN 'irrelevant' END AS label, CAST(1 + n_chars % 3 AS INT) AS tier FROM documents LEFT JOIN labels USING (doc_id) WHERE 1 + n_chars % 3 <= 2""")
def _(spark, d):
    p = table(spark, d, "documents").select("doc_id", (1 + F.col("n_chars") % 3).cast("int").alias("tier")).where("tier <= 2")
    label = F.when(F.col("quality") == 1, "relevant").when(F.col("quality") == 0, "irrelevant")
    return p.join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", label.alias("label"), "tier").orderBy("tier", "doc_id")


@R.query("j03_back_merge", "SELECT d.doc_id, coalesce(l.quality, -1) AS score FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("score"))


@R.query("j06_first_by_key", f"WITH {KEYED} SELECT doi, min(ord) AS ord FROM keyed WHERE doi IS NOT NULL GROUP BY doi")
def _(spark, d):
    return keyed(spark, d).where("doi IS NOT NULL").groupBy("doi").agg(F.min("ord").alias("ord"))


@R.query("j09_u02_snapshot_diff", """WITH o AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1), n AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderdate >= DATE '1997-01-01' GROUP BY 1)
SELECT o_custkey, round(o.v, 2) AS old, round(n.v, 2) AS new, CASE WHEN o.v IS NULL THEN 'new' WHEN n.v IS NULL THEN 'removed' WHEN abs(n.v - o.v) > 0.01 THEN 'changed' ELSE 'same' END AS status FROM o FULL OUTER JOIN n USING (o_custkey)""")
def _(spark, d):
    o = table(spark, d, "orders")
    total = lambda rows: rows.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return C.snapshot_diff(total(o.where("o_orderdate < DATE '1998-01-01'")), total(o.where("o_orderdate >= DATE '1997-01-01'")), "o_custkey", "v").withColumns({c: F.round(c, 2) for c in ("old", "new")})


@R.query("j10_run_join_last_wins", """WITH r AS (SELECT o_custkey, o_totalprice, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS rn, o_orderstatus FROM orders)
SELECT a.o_custkey, round(a.o_totalprice, 2) AS a, round(b.o_totalprice, 2) AS b FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.rn = 1 AND b.rn = 1 AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'""")
def _(spark, d):
    last = C.last_of(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderkey"])
    side = lambda s, n: last.where(F.col("o_orderstatus") == s).select("o_custkey", F.round("o_totalprice", 2).alias(n))
    return side("F", "a").join(side("O", "b"), "o_custkey")


@R.query("j11_run_pairs", "WITH r AS (SELECT l_linenumber AS run, list(DISTINCT l_partkey) AS s FROM lineitem GROUP BY 1) SELECT a.run AS a, b.run AS b, round(len(list_intersect(a.s, b.s)) / CAST(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS DOUBLE), 6) AS jaccard FROM r a JOIN r b ON a.run < b.run")
def _(spark, d):
    """Line numbers as runs: what two runs share is counted by joining on the record, not on the run."""
    r = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("run"), "l_partkey").distinct()
    n = r.groupBy("run").agg(F.count("*").alias("n"))
    runs = r.groupBy("l_partkey").agg(F.sort_array(F.collect_set("run")).alias("x"))  # at most as many as there are runs
    pair = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = runs.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("k"))
    j = both.join(n.select(F.col("run").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("run").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("jaccard"))


@R.query("j15_seed_match", f"""WITH {KEYED}, s AS (SELECT ord AS seed, doi, lower(title) AS t, year FROM keyed WHERE ord IN (SELECT doc_id FROM labels WHERE quality = 1)),
c AS (SELECT seed, k.ord, 1 AS p FROM s JOIN keyed k ON s.doi = k.doi UNION ALL SELECT seed, k.ord, 2 FROM s JOIN keyed k ON s.t = lower(k.title) AND s.year = k.year AND s.t <> '')
SELECT ord, seed, min(p) AS priority FROM c WHERE ord <> seed GROUP BY ALL""")
def _(spark, d):
    """Seeds are the papers that reviewers found relevant; each way to match is an equi-join, the best one counts.

    Keys are taken from the texts once. Pairs are as many as the square of a key's papers, so a key's papers are dealt to
    many tasks, and pairs are not brought together again: a title's pair stands only where the DOI gives none. Only where
    an id stands for several papers are pairs grouped."""
    k = cut(keyed(spark, d).where("ord IS NOT NULL").select("ord", "doi", F.struct(T.lower(F.col("title")).alias("t"), "year").alias("key")))
    s = k.join(table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("ord")), "ord", "left_semi").select(F.col("ord").alias("seed"), F.col("doi").alias("seed_doi"), "doi", "key")
    by_doi = salted_join(k.where("doi IS NOT NULL").select("ord", "doi"), s.where("doi IS NOT NULL").select("seed", "doi"), "doi", "ord")
    by_title = salted_join(k.where("key.t <> ''"), s.where("key.t <> ''").select("seed", "seed_doi", "key"), "key", "ord").where("NOT coalesce(doi = seed_doi, false)")
    hit = by_doi.select("ord", "seed", F.lit(1).alias("priority")).unionByName(by_title.select("ord", "seed", F.lit(2).alias("priority"))).where("ord <> seed")
    if k.groupBy("ord").count().where("count > 1").isEmpty():
        return hit
    return hit.groupBy("ord", "seed").agg(F.min("priority").alias("priority"))


@R.query("j17_x19_entities", """WITH e AS (SELECT * FROM (VALUES ('lead', '(^|[^a-z])that([^a-z]|$)'), ('german', '(^|[^a-z])(und|der|die)([^a-z]|$)'), ('iberian', '(^|[^a-z])(que|para)([^a-z]|$)')) v(entity, pat)) SELECT doc_id, entity FROM documents, e WHERE regexp_matches(lower(text), pat)""")
def _(spark, d):
    patterns = {"lead": "(^|[^a-z])that([^a-z]|$)", "german": "(^|[^a-z])(und|der|die)([^a-z]|$)", "iberian": "(^|[^a-z])(que|para)([^a-z]|$)"}
    low = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    found = low.select("doc_id", F.array(*(F.when(F.col("low").rlike(p), e) for e, p in patterns.items())).alias("e"))
    return found.select("doc_id", F.explode(F.array_compact("e")).alias("entity"))


@R.query("j16_n09_region_match", """WITH p AS (SELECT DISTINCT p_brand AS region FROM part), o AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS t, p_brand AS b FROM part WHERE p_size = 10), m AS (SELECT region, max(CASE WHEN contains(region, b) OR contains(b, region) THEN 1 ELSE 0 END) AS hit FROM p, o GROUP BY region) SELECT count(*) AS predicted, CAST(sum(hit) AS BIGINT) AS matched, round(sum(hit) / CAST(count(*) AS DOUBLE), 3) AS convergence FROM m""")
def _(spark, d):
    """Names match if they are equal or one holds the other, in their normal forms."""
    x = table(spark, d, "part")
    p, o = x.select(F.col("p_brand").alias("region")).distinct(), x.where("p_size = 10").select(F.col("p_brand").alias("other")).distinct()
    hit = E.matching_regions(p, o)
    m = p.join(hit, "region", "left").select(F.coalesce("hit", F.lit(0)).alias("hit"))
    return m.agg(F.count("*").alias("predicted"), F.sum("hit").cast("bigint").alias("matched"), F.round(F.sum("hit") / F.count("*"), 3).alias("convergence"))


@R.query("j18_w08_f20_bottom_third", f"""WITH {PAPERS}, a AS (SELECT ord, (citations % 97) / 97.0 AS score FROM papers WHERE ord IN (SELECT doc_id FROM labels)), r AS (SELECT ord, row_number() OVER (ORDER BY score, ord) AS rn, count(*) OVER () AS n FROM a)
SELECT ord, 'audited' AS reason FROM r WHERE rn > n // 3 UNION ALL SELECT ord, 'unaudited' FROM papers WHERE ord NOT IN (SELECT doc_id FROM labels)""")
def _(spark, d):
    """The lowest third by score goes; papers without an audit pass. The cut is the score of one rank, found by counting scores, of which there are few."""
    p = papers(spark, d)
    audited = p.join(table(spark, d, "labels").select(F.col("doc_id").alias("ord")), "ord", "left_semi").select("ord", (F.col("citations") % 97).alias("s"))
    by = audited.groupBy("s").agg(F.count("*").alias("c"))
    below = by.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    place = F.row_number().over(Window.partitionBy("s").orderBy("ord")) + F.col("before")
    kept = audited.join(F.broadcast(below), "s").withColumn("place", place).where(F.col("place") > F.floor(F.col("n") / 3)).select("ord", F.lit("audited").alias("reason"))
    return kept.unionByName(p.join(audited, "ord", "left_anti").select("ord", F.lit("unaudited").alias("reason")))


@R.query("f19_audit_composite", """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS sem, l_discount * 10 AS tok, l_tax * 12.5 AS tf FROM lineitem), c AS (SELECT *, 0.4 * sem + 0.3 * tok + 0.3 * tf AS comp FROM s) SELECT l_orderkey, l_linenumber, round(comp, 6) AS composite, CASE WHEN (sem < 0.5 AND tok < 0.3) OR comp < 0.35 THEN 'P1' WHEN comp < 0.55 THEN 'P2' ELSE 'P3' END AS priority FROM c""")
def _(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("sem"), (F.col("l_discount") * 10).alias("tok"), (F.col("l_tax") * 12.5).alias("tf")).withColumn("comp", 0.4 * F.col("sem") + 0.3 * F.col("tok") + 0.3 * F.col("tf"))
    return s.select("l_orderkey", "l_linenumber", F.round("comp", 6).alias("composite"), F.when(((F.col("sem") < 0.5) & (F.col("tok") < 0.3)) | (F.col("comp") < 0.35), "P1").when(F.col("comp") < 0.55, "P2").otherwise("P3").alias("priority"))


@R.query("u01_union_sources", "SELECT source, count(*) AS n FROM (SELECT 'customer' AS source, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'part', p_name FROM part) GROUP BY source")
def _(spark, d):
    one = lambda t, c: table(spark, d, t).select(F.lit(t).alias("source"), F.col(c).alias("name"))
    return one("customer", "c_name").unionByName(one("supplier", "s_name")).unionByName(one("part", "p_name")).groupBy("source").agg(F.count("*").alias("n"))


@R.query("u04_ordered_distinct", "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), f AS (SELECT doc_id, lower(w) AS k, arg_min(w, i) AS w, min(i) AS i FROM w WHERE w <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f) SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS first_words FROM r WHERE rn <= 5 GROUP BY doc_id")
def _(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w")).where("w <> ''")
    f = w.groupBy("doc_id", F.lower("w").alias("k")).agg(F.min(F.struct("i", "w")).alias("s"))
    return f.groupBy("doc_id").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("s")), 1, 5), lambda x: x["w"]), " ").alias("first_words"))


@R.query("a21_top_terms", f"WITH {PAPERS}, t AS (SELECT source, unnest(list_filter(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9_/-]+'), lambda x: length(x) >= 3 AND NOT list_contains({T.STOP_WORDS!r}, x))) AS term FROM papers), c AS (SELECT source, term, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS place FROM c) SELECT source, CAST(place AS INT) AS place, term, n FROM r WHERE place <= 5")
def _(spark, d):
    c = papers(spark, d).select("source", F.explode(T.triage_terms(F.col("title"))).alias("term")).groupBy("source", "term").agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "term"))).where("place <= 5").select("source", "place", "term", "n")


@R.query("a20_cluster_summary", "SELECT label AS cluster, count(*) AS n, array_to_string(list_sort(list(DISTINCT vec_id % 7)), ',') AS members FROM embeddings GROUP BY label")
def _(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col("vec_id") % 7)), ",").alias("members"))


@R.query("a23_condition_gradient", "WITH r AS (SELECT p_brand AS condition, l_returnflag = 'R' AS critical FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT condition, count(*) AS total, count(*) FILTER (critical) AS n_critical, round(count(*) FILTER (critical) / CAST(count(*) AS DOUBLE), 4) AS rate FROM r GROUP BY condition HAVING count(*) >= 3")
def _(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_returnflag") == "R").alias("critical")).join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("condition")), "p_partkey")
    return r.groupBy("condition").agg(F.count("*").alias("total"), F.count_if("critical").alias("n_critical")).where("total >= 3").withColumn("rate", F.round(F.col("n_critical") / F.col("total"), 4))


@R.query("a11_run_metrics", "SELECT coalesce(event_type, 'all') AS event_type, coalesce(CAST(day AS VARCHAR), 'all') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT event_type, CAST(ts AS DATE) AS day, user_id FROM events) GROUP BY GROUPING SETS ((event_type), (day), ())")
def _(spark, d):
    """Totals by type, by day and over all, in one pass over the events."""
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("date").cast("string").alias("day"), "user_id")
    g = e.groupingSets([["event_type"], ["day"], []], "event_type", "day").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return g.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("day", F.lit("all")).alias("day"), "n", "users")


@R.query("a13_prisma_funnel", f"WITH {PAPERS} SELECT (SELECT count(*) FROM papers) AS identified, (SELECT count(DISTINCT abstract) FROM papers) AS after_dedup, (SELECT greatest(count(*) - count(DISTINCT abstract), 0) FROM papers) AS duplicates, (SELECT count(*) FROM labels) AS screened, (SELECT count(*) FROM labels WHERE quality = 1) AS included, (SELECT count(*) FROM labels WHERE quality = 0) AS excluded")
def _(spark, d):
    p = papers(spark, d).agg(F.count("*").alias("identified"), F.count_distinct(F.md5("abstract")).alias("after_dedup"))
    s = table(spark, d, "labels").agg(F.count("*").alias("screened"), F.count_if(F.col("quality") == 1).alias("included"), F.count_if(F.col("quality") == 0).alias("excluded"))
    return p.join(s).withColumn("duplicates", F.greatest(F.col("identified") - F.col("after_dedup"), F.lit(0)))


@R.query("a31_budget_split", "WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS place, count(*) OVER () AS k FROM supplier) SELECT s_suppkey, 100302 // k + CAST(place <= 100302 % k AS BIGINT) AS share FROM n")
def _(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey")
    placed = running(s, [F.col("s_suppkey").asc()])
    return placed.select("s_suppkey", C.budget_split(F.lit(100_302), F.lit(s.count()), F.col("rank") + 1).alias("share"))


@R.query("w07_s21_citation_keys", "WITH k AS (SELECT c_custkey, lower(c_mktsegment) || c_nationkey AS base FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY c_custkey) AS rn FROM k) SELECT c_custkey, CASE WHEN rn = 1 THEN base ELSE base || chr(CAST(96 + rn AS INT)) END AS cite_key FROM r")
def _(spark, d):
    """The first keeps the key, the second gets "b", and so on through the code points, however many there are."""
    k = table(spark, d, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), "c_nationkey").alias("base"))
    return ranked_in_groups(k, ["base"], [F.col("c_custkey")]).withColumn("rn", (F.col("rank") + 1).cast("int")).select("c_custkey", F.when(F.col("rn") == 1, F.col("base")).otherwise(F.concat("base", T.letter(96 + F.col("rn")))).alias("cite_key"))


@R.query("s22_ris_records", f"WITH {PAPERS} SELECT ord, md5('TY  - JOUR' || chr(10) || 'TI  - ' || title || chr(10) || 'PY  - ' || year || chr(10) || 'JO  - ' || source || chr(10) || 'ER  - ') AS ris FROM papers")
def _(spark, d):
    f = lambda tag, c: F.concat(F.lit(f"{tag}  - "), c)
    return papers(spark, d).select("ord", F.md5(F.array_join(F.array(f("TY", F.lit("JOUR")), f("TI", F.col("title")), f("PY", F.col("year").cast("string")), f("JO", F.col("source")), f("ER", F.lit(""))), "\n")).alias("ris"))


@R.query("s12_html_text", rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|nav|header|footer)\b.*?</(script|style|noscript|nav|header|footer)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages),
e AS (SELECT page_id, {UNESCAPED} AS t FROM b) SELECT page_id, md5(trim(regexp_replace(replace(t, chr(160), ' '), '\s+', ' ', 'g'))) AS text FROM e""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("text"))


@R.query("s14_links_in_html", "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS n_links, regexp_extract(html, 'href=\"([^\"]+)\"', 1) AS first_link FROM pages")
def _(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(links).alias("n_links"), F.regexp_extract("html", 'href="([^"]+)"', 1).alias("first_link"))


@R.query("s18_s28_latest_upsert", "WITH a AS (SELECT user_id, event_id, event_type, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM a) SELECT user_id, event_id, event_type FROM r WHERE rn = 1")
def _(spark, d):
    return C.last_of(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@R.query("s31_triplets_to_pairs", "SELECT conv_id, turn, p.label, length(p.t) AS n FROM (SELECT conv_id, turn, unnest([{'label': 1.0, 't': text}, {'label': 0.0, 't': role}]) AS p FROM conversations)")
def _(spark, d):
    pair = lambda x, c: F.struct(F.lit(x).alias("label"), F.col(c).alias("t"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array(pair(1.0, "text"), pair(0.0, "role"))).alias("p")).select("conv_id", "turn", "p.label", F.length("p.t").alias("n"))


def brands(spark, d):
    """Orders as papers that name brands of parts and nations of suppliers."""
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("nation"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(p, "l_partkey").join(s, "l_suppkey").select("l_orderkey", "brand", "nation")


BRANDS = "brands AS (SELECT l_orderkey, p_brand AS brand, n_name AS nation FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"
_EDGES = f"WITH {BRANDS}, a AS (SELECT DISTINCT l_orderkey, brand FROM brands), b AS (SELECT DISTINCT l_orderkey, nation FROM brands)"


@R.query("n01_cooccurrence_edges", f"{_EDGES} SELECT brand, nation, count(*) AS weight FROM a JOIN b USING (l_orderkey) GROUP BY ALL")
def _(spark, d):
    return N.cooccurrence(brands(spark, d), "l_orderkey", "brand", "nation")


@R.query("t06_top_edges", f"{_EDGES} SELECT brand, nation, count(*) AS weight FROM a JOIN b USING (l_orderkey) GROUP BY ALL ORDER BY weight DESC, brand, nation LIMIT 10")
def _(spark, d):
    return N.cooccurrence(brands(spark, d), "l_orderkey", "brand", "nation").orderBy(F.desc("weight"), "brand", "nation").limit(10)


@R.query("n05_w02_v06_edge_windows", f"""{_EDGES}, e AS (SELECT DISTINCT year(o_orderdate) AS y, brand, nation FROM a JOIN b USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey),
w AS (SELECT DISTINCT CAST((SELECT min(y) FROM e) + (y - (SELECT min(y) FROM e)) // 2 * 2 AS INT) AS window_start, brand, nation FROM e), s AS (SELECT window_start, count(*) AS n FROM w GROUP BY 1), l AS (SELECT window_start, n, lag(window_start) OVER (ORDER BY window_start) AS prev FROM s),
j AS (SELECT x.window_start, count(*) AS k FROM w x JOIN l ON l.window_start = x.window_start JOIN w p ON p.window_start = l.prev AND p.brand = x.brand AND p.nation = x.nation GROUP BY 1)
SELECT l.window_start, l.n AS n_edges, CASE WHEN l.prev IS NOT NULL THEN round(coalesce(k, 0) / CAST(l.n + q.n - coalesce(k, 0) AS DOUBLE), 6) END AS jaccard FROM l LEFT JOIN j USING (window_start) LEFT JOIN s q ON q.window_start = l.prev""")
def _(spark, d):
    r = brands(spark, d)
    a, b = r.select("l_orderkey", "brand").distinct(), r.select("l_orderkey", "nation").distinct()
    e = a.join(b, "l_orderkey")
    e = e.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("y")), "l_orderkey")
    return N.window_edges(e, "y", 2, ["brand", "nation"]).withColumn("jaccard", F.round("jaccard", 6))


@R.query("n02_n03_edge_threshold")
def _(spark, d):
    r = brands(spark, d)
    edges, bound = N.cooccurrence(r, "l_orderkey", "brand", "nation"), N.permutation_threshold(r, "l_orderkey", "brand", "nation", rounds=500)
    return edges.join(F.broadcast(bound)).select("brand", "nation", "weight", "threshold", (F.col("weight") >= F.col("threshold")).alias("significant"))


def nation_edges(spark, d):
    r = brands(spark, d).select("l_orderkey", "nation").distinct()
    a, b = r.withColumnRenamed("nation", "source"), r.withColumnRenamed("nation", "target")
    return a.join(b, "l_orderkey").where("source < target").groupBy("source", "target").agg(F.count("*").alias("weight"))


@R.query("n04_communities")
def _(spark, d):
    return N.label_communities(nation_edges(spark, d), cut, rounds=6)


@R.query("n04_louvain")
def _(spark, d):
    """Communities of nations by modularity, with the modularity they reach."""
    edges = cut(nation_edges(spark, d))
    labels = N.louvain(edges, cut)
    return labels.join(N.modularity(edges, labels).select(F.round("modularity", 9).alias("modularity"))).select("node", "community", "modularity")


@R.query("n04_modularity", f"""WITH {BRANDS}, r AS (SELECT DISTINCT l_orderkey, nation FROM brands), e AS (SELECT a.nation AS s, b.nation AS t, count(*) AS w FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.nation < b.nation GROUP BY ALL),
l AS (SELECT n_name AS node, n_regionkey AS c FROM nation), x AS (SELECT w, p.c AS cs, q.c AS ct FROM e JOIN l p ON p.node = s JOIN l q ON q.node = t), m AS (SELECT sum(w) AS m, sum(CASE WHEN cs = ct THEN w ELSE 0 END) AS i FROM x), g AS (SELECT c, sum(w) AS d FROM (SELECT cs AS c, w FROM x UNION ALL SELECT ct, w FROM x) GROUP BY c)
SELECT round(any_value(i) / CAST(any_value(m) AS DOUBLE) - sum(pow(d / (2.0 * m), 2)), 6) AS modularity, count(*) AS communities FROM g, m""")
def _(spark, d):
    labels = table(spark, d, "nation").select(F.col("n_name").alias("node"), F.col("n_regionkey").alias("community"))
    return N.modularity(nation_edges(spark, d), labels).withColumn("modularity", F.round("modularity", 6))


@R.query("n08_citation_expansion", """WITH e AS (SELECT l_orderkey AS src, l_partkey + 10000000 AS dst FROM lineitem), s AS (SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15),
f AS (SELECT DISTINCT dst AS id, s.id AS via, 'reference' AS kind FROM s JOIN e ON s.id = e.src), r AS (SELECT *, row_number() OVER (PARTITION BY via, kind ORDER BY id) AS rn FROM f), k AS (SELECT id, via, kind FROM r WHERE rn <= 3)
SELECT id, min(via) AS via, 'reference' AS kind FROM k GROUP BY id""")
def _(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst"))
    return N.expand(table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select(F.col("o_orderkey").alias("id")), e, 3)


@R.query("n08_two_hops", """WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey + 10000000 AS dst FROM lineitem), s AS (SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15),
r AS (SELECT dst AS id, s.id AS via, row_number() OVER (PARTITION BY s.id ORDER BY dst) AS rn FROM s JOIN e ON s.id = src), h1 AS (SELECT id, 1 AS hop, min(via) AS via, 'reference' AS kind FROM r WHERE rn <= 3 GROUP BY id),
c AS (SELECT src AS id, h1.id AS via, row_number() OVER (PARTITION BY h1.id ORDER BY src) AS rn FROM h1 JOIN e ON h1.id = dst), h2 AS (SELECT id, 2 AS hop, min(via) AS via, 'citation' AS kind FROM c WHERE rn <= 3 AND id NOT IN (SELECT id FROM s) GROUP BY id)
SELECT id, 0 AS hop, NULL AS via, NULL AS kind FROM s UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2""")
def _(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst"))
    seeds = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select(F.col("o_orderkey").alias("id"))
    return N.dive(seeds, e, 3, 2, cut)


def clustered(spark, d):
    """documents as papers in clusters by source, with claims made from their numbers."""
    i = F.col("doc_id")
    one = lambda tag, n: F.array(F.concat(F.lit(tag), i % n))
    rows = table(spark, d, "documents").where("source IS NOT NULL")
    return rows.select(F.col("source").alias("cluster"), i.cast("string").alias("paper"), F.concat(F.lit("Paper "), i).alias("title"), F.when(i % 3 == 0, "supports").when(i % 3 == 1, "contradicts").otherwise("mixed").alias("direction"), (F.col("n_chars") % 6).cast("double").alias("score"), F.col("n_chars").alias("citations"), (1990 + i % 30).alias("year"), one("Mech ", 11).alias("mechanisms"), one("C/", 7).alias("conditions"), one("r", 5).alias("brain_regions"), F.array().cast("array<string>").alias("findings"), F.when(i % 2 == 0, "mri/eeg, cohort").alias("methodology"))


@R.query("n06_evidence_network", """WITH p AS (SELECT source AS c, doc_id AS i, n_chars % 6 AS score, 'paper:' || doc_id AS pid, 'cluster:' || source AS cid, row_number() OVER (PARTITION BY source ORDER BY doc_id % 3 = 0 DESC, n_chars % 6 DESC, n_chars DESC, CAST(1990 + doc_id % 30 AS VARCHAR) DESC, 'paper ' || doc_id DESC, CAST(doc_id AS VARCHAR)) AS rn FROM documents WHERE source IS NOT NULL),
t AS (SELECT * FROM p WHERE rn <= 8), n AS (SELECT pid, cid, unnest(['mechanism:mech_' || i % 11, 'condition:c_' || i % 7, 'brain_region:r' || i % 5]) AS tid FROM t), m AS (SELECT pid, unnest(['method:mri_eeg', 'method:cohort']) AS tid FROM t WHERE i % 2 = 0),
e AS (SELECT pid AS source, cid AS target, 'belongs_to' AS type, 1.0 AS weight FROM t UNION ALL SELECT pid, cid, CASE i % 3 WHEN 0 THEN 'supports' ELSE 'contradicts' END, greatest(score, 1.0) FROM t WHERE i % 3 < 2 UNION ALL SELECT pid, tid, 'mentions', 1.0 FROM n UNION ALL SELECT cid, tid, 'cluster_theme', 1.0 FROM n UNION ALL SELECT pid, tid, 'uses_method', 1.0 FROM m)
SELECT source, target, type, round(sum(weight), 3) AS weight, count(*) AS evidence_count FROM e GROUP BY ALL""")
def _(spark, d):
    return N.evidence_network(clustered(spark, d), cut)[1]


@R.query("n06_network_nodes", """WITH p AS (SELECT source AS c, doc_id AS i, n_chars % 6 AS score, row_number() OVER (PARTITION BY source ORDER BY doc_id % 3 = 0 DESC, n_chars % 6 DESC, n_chars DESC, CAST(1990 + doc_id % 30 AS VARCHAR) DESC, 'paper ' || doc_id DESC, CAST(doc_id AS VARCHAR)) AS rn FROM documents WHERE source IS NOT NULL),
w AS (SELECT rn, unnest([{'id': 'mechanism:mech_' || i % 11, 'type': 'mechanism'}, {'id': 'condition:c_' || i % 7, 'type': 'condition'}, {'id': 'brain_region:r' || i % 5, 'type': 'brain_region'}]) AS n FROM p UNION ALL SELECT rn, unnest([{'id': 'method:mri_eeg', 'type': 'method'}, {'id': 'method:cohort', 'type': 'method'}]) FROM p WHERE i % 2 = 0)
SELECT 'cluster:' || c AS id, 'cluster' AS type, count(*) AS count FROM p GROUP BY c UNION ALL SELECT 'paper:' || i, 'paper', count(*) FROM p WHERE rn <= 8 GROUP BY i UNION ALL SELECT n.id, n.type, count(*) FROM w GROUP BY ALL HAVING min(rn) <= 8""")
def _(spark, d):
    return N.evidence_network(clustered(spark, d), cut)[0].drop("label")


@R.query("a03_hard_mode_dedup")
def _(spark, d):
    """Papers with hits and scores merged by DOI, then PMID, then title; sources stand for first authors."""
    p = papers(spark, d)
    i = F.col("ord")
    hit = F.array(F.struct(F.col("source").alias("provider"), F.concat(F.lit("f"), i % 3).alias("family"), F.lit("q").alias("query"), (i % 9).cast("int").alias("rank")))
    rows = p.select("ord", F.when(i % 7 == 0, F.concat(F.lit("10.1/"), F.floor(i / 14))).alias("doi"), F.when(i % 5 == 0, F.floor(i / 10).cast("string")).alias("pmid"), "title", F.array("source").alias("authors"), "year", "source", hit.alias("hits"), F.struct(F.when(i % 2 == 0, i % 6).alias("score"), F.lit("x").alias("tag")).alias("machine"))
    out = C.dedupe_papers(rows, ["title", "authors", "year", "doi", "pmid"], ["machine"], cut)
    return out.select("ord", "n_merged", "title", "source", F.size("hits").alias("n_hits"), F.col("machine.score").alias("score"))


@R.query("g01_g08_grade_table", """WITH s AS (SELECT n_name AS component, count(*) AS n, avg(CAST(l_returnflag = 'R' AS DOUBLE)) AS low, avg(CAST(l_returnflag = 'A' AS DOUBLE)) AS moderate, avg(CAST(l_linestatus = 'F' AS DOUBLE)) AS flagged, avg(CAST(l_tax > 0.02 AS DOUBLE)) AS control,
    avg(l_discount) * 10 AS agreement, stddev_samp(l_discount) AS spread, avg(l_quantity) / 50 AS stability, avg(CAST(l_quantity > 20 AS DOUBLE)) AS matched, stddev_samp(l_quantity) / sqrt(count(*)) AS width
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1),
b AS (SELECT *, CASE WHEN low > 0.5 OR flagged > 0.4 THEN 2 WHEN moderate > 0.5 OR low > 0.3 THEN 1 ELSE 0 END AS b1, CASE WHEN agreement < 0.4 THEN 2 WHEN agreement < 0.7 THEN 1 ELSE 0 END AS b2, CASE WHEN width > 0.5 THEN 2 WHEN width > 0.3 THEN 1 ELSE 0 END AS b4 FROM s),
g AS (SELECT component, least(2, b1 + CASE WHEN control < 0.3 AND b1 < 2 THEN 1 ELSE 0 END) AS risk_of_bias, least(2, CASE WHEN spread > 0.3 AND b2 < 1 THEN 1 ELSE b2 END + CASE WHEN stability < 0.5 THEN 1 ELSE 0 END) AS inconsistency,
  CASE WHEN matched < 0.2 THEN 2 WHEN matched < 0.5 THEN 1 ELSE 0 END AS indirectness, CASE WHEN n < 3 THEN 2 WHEN n < 5 THEN greatest(b4, 1) ELSE b4 END AS imprecision FROM b)
SELECT *, (['High', 'Moderate', 'Low', 'Very Low'])[1 + least(3, 0 + risk_of_bias + inconsistency + indirectness + imprecision)] AS certainty FROM g""")
def _(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("component"))
    share = lambda x: F.avg(F.expr(x).cast("double"))
    a = table(spark, d, "lineitem").join(s, "l_suppkey").groupBy("component").agg(F.count("*").alias("n"), share("l_returnflag = 'R'").alias("low"), share("l_returnflag = 'A'").alias("moderate"), share("l_linestatus = 'F'").alias("flagged"), share("l_tax > 0.02").alias("control"), (F.avg("l_discount") * 10).alias("agreement"), F.stddev_samp("l_discount").alias("spread"), (F.avg("l_quantity") / 50).alias("stability"), share("l_quantity > 20").alias("matched"), (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("width"))
    c = F.col
    g = a.select("component", G.risk_of_bias(c("low"), c("moderate"), c("flagged"), c("control")).alias("risk_of_bias"), G.inconsistency(c("agreement"), c("spread"), c("stability")).alias("inconsistency"), G.indirectness(c("matched"), c("n")).alias("indirectness"), G.imprecision(c("width"), c("n")).alias("imprecision"))
    return g.withColumn("certainty", G.certainty(F.lit(True), c("risk_of_bias") + c("inconsistency") + c("indirectness") + c("imprecision")))


@R.query("r01_stratified_sample", f"""WITH {PAPERS}, s AS (SELECT ord, CASE WHEN citations < 800 THEN 'low' WHEN citations < 2500 THEN 'mid' ELSE 'high' END AS stratum FROM papers), c AS (SELECT stratum, count(*) AS n, sum(count(*)) OVER () AS total FROM s GROUP BY stratum),
q AS (SELECT stratum, greatest(1, CAST(floor(100.0 * n / total + 0.5) AS BIGINT)) AS quota FROM c), r AS (SELECT ord, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || ord), ord) AS rn FROM s)
SELECT ord, stratum FROM r JOIN q USING (stratum) WHERE rn <= quota""")
def _(spark, d):
    """A sample of about 100 by strata of length, in proportion and at least one each, by order of a seeded hash."""
    s = papers(spark, d).select("ord", F.when(F.col("citations") < 800, "low").when(F.col("citations") < 2500, "mid").otherwise("high").alias("stratum"))
    c = s.groupBy("stratum").agg(F.count("*").alias("n"))
    q = c.withColumn("quota", F.greatest(F.lit(1), F.floor(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()) + 0.5)))
    order = [F.md5(F.concat(F.lit("42:"), "ord")), F.col("ord")]
    return ranked_in_groups(s, ["stratum"], order).join(F.broadcast(q), "stratum").where("rank < quota").select("ord", "stratum")  # a row a stratum


GRADED = [("articles", "thatthe", ["ingthe", "hetion"]), ("romance", "cionado", ["osque", "para"]), ("german", "einheit", ["keitund"]), ("none", "zzzz", [])]
_MATCHED = " UNION ALL ".join(f"SELECT '{cid}' AS component_id, doc_id FROM documents WHERE {' OR '.join(f'contains(lower(text), {w!r})' for w in (label, *words))}" for cid, label, words in GRADED)


@R.query("g07_g08_findings_table", f"""WITH m AS ({_MATCHED}), s AS (SELECT component_id, count(*) AS n, avg(CAST(n_chars % 5 = 0 AS DOUBLE)) AS low, avg(CAST(n_chars % 5 = 1 AS DOUBLE)) AS moderate, avg(CAST(n_chars % 3 = 0 AS DOUBLE)) AS flagged, avg(CAST(n_chars % 2 = 0 AS DOUBLE)) AS control, avg(CAST(n_chars % 5 = 2 AS DOUBLE)) AS high, avg(CAST(n_chars % 7 > 0 AS DOUBLE)) AS matched FROM m JOIN documents USING (doc_id) GROUP BY 1),
g AS (SELECT component_id, n, least(2, b1 + CASE WHEN control < 0.3 AND b1 < 2 THEN 1 ELSE 0 END) AS d1, 1 AS d2, CASE WHEN matched < 0.2 THEN 2 WHEN matched < 0.5 THEN 1 ELSE 0 END AS d3, CASE WHEN n < 3 THEN 2 WHEN n < 5 THEN 1 ELSE 0 END AS d4, 1 AS d5, high > 0.5 AS high FROM (SELECT *, CASE WHEN low > 0.5 OR flagged > 0.4 THEN 2 WHEN moderate > 0.5 OR low > 0.3 THEN 1 ELSE 0 END AS b1 FROM s)),
l AS (SELECT ['No concern', 'Serious', 'Very serious'] AS x)
SELECT component_id, n, x[d1 + 1] AS risk_of_bias, x[d2 + 1] AS inconsistency, x[d3 + 1] AS indirectness, x[d4 + 1] AS imprecision, x[d5 + 1] AS publication_bias, (['High', 'Moderate', 'Low', 'Very Low'])[1 + least(3, CASE WHEN high THEN 0 ELSE 2 END + d1 + d2 + d3 + d4 + d5)] AS certainty FROM g, l""")
def _(spark, d):
    """Studies of each component inferred from claims, all five domains rated, the certainty, and the table with a column a domain. Nothing is known of agreement, nor were bias tests run."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "text", "n_chars")
    claims_ = docs.select("article_id", F.array("text").alias("findings"), F.array().cast("array<string>").alias("conditions"))
    x = G.studies_of_components(claims_, GRADED).join(docs.select("article_id", "n_chars"), "article_id")
    share = lambda e: F.avg(F.expr(e).cast("double"))
    a = x.groupBy("component_id").agg(F.count("*").alias("n"), share("n_chars % 5 = 0").alias("low"), share("n_chars % 5 = 1").alias("moderate"), share("n_chars % 3 = 0").alias("flagged"), share("n_chars % 2 = 0").alias("control"), share("n_chars % 5 = 2").alias("high"), share("n_chars % 7 > 0").alias("matched"))
    none, c = F.lit(None).cast("double"), F.col
    rated = {"risk_of_bias": G.risk_of_bias(c("low"), c("moderate"), c("flagged"), c("control")), "inconsistency": G.inconsistency(none, none, none), "indirectness": G.indirectness(c("matched"), c("n")), "imprecision": G.imprecision(none, c("n")), "publication_bias": G.publication_bias(c("n"), none, none, none, none)}
    long = a.select("component_id", "n", "high", F.explode(F.array(*(F.struct(F.lit(k).alias("domain"), v.cast("int").alias("downgrade")) for k, v in rated.items()))).alias("r")).select("component_id", "n", "high", "r.*")
    total = long.groupBy("component_id").agg(F.sum("downgrade").alias("down"), F.first("high").alias("high")).select("component_id", G.certainty(F.col("high") > 0.5, F.col("down")).alias("certainty"))
    return G.findings_table(long, ["component_id", "n"]).join(total, "component_id")


#: Documents as bulk records: a labelled half of the text and another one, an author or a group, one of three kinds of dates.
_PLAIN = "[^\\x21-\\x25\\x27-\\x3B\\x3D\\x3F-\\x7E]+"


@R.query("s06_pubmed_bulk", f"""WITH d AS (SELECT doc_id, lang, source, trim(regexp_replace(text, '{_PLAIN}', ' ', 'g')) AS t FROM documents),
p AS (SELECT *, trim(substr(t, 1, length(t) // 2)) AS a, trim(substr(t, length(t) // 2 + 1)) AS b FROM d)
SELECT CAST(doc_id AS VARCHAR) AS pmid, '10.1/' || doc_id AS doi, trim(substr(t, 1, 40)) AS title, trim(CASE WHEN a <> '' THEN 'BACKGROUND: ' || a ELSE '' END || CASE WHEN b <> '' THEN ' ' || b ELSE '' END) AS abstract, CASE WHEN doc_id % 2 = 0 THEN source || ' group' ELSE 'Last' || doc_id || ', F' END AS authors,
  CAST(CASE doc_id % 3 WHEN 0 THEN 1990 + doc_id % 30 WHEN 1 THEN 1950 + doc_id % 40 ELSE 2001 END AS INT) AS year, lang AS mesh FROM p WHERE a <> '' OR b <> ''""")
def _(spark, d):
    """documents written as compressed bulk XML and read back by the data source; records without an abstract stay out."""
    from ..sources import pubmed
    from ..tables import new_folder, partitions, written

    i = F.col("doc_id")
    t = F.trim(F.regexp_replace("text", _PLAIN, " "))
    half = F.floor(F.char_length(t) / 2).cast("int")
    section = lambda label, text: F.struct(F.lit(label).cast("string").alias("_Label"), F.trim(text).alias("_VALUE"))
    author = F.struct(F.when(i % 2 == 0, F.concat("source", F.lit(" group"))).alias("CollectiveName"), F.when(i % 2 == 1, F.concat(F.lit("Last"), i)).alias("LastName"), F.when(i % 2 == 1, F.lit("F")).alias("Initials"))
    date = F.struct(F.when(i % 3 == 0, (1990 + i % 30).cast("string")).alias("Year"), F.when(i % 3 == 1, F.concat(F.lit("Spring "), 1950 + i % 40, F.lit("-51"))).alias("MedlineDate"))
    article = F.struct(F.substring(t, 1, 40).alias("ArticleTitle"), F.struct(F.array(section("BACKGROUND", F.substring(t, F.lit(1), half)), section(None, F.substring(t, half + 1, F.char_length(t)))).alias("AbstractText")).alias("Abstract"), F.struct(F.array(author).alias("Author")).alias("AuthorList"), F.struct(F.struct(date.alias("PubDate")).alias("JournalIssue")).alias("Journal"))
    citation = F.struct(i.cast("string").alias("PMID"), F.when(i % 3 == 2, F.struct(F.lit("2001").alias("Year"))).alias("DateRevised"), article.alias("Article"), F.struct(F.array(F.struct(F.col("lang").alias("DescriptorName"))).alias("MeshHeading")).alias("MeshHeadingList"))
    ids = F.struct(F.struct(F.array(F.struct(F.lit("doi").alias("_IdType"), F.concat(F.lit("10.1/"), i).alias("_VALUE"))).alias("ArticleId")).alias("ArticleIdList"))
    folder = new_folder(spark, "pubmed")
    table(spark, d, "documents").where(i.isNotNull()).select(citation.alias("MedlineCitation"), ids.alias("PubmedData")).repartition(partitions(spark)).write.format("xml").option("rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle").option("compression", "gzip").save(folder)
    pubmed.register(spark)
    rows = spark.read.format("pubmed_bulk").option("path", folder).load()
    return written(rows.select("pmid", "doi", "title", "abstract", F.array_join("authors", "; ").alias("authors"), "year", F.array_join("mesh_terms", "; ").alias("mesh")), "pubmed-rows")
