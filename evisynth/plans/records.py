"""Queries on provider records, claims, reviews and reports: projections, lookups and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import ids as I
from ..functions import text as T
from ..operators import claims as E
from ..operators import corpus as O
from ..operators import records as C
from ..sources import bibliography as bib
from ..tables import new_folder
from .registry import CLAIMS, PAPERS, UNESCAPED, Registry, claims, papers, table

R = Registry()


@R.query("p01_provider_union", "SELECT 'a' AS provider, c_custkey AS id, c_name AS title, CAST(c_nationkey + 1990 AS INT) AS year FROM customer UNION ALL SELECT 'b', s_suppkey, s_name, CAST(s_nationkey + 1990 AS INT) FROM supplier UNION ALL SELECT 'c', p_partkey, p_name, NULL FROM part")
def _(spark, d):
    """Each provider's columns become one schema; what a provider lacks is null."""
    a = table(spark, d, "customer").select(F.lit("a").alias("provider"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), (F.col("c_nationkey") + 1990).cast("int").alias("year"))
    b = table(spark, d, "supplier").select(F.lit("b").alias("provider"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), (F.col("s_nationkey") + 1990).cast("int").alias("year"))
    c = table(spark, d, "part").select(F.lit("c").alias("provider"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


@R.query("p05_identifier_lookup", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS doi FROM part")
def _(spark, d):
    """The value of the first identifier of a type, whatever the case of its name."""
    even = F.col("p_size") % 2 == 0
    ids = F.array(F.struct(F.when(even, "DOI").otherwise("pmid").alias("type"), F.col("p_brand").alias("value")), F.struct(F.when(even, "pmid").otherwise("Doi").alias("type"), F.col("p_type").alias("value")))
    return table(spark, d, "part").select("p_partkey", C.identifier(ids, "doi").alias("doi"))


@R.query("p08_relevance_threshold", f"WITH {CLAIMS} SELECT l_orderkey, l_linenumber, l_suppkey, a FROM claims WHERE coalesce(nullif(a, 5), 0) >= 3")
def _(spark, d):
    return claims(spark, d).where(F.coalesce(F.nullif("a", F.lit(5)), F.lit(0)) >= 3).select("l_orderkey", "l_linenumber", "l_suppkey", "a")


@R.query("p12_review_filter", "SELECT doc_id, label FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' Relevant' WHEN 1 THEN 'maybe ' WHEN 2 THEN 'IRRELEVANT' ELSE 'skipped' END AS raw FROM documents) CROSS JOIN LATERAL (SELECT lower(trim(raw)) AS label) WHERE label IN ('relevant', 'maybe', 'irrelevant')")
def _(spark, d):
    i = F.col("doc_id") % 4
    raw = F.when(i == 0, " Relevant").when(i == 1, "maybe ").when(i == 2, "IRRELEVANT").otherwise("skipped")
    return table(spark, d, "documents").select("doc_id", F.lower(F.trim(raw)).alias("label")).where(F.col("label").isin("relevant", "maybe", "irrelevant"))


@R.query("p14_full_text_targets", "WITH t AS (SELECT o_orderkey, o_custkey, 1 AS p FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_orderkey, o_custkey, 2 FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p, o_orderkey) AS rn FROM t) SELECT o_custkey, o_orderkey, p AS priority FROM r WHERE rn = 1")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    both = o.where("o_orderpriority LIKE '1%'").withColumn("priority", F.lit(1)).unionByName(o.where("o_orderstatus = 'F'").withColumn("priority", F.lit(2)))
    return both.groupBy("o_custkey").agg(F.min(F.struct("priority", "o_orderkey")).alias("m")).select("o_custkey", "m.o_orderkey", "m.priority")


@R.query("p17_p18_overlay", "SELECT s_suppkey, coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN 'corrected' END, ''), s_name) AS name, CASE WHEN s_nationkey = 0 THEN 99 ELSE s_nationkey END AS nation FROM supplier")
def _(spark, d):
    i = F.col("s_suppkey") % 3
    fixed = F.when(i == 0, "").when(i == 1, "corrected")
    return table(spark, d, "supplier").select("s_suppkey", T.first_nonempty(fixed, F.col("s_name")).alias("name"), F.when(F.col("s_nationkey") == 0, 99).otherwise(F.col("s_nationkey")).alias("nation"))


@R.query("p20_review_rows", f"WITH {CLAIMS} SELECT l_orderkey, count(*) AS n, min(a) AS first_score, max(b) AS max_n, CASE WHEN bool_or(a = 0) THEN 'Review' ELSE 'Ready' END AS status FROM claims GROUP BY l_orderkey")
def _(spark, d):
    return claims(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("a").alias("first_score"), F.max("b").alias("max_n"), F.when(F.bool_or(F.col("a") == 0), "Review").otherwise("Ready").alias("status"))


@R.query("j04_j05_full_text_join", "SELECT d.doc_id, CASE WHEN p.page_id IS NULL THEN 'abstract' WHEN length(p.html) >= 1200 THEN 'full_text' ELSE 'landing' END AS text_source FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def _(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.length("html").alias("n"))
    kind = F.when(F.col("n").isNull(), "abstract").when(F.col("n") >= 1200, "full_text").otherwise("landing")
    return table(spark, d, "documents").select("doc_id").join(p, "doc_id", "left").select("doc_id", kind.alias("text_source"))


@R.query("s17_cache_misses", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@R.query("j07_profile_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_brand, 'unknown') AS design FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey")
def _(spark, d):
    p = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("design"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("design", F.lit("unknown")).alias("design"))


@R.query("j08_component_studies", "SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey").join(table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi")


@R.query("j12_rescue_last_wins", "WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) SELECT e.user_id, e.event_type, count(*) AS n, any_value(r.event_id) AS last_id FROM events e JOIN r ON r.user_id = e.user_id AND r.event_type = e.event_type AND rn = 1 GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@R.query("j19_linked_or_blank", "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = CASE WHEN c_nationkey % 5 = 0 THEN n_nationkey ELSE c_nationkey END WHERE n_regionkey = 1")
def _(spark, d):
    """Claims of a component, and for every component those without one: two joins, of which the blank one is by region."""
    n = F.broadcast(table(spark, d, "nation").where("n_regionkey = 1"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    own = c.where("c_nationkey % 5 <> 0").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    blank = c.where("c_nationkey % 5 = 0").withColumn("r", F.lit(1)).join(n, F.col("n_regionkey") == F.col("r"))
    return own.select("c_custkey", "n_name").unionByName(blank.select("c_custkey", "n_name"))


@R.query("j20_score_lookup", "SELECT conv_id, turn, coalesce(quality, 0) AS score FROM conversations LEFT JOIN labels ON doc_id = conv_id")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn").join(table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), "quality"), "conv_id", "left").select("conv_id", "turn", F.coalesce("quality", F.lit(0)).alias("score"))


@R.query("a04_hit_merge", "SELECT o_custkey, o_orderstatus AS provider, substr(o_orderpriority, 1, 1) AS family, min(o_orderkey) AS first_hit, arg_min(round(o_totalprice, 2), o_orderkey) AS rank FROM orders GROUP BY 1, 2, 3")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("provider"), F.substring("o_orderpriority", 1, 1).alias("family"), "o_orderkey", F.round("o_totalprice", 2).alias("rank"))
    return o.groupBy("o_custkey", "provider", "family").agg(F.min("o_orderkey").alias("first_hit"), F.min_by("rank", "o_orderkey").alias("rank"))


@R.query("a10_a14_counters", f"WITH {CLAIMS} SELECT count(*) AS total, count(*) FILTER (a >= 3) AS scored_high, count(*) FILTER (b = 0) AS empty, count(DISTINCT l_suppkey) AS runs, round(100.0 * count(*) FILTER (b = 0) / count(*), 4) AS empty_pct FROM claims")
def _(spark, d):
    empty = F.count_if(F.col("b") == 0)
    return claims(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("a") >= 3).alias("scored_high"), empty.alias("empty"), F.count_distinct("l_suppkey").alias("runs"), F.round(100.0 * empty / F.count("*"), 4).alias("empty_pct"))


@R.query("a18_distinct_subjects", f"WITH {CLAIMS} SELECT l_suppkey, a AS n, b AS label, min(l_orderkey) AS first_order FROM claims GROUP BY 1, 2, 3")
def _(spark, d):
    return claims(spark, d).groupBy("l_suppkey", F.col("a").alias("n"), F.col("b").alias("label")).agg(F.min("l_orderkey").alias("first_order"))


@R.query("a19_human_review", f"WITH {CLAIMS} SELECT l_orderkey, l_linenumber, l_suppkey, 'flag' AS why FROM claims WHERE a = 0 UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, 'model' FROM claims WHERE b = 5 AND a >= 4")
def _(spark, d):
    why = F.array_compact(F.array(F.when(F.col("a") == 0, "flag"), F.when((F.col("b") == 5) & (F.col("a") >= 4), "model")))
    return claims(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", F.explode(why).alias("why"))


@R.query("a22_paper_composite", f"WITH {CLAIMS} SELECT l_orderkey, round(avg(0.4 * a + 0.6 * b), 6) AS composite, bool_or(a <> b) AS reclassified FROM claims GROUP BY l_orderkey")
def _(spark, d):
    return claims(spark, d).groupBy("l_orderkey").agg(F.round(F.avg(0.4 * F.col("a") + 0.6 * F.col("b")), 6).alias("composite"), F.bool_or(F.col("a") != F.col("b")).alias("reclassified"))


@R.query("a26_certainty_histogram", "WITH g AS (SELECT p_partkey, (['High', 'Moderate', 'Low', 'Very Low'])[1 + p_size % 4] AS certainty FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY certainty ORDER BY p_partkey) AS rn FROM g) SELECT certainty, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FILTER (rn <= 8) AS examples FROM r GROUP BY certainty")
def _(spark, d):
    """Counts, and the first eight of each as examples."""
    names = F.array(*(F.lit(x) for x in ("High", "Moderate", "Low", "Very Low")))
    g = table(spark, d, "part").select("p_partkey", F.get(names, (F.col("p_size") % 4).cast("int")).alias("certainty"))
    top = g.withColumn("rn", F.row_number().over(Window.partitionBy("certainty").orderBy("p_partkey"))).where("rn <= 8").groupBy("certainty").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",").alias("examples"))
    return g.groupBy("certainty").agg(F.count("*").alias("n")).join(top, "certainty")


@R.query("a29_a30_model_comparison", f"WITH {CLAIMS}, b AS (SELECT a, b, CASE WHEN a >= 4 THEN 'high' WHEN a >= 2 THEN 'medium' ELSE 'low' END AS x, CASE WHEN b >= 4 THEN 'high' WHEN b >= 2 THEN 'medium' ELSE 'low' END AS y FROM claims) SELECT count(*) AS n, round(avg(CAST(x = y AS DOUBLE)), 6) AS band_agreement, round(avg(abs(a - b)), 6) AS mean_delta, count(*) FILTER (b > a AND x <> y) AS promoted, count(*) FILTER (b < a AND x <> y) AS demoted FROM b")
def _(spark, d):
    band = lambda c: F.when(F.col(c) >= 4, "high").when(F.col(c) >= 2, "medium").otherwise("low")
    x = claims(spark, d).select("a", "b", (band("a") == band("b")).alias("same"))
    return x.agg(F.count("*").alias("n"), F.round(F.avg(F.col("same").cast("double")), 6).alias("band_agreement"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mean_delta"), F.count_if((F.col("b") > F.col("a")) & ~F.col("same")).alias("promoted"), F.count_if((F.col("b") < F.col("a")) & ~F.col("same")).alias("demoted"))


@R.query("w10_direction_flips", f"WITH {CLAIMS}, m AS (SELECT l_suppkey, a AS t, sign(avg(b) - 2.5) AS s FROM claims GROUP BY 1, 2), l AS (SELECT *, lag(s) OVER (PARTITION BY l_suppkey ORDER BY t) AS p FROM m) SELECT l_suppkey, count(*) FILTER (s <> p) AS flips FROM l GROUP BY l_suppkey")
def _(spark, d):
    m = claims(spark, d).groupBy("l_suppkey", "a").agg(F.signum(F.avg("b") - 2.5).alias("s"))
    m = m.withColumn("p", F.lag("s").over(Window.partitionBy("l_suppkey").orderBy("a")))
    return m.groupBy("l_suppkey").agg(F.count_if(F.col("s") != F.col("p")).alias("flips"))


@R.query("t02_dive_seeds", f"WITH {PAPERS} SELECT ord, citations FROM papers WHERE ord IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) ORDER BY citations DESC, ord LIMIT 15")
def _(spark, d):
    seeds = table(spark, d, "labels").where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("ord"))
    return papers(spark, d).join(seeds, "ord", "left_semi").orderBy(F.desc("citations"), "ord").limit(15).select("ord", "citations")


@R.query("t03_t04_paper_ranking", f"WITH {PAPERS}, r AS (SELECT source, ord, row_number() OVER (PARTITION BY source ORDER BY ord % 2 DESC, citations DESC, CAST(year AS VARCHAR) DESC, lower(title) DESC, ord) AS place FROM papers) SELECT source, CAST(place AS INT) AS place, ord FROM r WHERE place <= 8")
def _(spark, d):
    order = Window.partitionBy("source").orderBy(F.desc(F.col("ord") % 2), F.desc("citations"), F.desc(F.col("year").cast("string")), F.desc(F.lower("title")), "ord")
    return papers(spark, d).withColumn("place", F.row_number().over(order)).where("place <= 8").select("source", "place", "ord")


@R.query("t07_keyword_suggestions", f"WITH {PAPERS}, r AS (SELECT ord, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z][a-z0-9_-]{{2,}}'))) AS term FROM papers WHERE ord IN (SELECT doc_id FROM labels WHERE quality = 1)), c AS (SELECT term, count(*) AS df FROM r WHERE term NOT IN ('the', 'que', 'und') GROUP BY term) SELECT term, df FROM c ORDER BY df DESC, term LIMIT 12")
def _(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("ord"))
    terms = papers(spark, d).join(good, "ord", "left_semi").select(F.explode(T.token_set(F.col("title"), "[a-z][a-z0-9_-]{2,}")).alias("term"))
    return terms.where(~F.col("term").isin("the", "que", "und")).groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(12)


@R.query("t11_cluster_order", "SELECT label AS cluster, count(*) AS n, round(avg(vec_id), 4) AS mean_id, CAST(row_number() OVER (ORDER BY count(*) DESC, avg(vec_id) DESC, label) AS INT) AS place FROM embeddings GROUP BY label")
def _(spark, d):
    g = table(spark, d, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("n"), F.avg("vec_id").alias("m"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("m"), "cluster"))).select("cluster", "n", F.round("m", 4).alias("mean_id"), "place")


@R.query("u03_jaccard_rules", "WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (value > 50)) AS x, list_sort(list(DISTINCT event_type) FILTER (value <= 50)) AS y FROM events GROUP BY 1) SELECT user_id, round(CASE WHEN len(coalesce(x, [])) + len(coalesce(y, [])) = 0 THEN 1.0 ELSE len(list_intersect(coalesce(x, []), coalesce(y, []))) / CAST(len(coalesce(x, [])) + len(coalesce(y, [])) - len(list_intersect(coalesce(x, []), coalesce(y, []))) AS DOUBLE) END, 6) AS jaccard FROM s")
def _(spark, d):
    side = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    s = table(spark, d, "events").groupBy("user_id").agg(side(F.col("value") > 50).alias("x"), side(F.col("value") <= 50).alias("y"))
    return s.select("user_id", F.round(T.jaccard(F.col("x"), F.col("y"), 1.0), 6).alias("jaccard"))


@R.query("f16_pair_tfidf_cosine", """WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before FROM conversations), q AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9_]{2,}') AS x, regexp_extract_all(lower(before), '[a-z0-9_]{2,}') AS y FROM p WHERE before IS NOT NULL),
t AS (SELECT conv_id, turn, term, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 2) AS b FROM (SELECT conv_id, turn, unnest(x) AS term, 1 AS side FROM q UNION ALL SELECT conv_id, turn, unnest(y), 2 FROM q) GROUP BY ALL),
w AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE ln(1.5) + 1 END AS idf FROM t) SELECT conv_id, turn, round(sum(a * b * idf * idf) / nullif(sqrt(sum(a * a * idf * idf)) * sqrt(sum(b * b * idf * idf)), 0), 6) AS cosine FROM w GROUP BY ALL""")
def _(spark, d):
    """Of two texts alone: a term's idf is 1 in both and ln(3/2) + 1 in one."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    c = table(spark, d, "conversations").withColumn("before", before).where("before IS NOT NULL")
    terms = lambda col, side: F.transform(F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9_]{2,}"), F.lit(0)), lambda x: F.struct(x.alias("term"), F.lit(side).alias("side")))
    t = c.select("conv_id", "turn", F.explode(F.concat(terms("text", 1), terms("before", 2))).alias("t")).groupBy("conv_id", "turn", "t.term").agg(F.count_if(F.col("t.side") == 1).alias("a"), F.count_if(F.col("t.side") == 2).alias("b"))
    w = t.withColumn("i", F.when((F.col("a") > 0) & (F.col("b") > 0), 1.0).otherwise(F.log(F.lit(1.5)) + 1))
    x, y = F.col("a") * F.col("i"), F.col("b") * F.col("i")
    n = F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))
    return w.groupBy("conv_id", "turn").agg(F.round(F.sum(x * y) / F.nullif(n, F.lit(0.0)), 6).alias("cosine"))


@R.query("f18_partial_ratio")
def _(spark, d):
    """The best-placed Indel ratio of a damaged quote in its title, and that of sorted words."""
    p = papers(spark, d).where("length(title) > 20").select("ord", F.regexp_replace(F.substring("title", 5, 40), "e", "").alias("quote"), "title")
    return p.select("ord", F.round(C.partial_ratio("quote", "title"), 4).alias("ratio"), F.round(C.token_sort_ratio("quote", "title"), 4).alias("sorted_ratio"))


@R.query("f21_quote_validity", f"WITH {PAPERS} SELECT ord, contains(abstract, substr(title, 1, 20)) AS valid FROM papers WHERE title <> ''")
def _(spark, d):
    return papers(spark, d).where("title <> ''").select("ord", F.contains("abstract", F.substring("title", 1, 20)).alias("valid"))


@R.query("f24_f25_evidence_tier", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'high' WHEN p_size % 5 IN (1, 2) THEN 'moderate' WHEN p_size % 5 = 3 THEN 'low' ELSE 'unknown' END AS tier, p_size % 5 = 4 OR p_retailprice < 950 AS needs_review FROM part")
def _(spark, d):
    names = F.array(*(F.lit(x) for x in ("randomized_controlled_trial", "cohort_observational", "case_control", "narrative_review", "other")))
    p = table(spark, d, "part").select("p_partkey", F.get(names, (F.col("p_size") % 5).cast("int")).alias("design"), (F.col("p_retailprice") < 950).alias("unsure"))
    tier = C.evidence_tier(F.col("design"))
    return p.select("p_partkey", tier.alias("tier"), ((tier == "unknown") | F.col("unsure")).alias("needs_review"))


@R.query("f28_z13_coercions", "SELECT event_id, lower(raw) IN ('true', 'yes', '1') AS supports, coalesce(TRY_CAST(raw AS INT), 0) AS score FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'yes' WHEN 2 THEN '1' WHEN 3 THEN '7' ELSE 'no' END AS raw FROM events)")
def _(spark, d):
    i = F.col("event_id") % 5
    raw = F.when(i == 0, "TRUE").when(i == 1, "yes").when(i == 2, "1").when(i == 3, "7").otherwise("no")
    return table(spark, d, "events").select("event_id", F.lower(raw).isin("true", "yes", "1").alias("supports"), F.coalesce(raw.try_cast("int"), F.lit(0)).alias("score"))


@R.query("f30_sentence_counts", f"WITH {PAPERS} SELECT ord, len(list_filter(regexp_split_to_array(abstract, '[.!?]+'), lambda x: trim(x) <> '')) AS n FROM papers")
def _(spark, d):
    return papers(spark, d).select("ord", F.size(F.filter(F.split("abstract", "[.!?]+"), lambda x: F.trim(x) != "")).alias("n"))


@R.query("f32_f33_topic_tokens", f"WITH {PAPERS} SELECT ord, len(t) AS n, len(list_distinct(t)) AS k FROM (SELECT ord, list_filter(list_transform(regexp_extract_all(lower(abstract), '[a-z][a-z0-9_-]{{2,}}'), lambda x: trim(x, '_-')), lambda x: length(x) >= 3 AND NOT list_contains({T.STOP_WORDS!r}, x)) AS t FROM papers)")
def _(spark, d):
    stop = F.array(*(F.lit(w) for w in T.STOP_WORDS))
    t = F.filter(F.transform(F.regexp_extract_all(F.lower("abstract"), F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0)), lambda x: F.trim(x, F.lit("_-"))), lambda x: (F.length(x) >= 3) & ~F.array_contains(stop, x))
    return papers(spark, d).select("ord", t.alias("t")).select("ord", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("k"))


@R.query("f37_context_snippet", f"WITH {PAPERS} SELECT ord, substr(abstract, greatest(strpos(abstract, ' ') - 10, 1), 30) AS snippet FROM papers WHERE strpos(abstract, ' ') > 0")
def _(spark, d):
    at = F.position(F.lit(" "), "abstract")
    return papers(spark, d).where(at > 0).select("ord", F.substring("abstract", F.greatest(at - 10, F.lit(1)), F.lit(30)).alias("snippet"))


@R.query("e03_ordinal_scores", "SELECT l_orderkey, l_linenumber, l_suppkey, CAST(least(5, greatest(0, floor(CASE WHEN p < 0.368 THEN p / 0.368 * 2.5 ELSE 2.5 + (p - 0.368) / 0.632 * 2.5 END + 0.5))) AS INT) AS score FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_discount * 10 AS p FROM lineitem)")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", C.ordinal(F.col("l_discount") * 10).alias("score"))


@R.query("e09_retrieval_hit", "SELECT o_custkey, CAST(bool_or(o_orderpriority LIKE '1%') AS INT) AS hit_1, CAST(bool_or(o_orderpriority LIKE '2%') AS INT) AS hit_2 FROM orders GROUP BY o_custkey")
def _(spark, d):
    hits = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("h"))
    return hits.select("o_custkey", *(F.array_contains("h", k).cast("int").alias(f"hit_{k}") for k in "12"))


@R.query("w09_e04_batch_packing", """WITH RECURSIVE x AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
b AS (SELECT i, doc_id, n AS total, 1 AS k, 0 AS batch FROM x WHERE i = 1 UNION ALL SELECT x.i, x.doc_id, CASE WHEN b.k >= 20 OR b.total + x.n > 36000 THEN x.n ELSE b.total + x.n END, CASE WHEN b.k >= 20 OR b.total + x.n > 36000 THEN 1 ELSE b.k + 1 END, CASE WHEN b.k >= 20 OR b.total + x.n > 36000 THEN b.batch + 1 ELSE b.batch END FROM b JOIN x ON x.i = b.i + 1)
SELECT doc_id, batch FROM b""")
def _(spark, d):
    """Greedy batches of at most 20 texts and 36,000 characters, all documents in one sequence."""
    return C.greedy_batches(table(spark, d, "documents").select("doc_id", F.length("text").alias("n")), "doc_id", "n", 20, 36_000)


@R.query("n10_explanation_rollup", f"WITH {CLAIMS} SELECT l_returnflag AS cluster, count(*) AS n, count(*) FILTER (a >= 3) AS supporting, count(*) FILTER (a < 2) AS contradicting, round(avg(b), 6) AS mean_score, array_to_string(list_sort(list(DISTINCT b)), ',') AS seen FROM claims GROUP BY 1")
def _(spark, d):
    return claims(spark, d).groupBy(F.col("l_returnflag").alias("cluster")).agg(F.count("*").alias("n"), F.count_if(F.col("a") >= 3).alias("supporting"), F.count_if(F.col("a") < 2).alias("contradicting"), F.round(F.avg("b"), 6).alias("mean_score"), F.array_join(F.sort_array(F.collect_set("b")), ",").alias("seen"))


@R.query("r06_train_test_split", "SELECT doc_id, CASE WHEN substr(md5('7:' || doc_id), 1, 1) < '4' THEN 'test' ELSE 'train' END AS split FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.substring(F.md5(F.concat(F.lit("7:"), "doc_id")), 1, 1) < "4", "test").otherwise("train").alias("split"))


@R.query("s03_record_count", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


@R.query("s13_plain_text", rf"""WITH e AS (SELECT doc_id, {UNESCAPED} AS t FROM (SELECT doc_id, text AS t FROM documents)), c AS (SELECT doc_id, translate(t, chr(65279) || chr(65533) || chr(160), '   ') AS t FROM e)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS text FROM c""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.plain_text(F.col("text"))).alias("text"))


@R.query("z14_normal_list_set", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT lower(trim(o_orderpriority)))), '|') AS items FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set(F.lower(F.trim("o_orderpriority")))), "|").alias("items"))


def abstracts(spark, d):
    """part as papers on a few conditions, regions and methods."""
    pick = lambda n, *names: F.get(F.array(*(F.lit(x) for x in names)), (n % len(names)).cast("int"))
    size, key = F.col("p_size"), F.col("p_partkey")
    text = F.concat(F.lit("We found altered GABA in "), pick(size, "ASD", "epileptic people", "attention-deficit/hyperactivity disorder", "nobody"), F.lit(". The "), pick(key, "amygdala", "hippocampus", "skin"), F.lit(" was seen by "), pick(size, "fMRI", "cohort", "chance"), F.lit("! Networks grew? "), pick(key, "Results indicate more", "Nothing"))
    return table(spark, d, "part").select("p_partkey", text.alias("abstract"), F.col("p_name").alias("title"))


_PICK = lambda n, *names: f"([{', '.join(repr(x) for x in names)}])[1 + {n} % {len(names)}]"


@R.query("f26_heuristic_claims", f"""WITH p AS (SELECT p_partkey, p_size, lower(p_name) AS name FROM part) SELECT p_partkey,
  'We found altered GABA in ' || {_PICK("p_size", "ASD", "epileptic people", "attention-deficit/hyperactivity disorder", "nobody")} || CASE WHEN p_partkey % 2 = 0 THEN '|Results indicate more' ELSE '' END AS findings, 'GABA' AS mechanisms,
  {_PICK("p_size", "autism spectrum disorder", "epilepsy", "ADHD", "")} AS conditions, {_PICK("p_partkey", "amygdala", "hippocampus", "")} AS brain_regions, {_PICK("p_size", "fmri", "cohort", "")} AS methodology, true AS supports_criticality, true AS network_effects FROM p""")
def _(spark, d):
    c = abstracts(spark, d).select("p_partkey", *E.heuristic_claims(F.col("abstract"), F.lit("")))
    joined = [F.array_join(n, "|").alias(n) for n in ("findings", "mechanisms", "conditions", "brain_regions")]
    return c.select("p_partkey", *joined, "methodology", "supports_criticality", F.col("network_effects_described").alias("network_effects"))


@R.query("x19_entities", f"""WITH e AS (SELECT p_partkey, 'conditions' AS category, {_PICK("p_size", "", "Epilepsy", "ADHD", "")} AS entity FROM part UNION ALL SELECT p_partkey, 'structural_regions', {_PICK("p_partkey", "Amygdala", "Hippocampus", "")} FROM part) SELECT * FROM e WHERE entity <> ''""")
def _(spark, d):
    return E.entities(abstracts(spark, d), "p_partkey", "abstract")


@R.query("f29_balance_flag", "SELECT p_partkey, p_size % 3 <> 2 AS balance FROM part")
def _(spark, d):
    texts = F.get(F.array(F.lit("E/I ratio"), F.lit("Glutamate tone"), F.lit("other")), (F.col("p_size") % 3).cast("int"))
    return table(spark, d, "part").select("p_partkey", E.names_balance(texts, F.lit("x")).alias("balance"))


@R.query("f39_region_names", f"""SELECT p_partkey, {_PICK("p_size", "dorsolateral prefrontal cortex", "prefrontal cortex", "insula", "temporoparietal junction")} AS region, {_PICK("p_size", True, True, False, False)} AS like_cortex FROM part""")
def _(spark, d):
    name = F.get(F.array(*(F.lit(x) for x in (" DLPFC", "pfc ", "Insula", "TPJ"))), (F.col("p_size") % 4).cast("int"))
    return table(spark, d, "part").select("p_partkey", E.region(name).alias("region"), E.regions_match(name, F.lit("Prefrontal  cortex")).alias("like_cortex"))


_ANSWERS = ["""'{"score": ' || k || ', "quoted_span": " q' || event_id || ' "}'""", """'I think {"score": ' || k || '.5} so rating: ' || k""", """'Well, ' || k || '/5 it is, quote: "x"'""", """'give this a ' || k""", """'at last ' || k""", """'none'"""]


@R.query("x20_relevance_answers", f"""WITH e AS (SELECT event_id, event_id % 6 AS v, event_id % 5 AS k FROM events) SELECT event_id, CASE WHEN v < 5 THEN CAST(k AS INT) END AS score, CASE v WHEN 0 THEN 'q' || event_id WHEN 2 THEN 'x' ELSE '' END AS quote FROM e""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 6).alias("v"), (F.col("event_id") % 5).alias("k"))
    text = F.expr("CASE v " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_ANSWERS)) + " END")
    return e.select("event_id", E.relevance_answer(text).alias("r")).select("event_id", "r.*")


@R.query("x20_batched_answers", """WITH e AS (SELECT user_id, event_id, user_id % 3 AS form, count(*) OVER (PARTITION BY user_id, event_id % 8) AS n, max(event_id) OVER (PARTITION BY user_id, event_id % 8) AS last FROM events)
SELECT user_id, CAST(event_id AS VARCHAR) AS id, CAST(event_id % 6 AS INT) AS score FROM e WHERE event_id % 7 < 5 AND (form = 0 OR (form = 1 AND n > 1)) AND event_id <> last UNION ALL SELECT user_id, CAST(event_id AS VARCHAR), 5 FROM e WHERE event_id = last AND (form = 0 OR (form = 1 AND n > 1))""")
def _(spark, d):
    """A model's answers for batches of events: an object with results, a list, or neither. Scores out of bounds or given as text go; the last event of a batch is answered twice, the second time with 5."""
    i = F.col("event_id")
    entry = lambda score: F.concat(F.lit('{"id": "'), i, F.lit('", "score": '), score, F.lit("}"))
    item = entry(F.when(i % 7 < 5, (i % 6).cast("string")).when(i % 7 == 5, F.lit('"3"')).otherwise(F.lit("9")))
    by = table(spark, d, "events").groupBy("user_id", (i % 8).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))).alias("items"), F.max_by(entry(F.lit("5")), "event_id").alias("again"))
    listed = F.concat_ws(", ", F.col("items.item"), F.when(F.size("items") > 1, F.col("again")))
    answer = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('Here: {"results": ['), F.concat_ws(", ", listed, "again"), F.lit("]}"))).when(F.col("user_id") % 3 == 1, F.concat(F.lit("["), listed, F.lit("]"))).otherwise("sorry")
    return by.select("user_id", F.explode(E.batched_answers(answer)).alias("a")).select("user_id", "a.id", "a.score")


@R.query("x20_extraction_answers", "WITH e AS (SELECT event_id, event_id % 3 AS v FROM events) SELECT event_id, 'f' || event_id AS findings, 'm' AS methodology, true AS supports_criticality, CASE WHEN v = 2 THEN 'parse_failed' END AS error FROM e")
def _(spark, d):
    body = F.concat(F.lit('"findings": ["f'), "event_id", F.lit('"], "methodology": "m", "supports_criticality": true'))
    v = F.col("event_id") % 3
    text = F.when(v == 0, F.concat(F.lit("```json\n{"), body, F.lit("}\n```"))).when(v == 1, F.concat(F.lit("Sure: {"), body, F.lit(', "x": {"y": 1}} done'))).otherwise(F.concat(F.lit("{"), body))
    c = table(spark, d, "events").select("event_id", E.extraction_answer(text).alias("c"))
    return c.select("event_id", F.array_join("c.findings", "|").alias("findings"), "c.methodology", "c.supports_criticality", "c.error")


@R.query("p10_full_text_only", r"SELECT page_id FROM pages WHERE regexp_matches(html, '\S')")
def _(spark, d):
    return O.full_text_only(table(spark, d, "pages"), "html").select("page_id")


@R.query("p11_spine_defaults", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id WHEN doc_id % 3 = 1 THEN '' END, ''), md5(text)) AS uid, 0 AS n_hits, coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, 'unknown') AS source FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "text", F.when(i % 2 == 0, F.col("source")).alias("source"), F.when(i % 3 == 0, F.concat(F.lit("u"), i)).when(i % 3 == 1, "").alias("uid"))
    return O.with_spine(docs, {"hits": "array()", "source": "'unknown'"}, F.md5("text")).select("doc_id", "uid", F.size("hits").alias("n_hits"), "source")


@R.query("p19_light_clusters", "SELECT label AS cluster, count(*) AS paper_count FROM embeddings GROUP BY label")
def _(spark, d):
    """Clusters without their papers, but with how many they have."""
    c = table(spark, d, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("paper_count"))
    return c


def records(spark, d):
    """documents as records whose identifiers are partly missing and variously written."""
    i = F.col("doc_id")
    c = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    doi = F.when(i % 3 == 0, c(" https://doi.org/10.1/A", i)).when(i % 3 == 1, "")
    pmc = F.when(i % 4 == 0, c("https://pmc.ncbi.nlm.nih.gov/articles/PMC", i, "/")).when(i % 4 == 1, i.cast("string")).when(i % 4 == 2, c(" pmc", i))
    pmid = F.when(i % 5 < 2, c("https://pubmed.ncbi.nlm.nih.gov/", i)).when(i % 5 == 2, i.cast("string"))
    return papers(spark, d).withColumnRenamed("ord", "doc_id").select("doc_id", doi.alias("doi"), pmc.alias("pmc"), pmid.alias("pmid"), "title", "year", "source")


RECORDS = f"""{PAPERS}, rec AS (SELECT ord AS doc_id, CASE ord % 3 WHEN 0 THEN ' https://doi.org/10.1/A' || ord WHEN 1 THEN '' END AS doi, CASE ord % 3 WHEN 0 THEN '10.1/a' || ord END AS bare, CASE ord % 4 WHEN 3 THEN NULL ELSE 'PMC' || ord END AS pmc, CASE WHEN ord % 5 < 3 THEN CAST(ord AS VARCHAR) END AS pmid,
  CASE WHEN ord % 5 < 2 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || ord WHEN ord % 5 = 2 THEN CAST(ord AS VARCHAR) END AS raw_pmid, title, year, source FROM papers)"""


@R.query("p02_record_identifiers", f"WITH {RECORDS} SELECT doc_id, bare AS doi, pmc, pmid FROM rec")
def _(spark, d):
    """DOI, PMC and PubMed ids without their addresses."""
    c = F.col
    return records(spark, d).select("doc_id", T.doi(c("doi")).alias("doi"), I.pmcid(c("pmc")).alias("pmc"), I.pmid(c("pmid")).alias("pmid"))


@R.query("f40_record_keys", f"""WITH {RECORDS} SELECT doc_id, substr(sha256(coalesce('doi:' || bare, 'pmid:' || pmid, lower(trim(title)) || '|' || year)), 1, 32) AS uid, coalesce('doi:' || nullif(lower(trim(doi)), ''), 'pmid:' || pmid, 'title:' || substr(lower(trim(title)), 1, 80) || '|' || year) AS record_key,
  coalesce('doi:' || lower(nullif(doi, '')), 'title:' || trim(lower(title))) AS article_key, coalesce(nullif(doi, ''), pmc, pmid, title, '') AS paper_key, coalesce(nullif(trim(doi), ''), pmid, nullif(substr(trim(title), 1, 80), ''), 'paper_' || (doc_id + 1)) AS article_id FROM rec""")
def _(spark, d):
    """Five keys of a record, as five parts of a review make them."""
    c = F.col
    r = records(spark, d).withColumns({"pmc": I.pmcid(c("pmc")), "pmid": I.pmid(c("pmid"))})
    none = F.lit(None).cast("string")
    return r.select("doc_id", I.paper_uid(c("doi"), c("pmid"), c("title"), c("year")).alias("uid"), I.record_key(c("doi"), c("pmid"), none, c("title"), c("year")).alias("record_key"), I.article_key(c("doi"), c("title")).alias("article_key"), I.paper_key(c("doi"), c("pmc"), c("pmid"), c("title")).alias("paper_key"), I.article_id([c("doi"), c("pmid")], c("title"), c("doc_id")).alias("article_id"))


@R.query("p15_open_access_candidates", """WITH p AS (SELECT page_id AS i, nullif(trim(url), '') AS url FROM pages), c AS (SELECT i, unnest([{'n': 1, 's': 'pmc', 'u': CASE WHEN i % 4 = 0 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || i || '/' END}, {'n': 2, 's': 'openalex_best_oa_pdf', 'u': CASE WHEN i % 3 = 1 THEN url || '.pdf' END}, {'n': 3, 's': 'openalex_best_oa', 'u': url}, {'n': 4, 's': 'openalex_oa_url', 'u': url}, {'n': 5, 's': 's2_open_access_pdf', 'u': 'https://host/' || i}]) AS c FROM p),
f AS (SELECT i, c.u AS u, min(c.n) AS n, arg_min(c.s, c.n) AS s FROM c WHERE c.u IS NOT NULL GROUP BY 1, 2) SELECT i AS page_id, arg_min(s, n) AS best_source, arg_min(u, n) AS best, count(*) AS n FROM f GROUP BY 1""")
def _(spark, d):
    """Open-access addresses in order of preference, each once; the first is best."""
    i = F.col("page_id")
    row = {"pmc": F.when(i % 4 == 0, i.cast("string")), "openalex_best_oa_pdf_url": F.when(i % 3 == 1, F.concat(F.trim("url"), F.lit(".pdf"))), "openalex_best_oa_url": F.col("url"), "openalex_oa_url": F.concat(F.lit(" "), "url"), "s2_open_access_pdf_url": F.concat(F.lit("https://host/"), i)}
    return table(spark, d, "pages").select("page_id", I.candidates(row).alias("c")).select("page_id", F.col("c")[0]["source"].alias("best_source"), F.col("c")[0]["url"].alias("best"), F.size("c").cast("bigint").alias("n"))


@R.query("s14_pdf_link", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://x/' || page_id || '.pdf?a=1&b=2' WHEN 1 THEN '/files/' || page_id || '.PDF' WHEN 2 THEN page_id || '.pdf' ELSE '' END AS pdf FROM pages""")
def _(spark, d):
    """The PDF that a page names in its citation tag, in a link, or for a reader. Links of the pages themselves are put out of the way first."""
    i = F.col("page_id")
    c = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    own = F.when(i % 4 == 0, c('<META name="citation_pdf_url" content="https://x/', i, '.pdf?a=1&amp;b=2">')).when(i % 4 == 1, c("<a href='/files/", i, ".PDF'>")).when(i % 4 == 2, c('<div data-readcube-pdf-url = "', i, '.pdf">')).otherwise("")
    html = F.concat(own, F.regexp_replace("html", r"(?i)\.pdf|citation_pdf_url", ""))
    return table(spark, d, "pages").select("page_id", I.pdf_link(html).alias("pdf"))


@R.query("z09_paper_fields", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(n_chars % 6 AS DOUBLE) WHEN 1 THEN 2.5 WHEN 2 THEN 3.0 ELSE 0.0 END AS score, CASE doc_id % 4 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'supports' WHEN 2 THEN 'supports' ELSE 'neutral' END AS direction, CASE WHEN doc_id % 3 = 0 THEN 'q ' || doc_id WHEN doc_id % 3 = 1 THEN 's' || doc_id ELSE '' END AS quote FROM documents""")
def _(spark, d):
    """Score, direction and quote of a paper from the fields that hold them."""
    i = F.col("doc_id")
    supports = i % 4 == 2
    score = I.paper_score({"relevance_score": F.when(i % 4 == 0, (F.col("n_chars") % 6).cast("string")).when(i % 4 == 1, "high"), "score": F.when(i % 4 == 1, F.lit("2.5"))}, supports)
    way = I.paper_direction({"direction": F.when(i % 4 == 0, "Contradicting").when(i % 4 == 1, "?"), "llm_direction": F.when(i % 4 == 1, "SUPPORTS it")}, supports)
    quote = I.paper_quote({"quote": F.when(i % 3 == 0, F.concat(F.lit(" q  "), i)).otherwise(" ")}, F.when(i % 3 == 1, F.array(F.lit(" "), F.concat(F.lit("s"), i))))
    return table(spark, d, "documents").select("doc_id", score.alias("score"), way.alias("direction"), quote.alias("quote"))


@R.query("g13_stopping_rule", "WITH r AS (SELECT CAST(doc_id // 100 AS INT) AS round, count(*) FILTER (quality = 1) AS new_relevant FROM labels GROUP BY 1) SELECT round, new_relevant, CASE WHEN round >= 8 THEN 'max_rounds' WHEN round > 0 AND new_relevant < 3 THEN 'below_yield' END AS why FROM r")
def _(spark, d):
    """Labels in rounds of a hundred ids; what would end retrieval after each."""
    r = table(spark, d, "labels").groupBy(F.floor(F.col("doc_id") / 100).cast("int").alias("round")).agg(F.count_if(F.col("quality") == 1).alias("new_relevant"))
    return r.select("round", "new_relevant", I.stops(F.col("round"), F.col("new_relevant"), 8, 3).alias("why"))


@R.query("s07_pubmed_strings", f"WITH {PAPERS} SELECT ord, CAST(ord AS VARCHAR) AS pmid, 'T ' || ord AS title, 'A ' || source || ' B' AS abstract, year, CASE WHEN ord % 2 = 0 THEN '10.1/' || ord END AS doi FROM papers")
def _(spark, d):
    """Papers written as a service's XML and read back."""
    c = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    i, y = F.col("ord"), F.col("year")
    date = F.when(i % 3 == 0, c("<MedlineDate>", y, " Jan-Feb</MedlineDate>")).otherwise(c("<Year>", y, "</Year>"))
    doi = F.when(i % 2 == 0, c('<ArticleId IdType="doi">10.1/', i, "</ArticleId>")).otherwise("")
    xml = c("<S><PubmedArticle><MedlineCitation><PMID>", i, "</PMID><Article><ArticleTitle>T ", i, "</ArticleTitle><Abstract><AbstractText>A ", F.col("source"), "</AbstractText><AbstractText>B</AbstractText></Abstract><Journal><Title>J</Title><JournalIssue><PubDate>", date, "</PubDate></JournalIssue></Journal></Article></MedlineCitation><PubmedData><ArticleIdList>", doi, "</ArticleIdList></PubmedData></PubmedArticle></S>")
    return bib.pubmed_strings(papers(spark, d).select("ord", xml.alias("xml")), "ord", "xml").drop("journal")


@R.query("s04_json_lines", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 5 < 3")
def _(spark, d):
    """A log of one object a line, among blank and broken lines, written and read back."""
    i = F.col("doc_id")
    line = F.when(i % 5 < 3, F.to_json(F.struct("doc_id", "n_chars"))).when(i % 5 == 3, " ").otherwise(F.concat(F.lit('{"doc_id": '), i))
    path = new_folder(spark, "lines")
    table(spark, d, "documents").select(line.alias("value")).write.text(path)
    return bib.jsonl(spark, path, "doc_id bigint, n_chars bigint")


@R.query("s01_paper_lists", "SELECT doc_id, source FROM documents WHERE source IS NOT NULL")
def _(spark, d):
    """Lists of papers in JSON files, some under a key, written and read back."""
    by = table(spark, d, "documents").where("source IS NOT NULL").groupBy(F.floor(F.col("doc_id") / 100).alias("b")).agg(F.to_json(F.collect_list(F.struct("doc_id", "source"))).alias("x"))
    path = new_folder(spark, "lists")
    value = F.when(F.col("b") % 2 == 0, F.col("x")).otherwise(F.concat(F.lit('{"articles": '), "x", F.lit("}")))
    by.select(F.regexp_replace(value, "^(.*)$", "$1").alias("value")).write.text(path)
    return bib.paper_lists(spark.read.text(path), "value", "doc_id bigint, source string")


@R.query("z01_locations_and_authors", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'p' || page_id ELSE coalesce(url, '') END AS url, CASE page_id % 3 WHEN 0 THEN 'p' || page_id ELSE '' END AS pdf_url, CASE page_id % 2 WHEN 0 THEN 'journal' ELSE '' END AS host_type, CASE page_id % 4 WHEN 0 THEN 'A,C' WHEN 1 THEN 'Z' ELSE '' END AS authors FROM pages""")
def _(spark, d):
    """Addresses and authors in the shapes that providers give them."""
    i = F.col("page_id")
    place = F.struct(F.when(i % 3 == 0, F.concat(F.lit("p"), i)).otherwise(F.when(i % 3 == 1, F.lit(""))).alias("pdf_url"), F.col("url").alias("landing_page_url"), F.struct(F.when(i % 2 == 0, " journal ").alias("type")).alias("source"))
    author = lambda full, short: F.struct(F.lit(full).cast("string").alias("displayName"), F.lit(short).cast("string").alias("name"))
    authors = F.when(i % 4 == 0, F.array(author("A", "B"), author(None, ""), author("", "C")))
    x = table(spark, d, "pages").select("page_id", I.location(place).alias("l"), I.author_names(authors, ("displayName", "name"), F.when(i % 4 == 1, "Z")).alias("a"))
    return x.select("page_id", "l.*", F.array_join("a", ",").alias("authors"))


@R.query("z05_full_text_enrich", r"SELECT d.doc_id, length(p.html) AS n FROM documents d JOIN pages p ON p.page_id = d.doc_id WHERE regexp_matches(p.html, '\S')")
def _(spark, d):
    """Papers with their full text, those without one left out."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("full_text"))
    return O.full_text_only(table(spark, d, "documents").select("doc_id").join(p, "doc_id", "left")).select("doc_id", F.length("full_text").alias("n"))


@R.query("x18_text_files", "SELECT 'source=' || source AS folder, count(*) AS n_lines FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY source")
def _(spark, d):
    """Ids written as text files in a folder for each source, and read back file by file."""
    path = new_folder(spark, "files")
    docs = table(spark, d, "documents").where("source IS NOT NULL AND source <> ''").select(F.col("doc_id").cast("string").alias("value"), "source")
    docs.write.partitionBy("source").text(path)
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x != ""))
    files = bib.text_files(spark, path).select(F.regexp_extract("path", "(source=[^/]+)/[^/]+$", 1).alias("folder"), lines.alias("n"))
    return files.groupBy("folder").agg(F.sum("n").alias("n_lines"))
