"""Queries on keyword evidence, triage and text functions, over documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as T
from ..operators import scoring as S
from .registry import PAPERS, Registry, papers, table

R = Registry()

COMPONENTS = [S.Component("articles", ("the", "that", "and")), S.Component("endings", ("tion", "ing", "heit")), S.Component("romance", ("que", "la", "el"), 1.4), S.Component("german", ("und", "der", "die"), 0.9)]
FAMILIES = [("f1", "thatthe reanthe onthat with"), ("f2", "cionado para osque una"), ("f3", "einheit keit und der die")]

_KEYS = sorted({k for c in COMPONENTS for k in c.keywords})
_HITS = ", ".join(f"CAST((length(norm) - length(replace(norm, '{k}', ''))) / {len(k)} AS INT) AS h_{k}" for k in _KEYS)
_COUNT = lambda patterns: " + ".join(f"CAST(regexp_matches(norm, '{p}') AS INT)" for p in patterns)


def _component_sql(c: S.Component) -> str:
    others = [k for o in COMPONENTS if o.id != c.id for k in o.keywords]
    m = lambda ks: "(" + " + ".join(f"CAST(h_{k} > 0 AS INT)" for k in ks) + ")"
    own = "(" + " + ".join(f"h_{k}" for k in c.keywords) + ")"
    return f"""SELECT ord, year, citations, n_words, dir_score, '{c.id}' AS component_id, {m(c.keywords)} AS n_matched,
      0.6 * ({m(c.keywords)} / CAST({len(c.keywords)} AS DOUBLE)) + 0.4 * least({own} / CAST(greatest(n_words, 1) AS DOUBLE) * 50, 1.0) AS kw_score,
      CASE WHEN {m(c.keywords)} > 0 AND {m(others)} > 0 THEN least({m(c.keywords)}, {m(others)}) / CAST({max(len(c.keywords), len(others))} AS DOUBLE) ELSE 0 END AS cooc FROM hits"""


LINKS = f"""{PAPERS},
norms AS (SELECT *, trim(regexp_replace(lower(coalesce(abstract, '')), '\\s+', ' ', 'g')) AS norm FROM papers),
counts AS (SELECT ord, year, citations, {_HITS}, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS n_words, {_COUNT(T.SUPPORT)} AS s, {_COUNT(T.NEGATION)} AS n FROM norms),
hits AS (SELECT *, CASE WHEN s + n = 0 THEN 0.0 ELSE CAST(s - n AS DOUBLE) / (s + n) END AS dir_score FROM counts),
scored AS ({" UNION ALL ".join(_component_sql(c) for c in COMPONENTS)}),
related AS (SELECT *, CASE WHEN n_words = 0 THEN 0.0 ELSE 0.5 * kw_score + 0.3 * cooc + 0.2 * abs(dir_score) END AS relevance, least(kw_score + cooc, 1.0) AS confidence FROM scored),
links AS (SELECT *, CASE WHEN relevance < 0.1 THEN 'neutral' WHEN dir_score > 0.2 THEN 'supports' WHEN dir_score < -0.2 THEN 'contradicts' ELSE 'tangential' END AS direction FROM related)"""


def links(spark, d):
    return S.evidence_links(papers(spark, d), COMPONENTS)


def six(*names):
    return [F.round(n, 6).alias(n) for n in names]


@R.query("j01_evidence_links", f"WITH {LINKS} SELECT ord, component_id, n_matched, round(kw_score, 6) AS kw_score, round(cooc, 6) AS cooc, round(dir_score, 6) AS dir_score, round(relevance, 6) AS relevance, round(confidence, 6) AS confidence, direction FROM links")
def _(spark, d):
    return links(spark, d).select("ord", "component_id", "n_matched", *six("kw_score", "cooc", "dir_score", "relevance", "confidence"), "direction")


@R.query("a06_alignment", f"""WITH {LINKS} SELECT component_id, count(*) AS evidence_count, count(*) FILTER (direction = 'supports') AS supporting, count(*) FILTER (direction = 'contradicts') AS contradicting,
  count(*) FILTER (direction NOT IN ('supports', 'contradicts')) AS neutral, round((supporting - contradicting) / CAST(count(*) AS DOUBLE), 6) AS support_score, round(avg(confidence), 6) AS confidence FROM links GROUP BY component_id""")
def _(spark, d):
    return S.alignment(links(spark, d)).select("component_id", "evidence_count", "supporting", "contradicting", "neutral", *six("support_score", "confidence"))


@R.query("a27_cluster_support", f"WITH {LINKS} SELECT component_id AS cluster, count(*) AS paper_count, round(avg(relevance), 3) AS avg_score, count(*) FILTER (direction = 'supports') AS supporting, count(*) FILTER (direction = 'contradicts') AS contradicting, count(*) FILTER (direction NOT IN ('supports', 'contradicts')) AS neutral FROM links GROUP BY 1")
def _(spark, d):
    return S.cluster_support(links(spark, d).select(F.col("component_id").alias("cluster"), "direction", F.col("relevance").alias("score")))


@R.query("a27_caveats", f"""WITH {LINKS}, c AS (SELECT count(*) AS total_papers, count(DISTINCT component_id) AS cluster_count, count(*) FILTER (direction = 'supports') AS supporting, count(*) FILTER (direction = 'contradicts') AS contradicting, count(*) FILTER (direction NOT IN ('supports', 'contradicts')) AS neutral FROM links)
SELECT *, CASE WHEN total_papers = 0 THEN '{S.CAVEATS["none"]}|' ELSE '' END || CASE WHEN contradicting > 0 THEN contradicting || ' paper(s) were marked as contradicting or directionally opposed.|' ELSE '' END || CASE WHEN supporting > 0 AND neutral > supporting THEN '{S.CAVEATS["weak"]}|' ELSE '' END || '{S.CAVEATS["grades"]}' AS caveats FROM c""")
def _(spark, d):
    """Clusters are the components, designs of the papers are there, grades are not."""
    rows = links(spark, d).select(F.col("component_id").alias("cluster"), "direction", F.col("relevance").alias("score"))
    found = S.caveats(S.cluster_support(rows), methods=papers(spark, d).select(T.design(F.col("abstract"))[0].alias("design")))
    return found.withColumn("caveats", F.array_join("caveats", "|"))


@R.query("z08_embedding_text", f"""WITH {PAPERS}, w AS (SELECT ord, title, abstract, list_filter(string_split(title, ' '), lambda x: length(x) > 6) AS own, ['claimed ' || source] AS claimed, list_filter(string_split(source, '-'), lambda x: x <> '') AS mechanisms FROM papers)
SELECT ord, md5(array_to_string(list_filter(list_concat([title, abstract], CASE WHEN len(own) > 0 THEN own ELSE claimed END, mechanisms), lambda x: x IS NOT NULL AND x <> ''), ' ')) AS digest FROM w""")
def _(spark, d):
    """Long words of the title are a paper's findings; where it has none, its claim's are."""
    findings = F.filter(F.split("title", " "), lambda x: F.char_length(x) > 6)
    text = T.embedding_text(F.col("title"), F.col("abstract"), findings, F.split("source", "-"), F.array(F.concat(F.lit("claimed "), "source")))
    return papers(spark, d).select("ord", F.md5(text).alias("digest"))


@R.query("a07_w01_trends", f"""WITH {LINKS}, y AS (SELECT component_id, year, count(*) AS article_count, avg(relevance) AS avg_score, sum(citations) AS c FROM links WHERE year > 1900 GROUP BY ALL)
SELECT component_id, year, article_count, round(avg_score, 6) AS avg_score, CAST(sum(c) OVER (PARTITION BY component_id ORDER BY year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_citations FROM y""")
def _(spark, d):
    return S.trends(links(spark, d)).select("component_id", "year", "article_count", *six("avg_score"), "cumulative_citations")


@R.query("a08_component_weights", f"""WITH {LINKS}, m AS (SELECT component_id, avg(CAST(n_matched > 0 OR relevance > 0 AS DOUBLE)) AS coverage, avg(relevance) AS r, avg(confidence) AS c,
  (count(*) FILTER (direction = 'supports') - count(*) FILTER (direction = 'contradicts')) / CAST(count(*) AS DOUBLE) AS b FROM links GROUP BY component_id),
u AS (SELECT *, 0.45 * r + 0.35 * coverage + 0.2 * c + 0.3 * b - CASE WHEN b < 0 THEN 0.75 * abs(b) * coverage ELSE 0 END AS utility FROM m)
SELECT component_id, round(coverage, 6) AS coverage, round(utility, 6) AS utility, round(greatest(0.2, least(3.0, 0.5 + 1.5 * utility)), 3) AS weight FROM u""")
def _(spark, d):
    return S.component_weights(links(spark, d)).select("component_id", *six("coverage", "utility"), "weight")


@R.query("w06_top_evidence", f"""WITH {LINKS}, t AS (SELECT component_id, row_number() OVER (PARTITION BY component_id ORDER BY round(relevance, 9) DESC, ord) AS place, ord, relevance FROM links WHERE direction = 'tangential')
SELECT component_id, CAST(place AS INT) AS place, ord, round(relevance, 6) AS relevance FROM t WHERE place <= 5""")
def _(spark, d):
    rows = links(spark, d).withColumn("relevance", F.round("relevance", 9))
    return S.top_evidence(rows, "tangential", 5).select("component_id", "place", "ord", *six("relevance"))


@R.query("t05_key_excerpts", f"""WITH {PAPERS}, s AS (SELECT ord, unnest(regexp_split_to_array(abstract, '[.!?]+')) AS sentence, generate_subscripts(regexp_split_to_array(abstract, '[.!?]+'), 1) AS pos FROM papers),
t AS (SELECT ord, pos, trim(sentence) AS sentence, trim(regexp_replace(lower(sentence), '\\s+', ' ', 'g')) AS norm FROM s),
h AS (SELECT *, CAST((length(norm) - length(replace(norm, 'the', ''))) / 3 AS INT) + CAST((length(norm) - length(replace(norm, 'que', ''))) / 3 AS INT) AS hits FROM t WHERE length(sentence) >= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY hits DESC, pos) AS place FROM h WHERE hits > 0)
SELECT ord, CAST(place AS INT) AS place, hits, length(sentence) AS n FROM r WHERE place <= 3""")
def _(spark, d):
    return S.excerpts(papers(spark, d), ["the", "que"]).select("ord", "place", "hits", F.length("sentence").alias("n"))


@R.query("p07_abstract_present", f"WITH {PAPERS} SELECT ord, year FROM papers WHERE abstract IS NOT NULL AND abstract <> ''")
def _(spark, d):
    return papers(spark, d).where(~T.falsy(F.col("abstract"))).select("ord", "year")


@R.query("p09_text_selection", f"WITH {PAPERS} SELECT ord, CASE WHEN length(abstract) > 1000 THEN 'full_text' ELSE 'abstract' END AS text_source, length(CASE WHEN length(abstract) > 1000 THEN substr(abstract, 1, 18000) ELSE substr(abstract, 1, 8000) END) AS used FROM papers")
def _(spark, d):
    full = F.length("abstract") > 1000
    return papers(spark, d).select("ord", F.when(full, "full_text").otherwise("abstract").alias("text_source"), F.length(F.when(full, F.substring("abstract", 1, 18000)).otherwise(F.substring("abstract", 1, 8000))).alias("used"))


@R.query("p16_triage_bundle", f"WITH {PAPERS} SELECT ord, md5(concat_ws(chr(10), nullif(title, ''), nullif(substr(abstract, 1, 1000), ''))) AS bundle FROM papers")
def _(spark, d):
    return papers(spark, d).select("ord", F.md5(F.array_join(F.filter(F.array("title", F.substring("abstract", 1, 1000)), lambda x: x != ""), "\n")).alias("bundle"))


@R.query("p03_doi_normal", "SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '^https://doi\\.org/', ''), '^http://doi\\.org/', ''), '^doi:', '')), '') AS doi FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' https://doi.org/10.1/A' || doc_id WHEN 1 THEN 'doi:10.1/b' || doc_id WHEN 2 THEN 'HTTP://DOI.ORG/10.2/X' ELSE '' END AS raw FROM documents)")
def _(spark, d):
    i = F.col("doc_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit(" https://doi.org/10.1/A"), i)).when(i % 4 == 1, F.concat(F.lit("doi:10.1/b"), i)).when(i % 4 == 2, "HTTP://DOI.ORG/10.2/X").otherwise("")
    return table(spark, d, "documents").select("doc_id", T.doi(raw).alias("doi"))


@R.query("p02_identifier_normal", "SELECT doc_id, list_extract(string_split(rtrim(url, '/'), '/'), -1) AS last_segment, CASE WHEN starts_with(upper(raw), 'PMC') THEN upper(raw) ELSE 'PMC' || raw END AS pmcid FROM (SELECT doc_id, 'https://openalex.org/W' || doc_id || '/' AS url, CASE WHEN doc_id % 2 = 0 THEN 'pmc' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS raw FROM documents)")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("https://openalex.org/W"), "doc_id", F.lit("/")).alias("url"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("pmc"), "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("raw"))
    return rows.select("doc_id", F.element_at(F.split(F.rtrim("url", F.lit("/")), "/"), -1).alias("last_segment"), F.when(F.upper("raw").startswith("PMC"), F.upper("raw")).otherwise(F.concat(F.lit("PMC"), "raw")).alias("pmcid"))


@R.query("p04_year_parse", "SELECT o_orderkey, CAST(regexp_extract(trim(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)), '^(\\d{4})', 1) AS INT) AS year FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.year(F.col("o_orderdate").cast("date").cast("string")).alias("year"))


@R.query("p06_inverted_index_text", "SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' ')) AS abstract FROM documents WHERE regexp_matches(text, '\\S')")
def _(spark, d):
    """Word positions as an inverted index of each record, then the text again, by position."""
    w = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    index = w.select("doc_id", F.posexplode("w").alias("pos", "word")).groupBy("doc_id", "word").agg(F.collect_list("pos").alias("positions"))
    back = index.select("doc_id", "word", F.explode("positions").alias("pos")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("x"))
    return back.select("doc_id", F.md5(F.array_join(F.transform("x", lambda s: s["word"]), " ")).alias("abstract"))


@R.query("f07_slug", f"WITH {PAPERS} SELECT ord, trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM papers")
def _(spark, d):
    return papers(spark, d).select("ord", T.slug(F.col("title")).alias("slug"))


@R.query("f13_title_words", f"WITH {PAPERS} SELECT ord, len(list_distinct(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda w: w <> ''))) AS n FROM papers")
def _(spark, d):
    return papers(spark, d).select("ord", F.size(T.word_set(F.col("title"))).alias("n"))


@R.query("f15_token_jaccard", "SELECT c.conv_id, c.turn, round(len(list_intersect(x, y)) / CAST(greatest(len(x) + len(y) - len(list_intersect(x, y)), 1) AS DOUBLE), 6) AS token_jaccard FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}')) AS x, list_distinct(regexp_extract_all(lower(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text), '')), '[a-z]{2,}')) AS y FROM conversations) c")
def _(spark, d):
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")), F.lit(""))
    rows = table(spark, d, "conversations").withColumn("before", before)
    sets = rows.select("conv_id", "turn", T.token_set(F.col("text"), "[a-z]{2,}").alias("x"), T.token_set(F.col("before"), "[a-z]{2,}").alias("y"))
    return sets.select("conv_id", "turn", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("token_jaccard"))


@R.query("f22_quote_spans", f"""WITH {PAPERS}, q AS (SELECT ord, abstract, CASE ord % 4 WHEN 0 THEN substr(abstract, 5, 30) WHEN 1 THEN upper(substr(abstract, 3, 12)) WHEN 2 THEN replace(substr(abstract, 1, 25), ' ', '  ') ELSE 'zzzz not there' END AS quote FROM papers),
p AS (SELECT ord, CASE WHEN trim(quote) = '' THEN 'empty' WHEN strpos(abstract, quote) > 0 THEN 'exact' WHEN strpos(lower(abstract), lower(quote)) > 0 THEN 'case_insensitive'
  WHEN contains(trim(regexp_replace(lower(abstract), '\\s+', ' ', 'g')), trim(regexp_replace(lower(quote), '\\s+', ' ', 'g'))) THEN 'whitespace_normalized' ELSE 'not_found' END AS reason, strpos(abstract, quote) - 1 AS e, strpos(lower(abstract), lower(quote)) - 1 AS l FROM q)
SELECT ord, reason, CAST(CASE reason WHEN 'exact' THEN e WHEN 'case_insensitive' THEN l ELSE -1 END AS INT) AS start FROM p""")
def _(spark, d):
    i = F.col("ord") % 4
    quote = F.when(i == 0, F.substring("abstract", 5, 30)).when(i == 1, T.upper(F.substring("abstract", 3, 12))).when(i == 2, F.replace(F.substring("abstract", 1, 25), F.lit(" "), F.lit("  "))).otherwise("zzzz not there")
    rows = papers(spark, d).withColumn("quote", quote)
    reason, start = T.quote_check(F.col("quote"), F.col("abstract"))
    return rows.withColumn("reason", reason).select("ord", "reason", start.alias("start"))


@R.query("f22_partial_quotes", f"""WITH {PAPERS}, n AS (SELECT ord, trim(regexp_replace(lower(abstract), '\\s+', ' ', 'g')) AS t FROM papers), q AS (SELECT ord, t, list_concat(string_split(t, ' ')[2:7], ['zzza', 'zzzb', 'zzzc', 'zzzd', 'zzze'][1:ord % 6]) AS w FROM n),
k AS (SELECT ord, len(w) AS n, list_max(list_filter(range(greatest(len(w) // 2, 3), greatest(len(w), 3) + 1), lambda i: contains(t, array_to_string(w[1:i], ' ')))) AS k, contains(t, array_to_string(w, ' ')) AS whole FROM q WHERE len(w) > 0)
SELECT ord, CASE WHEN whole THEN 'exact' WHEN n >= 4 AND k IS NOT NULL THEN 'partial_match (' || k || '/' || n || ' words)' ELSE 'not_found' END AS reason FROM k""")
def _(spark, d):
    """Six words of each text, in lower case, with up to five foreign ones behind them, against the text in its normal form."""
    rows = papers(spark, d).select("ord", T.normal(F.col("abstract")).alias("t"))
    foreign = F.slice(F.array(*(F.lit(f"zzz{c}") for c in "abcde")), F.lit(1), (F.col("ord") % 6).cast("int"))
    rows = rows.withColumn("quote", F.array_join(F.concat(F.slice(F.split("t", " "), 2, 6), foreign), " ")).where("quote <> ''")
    return rows.select("ord", T.quote_check(F.col("quote"), F.col("t"))[0].alias("reason"))


def _design_sql() -> str:
    cases = []
    for name, _, every, some in T.DESIGNS:
        parts = [f"contains(low, '{w}')" for w in every] + (["(" + " OR ".join(f"contains(low, '{w}')" for w in some) + ")"] if some else [])
        cases.append((" AND ".join(parts), name))
    sure = {n: c for n, c, _, _ in T.DESIGNS}
    return f"SELECT ord, CASE {' '.join(f'WHEN {c} THEN {n!r}' for c, n in cases)} ELSE 'unknown' END AS design, CAST(CASE {' '.join(f'WHEN {c} THEN {sure[n]}' for c, n in cases)} ELSE 0.1 END AS DOUBLE) AS confidence FROM (SELECT ord, lower(abstract || ' ' || title) AS low FROM papers)"


@R.query("f23_study_design", f"WITH {PAPERS} {_design_sql()}")
def _(spark, d):
    kind, sure = T.design(F.concat_ws(" ", "abstract", "title"))
    return papers(spark, d).select("ord", kind.alias("design"), sure.alias("confidence"))


@R.query("a09_design_summary", f"WITH {PAPERS}, x AS ({_design_sql()}) SELECT design, count(*) AS n, round(100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 1) AS pct FROM x GROUP BY design")
def _(spark, d):
    kind, _ = T.design(F.concat_ws(" ", "abstract", "title"))
    rows = papers(spark, d).groupBy(kind.alias("design")).agg(F.count("*").alias("n"))
    return rows.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


@R.query("f31_triage_terms", f"WITH {PAPERS} SELECT ord, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct FROM (SELECT ord, list_filter(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9_/-]+'), lambda x: length(x) >= 3 AND NOT list_contains({T.STOP_WORDS!r}, x)) AS t FROM papers)")
def _(spark, d):
    rows = papers(spark, d).withColumn("t", T.triage_terms(F.col("title")))
    return rows.select("ord", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"))


@R.query("f35_uid", f"WITH {PAPERS} SELECT ord, substr(sha256(CASE WHEN ord % 3 = 0 THEN 'doi:10.1/' || ord WHEN ord % 3 = 1 THEN 'pmid:' || ord ELSE 'title:' || lower(trim(title)) || '|' || year END), 1, 32) AS uid FROM papers")
def _(spark, d):
    i = F.col("ord")
    doi, pmid = F.when(i % 3 == 0, F.concat(F.lit("10.1/"), i)), F.when(i % 3 == 1, i.cast("string"))
    return papers(spark, d).select("ord", T.uid(doi, pmid, F.col("title"), F.col("year")).alias("uid"))


@R.query("f36_safe_name", "SELECT page_id, substr(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), 1, 120) AS name FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@R.query("e07_token_overlap", f"""WITH {PAPERS}, f AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in FAMILIES)}) v(family, q)),
tok AS (SELECT ord, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9_/-]+'), lambda x: length(x) >= 3 AND NOT list_contains({T.STOP_WORDS!r}, x))) AS t FROM papers),
ft AS (SELECT family, list_distinct(list_filter(regexp_extract_all(lower(q), '[a-z0-9][a-z0-9_/-]+'), lambda x: length(x) >= 3 AND NOT list_contains({T.STOP_WORDS!r}, x))) AS g FROM f),
n AS (SELECT ord, family, len(list_intersect(t, g)) AS n, len(t) AS a, len(g) AS b FROM tok, ft)
SELECT ord, family, round(CASE WHEN n = 0 THEN 0.0 ELSE 0.7 * n / b + 0.3 * n / (a + b - n) END, 6) AS overlap FROM n""")
def _(spark, d):
    rows = papers(spark, d).select("ord", F.array_distinct(T.triage_terms(F.col("title"))).alias("t"))
    each = [F.struct(F.lit(f).alias("family"), F.array_distinct(T.triage_terms(F.lit(q))).alias("g")) for f, q in FAMILIES]
    rows = rows.withColumn("f", F.explode(F.array(*each)))
    return rows.select("ord", "f.family", F.round(S.token_overlap(F.col("t"), F.col("f.g")), 6).alias("overlap"))


_TERMS = f"list_filter(regexp_extract_all(lower(t), '[a-z0-9][a-z0-9_/-]+'), lambda x: length(x) >= 3 AND NOT list_contains({T.STOP_WORDS!r}, x))"


@R.query("e06_tfidf_similarity", f"""WITH raw AS (SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, text AS t FROM documents UNION ALL SELECT 'q', CAST(item_id AS VARCHAR), text FROM benchmark),
tok AS (SELECT side, id, {_TERMS} AS w FROM raw),
terms AS (SELECT side, id, unnest(w) AS term FROM tok UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS i FROM tok)),
c AS (SELECT side, id, term, count(*) AS n FROM terms GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
w AS (SELECT side, id, term, (1 + ln(n)) * (ln((1.0 + (SELECT count(*) FROM raw)) / (1.0 + df)) + 1) AS w FROM c JOIN df USING (term)),
norm AS (SELECT side, id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dot AS (SELECT a.id AS doc, b.id AS query, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.term = b.term AND a.side = 'd' AND b.side = 'q' GROUP BY ALL),
s AS (SELECT doc, query, round(least(1.0, dot / (x.norm * y.norm)), 6) AS tfidf FROM dot JOIN norm x ON x.side = 'd' AND x.id = doc JOIN norm y ON y.side = 'q' AND y.id = query)
SELECT doc, query, tfidf FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY tfidf DESC, query) AS rn FROM s) WHERE rn <= 3""")
def _(spark, d):
    """The three best queries of every document: a top-k report."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return S.tfidf_similarity(docs, queries, best=3).withColumn("tfidf", F.round("tfidf", 6))


@R.query("e10_triage_band", f"""WITH {PAPERS}, s AS (SELECT ord, CAST(citations % 101 AS DOUBLE) / 100 AS c FROM papers)
SELECT ord, CASE WHEN c >= 0.5 THEN 'high' WHEN c >= 0.28 THEN 'medium' ELSE 'low' END AS band, CASE WHEN c >= 0.5 THEN 1 WHEN c >= 0.28 THEN 2 ELSE 3 END AS tier FROM s""")
def _(spark, d):
    name, tier = S.band((F.col("citations") % 101).cast("double") / 100)
    return papers(spark, d).select("ord", name.alias("band"), tier.alias("tier"))


@R.query("e12_overlap_and_tier", """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 12.5 AS c, CAST(l_partkey % 100 AS DOUBLE) / 100 AS e, CAST(l_suppkey % 10 AS DOUBLE) / 10 AS i, CAST(l_orderkey % 10 AS DOUBLE) / 10 AS f FROM lineitem),
n AS (SELECT *, CAST(a >= 0.35 AS INT) + CAST(b >= 0.35 AS INT) + CAST(c >= 0.35 AS INT) + CAST(e >= 0.35 AS INT) AS n, CAST(a >= 0.55 AS INT) + CAST(b >= 0.55 AS INT) + CAST(c >= 0.55 AS INT) + CAST(e >= 0.55 AS INT) AS s FROM s)
SELECT l_orderkey, l_linenumber, n || '-way' AS bucket, n AS axes, CASE WHEN s >= 3 AND i >= 0.5 AND f >= 0.45 THEN 1 WHEN f >= 0.3 THEN 2 ELSE 3 END AS tier FROM n""")
def _(spark, d):
    x = table(spark, d, "lineitem")
    axes = [F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12.5, (F.col("l_partkey") % 100).cast("double") / 100]
    bucket, n, tier = S.overlap_and_tier(axes, (F.col("l_suppkey") % 10).cast("double") / 10, (F.col("l_orderkey") % 10).cast("double") / 10)
    return x.select("l_orderkey", "l_linenumber", bucket.alias("bucket"), n.alias("axes"), tier.alias("tier"))


@R.query("e08_embedding_cosine", """WITH q AS (SELECT label, list_transform(range(1, 65), lambda i: 0) AS z FROM embeddings LIMIT 0), c AS (SELECT label, min(vec_id) AS hub FROM embeddings GROUP BY label),
p AS (SELECT e.vec_id, e.label, e.embedding AS a, h.embedding AS b FROM embeddings e JOIN c USING (label) JOIN embeddings h ON h.vec_id = c.hub)
SELECT vec_id, label, round(greatest(0.0, least(1.0, list_sum(list_transform(list_zip(a, b), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b, lambda x: CAST(x AS DOUBLE) * x)))))), 5) AS similarity FROM p""")
def _(spark, d):
    """Each vector against the first of its topic, as cosine clamped to 0..1."""
    e = table(spark, d, "embeddings")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    hub = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("b"))
    cosine = dot("embedding", "b") / (F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("b", "b")))
    return e.join(F.broadcast(hub), "label").select("vec_id", "label", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)), 5).alias("similarity"))


@R.query("e10_cheap_triage", f"""WITH f AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(FAMILIES))}) v(place, family, q)),
raw AS (SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, text AS t FROM documents UNION ALL SELECT 'q', family, q FROM f),
tok AS (SELECT side, id, {_TERMS} AS w FROM raw),
terms AS (SELECT side, id, unnest(w) AS term FROM tok UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS i FROM tok)),
c AS (SELECT side, id, term, count(*) AS n FROM terms GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
w AS (SELECT side, id, term, (1 + ln(n)) * (ln((1.0 + (SELECT count(*) FROM raw)) / (1.0 + df)) + 1) AS w FROM c JOIN df USING (term)),
norm AS (SELECT side, id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dot AS (SELECT a.id AS doc, b.id AS query, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.term = b.term AND a.side = 'd' AND b.side = 'q' GROUP BY ALL),
sim AS (SELECT doc, query, least(1.0, dot / (x.norm * y.norm)) AS tfidf FROM dot JOIN norm x ON x.side = 'd' AND x.id = doc JOIN norm y ON y.side = 'q' AND y.id = query),
sets AS (SELECT side, id, list_distinct(w) AS w FROM tok),
o AS (SELECT d.id AS doc, q.id AS query, len(list_intersect(d.w, q.w)) AS n, len(d.w) AS a, len(q.w) AS b FROM sets d, sets q WHERE d.side = 'd' AND q.side = 'q'),
p AS (SELECT CAST(o.doc AS BIGINT) AS doc_id, o.query AS family, f.place, round(round(coalesce(tfidf, 0), 9), 4) AS tfidf, round(round(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE 0.7::DOUBLE * n / b + 0.3::DOUBLE * n / (a + b - n) END, 9), 4) AS token_overlap, CAST((lang = 'en' AND o.query = 'f1') OR (lang IN ('fr', 'es') AND o.query = 'f2') OR (lang = 'de' AND o.query = 'f3') AS INT)::DOUBLE AS retrieval_hit
  FROM o JOIN f ON f.family = o.query JOIN documents ON CAST(documents.doc_id AS VARCHAR) = o.doc LEFT JOIN sim ON sim.doc = o.doc AND sim.query = o.query),
r AS (SELECT *, round(round((0.35::DOUBLE * tfidf + 0.15::DOUBLE * token_overlap + 0.05::DOUBLE * retrieval_hit) / 0.55::DOUBLE, 9), 4) AS composite FROM p)
SELECT doc_id, family, tfidf, token_overlap, retrieval_hit, composite, CASE WHEN composite >= 0.5 THEN 'high' WHEN composite >= 0.28 THEN 'medium' ELSE 'low' END AS band, CASE WHEN composite >= 0.5 THEN 1 WHEN composite >= 0.28 THEN 2 ELSE 3 END AS tier FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY composite DESC, place) = 1""")
def _(spark, d):
    """Whole texts against the query families, a language standing for the family that retrieved a document; without a semantic model."""
    hit = F.when(F.col("lang") == "en", "f1").when(F.col("lang").isin("fr", "es"), "f2").when(F.col("lang") == "de", "f3")
    docs = table(spark, d, "documents").select("doc_id", "text", F.array_compact(F.array(hit)).alias("hits"))
    return S.cheap_triage(docs, FAMILIES, "doc_id").drop("semantic")


@R.query("f19_span_audit", """WITH s AS (SELECT doc_id, unnest([{'field': 'key_quote', 'span': array_to_string(string_split(text, ' ')[3:12], ' ')}, {'field': 'relevance_quote', 'span': substr(text, 1, length(text) // 2) || ' evidence added here'}], recursive := true), text FROM documents),
g AS (SELECT * FROM s WHERE span <> '' AND text <> ''),
t AS (SELECT doc_id, field, term, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 2) AS b FROM (SELECT doc_id, field, unnest(regexp_extract_all(lower(span), '[\\p{L}\\p{N}_]{2,}')) AS term, 1 AS side FROM g UNION ALL SELECT doc_id, field, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')), 2 FROM g) GROUP BY ALL),
w AS (SELECT doc_id, field, a * i AS x, b * i AS y FROM (SELECT *, CASE WHEN a > 0 AND b > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1 END AS i FROM t)),
c AS (SELECT doc_id, field, sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0) AS cosine FROM w GROUP BY ALL),
j AS (SELECT doc_id, field, span, text, list_distinct(regexp_extract_all(lower(span), '[a-z]{2,}')) AS p, list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}')) AS q FROM g),
k AS (SELECT doc_id, field, CASE WHEN len(p) + len(q) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(p, q))::DOUBLE / (len(p) + len(q) - len(list_intersect(p, q))) END AS token, trim(span) = '' OR trim(text) = '' AS blank FROM j),
r AS (SELECT doc_id, field, token, CASE WHEN blank THEN token ELSE coalesce(cosine, 0) END AS tfidf FROM k LEFT JOIN c USING (doc_id, field))
SELECT doc_id, field, round(token, 6) AS token_similarity, round(tfidf, 6) AS tfidf_similarity, round(0.5 * token + 0.5 * tfidf, 6) AS composite, CASE WHEN token < 0.3 OR 0.5 * token + 0.5 * tfidf < 0.35 THEN 'P1' WHEN 0.5 * token + 0.5 * tfidf < 0.55 THEN 'P2' ELSE 'P3' END AS priority FROM r""")
def _(spark, d):
    """Two quotes of each document against its whole text, one of few words and one of half the text with words put behind it."""
    half = F.concat(F.substring("text", F.lit(1), F.floor(F.char_length("text") / 2).cast("int")), F.lit(" evidence added here"))
    quotes = {"key_quote": F.array_join(F.slice(F.split("text", " "), 3, 10), " "), "relevance_quote": half}
    rows = table(spark, d, "documents").select("doc_id", "text", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), q.alias("span")) for n, q in quotes.items()))).alias("s")).select("doc_id", "text", "s.*")
    return S.audit_spans(rows, ["doc_id", "field"], "span", "text").select("doc_id", "field", *six("token_similarity", "tfidf_similarity", "composite"), "priority")


@R.query("e11_pass3_selection", f"""WITH {PAPERS}, b AS (SELECT ord, CASE WHEN citations % 101 >= 50 THEN 'high' WHEN citations % 101 >= 28 THEN 'medium' ELSE 'low' END AS band FROM papers),
l AS (SELECT ord, row_number() OVER (ORDER BY md5('42:' || ord), ord) AS rn, count(*) OVER () AS n FROM b WHERE band = 'low')
SELECT ord, 'band' AS reason FROM b WHERE band <> 'low' UNION ALL SELECT ord, 'sample' FROM l WHERE rn <= least(greatest(CAST(floor(n * 0.1) AS INT), 5), 25)""")
def _(spark, d):
    """High and medium bands, and of the low band a tenth, 5 to 25, by order of a seeded hash: a limited report by design."""
    name, _ = S.band((F.col("citations") % 101).cast("double") / 100)
    rows = papers(spark, d).select("ord", name.alias("band"))
    low = rows.where("band = 'low'")
    k = min(max(low.count() // 10, 5), 25)
    sample = low.orderBy(F.md5(F.concat(F.lit("42:"), "ord")), "ord").limit(k).select("ord", F.lit("sample").alias("reason"))
    return rows.where("band <> 'low'").select("ord", F.lit("band").alias("reason")).unionByName(sample)


@R.query("t01_snowball_seeds", f"WITH {PAPERS} SELECT ord, citations FROM papers WHERE title <> '' AND abstract <> '' ORDER BY citations DESC, year DESC, length(abstract) DESC, ord LIMIT 15")
def _(spark, d):
    return papers(spark, d).where("title <> '' AND abstract <> ''").orderBy(F.desc("citations"), F.desc("year"), F.desc(F.length("abstract")), "ord").limit(15).select("ord", "citations")


@R.query("p13_corpus_filter", f"WITH {PAPERS} SELECT ord FROM papers WHERE (contains(lower(title), 'tion') OR contains(CAST(year AS VARCHAR), '2011')) AND ord IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, d):
    rows = papers(spark, d).where(F.lower("title").contains("tion") | F.col("year").cast("string").contains("2011"))
    return rows.join(table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("ord")), "ord", "left_semi").select("ord")


@R.query("f27_conditions", f"WITH t AS (SELECT doc_id, lower(text) || CASE doc_id % 5 WHEN 0 THEN ' anxiety and depressive' WHEN 1 THEN ' epileptic seizures' WHEN 2 THEN ' adhd (attention deficit)' ELSE '' END AS low FROM documents) SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS conditions FROM (SELECT doc_id, list_sort(list_distinct(list_filter([{', '.join(f'''CASE WHEN contains(low, '{p}') THEN '{n}' END''' for p, n in T.CONDITIONS)}], lambda x: x IS NOT NULL))) AS list_distinct_ordered FROM t)")
def _(spark, d):
    i = F.col("doc_id") % 5
    more = F.when(i == 0, " anxiety and depressive").when(i == 1, " epileptic seizures").when(i == 2, " adhd (attention deficit)").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(T.conditions(F.concat("text", more))), "|").alias("conditions"))


@R.query("e13_tfidf_vectors", f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}) GROUP BY ALL),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY term ORDER BY total DESC, term LIMIT 5000), w AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM c JOIN v USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1)
SELECT doc_id, count(*) AS n_terms, round(max(w / n), 6) AS top_weight, round(sum(w / n), 4) AS total FROM w JOIN n USING (doc_id) GROUP BY 1""")
def _(spark, d):
    """What is to be known of each document's vector: its terms, its heaviest weight and the sum."""
    v = S.tfidf_vectors(table(spark, d, "documents"), "doc_id", "text", T.STOP_WORDS)
    return v.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("top_weight"), F.round(F.sum("weight"), 4).alias("total"))
