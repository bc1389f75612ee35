"""Keyword evidence of papers for hypothesis components, its alignment, trends and weights, and cheap triage by text similarity."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..tables import partitions, written


@dataclass(frozen=True)
class Component:
    id: str
    keywords: tuple[str, ...]
    weight: float = 1.0


def evidence_links(papers: DataFrame, components: list[Component]) -> DataFrame:
    """A row for each paper and component: ord, year, citations, component_id, n_matched, kw_score, cooc, dir_score, relevance, direction, confidence.

    Every keyword is counted once a paper, whatever the number of components; blank texts score 0 and are neutral."""
    keywords = sorted({k.lower() for c in components for k in c.keywords})
    norm = papers.withColumn("norm", T.normal(F.coalesce("abstract", F.lit(""))))
    hits = norm.select("ord", "year", "citations", F.array(*(T.occurrences(F.col("norm"), k) for k in keywords)).alias("hits"), T.words(F.col("norm")).alias("n_words"), *(c.alias(name) for c, name in zip(T.stances(F.col("norm")), ("s", "n"), strict=True)))
    hits = hits.select("ord", "year", "citations", "hits", "n_words", T.direction(F.col("s"), F.col("n")).alias("dir_score"))
    at = {k: i for i, k in enumerate(keywords)}

    def entry(c: Component) -> Column:
        own = [F.col("hits")[at[k.lower()]] for k in c.keywords]
        other = [F.col("hits")[at[k.lower()]] for o in components if o.id != c.id for k in o.keywords]
        matched = lambda xs: sum(((x > 0).cast("int") for x in xs), F.lit(0))
        cooc = F.when((matched(own) > 0) & (matched(other) > 0), F.least(matched(own), matched(other)) / max(len(own), len(other), 1)).otherwise(0.0)
        return F.struct(F.lit(c.id).alias("component_id"), matched(own).alias("n_matched"), (matched(own) / max(len(own), 1)).alias("coverage"), sum(own, F.lit(0)).alias("n_hits"), cooc.alias("cooc"))

    rows = hits.withColumn("c", F.explode(F.array(*(entry(c) for c in components)))).select("ord", "year", "citations", "n_words", "dir_score", "c.*")
    rows = rows.withColumn("kw_score", T.keyword_score(F.col("coverage"), F.col("n_hits"), F.col("n_words")))
    rows = rows.withColumn("relevance", F.when(F.col("n_words") == 0, 0.0).otherwise(0.5 * F.col("kw_score") + 0.3 * F.col("cooc") + 0.2 * F.abs("dir_score")))
    way = F.when(F.col("relevance") < 0.1, "neutral").when(F.col("dir_score") > 0.2, "supports").when(F.col("dir_score") < -0.2, "contradicts").otherwise("tangential")
    return rows.withColumns({"direction": way, "confidence": F.least(F.col("kw_score") + F.col("cooc"), F.lit(1.0))}).drop("coverage", "n_hits")


def alignment(links: DataFrame) -> DataFrame:
    """Per component: evidence_count, supporting, contradicting, neutral, support_score, confidence."""
    n = lambda way: F.count_if(F.col("direction") == way)
    rows = links.groupBy("component_id").agg(F.count("*").alias("evidence_count"), n("supports").alias("supporting"), n("contradicts").alias("contradicting"), F.avg("confidence").alias("confidence"))
    return rows.withColumns({"neutral": F.col("evidence_count") - F.col("supporting") - F.col("contradicting"), "support_score": (F.col("supporting") - F.col("contradicting")) / F.col("evidence_count")})


#: What is said about a body of evidence, and when.
CAVEATS = {
    "none": "No papers were available for deterministic provenance.",
    "against": "%d paper(s) were marked as contradicting or directionally opposed.",
    "weak": "Neutral or weakly directional evidence outnumbers direct support.",
    "methods": "Method validation output was not available for study-design weighting.",
    "grades": "GRADE output was not available when this explanation was generated.",
}


def cluster_support(papers: DataFrame) -> DataFrame:
    """Per cluster: paper_count, avg_score (three places), supporting, contradicting and neutral of papers (cluster, direction, score); a score or direction that is null counts as 0 and as neutral."""
    n = lambda way: F.count_if(F.col("direction") == way)
    rows = papers.groupBy("cluster").agg(F.count("*").alias("paper_count"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 3).alias("avg_score"), n("supports").alias("supporting"), n("contradicts").alias("contradicting"))
    return rows.withColumn("neutral", F.col("paper_count") - F.col("supporting") - F.col("contradicting"))


def caveats(clusters: DataFrame, methods: DataFrame | None = None, grades: DataFrame | None = None) -> DataFrame:
    """One row over what `cluster_support` gives: total_papers, cluster_count, supporting, contradicting, neutral, caveats (an array, in the order of CAVEATS). methods and grades count as there if they have a row."""
    total = clusters.agg(F.coalesce(F.sum("paper_count"), F.lit(0)).alias("total_papers"), F.count("*").alias("cluster_count"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("supporting", "contradicting", "neutral")))
    lacks = {name: df is None or df.isEmpty() for name, df in (("methods", methods), ("grades", grades))}
    when = {
        "none": F.when(F.col("total_papers") == 0, CAVEATS["none"]),
        "against": F.when(F.col("contradicting") > 0, F.format_string(CAVEATS["against"], "contradicting")),
        "weak": F.when((F.col("supporting") > 0) & (F.col("neutral") > F.col("supporting")), CAVEATS["weak"]),
    } | {name: F.when(F.lit(lack), CAVEATS[name]) for name, lack in lacks.items()}
    return total.withColumn("caveats", F.array_compact(F.array(*when.values())))


def top_evidence(links: DataFrame, way: str, k: int) -> DataFrame:
    """The k most relevant links of a direction for each component, ties by order of input."""
    place = F.row_number().over(Window.partitionBy("component_id").orderBy(F.desc("relevance"), "ord"))
    return links.where(F.col("direction") == way).withColumn("place", place).where(F.col("place") <= k).select("component_id", "place", "ord", "relevance")


def trends(links: DataFrame) -> DataFrame:
    """Per component and year after 1900: article_count, avg_score, citations of that and all earlier years."""
    rows = links.where("year > 1900").groupBy("component_id", "year").agg(F.count("*").alias("article_count"), F.avg("relevance").alias("avg_score"), F.sum("citations").alias("c"))
    running = Window.partitionBy("component_id").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cumulative_citations", F.sum("c").over(running)).drop("c")


def component_weights(links: DataFrame, least: float = 0.2, most: float = 3.0) -> DataFrame:
    rows = links.groupBy("component_id").agg(
        F.avg(((F.col("n_matched") > 0) | (F.col("relevance") > 0)).cast("double")).alias("coverage"),
        F.avg("relevance").alias("mean_relevance"),
        F.avg("confidence").alias("mean_confidence"),
        ((F.count_if(F.col("direction") == "supports") - F.count_if(F.col("direction") == "contradicts")) / F.count("*")).alias("balance"),
    )
    utility = 0.45 * F.col("mean_relevance") + 0.35 * F.col("coverage") + 0.2 * F.col("mean_confidence") + 0.3 * F.col("balance")
    utility = utility - F.when(F.col("balance") < 0, 0.75 * F.abs("balance") * F.col("coverage")).otherwise(0.0)
    rows = rows.withColumn("utility", utility)
    return rows.withColumn("weight", F.round(F.greatest(F.lit(least), F.least(F.lit(most), 0.5 + 1.5 * F.col("utility"))), 3))


def excerpts(papers: DataFrame, keywords: list[str], k: int = 3) -> DataFrame:
    """The k sentences of 20 or more characters with most keyword hits, for each paper, ties by place."""
    s = papers.select("ord", F.posexplode(F.split("abstract", "[.!?]+")).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence"))
    hits = sum((T.occurrences(T.normal(F.col("sentence")), w.lower()) for w in keywords), F.lit(0))
    place = F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("hits"), "pos"))
    return s.where(F.length("sentence") >= 20).withColumn("hits", hits).where("hits > 0").withColumn("place", place).where(F.col("place") <= k).select("ord", "place", "hits", "sentence")


def tfidf_similarity(docs: DataFrame, queries: DataFrame, id_col: str = "ord", best: int | None = None) -> DataFrame:
    """(doc, query, tfidf): cosine of every document with every query in which they share a term, or with its `best` ones: uni- and bigrams, idf over both, tf 1 + ln.

    Terms are counted in the task that holds the text (exploded outer, or Spark would find them twice). A term's weight needs its document frequency, so (text, term)
    counts are joined to it once; from there a text is one row with its length and its terms that queries have."""
    terms = lambda t: F.concat(t, F.when(F.size(t) > 1, F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))
    q_rows = queries.select(F.lit("q").alias("side"), F.col("query_id").cast("string").alias("id"), F.col("query_text").alias("text"))
    both = docs.select(F.lit("d").alias("side"), F.col(id_col).cast("string").alias("id"), "text").unionByName(q_rows)
    spark = docs.sparkSession
    dealt = both.repartition(partitions(spark, spark.sparkContext.defaultParallelism), "side", "id")  # texts are dealt out, not their terms
    counted = dealt.select("side", "id", F.explode_outer(terms(T.triage_terms(F.col("text")))).alias("term")).where("term IS NOT NULL").groupBy("side", "id", "term").count()
    total = both.count()
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    asked = q_rows.select(F.explode(terms(T.triage_terms(F.col("text")))).alias("term")).distinct().withColumn("asked", F.lit(True))
    weight = (1 + F.log(F.col("count"))) * (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1)
    w = counted.join(df.join(asked, "term", "left"), "term").select("side", "id", "term", "asked", weight.alias("w"))
    texts = w.groupBy("side", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("asked"), F.struct("term", "w"))).alias("x"))
    texts = written(texts.where(F.size("x") > 0), "tfidf")
    side = lambda s, name: texts.where(F.col("side") == s).select(F.col("id").alias(name), F.col("norm").alias(f"{name}_norm"), F.explode("x").alias("x")).select(name, f"{name}_norm", "x.term", F.col("x.w").alias(f"{name}_w"))
    dots = side("d", "doc").join(side("q", "query"), "term").groupBy("doc", "query").agg(F.sum(F.col("doc_w") * F.col("query_w")).alias("dot"), F.first("doc_norm").alias("x"), F.first("query_norm").alias("y"))
    rows = dots.select("doc", "query", F.least(F.lit(1.0), F.col("dot") / (F.col("x") * F.col("y"))).alias("tfidf"))
    if best is None:
        return rows
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc(F.round("tfidf", 6)), "query"))
    return rows.withColumn("_place", place).where(F.col("_place") <= best).drop("_place")


def tfidf_vectors(docs: DataFrame, id_col: str, text: str, stop_words: list[str], most: int = 5000) -> DataFrame:
    """(id_col, term, weight): each text as a vector of length 1 over the `most` commonest terms of all texts (ties by term), tf times ln((1 + n) / (1 + df)) + 1; words of two or more letters, digits or _, lower case, without stop words.

    Texts without such a term have no rows; the vocabulary is bounded by `most`, so it may be broadcast."""
    spark = docs.sparkSession
    dealt = docs.select(id_col, text).where(F.col(text).isNotNull()).repartition(partitions(spark, spark.sparkContext.defaultParallelism), id_col)
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    counted = dealt.select(id_col, F.explode_outer(words).alias("term")).where(~F.col("term").isin(stop_words)).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    n = docs.count()
    vocabulary = counted.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(most)
    weight = F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)
    w = counted.join(F.broadcast(vocabulary.select("term", "df")), "term").select(id_col, "term", weight.alias("w"))
    length = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return w.join(length, id_col).select(id_col, "term", (F.col("w") / F.col("length")).alias("weight"))


def token_overlap(doc_tokens: Column, query_tokens: Column) -> Column:
    """0.7 of the query's recall and 0.3 of Jaccard, over sets."""
    n = F.size(F.array_intersect(doc_tokens, query_tokens))
    either = F.size(doc_tokens) + F.size(query_tokens) - n
    return F.when(n == 0, 0.0).otherwise(0.7 * n / F.size(query_tokens) + 0.3 * n / either)


def band(composite: Column, high: float = 0.5, medium: float = 0.28) -> tuple[Column, Column]:
    pick = lambda a, b, c: F.when(composite >= high, a).when(composite >= medium, b).otherwise(c)
    return pick("high", "medium", "low"), pick(1, 2, 3)


#: Weights of the parts of the triage composite.
TRIAGE_WEIGHTS = {"semantic": 0.45, "tfidf": 0.35, "token_overlap": 0.15, "retrieval_hit": 0.05}


def cheap_triage(docs: DataFrame, families: list[tuple[str, str]], id_col: str = "ord", semantic: DataFrame | None = None, weights: dict[str, float] = TRIAGE_WEIGHTS, high: float = 0.5, medium: float = 0.28) -> DataFrame:
    """id_col, family, tfidf, token_overlap, retrieval_hit, semantic, composite, band, tier: each document's best query family (ties to the earlier one) and the scores with it, to four places.

    docs: id_col (unique), text, hits (ids of families that have retrieved it; null as none). families: (id, query text).
    semantic, if there is a model, gives (id_col, family, semantic) from 0 to 1; without it the other weights are scaled
    up to 1. A null or empty text has no terms and scores by its hits alone."""
    spark = docs.sparkSession
    rounded = lambda c: F.round(F.round(F.coalesce(c, F.lit(0.0)), 9), 4)  # noqa: E731  first what sums leave behind the ninth place
    terms = F.array_distinct(T.triage_terms(F.coalesce("text", F.lit(""))))
    each = [F.struct(F.lit(i).alias("place"), F.lit(f).alias("family"), F.array_distinct(T.triage_terms(F.lit(q))).alias("terms")) for i, (f, q) in enumerate(families)]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce("hits", F.array().cast("array<string>")).alias("_hits"), terms.alias("_terms")).withColumn("f", F.explode(F.array(*each)))
    rows = rows.select("_id", F.col("f.place").alias("_place"), F.col("f.family").alias("family"), rounded(token_overlap(F.col("_terms"), F.col("f.terms"))).alias("token_overlap"), F.array_contains("_hits", F.col("f.family")).cast("double").alias("retrieval_hit"))
    asked = spark.createDataFrame(families, "query_id string, query_text string")
    cosine = tfidf_similarity(docs.select(id_col, F.coalesce("text", F.lit("")).alias("text")), asked, id_col).select(F.col("doc").alias("_doc"), F.col("query").alias("family"), "tfidf")
    rows = rows.withColumn("_doc", F.col("_id").cast("string")).join(cosine, ["_doc", "family"], "left").drop("_doc").withColumn("tfidf", rounded(F.col("tfidf")))
    used = dict(weights)
    if semantic is None:
        rows, used["semantic"] = rows.withColumn("semantic", F.lit(0.0)), 0.0
    else:
        rows = rows.join(semantic.select(F.col(id_col).alias("_id"), "family", "semantic"), ["_id", "family"], "left").withColumn("semantic", rounded(F.col("semantic")))
    total = sum(used.values()) or 1.0
    composite = rounded(sum((w * F.col(name) for name, w in used.items()), F.lit(0.0)) / total)
    names = ["family", "semantic", "tfidf", "token_overlap", "retrieval_hit", "composite"]
    best = rows.withColumn("composite", composite).groupBy("_id").agg(F.max(F.struct("composite", (-F.col("_place")).alias("_first"), *(n for n in names if n != "composite"))).alias("best"))
    name, tier = band(F.col("composite"), high, medium)
    return best.select(F.col("_id").alias(id_col), *(F.col(f"best.{n}").alias(n) for n in names)).withColumns({"band": name, "tier": tier})


_LETTERS, _WORDS = re.compile("[a-z]{2,}"), re.compile(r"\w{2,}")


def _words_of(low: str) -> tuple[set[str], Counter]:
    return set(_LETTERS.findall(low)), Counter(_WORDS.findall(low))


def _jaccard(a: set[str], b: set[str]) -> float:
    n = len(a & b)
    return n / (len(a) + len(b) - n) if a or b else 0.0


def _two_text_cosine(a: Counter, b: Counter) -> float:
    """Cosine of the counts of two texts, with idf over the two alone: 1 for words of both, ln 1.5 + 1 for those of one."""
    both = a.keys() & b.keys()
    rare = (math.log(1.5) + 1) ** 2
    dot, x, y = sum(a[w] * b[w] for w in both), sum(a[w] ** 2 for w in both), sum(b[w] ** 2 for w in both)
    x, y = x + rare * (sum(n * n for n in a.values()) - x), y + rare * (sum(n * n for n in b.values()) - y)
    return dot / (math.sqrt(x) * math.sqrt(y)) if x and y else 0.0


def audit_spans(rows: DataFrame, keys: list[str], span: str, text: str, semantic: str | None = None) -> DataFrame:
    """keys, token_similarity, tfidf_similarity, semantic_similarity, composite, priority of quoted spans against the text they are said to come from.

    Token similarity is the Jaccard index of words of two or more of a-z, 0 if a side has none. TF-IDF similarity is the
    cosine over the two texts alone (words of two or more letters, digits or _); token similarity stands in for it where a side
    is blank. With a model's similarity (column `semantic`) the weights are 0.4, 0.3 and 0.3, else 0.5 for each of the others.
    Rows without a span or a text are left out; keys are unique. A row needs no other one, so nothing is shuffled."""
    given = rows.where((F.col(span) != "") & (F.col(text) != "")).select(*keys, (F.col(semantic) if semantic else F.lit(0.0)).cast("double").alias("semantic_similarity"), T.lower(F.col(span)).alias("_span"), T.lower(F.col(text)).alias("_text"), ((T.trimmed(F.col(span)) == "") | (T.trimmed(F.col(text)) == "")).alias("_blank"))
    kept = [*keys, "semantic_similarity"]
    schema = StructType([*(given.schema[c] for c in kept), *StructType.fromDDL("token_similarity double, tfidf_similarity double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, tfidf, last = [], [], None
            for s, t, blank in zip(*(b.column(c).to_pylist() for c in ("_span", "_text", "_blank")), strict=True):
                last = last if last and last[0] == t else (t, *_words_of(t))  # the spans of a text come one after the other
                words, counts = _words_of(s)
                token.append(_jaccard(words, last[1]))
                tfidf.append(token[-1] if blank else _two_text_cosine(counts, last[2]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(token, pa.float64()), pa.array(tfidf, pa.float64())], names=schema.names)

    token = given.mapInArrow(run, schema)
    c = 0.4 * F.col("semantic_similarity") + 0.3 * F.col("token_similarity") + 0.3 * F.col("tfidf_similarity") if semantic else 0.5 * F.col("token_similarity") + 0.5 * F.col("tfidf_similarity")
    token = token.withColumn("composite", c)
    weak = ((F.col("semantic_similarity") < 0.5) & (F.col("token_similarity") < 0.3)) | (F.col("composite") < 0.35)
    return token.select(*keys, "semantic_similarity", "token_similarity", "tfidf_similarity", "composite", F.when(weak, "P1").when(F.col("composite") < 0.55, "P2").otherwise("P3").alias("priority"))


def overlap_and_tier(axes: list[Column], integration: Column, confidence: Column, present: float = 0.35, strong: float = 0.55) -> tuple[Column, Column, Column]:
    """(bucket, axes present, tier): tier 1 needs three strong axes, integration 0.5 and confidence 0.45; tier 2 confidence 0.3."""
    n, s = (sum(((F.coalesce(a, F.lit(0.0)) >= t).cast("int") for a in axes), F.lit(0)) for t in (present, strong))
    tier = F.when((s >= 3) & (integration >= 0.5) & (confidence >= 0.45), 1).when(confidence >= 0.3, 2).otherwise(3)
    return F.concat(F.least(n, F.lit(4)).cast("string"), F.lit("-way")), n, tier
