"""Identifiers and keys of bibliographic records, links to their texts, and what a paper's fields say, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Address prefixes of two identifiers.
PMC_PREFIXES = ["https://www.ncbi.nlm.nih.gov/pmc/articles/", "http://www.ncbi.nlm.nih.gov/pmc/articles/", "https://pmc.ncbi.nlm.nih.gov/articles/", "http://pmc.ncbi.nlm.nih.gov/articles/"]
PUBMED_PREFIXES = ["https://pubmed.ncbi.nlm.nih.gov/", "http://pubmed.ncbi.nlm.nih.gov/"]
#: Open-access candidates in order: name, address column, columns of the kind of host.
CANDIDATES = [
    ("openalex_best_oa_pdf", "openalex_best_oa_pdf_url", ["openalex_best_oa_host_type"]),
    ("openalex_best_oa", "openalex_best_oa_url", ["openalex_best_oa_host_type"]),
    ("openalex_oa_url", "openalex_oa_url", ["openalex_best_oa_host_type", "openalex_primary_host_type"]),
    ("openalex_primary_pdf", "openalex_primary_pdf_url", ["openalex_primary_host_type"]),
    ("openalex_primary", "openalex_primary_url", ["openalex_primary_host_type"]),
    ("s2_open_access_pdf", "s2_open_access_pdf_url", []),
]
#: Fields that may hold a paper's score, direction, quote or id, in order.
SCORE_FIELDS = ["relevance_score", "score", "llm_relevance", "support_score", "combined_score"]
DIRECTION_FIELDS = ["direction", "llm_direction", "evidence_direction"]
QUOTE_FIELDS = ["key_quote", "quoted_span", "quote", "excerpt"]


def _without(text: Column, prefixes: list[str]) -> Column:
    for p in prefixes:
        text = F.when(F.startswith(text, F.lit(p)), F.substring(text, len(p) + 1, 2_147_483_647)).otherwise(text)
    return text


def external_id(raw: Column, prefixes: list[str] | None = None) -> Column:
    """Trimmed, without the prefixes; of an address its last segment; null if nothing is left."""
    bare = _without(F.trim(raw), prefixes or [])
    last = F.element_at(F.split(F.rtrim(bare, F.lit("/")), "/"), -1)
    return F.nullif(F.when(bare.rlike("^https?://"), last).otherwise(bare), F.lit(""))


def pmcid(raw: Column) -> Column:
    """Upper case, with PMC before bare digits, of an id with a path its last segment; null if empty."""
    bare = external_id(raw, PMC_PREFIXES)
    bare = F.when(bare.startswith("PMC"), F.element_at(F.split(F.rtrim(bare, F.lit("/")), "/"), -1)).otherwise(bare)
    return F.upper(F.when(bare.rlike(r"^\d+$"), F.concat(F.lit("PMC"), bare)).otherwise(bare))


def pmid(raw: Column) -> Column:
    return external_id(raw, PUBMED_PREFIXES)


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def paper_uid(doi: Column, pmid_: Column, title: Column, year: Column) -> Column:
    """32 hexadecimal digits of the hash of the DOI, else the PMID, else title and year."""
    low = T.doi(doi)
    key = F.coalesce(F.concat(F.lit("doi:"), low), F.concat(F.lit("pmid:"), _given(pmid_)), F.concat(F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lit("|"), F.coalesce(year.cast("string"), F.lit(""))))
    return F.substring(F.sha2(key, 256), 1, 32)


def record_key(doi: Column, pmid_: Column, s2: Column, title: Column, year: Column) -> Column:
    """doi:, else pmid:, else s2:, else title: of its first 80 characters and year."""
    by_title = F.concat(F.lit("title:"), F.substring(F.lower(F.trim(F.coalesce(title, F.lit("")))), 1, 80), F.lit("|"), F.coalesce(year.cast("string"), F.lit("")))
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(_given(doi))), F.concat(F.lit("pmid:"), _given(pmid_)), F.concat(F.lit("s2:"), _given(s2)), by_title)


def article_key(doi: Column, title: Column) -> Column:
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(F.nullif(doi, F.lit("")))), F.concat(F.lit("title:"), F.trim(F.lower(F.coalesce(title, F.lit(""))))))


def paper_key(*candidates: Column) -> Column:
    """The first of DOI, PMC, PMID, S2 and OpenAlex ids and title that is there."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in candidates), F.lit(""))


def article_id(candidates: list[Column], title: Column, index: Column) -> Column:
    """The first identifier that is there, else the title's first 80 characters, else paper_ and the row's number."""
    return F.coalesce(*map(_given, candidates), F.nullif(F.substring(F.trim(title), 1, 80), F.lit("")), F.concat(F.lit("paper_"), (index + 1).cast("string")))


def candidates(row: dict[str, Column]) -> Column:
    """(source, url, host_type) of a paper's open-access addresses in order of preference, each address once. row: columns by name; missing ones have none."""
    get = lambda name: row.get(name, F.lit(None).cast("string"))
    found = [F.struct(F.lit("pmc").alias("source"), F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmcid(get("pmc")), F.lit("/")).alias("url"), F.lit("repository").alias("host_type"))]
    for source, url, hosts in CANDIDATES:
        host = F.coalesce(*(_given(get(h)) for h in hosts), F.lit(""))
        found.append(F.struct(F.lit(source).alias("source"), _given(get(url)).alias("url"), host.alias("host_type")))
    listed = F.filter(F.array(*found), lambda x: x["url"].isNotNull())
    return F.filter(listed, lambda x, i: F.array_position(F.transform(listed, lambda y: y["url"]), x["url"]) == i + 1)


def location(place: Column) -> Column:
    """(url, pdf_url, host_type) of a place (pdf_url, landing_page_url, source struct with type): the PDF's address before the page's; empty where there is none."""
    pdf = F.coalesce(place["pdf_url"], F.lit(""))
    url = F.coalesce(F.nullif(pdf, F.lit("")), place["landing_page_url"], F.lit(""))
    return F.struct(url.alias("url"), pdf.alias("pdf_url"), F.trim(F.coalesce(place["source"]["type"], F.lit(""))).alias("host_type"))


def link_addresses(links: Column, names: tuple[str, ...] = ("url", "href")) -> Column:
    """The address of each link object, by the first of the names that has one; objects without any go."""
    return F.filter(F.transform(links, lambda x: T.first_nonempty(*(x[n] for n in names))), lambda u: u.isNotNull())


def author_names(authors: Column, names: tuple[str, ...], creator: Column | None = None) -> Column:
    """Each author's name by the first of the names that a provider gives; without any author, the creator alone."""
    found = F.coalesce(link_addresses(authors, names), F.array().cast("array<string>"))
    if creator is None:
        return found
    return F.when((F.size(found) == 0) & ~T.falsy(creator), F.array(creator)).otherwise(found)


def pdf_link(html: Column) -> Column:
    """The address of a page's PDF as it stands there: of the citation_pdf_url tag, else the first link to a .pdf, else the reader's; empty without any."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta[^>]+>"), F.lit(0)), lambda t: F.contains(F.lower(t), F.lit("citation_pdf_url")))
    contents = F.filter(F.transform(tags, lambda t: F.trim(T.unescaped(F.regexp_extract(t, r"""(?is)\bcontent\s*=\s*(['"])(.*?)\1""", 2)))), lambda x: x != "")
    link = lambda name: F.nullif(T.unescaped(F.regexp_extract(html, rf"""(?i){name}\s*=\s*(['"])([^'"]+\.pdf(?:\?[^'"]*)?)\1""", 2)), F.lit(""))
    return F.coalesce(F.get(contents, F.lit(0)), link("href"), link("data-readcube-pdf-url"), F.lit(""))


def paper_score(fields: dict[str, Column], supports: Column) -> Column:
    """The first of SCORE_FIELDS that is a number, else 3 for a paper that supports, else 0."""
    return F.coalesce(*(fields[f].try_cast("double") for f in SCORE_FIELDS if f in fields), F.when(supports, 3.0), F.lit(0.0))


def paper_direction(fields: dict[str, Column], supports: Column) -> Column:
    """contradicts, supports or neutral by the first of DIRECTION_FIELDS that says so; else supports for a paper that does, else neutral."""

    def said(c: Column) -> Column:
        low = F.lower(c)
        return F.when(F.contains(low, F.lit("contradict")), "contradicts").when(F.contains(low, F.lit("support")), "supports").when(F.contains(low, F.lit("neutral")), "neutral")

    return F.coalesce(*(said(fields[f]) for f in DIRECTION_FIELDS if f in fields), F.when(supports, "supports"), F.lit("neutral"))


def paper_quote(fields: dict[str, Column], spans: Column) -> Column:
    """The first of QUOTE_FIELDS with more than white space, with single blanks, else the first evidence span, else empty."""
    single = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    first = F.get(F.filter(F.transform(spans, lambda s: F.trim(s)), lambda s: s != ""), F.lit(0))
    return F.coalesce(*(single(fields[f]) for f in QUOTE_FIELDS if f in fields), first, F.lit(""))


def stops(round_: Column, new_relevant: Column, most_rounds: int = 99, least_new: int = 0) -> Column:
    """Why retrieval stops after a round, or null: as many rounds as allowed, or, but for round 0, too few new relevant records."""
    return F.when(round_ >= most_rounds, "max_rounds").when((round_ > 0) & (new_relevant < least_new), "below_yield")
