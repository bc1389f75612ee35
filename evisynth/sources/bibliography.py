"""Bibliographic files and strings: XML of abstracts, JSON logs, BibTeX, RIS and EndNote sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """Records of a PubMed export: pmid, title, abstract (labelled parts joined), year (from whichever date has one)."""
    schema = "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>>>"
    x = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path)
    a = "MedlineCitation.Article"
    date = F.coalesce(F.col(f"{a}.Journal.JournalIssue.PubDate.Year"), F.col(f"{a}.Journal.JournalIssue.PubDate.MedlineDate"))
    return x.select(F.col("MedlineCitation.PMID").alias("pmid"), F.col(f"{a}.ArticleTitle").alias("title"), F.array_join(f"{a}.Abstract.AbstractText", " ").alias("abstract"), F.col(f"{a}.Journal.Title").alias("journal"), F.regexp_extract(date, r"\b((?:18|19|20)\d{2})\b", 1).try_cast("int").alias("year"))


#: Places of an abstract record's parts in its XML.
_CITATION, _ARTICLE = "MedlineCitation", "MedlineCitation/Article"


def pubmed_strings(rows: DataFrame, id_col: str, xml: str) -> DataFrame:
    """Records in strings of XML as a service returns them, one row a record: id_col, pmid, title, abstract (parts joined by blanks), journal, year (of Year, else of MedlineDate), doi. Strings that are no XML, and nulls, give no rows."""
    articles = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<PubmedArticle\b.*?</PubmedArticle>"), F.lit(0))
    rows = rows.select(id_col, F.explode(articles).alias("_x"))
    text = lambda path: F.expr(f"xpath_string(_x, '/PubmedArticle/{path}')")
    listed = lambda path: F.expr(f"xpath(_x, '/PubmedArticle/{path}/text()')")
    date = f"{_ARTICLE}/Journal/JournalIssue/PubDate"
    year = F.regexp_extract(F.coalesce(F.nullif(text(f"{date}/Year"), F.lit("")), text(f"{date}/MedlineDate")), r"\b((?:18|19|20)\d{2})\b", 1).try_cast("int")
    doi = F.expr("xpath_string(_x, '/PubmedArticle/PubmedData/ArticleIdList/ArticleId[@IdType=\"doi\"]')")
    return rows.select(id_col, text(f"{_CITATION}/PMID").alias("pmid"), text(f"{_ARTICLE}/ArticleTitle").alias("title"), F.array_join(listed(f"{_ARTICLE}/Abstract/AbstractText"), " ").alias("abstract"), text(f"{_ARTICLE}/Journal/Title").alias("journal"), year.alias("year"), F.nullif(doi, F.lit("")).alias("doi"))


def paper_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def text_files(spark: SparkSession, path: str, kinds: tuple[str, ...] = (".txt", ".md", ".html", ".xml")) -> DataFrame:
    """(path, text) of every file of these kinds below a folder, a row a file."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.where(F.lower("path").rlike(r"(?:" + "|".join(k.replace(".", r"\.") for k in kinds) + ")$"))


def paper_lists(texts: DataFrame, text: str, schema: str) -> DataFrame:
    """The papers in strings that are each a JSON list of papers, or an object with one under `articles`; strings that are neither have none."""
    item = f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in schema.split(','))}>>"
    is_list = F.startswith(F.trim(text), F.lit("["))
    found = F.when(is_list, F.from_json(text, item)).otherwise(F.from_json(text, f"struct<articles:{item}>")["articles"])
    return texts.select(F.explode(found).alias("p")).where("p IS NOT NULL").select("p.*")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of one JSON object a line; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def escape_tex(text: Column) -> Column:
    return F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")


def bibtex(cite_key: Column, title: Column, year: Column, journal: Column) -> Column:
    field = lambda n, c: F.concat(F.lit(f"  {n} = {{"), escape_tex(c), F.lit("}"))
    return F.concat(F.lit("@article{"), cite_key, F.lit(",\n"), F.array_join(F.array(field("title", title), field("year", year.cast("string")), field("journal", journal)), ",\n"), F.lit("\n}"))


def endnote(df: DataFrame, path: str) -> None:
    df.write.format("xml").option("rootTag", "records").option("rowTag", "record").save(path)
