"""Bulk files of PubMed records as a data source: a partition a file, records streamed from compressed XML.

    register(spark)
    spark.read.format("pubmed_bulk").option("path", folder).load()

Options: path (a folder or a file; .xml and .xml.gz), includeNoAbstract (records without an abstract too; false). Files are
reached through their file system's address, so shared stores work as mounted folders do."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "pmid string, pmcid string, doi string, title string, abstract string, authors array<string>, year int, journal string, journal_iso string, publication_types array<string>, mesh_terms array<string>, source string, source_file string"
#: Where a record's parts are, dates in the order in which they are asked, the free-form date behind them.
PARTS = {"title": "MedlineCitation/Article/ArticleTitle", "journal": "MedlineCitation/Article/Journal/Title", "journal_iso": "MedlineCitation/Article/Journal/ISOAbbreviation"}
LISTS = {"publication_types": "MedlineCitation/Article/PublicationTypeList/PublicationType", "mesh_terms": "MedlineCitation/MeshHeadingList/MeshHeading/DescriptorName"}
DATES = ["MedlineCitation/Article/Journal/JournalIssue/PubDate/Year", "MedlineCitation/Article/ArticleDate/Year", "MedlineCitation/DateCompleted/Year", "MedlineCitation/DateRevised/Year"]
FREE_DATE = "MedlineCitation/Article/Journal/JournalIssue/PubDate/MedlineDate"
#: Records of an Arrow batch; bytes read at once.
BATCH, PIECE = 500, 1 << 20


def _said(element) -> str:
    return "" if element is None else "".join(element.itertext()).strip()


def _author(element) -> str:
    group = _said(element.find("CollectiveName"))
    if group:
        return group
    given = _said(element.find("ForeName")) or _said(element.find("Initials"))
    return ", ".join(filter(None, (_said(element.find("LastName")), given)))


def _section(element) -> str:
    name, text = element.get("Label") or element.get("NlmCategory"), _said(element)
    return f"{name}: {text}" if name and text else text


def _year(article) -> int | None:
    plain = next((y for y in (_said(article.find(p)) for p in DATES) if y.isdigit()), None)
    found = plain or next(iter(re.findall(r"\b(?:18|19|20)\d{2}\b", _said(article.find(FREE_DATE)))), None)
    return int(found) if found else None


def record(article, file: str) -> dict:
    """The columns of SCHEMA from a PubmedArticle element; what is missing is empty, a year null."""
    ids = {"pmid": _said(article.find("MedlineCitation/PMID"))}
    for x in article.iterfind("PubmedData/ArticleIdList/ArticleId"):
        kind = (x.get("IdType") or "").strip().lower()
        if kind and _said(x):
            ids[kind] = _said(x)
    row = {"pmid": ids["pmid"], "pmcid": ids.get("pmc", ""), "doi": ids.get("doi", ""), "year": _year(article), "source": "PubMed", "source_file": file}
    row |= {name: _said(article.find(path)) for name, path in PARTS.items()}
    row |= {name: [t for t in map(_said, article.iterfind(path)) if t] for name, path in LISTS.items()}
    row["abstract"] = " ".join(filter(None, map(_section, article.iterfind("MedlineCitation/Article/Abstract/AbstractText")))).strip()
    row["authors"] = list(filter(None, map(_author, article.iterfind("MedlineCitation/Article/AuthorList/Author"))))
    return row


def records(pieces: Iterator[bytes], file: str) -> Iterator[dict]:
    """Records of an XML stream; only the one being read is held."""
    from xml.etree.ElementTree import XMLPullParser

    parser, root = XMLPullParser(("start", "end")), None
    for piece in pieces:
        parser.feed(piece)
        for event, element in parser.read_events():
            root = element if root is None else root
            if event == "end" and element.tag == "PubmedArticle":
                yield record(element, file)
                root.clear()


class _File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class _Reader(DataSourceReader):
    def __init__(self, path: str, every: bool):
        self.path, self.every = path, every

    @staticmethod
    def _system(uri: str) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = self._system(self.path)
        if system.get_file_info(path).is_file:
            return [_File(self.path)]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        base = self.path.rstrip("/")
        return [_File(base + f.path[len(path.rstrip("/")) :]) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith((".xml", ".xml.gz"))]

    def read(self, partition: _File) -> Iterator:
        import pyarrow as pa

        system, path = self._system(partition.uri)
        kinds = {"year": pa.int32()} | dict.fromkeys(("authors", "publication_types", "mesh_terms"), pa.list_(pa.string()))
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch(rows: list[dict]):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

        with system.open_input_stream(path) as stream:  # by its name it is inflated
            rows = []
            for row in records(iter(lambda: stream.read(PIECE), b""), path.rpartition("/")[2]):
                if self.every or row["abstract"]:
                    rows.append(row)
                if len(rows) == BATCH:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


class PubmedBulk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pubmed_bulk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("includenoabstract", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PubmedBulk)
