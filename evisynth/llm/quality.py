"""Quality rules as a short-circuit cascade: cost and selectivity of each rule are measured on a bounded sample, and the
rules run in order of rejections per second, each only on texts that the ones before have let through.

The order changes how long a verdict takes, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, table

#: Texts that the cascade's order is estimated on, about; the seed of their choice.
SAMPLE, SEED = 2000, 42
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_LETTER = re.compile(rb"[A-Za-z]")


class Profile:
    """What rules ask of one text (UTF-8), each computed when it is first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        kept = self.text.translate(None, _SPACE)
        return len(kept) if kept.isascii() else len(kept.decode())

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_ids(self) -> np.ndarray:
        ids: dict[bytes, int] = {}
        return np.array([ids.setdefault(w, len(ids)) for w in self.words], np.int64)

    @cached_property
    def word_counts(self) -> np.ndarray:
        return np.bincount(self.word_ids)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that occur twice or more."""
        ids = self.word_ids
        if len(ids) < 4:
            return 0
        n = int(ids.max()) + 1
        _, pairs = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)
        windows = pairs * n + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = np.diff(windows[order]) == 0
        again = np.zeros(len(windows), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        covered = np.zeros(len(ids), bool)
        for i in range(3):
            covered[i : i + len(again)] |= again
        return int(covered.sum())

    @cached_property
    def capitals(self) -> tuple[int, int]:
        n = len(self.text)
        return n - len(self.text.translate(None, _UPPER)), n - len(self.text.translate(None, _LOWER))

    @cached_property
    def n_lettered(self) -> int:
        seen = {w: bool(_LETTER.search(w)) or (not w.isascii() and any(map(str.isalpha, w.decode()))) for w in set(self.words)}
        return sum(map(seen.__getitem__, self.words))


Rule = Callable[[Profile], bool]

#: Each is true for a text to reject. Shares of words, lines and letters are compared as whole numbers.
RULES: dict[str, Rule] = {
    "word_length": lambda p: p.word_chars < 2 * p.n_words or p.word_chars > 20 * p.n_words,
    "symbols": lambda p: 10 * p.n_symbols > p.n_words,
    "repeated_lines": lambda p: 2 * p.n_dup_lines > len(p.lines),
    "capitals": lambda p: p.capitals[0] > p.capitals[1],
    "letters": lambda p: 100 * p.n_lettered < 80 * p.n_words,
    "one_word": lambda p: p.n_words > 0 and 100 * int(p.word_counts.max()) > 30 * p.n_words,
}


def base_failed(p: Profile) -> bool:
    return p.n_words < 50 or 100 * p.n_repeat_words > 50 * p.n_words


def cascade_order(docs: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES, sample: int = SAMPLE, seed: int = SEED) -> list[str]:
    """Names of the rules, most rejections per second first, measured in tasks over about `sample` of the rows.

    Rules run on what the base lets through and find its words split, so that is where and how they are measured."""
    share = min(1.0, sample / max(docs.count(), 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0)
        for batch in batches:
            for t in bytes_of(batch.column(0)):
                based = Profile(t)
                if base_failed(based):
                    continue
                for name, rule in rules.items():
                    p = Profile(t)
                    p.__dict__.update(based.__dict__)  # what the base has computed, and nothing of other rules
                    began = time.perf_counter()
                    hits[name] += bool(rule(p))
                    spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(list(rules)), pa.array(list(spent.values())), pa.array(list(hits.values()), pa.int64())], ["rule", "spent", "hits"])

    picked = docs.select(text).sample(False, share, seed) if share < 1 else docs.select(text)
    rows = picked.mapInArrow(measure, "rule string, spent double, hits bigint").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("hits").alias("hits")).collect()
    worth = {r["rule"]: r["hits"] / max(r["spent"], 1e-9) for r in rows}  # one row a rule
    return sorted(rules, key=lambda name: (-worth.get(name, 0.0), list(rules).index(name)))


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: dict[str, Rule] = RULES, order: list[str] | None = None) -> DataFrame:
    """A row for each row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    Words are runs of anything but ASCII white space; a null text has none and fails for being short, as an empty one
    does. rejected_by is "base", the first rule of the cascade that rejects, or null. Repeated rows, null ids and very
    long texts are judged like any other; an empty table gives no rows; other columns are ignored."""
    order = order or cascade_order(docs, text, rules)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in bytes_of(batch.column(1)):
                p = Profile(t)
                failed = base_failed(p)
                by = "base" if failed else next((name for name in order if rules[name](p)), None)
                rows.append((p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, failed, by is None, by))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names)
            pa.default_memory_pool().release_unused()

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, rejected_by string"
    return chosen.mapInArrow(judge, schema).withColumnRenamed("doc_id", id_col)


def keep_good(docs: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES) -> DataFrame:
    """docs without the rows that the base or the cascade rejects; columns and other rows stay as they are."""
    order = cascade_order(docs, text, rules)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = []
            for t in bytes_of(batch.column(at)):
                p = Profile(t)
                verdicts.append(not base_failed(p) and not any(rules[name](p) for name in order))
            yield batch.filter(pa.array(verdicts, pa.bool_()))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(keep, docs.schema)


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("rejected_by")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
v AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM g WHERE z IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
u AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, x, count(*) AS n FROM v GROUP BY doc_id, x) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
    len(ls) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS uppers, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS lowers,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS lettered, coalesce(top, 0) AS top
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR uppers > lowers OR 100 * lettered < 80 * n_words OR 100 * top > 30 * n_words) AS kept
FROM f
"""
