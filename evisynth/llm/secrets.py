"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression follows a Boolean query of trigrams that any match must hold (lower case). The index
keeps, for the trigrams of all queries, the documents that hold them; a rule's candidates are the documents in the
postings of every trigram of one of its clauses. Candidates are verified with the expression itself, on the whole text;
a rule that no trigram is mandatory for scans all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, written

# re's own parser gives the expression's tree
from re import _constants as _sre, _parser  # isort: skip

Clauses = list[frozenset[str]]
#: Clauses that a query may have before it gives up and asks for all documents.
MOST_CLAUSES = 64
ALL: Clauses = [frozenset()]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression (Java's and Python's agree on it), and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed values. A run of 20 or more from AKIA, and one of 24 or more hexadecimal digits, begins where a shorter run would, so
#: that the length can stand in the expression; a value of an assignment that is too short still uses up its text.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


def _both(a: Clauses, b: Clauses) -> Clauses:
    out = list({x | y for x in a for y in b})
    return out if len(out) <= MOST_CLAUSES else min((a, b), key=len)


def _clauses(tree) -> Clauses:
    found, run = ALL, ""

    def ended() -> None:
        nonlocal found, run
        grams = frozenset(run[i : i + 3] for i in range(len(run) - 2))
        found, run = _both(found, [grams]), ""

    for op, arg in tree:
        if op is _sre.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if op is _sre.MAX_REPEAT and arg[0] == arg[1] and len(arg[2]) == 1 and arg[2][0][0] is _sre.LITERAL and arg[2][0][1] < 128:
            run += chr(arg[2][0][1]).lower() * arg[0]
            continue
        ended()
        if op is _sre.SUBPATTERN:
            found = _both(found, _clauses(arg[3]))
        elif op is _sre.BRANCH:
            found = _both(found, [c for branch in arg[1] for c in _clauses(branch)])
        elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT) and arg[0] > 0:
            found = _both(found, _clauses(arg[2]))
    ended()
    return found


def trigram_query(pattern: str) -> Clauses:
    """Sets of lower-case trigrams: every match holds all of one of them. [frozenset()] asks for all texts."""
    found = _clauses(_parser.parse(pattern))
    least = [c for c in found if not any(d < c for d in found)]  # a clause that asks for more than another adds nothing
    return ALL if frozenset() in least else sorted(least, key=sorted)


def trigram_index(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, doc_id) of the given lower-case trigrams over whole texts."""
    known = F.array(*(F.lit(g) for g in grams))
    held = let(F.lower(F.col(text)), lambda low: F.filter(known, lambda g: F.contains(low, g)))
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull())
    # outer: before an inner explode Spark would look for the trigrams again to see whether there are any
    return rows.select(F.explode_outer(held).alias("gram"), F.col(id_col).alias("doc_id")).where("gram IS NOT NULL")


def candidates(postings: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """doc_id and the rules whose query its postings meet. The clauses, a row for each trigram in the rules' text, are joined to the postings."""
    spark = postings.sparkSession
    rows = [(kind, i, len(c), g) for kind, clauses in queries.items() for i, c in enumerate(clauses) for g in sorted(c)]
    asked = spark.createDataFrame(rows, "kind string, clause int, need int, gram string")
    met = postings.join(F.broadcast(asked), "gram").groupBy("doc_id", "kind", "clause", "need").agg(F.size(F.collect_set("gram")).alias("n"))
    return met.where("n = need").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """The rule's matches, leftmost and not overlapping, as (start, kind number, end) in code points, end exclusive; too short ones are left out."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    pattern = F.lit(rule.pattern)
    between, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found

    def walk(x: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.char_length(x["between"][i])
            end = start + F.char_length(x["found"][i])
            span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
            fits = F.char_length(x["values"][i]) >= rule.least
            return F.struct(end.alias("at"), F.when(fits, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["found"]) - 1), begin, step)["out"]

    pieces = F.struct(between.alias("between"), found.alias("found"), values.alias("values"))
    return F.when(text.rlike(rule.pattern), let(pieces, walk)).otherwise(empty)


def found_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `secrets`: all spans by start, then kind as listed, as (start, kind number, end).

    A null or empty text has none; very long ones are scanned whole. Texts of a null id are verified by every rule, as no
    posting names them; rows that share an id share their candidate rules, and each is verified by its own text. Other
    columns stay; an empty table stays empty."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: c for kind, c in queries.items() if c != ALL}
    grams = sorted({g for clauses in indexed.values() for c in clauses for g in c})
    postings = written(trigram_index(docs, grams, id_col, text), "postings")
    asked = candidates(postings, indexed).select(F.col("doc_id").alias("_candidate"), F.col("kinds").alias("_kinds"))
    rows = docs.join(asked, docs[id_col] == F.col("_candidate"), "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    asks = lambda kind: F.col(id_col).isNull() | F.coalesce(F.array_contains("_kinds", kind), F.lit(False))
    each = [spans_of(whole, r, i) if r.kind not in indexed else F.when(asks(r.kind), spans_of(whole, r, i)).otherwise(none) for i, r in enumerate(rules)]
    return rows.withColumn("secrets", F.array_sort(F.concat(*each))).drop("_candidate", "_kinds")


def written_spans(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with every span, or run of overlapping ones, replaced by the mask."""

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) > 0, let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.char_length(text))))).otherwise(text)


def op8_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found_secrets(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    n = lambda i: F.size(F.filter("secrets", lambda s: s["kind"] == i)).cast("bigint")
    base = F.filter("secrets", lambda s: s["kind"] < len(BASE))
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written_spans(base), 256).alias("base_sha256"), written_spans(F.col("secrets")).alias("spans"))
