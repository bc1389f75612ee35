"""Statistical results in text: test statistics, p-values, intervals, effects, samples; report numbers; coordinates.

Most is regexp functions over whole texts. Where a match's place counts (statistics that must not be read twice,
the p-value next to a statistic), places follow from splitting the text at its matches. Results with all that is around
them are read text by text in Arrow batches, with the same expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..tables import partitions

#: A number with optional sign and blanks around its point, and what it stands in. Group 1 is the statistic,
#: the group named first where there are degrees of freedom.
NUMBER = r"[-+−]?(?:\d+\s*\.\s*\d+|\.\s*\d+|\d+)"
TESTS = [
    ("t_test", rf"(?i)\bt\s*\(\s*(?<df1>{NUMBER})\s*\)\s*=\s*(?<stat>{NUMBER})"),
    ("f_test", rf"(?i)\bF\s*\(\s*(?<df1>{NUMBER})\s*,\s*(?<df2>{NUMBER})\s*\)\s*=\s*(?<stat>{NUMBER})"),
    ("chi_square", rf"(?i)(?:chi[- ]?square|x\^?2|χ\s*(?:2|\^2|²))\s*\(\s*(?<df1>{NUMBER})\s*\)\s*=\s*(?<stat>{NUMBER})"),
    ("z_test", rf"(?i)\bz\s*=\s*(?<stat>{NUMBER})"),
    ("correlation", rf"(?i)\b(?:r|rho|rs)\s*=\s*(?<stat>{NUMBER})"),
    ("regression_coefficient", rf"(?i)\b(?:beta|b|coef(?:ficient)?)\s*=\s*(?<stat>{NUMBER})"),
    ("effect_size", rf"(?i)\b(?:Cohen[''’]?s\s+)?(?<type>d|g)\s*=\s*(?<stat>{NUMBER})"),
    ("odds_or_risk_ratio", rf"\b(?<type>OR|RR|HR)\s*=\s*(?<stat>{NUMBER})"),
]
P_VALUE = rf"(?i)\bp\s*(<=|>=|[<>=])\s*({NUMBER})(?:\b|(?=\s))"
INTERVAL = rf"(?i)(9[059])%?\s*CI\s*[:=]?\s*[\[(]?\s*({NUMBER})\s*(?:,|;|\bto\b|-)\s*({NUMBER})"
EFFECTS = [rf"(?i)\b(?:Cohen[''’]?s\s+)?(d|g)\s*=\s*({NUMBER})", rf"\b(OR|RR|HR)\s*=\s*({NUMBER})", rf"(?i)\b(r|rho|rs)\s*=\s*({NUMBER})"]
#: All of these in one pass; a name before d or g does not change what is found.
ANY_EFFECT = rf"\b(?:[dgDG]|[rR](?:[hH][oO]|[sS])?|OR|RR|HR)\s*=\s*{NUMBER}"
SAMPLE_WORDS = "participants|patients|subjects|children|adults|adolescents|students|controls|cases|mice|rats|animals|dyads|families"
SAMPLE, N_EQUALS = rf"(?i)(\d{{1,6}})\s+({SAMPLE_WORDS})", r"\b[Nn]\s*=\s*(\d{1,6})\b"
AGE = rf"(?i)\bage\s*(?:mean|M)?\s*[=:]?\s*({NUMBER})(?:\s*(?:years|yrs?))?(?:\s*,?\s*SD\s*=\s*({NUMBER}))?"
COMPARISON = r"(?i)\b([A-Za-z][A-Za-z0-9 /-]{2,40})\s+(?:vs\.?|versus|compared with|compared to)\s+([A-Za-z][A-Za-z0-9 /-]{2,40})"
SUBJECT_WORDS = ["participants", "patients", "subjects", "children", "adults", "adolescents", "students", "controls", "cases", "mice", "rats", "animals", "caregivers", "families", "dyads", "cohort", "sample"]
RESULT_PHRASES = ["significant", "non-significant", "nonsignificant", "associated with", "correlated with", "increased", "decreased", "no difference", "main effect", "interaction", "predicted", "odds", "risk"]
#: Characters around a statistic that its context has, the farthest p-value that is near, kinds that are effects themselves.
RADIUS, NEAR, OWN_EFFECT = 280, 180, ["effect_size", "odds_or_risk_ratio", "correlation"]
#: The metrics of full texts and the numbers of abstracts.
METRICS = {
    "d_or_g": r"(?i)(?:Cohen[''’]?s\s+)?([dg])\s*=\s*(-?\d+\.\d{1,4})",
    "hedges": r"(?i)Hedges[''’]?\s*g\s*=\s*(-?\d+\.\d{1,4})",
    "eta": r"(?i)(?:partial\s+)?(?:η²|η-squared|eta[- ]?squared)\s*=\s*(\d+\.\d{1,4})",
    "ratio": r"\b(OR|RR)\s*=\s*(\d+\.\d{1,4})",
    "n": r"(?:participants|sample|subjects|patients)?\s*[\(\[]?\s*[Nn]\s*=\s*(\d{2,6})\s*[\)\]]?",
    "total": r"(?i)(?:total\s+(?:of\s+)?|included\s+|enrolled\s+)(\d{1,3}(?:,\d{3})*)\s+(?:participants|patients|subjects|individuals)",
    "ci": r"(?i)(\d{2,3})%?\s*CI\s*[:=]?\s*[\[\(]?\s*(-?\d+\.?\d*)\s*[,;\s]+\s*(-?\d+\.?\d*)\s*[\]\)]?",
    "ci_to": r"(?i)(\d{2,3})%?\s*CI\s*[:=]?\s*(-?\d+\.?\d*)\s+to\s+(-?\d+\.?\d*)",
    "p": r"(?i)\bp\s*([<>=≤≥])\s*\.?(\d+\.?\d*(?:[eE][+-]?\d+)?)",
}
ABSTRACT_NUMBERS = {
    "paper_counts": r"(?i)(\d[\d,]*)\s+(?:papers?|studies|articles|publications?)",
    "percentages": r"(\d+(?:\.\d+)?)\s*%",
    "kappa_values": r"(?iu)(?:κ|kappa)\s*=\s*(\d+(?:\.\d+)?)",
    "ci_values": r"(?i)CI\s*[\[(\s]*(\d+(?:\.\d+)?)\s*[,–-]\s*(\d+(?:\.\d+)?)\s*[\])]?",
    "p_values": r"(?i)p\s*([<=>≤≥])\s*\.?(\d+(?:\.\d+)?)",
    "correlations": r"\br\s*=\s*(\-?\d+(?:\.\d+)?)",
    "generic_counts": r"(?i)(\d+)\s+(?:of\s+)?(?:\w+\s+)?(?:conditions?|mechanisms?|clusters?|brain\s+regions?)",
}


def number(raw: Column) -> Column:
    """A matched number as a double: blanks go, the minus sign of typesetting becomes a hyphen."""
    return F.regexp_replace(F.regexp_replace(raw, r"\s+", ""), "−", "-").try_cast("double")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _matches(text: Column, pattern: str, *needed: str) -> Column:
    """Whole matches of a pattern, looked for only where one of the plain strings is."""
    there = F.contains(text, F.lit(needed[0]))
    for plain in needed[1:]:
        there = there | F.contains(text, F.lit(plain))
    return F.when(there, _all(text, pattern)).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _groups(pattern: str) -> dict[str, int]:
    """Numbers of the named groups; these expressions have no others."""
    return {part.split(">")[0]: i for i, part in enumerate(pattern.replace("(?<=", "").replace("(?<!", "").split("(?<")[1:], 1)}


def spans(text: Column, pattern: str, groups: dict[str, int]) -> Column:
    """The matches in order, as (start, end, raw, incomplete, and a field for each group): places in code points, end exclusive.

    incomplete: the point of a decimal follows, but no digits, as when a line or page ended there."""
    kind = "array<struct<start:int,end:int,raw:string,incomplete:boolean" + "".join(f",{name}:string" for name in groups) + ">>"
    empty = F.array().cast(kind)
    clean = F.translate(F.coalesce(text, F.lit("")), "\x01", " ")  # one character for each match parts what is between

    def walk(x: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.char_length(x["between"][i])
            end = start + F.char_length(x["found"][i])
            tail, last = x["between"][i + 1], i == F.size(x["found"]) - 1
            cut = tail.rlike(r"^\s*\.\s+(?:\D|$)") | (last & tail.rlike(r"^\s*\.\s*$"))
            row = F.struct(start.alias("start"), end.alias("end"), x["found"][i].alias("raw"), cut.alias("incomplete"), *(F.regexp_extract(x["found"][i], pattern, g).alias(name) for name, g in groups.items()))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(row)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(x["found"]) - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]

    def found_in(found: Column) -> Column:
        parts = F.struct(F.split(F.regexp_replace(clean, pattern, "\x01"), "\x01", -1).alias("between"), found.alias("found"))
        return F.when(F.size(found) == 0, empty).otherwise(_let(parts, walk))

    return _let(_all(clean, pattern), found_in)


def p_value_spans(text: Column) -> Column:
    """(start, end, operator, value) with a value from 0 to 1, whole decimals only."""
    found = F.filter(spans(text, P_VALUE, {"op": 1, "digits": 2}), lambda s: ~(s["incomplete"] & ~F.contains(s["digits"], F.lit("."))))
    rows = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["op"].alias("operator"), number(s["digits"]).alias("value")))
    return F.filter(rows, lambda s: s["value"].between(0, 1))


def p_values(text: Column) -> Column:
    """(operator, value) pairs with a value from 0 to 1."""
    return F.transform(p_value_spans(text), lambda s: F.struct(s["operator"].alias("operator"), s["value"].alias("value")))


def nearest(p_spans: Column, start: Column, end: Column) -> Column:
    """(operator, value) of the p-values within NEAR characters of a span, nearest first; if none is, of the nearest one."""
    gap = lambda s: F.when((s["start"] <= end) & (start <= s["end"]), 0).otherwise(F.least(F.abs(s["start"] - end), F.abs(start - s["end"])))
    ordered = F.array_sort(F.transform(p_spans, lambda s, i: F.struct(gap(s).alias("gap"), i.alias("i"), s["operator"].alias("operator"), s["value"].alias("value"))))
    # the first is near, or it is the nearest one
    kept = _let(ordered, lambda o: F.filter(o, lambda s, i: (s["gap"] <= NEAR) | (i == 0)))
    return F.transform(kept, lambda s: F.struct(s["operator"].alias("operator"), s["value"].alias("value")))


def intervals(text: Column) -> Column:
    """(level, lower, upper) with lower < upper."""
    part = lambda s, i: F.regexp_extract(s, INTERVAL, i)
    rows = F.transform(_matches(text, INTERVAL, "CI", "ci", "Ci", "cI"), lambda s: F.struct(part(s, 1).try_cast("int").alias("level"), number(part(s, 2)).alias("lower"), number(part(s, 3)).alias("upper")))
    return F.filter(rows, lambda s: s["lower"] < s["upper"])


def effect_sizes(text: Column) -> Column:
    """Distinct (type, value): d and g, then OR, RR and HR, then r, rho and rs; types in lower case."""
    pairs = F.transform(_matches(text, ANY_EFFECT, "="), lambda m: F.struct(F.lower(F.rtrim(F.regexp_replace(F.split_part(m, F.lit("="), F.lit(1)), r"\s+", ""))).alias("type"), number(F.split_part(m, F.lit("="), F.lit(2))).alias("value")))
    of = lambda x, kinds: F.filter(x, lambda s: s["type"].isin(kinds) & s["value"].isNotNull())
    return _let(pairs, lambda x: F.array_distinct(F.concat(of(x, ["d", "g"]), of(x, ["or", "rr", "hr"]), of(x, ["r", "rho", "rs"]))))


def effects(text: Column) -> Column:
    """Values of d and g from -5 to 5, each once."""
    return F.array_distinct(F.filter(F.transform(_all(text, EFFECTS[0], 2), number), lambda x: x.between(-5, 5)))


def subjects(text: Column) -> Column:
    """Distinct (n, label): numbers before words for people or animals, then N = n as "sample"; 2 to 999999 and no years."""
    named = F.transform(_all(text, SAMPLE), lambda m: F.struct(F.regexp_extract(m, r"^\d+", 0).try_cast("int").alias("n"), F.lower(F.regexp_extract(m, r"[A-Za-z]+$", 0)).alias("label")))
    plain = F.transform(_all(text, N_EQUALS, 1), lambda n: F.struct(n.try_cast("int").alias("n"), F.lit("sample").alias("label")))
    return F.array_distinct(F.filter(F.concat(named, plain), lambda s: s["n"].between(2, 999_999) & ~s["n"].between(1900, 2099)))


def age(text: Column) -> Column:
    """(mean, sd) of the first age; null without one."""
    mean = number(F.regexp_extract(text, AGE, 1))
    return F.when(mean.isNotNull(), F.struct(mean.alias("mean"), number(F.regexp_extract(text, AGE, 2)).alias("sd")))


def sample_sizes(text: Column) -> Column:
    """Numbers before words for people or animals, 2 to 999999 and no years."""
    found = F.transform(_all(text, SAMPLE, 1), lambda x: x.try_cast("int"))
    return F.filter(found, lambda n: (n >= 2) & (n <= 999_999) & ~n.between(1900, 2099))


def comparisons(text: Column) -> Column:
    """The first three of "a vs b" of at most 100 characters."""
    both = F.zip_with(_all(text, COMPARISON, 1), _all(text, COMPARISON, 2), lambda a, b: F.concat(F.trim(a), F.lit(" vs "), F.trim(b)))
    return F.slice(F.filter(both, lambda x: F.length(x) <= 100), 1, 3)


def _held(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), w) for w in words)))


def subject_terms(text: Column) -> Column:
    return _held(text, SUBJECT_WORDS)


def likely_result(text: Column) -> Column:
    return F.size(_held(text, RESULT_PHRASES)) > 0


def test_spans(text: Column) -> Column:
    """(test, start, end, raw, stat, df1, df2, type): earlier patterns first; a later match leaves out what overlaps a span already read, and a cut decimal is none."""
    names = ["stat", "df1", "df2", "type"]

    def one(name: str, pattern: str) -> Column:
        groups = _groups(pattern)
        found = F.filter(spans(text, pattern, groups), lambda s: ~(s["incomplete"] & ~F.contains(s["stat"], F.lit("."))))
        value = lambda s, n: (s[n] if n in groups else F.lit(None).cast("string")).alias(n)
        return F.transform(found, lambda s: F.struct(F.lit(name).alias("test"), s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw"), *(value(s, n) for n in names)))

    every = F.concat(*(one(name, pattern) for name, pattern in TESTS))
    none = F.array().cast("array<struct<test:string,start:int,end:int,raw:string,stat:string,df1:string,df2:string,type:string>>")
    overlaps = lambda taken, s: F.exists(taken, lambda t: F.greatest(t["start"], s["start"]) < F.least(t["end"], s["end"]))
    return F.aggregate(every, none, lambda taken, s: F.when(overlaps(taken, s), taken).otherwise(F.concat(taken, F.array(s))))


def exploded(rows: DataFrame, found: Column, name: str) -> DataFrame:
    """rows with `name`, a row for each element of the array: outer, then without nulls, as Spark would otherwise compute the array again to see whether it is empty."""
    return rows.withColumn("_found", found).withColumn(name, F.explode_outer("_found")).drop("_found").where(F.col(name).isNotNull())


def test_statistics(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row for each test statistic: id_col, test, statistic, start, end. Null and empty texts have none."""
    rows = exploded(docs.select(id_col, F.col(text).alias("_text")), test_spans(F.col("_text")), "t")
    return rows.select(id_col, "t.test", number(F.col("t.stat")).alias("statistic"), "t.start", "t.end")


#: Columns that a result has besides its block's id.
RESULT = "test string, raw string, statistic double, df1 double, df2 double, start int, end int, p_values array<struct<operator:string,value:double>>, confidence_intervals array<struct<level:int,lower:double,upper:double>>, effect_sizes array<struct<type:string,value:double>>, sample_sizes array<struct<n:int,label:string>>, comparisons array<string>, context string, missing_fields array<string>, needs_review boolean"
#: Words before an equals sign with which tests and effects end; with a bracket, words before brackets that are before it.
_TEST_WORDS = [{"t("}, {"f("}, {"square(", "2(", "²("}, {"z"}, {"r", "rho", "rs"}, {"beta", "b", "coef", "coefficient"}, {"d", "g"}, {"or", "rr", "hr"}]
_EFFECT_WORDS = [{"d", "g"}, {"or", "rr", "hr"}, {"r", "rho", "rs"}]
_TESTS = [(name, re.compile(pattern.replace("(?<", "(?P<")), words) for (name, pattern), words in zip(TESTS, _TEST_WORDS, strict=True)]
_EFFECTS = [(re.compile(pattern), words) for pattern, words in zip(EFFECTS, _EFFECT_WORDS, strict=True)]
_SIGN = re.compile(r"[<>=]")
_P_VALUE, _INTERVAL, _SAMPLE, _N_EQUALS, _COMPARISON = map(re.compile, (P_VALUE, INTERVAL, SAMPLE, N_EQUALS, COMPARISON))
_VERSUS = re.compile(r"(?i)(?<=\s)(?:vs\.?|versus|compared with|compared to)(?=\s)")
_CUT = re.compile(r"\s*\.(?:\s*$|\s+(?:$|\D))")
_BLANKS = re.compile(r"\s+")


def _read_number(raw: str | None) -> float | None:
    try:
        return float(_BLANKS.sub("", raw or "").replace("−", "-"))
    except ValueError:
        return None


def _signs(text: str) -> list[tuple[int, str]]:
    """(start, word) of the word in folded case that is before each equals sign or comparison, or before the brackets that are; that of brackets ends in a bracket."""
    out = []
    for m in _SIGN.finditer(text):
        end, bracket = m.start(), ""
        while end and text[end - 1].isspace():
            end -= 1
        if end and text[end - 1] == ")":
            end, bracket = max(0, text.rfind("(", 0, end)), "("
            while end and text[end - 1].isspace():
                end -= 1
        at = end
        while at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            at -= 1
        if at < end:
            out.append((at, text[at:end].casefold() + bracket))
    return out


def _matches_at(pattern: re.Pattern, text: str, words: set[str], signs: list[tuple[int, str]]) -> list[re.Match]:
    """The matches of a pattern that begins with one of `words`, looked for where one is; or all over the text if a match may begin before its word."""
    if "2(" in words:
        return list(pattern.finditer(text)) if any(w.endswith(tuple(words)) for _, w in signs) else []
    at = [i for i, w in signs if w in words]
    if at and "d" in words and "ohen" in text.lower():
        return list(pattern.finditer(text))
    return [m for i in at if (m := pattern.match(text, i))]


def _is_cut(text: str, end: int, digits: str) -> bool:
    return "." not in digits and _CUT.match(text, end) is not None


def _read_tests(text: str, signs: list[tuple[int, str]]) -> list[tuple[str, re.Match]]:
    found = []
    for name, pattern, words in _TESTS if signs else ():
        for m in _matches_at(pattern, text, words, signs):
            start, end = m.span()
            if not _is_cut(text, end, m["stat"]) and not any(max(start, t.start()) < min(end, t.end()) for _, t in found):
                found.append((name, m))
    return found


def _read_p_values(text: str, signs: list[tuple[int, str]]) -> list[tuple[int, int, dict]]:
    rows = [(*m.span(), {"operator": m[1], "value": _read_number(m[2])}) for m in _matches_at(_P_VALUE, text, {"p"}, signs) if not _is_cut(text, m.end(), m[2])]
    return [r for r in rows if r[2]["value"] is not None and 0 <= r[2]["value"] <= 1]


def _read_nearest(found: list[tuple[int, int, dict]], start: int, end: int) -> list[dict]:
    gap = lambda s, e: 0 if s <= end and start <= e else min(abs(s - end), abs(start - e))
    ordered = sorted(((gap(s, e), i, row) for i, (s, e, row) in enumerate(found)), key=lambda x: x[:2])
    return [row for i, (far, _, row) in enumerate(ordered) if far <= NEAR or i == 0]


def _read_intervals(text: str) -> list[dict]:
    rows = [{"level": int(m[1]), "lower": _read_number(m[2]), "upper": _read_number(m[3])} for m in _INTERVAL.finditer(text)]
    return [r for r in rows if r["lower"] is not None and r["upper"] is not None and r["lower"] < r["upper"]]


def _read_effects(text: str, signs: list[tuple[int, str]]) -> list[dict]:
    seen: dict[tuple[str, float], None] = {}
    for pattern, words in _EFFECTS:
        for m in _matches_at(pattern, text, words, signs):
            value = _read_number(m[2])
            if value is not None:
                seen.setdefault((m[1].lower(), value))
    return [{"type": t, "value": v} for t, v in seen]


def _read_subjects(text: str, signs: list[tuple[int, str]]) -> list[dict]:
    named = [(int(m[1]), m[2].lower()) for m in _SAMPLE.finditer(text)] + [(int(m[1]), "sample") for m in _matches_at(_N_EQUALS, text, {"n"}, signs)]
    return [{"n": n, "label": label} for n, label in dict.fromkeys(named) if 2 <= n <= 999_999 and not 1900 <= n <= 2099]


def _read_comparisons(text: str) -> list[str]:
    """The first three; a match is looked for from 41 characters before the blanks before the next word that compares, as its first side has no more."""
    out, at, word = [], 0, _VERSUS.search(text)
    while word and len(out) < 3:
        before = len(text[: word.start()].rstrip())
        if (m := _COMPARISON.search(text, max(at, before - 41))) is None:
            break
        value = f"{m[1].strip(' ')} vs {m[2].strip(' ')}"
        if len(value) <= 100:
            out.append(value)
        at = m.end()
        word = _VERSUS.search(text, at)
    return out


def _read_results(text: str, around: bool = True) -> Iterator[dict]:
    """Rows of RESULT of a text; without `around`, only what the statistic itself and its p-values are."""
    signs = _signs(text)
    tests = _read_tests(text, signs)
    known: dict[str, tuple] = {}

    def local(of: str) -> tuple:
        if of not in known:
            near = signs if of == text else _signs(of)
            known[of] = (_read_intervals(of), _read_effects(of, near), _read_subjects(of, near), _read_comparisons(of))
        return known[of]

    p_values = _read_p_values(text, signs) if tests else []
    for name, m in tests:
        groups, (start, end) = m.groupdict(), m.span()
        stat = _read_number(m["stat"])
        row = {"test": name, "raw": m[0], "statistic": stat, "df1": _read_number(groups.get("df1")), "df2": _read_number(groups.get("df2")), "start": start, "end": end, "p_values": _read_nearest(p_values, start, end)}
        if around:
            context = text[max(0, start - RADIUS) : end + RADIUS].strip()
            intervals_, effects_, people, compared = local(context)
            if name in OWN_EFFECT and stat is not None:
                own = {"type": (groups.get("type") or ("r" if name == "correlation" else name)).lower(), "value": stat}
                effects_ = effects_ if own in effects_ else [*effects_, own]
            people, compared = people or local(text)[2], compared or local(text)[3]
            lacks = {"p_value_or_ci": not row["p_values"] and not intervals_, "effect_size": not effects_ and name not in OWN_EFFECT, "subjects": not people, "comparison": not compared}
            missing = [k for k, lack in lacks.items() if lack]
            row |= {"confidence_intervals": intervals_, "effect_sizes": effects_, "sample_sizes": people, "comparisons": compared, "context": context, "missing_fields": missing, "needs_review": bool(missing)}
        yield row


def by_text(blocks: DataFrame, id_col: str, text: str, fields: str, read: Callable[[str], Iterator[dict]]) -> DataFrame:
    """id_col and `fields`, for each row that read gives of a text; texts are dealt out, however few files they come in. Nulls give none."""
    spark = blocks.sparkSession
    rows = blocks.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    dealt = rows.repartition(partitions(spark, spark.sparkContext.defaultParallelism), "_id", "_text")
    schema = StructType([rows.schema["_id"], *StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], {n: [] for n in arrow.names[1:]}
            for i, t in enumerate(b.column(1).to_pylist()):
                for row in read(t):
                    at.append(i)
                    for n, values in found.items():
                        values.append(row[n])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, arrow.field(n).type) for n, v in found.items())], names=arrow.names)

    return dealt.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def results(blocks: DataFrame, id_col: str, text: str, only: list[str] | None = None) -> DataFrame:
    """A row for each test statistic of a block of text, with what is found around it, and what is missing.

    id_col, test, raw, statistic, df1, df2, start, end, p_values (nearest first), confidence_intervals, effect_sizes,
    sample_sizes and comparisons (of the statistic's context, else of the block), context, missing_fields,
    needs_review; or id_col and the columns in `only`. A statistic that is an effect stands among its effect sizes.
    Null and empty texts give no rows."""
    names = only or [f.name for f in StructType.fromDDL(RESULT).fields]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(RESULT).fields if f.name in names]
    around = not {"test", "raw", "statistic", "df1", "df2", "start", "end", "p_values"}.issuperset(names)
    return by_text(blocks, id_col, text, ", ".join(fields), lambda t: _read_results(t, around)).select(id_col, *names)


def _read_flags(text: str) -> Iterator[dict]:
    none = True
    for row in _read_results(text):
        none = False
        if row["needs_review"]:
            yield {"reason": "partial_statistical_result", "missing_fields": row["missing_fields"]}
    low = text.lower()
    if none and any(phrase in low for phrase in RESULT_PHRASES):
        yield {"reason": "result_context_without_parseable_statistic", "missing_fields": ["statistical_test", "effect_size", "p_value_or_ci"]}


def review_flags(blocks: DataFrame, id_col: str, text: str) -> DataFrame:
    """id_col, reason, missing_fields: each partial result of a block, and blocks that speak of results but hold none that can be read."""
    return by_text(blocks, id_col, text, "reason string, missing_fields array<string>", _read_flags)


def repaired(rows: DataFrame) -> DataFrame:
    """rows (test, statistic, p_values, context and others) with numbers read again where blanks in the context had cut decimals.

    Rows whose context has no blank in a decimal stay. The match of the row's test nearest the context's middle gives
    statistic (null if it was 0 and is cut still) and the p-values near it; without any, p-values of 0 go."""
    c = F.col("context")
    middle = F.char_length(c) / 2
    none = F.lit(None).cast("struct<start:int,end:int,stat:string,incomplete:boolean>")
    pick = none
    for name, pattern in TESTS:
        found = F.transform(spans(c, pattern, _groups(pattern)), lambda s: F.struct(F.abs((s["start"] + s["end"]) / 2 - middle).alias("gap"), s["start"].alias("start"), s["end"].alias("end"), s["stat"].alias("stat"), s["incomplete"].alias("incomplete")))
        best = F.array_min(found)
        pick = F.when(F.col("test") == name, F.struct(best["start"].alias("start"), best["end"].alias("end"), best["stat"].alias("stat"), best["incomplete"].alias("incomplete"))).otherwise(pick)
    spaced = F.coalesce(c.rlike(r"[-+−]?(?:\d+\s*\.\s+\d+|\.\s+\d+)"), F.lit(False))
    rows = rows.withColumn("_m", pick).withColumn("_cut", F.coalesce(F.col("_m.incomplete") & ~F.contains("_m.stat", F.lit(".")), F.lit(False)))
    again = F.when(F.col("_cut"), F.when(F.col("statistic") != 0, F.col("statistic"))).otherwise(F.coalesce(number(F.col("_m.stat")), F.col("statistic")))
    near = F.when(F.col("_m.start").isNull(), p_values(c)).otherwise(nearest(p_value_spans(c), F.col("_m.start"), F.col("_m.end")))
    zero = F.exists("p_values", lambda p: p["value"] == 0)
    fresh = F.when(F.size(near) > 0, near).when(zero, F.slice("p_values", 1, 0)).otherwise(F.col("p_values"))
    return rows.withColumns({"statistic": F.when(spaced, again).otherwise(F.col("statistic")), "p_values": F.when(spaced, fresh).otherwise(F.col("p_values"))}).drop("_m", "_cut")


def metrics(text: Column) -> list[Column]:
    """Of a full text: effect_sizes (type, value), sample_sizes, confidence_intervals (level, lower, upper), p_values (operator, value), each as found, filtered to plausible values."""
    m = METRICS
    typed = lambda kind, value: F.struct(kind.alias("type"), value.alias("value"))
    pairs = lambda p: F.zip_with(_all(text, p, 1), _all(text, p, 2), lambda k, v: typed(F.lower(k), v.cast("double")))
    singles = lambda p, kind: F.transform(_all(text, p, 1), lambda v: typed(F.lit(kind), v.cast("double")))
    within = lambda rows, low, high: F.filter(rows, lambda s: s["value"].between(low, high))
    plain, hedges = within(pairs(m["d_or_g"]), -5, 5), within(singles(m["hedges"], "g"), -5, 5)
    effects_ = F.concat(plain, F.array_except(hedges, plain), within(singles(m["eta"], "eta_squared"), 0, 1), within(pairs(m["ratio"]), 0.01, 100))
    counts = lambda p: F.transform(_all(text, p, 1), lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("int"))
    sizes = F.concat(F.filter(counts(m["n"]), lambda n: n.between(10, 999_999) & ~n.between(1900, 2099)), F.filter(counts(m["total"]), lambda n: n.between(10, 999_999)))

    def bounds(p: str) -> Column:
        rows = F.transform(F.arrays_zip(*(_all(text, p, i).alias(n) for i, n in enumerate("abc", 1))), lambda s: F.struct(s["a"].cast("int").alias("level"), s["b"].cast("double").alias("lower"), s["c"].cast("double").alias("upper")))
        return F.filter(rows, lambda s: s["level"].isin(90, 95, 99) & (s["lower"] < s["upper"]))

    first = bounds(m["ci"])
    value = lambda v: F.when(~v.startswith("0") & ~F.contains(v, F.lit(".")), F.concat(F.lit("0."), v)).otherwise(v).try_cast("double")
    p = F.zip_with(_all(text, m["p"], 1), _all(text, m["p"], 2), lambda o, v: F.struct(o.alias("operator"), value(v).alias("value")))
    return [effects_.alias("effect_sizes"), sizes.alias("sample_sizes"), F.concat(first, F.array_except(bounds(m["ci_to"]), first)).alias("confidence_intervals"), F.filter(p, lambda s: (s["value"] > 0) & (s["value"] <= 1)).alias("p_values")]


def abstract_numbers(text: Column) -> list[Column]:
    """Of an abstract: paper_counts, percentages, kappa_values, ci_values (lower, upper), p_values (operator, value), correlations, generic_counts."""
    n = ABSTRACT_NUMBERS
    doubles = lambda name: F.transform(_all(text, n[name], 1), lambda v: v.cast("double")).alias(name)
    counts = lambda name: F.transform(_all(text, n[name], 1), lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("bigint")).alias(name)
    ci = F.zip_with(_all(text, n["ci_values"], 1), _all(text, n["ci_values"], 2), lambda a, b: F.struct(a.cast("double").alias("lower"), b.cast("double").alias("upper")))
    p = F.zip_with(_all(text, n["p_values"], 1), _all(text, n["p_values"], 2), lambda o, v: F.struct(o.alias("operator"), v.cast("double").alias("value")))
    return [counts("paper_counts"), doubles("percentages"), doubles("kappa_values"), ci.alias("ci_values"), p.alias("p_values"), doubles("correlations"), counts("generic_counts")]


#: Scale of x, y and z from Talairach to MNI, at and in front of the plane y = 0, and behind it.
FRONT, BACK = (1.0101, 1.0212, 1.0760), (1.0101, 1.0167, 1.0886)


#: Fixed value: three whole numbers in brackets.
TRIPLET = r"[\[(]\s*([-+−]?\d{1,3})\s*[,;]\s*([-+−]?\d{1,3})\s*[,;]\s*([-+−]?\d{1,3})\s*[\])]"


def talairach_to_mni(x: Column, y: Column, z: Column) -> list[Column]:
    """Piecewise scaling, to one decimal."""
    return [F.round(F.when(y >= 0, c * f).otherwise(c * k), 1) for c, f, k in zip((x, y, z), FRONT, BACK, strict=True)]


def coordinates(text: Column) -> Column:
    """(x, y, z) triplets in brackets within the brain's box, each once."""
    xs, ys, zs = (_all(text, TRIPLET, i) for i in (1, 2, 3))
    rows = F.transform(F.arrays_zip(xs.alias("a"), ys.alias("b"), zs.alias("c")), lambda s: F.struct(number(s["a"]).alias("x"), number(s["b"]).alias("y"), number(s["c"]).alias("z")))
    return F.array_distinct(F.filter(rows, lambda s: s["x"].between(-90, 90) & s["y"].between(-130, 90) & s["z"].between(-80, 110)))


def verdict(claim: Column, actual: Column, relative: float = 0.02, absolute: float = 2.0) -> Column:
    """PASS within 2 % or an absolute 2 of the actual number, FAIL beyond, WARN without one."""
    gap = F.abs(claim - actual)
    return F.when(actual.isNull(), "WARN").when((gap <= absolute) | (gap <= relative * F.abs(actual)), "PASS").otherwise("FAIL")


#: Characters before and behind a percentage in which words tell what it is of, and those words, first kinds first.
BEFORE, BEHIND = 80, 40
PERCENTAGES = {"criticality support": ["critical", "e/i", "excitat", "inhibit", "support"], "mechanism": ["mechanism", "gaba", "glutam", "gabaergic"], "agreement": ["agree", "concordan"]}


def number_checks(docs: DataFrame, id_col: str, text: str, actual: dict[str, Column]) -> DataFrame:
    """A row for each number of a report text, held against computed metrics: id_col, kind, start, claim, expected, expected_upper, actual, actual_upper, metric, status.

    actual gives columns of docs (or literals) by metric: papers, criticality support, mechanism, agreement, kappa, ci_lower and
    ci_upper, p, correlation, conditions; what is missing or null makes a check a WARN. A percentage is of the first metric whose
    words stand within BEFORE characters before it or BEHIND behind it. PASS is within 2 % or an absolute 2, for p-values
    claimed to be below a bound at or below it, for intervals at both ends. Null and empty texts have no numbers."""
    none = F.lit(None).cast("double")
    metric = {name: actual[name].cast("double") if name in actual else none for name in ("papers", *PERCENTAGES, "kappa", "ci_lower", "ci_upper", "p", "correlation", "conditions")}
    rows = docs.select(F.col(id_col), F.col(text).alias("_text"), *(c.alias(f"_m{i}") for i, c in enumerate(metric.values())))
    known = {name: F.col(f"_m{i}") for i, name in enumerate(metric)}
    plain = lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double")

    def entry(kind: str, groups: dict[str, int], build) -> Column:
        return F.transform(spans(F.col("_text"), ABSTRACT_NUMBERS[kind], groups), lambda s: build(kind, s))

    def check(kind: str, s: Column, value: Column, real: Column, name: Column, upper: Column = none, real_upper: Column = none, below: Column | None = None) -> Column:
        near = lambda x, y: F.coalesce((F.abs(x - y) <= 2.0) | (F.abs(x - y) <= 0.02 * F.abs(x)), F.lit(True))
        good = near(value, real) & near(upper, real_upper)
        if below is not None:
            good = F.when(below, real <= value).otherwise(good)
        status = F.when(real.isNull() | (upper.isNotNull() & real_upper.isNull()), "WARN").when(good, "PASS").otherwise("FAIL")
        named = [F.lit(kind).alias("kind"), s["start"].alias("start"), s["raw"].alias("claim"), value.alias("expected"), upper.alias("expected_upper"), real.alias("actual"), real_upper.alias("actual_upper"), name.alias("metric"), status.alias("status")]
        return F.struct(*named)

    def percentage(kind: str, s: Column) -> Column:
        low = F.greatest(F.lit(0), s["start"] - BEFORE)
        around = F.lower(F.substring(F.col("_text"), low + 1, s["end"] + BEHIND - low))
        name = F.lit(None).cast("string")
        real = none
        for what, words in reversed(PERCENTAGES.items()):
            there = F.contains(around, F.lit(words[0]))
            for w in words[1:]:
                there = there | F.contains(around, F.lit(w))
            name, real = F.when(there, what).otherwise(name), F.when(there, known[what]).otherwise(real)
        return check(kind, s, plain(s["v"]), real, name)

    def generic(kind: str, s: Column) -> Column:
        of = F.contains(F.lower(s["raw"]), F.lit("condition"))
        return check(kind, s, plain(s["v"]), F.when(of, known["conditions"]), F.when(of, "conditions"))

    simple = lambda name: lambda kind, s: check(kind, s, plain(s["v"]), known[name], F.lit(name))
    every = F.concat(
        entry("paper_counts", {"v": 1}, simple("papers")),
        entry("percentages", {"v": 1}, percentage),
        entry("kappa_values", {"v": 1}, simple("kappa")),
        entry("ci_values", {"v": 1, "w": 2}, lambda kind, s: check(kind, s, plain(s["v"]), known["ci_lower"], F.lit("interval"), plain(s["w"]), known["ci_upper"])),
        entry("p_values", {"op": 1, "v": 2}, lambda kind, s: check(kind, s, plain(s["v"]), known["p"], F.lit("p"), below=s["op"].isin("<", "≤"))),
        entry("correlations", {"v": 1}, simple("correlation")),
        entry("generic_counts", {"v": 1}, generic),
    )
    return exploded(rows.select(id_col, "_text", *(f"_m{i}" for i in range(len(metric)))), every, "c").select(id_col, "c.*")
