"""Controlled concepts: evidence in its report, codes, concepts, negation and anatomy.

The concepts are a parameter: a small dimension that is planned as one literal, so that a row meets all its spellings inside the
JVM. Normalised text has single spaces between words, so a spelling stands there as whole words exactly when the padded text
contains the padded spelling; spellings in Chinese characters may stand anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = r"(?U)[\s\x1c-\x1f]"
UNMAPPED = "other_finding"
#: Observations that name nothing, and concepts that give way to any other.
GENERIC_OBSERVATIONS = ("finding", "normal", "observation", "reported finding")
BROAD_CONCEPTS = ("cardiopulmonary_abnormality",)
#: What negates a mention that follows in its clause, and what starts a new clause.
NEGATION = re.compile(
    r"(?:\b(?:no|without|negative for|no evidence of|absent|free of|not seen|not identified|cannot identify)\b|未见|无|未发现|未提示)", re.I
)
CONTRAST = re.compile(r"(?:\b(?:but|however|yet|nevertheless|though)\b|但是|但|然而|不过|而|却)", re.I)
CLAUSE_END = re.compile(r"[。.；;\n]")
#: Names of anatomy by canonical name.
ANATOMY = {
    "lung": ("bilateral lung", "bilateral lungs", "both lung", "both lungs", "lung", "lungs", "pulmonary"),
    "pleura": ("bilateral pleura", "pleura", "pleural", "pleural space"),
    "heart": ("cardiac", "cardiomediastinal", "cardiomediastinum", "heart"),
    "mediastinum": ("mediastinal", "mediastinum"),
    "trachea": ("trachea", "tracheal"),
    "pulmonary_hilum": ("hila", "hilum", "pulmonary hila", "pulmonary hilum"),
    "aorta": ("aorta", "aortic"),
    "diaphragm": ("diaphragm", "diaphragmatic", "diaphragms"),
    "bone": ("bone", "bones", "osseous"),
    "thoracic_cage": ("bony thorax", "thoracic cage"),
    "device": ("device", "devices", "line", "lines"),
    "cardiopulmonary": ("cardiopulmonary", "chest", "thorax"),
}


@dataclass(frozen=True)
class Concept:
    """A code, its anatomy, the spellings of the finding, and the statements that it is not there."""

    code: str
    anatomy: str
    aliases: tuple[str, ...] = ()
    normal: tuple[str, ...] = ()


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", "")


def normalized(x: Column) -> Column:
    """Lower-case words of letters and digits with single spaces between them; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _normal_form(alias: str) -> str:
    return re.sub(r"[\W_]+", " ", alias.lower()).strip()


def evidence_span(report: Column, requested: Column) -> Column:
    """A struct of start, end (from 0, end excluded) and the text in the report; null if the evidence is not there.

    Evidence is looked for as it is (without space around), then with all white space left out of both. Blank evidence stands
    at 0. The position list is only made for rows without an exact match.
    """
    bare, wanted = F.regexp_replace(report, _SPACE, ""), _stripped(requested)
    at, loose = F.instr(report, wanted), F.instr(bare, F.regexp_replace(wanted, _SPACE, ""))
    letters = F.regexp_extract_all(report, F.lit("(?s)(.)"), F.lit(1))
    places = F.array_compact(F.transform(letters, lambda c, i: F.when(~c.rlike(f"^{_SPACE}$"), i)))
    last = loose + F.char_length(F.regexp_replace(wanted, _SPACE, "")) - 1
    span = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.substring(report, start + 1, end - start).alias("text"))
    exact = span(at - 1, at - 1 + F.char_length(wanted))
    return F.when(at > 0, exact).when(loose > 0, span(F.element_at(places, loose), F.element_at(places, last) + 1))


def ungrounded(laterality: Column, anatomy: Column, location: Column, measurements: Column, evidence: Column) -> Column:
    """The reasons why a finding does not agree with its evidence: its side against its place, a measurement that is not there.

    ``measurements`` is an array of (value double, unit string); units are mm and cm, and their Chinese names count as well.
    """
    place = F.lower(F.concat_ws(" ", anatomy, location))
    says = lambda *words: F.coalesce(place.rlike("|".join(words)), F.lit(False))
    conflict = ((laterality == "left") & says("right", "右")) | ((laterality == "right") & says("left", "左"))

    def missing(m: Column) -> Column:
        number = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", m["value"]), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        unit = F.when(m["unit"] == "mm", "(?:mm|毫米)").otherwise("(?:cm|厘米)")
        pattern = F.concat(F.lit(r"(?i)(?<![\d.])"), F.replace(number, F.lit("."), F.lit(r"\.")), F.lit(r"(?:\.0+)?\s*"), unit, F.lit("(?![A-Za-z])"))
        return ~F.coalesce(F.regexp_like(evidence, pattern), F.lit(False))

    unseen = F.exists(F.coalesce(measurements, F.array().cast("array<struct<value:double,unit:string>>")), missing)
    return F.array_compact(F.array(F.when(conflict, "laterality_conflict"), F.when(unseen, "measurement_not_in_evidence")))


def code_slug(code: Column, text: Column) -> Column:
    """A code in lower case with ``_`` for spaces and hyphens, from the text if there is no code; else ``reported_finding``."""
    value = F.lower(_stripped(F.coalesce(F.nullif(code, F.lit("")), text, F.lit(""))))
    slug = F.regexp_replace(F.regexp_replace(value, r"[^\p{L}\p{N}_\s-]", " "), r"(?U)[-\s]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^_+|_+$", ""), F.lit("")), F.lit("reported_finding"))


def spellings(concepts: Sequence[Concept]) -> list[tuple[str, str, bool]]:
    """(normalised spelling, code, whether it states that nothing is there), longest first, then in order."""
    found = set()
    for c in concepts:
        if c.code != UNMAPPED:
            found |= {(_normal_form(a), c.code, False) for a in (*c.aliases, c.code)} | {(_normal_form(a), c.code, True) for a in c.normal}
    return sorted((f for f in found if f[0]), key=lambda f: (-len(f[0]), f))


def alias_table(spark: SparkSession, concepts: Sequence[Concept]) -> DataFrame:
    """The compiled spellings as a table: spelling, code, normal, length and priority (from 1, in the order they are tried)."""
    rows = [(s, c, n, len(s), i) for i, (s, c, n) in enumerate(spellings(concepts), 1)]
    return spark.createDataFrame(rows, "spelling string, code string, normal boolean, length int, priority int")


def _resolved(value: Column, table: Column) -> Column:
    hits = F.filter(table, lambda s: F.contains(F.concat(F.lit(" "), value, F.lit(" ")), s["needle"]))
    return F.array_max(F.transform(hits, lambda s: F.struct(s["length"].alias("length"), s["normal"].alias("normal"), s["code"].alias("code"))))


def concept(code: Column, text: Column, evidence: Column, concepts: Sequence[Concept]) -> Column:
    """A struct of the concept's code and how it was found: canonical, normal or unmapped.

    In each field the longest spelling wins, then a normal statement, then the last code. The fields are tried in order, the
    first two not if they name nothing; a broad concept only stands if no field names another.
    """
    padded = lambda s: s if re.search("[一-鿿]", s) else f" {s} "
    known = spellings(concepts)
    entry = "array<struct<needle:string,length:int,normal:int,code:string>>"
    table = F.array(*(F.struct(F.lit(padded(s)).alias("needle"), F.lit(len(s)).alias("length"), F.lit(int(n)).alias("normal"), F.lit(c).alias("code")) for s, c, n in known)).cast(entry)
    values = [normalized(x) for x in (code, text, evidence)]
    hits = [F.when(~v.isin(*GENERIC_OBSERVATIONS), _resolved(v, table)) for v in values[:2]] + [_resolved(values[2], table)]
    every = F.array_compact(F.array(*hits))
    broad = lambda h: h["code"].isin(*BROAD_CONCEPTS)
    exact, wide = F.filter(every, lambda h: ~broad(h)), F.filter(every, broad)
    last_normal = F.get(F.reverse(F.filter(wide, lambda h: h["normal"] == 1)), F.lit(0))
    best = F.coalesce(F.get(exact, F.lit(0)), last_normal, F.get(wide, F.lit(0)))
    kind = F.when(best.isNull(), "unmapped").when(best["normal"] == 1, "normal").otherwise("canonical")
    return F.struct(F.coalesce(best["code"], F.lit(UNMAPPED)).alias("code"), kind.alias("matched_as"))


def _pattern(alias: str) -> str:
    words = r"\s+".join(map(re.escape, alias.split()))
    return rf"(?<!\w){words}(?!\w)" if alias.isascii() else words


def all_negated(text: str, patterns: Sequence[re.Pattern[str]]) -> bool:
    """Whether the text has mentions, and each follows a negation in its own clause."""
    found = False
    for pattern in patterns:
        for m in pattern.finditer(text):
            clause = CONTRAST.split(CLAUSE_END.split(text[: m.start()])[-1])[-1]
            if not NEGATION.search(clause):
                return False
            found = True
    return found


def negated(evidence: Column, code: Column, concepts: Sequence[Concept]) -> Column:
    """Whether all mentions of the code's concept in the evidence are negated (Arrow batches); false without mentions or text."""
    patterns = {
        c.code: [re.compile(_pattern(a), re.I) for a in {c.code.replace("_", " "), *c.aliases, *c.normal} if a.strip()] for c in concepts
    }

    @F.pandas_udf("boolean")
    def check(texts: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([all_negated(t, patterns.get(c, ())) if isinstance(t, str) else False for t, c in zip(texts, codes)], dtype=bool)

    return check(evidence, code)


def anatomy(name: Column, default: Column) -> Column:
    """The canonical anatomy; unknown names stay as they are; a blank one becomes the default, or null if that is unspecified."""
    known = F.create_map(*(F.lit(x) for canonical, names in ANATOMY.items() for n in names for x in (n, canonical)))
    blank = F.coalesce(_stripped(name), F.lit("")) == ""
    return F.when(blank, F.nullif(default, F.lit("unspecified"))).otherwise(F.coalesce(F.try_element_at(known, normalized(name)), _stripped(name)))


def canonical_findings(findings: DataFrame, concepts: Sequence[Concept]) -> DataFrame:
    """Findings (observation_code, observation_text, evidence, anatomy_code, certainty) with concept, matched_as and anatomy.

    A normal statement, or evidence that negates all mentions, makes a finding absent. Unmapped findings keep their slug.
    """
    out = findings.withColumn("__c", concept(F.col("observation_code"), F.col("observation_text"), F.col("evidence"), concepts))
    places = F.create_map(*(F.lit(x) for c in concepts for x in (c.code, c.anatomy))) if concepts else F.create_map().cast("map<string,string>")
    code, kind = F.col("__c")["code"], F.col("__c")["matched_as"]
    out = out.withColumns({"concept": code, "matched_as": kind, "slug": code_slug(F.col("observation_code"), F.col("observation_text"))})
    out = out.withColumn("negated", negated(F.col("evidence"), F.col("concept"), concepts))
    absent = (F.col("matched_as") == "normal") | F.col("negated")
    place = anatomy(F.col("anatomy_code"), F.coalesce(F.try_element_at(places, F.col("concept")), F.lit("unspecified")))
    return out.withColumns({"certainty": F.when(absent, "absent").otherwise(F.col("certainty")), "anatomy": place}).drop("__c")
