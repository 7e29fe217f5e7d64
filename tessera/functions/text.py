"""Text expressions: modality, sections, personal data, truncation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What names a modality family, in the order of priority.
MODALITY_PATTERNS = {
    "mri": r"\bmri\b|\bmr\b|\bmra\b|\bmagnetic\s+resonance\b|磁共振|核磁",
    "ct": r"\bct\b|\bcta\b|\bcomputed\s+tomography\b|计算机断层|电子计算机断层",
    "cxr": r"\bcxr\b|\bx[-\s]?ray\b|\bxray\b|\bxr\b|\bcr\b|\bdx\b|\bradiograph(?:y)?\b|\bchest\s+film\b|胸片|胸部平片|x线|x光",
}
#: Section names with their weights and headings.
SECTION_WEIGHTS = {"findings": 0.55, "impression": 0.35, "clinical_history": 0.10}
SECTION_HEADINGS = {
    "findings": ("findings", "finding", "检查所见", "影像所见", "所见"),
    "impression": ("impression", "诊断意见", "印象", "结论"),
    "clinical_history": ("clinical history", "history", "临床资料", "病史"),
}
#: Categories of personal data and what gives them away.
PERSONAL_DATA = {
    "chinese_clinical_identifier": r"(?iU)(?:姓名|住院号|门诊号|身份证(?:号)?|影像号|检查号|床号|电话|手机号|联系电话|报告医生|审核医生)\s*[:：]\s*[^\s,，;；]+",
    "phone_number": r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)",
    "email_address": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "cn_national_id": r"(?<!\d)\d{17}[0-9Xx](?!\d)",
    "calendar_date": r"(?<!\d)(?:19|20)\d{2}(?:[-/.年])\d{1,2}(?:[-/.月])\d{1,2}日?(?!\d)",
    "dicom_uid": r"(?<!\d)\d+(?:\.\d+){4,}(?!\d)",
    "server_absolute_path": r"(?U)(?<![A-Za-z0-9])/(?:data|nfsdata[^/]*|home|tmp|var|opt|private)(?:/[^\s,，;；]+)+",
    "privacy_canary": r"(?i)PATIENT_CANARY_[A-Z0-9_-]+",
}
#: Where the clinical sections of a report begin and what ends them.
CLINICAL_START = r"(?iU)(?:^|\n)\s*[*#_\-]*\s*(?:检查所见|影像所见|所见|findings?)\s*[:：]"
CLINICAL_END = r"(?iU)(?:^|\n)\s*[*#_\-]*\s*(?:报告医生|审核医生|审核时间|打印时间|注\s*[:：]|PATIENT_CANARY_[A-Z0-9_-]+)"


def squeezed(x: Column) -> Column:
    """Lower case, with single spaces between words and none around."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def modality(value: Column) -> Column:
    """mri, ct or cxr by the first family named; else the value's letters and digits; ``unknown`` without any."""
    raw = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    compact = F.regexp_replace(raw, "[^a-z0-9]+", "")
    out = F.when(raw.isNull() | (raw == ""), "unknown")
    for name, pattern in MODALITY_PATTERNS.items():
        out = out.when(raw.rlike(f"(?U)(?:{pattern})"), name)
    return out.when(compact == "", "unknown").otherwise(compact)


def sections(text: Column) -> Column:
    """A map from section to its text. Repeated sections are joined by a line break, text before the first heading is
    ``other``, and a text without headings is all findings."""
    heads = sorted((h for hs in SECTION_HEADINGS.values() for h in hs), key=len, reverse=True)
    heading = rf"(?:{'|'.join(heads)})"
    whole = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    parts = F.split(whole, rf"(?im)^(?=\s*{heading}\s*[:：])")
    titled = rf"(?is)^\s*({heading})\s*[:：]\s*(.*)$"
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    named = F.transform(parts, lambda p: F.struct(F.lower(F.regexp_extract(p, titled, 1)).alias("head"), strip(F.when(p.rlike(titled), F.regexp_extract(p, titled, 2)).otherwise(p)).alias("body")))
    none = ~F.exists(named, lambda n: n["head"] != "")
    entry = lambda name, keep: F.array_join(F.transform(F.filter(named, lambda n: keep(n) & (n["body"] != "")), lambda n: n["body"]), "\n")
    out = []
    for name, hs in SECTION_HEADINGS.items():
        found = entry(name, lambda n, hs=hs: n["head"].isin(*hs))
        out += [F.lit(name), F.when(none, whole if name == "findings" else F.lit("")).otherwise(found)]
    out += [F.lit("other"), F.when(none, F.lit("")).otherwise(entry("other", lambda n: n["head"] == ""))]
    return F.create_map(*out)


def structure_score(parts: Column) -> Column:
    """The weights of the sections that have text, in hundredths as an integer, so that engines agree."""
    return sum((F.when(F.coalesce(parts[name], F.lit("")) != "", round(w * 100)).otherwise(0) for name, w in SECTION_WEIGHTS.items()), F.lit(0))


def personal_data(text: Column) -> Column:
    """The categories of personal data found, in their fixed order."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), name) for name, p in PERSONAL_DATA.items())))


def redacted(text: Column) -> Column:
    for name, pattern in PERSONAL_DATA.items():
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def clinical_only(text: Column) -> Column:
    """From the first heading of findings, or else all, up to the first line of physicians, times or notes."""
    begun = F.regexp_replace(text, rf"(?s)\A.*?({CLINICAL_START}.*)\z", "$1")
    return F.regexp_replace(begun, rf"(?s){CLINICAL_END}.*\z", "")


def deidentified(text: Column) -> Column:
    """The clinical sections with personal data masked, without blank lines and spaces at the ends of lines."""
    lines = F.transform(F.split(redacted(clinical_only(text)), r"\R"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return F.regexp_replace(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), r"(?U)^\s+", "")


def deterministic_likert(text: Column, parts: Column) -> Column:
    """3, one more from 20 tokens on, one more with findings and impression; 1 for a blank text; at most 5."""
    blank = F.coalesce(F.regexp_replace(text, r"(?U)\s+", ""), F.lit("")) == ""
    tokens = F.size(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+"))
    both = (parts["findings"] != "") & (parts["impression"] != "")
    return F.when(blank, 1).otherwise(3 + (tokens >= 20).cast("int") + both.cast("int"))


def bounded(text: Column, limit: int = 12_000, marker: str = "\n[...]\n") -> Column:
    """The head and tail of a text of more than ``limit`` characters, with a marker between."""
    half = (limit - len(marker)) // 2
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, half), F.lit(marker), F.substring(text, -half, half)))


def character_error_rate(gold: Column, candidate: Column) -> Column:
    """Edits per character of the gold text, spaces left out; an empty gold text counts as one character."""
    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    return F.levenshtein(bare(gold), bare(candidate)) / F.greatest(F.char_length(bare(gold)), F.lit(1))


_CLINICAL_HEADING = re.compile(r"(?:findings?|impression|conclusion|clinical\s+history|history|所见|影像所见|印象|诊断意见|诊断结论|临床资料|病史)\s*[:：]", re.I)
_HISTORY = {"clinical history", "history", "临床资料", "病史"}


def clinical_bare(text: str) -> str:
    """The texts of the clinical sections but the history (all without one) in NFKC, without white space."""
    heads = list(_CLINICAL_HEADING.finditer(text))
    found = []
    for m, end in zip(heads, [*(m.start() for m in heads[1:]), len(text)]):
        body = text[m.end() : end].strip()
        if body and m[0].split(":", 1)[0].strip().lower().replace("：", "") not in _HISTORY:
            found.append(body)
    return "".join(unicodedata.normalize("NFKC", "\n".join(found) if found else text).split())


@F.pandas_udf(StringType())
def clinical_letters(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else clinical_bare(x))


def clinical_error_rate(gold: Column, candidate: Column) -> Column:
    """Edits per character of the gold text's clinical sections; an empty one counts as one character."""
    a, b = clinical_letters(gold), clinical_letters(candidate)
    return F.levenshtein(a, b) / F.greatest(F.char_length(a), F.lit(1))


def tokens(text: Column) -> Column:
    """The distinct words of 3 characters or more in lower case, and 3- to 6-grams of runs of Chinese characters."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+|[\u4e00-\u9fff]+"), F.lit(0))
    grams = lambda r: F.flatten(F.transform(F.sequence(F.lit(3), F.least(F.lit(6), F.char_length(r))), lambda n: F.transform(F.sequence(F.lit(1), F.char_length(r) - n + 1), lambda i: F.substr(r, i, n))))
    expanded = F.transform(F.filter(runs, lambda r: F.char_length(r) >= 3), lambda r: F.when(r.rlike("^[\u4e00-\u9fff]"), grams(r)).otherwise(F.array(r)))
    return F.array_distinct(F.flatten(expanded))


def section_order(text: Column) -> Column:
    """The sections in the order of their first headings; of a text without headings those with text."""
    names = F.create_map(*(F.lit(x) for name, hs in SECTION_HEADINGS.items() for h in hs for x in (h, name)))
    heads = "|".join(sorted((h for hs in SECTION_HEADINGS.values() for h in hs), key=len, reverse=True))
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?imU)^\s*({heads})\s*[:：]"), F.lit(1)), lambda h: names[F.lower(h)]))
    plain = F.when(F.trim(text) != "", F.array(F.lit("findings"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(plain)


def section_deltas(a: Column, b: Column) -> Column:
    """A map from section to its characters and words in two maps of ``sections``, and what the second has more."""
    chars = lambda parts, name: F.char_length(F.coalesce(parts[name], F.lit("")))
    words = lambda parts, name: F.size(F.regexp_extract_all(F.coalesce(parts[name], F.lit("")), F.lit(r"(?U)\b\w+\b"), F.lit(0)))
    out = []
    for name in (*SECTION_WEIGHTS, "other"):
        c, w = [chars(x, name) for x in (a, b)], [words(x, name) for x in (a, b)]
        out += [F.lit(name), F.struct(c[0].alias("chars_a"), c[1].alias("chars_b"), (c[1] - c[0]).alias("chars_delta"), w[0].alias("words_a"), w[1].alias("words_b"), (w[1] - w[0]).alias("words_delta"))]
    return F.create_map(*out)


def missing_sections(parts: Column) -> Column:
    """A warning for each weighted section without text, in the order of the weights."""
    return F.array_compact(F.array(*(F.when(F.coalesce(parts[name], F.lit("")) == "", f"missing_{name}") for name in SECTION_WEIGHTS)))


def privacy_scan(text: Column) -> Column:
    """A struct of the categories found, whether the text may be passed on, and an id of the scan (16 hex digits of text and finding)."""
    found = personal_data(F.coalesce(text, F.lit("")))
    scan = F.substring(F.sha2(F.concat_ws("|", F.coalesce(text, F.lit("")), F.array_join(found, ",")), 256), 1, 16)
    return F.struct(found.alias("categories"), (F.size(found) == 0).alias("allowed"), scan.alias("scan_id"))
