"""Quality of a text as a report: whether it was cut off, what is not part of it, what may leave the house."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import modality, personal_data

_LINE_END = r"(?:\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029])"
#: Last lines of metadata after which a report is complete, and words that may end one.
_STAMP = r"(?:审核时间|检查时间)\s*[:：]\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?\s*$"
_SIGNED = r"^(?:报告医生|审核医生|检查医生)\s*[:：]\s*[一-鿿A-Za-z][一-鿿A-Za-z· ]{0,39}$"
_LAST_WORDS = ("stable", "normal", "negative")
#: What starts a model's commentary or a vendor's footer.
COMMENTARY = (
    "the image provided", "the image you've provided", "the provided image", "the image you provided", "appears to be blank",
    "unable to transcribe", "unable to read", "i'm unable", "im unable", "there is", "contains no visible text",
    "no radiology report visible", "if you intended to upload", "please re-upload the image", "图像为空", "未见可识别的报告文字",
    "万里云", "wanlicloud", "阿里云", "alibaba cloud", "提供技术支持", "了解详情",
)
#: Terms of another modality's reports.
FOREIGN_TERMS = {
    "mri": ("radiograph", "x-ray", "xray", "computed tomography", "ct"),
    "ct": ("radiograph", "x-ray", "xray", "magnetic resonance", "mri"),
    "cxr": ("computed tomography", "ct", "magnetic resonance", "mri"),
}

#: Terms of other parts of the body than the one a report is of.
FOREIGN_BODY_TERMS = {
    "brain": ("hip", "femoral", "femur", "pelvis", "liver", "kidney", "spleen", "lung", "chest", "胸部", "双肺", "肺部", "右肺", "左肺"),
    "head": ("hip", "femoral", "femur", "pelvis", "liver", "kidney", "spleen", "lung", "chest", "胸部", "双肺", "肺部", "右肺", "左肺"),
    "chest": ("hip", "femoral", "femur", "liver", "kidney", "spleen", "brain"),
    "abdomen": ("hip", "femoral", "femur", "brain"),
}
#: What makes a sentence a recommendation, the examinations it may name, where sentences end, and phrases of advice.
ADVICE_CUES = ("consider", "recommend", "follow", "further", "建议", "必要时", "进一步", "随诊", "评估")
EXAMINATIONS, EXAMINATIONS_ZH = ("ct", "mri", "computed tomography", "magnetic resonance"), ("核磁", "磁共振")
SENTENCE_ENDS = "。.!?；;"
ADVICE = (
    r"\bconsider\s+(?:a\s+|an\s+)?(?:ct|mri|computed tomography|magnetic resonance)\b",
    r"\brecommend(?:ed|s|ing)?\s+(?:a\s+|an\s+)?(?:follow[- ]?up\s+)?(?:ct|mri|computed tomography|magnetic resonance)\b",
    r"\bfurther\s+(?:ct|mri|computed tomography|magnetic resonance)\b",
    r"\b(?:ct|mri)\s+if\b",
    r"\be\.g\.,?\s*(?:ct|mri|computed tomography|magnetic resonance)\b",
)


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def looks_truncated(text: Column) -> Column:
    """Whether a text seems to be cut off: null or blank, without an end mark and under 8 characters, or ending inside a word.

    A last line that states a time or a physician, and the words that close many reports, are complete.
    """
    body = stripped(F.coalesce(text, F.lit("")))
    last = stripped(F.element_at(F.split(body, _LINE_END), -1))
    whole = last.rlike(_STAMP) | last.rlike(_SIGNED) | F.lower(body).rlike(rf"(?:{'|'.join(_LAST_WORDS)})\z")
    ended = body.rlike(r"[。！？.!?)\]】}」』”\"']\z")
    return F.when(body == "", True).when(ended, False).when(F.char_length(body) < 8, True).when(body.rlike(r"[A-Za-z0-9]\z"), ~whole).otherwise(False)


def without_commentary(text: Column) -> Column:
    """The text up to the first mark of commentary, stripped, with ``\\n`` between its lines; without a mark only stripped.
    Null and blank texts give an empty one."""
    marks = rf"(?iu)(?:{'|'.join(COMMENTARY)})"
    kept = F.regexp_replace(F.regexp_replace(text, rf"(?s){marks}.*\z", ""), _LINE_END, "\n")
    return stripped(F.coalesce(F.when(text.rlike(marks), kept).otherwise(text), F.lit("")))


def _standing(terms: tuple[str, ...]) -> str:
    """A pattern of the terms as words of their own."""
    return rf"(?<![a-z0-9])(?:{'|'.join(terms)})(?![a-z0-9])"


def without_advice(text: Column) -> Column:
    """A text in lower case in which the examinations that it recommends are no longer named."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), rf"(?<=[{SENTENCE_ENDS}])")
    advised = lambda x: x.rlike("|".join(ADVICE_CUES)) & x.rlike("|".join((*EXAMINATIONS, *EXAMINATIONS_ZH)))
    masked = lambda x: F.regexp_replace(F.regexp_replace(x, _standing(EXAMINATIONS), " followup imaging "), "|".join(EXAMINATIONS_ZH), "followup imaging")
    body = F.array_join(F.transform(parts, lambda x: F.when(advised(x), masked(x)).otherwise(x)), "")
    for pattern in ADVICE:
        body = F.regexp_replace(body, pattern, " followup imaging ")
    return body


def _terms_in(body: Column, key: Column, terms: dict[str, tuple[str, ...]]) -> Column:
    out = F.array().cast("array<string>")
    for name, words in terms.items():
        found = F.array_compact(F.array(*(F.when(body.rlike(_standing((w,))), w) for w in words)))
        out = F.when(key == name, found).otherwise(out)
    return out


def foreign_terms(text: Column, kind: Column) -> Column:
    """The terms of other modalities that stand in the text as words, without recommendations of another examination."""
    return _terms_in(without_advice(text), kind, FOREIGN_TERMS)


def foreign_body_terms(text: Column, body_part: Column) -> Column:
    """The terms of other parts of the body that stand in the text as words."""
    return _terms_in(F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(body_part, F.lit(""))), FOREIGN_BODY_TERMS)


def quality_gate(text: Column, kind: Column, body_part: Column) -> Column:
    """A struct of passed, warnings and the conflicting terms. Only another modality blocks; another body part is a warning."""
    parts, kinds = foreign_body_terms(text, body_part), foreign_terms(text, kind)
    warnings = F.array_compact(F.array(F.when(F.size(parts) > 0, "body_part_mismatch"), F.when(F.size(kinds) > 0, "modality_mismatch")))
    return F.struct((F.size(kinds) == 0).alias("passed"), warnings.alias("warnings"), parts.alias("body_terms"), kinds.alias("modality_terms"))


def payload_block(text: Column, classification: Column, has_image: Column, allowed: list[str], images: bool = False) -> Column:
    """Why a payload may not go to an outside service: its class, an image, personal data; null if it may."""
    found = personal_data(F.coalesce(text, F.lit("")))
    return (
        F.when(~F.coalesce(classification.isin(*allowed), F.lit(False)), "classification_not_allowed").when(has_image & F.lit(not images), "image_blocked")
        .when(F.size(found) > 0, F.concat(F.lit("personal_data:"), F.array_join(F.array_sort(found), ",")))
    )


def filename_modality(path: Column) -> Column:
    """cxr if the file's name says so in a word of its own; else null."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    words = F.split(F.regexp_replace(F.lower(stem), "[- ]", "_"), "_")
    has = lambda *w: F.arrays_overlap(words, F.array(*map(F.lit, w)))
    chest = has("chest") & has("x") & has("ray")
    return F.when(has("cxr", "xray", "radiograph", "radiography") | chest, "cxr")


def recognised_modality(header: Column, path: Column, judged: Column) -> Column:
    """modality and where it is from: the header's, else the file name's, else the judge's, else unknown."""
    known = lambda c: F.when(modality(c).isin("ct", "mri", "cxr"), modality(c))
    name = F.coalesce(known(header), filename_modality(path), known(judged), F.lit("unknown"))
    source = F.when(known(header).isNotNull(), "header").when(filename_modality(path).isNotNull(), "filename").when(known(judged).isNotNull(), "judge").otherwise("none")
    return F.struct(name.alias("modality"), source.alias("source"))
