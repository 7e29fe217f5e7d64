"""Expressions over single values: JSON, digests, names, addresses, delays, and rules over one record."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.numbers import finite

#: Words for certainty, by the finding's own field and by an older record's.
ABSENT, UNCERTAIN = ("absent", "negative", "negated"), ("uncertain", "possible", "indeterminate", "suspected")
OLD_ABSENT, OLD_UNCERTAIN = ("absent", "negative", "negated", "no", "none"), ("uncertain", "possible", "probable", "equivocal", "indeterminate")
#: Series names in the order they are looked for.
SEQUENCES = ("DWI", "ADC", "T2-FLAIR", "FLAIR", "T2WI", "T1WI", "SWI")
SIDES = ("left", "right", "bilateral", "midline")
#: Parts of the body by their names in a header.
BODY_PARTS = {"CHEST": "chest", "LUNG": "chest", "ABDOMEN": "abdomen", "HEAD": "head", "BRAIN": "brain", "PELVIS": "pelvis"}
#: What a file's name ends in if a value is a path to a text, and the longest wait a server may ask for.
TEXT_SUFFIXES, LONGEST_DELAY = (".txt", ".md", ".json", ".pdf"), 300.0
#: Bookkeeping fields that are no metrics.
BOOKKEEPING = ("model", "model_key", "source", "warnings", "metadata", "provenance", "evidence_tier")


def plain(x: Column) -> Column:
    """In lower case with single spaces; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+", " "))


def first_filled(*values: Column) -> Column:
    """The first value that is not null or empty."""
    return F.coalesce(*(F.nullif(v.cast("string"), F.lit("")) for v in values))


# JSON -----------------------------------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def canonical_json(value: pd.Series) -> pd.Series:
    """JSON with sorted keys, no spaces and its letters as they are; null if it is no JSON."""

    def canonical(x: str | None) -> str | None:
        try:
            return json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return value.map(canonical)


def stable_sha256(value: Column) -> Column:
    """The digest of a JSON value that does not depend on the order of its keys."""
    return F.sha2(canonical_json(value), 256)


def json_object(raw: Column) -> Column:
    """The JSON object in an answer: the answer, the inside of its code fence, or what lies from its first to its last brace.

    Null if that is no JSON or no object.
    """
    text = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    text = F.coalesce(F.nullif(F.regexp_extract(text, r"(?is)^```(?:json)?\s*\n?(.*?)\n?```$", 1), F.lit("")), text)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    whole = F.try_parse_json(text)
    part = F.try_parse_json(F.nullif(inner, F.lit("")))
    found = F.when(whole.isNotNull(), whole).otherwise(part)
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), F.to_json(found))


def nested(value: Column, path: str, kind: str, default=None) -> Column:
    """The value at a path of a JSON text, if it is there and of that kind; else the default."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(value), path, kind), F.lit(default).cast(kind))


@F.pandas_udf(StringType())
def schema_shape(value: pd.Series) -> pd.Series:
    """A JSON value with each text, number and truth value replaced by one of its kind, and lists cut to their first entry's shape."""

    def shape(x):
        if isinstance(x, dict):
            return {k: shape(v) for k, v in x.items()}
        if isinstance(x, list):
            return [shape(x[0])] if x else []
        return False if isinstance(x, bool) else 0 if isinstance(x, (int, float)) else None if x is None else "<string>"

    def of(text: str | None) -> str | None:
        try:
            return json.dumps(shape(json.loads(text)), ensure_ascii=False, sort_keys=True)
        except (TypeError, ValueError):
            return None

    return value.map(of)


def filled(options: Column) -> Column:
    """A map without its null and empty values."""
    return F.map_filter(options, lambda _, v: v.isNotNull() & (v != ""))


SECRET = r"(?i)key|token|secret|password|authorization|credential"


@F.pandas_udf(StringType())
def without_secrets(value: pd.Series) -> pd.Series:
    """A JSON value whose fields with the name of a secret are masked, at every depth."""
    secret = re.compile(SECRET)

    def masked(x):
        if isinstance(x, dict):
            return {k: "***" if secret.search(k) else masked(v) for k, v in x.items()}
        return [masked(v) for v in x] if isinstance(x, list) else x

    return value.map(lambda x: None if x is None else json.dumps(masked(json.loads(x)), ensure_ascii=False, sort_keys=True))


def without_digests(value: Column, fields: tuple[str, ...] = ("source_case_sha256",)) -> Column:
    """A JSON text in which the values of fields that hold digests are masked, so that no scan takes them for numbers of people."""
    return F.regexp_replace(value, rf'("(?:{"|".join(fields)})"\s*:\s*)"[^"]*"', '$1"[opaque]"')


@F.pandas_udf(StringType())
def fingerprint(value: pd.Series) -> pd.Series:
    """The first 16 hex digits of the digest of a text."""
    return value.map(lambda x: None if x is None else hashlib.sha256(x.encode()).hexdigest()[:16])


def route_fingerprint(provider: Column, model: Column, endpoint: Column, options: Column) -> Column:
    """The digest of what decides an answer of a model: provider, model, canonical endpoint and the filled options."""
    fields = F.struct(provider.alias("provider"), model.alias("model"), endpoint_url(endpoint).alias("endpoint"), filled(options).alias("options"))
    return stable_sha256(F.to_json(fields))


# Names, texts and addresses -------------------------------------------------------------------------------------------


def safe_component(value: Column) -> Column:
    """A name that a path may have; ``unknown`` if nothing is left."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("unknown"))


def safe_error(message: Column) -> Column:
    """The last 2000 characters of a message without what follows the name of a credential."""
    masked = F.regexp_replace(message, r"(?i)(authorization|api[_ -]?key|bearer)[^,;\n]*", "$1=<redacted>")
    return F.substring(masked, -2000, 2000)


def endpoint_url(url: Column) -> Column:
    """Scheme, host, port and path of an address, in lower case up to the path; empty without scheme or host."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")
    host, port = F.lower(F.regexp_extract(place, r"^([^:]*)", 1)), F.regexp_extract(place, r":(\d+)$", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    found = F.concat(scheme, F.lit("://"), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), path)
    return F.when((scheme != "") & (host != ""), found).otherwise("")


def signature(*parts: Column) -> Column:
    """Parts joined by bars, null as empty."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def is_text_path(value: Column) -> Column:
    """Whether a value names a file with a text rather than being the text: an absolute path, or one with a known suffix."""
    return F.coalesce(value.startswith("/") | F.lower(value).rlike(rf"[^/\s][^/\n]*(?:{'|'.join(re.escape(s) for s in TEXT_SUFFIXES)})$"), F.lit(False))


def retry_delay(value: Column, now: Column) -> Column:
    """The seconds that a Retry-After header asks for, a number or an HTTP date, held to 0 to LONGEST_DELAY; null if it is neither."""
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]{3,9},\s*", ""), r"\s*(?:GMT|UTC)$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(value.try_cast("double"), F.unix_micros(date) / 1e6 - F.unix_micros(now) / 1e6)
    return F.when(seconds.isNotNull() & ~F.isnan(seconds), F.greatest(F.lit(0.0), F.least(seconds, F.lit(LONGEST_DELAY))))


def utc_text(at: Column) -> Column:
    """A moment as an ISO text in UTC; the session's zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def strict_count(value: Column) -> Column:
    """A text as a whole number of 0 or more; null if it is anything else."""
    return F.when(value.rlike(r"^\d+$"), value.try_cast("long"))


def item_coverage(found: Column, items: Column) -> Column:
    """The share of items found, 1 at most."""
    return F.least(F.lit(1.0), found / F.greatest(items, F.lit(1)))


# Findings -------------------------------------------------------------------------------------------------------------


def certainty(value: Column, old: bool = False) -> Column:
    """absent, uncertain or present; ``old`` takes the words of older records."""
    text = plain(value)
    return F.when(text.isin(*(OLD_ABSENT if old else ABSENT)), "absent").when(text.isin(*(OLD_UNCERTAIN if old else UNCERTAIN)), "uncertain").otherwise("present")


def sequence_name(sentence: Column) -> Column:
    """The first of SEQUENCES that a sentence names, in any case; else null."""
    upper = F.upper(sentence)
    return F.coalesce(*(F.when(upper.contains(s), s) for s in SEQUENCES))


def measurement(value: Column) -> Column:
    """A struct of value, unit and millimetres from the first size in a text; null without one."""
    number = F.regexp_extract(value, r"(?i)(\d+(?:\.\d+)?)\s*(cm|mm)\b", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(value, r"(?i)(\d+(?:\.\d+)?)\s*(cm|mm)\b", 2))
    return F.when(number.isNotNull(), F.struct(number.alias("value"), unit.alias("unit"), (number * F.when(unit == "cm", 10.0).otherwise(1.0)).alias("normalized_mm")))


def finding_keys(f) -> Column:
    """The observation, location, laterality, certainty and severity of a finding under any of the names they have had.

    ``f`` gives the Column of a field's name. A side that is not stated is read from the location.
    """
    observation = plain(first_filled(f("observation_code"), f("observation"), f("observation_text")))
    location = F.coalesce(F.nullif(plain(first_filled(f("anatomy_code"), f("location"), f("location_text"))), F.lit("")), F.lit("unspecified"))
    stated = plain(f("laterality"))
    read = F.when(location.contains("bilateral"), "bilateral").when(location.contains("right"), "right").when(location.contains("left"), "left").when(location.contains("midline"), "midline")
    severity = F.coalesce(F.nullif(plain(f("severity")), F.lit("")), F.lit("unspecified"))
    return F.struct(
        observation.alias("observation"), location.alias("location"), F.when(stated.isin(*SIDES), stated).otherwise(F.coalesce(read, F.lit("unknown"))).alias("laterality"),
        certainty(f("certainty")).alias("certainty"), severity.alias("severity"),
    )


def body_part(value: Column, modality: Column) -> Column:
    """The part of the body of a header's name; without a known one brain for an mri, else the name in lower case or unknown."""
    key = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    known = F.coalesce(*(F.when(key == name, part) for name, part in BODY_PARTS.items()))
    return F.coalesce(known, F.when(modality == "mri", "brain"), F.nullif(F.lower(key), F.lit("")), F.lit("unknown"))


def input_asset(modality: Column, volume: Column, derived_volume: Column, image: Column, derived_image: Column) -> Column:
    """What is sent of a case: a volume for ct and mri, else one image; a derived file goes first."""
    wide = F.lower(F.trim(F.coalesce(modality, F.lit("")))).isin("ct", "mr", "mri")
    path = F.when(wide, first_filled(derived_volume, volume)).otherwise(first_filled(derived_image, image))
    return F.struct(
        F.when(wide, "volume").otherwise("image").alias("kind"), F.coalesce(path, F.lit("")).alias("path"), path.isNotNull().alias("exists"),
        F.when(wide, "3d_volume_required").otherwise("2d_image_required").alias("selection_policy"),
    )


def own_metrics(payload: Column) -> Column:
    """A map of a row's fields without bookkeeping and without values that are not finite."""
    return F.map_filter(payload, lambda k, v: ~k.isin(*BOOKKEEPING) & finite(v))


# Routes and evidence --------------------------------------------------------------------------------------------------


def readiness_problems(tier: Column, source: Column, ready: Column, fresh: Column, sha256: Column, formal_sources: tuple[str, ...], **versions: Column) -> Column:
    """Why a generator may not make formal evidence, in the order of the rules."""
    missing = [F.when(F.trim(F.coalesce(v, F.lit(""))) == "", f"missing_{name}") for name, v in versions.items()]
    return F.array_compact(F.array(
        F.when(~tier.eqNullSafe("formal_fresh"), "non_formal_evidence_tier"), F.when(~F.coalesce(source.isin(*formal_sources), F.lit(False)), "unsupported_formal_source"),
        F.when(~F.coalesce(ready, F.lit(False)), "generator_not_ready"), F.when(~F.coalesce(fresh, F.lit(False)), "fresh_inference_unverified"),
        F.when(~F.coalesce(sha256.rlike("^[0-9a-f]{64}$"), F.lit(False)), "missing_model_sha256"), *missing,
    ))


def route_role(report_trained: Column, fresh: Column, source: Column, ready: Column) -> Column:
    return (
        F.when(report_trained & fresh, "fresh_report_trained_local").when(report_trained & (source == "artifact_reuse"), "artifact_report_trained_local")
        .when(ready, "local_ready_non_report_trained").otherwise("local_not_ready")
    )


def legacy_tier(tier: Column, schema_version: Column, source: Column, legacy_source: str) -> Column:
    """The tier of a report; one of the former tool under an older schema counts as debug_fallback."""
    old = ~F.coalesce(schema_version == "2.0", F.lit(False)) & (source == legacy_source)
    return F.when(old, "debug_fallback").otherwise(tier)


def transcript_status(text: Column, warnings: Column, page_statuses: Column, verifier_missing: Column) -> Column:
    """blocked, review_required or passed, by a transcript's text, its warnings and the verifier's status of its pages."""
    blank = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")) == ""
    cut = F.exists(warnings, lambda w: (w == "empty_vlm_ocr_result") | w.startswith("ocr_possible_truncation"))
    doubted = F.exists(page_statuses, lambda s: F.lower(s).isin("disagreement", "verifier_failed", "invalid_verifier_response"))
    aside = F.exists(warnings, lambda w: (w == "ocr_non_report_page") | w.startswith("ocr_non_report_page:"))
    agreed = (F.size(page_statuses) > 0) & F.forall(page_statuses, lambda s: F.lower(s) == "agree")
    unchecked = F.coalesce(verifier_missing, F.lit(False)) | F.array_contains(warnings, "ocr_verifier_client_missing")
    return F.when(blank | cut, "blocked").when(doubted | (aside & ~agreed) | unchecked, "review_required").otherwise("passed")


def provenance_kind(has_text: Column, has_source: Column, warnings: Column, sidecar: Column, real_providers: tuple[str, ...]) -> Column:
    """real, mock, unknown or missing: where the transcript of a case comes from, by its warnings and its sidecar (method, provider).

    Null for a case that has neither a transcript nor a document to transcribe.
    """
    method, provider = plain(sidecar["method"]), plain(sidecar["provider"])
    mocked = F.coalesce(F.arrays_overlap(warnings, F.array(F.lit("mock_ocr_used"), F.lit("real_ocr_required_but_provider_is_mock"))), F.lit(False))
    real = (method == "pdf_text_layer") | (provider == "local_pdf_text") | ((method == "vlm_ocr") & provider.isin(*real_providers))
    kind = F.when(mocked, "mock").when(sidecar.isNull(), "unknown").when(real, "real").when(provider == "mock", "mock").otherwise("unknown")
    return F.when(has_text, kind).when(has_source, "missing")


def gold_blocker(status: Column) -> Column:
    """Why a gold text may not be used: the status of its quality sidecar; null if it has passed or there is no status."""
    name = plain(status)
    return F.when(name.isin("blocked", "review_required"), F.concat(F.lit("ocr_quality_"), name)).when(~name.isin("", "passed"), "ocr_quality_status")


def independent(first: Column, second: Column) -> Column:
    """Whether two judges (structs provider, model, host) differ in all of what names them together."""
    key = lambda s: F.struct(plain(s["provider"]).alias("p"), plain(s["model"]).alias("m"), plain(s["host"]).alias("h"))
    return key(first) != key(second)
