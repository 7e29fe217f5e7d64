"""Queries of the expressions over single values, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators.statistics import ordered_pair_counts
from tessera.plans import adapters as A

VALUES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
VALUES_SQL: dict[str, str] = {}


def value_query(sql: str | None = None):
    def put(f):
        VALUES[f.__name__] = f
        if sql:
            VALUES_SQL[f.__name__] = sql
        return f

    return put


def picked(key: Column, *choices: str | None) -> Column:
    """One of the choices by a number."""
    return F.element_at(F.array(*(F.lit(c).cast("string") for c in choices)), (key % len(choices) + 1).cast("int"))


def _pick(key: str, *choices: str | None) -> str:
    quoted = ", ".join("NULL" if c is None else "'" + c.replace("'", "''") + "'" for c in choices)
    return f"([{quoted}])[{key} % {len(choices)} + 1]"


_CERTAIN = ("Negated", " possible ", "present", "", "suspected", "absent", "seen", "indeterminate")


@value_query(f"""SELECT CASE trim(lower({_pick('p_partkey', *_CERTAIN)})) WHEN 'negated' THEN 'absent' WHEN 'absent' THEN 'absent' WHEN 'possible' THEN 'uncertain' WHEN 'suspected' THEN 'uncertain'
  WHEN 'indeterminate' THEN 'uncertain' ELSE 'present' END AS certainty, count(*) AS n FROM part GROUP BY certainty""")
def certainty_counts(spark, d):
    return A.table(spark, d, "part").select(V.certainty(picked(F.col("p_partkey"), *_CERTAIN)).alias("certainty")).groupBy("certainty").agg(F.count(F.lit(1)).alias("n"))


_SERIES = ("ax t2-flair", "dwi and adc", "plain", "swi", "t1wi sag", "adc map", "flair")


@value_query(f"""WITH s AS (SELECT upper({_pick('p_partkey', *_SERIES)}) || ' ' || upper(p_name) AS t FROM part)
SELECT CASE WHEN contains(t, 'DWI') THEN 'DWI' WHEN contains(t, 'ADC') THEN 'ADC' WHEN contains(t, 'T2-FLAIR') THEN 'T2-FLAIR' WHEN contains(t, 'FLAIR') THEN 'FLAIR' WHEN contains(t, 'T2WI') THEN 'T2WI'
  WHEN contains(t, 'T1WI') THEN 'T1WI' WHEN contains(t, 'SWI') THEN 'SWI' END AS sequence, count(*) AS n FROM s GROUP BY sequence""")
def sequence_counts(spark, d):
    sentence = F.concat_ws(" ", picked(F.col("p_partkey"), *_SERIES), "p_name")
    return A.table(spark, d, "part").select(V.sequence_name(sentence).alias("sequence")).groupBy("sequence").agg(F.count(F.lit(1)).alias("n"))


@value_query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'findings' WHEN 1 THEN 'impression;findings' ELSE 'findings;impression' END AS sections FROM conversations WHERE trim(text) <> ''""")
def section_orders(spark, d):
    kind = F.col("turn") % 3
    shown = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("Impression: x\nFindings: "), F.col("text"))).otherwise(F.concat(F.lit("FINDINGS: a\nimpression：b\nFindings: "), F.col("text")))
    rows = A.table(spark, d, "conversations").where("trim(text) <> ''")
    return rows.select("conv_id", "turn", F.array_join(T.section_order(shown), ";").alias("sections"))


@value_query("""SELECT s_suppkey, coalesce(nullif(regexp_replace(regexp_replace(trim(v), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'unknown') AS component
FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ' ../' || s_name || '/ä b ' WHEN 1 THEN '..' ELSE s_name END AS v FROM supplier)""")
def safe_components(spark, d):
    kind = F.col("s_suppkey") % 3
    value = F.when(kind == 0, F.concat(F.lit(" ../"), "s_name", F.lit("/ä b "))).when(kind == 1, "..").otherwise(F.col("s_name"))
    return A.table(spark, d, "supplier").select("s_suppkey", V.safe_component(value).alias("component"))


@value_query(r"""SELECT conv_id, turn, length(m) AS chars, md5(m) AS digest FROM (SELECT conv_id, turn, right(regexp_replace(text || chr(10) || 'Authorization: Bearer ' || conv_id || ', API-key=' || turn || '; ok',
  '(?i)(authorization|api[_ -]?key|bearer)[^,;\n]*', '\1=<redacted>', 'g'), 2000) AS m FROM conversations)""")
def safe_errors(spark, d):
    message = F.concat("text", F.lit("\nAuthorization: Bearer "), F.col("conv_id").cast("string"), F.lit(", API-key="), F.col("turn").cast("string"), F.lit("; ok"))
    rows = A.table(spark, d, "conversations").select("conv_id", "turn", V.safe_error(message).alias("m"))
    return rows.select("conv_id", "turn", F.char_length("m").cast("long").alias("chars"), F.md5("m").alias("digest"))


@value_query(r"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '://', '://User@') || '/' WHEN 1 THEN regexp_replace(url, '(://[^/]*)', '\1:8080') WHEN 2 THEN 'no address' ELSE url END AS u FROM pages),
s AS (SELECT page_id, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', ['scheme', 'place', 'path']) AS x FROM p)
SELECT page_id, CASE WHEN x.scheme = '' THEN '' ELSE lower(x.scheme) || '://' || lower(regexp_replace(x.place, '^.*@', '')) || regexp_replace(x.path, '/+$', '') END AS endpoint FROM s""")
def endpoint_urls(spark, d):
    kind, url = F.col("page_id") % 4, F.col("url")
    shown = F.when(kind == 0, F.concat(F.replace(url, F.lit("://"), F.lit("://User@")), F.lit("/"))).when(kind == 1, F.regexp_replace(url, "(://[^/]*)", "$1:8080")).when(kind == 2, "no address").otherwise(url)
    return A.table(spark, d, "pages").select("page_id", V.endpoint_url(shown).alias("endpoint"))


@value_query("""SELECT 'obs' || CAST(l_partkey % 6 AS VARCHAR) || '|' || CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'loc' || CAST(l_suppkey % 4 AS VARCHAR) END || '|' || l_returnflag AS signature, count(*) AS n FROM lineitem GROUP BY signature""")
def finding_signatures(spark, d):
    place = F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("loc"), (F.col("l_suppkey") % 4).cast("string")))
    named = V.signature(F.concat(F.lit("obs"), (F.col("l_partkey") % 6).cast("string")), place, F.col("l_returnflag"))
    return A.table(spark, d, "lineitem").groupBy(named.alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@value_query("""SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN CAST(p_size AS DOUBLE) + 0.5e0 END AS value, CASE WHEN p_partkey % 4 < 2 THEN 'mm' WHEN p_partkey % 4 = 2 THEN 'cm' END AS unit,
  CASE WHEN p_partkey % 4 < 2 THEN CAST(p_size AS DOUBLE) + 0.5e0 WHEN p_partkey % 4 = 2 THEN (CAST(p_size AS DOUBLE) + 0.5e0) * 10 END AS normalized_mm FROM part""")
def measurement_values(spark, d):
    size = F.concat(F.col("p_size").cast("string"), F.lit(".5"))
    shown = F.concat(F.lit("about "), size, picked(F.col("p_partkey"), " mm wide", "MM", " cm x 3 mm", " metres"))
    rows = A.table(spark, d, "part").select("p_partkey", V.measurement(shown).alias("m"))
    return rows.select("p_partkey", "m.value", "m.unit", "m.normalized_mm")


@value_query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","sizes":[' || p_size || ',null],"ü":{"a":true,"b":' || p_partkey || '}}') AS digest FROM part""")
def canonical_digests(spark, d):
    text = F.format_string('{ "ü": {"b": %d, "a": true}, "sizes": [%d, null],\n "name": "%s", "brand": "%s"}', "p_partkey", "p_size", "p_name", "p_brand")
    return A.table(spark, d, "part").select("p_partkey", V.stable_sha256(text).alias("digest"))


@value_query("""SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN p_size END AS size, p_partkey % 5 < 3 AS parsed FROM part""")
def json_answers(spark, d):
    body = F.format_string('{"size": %d, "name": "%s"}', "p_size", "p_name")
    kind = F.col("p_partkey") % 5
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" as asked."))).when(kind == 3, F.lit("[1, 2]")).otherwise(F.lit("{broken"))
    rows = A.table(spark, d, "part").select("p_partkey", V.json_object(raw).alias("o"))
    return rows.select("p_partkey", V.nested(F.col("o"), "$.size", "int").alias("size"), F.col("o").isNotNull().alias("parsed"))


@value_query("""SELECT event_type, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) END) AS total FROM events GROUP BY event_type""")
def nested_totals(spark, d):
    props = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", r"\d+", '"text"')).otherwise(F.col("props"))
    rows = A.table(spark, d, "events").select("event_type", V.nested(props, "$.k", "int", -1).alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("total"))


@value_query("""SELECT CASE p_partkey % 3 WHEN 0 THEN '{"a": ["<string>"], "n": 0}' WHEN 1 THEN '{"a": [], "n": null, "t": false}' ELSE '[{"x": 0}]' END AS shape, count(*) AS n FROM part GROUP BY shape""")
def schema_shapes(spark, d):
    value = F.when(F.col("p_partkey") % 3 == 0, F.format_string('{"n": %d, "a": ["%s", 3]}', "p_size", "p_name")).when(F.col("p_partkey") % 3 == 1, F.lit('{"t": true, "a": [], "n": null}')).otherwise(F.lit('[{"x": 1.5}, 2]'))
    return A.table(spark, d, "part").groupBy(V.schema_shape(value).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@value_query("""SELECT p_partkey, concat_ws(';', 'brand', CASE WHEN p_partkey % 2 = 0 THEN 'name' END, CASE WHEN p_partkey % 3 <> 0 THEN 'size' END) AS options FROM part""")
def filled_options(spark, d):
    options = F.create_map(
        F.lit("brand"), F.col("p_brand"), F.lit("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(""), F.lit("size"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("string"))
    )
    return A.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(V.filled(options))), ";").alias("options"))


@value_query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id % 400 AS DOUBLE) WHEN 1 THEN 0e0 WHEN 2 THEN 45e0 WHEN 3 THEN 0e0 END AS capped FROM events WHERE event_id % 400 <= 300 OR event_id % 5 <> 0
UNION ALL SELECT event_id, 300e0 FROM events WHERE event_id % 5 = 0 AND event_id % 400 > 300""")
def retry_delays(spark, d):
    kind = F.col("event_id") % 5
    value = F.when(kind == 0, (F.col("event_id") % 400).cast("string")).when(kind == 1, "-3").when(kind == 2, "Mon, 01 Jan 2024 12:00:45 GMT").when(kind == 3, "Sun, 31 Dec 2023 12:00:45 GMT").otherwise("soon")
    return A.table(spark, d, "events").select("event_id", V.retry_delay(value, F.to_timestamp(F.lit("2024-01-01 12:00:00"))).alias("capped"))


@value_query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events""")
def utc_texts(spark, d):
    return A.table(spark, d, "events").select("event_id", V.utc_text(F.col("ts")).alias("at"))


@value_query("""SELECT sum(CASE WHEN p_partkey % 3 = 0 THEN p_size END) AS total, count(*) FILTER (WHERE p_partkey % 3 <> 0) AS refused, round(avg(least(1e0, p_size / 30e0)) * 1e6) AS coverage FROM part""")
def strict_counts(spark, d):
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise("1.0")
    rows = A.table(spark, d, "part").select(V.strict_count(text).alias("n"), V.item_coverage(F.col("p_size"), F.lit(30)).alias("c"))
    return rows.agg(F.sum("n").alias("total"), F.count_if(F.col("n").isNull()).alias("refused"), F.round(F.avg("c") * 1e6).alias("coverage"))


@value_query("""SELECT p_partkey, concat_ws(';', CASE WHEN p_partkey % 2 = 1 THEN 'non_formal_evidence_tier' END, CASE WHEN p_partkey % 3 = 2 THEN 'unsupported_formal_source' END, CASE WHEN p_size <= 10 THEN 'generator_not_ready' END,
  CASE WHEN p_size % 2 = 0 THEN 'fresh_inference_unverified' END, CASE WHEN p_partkey % 5 = 0 THEN 'missing_model_sha256' END, CASE WHEN p_partkey % 7 = 0 THEN 'missing_model_version' END) AS problems FROM part""")
def formal_readiness(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    problems = V.readiness_problems(
        picked(key, "formal_fresh", "mock"), picked(key, "service", "console", "else"), size > 10, F.when(size % 2 == 1, True), F.when(key % 5 != 0, F.sha2("p_name", 256)),
        ("service", "console"), model_version=F.when(key % 7 != 0, "v1").otherwise(" "), prompt_version=F.lit("p"),
    )
    return A.table(spark, d, "part").select("p_partkey", F.array_join(problems, ";").alias("problems"))


@value_query("""SELECT CASE WHEN p_size % 2 = 0 AND p_size > 25 THEN 'fresh_report_trained_local' WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN 'artifact_report_trained_local' WHEN p_partkey % 5 <> 0 THEN 'local_ready_non_report_trained'
  ELSE 'local_not_ready' END AS role, CASE WHEN p_partkey % 4 = 0 AND p_size <> 7 THEN 'debug_fallback' ELSE 'artifact' END AS tier, count(*) AS n FROM part GROUP BY role, tier""")
def route_roles(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    role = V.route_role(size % 2 == 0, size > 25, picked(key, "artifact_reuse", "fresh_cli", "mock"), key % 5 != 0)
    tier = V.legacy_tier(F.lit("artifact"), F.when(size == 7, "2.0").when(size % 2 == 0, "1.0"), F.when(key % 4 == 0, "former_cli").otherwise("other"), "former_cli")
    return A.table(spark, d, "part").groupBy(role.alias("role"), tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@value_query("""WITH f AS (SELECT lower(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END) AS observation, CASE WHEN p_partkey % 3 = 0 THEN 'unspecified' WHEN p_partkey % 3 = 1 THEN 'right upper lobe' ELSE 'base' END AS location,
  CASE WHEN p_size % 2 = 0 THEN 'left' WHEN p_partkey % 3 = 1 THEN 'right' ELSE 'unknown' END AS laterality, CASE WHEN p_size % 5 = 0 THEN 'absent' ELSE 'present' END AS certainty FROM part)
SELECT observation, location, laterality, certainty, 'unspecified' AS severity, count(*) AS n FROM f GROUP BY ALL""")
def finding_key_counts(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    fields = {
        "observation_code": F.when(key % 2 == 0, F.upper("p_name")).otherwise(""), "observation": F.col("p_brand"), "observation_text": F.lit("unused"),
        "anatomy_code": F.lit(None).cast("string"), "location": F.when(key % 3 == 1, " Right  upper lobe").otherwise(""), "location_text": F.when(key % 3 == 2, "Base"),
        "laterality": F.when(size % 2 == 0, "LEFT").otherwise("none"), "certainty": F.when(size % 5 == 0, "Negative"), "severity": F.lit(None).cast("string"),
    }
    return A.table(spark, d, "part").select(V.finding_keys(fields.__getitem__).alias("f")).select("f.*").groupBy("observation", "location", "laterality", "certainty", "severity").agg(F.count(F.lit(1)).alias("n"))


@value_query("""SELECT CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN 'blocked' WHEN p_size % 3 = 0 THEN 'review_required' WHEN p_partkey % 5 = 1 AND p_size % 3 <> 1 THEN 'review_required' WHEN p_partkey % 11 = 0 THEN 'review_required'
  ELSE 'passed' END AS status, count(*) AS n FROM part GROUP BY status""")
def transcript_statuses(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    warnings = F.when(key % 5 == 0, F.array(F.lit("ocr_possible_truncation:3"))).when(key % 5 == 1, F.array(F.lit("ocr_non_report_page:2"))).otherwise(F.array().cast("array<string>"))
    pages = F.when(size % 3 == 0, F.array(F.lit("agree"), F.lit("Disagreement"))).when(size % 3 == 1, F.array(F.lit("agree"), F.lit("agree"))).otherwise(F.array(F.lit("skipped")))
    status = V.transcript_status(F.when(key % 7 == 0, " \n").otherwise(F.col("p_name")), warnings, pages, key % 11 == 0)
    return A.table(spark, d, "part").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@value_query("""SELECT CASE WHEN p_partkey % 9 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'missing' END WHEN p_size % 6 = 0 THEN 'mock' WHEN p_partkey % 4 = 0 THEN 'unknown' WHEN p_partkey % 4 = 1 THEN 'real' WHEN p_partkey % 4 = 2 THEN 'real'
  ELSE 'mock' END AS kind, count(*) AS n FROM part GROUP BY kind""")
def transcript_provenance(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    sidecar = F.when(key % 4 == 1, F.struct(F.lit("pdf_text_layer").alias("method"), F.lit("x").alias("provider"))).when(key % 4 == 2, F.struct(F.lit("VLM_OCR").alias("method"), F.lit("service").alias("provider"))).when(
        key % 4 == 3, F.struct(F.lit("vlm_ocr").alias("method"), F.lit("mock").alias("provider"))
    )
    kind = V.provenance_kind(key % 9 != 0, size % 2 == 0, F.when(size % 6 == 0, F.array(F.lit("mock_ocr_used"))).otherwise(F.array(F.lit("x"))), sidecar, ("service",))
    return A.table(spark, d, "part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@value_query("""SELECT p_partkey, concat_ws(';', CASE WHEN p_size > 10 THEN 'price' END, 'size') AS metrics FROM part""")
def own_metric_names(spark, d):
    payload = F.create_map(
        F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).otherwise(float("nan")), F.lit("metadata"), F.lit(1.0), F.lit("source"), F.lit(2.0)
    )
    return A.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(V.own_metrics(payload))), ";").alias("metrics"))


@value_query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'path' ELSE 'text' END AS kind, count(*) AS n FROM part GROUP BY kind""")
def text_or_path(spark, d):
    value = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("/data/"), "p_name")).when(F.col("p_partkey") % 6 == 3, F.concat(F.lit("reports/"), F.col("p_partkey").cast("string"), F.lit(".TXT"))).otherwise(F.concat("p_name", F.lit(". No .txt here, see text")))
    return A.table(spark, d, "part").groupBy(F.when(V.is_text_path(value), "path").otherwise("text").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@value_query(f"""SELECT CASE {_pick('p_partkey', 'Chest', ' lung ', 'brain', 'KNEE', '', None)} WHEN 'Chest' THEN 'chest' WHEN ' lung ' THEN 'chest' WHEN 'brain' THEN 'brain' WHEN 'KNEE' THEN CASE WHEN p_size % 2 = 0 THEN 'brain' ELSE 'knee' END
  ELSE CASE WHEN p_size % 2 = 0 THEN 'brain' ELSE 'unknown' END END AS body_part, count(*) AS n FROM part GROUP BY body_part""")
def body_part_counts(spark, d):
    part = V.body_part(picked(F.col("p_partkey"), "Chest", " lung ", "brain", "KNEE", "", None), F.when(F.col("p_size") % 2 == 0, "mri").otherwise("ct"))
    return A.table(spark, d, "part").groupBy(part.alias("body_part")).agg(F.count(F.lit(1)).alias("n"))


@value_query("""WITH c AS (SELECT o_orderkey AS k, o_orderstatus <> 'O' AS wide FROM orders)
SELECT CASE WHEN wide THEN 'volume' ELSE 'image' END AS kind, CASE WHEN wide THEN CASE WHEN k % 2 = 0 THEN 'derived.nii' WHEN k % 3 = 0 THEN 'scan.nii' ELSE '' END ELSE CASE WHEN k % 5 = 0 THEN 'primary.png' ELSE 'first.png' END END AS path,
  NOT (wide AND k % 2 <> 0 AND k % 3 <> 0) AS exists, CASE WHEN wide THEN '3d_volume_required' ELSE '2d_image_required' END AS selection_policy, count(*) AS n FROM c GROUP BY ALL""")
def input_assets(spark, d):
    k = F.col("case_id")
    asset = V.input_asset(F.col("modality"), F.when(k % 3 == 0, "scan.nii"), F.when(k % 2 == 0, "derived.nii").otherwise(""), F.lit("first.png"), F.when(k % 5 == 0, "primary.png"))
    return A.cases(spark, d).select(asset.alias("a")).select("a.*").groupBy("kind", "path", "exists", "selection_policy").agg(F.count(F.lit(1)).alias("n"))


@value_query("""SELECT CASE p_partkey % 4 WHEN 0 THEN 'ocr_quality_blocked' WHEN 2 THEN 'ocr_quality_status' END AS blocker, count(*) AS n FROM part GROUP BY blocker""")
def gold_blockers(spark, d):
    return A.table(spark, d, "part").groupBy(V.gold_blocker(picked(F.col("p_partkey"), " Blocked", "passed", "odd", None)).alias("blocker")).agg(F.count(F.lit(1)).alias("n"))


@value_query("""SELECT p_partkey, '{"name": "' || p_name || '", "source_case_sha256": "[opaque]", "x": "13800000000"}' AS masked FROM part""")
def masked_digests(spark, d):
    payload = F.format_string('{"name": "%s", "source_case_sha256": "%s", "x": "13800000000"}', "p_name", F.sha2("p_name", 256))
    return A.table(spark, d, "part").select("p_partkey", V.without_digests(payload).alias("masked"))


@value_query("""SELECT p_partkey, sha256('{"endpoint":"http://h/v1","model":"' || p_brand || '","options":{"seed":"' || p_size || '"},"provider":"local"}') AS route FROM part""")
def route_fingerprints(spark, d):
    options = F.create_map(F.lit("seed"), F.col("p_size").cast("string"), F.lit("stop"), F.lit(""))
    return A.table(spark, d, "part").select("p_partkey", V.route_fingerprint(F.lit("local"), F.col("p_brand"), F.lit("HTTP://H/v1/?x"), options).alias("route"))


@value_query("""SELECT a.s_suppkey % 3 = 0 AND b.s_suppkey % 2 = 0 AS same, count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY same""")
def judge_pairs(spark, d):
    judge = lambda provider: F.struct(provider.alias("provider"), F.lit("m").alias("model"), F.lit("h").alias("host"))
    first = judge(F.when(F.col("s_suppkey") % 3 == 0, "One").otherwise("two"))
    second = judge(F.when(F.col("s_suppkey") % 2 == 0, " one ").otherwise("three"))
    pairs = ordered_pair_counts(A.table(spark, d, "supplier"), "s_nationkey", "s_suppkey", first, second)
    return pairs.groupBy((~V.independent(F.col("first"), F.col("second"))).alias("same")).agg(F.sum("n").alias("n"))
