"""Queries of the rule operators (concepts, quality, gates, reuse, annotation, series) with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import quality
from tessera.operators import annotation, composites, gates, ontology, reuse, series
from tessera.plans import adapters as A

RULES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RULES_SQL: dict[str, str] = {}
CONCEPTS = (
    ontology.Concept("ring", "hand", ("ring", "small ring"), ("red ring",)),
    ontology.Concept("widget", "desk", ("widget",), ("blue widget",)),
    ontology.Concept("fastener", "wall", ("bolt", "screw", "red bolt")),
    ontology.Concept("cardiopulmonary_abnormality", "chest", ("economy", "small"), ("promo",)),
)


def rule(sql: str | None = None):
    def put(f):
        RULES[f.__name__] = f
        if sql:
            RULES_SQL[f.__name__] = sql
        return f

    return put


@rule("""WITH s(needle, code, normal) AS (VALUES ('ring', 'ring', 0), ('small ring', 'ring', 0), ('red ring', 'ring', 1), ('widget', 'widget', 0), ('blue widget', 'widget', 1),
  ('bolt', 'fastener', 0), ('screw', 'fastener', 0), ('red bolt', 'fastener', 0), ('fastener', 'fastener', 0), ('economy', 'cardiopulmonary_abnormality', 0),
  ('small', 'cardiopulmonary_abnormality', 0), ('promo', 'cardiopulmonary_abnormality', 1)),
f AS (SELECT p_partkey, 2 AS ord, lower(p_name) AS v FROM part UNION ALL SELECT p_partkey, 3, lower(p_type) FROM part),
hits AS (SELECT p_partkey, ord, code, normal, length(needle) AS n FROM f JOIN s ON contains(' ' || v || ' ', ' ' || needle || ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, ord ORDER BY n DESC, normal DESC, code DESC) AS r FROM hits),
picked AS (SELECT *, code = 'cardiopulmonary_abnormality' AS broad FROM best WHERE r = 1),
chosen AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY broad, CASE WHEN broad THEN -normal ELSE 0 END, CASE WHEN broad AND normal = 1 THEN -ord ELSE ord END) AS k FROM picked)
SELECT p.p_partkey, coalesce(c.code, 'other_finding') AS concept, CASE WHEN c.code IS NULL THEN 'unmapped' WHEN c.normal = 1 THEN 'normal' ELSE 'canonical' END AS matched_as
FROM part p LEFT JOIN (SELECT * FROM chosen WHERE k = 1) c USING (p_partkey)""")
def concept_resolution(spark, d):
    found = A.table(spark, d, "part").select("p_partkey", ontology.concept(F.lit(""), F.col("p_name"), F.col("p_type"), CONCEPTS).alias("c"))
    return found.select("p_partkey", F.col("c.code").alias("concept"), F.col("c.matched_as").alias("matched_as"))


@rule()
def evidence_spans(spark, d):
    rows = A.table(spark, d, "conversations").select("conv_id", "turn", ontology.evidence_span(F.col("text"), F.regexp_replace(F.substring("text", 5, 24), " ", "  ")).alias("s"))
    return rows.select("conv_id", "turn", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@rule()
def concept_negation(spark, d):
    rows = A.table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 2 == 0, "no ").otherwise("one "), "p_name").alias("evidence"), F.lit("fastener").alias("code"))
    return rows.select("p_partkey", ontology.negated(F.col("evidence"), F.col("code"), CONCEPTS).alias("negated"))


@rule("""WITH b AS (SELECT lang, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT lang, count(*) AS n, sum(CASE WHEN t = '' THEN 1 WHEN regexp_matches(t, '[。！？.!?)\\]】}」』”"'']\\z') THEN 0 WHEN length(t) < 8 THEN 1
  WHEN regexp_matches(t, '[A-Za-z0-9]\\z') AND NOT regexp_matches(lower(t), '(?:stable|normal|negative)\\z') THEN 1 ELSE 0 END) AS truncated FROM b GROUP BY lang""")
def truncated_documents(spark, d):
    rows = A.table(spark, d, "documents").select("lang", quality.looks_truncated(F.col("text")).alias("cut"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("truncated"))


@rule("""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN text || chr(13) || chr(10) || 'There is nothing else here.' ELSE text END AS t FROM conversations),
m AS (SELECT *, regexp_matches(t, '(?i)there is|unable to read|the provided image|appears to be blank') AS marked FROM r)
SELECT conv_id, turn, regexp_replace(CASE WHEN marked THEN regexp_replace(regexp_replace(t, '(?is)(?:there is|unable to read|the provided image|appears to be blank).*', ''), '\\r\\n', chr(10), 'g') ELSE t END, '^\\s+|\\s+$', '', 'g') AS report
FROM m""")
def commentary_stripped(spark, d):
    text = F.when(F.col("turn") % 2 == 1, F.concat("text", F.lit("\r\nThere is nothing else here."))).otherwise(F.col("text"))
    return A.table(spark, d, "conversations").select("conv_id", "turn", quality.without_commentary(text).alias("report"))


@rule()
def foreign_modality_terms(spark, d):
    words = F.concat(F.lit("seen on ct. "), F.when(F.col("p_size") % 3 == 0, "Recommend MRI.").otherwise("An x-ray."))
    kind = F.when(F.col("p_partkey") % 3 == 0, "ct").when(F.col("p_partkey") % 3 == 1, "mri").otherwise("cxr")
    rows = A.table(spark, d, "part").select(kind.alias("modality"), F.explode(quality.foreign_terms(words, kind)).alias("term"))
    return rows.groupBy("modality", "term").agg(F.count(F.lit(1)).alias("n"))


@rule("""WITH c AS (SELECT 'reader_' || CAST(o_custkey % 12 AS VARCHAR) AS reader, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS ok FROM orders GROUP BY 1),
x AS (SELECT reader, total, ok, CASE WHEN reader = 'reader_3' THEN total - ok + 1 ELSE total - ok END AS failed,
        CASE WHEN reader = 'reader_5' THEN 0.5e0 * ok / total ELSE ok * 1e0 / total END AS ok_rate, CASE WHEN reader = 'reader_7' THEN 1.5e0 ELSE (total - ok) * 1e0 / total END AS failed_rate FROM c),
p AS (SELECT reader, unnest([CASE WHEN ok_rate NOT BETWEEN 0 AND 1 OR failed_rate NOT BETWEEN 0 AND 1 THEN 'rate_out_of_range' END, CASE WHEN ok + failed <> total THEN 'counts_do_not_sum' END,
        CASE WHEN abs(ok_rate - ok * 1e0 / total) > 1e-4 THEN 'success_rate_mismatch' END, CASE WHEN abs(failed_rate - failed * 1e0 / total) > 1e-4 THEN 'failure_rate_mismatch' END]) AS problem FROM x)
SELECT reader, problem FROM p WHERE problem IS NOT NULL""")
def denominator_check(spark, d):
    rows = A.table(spark, d, "orders").groupBy(F.concat(F.lit("reader_"), (F.col("o_custkey") % 12).cast("string")).alias("reader"))
    rows = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"))
    left, share = F.col("total") - F.col("ok"), F.col("ok") / F.col("total")
    failed = left + (F.col("reader") == "reader_3").cast("int")
    ok_rate = F.when(F.col("reader") == "reader_5", 0.5 * share).otherwise(share)
    failed_rate = F.when(F.col("reader") == "reader_7", 1.5).otherwise(left / F.col("total"))
    problems = gates.denominator_problems(F.col("total"), F.lit(None).cast("long"), F.col("ok"), failed, ok_rate, failed_rate)
    return rows.select("reader", F.explode(problems).alias("problem"))


@rule("""SELECT CASE l_linenumber % 4 WHEN 0 THEN 'omission_finding' WHEN 1 THEN 'incorrect_severity' WHEN 2 THEN 'surprise' ELSE 'contradiction' END AS error_type,
  CAST(CASE WHEN l_suppkey % 5 = 0 THEN CASE l_linenumber % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END ELSE greatest(1, least(5, l_partkey % 9 - 1)) END AS INTEGER) AS level, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def hazard_levels(spark, d):
    kinds = F.array(*map(F.lit, ("omission_finding", "incorrect_severity", "surprise", "contradiction")))
    raw = F.when(F.col("l_suppkey") % 5 == 0, "high").otherwise((F.col("l_partkey") % 9 - 1).cast("string"))
    rows = A.table(spark, d, "lineitem").select(F.get(kinds, (F.col("l_linenumber") % 4).cast("int")).alias("error_type"), raw.alias("raw"))
    return rows.groupBy("error_type", gates.hazard_level(F.col("raw"), F.col("error_type")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@rule("""SELECT CASE event_id % 7 WHEN 0 THEN 'missing_overall_score' WHEN 1 THEN 'non_finite_overall_score' WHEN 2 THEN 'non_finite_overall_score' WHEN 3 THEN 'invalid_overall_score'
  WHEN 4 THEN 'missing_overall_score' ELSE 'counted' END AS reason, count(*) AS n FROM events GROUP BY 1""")
def score_exclusions(spark, d):
    raw = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, ("NaN", "-inf", "abc", "true", "3.25", "4"))), (F.col("event_id") % 7).cast("int"))
    rows = A.table(spark, d, "events").select(F.coalesce(gates.exclusion_reason(raw), F.lit("counted")).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@rule("""WITH e AS (SELECT l_orderkey AS case_id, l_linenumber AS error_index, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
j AS (SELECT *, CASE WHEN p % 4 = 3 OR (s % 10) / 10e0 < 0.8e0 THEN 'abstain' WHEN p % 4 = 0 THEN 'unsupported' WHEN p % 4 = 1 THEN 'incorrect_error_type' ELSE 'supported' END AS eff FROM e)
SELECT case_id, count(*) AS deterministic, count(*) FILTER (eff <> 'unsupported') AS retained, count(*) FILTER (eff = 'unsupported') AS rejected,
  count(*) FILTER (eff = 'incorrect_error_type') AS modified, count(*) FILTER (eff = 'abstain') AS abstained, bool_and(p % 4 <> 3) AS complete FROM j GROUP BY case_id""")
def error_adjudication(spark, d):
    base = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("error_index")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    errors = base.select("case_id", "error_index", F.lit("false_finding").alias("error_type"))
    kinds = F.array(*map(F.lit, ("unsupported", "incorrect_error_type", "supported")))
    said = base.where("p % 4 < 3").select("case_id", "error_index", F.get(kinds, (F.col("p") % 4).cast("int")).alias("disposition"), ((F.col("s") % 10) / 10).alias("confidence"), F.lit("contradiction").alias("suggested_type"))
    return gates.adjudication_counts(gates.adjudicated(errors, said), ["case_id"])


@rule("""WITH p AS (SELECT conv_id AS case_id, turn + 1 AS page, CASE WHEN (conv_id + turn) % 9 = 0 THEN 0 ELSE length(text) END AS chars, conv_id % 4 = 0 AND turn = 0 AS warned
  FROM conversations WHERE NOT (turn = 1 AND conv_id % 10 = 0)),
b AS (SELECT case_id, bool_or(chars = 0) AS e, NOT (min(page) = 1 AND max(page) = count(*) AND count(DISTINCT page) = count(*)) AS s, bool_or(warned) AS w FROM p GROUP BY case_id)
SELECT case_id, concat_ws(';', CASE WHEN e THEN 'empty_page' END, CASE WHEN s THEN 'page_sequence' END, CASE WHEN w THEN 'page_warning' END) AS reasons FROM b WHERE e OR s OR w""")
def page_quality_blockers(spark, d):
    pages = A.table(spark, d, "conversations").where("NOT (turn = 1 AND conv_id % 10 = 0)").select(
        F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("page"), F.lit(True).alias("retained"),
        F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, 0).otherwise(F.char_length("text")).alias("chars"),
        F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 0), F.array(F.lit("possible_truncation"))).alias("warnings"),
    )
    return gates.page_blockers(pages).select("case_id", F.array_join("reasons", ";").alias("reasons"))


@rule("""WITH d AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, event_type AS m, count(*) AS c FROM events WHERE event_type = 'view' OR event_id % 3 <> 0 GROUP BY 1, 2),
m AS (SELECT DISTINCT event_type AS m FROM events)
SELECT 'coverage:' || m.m AS blocker FROM m LEFT JOIN (SELECT m, count(*) AS n FROM r GROUP BY 1) x ON x.m = m.m WHERE coalesce(x.n, 0) <> (SELECT count(*) FROM d) AND (SELECT count(*) FROM m) > 1
UNION ALL SELECT 'duplicate:' || CAST(user_id AS VARCHAR) || ':' || m FROM r WHERE c > 1""")
def benchmark_selection_blockers(spark, d):
    events = A.table(spark, d, "events")
    pairs = events.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("model"))
    rows = events.where("event_type = 'view' OR event_id % 3 <> 0").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("model"))
    return gates.benchmark_blockers(pairs, rows)


@rule("""WITH o AS (SELECT o_orderkey, md5(o_orderstatus) AS h, o_orderkey % 3 <> 0 AS has, o_orderkey % 7 = 0 AS changed, o_orderkey % 11 = 0 AS failed FROM orders)
SELECT CASE WHEN NOT has THEN 'compute' WHEN changed OR failed THEN 'error' ELSE 'reuse' END AS decision,
  CASE WHEN NOT has THEN '' ELSE concat_ws(';', CASE WHEN failed THEN 'status' END, CASE WHEN changed THEN 'h' END) END AS mismatch, count(*) AS n FROM o GROUP BY 1, 2""")
def reuse_decisions(spark, d):
    wanted = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.md5("o_orderstatus").alias("h"))
    status = F.when(F.col("case_id") % 11 == 0, "failed").otherwise("succeeded")
    old = wanted.where("case_id % 3 <> 0").select("case_id", status.alias("status"), F.when(F.col("case_id") % 7 == 0, "old").otherwise(F.col("h")).alias("h"))
    rows = reuse.reusable(wanted, old, "case_id", ["h"]).withColumn("mismatch", F.array_join("mismatch", ";"))
    return rows.groupBy("decision", "mismatch").agg(F.count(F.lit(1)).alias("n"))


@rule("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS n FROM lineitem)
SELECT l_orderkey AS case_id, 'candidate-' || CASE WHEN n < 10 THEN '0' ELSE '' END || CAST(n AS VARCHAR) AS candidate_id, 'model-' || CASE WHEN n < 10 THEN '0' ELSE '' END || CAST(n AS VARCHAR) AS blinded_model_id,
  'm' || CAST(l_suppkey % 8 AS VARCHAR) AS model FROM r""")
def blinded_candidates(spark, d):
    return annotation.blinded(A.reports(spark, d), ["pos", "k1", "k2", "k3"], ["model"])[1]


@rule("""WITH h AS (SELECT l_orderkey AS case_id, l_linenumber AS i, 'img/' || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) AS path, 'u' || CAST(l_suppkey % 3 AS VARCHAR) || ':2x2' AS k,
  CASE l_partkey % 5 WHEN 0 THEN 'ax flair' WHEN 1 THEN 't2 sag' ELSE 'scout' END AS words FROM lineitem),
s AS (SELECT case_id, k, count(*) AS n, min(path) AS p, arg_min(words, row(i, path)) AS w FROM h GROUP BY 1, 2),
t AS (SELECT s.*, CASE WHEN o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 2 = 0 THEN CASE WHEN contains(w, 'flair') THEN 'flair' WHEN contains(w, 't2') THEN 't2' ELSE 'largest' END ELSE 'largest' END AS y
  FROM s JOIN orders ON o_orderkey = case_id),
f AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE y WHEN 'flair' THEN 100 WHEN 't2' THEN 20 ELSE 0 END DESC, n DESC, p) AS r FROM t)
SELECT case_id, k AS series_key, n, y AS series_type, CASE y WHEN 'largest' THEN 'largest_series' ELSE 'brain_mri_' || y || '_preferred' END AS reason FROM f WHERE r = 1""")
def series_choice(spark, d):
    words = F.when(F.col("l_partkey") % 5 == 0, "Ax FLAIR").when(F.col("l_partkey") % 5 == 1, "T2 sag").otherwise("scout")
    path = F.concat(F.lit("img/"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string"))
    none = F.lit(None).cast("string")
    headers = A.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), path.alias("path"), F.col("l_linenumber").alias("instance"), F.concat(F.lit("u"), (F.col("l_suppkey") % 3).cast("string")).alias("series_uid"),
        F.lit(2).alias("rows"), F.lit(2).alias("columns"), words.alias("description"), none.alias("protocol"), none.alias("sequence"),
    )
    cases = A.cases(spark, d).withColumn("body_part", F.when(F.col("case_id") % 2 == 0, "Brain").otherwise("hip"))
    return series.chosen_series(headers, cases)


@rule("""WITH g AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS error_index FROM lineitem WHERE l_linenumber <= 3),
a AS (SELECT l_orderkey AS case_id, l_linenumber - 1 AS error_index, count(*) AS n FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1, 2),
k AS (SELECT coalesce(g.case_id, a.case_id) AS case_id, CASE WHEN a.n IS NULL THEN 'missing_index' WHEN g.case_id IS NULL THEN 'extra_index' WHEN a.n > 1 THEN 'repeated_index' END AS problem
  FROM g FULL JOIN a ON g.case_id = a.case_id AND g.error_index = a.error_index
  UNION ALL SELECT l_orderkey, 'unknown_id' FROM lineitem WHERE l_partkey % 2 = 0 AND l_suppkey % 4 = 3)
SELECT case_id, problem, count(*) AS n FROM k WHERE problem IS NOT NULL GROUP BY 1, 2""")
def judge_response_coverage(spark, d):
    lines = A.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "case_id")
    name = F.concat(F.lit("f"), (F.col("l_suppkey") % 4).cast("string"))
    requested = lines.where("l_linenumber <= 3").select("case_id", F.col("l_linenumber").alias("error_index"))
    answers = lines.where("l_partkey % 2 = 0").select("case_id", (F.col("l_linenumber") - 1).alias("error_index"), F.array(name).alias("cited"))
    ids = lines.where("l_suppkey % 4 <> 3").select("case_id", name.alias("id"))
    return composites.judge_coverage(requested, answers, ids)


@rule("""WITH r AS (SELECT l_returnflag, l_linestatus, l_partkey % 7 AS u, CASE WHEN l_returnflag = 'A' THEN 'artifact_reuse' WHEN l_returnflag = 'N' THEN 'fresh_cli' WHEN l_linestatus = 'F' THEN 'mock_fallback' ELSE 'cloud_fallback' END AS source FROM lineitem),
t AS (SELECT *, CASE source WHEN 'artifact_reuse' THEN 'artifact' WHEN 'mock_fallback' THEN 'mock' WHEN 'cloud_fallback' THEN 'debug_fallback' ELSE 'exploratory_fresh' END AS tier FROM r)
SELECT source, tier, count(*) AS n, count(*) FILTER (u = 2 OR tier IN ('mock', 'debug_fallback') OR (u = 1 AND tier <> 'exploratory_fresh')) AS blocked FROM t GROUP BY 1, 2""")
def blocking_fallbacks(spark, d):
    flag = F.get(F.array(*map(F.lit, ("false", "true", "perhaps"))), (F.col("k2") % 7).cast("int"))
    rows = A.reports(spark, d).withColumn("blocked", composites.blocking_fallback(F.col("evidence_tier"), F.col("source"), flag))
    return rows.groupBy("source", F.col("evidence_tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("blocked"))


@rule("""WITH w AS (SELECT o_orderkey AS case_id, 'm' || CAST(m AS VARCHAR) AS model, m FROM orders, (VALUES (0), (1)) v(m))
SELECT model, CASE WHEN (case_id + m) % 3 = 0 THEN 'fresh' WHEN case_id % 4 <> 0 THEN 'exploratory_fresh' ELSE 'none' END AS evidence_tier, count(*) AS n FROM w GROUP BY 1, 2""")
def generation_fallbacks(spark, d):
    wanted = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(F.array(F.lit("m0"), F.lit("m1"))).alias("model"))
    number = F.substring("model", 2, 1).cast("int")
    local = wanted.withColumn("report", F.when((F.col("case_id") + number) % 3 == 0, "text").otherwise(" "))
    backup = wanted.where("case_id % 4 <> 0").withColumn("report", F.lit("other"))
    return composites.with_fallback(wanted, local, backup, mock=False).groupBy("model", "evidence_tier").agg(F.count(F.lit(1)).alias("n"))


@rule("""SELECT l_orderkey AS case_id, coalesce(string_agg('line ' || CAST(l_linenumber AS VARCHAR), chr(10) ORDER BY l_linenumber) FILTER (l_partkey % 3 <> 0), '') AS report FROM lineitem GROUP BY 1""")
def reconstructed_reports(spark, d):
    text = F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))).otherwise(" ")
    return composites.reconstructed_report(A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("pos"), text.alias("source_text")))
