"""Queries of the evaluation and work operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up
from tessera.operators import evaluation as E
from tessera.operators import gates, matching, ontology, statistics, work
from tessera.plans import adapters as A
from tessera.plans.oracle import _CASES, _FINDINGS, _HAZARDS, _REPORTS, _VALUES, _r, _with
from tessera.plans.value_queries import picked

EVALUATIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EVALUATIONS_SQL: dict[str, str] = {}


def evaluation(sql: str | None = None):
    def put(f):
        EVALUATIONS[f.__name__] = f
        if sql:
            EVALUATIONS_SQL[f.__name__] = sql
        return f

    return put


def _levels(spark, d):
    rows = A.hazards(spark, d)
    decision = F.struct(F.col("abstain"), F.col("review_level").alias("hazard_level"))
    return rows.withColumn("level", E.consensus_level(F.col("level"), F.col("level") != F.col("review_level"), decision))


_LEVELS = _HAZARDS + """, lv AS (SELECT case_id, error_type, CASE WHEN level = review_level THEN level WHEN NOT abstain THEN review_level END AS level FROM hazards),
  ch AS (SELECT case_id, count(*) AS errors, coalesce(max(level), 0) AS max_level, count(*) FILTER (WHERE level >= 3) AS material, count(*) FILTER (WHERE level >= 2) AS nontrivial, count(*) FILTER (WHERE level IS NULL) AS unresolved FROM lv GROUP BY case_id)"""


@evaluation(_with(_LEVELS) + "SELECT * FROM ch")
def case_hazard_metrics(spark, d):
    return E.case_hazards(_levels(spark, d))


@evaluation(_with(_CASES, _LEVELS) + f""", j AS (SELECT c.modality, coalesce(errors, 0) AS errors, coalesce(max_level, 0) AS max_level, coalesce(material, 0) AS material, coalesce(nontrivial, 0) AS nontrivial, coalesce(unresolved, 0) AS unresolved FROM cases c LEFT JOIN ch USING (case_id))
SELECT modality, count(*) AS cases, count(*) FILTER (WHERE errors > 0) AS with_errors, count(*) FILTER (WHERE material > 0) AS with_material, count(*) FILTER (WHERE unresolved > 0) AS with_unresolved, CAST(sum(errors) AS BIGINT) AS errors,
  CAST(sum(material) AS BIGINT) AS material, CAST(sum(nontrivial) AS BIGINT) AS nontrivial, {_r('avg(max_level)', 4)} AS mean_max_level, max(max_level) AS max_level, {_r('count(*) FILTER (WHERE material > 0) / count(*)', 4)} AS material_rate FROM j GROUP BY modality""")
def evaluation_summary(spark, d):
    return E.evaluation_summary(A.cases(spark, d), _levels(spark, d), ["modality"])


@evaluation(_with(_REPORTS) + f"""SELECT model, count(x) AS count, {_r('avg(x)', 4)} AS mean, {_r('min(x)', 4)} AS min, {_r('max(x)', 4)} AS max FROM (SELECT model, CASE WHEN k2 % 5 <> 0 THEN k3 END AS x FROM reports) GROUP BY model""")
def numeric_summaries(spark, d):
    rows = A.reports(spark, d).select("model", F.when(F.col("k2") % 5 == 0, float("nan")).otherwise(F.col("k3")).alias("x"))
    return E.numeric_summary(rows, "x", ["model"])


@evaluation(_with(_CASES, _REPORTS) + """, n AS (SELECT case_id, count(*) AS n FROM reports GROUP BY case_id) SELECT modality, min(n) AS min, median(n) AS median, max(n) AS max FROM n JOIN cases USING (case_id) GROUP BY modality""")
def case_distribution(spark, d):
    sizes = A.reports(spark, d).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return E.distribution(sizes.join(A.cases(spark, d).select("case_id", "modality"), "case_id"), "n", ["modality"])


@evaluation(_with(_REPORTS) + """SELECT 'model' AS kind, CASE WHEN k2 % 9 = 0 THEN 'unknown' ELSE model END AS value, count(*) AS n FROM reports GROUP BY value UNION ALL SELECT 'quality', quality, count(*) FROM reports GROUP BY quality
  UNION ALL SELECT 'level', CAST(1 + k2 % 5 AS VARCHAR), count(*) FROM reports GROUP BY 2""")
def experiment_histograms(spark, d):
    rows = A.reports(spark, d).select(F.when(F.col("k2") % 9 != 0, F.col("model")).otherwise("").alias("model"), "quality", (1 + F.col("k2") % 5).alias("level"))
    return E.histograms(rows, ["model", "quality", "level"])


@evaluation(_with(_HAZARDS) + f""", s AS (SELECT c_custkey AS case_id, i AS idx, 1 + (c_custkey + i) % 5 AS level, (c_custkey + i) % 3 AS action, r AS rep, 1 + (c_custkey + i + CASE WHEN (c_custkey + r) % 4 = 0 THEN 1 ELSE 0 END) % 5 AS l, (c_custkey + i + r) % 3 AS a,
    c_custkey % 7 = 0 AS fallback, (c_custkey + r) % 6 = 0 AS short FROM customer, range(3) t(i), range(2) u(r)),
  x AS (SELECT case_id, bool_or(fallback) AS blocked, count(*) FILTER (WHERE NOT short) AS c, count(*) FILTER (WHERE NOT short AND level = l) AS e, count(*) FILTER (WHERE NOT short AND abs(level - l) <= 1) AS w, count(*) FILTER (WHERE NOT short AND action = a) AS g FROM s GROUP BY case_id)
SELECT case_id, 3 AS runs, CASE WHEN blocked THEN 'blocked' ELSE 'complete' END AS status, CASE WHEN blocked THEN 0 ELSE c END AS compared, CASE WHEN NOT blocked AND c > 0 THEN {_r('e / c', 4)} END AS exact_rate,
  CASE WHEN NOT blocked AND c > 0 THEN {_r('w / c', 4)} END AS within_one_rate, CASE WHEN NOT blocked AND c > 0 THEN {_r('g / c', 4)} END AS action_rate FROM x""")
def retest_consistency(spark, d):
    key = F.col("c_custkey")
    first = A.table(spark, d, "customer").select(key.alias("case_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("index"), key, (key % 7 == 0).alias("fallback"))
    first = first.select("case_id", "index", (1 + (key + F.col("index")) % 5).alias("level"), ((key + F.col("index")) % 3).alias("action"), "fallback")
    both = first.select("case_id", "index", "fallback", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("repeat"))
    case, i, r = F.col("case_id"), F.col("index"), F.col("repeat")
    moved = F.when((case + r) % 4 == 0, 1).otherwise(0)
    repeats = both.select("case_id", "repeat", "index", (1 + (case + i + moved) % 5).alias("level"), ((case + i + r) % 3).alias("action"), F.lit(False).alias("fallback"))
    return E.retest_consistency(first, repeats.where(((F.col("case_id") + F.col("repeat")) % 6 != 0) | (F.col("index") < 2)))


@evaluation(f"""WITH s AS (SELECT p_partkey, p_size % 7 AS a, p_partkey % 6 AS b, 3 AS c FROM part), v AS (SELECT p_partkey, x FROM s, LATERAL (VALUES (a), (b), (c)) t(x) WHERE x BETWEEN 1 AND 5)
SELECT s.p_partkey, {_r('avg(x)', 4)} AS mean, CASE WHEN a BETWEEN 1 AND 5 AND a <= 3 AND (b NOT BETWEEN 1 AND 5 OR a <= b) THEN 'first' WHEN b BETWEEN 1 AND 5 AND b <= 3 THEN 'second' ELSE 'third' END AS weakest
FROM s JOIN v USING (p_partkey) GROUP BY s.p_partkey, a, b""")
def likert_means(spark, d):
    scores = F.array((F.col("p_size") % 7).cast("double"), (F.col("p_partkey") % 6).cast("double"), F.lit(3.0))
    return A.table(spark, d, "part").select("p_partkey", E.likert_mean(scores).alias("mean"), E.weakest(["first", "second", "third"], scores).alias("weakest"))


@evaluation(_with(_CASES, _REPORTS) + f"""SELECT reader, {_r('count(*) / count(DISTINCT case_id)', 4)} AS finding_density, {_r("1e0 - count(*) FILTER (WHERE quality = 'failed') / count(*)", 4)} AS pass_rate,
  {_r("count(*) FILTER (WHERE source = 'fresh_cli') / count(*)", 4)} AS real_rate FROM reports JOIN cases USING (case_id) GROUP BY reader""")
def proxy_rates(spark, d):
    by_case = A.reports(spark, d).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == "failed").alias("f"), F.count_if(F.col("source") == "fresh_cli").alias("r"))
    rows = by_case.join(A.cases(spark, d).select("case_id", "reader"), "case_id").groupBy("reader").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), F.sum("f").alias("f"), F.sum("r").alias("r"))
    return rows.select("reader", *E.proxy_rates(F.col("n"), F.col("c"), F.col("n"), F.col("f"), F.col("r"), F.col("n")))


@evaluation(f"""SELECT CASE WHEN s % 5 = 4 THEN 'unknown' ELSE 'b' || CAST(s % 5 AS VARCHAR) END AS backend, count(*) AS total, count(*) FILTER (WHERE p % 3 = 0) AS mock, {_r('count(*) FILTER (WHERE p % 3 = 0) / count(*)', 4)} AS mock_ratio
FROM (SELECT l_suppkey AS s, l_partkey AS p FROM lineitem) GROUP BY backend""")
def honesty_audit(spark, d):
    s = F.col("l_suppkey") % 5
    rows = A.table(spark, d, "lineitem").select(F.when(s != 4, F.concat(F.lit("b"), s.cast("string"))).alias("backend"), F.when(F.col("l_partkey") % 3 == 0, "Deterministic MVP score").otherwise("seen").alias("explanation"))
    return E.honesty_audit(rows)


@evaluation(_with(_CASES, _REPORTS) + """, f AS (SELECT reader AS claim, 'gates' AS family, bool_and(quality <> 'failed' OR k2 % 4 <> 0) AS ok FROM reports JOIN cases USING (case_id) GROUP BY reader UNION ALL SELECT reader, 'volume', count(*) >= 120 FROM cases GROUP BY reader
  UNION ALL SELECT reader, 'scores', avg(finding_coverage) > 0.505e0 FROM reports JOIN cases USING (case_id) GROUP BY reader)
SELECT claim, bool_and(ok) AS passed, coalesce(string_agg(CASE WHEN NOT ok THEN family END, ';' ORDER BY family), '') AS failed FROM f GROUP BY claim""")
def evidence_gates(spark, d):
    cases = A.cases(spark, d)
    rows = A.reports(spark, d).join(cases.select("case_id", "reader"), "case_id").groupBy(F.col("reader").alias("claim"))
    both = rows.agg(F.bool_and((F.col("quality") != "failed") | (F.col("k2") % 4 != 0)).alias("gates"), (F.avg("finding_coverage") > 0.505).alias("scores"))
    sizes = cases.groupBy(F.col("reader").alias("claim")).agg((F.count(F.lit(1)) >= 120).alias("volume"))
    return E.evidence_gate(both.unpivot(["claim"], ["gates", "scores"], "family", "passed").unionByName(sizes.unpivot(["claim"], ["volume"], "family", "passed")))


@evaluation("SELECT 'cases' AS field, count(*) AS value FROM orders UNION ALL SELECT 'reports', count(*) FROM lineitem UNION ALL SELECT 'runs', count(*) FROM events")
def run_dashboard(spark, d):
    return E.dashboard({"cases": A.table(spark, d, "orders"), "reports": A.table(spark, d, "lineitem"), "runs": A.table(spark, d, "events")})


@evaluation("""SELECT reader, f.field, f.value, 'run' AS source FROM (SELECT 'reader_' || CAST(o_custkey % 12 AS VARCHAR) AS reader, count(*) AS cases, max(o_orderkey) AS last_case FROM orders GROUP BY reader),
  LATERAL (VALUES ('cases', CAST(cases AS VARCHAR)), ('last_case', CAST(last_case AS VARCHAR))) f(field, value)""")
def summary_fields(spark, d):
    rows = A.cases(spark, d).groupBy("reader").agg(F.count(F.lit(1)).alias("cases"), F.max("case_id").alias("last_case"))
    return E.long_format(rows, ["reader"], "run")


@evaluation("""SELECT o_custkey, o_orderstatus, f AS first_row, o_orderkey AS "row" FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) AS f FROM orders) WHERE o_orderkey > f""")
def duplicate_rows(spark, d):
    return E.duplicates(A.table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@evaluation("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
v AS (SELECT l_orderkey AS case_id, CASE WHEN l_partkey % 10 = 0 THEN 'abstain' WHEN l_partkey % 10 < 4 THEN 'issues_found' ELSE 'pass' END AS verdict, l_quantity / 100 AS confidence, CASE WHEN l_partkey % 10 < 4 THEN l_partkey % 3 END AS issue, (k - 1) // 3 AS chunk FROM c)
SELECT case_id, CASE WHEN bool_or(verdict = 'abstain') THEN 'abstain' WHEN bool_or(verdict = 'issues_found') THEN 'issues_found' ELSE 'pass' END AS verdict, min(confidence) AS confidence, count(DISTINCT issue) AS issues, max(chunk) + 1 AS chunks FROM v GROUP BY case_id""")
def merged_verdicts(spark, d):
    rows = A.table(spark, d, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    parts = E.chunk(rows, ["l_orderkey"], "at", 3)
    k = F.col("l_partkey") % 10
    issues = F.when(k < 4, F.array(F.format_string('{"kind":%d}', F.col("l_partkey") % 3))).otherwise(F.array().cast("array<string>"))
    chunks = parts.select(F.col("l_orderkey").alias("case_id"), "chunk", F.when(k == 0, "abstain").when(k < 4, "issues_found").otherwise("pass").alias("verdict"), (F.col("l_quantity") / 100).alias("confidence"), issues.alias("issues"))
    counts = chunks.groupBy("case_id").agg((F.max("chunk") + 1).alias("chunks"))
    return E.merged_verdicts(chunks, ["case_id"]).join(counts, "case_id")


@evaluation()
def evidence_budgets(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", E.evidence_budget(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("spans"), F.coalesce(F.aggregate("s", F.lit(0), lambda a, x: a + x["length"]), F.lit(0)).alias("chars"), F.element_at(F.col("s.start"), -1).alias("last_start"))


@evaluation("""WITH p AS (SELECT p_partkey, concat_ws(';', CASE WHEN p_partkey % 5 = 0 THEN 'missing_error_type' WHEN p_partkey % 5 = 1 THEN 'error_type_mismatch' END, CASE WHEN p_size % 7 = 0 OR p_size % 7 > 5 THEN 'hazard_level' END,
  CASE WHEN p_partkey % 6 = 0 THEN 'explanation' END, CASE WHEN p_size % 4 = 0 THEN 'recommended_action' END, CASE WHEN p_size > 40 THEN 'confidence' END, CASE WHEN p_partkey % 11 = 0 THEN 'abstain' END, CASE WHEN p_partkey % 4 <> 2 THEN 'evidence_ids' END) AS problems FROM part)
SELECT problems, count(*) AS n FROM p GROUP BY problems""")
def judgement_problems(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    problems = E.judgement_problems(
        key % 4, F.lit("false_finding"), F.when(key % 5 == 0, "").when(key % 5 == 1, "omission_finding").otherwise("false_finding"), size % 7, F.when(key % 6 != 0, F.col("p_name")).otherwise(" "),
        picked(size, "else", "no_action", "urgent_review", "radiologist_review"), size / 40, F.when(key % 11 != 0, False), F.array(F.lit("e3"), F.lit("e9")),
    )
    return A.table(spark, d, "part").groupBy(F.array_join(problems, ";").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


@evaluation(_with(_REPORTS) + """, s AS (SELECT 'm' || CAST(s_suppkey % 5 AS VARCHAR) AS model, count(*) AS n FROM supplier GROUP BY model) SELECT model, count(*) AS reports, count(*) * coalesce(any_value(s.n), 0) AS selected FROM reports r LEFT JOIN s USING (model) GROUP BY model""")
def selected_counts(spark, d):
    return work.selected_counts(A.reports(spark, d), A.table(spark, d, "supplier").select(F.concat(F.lit("m"), (F.col("s_suppkey") % 5).cast("string")).alias("model")))


@evaluation("""WITH s AS (SELECT c_nationkey AS run_id, string_agg(c_custkey || ':' || c_mktsegment, ';' ORDER BY c_custkey) AS stages FROM customer GROUP BY run_id), a AS (SELECT s_nationkey AS run_id, string_agg(s_suppkey || ':' || s_name, ';' ORDER BY s_suppkey) AS artifacts FROM supplier GROUP BY run_id)
SELECT r.run_id, stages, artifacts FROM (SELECT unnest(range(26)) AS run_id) r LEFT JOIN s USING (run_id) LEFT JOIN a USING (run_id)""")
def run_details(spark, d):
    stages = A.table(spark, d, "customer").select(F.col("c_nationkey").alias("run_id"), F.col("c_custkey").alias("stage_id"), F.col("c_mktsegment").alias("x"))
    artifacts = A.table(spark, d, "supplier").select(F.col("s_nationkey").alias("run_id"), F.col("s_suppkey").alias("artifact_id"), F.col("s_name").alias("x"))
    found = work.run_details(spark.range(26).withColumnRenamed("id", "run_id"), stages, artifacts)
    joined = lambda c, key: F.array_join(F.transform(c, lambda x: F.concat(x[key].cast("string"), F.lit(":"), x["x"])), ";").alias(c)
    return found.select("run_id", joined("stages", "stage_id"), joined("artifacts", "artifact_id"))


@evaluation("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'missing_primary' ELSE 'hash_mismatch' END AS problem FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0""")
def unbound_audits(spark, d):
    digest = lambda c: F.sha2(c, 256).alias("digest")
    parts = A.table(spark, d, "part")
    audits = parts.select("p_partkey", digest(F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name"))))
    return work.unbound(audits, parts.where("p_partkey % 7 <> 0").select("p_partkey", digest(F.col("p_name"))), ["p_partkey"])


@evaluation("""WITH f AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS pos FROM lineitem), e AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber % 4 + 1 AS pos FROM lineitem WHERE l_partkey % 3 = 0),
m AS (SELECT f.*, e.pos IS NOT NULL AS hit, min(f.pos) OVER (PARTITION BY f.case_id) = f.pos AS first, f.case_id IN (SELECT case_id FROM e) AS known FROM f LEFT JOIN e ON f.case_id = e.case_id AND f.pos = e.pos)
SELECT case_id, pos FROM m WHERE hit OR (NOT known AND first)""")
def targeted_findings(spark, d):
    rows = A.table(spark, d, "lineitem")
    findings = rows.select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("F"), F.col("l_linenumber").cast("string")).alias("finding_id"), F.col("l_linenumber").alias("pos")).distinct()
    name = F.concat(F.lit("f"), (F.col("l_linenumber") % 4 + 1).cast("string"))
    none = F.lit(None).cast("string")
    kind = F.when(F.col("l_partkey") % 3 == 0, "omission_finding").otherwise("contradiction")
    errors = rows.select(F.col("l_orderkey").alias("case_id"), kind.alias("error_type"), none.alias("finding"), F.when(F.col("l_partkey") % 2 == 0, name).alias("candidate"), F.when(F.col("l_partkey") % 2 == 1, name).alias("reference"), F.lit("").alias("a"), none.alias("b"))
    return work.targeted(findings, errors).select("case_id", "pos")


@evaluation("""SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events""")
def stage_attempts(spark, d):
    rows = A.table(spark, d, "events").select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.struct("ts", "event_id").alias("at"))
    return work.attempts(rows, "at").select("event_id", "attempt")


@evaluation("""WITH e AS (SELECT *, last_value(CASE WHEN event_type IN ('view', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM events)
SELECT event_type AS stage, coalesce(st = 'view', false) AS legal, count(*) AS n FROM e WHERE event_type NOT IN ('view', 'error') GROUP BY ALL""")
def stage_starts(spark, d):
    kind = F.col("event_type")
    run = kind.isin("view", "error")
    rows = A.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.when(~run, kind).alias("stage"), F.when(kind == "view", "running").when(kind == "error", "failed").otherwise("started").alias("status"), F.struct("ts", "event_id").alias("at"))
    return work.stage_starts(rows, "at").groupBy("stage", "legal").agg(F.count(F.lit(1)).alias("n"))


@evaluation("""WITH e AS (SELECT p_brand, p_partkey, p_partkey % 3 = 0 AS fresh, p_size % 4 = 0 OR p_size % 4 = 1 AS fits FROM part) SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY NOT fresh, NOT fits, p_partkey) AS rank FROM e""")
def ranked_entries(spark, d):
    size = F.col("p_size") % 4
    parts = F.when(size == 0, F.array(F.lit("CHEST"), F.lit("head"))).when(size == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("knee")))
    rows = A.table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("entry"), (F.col("p_partkey") % 3 == 0).alias("fresh"), parts.alias("body_parts"))
    return work.ranked_entries(rows, F.lit("chest"), ["p_brand"]).select("p_brand", F.col("entry").alias("p_partkey"), "rank")


@evaluation("""SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 9 = 0 THEN 1000000000 ELSE o_orderkey * 2 END AS ordinal FROM orders""")
def manifest_order(spark, d):
    cases = A.cases(spark, d).select("case_id")
    return work.in_manifest_order(cases, cases.where("case_id % 9 <> 0").select("case_id", (F.col("case_id") * 2).alias("ordinal")))


@evaluation("""SELECT candidate, repeat, status, count(*) AS n, sum(case_id) AS cases FROM (SELECT o_orderkey AS case_id FROM orders), (VALUES ('a'), ('b')) c(candidate), (VALUES (1), (2)) r(repeat), (VALUES ('blocked')) s(status) GROUP BY ALL""")
def work_list(spark, d):
    rows = work.work_list(A.cases(spark, d), ["a", "b"], 2)
    return rows.groupBy("candidate", "repeat", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("case_id").alias("cases"))


@evaluation("""SELECT repeat, CASE WHEN o_orderkey % 3 = 0 THEN 'blocked' WHEN o_orderkey % 2 = 0 THEN 'succeeded' ELSE 'review_required' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'missing_result' END AS problem, count(*) AS n
FROM orders, (VALUES (1), (2)) r(repeat) GROUP BY ALL UNION ALL SELECT 3, 'succeeded', 'extra_result', count(*) FROM orders WHERE o_orderkey % 10 = 0""")
def persisted_results(spark, d):
    cases = A.cases(spark, d)
    wanted = work.work_list(cases, ["a"], 2)
    status = F.when(F.col("case_id") % 2 == 0, "succeeded").otherwise("review_required")
    results = wanted.where("case_id % 3 <> 0").select("case_id", "candidate", "repeat", status.alias("status"))
    extra = cases.where("case_id % 10 = 0").select("case_id", F.lit("a").alias("candidate"), F.lit(3).alias("repeat"), F.lit("succeeded").alias("status"))
    return work.with_results(wanted, results.unionByName(extra)).groupBy("repeat", "status", "problem").agg(F.count(F.lit(1)).alias("n"))


@evaluation("""WITH c AS (SELECT p_brand, p_partkey % 8 = 0 AS audit, CASE WHEN p_size % 9 = 0 OR p_size % 5 = 0 OR p_partkey % 7 = 0 THEN 'blocked' WHEN p_partkey % 7 = 1 THEN 'review_required' ELSE 'succeeded' END AS class FROM part)
SELECT p_brand, count(*) FILTER (WHERE NOT audit AND class = 'succeeded') AS succeeded, count(*) FILTER (WHERE NOT audit AND class = 'review_required') AS review_required, count(*) FILTER (WHERE NOT audit AND class = 'blocked') AS blocked, count(*) FILTER (WHERE audit) AS audits FROM c GROUP BY p_brand""")
def candidate_classes(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    quality = F.when(key % 7 == 0, "blocked").when(key % 7 == 1, "review_required").otherwise("passed")
    rows = A.table(spark, d, "part").select("p_brand", F.when(key % 8 == 0, "audit").otherwise("candidate").alias("role"), work.candidate_class(F.when(size % 9 == 0, "timeout"), quality, F.when(size % 5 != 0, F.col("p_name")).otherwise(" ")).alias("class"))
    return work.class_counts(rows, ["p_brand"])


@evaluation("""SELECT n_nationkey AS ordinal, 'E' || n_nationkey AS experiment_id, n_name AS title, CASE WHEN s.n > 0 THEN 'evidence_available' WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 THEN 'ready_for_generation' ELSE 'missing_inputs' END AS status
FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY s_nationkey) s ON s_nationkey = n_nationkey""")
def protocol_rows(spark, d):
    name = lambda c: F.concat(F.lit("E"), F.col(c).cast("string")).alias("experiment_id")
    nations = A.table(spark, d, "nation")
    seen = A.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    experiments = nations.where("n_nationkey % 3 <> 0").join(seen, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    experiments = experiments.select(name("n_nationkey"), work.evidence_status(F.coalesce("n", F.lit(0)), F.col("n_nationkey") % 2 == 0).alias("status"))
    return work.protocol_rows(nations.select(F.col("n_nationkey").alias("ordinal"), name("n_nationkey"), F.col("n_name").alias("title")), experiments)


@evaluation("SELECT 'model' AS kind, p_brand AS name FROM part GROUP BY p_brand UNION ALL SELECT 'stage', event_type FROM events GROUP BY event_type UNION ALL SELECT 'provider', s_name FROM supplier GROUP BY s_name")
def capability_catalog(spark, d):
    return work.catalog(model=A.table(spark, d, "part").select("p_brand"), stage=A.table(spark, d, "events").select("event_type"), provider=A.table(spark, d, "supplier").select("s_name"))


@evaluation("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS old_index FROM part) SELECT p_partkey, old_index, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS new_index FROM o WHERE p_size % 3 <> 0""")
def gate_indices(spark, d):
    rows = A.table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") % 3 != 0).alias("passed"))
    return work.passed_with_place(rows, ["p_brand"], "p_partkey").select("p_partkey", "old_index", "new_index")


@evaluation("""SELECT CASE WHEN p_partkey % 6 = 0 THEN 'undecided' WHEN p_partkey % 6 = 1 THEN 'ambiguous' WHEN p_partkey % 6 = 2 THEN 'stale' WHEN p_size % 2 = 0 THEN 'abstained' ELSE 'resolved' END AS outcome, count(*) AS n FROM part GROUP BY outcome""")
def adjudication_outcomes(spark, d):
    parts = A.table(spark, d, "part")
    base = parts.select(F.col("p_partkey").alias("case_id"), F.lit(0).alias("error_index"), F.sha2("p_name", 256).alias("input_sha256"), (F.col("p_size") % 2 == 0).alias("abstain"))
    k = F.col("case_id") % 6
    decisions = base.where(k != 0).withColumn("input_sha256", F.when(k == 2, F.lit("old")).otherwise(F.col("input_sha256")))
    return work.decided(base.drop("abstain"), decisions.unionByName(decisions.where(k == 1))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@evaluation(_with(_FINDINGS) + """, k AS (SELECT case_id, observation, count(*) AS n FROM findings WHERE side = 'ref' GROUP BY case_id, observation) SELECT least(coalesce(k.n, 0), 2) AS matches, count(*) AS candidates FROM findings f LEFT JOIN k USING (case_id, observation) WHERE side = 'cand' GROUP BY 1""")
def finding_identities(spark, d):
    rows = A.findings(spark, d)
    found = work.identified(rows.where("side = 'cand'").select("case_id", "observation"), rows.where("side = 'ref'").select("case_id", "observation", "finding_id"), ["case_id", "observation"])
    named = F.when(F.col("finding_id").isNotNull(), 1).when(F.col("matches") == 0, 0).otherwise(2).cast("long")
    return found.groupBy(named.alias("matches")).agg(F.count(F.lit(1)).alias("candidates"))


def _reader_means(spark, d):
    rows = A.reports(spark, d).join(A.cases(spark, d).select("case_id", "reader"), "case_id")
    return statistics.unpivoted(rows, ["reader"]).groupBy("reader", "metric").agg(half_up(F.avg("value")).alias("mean"))


_ALL_MEANS = _with(_CASES, _REPORTS) + f""", am AS (SELECT reader, metric, {_r('avg(value)')} AS mean FROM (SELECT c.reader, m.metric, m.value FROM reports r JOIN cases c USING (case_id),
  LATERAL (VALUES ('likert_mean', r.likert_mean), ('structure_score', r.structure_score), ('finding_coverage', r.finding_coverage)) m(metric, value)) GROUP BY reader, metric)"""


@evaluation(_ALL_MEANS + " SELECT * FROM am WHERE reader NOT IN ('reader_1', 'reader_2') UNION ALL SELECT reader, 'likert_mean', 2.5e0 FROM (VALUES ('reader_1'), ('reader_2')) t(reader)")
def effective_statistics(spark, d):
    stored = spark.range(1, 3).select(F.concat(F.lit("reader_"), F.col("id").cast("string")).alias("reader"), F.lit("likert_mean").alias("metric"), F.lit(2.5).alias("mean"))
    return work.effective_statistics(stored, _reader_means(spark, d))


@evaluation(f"""WITH s AS (SELECT p_partkey AS report_id, [p_size % 7, p_partkey % 8, p_size % 6] AS v FROM part), x AS (SELECT report_id, unnest(['clarity', 'detail', 'style']) AS n, unnest(v) AS s FROM s), g AS (SELECT report_id, n, s FROM x WHERE s BETWEEN 1 AND 5)
SELECT s.report_id, CASE WHEN count(g.s) > 0 THEN 'suggestions_generated' ELSE 'blocked_insufficient_data' END AS status, arg_min(n, (g.s, n)) AS weakest_metric, min(g.s) AS weakest_score, {_r('avg(g.s)', 4)} AS overall_score FROM s LEFT JOIN g USING (report_id) GROUP BY s.report_id""")
def report_education(spark, d):
    scores = F.create_map(F.lit("style"), F.col("p_size") % 6, F.lit("clarity"), F.col("p_size") % 7, F.lit("detail"), (F.col("p_partkey") % 8).cast("int"))
    return work.report_education(A.table(spark, d, "part").select(F.col("p_partkey").alias("report_id"), scores.alias("scores")))


@evaluation(_ALL_MEANS + f""", p AS (SELECT *, (sum(mean) OVER (PARTITION BY metric) - mean) / (count(*) OVER (PARTITION BY metric) - 1) AS peer FROM am), f AS (SELECT reader, metric, mean, {_r('mean - peer', 4)} AS gap FROM p WHERE reader = 'reader_0'),
  w AS (SELECT *, gap < -0.001e0 AS weak, mean = min(mean) OVER () AS low, bool_or(gap < -0.001e0) OVER () AS any_weak FROM f) SELECT reader, metric, mean, gap FROM w WHERE weak OR (NOT any_weak AND low)""")
def reader_education(spark, d):
    gaps = statistics.peer_gap(_reader_means(spark, d).withColumnRenamed("mean", "value"), "reader").select("reader", "metric", "mean", "gap")
    return work.reader_education(gaps, -0.001)


@evaluation("""SELECT p_partkey AS path_key, length(p_name) AS length, sha256(p_name) AS sha256 FROM part""")
def text_inventory(spark, d):
    files = A.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.length("p_name").alias("length"), F.encode("p_name", "UTF-8").alias("content"))
    return work.file_digests(files).withColumnRenamed("path", "path_key")


@evaluation(f"""SELECT CASE WHEN p_partkey % 4 = 0 THEN 'mismatched_finding' WHEN p_partkey % 4 = 1 THEN 'omission_finding' ELSE 'contradiction' END AS error_type, CASE WHEN p_size % 3 = 0 THEN least(p_size, 5) WHEN p_partkey % 4 = 0 THEN 3 ELSE 4 END AS hazard_level,
  CASE WHEN p_size % 2 = 0 THEN 'seen' ELSE 'estimated' END AS explained, CASE WHEN p_size % 5 = 0 THEN 'urgent_review' ELSE 'review_if_relevant' END AS recommended_action, count(*) AS n FROM part GROUP BY ALL""")
def filled_hazards(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    found = gates.filled_hazard(F.when(size % 3 == 0, size.cast("string")).otherwise("high"), picked(key, "", "omission_finding", "contradiction", "contradiction"), F.when(size % 2 == 0, "seen"), F.when(size % 5 == 0, "urgent_review").otherwise(""))
    rows = A.table(spark, d, "part").select(found.alias("h")).select("h.*").withColumn("explained", F.when(F.col("explanation") == "seen", "seen").otherwise("estimated"))
    return rows.groupBy("error_type", "hazard_level", "explained", "recommended_action").agg(F.count(F.lit(1)).alias("n"))


@evaluation(_with(_CASES) + """, f AS (SELECT modality AS field, count(*) AS found FROM cases GROUP BY modality), s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'ct' WHEN 'O' THEN 'cxr' ELSE 'us' END AS field, count(*) - CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS declared FROM orders GROUP BY o_orderstatus)
SELECT coalesce(f.field, s.field) AS field, found, declared FROM f FULL JOIN s ON f.field = s.field WHERE found IS DISTINCT FROM declared""")
def run_count_problems(spark, d):
    found = A.cases(spark, d).groupBy(F.col("modality").alias("field")).agg(F.count(F.lit(1)).alias("value"))
    declared = found.select(F.when(F.col("field") == "mri", "us").otherwise(F.col("field")).alias("field"), (F.col("value") - F.when(F.col("field") == "cxr", 1).otherwise(0)).alias("value"))
    return gates.count_problems(found, declared)


@evaluation("""SELECT o_orderkey AS case_id, d.lang, d.source FROM orders LEFT JOIN documents d ON d.doc_id = o_orderkey""")
def cases_with_documents(spark, d):
    documents = A.table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("doc_id").cast("string").alias("path"), "lang", "source")
    return work.with_documents(A.cases(spark, d), documents).select("case_id", F.col("document.lang").alias("lang"), F.col("document.source").alias("source"))


def _registry(spark, d):
    key = F.col("p_partkey")
    new = F.format_string('{"schema_version": "2.0", "name": "%s", "modalities": ["ct", "mri"], "ready": true, "temperature": %d.5}', "p_name", F.col("p_size") % 3)
    old, bad = F.format_string('{"modality": "cxr", "brand": "%s"}', "p_brand"), F.lit('{"schema_version": "2.0", "ready": "perhaps", "temperature": "warm"}')
    return A.table(spark, d, "part").select(F.concat(F.lit("m"), key.cast("string")).alias("id"), F.when(key % 5 == 0, old).when(key % 5 == 1, bad).when(key % 5 == 2, F.lit("{")).otherwise(new).alias("body"))


@evaluation("""SELECT 'm' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'm' || p_partkey ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'cxr' ELSE 'ct;mri' END AS modalities, p_partkey % 5 <> 0 AS ready,
  CASE WHEN p_partkey % 5 = 0 THEN 0e0 ELSE p_size % 3 + 0.5e0 END AS temperature, p_partkey % 5 = 0 AS legacy FROM part WHERE p_partkey % 5 NOT IN (1, 2)""")
def registry_entries(spark, d):
    good, _ = work.registry_entries(_registry(spark, d))
    return good.withColumn("modalities", F.array_join("modalities", ";"))


@evaluation("""SELECT CASE WHEN p_partkey % 5 = 2 THEN 'body' ELSE f END AS field, count(*) AS n FROM part, (VALUES ('$.ready'), ('$.temperature')) t(f) WHERE p_partkey % 5 = 1 OR (p_partkey % 5 = 2 AND f = '$.ready') GROUP BY 1""")
def registry_errors(spark, d):
    return work.registry_entries(_registry(spark, d))[1].groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@evaluation("""SELECT n_nationkey AS ordinal, 'E' || n_nationkey AS experiment_id, coalesce(c.n, 0) AS n, CASE WHEN c.n > 0 THEN 'evidence_available' WHEN n_regionkey < 2 THEN 'ready_for_generation' ELSE 'missing_inputs' END AS status
FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) c ON c.s_nationkey = n_nationkey""")
def experiment_rows(spark, d):
    name = lambda c: F.concat(F.lit("E"), F.col(c).cast("string")).alias("experiment_id")
    nations = A.table(spark, d, "nation")
    counts = A.table(spark, d, "supplier").groupBy(name("s_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return work.experiment_rows(counts, nations.where("n_regionkey < 2").select(name("n_nationkey")), nations.select(F.col("n_nationkey").alias("ordinal"), name("n_nationkey")))


@evaluation(_with(_FINDINGS, _LEVELS) + f""", o AS (SELECT case_id, observation, count(*) FILTER (WHERE side = 'cand') AS c, count(*) FILTER (WHERE side = 'ref') AS r FROM findings GROUP BY case_id, observation),
  m AS (SELECT case_id, CAST(sum(c) AS BIGINT) AS n_cand, CAST(sum(r) AS BIGINT) AS n_ref, CAST(sum(least(c, r)) AS BIGINT) AS matched FROM o GROUP BY case_id),
  a AS (SELECT case_id, count(*) AS compared, count(*) FILTER (WHERE level = review_level) AS exact FROM hazards GROUP BY case_id)
SELECT o_orderkey AS case_id, coalesce(n_cand, 0) AS n_cand, coalesce(n_ref, 0) AS n_ref, {_r('matched / greatest(n_cand, 1)', 4)} AS precision, {_r('matched / greatest(n_ref, 1)', 4)} AS recall, coalesce(errors, 0) AS errors, coalesce(max_level, 0) AS max_level,
  coalesce(material, 0) AS material, coalesce(unresolved, 0) AS unresolved, coalesce(compared, 0) AS compared, {_r('exact / compared', 4)} AS exact_rate FROM orders LEFT JOIN m ON m.case_id = o_orderkey LEFT JOIN ch ON ch.case_id = o_orderkey LEFT JOIN a ON a.case_id = o_orderkey""")
def case_evaluation_metrics(spark, d):
    alignment = matching.alignment_metrics(A.findings(spark, d)).select("case_id", "n_cand", "n_ref", "precision", "recall")
    agreement = statistics.level_agreement(A.hazards(spark, d), "level", "review_level", ["case_id"]).select("case_id", "compared", "exact_rate")
    hazards = E.case_hazards(_levels(spark, d)).select("case_id", "errors", "max_level", "material", "unresolved")
    return E.case_metrics(A.cases(spark, d), alignment, hazards, agreement)


@evaluation("""WITH f AS (SELECT l_orderkey AS case_id, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY case_id) SELECT o_orderkey AS case_id, coalesce(n, 0) AS findings, least(1e0, coalesce(n, 0) / greatest(o_orderkey % 5, 1)) AS coverage, CASE WHEN n IS NULL THEN 'no_findings_extracted' END AS warning
FROM orders LEFT JOIN f ON case_id = o_orderkey""")
def extraction_coverage(spark, d):
    found = A.findings(spark, d).where("side = 'cand'")
    return E.extraction_coverage(A.cases(spark, d).withColumnRenamed("batch", "items"), found, "items")


@evaluation("""SELECT * FROM (VALUES ('blue widget', 'widget', true, 11, 1), ('small ring', 'ring', false, 10, 2), ('red ring', 'ring', true, 8, 3), ('widget', 'widget', false, 6, 4), ('ring', 'ring', false, 4, 5)) t(spelling, code, normal, length, priority)""")
def alias_table(spark, d):
    return ontology.alias_table(spark, (ontology.Concept("ring", "hand", ("ring", "small ring"), ("red ring",)), ontology.Concept("widget", "desk", ("widget",), ("blue widget",))))
