"""Queries of the verification operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import verification as W
from tessera.operators.coverage import violations
from tessera.plans import adapters as A
from tessera.plans.value_queries import picked

VERIFICATIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
VERIFICATIONS_SQL: dict[str, str] = {}


def verification(sql: str | None = None):
    def put(f):
        VERIFICATIONS[f.__name__] = f
        if sql:
            VERIFICATIONS_SQL[f.__name__] = sql
        return f

    return put


CONTRACTS = {"brand": {"$.name": "string", "$.size": "int"}, "type": {"$.type": "string"}}


def _artifacts(spark, d):
    key = F.col("p_partkey")
    body = F.when(key % 5 == 0, F.format_string('{"name": "%s"}', "p_name")).when(key % 5 == 1, F.lit("[1]")).otherwise(F.format_string('{"name": "%s", "size": %d, "type": "%s"}', "p_name", "p_size", "p_type"))
    return A.table(spark, d, "part").select(picked(key, "brand", "type", "other").alias("kind"), key.alias("id"), body.alias("payload"))


_RULES = """WITH a AS (SELECT p_partkey AS id, (['brand', 'type', 'other'])[p_partkey % 3 + 1] AS kind, p_partkey % 5 AS b FROM part),
r AS (SELECT kind, id, CASE WHEN kind = 'other' THEN 'unknown_kind' WHEN b = 1 THEN 'no_object' WHEN b = 0 AND kind = 'brand' THEN '$.size' WHEN b = 0 THEN '$.type' END AS rule FROM a) """


@verification(_RULES + "SELECT kind, rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY kind, rule")
def contract_problems(spark, d):
    return W.contract_problems(_artifacts(spark, d), CONTRACTS).groupBy("kind", "rule").agg(F.count(F.lit(1)).alias("n"))


@verification(_RULES + "SELECT kind, count(*) AS artifacts, count(*) FILTER (WHERE rule IS NULL) AS valid FROM r GROUP BY kind")
def contract_counts(spark, d):
    return W.contract_counts(_artifacts(spark, d), CONTRACTS)


@verification("""WITH e AS (SELECT l_orderkey AS case_id, count(*) FILTER (WHERE l_linenumber = 1) AS a, count(*) FILTER (WHERE l_linenumber = 2) AS b, count(*) FILTER (WHERE l_linenumber = 3) AS c FROM lineitem GROUP BY case_id),
k AS (SELECT o_orderkey AS case_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, o_custkey % 4 <> 0 AS rev, o_custkey % 4 = 1 AS same, o_custkey % 5 <> 0 AS tried, o_custkey % 7 = 0 AS fell FROM orders LEFT JOIN e ON case_id = o_orderkey),
v AS (SELECT unnest([CASE WHEN a <> 1 THEN 'one_reference' END, CASE WHEN b <> 1 THEN 'one_candidate' END, CASE WHEN c <> 1 THEN 'one_pair' END, CASE WHEN NOT rev THEN 'one_reviewer' END, CASE WHEN NOT tried THEN 'attempts' END, CASE WHEN fell THEN 'no_fallback' END,
  CASE WHEN same THEN 'independent' WHEN NOT rev THEN 'independent' END]) AS rule FROM k) SELECT rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY rule""")
def real_judge_problems(spark, d):
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("k"))
    kinds = picked(F.col("l_linenumber") + 4, "x", "x", "x", "x", "x", "reference", "candidate", "pair", "x", "x", "x", "x")
    evaluations = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), kinds.alias("kind"))
    judge = lambda role, provider: rows.select("case_id", "k", F.lit(role).alias("role"), provider.alias("provider"), F.lit("m").alias("model"), F.lit("h").alias("host"))
    both = judge("primary", F.lit("One")).unionByName(judge("reviewer", F.when(F.col("k") % 4 == 1, "one").otherwise("two")).where("k % 4 <> 0"))
    judgements = both.select("*", F.when(F.col("k") % 5 != 0, 1).otherwise(0).alias("attempts"), (F.col("k") % 7 == 0).alias("fallback"))
    return W.real_judge_problems(rows, evaluations, judgements).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@verification("""SELECT 'blocker' AS kind, 'text_not_real' AS reason, count(*) FILTER (WHERE p_partkey % 3 <> 0) AS n FROM part UNION ALL SELECT 'warning', 'missing_report_text', count(*) FILTER (WHERE p_size % 4 = 0) FROM part
  UNION ALL SELECT 'warning', 'missing_images', count(*) FILTER (WHERE p_size % 5 = 0) FROM part UNION ALL SELECT 'blocker', 'no_ready_model', 1""")
def preflight(spark, d):
    size = F.col("p_size")
    cases = A.table(spark, d, "part").select(
        F.when(size % 4 != 0, F.col("p_name")).otherwise(" ").alias("report_text"), F.when(size % 5 != 0, F.array("p_name")).alias("image_paths"), F.when(F.col("p_partkey") % 3 == 0, "real").when(F.col("p_partkey") % 3 == 1, "mock").alias("provenance")
    )
    return W.preflight(cases, A.table(spark, d, "supplier").select((F.col("s_suppkey") < 0).alias("ready")), True)


@verification("""WITH c AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS k, o_orderkey % 4 = 0 AS adj, o_orderkey % 3 <> 0 AS a, o_orderkey % 2 = 0 AS content FROM orders),
v AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id, unnest([CASE WHEN k > 1 THEN 'duplicate_case' END, CASE WHEN adj AND NOT a THEN 'adjudicated_before_readers' END, CASE WHEN content AND NOT a AND NOT adj THEN 'content_before_start' END,
  CASE WHEN NOT (CASE WHEN a AND adj THEN 'complete' WHEN a OR adj THEN 'in_progress' ELSE 'not_started' END = 'in_progress') THEN 'status_mismatch' END, CASE WHEN o_orderkey % 6 = 5 THEN 'missing_file' END]) AS problem FROM c)
SELECT problem, count(*) AS n FROM v WHERE problem IS NOT NULL GROUP BY problem UNION ALL SELECT 'unlisted_file', count(*) FROM supplier""")
def package_problems(spark, d):
    k = F.col("o_orderkey")
    state = lambda c: F.when(c, "complete").otherwise("not_started")
    cases = A.table(spark, d, "orders").select(
        F.col("o_custkey").alias("case_id"), F.concat(F.lit("case_"), k.cast("string")).alias("path"), state(k % 3 != 0).alias("reader_a"), state(k % 3 != 0).alias("reader_b"), state(k % 4 == 0).alias("adjudication"),
        (k % 2 == 0).alias("has_content"), F.lit("in_progress").alias("status"),
    )
    files = cases.where(~F.col("path").rlike("x")).join(A.table(spark, d, "orders").where(k % 6 != 5).select(F.concat(F.lit("case_"), k.cast("string")).alias("path")), "path", "left_semi").select("path")
    return W.package_problems(cases, files.unionByName(A.table(spark, d, "supplier").select(F.col("s_name").alias("path")))).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@verification("""WITH v AS (SELECT unnest([CASE WHEN p_partkey % 7 = 0 THEN 'case' END, CASE WHEN p_size % 6 = 0 THEN 'status' END, CASE WHEN p_partkey % 5 = 0 THEN 'digest' END, CASE WHEN p_size > 30 THEN 'times' END, CASE WHEN p_partkey % 4 = 0 THEN 'fallback' END,
  CASE WHEN p_size % 2 = 0 THEN 'attempts' END]) AS rule FROM part) SELECT rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY rule""")
def provenance_problems(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = A.table(spark, d, "part").select(
        key, key.alias("case_id"), F.when(key % 7 != 0, key).alias("declared_case"), F.concat(F.lit(" "), F.upper("p_brand")).alias("model"), F.col("p_brand").alias("declared_model"),
        F.when(size % 6 == 0, "failed").otherwise("succeeded").alias("status"), F.sha2(F.when(key % 5 == 0, F.lit("old")).otherwise(F.col("p_name")), 256).alias("text_sha256"), size.alias("started_at"), F.lit(30).alias("finished_at"),
        F.when(key % 4 != 0, False).alias("fallback_used"), (size % 2).alias("attempts"), "p_name",
    )
    return violations(rows, "p_partkey", W.provenance_rules(F.col, F.sha2("p_name", 256))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@verification("""WITH d AS (SELECT DISTINCT o_orderkey AS case_id, m FROM orders, (VALUES ('a'), ('b')) t(m)), g AS (SELECT l_orderkey AS case_id, (['a', 'b', 'c'])[l_linenumber % 3 + 1] AS m, count(*) AS n, bool_or(l_partkey % 50 = 0) AS bad FROM lineitem GROUP BY ALL),
j AS (SELECT d.case_id AS dc, g.n, g.bad FROM d FULL JOIN g ON d.case_id = g.case_id AND d.m = g.m), v AS (SELECT unnest([CASE WHEN n IS NULL THEN 'missing' END, CASE WHEN dc IS NULL THEN 'extra' END, CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN bad THEN 'non_finite' END]) AS problem FROM j)
SELECT problem, count(*) AS n FROM v WHERE problem IS NOT NULL GROUP BY problem UNION ALL SELECT 'winner_not_declared', 1""")
def result_problems(spark, d):
    declared = A.cases(spark, d).select("case_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"))
    results = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), picked(F.col("l_linenumber"), "a", "b", "c").alias("model"), F.when(F.col("l_partkey") % 50 == 0, float("nan")).otherwise(F.col("l_tax")).alias("cer"))
    return W.result_problems(results, declared, ["cer"], F.lit("c"))


@verification("""SELECT CASE WHEN p_partkey % 7 = 0 THEN 'path_outside_root' WHEN p_partkey % 5 = 0 THEN 'missing_file' WHEN p_size % 3 = 0 THEN 'hash_mismatch' WHEN p_size % 4 = 1 THEN 'schema_version' WHEN p_partkey % 6 = 1 THEN 'gate_id' END AS reason, count(*) AS n FROM part GROUP BY reason""")
def gate_evidence(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    path = F.when(key % 14 == 0, F.concat(F.lit("/run/../"), "p_name")).when(key % 14 == 7, F.lit("/run2/x")).otherwise(F.concat(F.lit("/run/"), "p_name"))
    reason = W.evidence_reason(path, "/run", F.sha2("p_name", 256), F.when(key % 5 != 0, F.sha2(F.when(size % 3 == 0, F.lit("x")).otherwise(F.col("p_name")), 256)), F.when(size % 4 != 1, "2.0"), "2.0", F.lit("g"), F.when(key % 6 != 1, "g"))
    return A.table(spark, d, "part").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@verification("""SELECT * FROM (SELECT 'annotation' AS family, count(*) AS problems FROM labels WHERE quality IS NULL UNION ALL SELECT 'bundle', count(*) FROM part WHERE p_size > 40 UNION ALL SELECT 'metadata', count(*) FROM part WHERE p_size < 0) WHERE problems > 0""")
def frozen_problems(spark, d):
    parts = A.table(spark, d, "part")
    return W.frozen_problems({"annotation": A.table(spark, d, "labels").where("quality IS NULL"), "bundle": parts.where("p_size > 40"), "metadata": parts.where("p_size < 0")})


@verification("""WITH v AS (SELECT unnest([CASE WHEN p_partkey % 3 = 0 THEN 'stage' END, CASE WHEN p_partkey % 4 = 0 THEN 'input_sha256' END, CASE WHEN p_size > 20 THEN 'items' END, CASE WHEN p_size % 2 = 0 THEN 'complete' END, CASE WHEN p_partkey % 5 = 0 THEN 'provenance' END]) AS rule FROM part)
SELECT rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY rule""")
def checkpoint_problems(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = A.table(spark, d, "part").select(
        key, picked(key, "audit", "hazard", "hazard").alias("stage"), F.lit("hazard").alias("wanted_stage"), F.when(key % 4 != 0, F.md5("p_name")).alias("input_sha256"), F.least(size, F.lit(20)).alias("items"), size.alias("n"),
        (size % 2 == 1).alias("complete"), F.when(key % 5 != 0, F.col("p_brand")).otherwise(" ").alias("provider"), "p_name",
    )
    return violations(rows, "p_partkey", W.checkpoint_rules(F.col, F.md5("p_name"), F.col("n"))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _records(spark, d):
    key = F.col("p_partkey")
    old = F.format_string('{"id": "%d", "name": "%s", "site": "%s", "certainty": "no", "size": "%d.5 cm", "brand": "%s"}', key, "p_name", "p_type", "p_size", "p_brand")
    new = F.format_string('{"schema_version": "2.0", "finding_id": "%d", "observation": "%s", "location": "%s", "certainty": "probable"}', key, "p_name", "p_type")
    payload = F.when(key % 4 == 0, F.lit('{"site": "x"}')).when(key % 4 == 1, old).when(key % 4 == 2, new).otherwise(F.lit("{broken"))
    return A.table(spark, d, "part").select(key.alias("id"), payload.alias("payload"))


@verification("""SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS finding_id, p_name AS observation, p_type AS location, CASE WHEN p_partkey % 4 = 1 THEN 'absent' ELSE 'uncertain' END AS certainty, CASE WHEN p_partkey % 4 = 1 THEN (p_size + 0.5e0) * 10 END AS mm,
  CASE WHEN p_partkey % 4 = 1 THEN p_brand END AS extra, p_partkey % 4 = 1 AS was_old FROM part WHERE p_partkey % 4 IN (1, 2)""")
def migrated_findings(spark, d):
    good, _ = W.migrated(_records(spark, d))
    return good.select("id", "finding_id", "observation", "location", "certainty", F.col("measurement.normalized_mm").alias("mm"), F.try_element_at("extra", F.lit("brand")).alias("extra"), "was_old")


@verification("""SELECT CASE WHEN p_partkey % 4 = 0 THEN 'missing_observation' ELSE 'no_json_object' END AS reason, count(*) AS n FROM part WHERE p_partkey % 4 IN (0, 3) GROUP BY reason""")
def migration_errors(spark, d):
    return W.migrated(_records(spark, d))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@verification("""SELECT l_orderkey AS case_id, string_agg(left('obs' || l_partkey % 6, 4) || ':' || l_returnflag, ';' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS sent FROM lineitem GROUP BY case_id""")
def minimal_payloads(spark, d):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    item = F.struct(order.alias("at"), F.concat(F.lit("obs"), (F.col("l_partkey") % 6).cast("string")).alias("observation"), F.col("l_returnflag").alias("flag"))
    rows = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    sent = W.minimised(F.col("items"), ["observation", "flag"], 4)
    return rows.select("case_id", F.array_join(F.transform(sent, lambda x: F.concat(x["observation"], F.lit(":"), x["flag"])), ";").alias("sent"))


@verification("""WITH r AS (SELECT p_brand, p_type, p_size FROM part WHERE p_partkey % 6 <> 0) SELECT 'model' AS kind, p_brand AS value, count(*) AS n FROM r GROUP BY p_brand UNION ALL SELECT 'source', 'unknown', count(*) FROM r UNION ALL SELECT 'quality', p_type, count(*) FROM r GROUP BY p_type
  UNION ALL SELECT 'warning', 'w' || p_size % 3, count(*) FROM r GROUP BY 2""")
def merge_counters(spark, d):
    body = F.format_string('{"reports": [{"model": "%s", "source": "", "quality": "%s", "warnings": ["w%d"]}]}', "p_brand", "p_type", F.col("p_size") % 3)
    return W.merge_counters(A.table(spark, d, "part").select(F.when(F.col("p_partkey") % 6 == 0, F.lit("{broken")).otherwise(body).alias("payload")))


@verification("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'original' WHEN p_partkey % 3 = 1 THEN 'reconstructed' ELSE 'missing' END AS report_text_source, p_size % 5 = 0 OR p_partkey % 3 = 1 AS fallback_used, count(*) AS n, count(CASE WHEN p_partkey % 3 <> 2 THEN 1 END) AS with_text FROM part GROUP BY ALL""")
def reevaluated_reports(spark, d):
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("model"), (F.col("p_size") % 5 == 0).alias("fallback_used"), "p_name")
    k = F.col("case_id") % 3
    originals = rows.select("case_id", "model", F.when(k == 0, F.col("p_name")).otherwise(" ").alias("report"))
    rebuilt = rows.where(k != 2).select("case_id", "model", F.lit("rebuilt").alias("report"))
    found = W.reevaluated(rows.drop("p_name"), originals, rebuilt)
    return found.groupBy("report_text_source", "fallback_used").agg(F.count(F.lit(1)).alias("n"), F.count("report").alias("with_text"))


@verification("""SELECT p.p_partkey AS case_id, p_brand AS model, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS alignment, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS structure FROM part p""")
def pair_bundles(spark, d):
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("model"), "p_size", "p_type")
    found = W.bundle(rows.select("case_id", "model"), alignment=rows.where("case_id % 2 = 0").select("case_id", "model", "p_size"), structure=rows.where("case_id % 3 = 0").select("case_id", "model", "p_type"))
    return found.select("case_id", "model", F.col("alignment.p_size").alias("alignment"), F.col("structure.p_type").alias("structure"))


@verification("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'rule' ELSE p_name END AS answer, CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 3 END AS attempts, p_partkey % 3 = 2 AS fallback_used FROM part""")
def judged_prompts(spark, d):
    rows = A.table(spark, d, "part").select("p_partkey", F.concat((F.col("p_partkey") % 3).cast("string"), F.lit(":"), "p_name").alias("prompt"))
    tries: dict[str, int] = {}

    def ask(prompt: str) -> str:
        """Kind 0 is answered at once, kind 1 at the third attempt, kind 2 never."""
        kind, name = prompt.split(":", 1)
        if kind == "2":
            raise TimeoutError("no answer")
        tries[prompt] = (tries.get(prompt, 0) + 1) % 3
        return name if kind == "0" or not tries[prompt] else ""

    found = W.judged(rows, ask, lambda said: [] if said else ["empty"], lambda prompt: "rule", 2)
    return found.select("p_partkey", "answer", "attempts", "fallback_used")
