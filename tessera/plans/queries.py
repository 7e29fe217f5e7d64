"""The named queries of the library, each composed of operators on the adapted tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import quality
from tessera.functions import text as T
from tessera.functions.numbers import half_up
from tessera.operators import coverage, gates, matching, ranking, state, statistics, summaries
from tessera.operators.eligibility import for_hazards, for_ranking, for_statistics
from tessera.plans import adapters as A
from tessera.plans.evaluation_queries import EVALUATIONS, EVALUATIONS_SQL
from tessera.plans.oracle import SQL
from tessera.plans.rule_queries import RULES, RULES_SQL
from tessera.plans.value_queries import VALUES, VALUES_SQL
from tessera.plans.verification_queries import VERIFICATIONS, VERIFICATIONS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TIES = ["pos", "k1", "k2", "k3"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _eligible(reports: DataFrame, rule=for_statistics) -> DataFrame:
    return reports.where(rule(F.col("evidence_tier"), F.col("source")))


def _with_reader(spark: SparkSession, d: str) -> DataFrame:
    return _eligible(A.reports(spark, d)).join(A.cases(spark, d).select("case_id", "reader"), "case_id")


@query
def model_source_summary(spark, d):
    return summaries.model_source_summary(A.reports(spark, d))


@query
def modality_body_part_summary(spark, d):
    return summaries.modality_summary(A.cases(spark, d), A.reports(spark, d))


@query
def case_routes(spark, d):
    return summaries.case_routes(A.cases(spark, d), A.reports(spark, d))


@query
def global_counters(spark, d):
    return summaries.counters(A.reports(spark, d))


@query
def warning_histogram(spark, d):
    return summaries.warning_text(A.reports(spark, d))


@query
def quality_gate_failures(spark, d):
    failed = A.reports(spark, d).where("quality = 'failed'")
    joined = failed.join(A.cases(spark, d), "case_id")
    return joined.select("case_id", "reader", "modality", "body_part", "model", "source", "evidence_tier", F.array_join("warnings", ";").alias("warnings"))


@query
def metric_statistics_ci(spark, d):
    return statistics.describe(statistics.unpivoted(_eligible(A.reports(spark, d)), ["case_id"]), ["metric"])


@query
def reader_metric_statistics(spark, d):
    return statistics.describe(statistics.unpivoted(_with_reader(spark, d), ["reader"]), ["reader", "metric"])


@query
def reader_overall_score(spark, d):
    return statistics.overall_score(_with_reader(spark, d), ["reader"])


@query
def reader_percentiles(spark, d):
    scores = statistics.overall_score(_with_reader(spark, d), ["reader"]).select("reader", F.col("overall_score").alias("value"))
    return statistics.midrank_percentile(scores).select("reader", F.col("value").alias("overall_score"), "percentile")


@query
def modelwise_weighted(spark, d):
    weights = spark.range(8).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model"), (0.5 * F.col("id")).alias("weight")).where("model <> 'm5'")
    rows = _eligible(A.reports(spark, d)).join(A.cases(spark, d).select("case_id", "modality"), "case_id")
    return statistics.weighted_means(rows, weights, ["modality"])


@query
def hazardwise_weighted(spark, d):
    rows = A.reports(spark, d).withColumns({"level": (1 + F.col("k2") % 5).cast("int"), "error_type": F.when(F.col("k1") % 2 == 0, "omission_finding").otherwise("false_finding")})
    weights = {("omission_finding", 4): 2.0, ("omission_finding", 5): 3.0, ("false_finding", 5): 1.5, ("false_finding", 1): 0.5}
    return statistics.hazard_weighted(_eligible(rows, for_hazards), "finding_coverage", weights, ["error_type", "level"])


@query
def department_denominators(spark, d):
    return summaries.denominators(A.cases(spark, d), _eligible(A.reports(spark, d)), ["modality"])


@query
def peer_gap(spark, d):
    return statistics.peer_gap(statistics.unpivoted(_with_reader(spark, d), ["reader"]), "reader")


@query
def weak_metrics(spark, d):
    gaps = statistics.peer_gap(statistics.unpivoted(_with_reader(spark, d), ["reader"]), "reader")
    first = F.rank().over(Window.partitionBy("reader").orderBy("mean"))
    return gaps.withColumn("r", first).where((F.col("r") == 1) | (F.col("gap") < -1.0)).select("reader", "metric", "mean", (F.col("gap") < -1.0).alias("below_peers"))


def _scored(spark, d):
    return _eligible(A.reports(spark, d), for_ranking).withColumn("score", ranking.score())


@query
def top_k_reports(spark, d):
    found = ranking.top_k(_scored(spark, d), "case_id", TIES)
    return found.select("case_id", *TIES, "model", "score", F.col("rank").cast("long"), "selected", "near_cutoff_review")


@query
def top_k_ci_overlap(spark, d):
    rows = _scored(spark, d)
    spread = statistics.describe(rows.select("model", F.lit("score").alias("metric"), F.col("score").alias("value")), ["model", "metric"])
    half = F.broadcast(spread.select("model", (F.col("ci_upper") - F.col("ci_lower")).alias("__w")))  # a dimension of models
    rows = rows.join(half, "model").withColumns({"low": F.col("score") - F.col("__w") / 2, "high": F.col("score") + F.col("__w") / 2})
    return ranking.overlapping(rows, "case_id", TIES, "low", "high").select("case_id", *TIES, "model", "score", F.col("rank").cast("long"), "uncertainty_overlap")


def _welch_pairs(spark, d):
    values = statistics.unpivoted(_eligible(A.reports(spark, d)), ["model"])
    groups = values.groupBy("metric", "model").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    return statistics.welch(groups, "model", ["metric"])


@query
def model_pair_welch(spark, d):
    return _welch_pairs(spark, d).withColumns({"t": half_up(F.col("t"), 4), "p": half_up(F.col("p"))})


@query
def holm_adjusted(spark, d):
    rows = _welch_pairs(spark, d).select("metric", "model_a", "model_b", "p")
    return statistics.holm(rows, "p", ["metric"]).withColumns({"p": half_up(F.col("p")), "p_holm": half_up(F.col("p_holm"))})


@query
def hazard_agreement(spark, d):
    rows = A.hazards(spark, d).withColumns({"action": F.col("level") % 3, "review_action": F.col("review_level") % 3})
    return statistics.level_agreement(rows, "level", "review_level", ["error_type"], "action", "review_action")


@query
def hazard_consensus(spark, d):
    rows = A.hazards(spark, d)
    level = F.when(F.col("level") == F.col("review_level"), F.col("level")).when(~F.col("abstain"), F.col("review_level"))
    out = rows.withColumn("consensus", level).groupBy("case_id")
    return out.agg(F.coalesce(F.max("consensus"), F.lit(0)).alias("max_level"), F.count_if(F.col("consensus") >= 3).alias("material"), F.count_if(F.col("consensus") >= 2).alias("nontrivial"), F.count_if(F.col("consensus").isNull()).alias("unresolved"))


@query
def hazard_histograms(spark, d):
    return A.hazards(spark, d).groupBy("error_type", "level").agg(F.count(F.lit(1)).alias("n"))


@query
def cohen_kappa_labels(spark, d):
    return statistics.cohen_kappa(A.table(spark, d, "labels"), "quality", "toxic")


@query
def weighted_kappa_levels(spark, d):
    return statistics.weighted_kappa(A.hazards(spark, d), "level", "review_level", 1, 5)


@query
def agreement_sets(spark, d):
    return statistics.side_differences(A.findings(spark, d), "observation", F.col("side") == "cand", F.col("side") == "ref", ["case_id"])


@query
def alignment_pair_scores(spark, d):
    pairs = matching.pair_scores(A.findings(spark, d))
    return pairs.groupBy("case_id").agg(F.count(F.lit(1)).alias("pairs"), F.max("points").cast("long").alias("best"), F.sum("points").alias("total"))


@query
def alignment_only(spark, d):
    return matching.unpaired(A.findings(spark, d)).groupBy("case_id", "error").agg(F.count(F.lit(1)).alias("n"))


@query
def alignment_assignment(spark, d):
    return matching.alignment_metrics(A.findings(spark, d))


@query
def alignment_strict(spark, d):
    return matching.strict_metrics(A.findings(spark, d))


@query
def merge_batches_coverage(spark, d):
    cases = A.cases(spark, d)
    done = cases.where("batch <> 3").select("case_id").unionByName(cases.where("case_id % 50 = 0").select((-F.col("case_id") - 1).alias("case_id")))
    return coverage.missing_and_extra(cases, done, "case_id")


@query
def merged_batches(spark, d):
    cases = A.cases(spark, d).select("case_id", "batch")
    parts = [cases.where(f"batch = {b}") for b in range(5)] + [cases.where("case_id % 40 = 0")]
    return coverage.merge_batches(parts).groupBy("batch", "batch_no").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("copies") > 1).alias("duplicated"))


@query
def manifest_summary(spark, d):
    return summaries.manifest_counts(A.cases(spark, d), ["modality", "body_part"], {"reader_0": F.col("reader") == "reader_0", "first_batch": F.col("batch") == 0})


@query
def count_max_merge(spark, d):
    failed = A.reports(spark, d).where("quality = 'failed'").join(A.cases(spark, d), "case_id")
    return summaries.max_merged(*(df.groupBy(F.col("modality").alias("key")).agg(F.count(F.lit(1)).alias("n")) for df in (A.cases(spark, d), failed)))


@query
def benchmark_summary(spark, d):
    return summaries.generation_summary(A.table(spark, d, "documents"), ["source"], "text", "n_chars")


@query
def truncation_rollup(spark, d):
    return summaries.truncation_rollup(A.table(spark, d, "documents"), "lang", ~F.col("text").rlike(r"[.!?]\z"))


@query
def plan_coverage_by_stratum(spark, d):
    supported = F.element_at(F.array(*map(F.lit, ("ct", "mri", "unknown", "ct", "pet", "mri"))), (F.col("id") + 1).cast("int"))
    models = spark.range(6).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("model"), supported.alias("supported"))
    cases = A.cases(spark, d)
    return coverage.plan_coverage(cases, coverage.compatible(cases, models, F.col("body_part") == "1-URGENT"), ["modality", "body_part"])


@query
def stratified_sample(spark, d):
    return ranking.stratified(A.cases(spark, d), ["modality", "body_part"], "case_id", 100).select("case_id", "modality", "body_part", F.col("turn").cast("long"))


@query
def coverage_cartesian(spark, d):
    rows = A.reports(spark, d).select("case_id", F.col("model").alias("candidate"), (1 + F.col("pos") % 2).alias("repeat"))
    problems = coverage.plan_problems(A.cases(spark, d), [f"m{i}" for i in range(7)], 2, rows)
    return problems.groupBy("candidate", "repeat", "problem").agg(F.count(F.lit(1)).alias("n"))


@query
def ambiguous_hash_join(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return coverage.unambiguous(docs, "h", "doc_id").select("doc_id", F.col("h").alias("text_sha256"))


@query
def unique_finding_ids(spark, d):
    rows = A.table(spark, d, "conversations").select("conv_id", "turn", "role")
    named = rows.withColumn("id", F.concat(F.col("role"), F.lit("_"), (F.col("conv_id") % 20).cast("string")))
    return ranking.unique_ids(named, "id", ["conv_id", "turn", "role"]).select("conv_id", "turn", "unique_id")


@query
def modality_normalize(spark, d):
    words = F.element_at(F.array(*map(F.lit, ("Chest X-ray", "CTA head", "MR brain", "US abdomen", " ", "computed  tomography", "DX", "primary"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return A.table(spark, d, "part").select(T.modality(words).alias("modality")).groupBy("modality").agg(F.count(F.lit(1)).alias("n"))


@query
def pii_scan(spark, d):
    found = A.table(spark, d, "documents").select("doc_id", F.explode(T.personal_data(F.col("text"))).alias("category"))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("documents"))


@query
def pii_redact(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "text", T.deidentified(F.col("text")).alias("clean"))
    return docs.where("clean <> text").select("doc_id", F.char_length("clean").cast("long").alias("clean_chars"), F.sha2("clean", 256).alias("clean_sha256"))


@query
def structure_scores(spark, d):
    rows = A.table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Findings: "), "text", F.lit("\nImpression: none"))).otherwise(F.col("text")).alias("report"))
    parts = rows.withColumn("parts", T.sections(F.col("report")))
    return parts.select("conv_id", "turn", T.structure_score(F.col("parts")).cast("long").alias("structure_score"), F.char_length(F.col("parts")["impression"]).cast("long").alias("impression_chars"), T.deterministic_likert(F.col("report"), F.col("parts")).cast("long").alias("likert"))


@query
def text_bounded(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", T.bounded(F.col("text")).alias("b"))
    return docs.select("doc_id", F.char_length("b").cast("long").alias("chars"), F.md5("b").alias("digest"))


def _pairs(spark, d):
    """All pairs of a turn of the user and the answer to it, with their whole texts."""
    turns = A.table(spark, d, "conversations")
    ref = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("ref_turn"), F.col("text").alias("gold"))
    cand = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("ref_turn"), F.col("text").alias("cand"))
    return ref.join(cand, ["conv_id", "ref_turn"])


@query
def ocr_cer_by_pair(spark, d):
    return _pairs(spark, d).select("conv_id", "ref_turn", half_up(T.clinical_error_rate(F.col("gold"), F.col("cand"))).alias("cer"))


@query
def ocr_model_summary(spark, d):
    rows = _pairs(spark, d).withColumn("model", F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")))
    rows = rows.withColumns({"cer": T.clinical_error_rate(F.col("gold"), F.col("cand")), "cut": (~F.col("cand").rlike(r"[.!?]\z")).cast("long")})
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("cer")).alias("mean_cer"), F.sum("cut").alias("truncated"))


@query
def token_overlap(spark, d):
    rows = _pairs(spark, d).withColumns({"a": T.tokens(F.col("gold")), "b": T.tokens(F.col("cand"))})
    return rows.select("conv_id", "ref_turn", F.size("a").cast("long").alias("ref_tokens"), F.size(F.array_intersect("a", "b")).cast("long").alias("shared"))


def _runs(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind == "view", "running").when(kind == "click", "succeeded").when(kind == "error", "failed").otherwise("cancelled")
    return A.table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("run_id"), status.alias("status"))


@query
def illegal_transitions(spark, d):
    steps = state.transitions(_runs(spark, d), "run_id", ["ts", "event_id"], "status")
    return steps.groupBy(F.coalesce("before", F.lit("none")).alias("before"), "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("legal")).alias("illegal"))


@query
def latest_registry_entry(spark, d):
    return state.latest(_runs(spark, d), "run_id", ["ts", "event_id"]).select("run_id", "event_id", "status")


@query
def progress_tumbling(spark, d):
    from tessera.streaming.progress import tumbling

    return tumbling(_runs(spark, d), "1 hour").select(F.col("window.start").alias("window_start"), "status", "n")


@query
def validate_run_violations(spark, d):
    rules = {"level_in_range": F.col("level").between(1, 5), "review_within_two": F.abs(F.col("level") - F.col("review_level")) <= 2, "not_abstained": ~F.col("abstain")}
    return coverage.violations(A.hazards(spark, d), "case_id", rules).groupBy("case_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query
def gate_matrix(spark, d):
    rows = A.reports(spark, d).join(A.cases(spark, d).select("case_id", "reader"), "case_id")
    gates = {"finite": F.col("likert_mean") >= 1, "not_mock": F.col("evidence_tier") != "mock", "coverage": F.col("finding_coverage") > 0.02}
    return coverage.gate_matrix(rows, ["reader", "model"], gates)


@query
def route_plan(spark, d):
    return summaries.route_counts(A.reports(spark, d), ["model"])


@query
def reader_aggregates(spark, d):
    found = summaries.reader_aggregate(A.cases(spark, d), A.reports(spark, d).select("case_id", "model", F.col("finding_coverage").alias("score")))
    models = F.array_join(F.transform("models", lambda m: F.concat_ws(":", m["model"], m["n"].cast("string"))), ";")
    return found.select("reader", "case_count", F.md5(F.array_join(F.transform("cases", lambda c: c.cast("string")), ",")).alias("cases_digest"), "report_count", models.alias("models"), F.array_max(F.transform("models", lambda m: m["mean"])).alias("best_mean"))


@query
def ordinal_weighted(spark, d):
    rows = _eligible(A.reports(spark, d)).join(A.cases(spark, d).select("case_id", "modality"), "case_id")
    return statistics.weighted_means(rows, statistics.ordinal_weights(rows, [3.0, 2.0, 0.0, 0.5]), ["modality"])


@query
def hazard_alignment_problems(spark, d):
    rows = A.hazards(spark, d).withColumn("error_index", F.col("error_type")).groupBy("case_id", "error_index").agg(F.min("level").alias("level"), F.max("review_level").alias("review_level"))
    primary = rows.where("level > 1").select("case_id", "error_index", F.when(F.col("level") > 3, "a").otherwise("b").alias("error_type"))
    review = rows.where("review_level < 5").select("case_id", "error_index", F.when(F.col("review_level") > 3, "a").otherwise("b").alias("error_type"))
    return gates.hazard_alignment(primary, review).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query
def side_relations(spark, d):
    rows = A.findings(spark, d)
    found = gates.set_relation(rows.where("side = 'cand'"), rows.where("side = 'ref'"), ["case_id"], "observation")
    return found.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query
def latest_outputs(spark, d):
    events = _runs(spark, d).withColumn("output", F.when(F.col("status") == "succeeded", F.concat(F.lit("o"), F.col("event_id").cast("string"))).when(F.col("status") == "failed", " "))
    return state.latest_output(events, "run_id", ["ts", "event_id"], "output").select("run_id", "output")


@query
def missing_sections(spark, d):
    kind = F.col("turn") % 3
    shown = F.when(kind == 0, F.concat(F.lit("Findings: x "), "text")).when(kind == 1, F.concat(F.lit("Findings:\nImpression: y "), "text")).otherwise(F.lit(" "))
    rows = A.table(spark, d, "conversations").select(F.array_join(T.missing_sections(T.sections(shown)), ";").alias("missing"))
    return rows.groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


@query
def recognised_modalities(spark, d):
    key = F.col("p_partkey")
    header = F.when(key % 4 == 0, "CT").when(key % 4 == 1, "OT")
    found = quality.recognised_modality(header, F.when(key % 3 == 0, "a/chest_xray-1.png").otherwise("a/b.png"), F.when(F.col("p_size") % 2 == 0, "MR brain").otherwise("unsure"))
    return A.table(spark, d, "part").select(found.alias("m")).select("m.*").groupBy("modality", "source").agg(F.count(F.lit(1)).alias("n"))


@query
def privacy_scans(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", T.privacy_scan(F.col("text")).alias("s"))
    return rows.select("doc_id", "s.allowed", "s.scan_id", F.size("s.categories").alias("categories"))


ORACLE_SQL = {**{k: v for k, v in SQL.items() if k in QUERIES}, **RULES_SQL, **VALUES_SQL, **EVALUATIONS_SQL, **VERIFICATIONS_SQL}
QUERIES.update(RULES | VALUES | EVALUATIONS | VERIFICATIONS)
