"""Rules over results: denominators, states, blockers, exclusion, adjudication, normalised judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The hazard level of an error type where none is given; other types have the last.
PRIOR_LEVEL = {
    "false_finding": 3, "omission_finding": 4, "incorrect_location": 3, "incorrect_severity": 2, "mismatched_finding": 3, "contradiction": 4,
}
OTHER_LEVEL = 3
#: Kinds of blockers with their reasons, most important first; a kind that is not listed ranks after the third.
BLOCKERS = {
    "manifest": (0, "invalid_manifest"), "provenance": (1, "invalid_candidate_provenance"), "missing_candidates": (2, "missing_candidates"),
    "": (3, "missing_gold_or_candidate_artifacts"), "coverage": (4, "unequal_candidate_coverage"), "duplicate": (5, "duplicate_case_model_rows"),
}


def denominator_problems(source: Column, manifest: Column, ok: Column, failed: Column, ok_rate: Column, failed_rate: Column) -> Column:
    """What is wrong with counts and rates. A null count or rate is not checked; either total may stand for the other."""
    total = F.coalesce(source, manifest)
    known = total.isNotNull() & ok.isNotNull() & failed.isNotNull()
    off = lambda rate, n: known & (F.abs(rate - F.when(total == 0, 0.0).otherwise(n / F.nullif(total, F.lit(0)))) > 1e-4)
    below = F.least(source, manifest, ok, failed) < 0
    outside = ~ok_rate.between(0, 1) | ~failed_rate.between(0, 1)
    checks = (
        (below, "negative_count"), (outside, "rate_out_of_range"), (source != manifest, "totals_differ"), (known & (ok + failed != total), "counts_do_not_sum"),
        (off(ok_rate, ok), "success_rate_mismatch"), (off(failed_rate, failed), "failure_rate_mismatch"),
    )
    return F.array_compact(F.array(*(F.when(c, name) for c, name in checks)))


def annotation_status(slots: Column) -> Column:
    """complete if the three slots of the map are, in_progress if any has been started, else not_started."""
    done = F.lit(True)
    for slot in ("reader_a", "reader_b", "adjudication"):
        done = done & (F.coalesce(F.try_element_at(slots, F.lit(slot)), F.lit("not_started")) == "complete")
    started = F.exists(F.map_values(slots), lambda s: s != "not_started")
    return F.when(done, "complete").when(F.coalesce(started, F.lit(False)), "in_progress").otherwise("not_started")


def audit_status(statuses: Column) -> Column:
    """passed if all pages agree, review_required if any page is in doubt, else (no page, an unknown status) blocked."""
    clean = F.transform(statuses, lambda s: F.lower(F.trim(F.coalesce(s, F.lit("")))))
    doubt = ("disagreement", "verifier_failed", "invalid_verifier_response")
    some = F.coalesce(F.size(statuses) > 0, F.lit(False))
    return F.when(some & F.forall(clean, lambda s: s == "agree"), "passed").when(some & F.exists(clean, lambda s: s.isin(*doubt)), "review_required").otherwise("blocked")


def exclusion_reason(raw: Column) -> Column:
    """Why a score given as text does not count: missing, non-finite or invalid; null if it counts."""
    word = F.lower(F.trim(raw))
    value = word.try_cast("double")
    endless = word.rlike(r"^[+-]?(?:nan|inf|infinity)$")
    return F.when(raw.isNull() | word.isin("true", "false"), "missing_overall_score").when(endless | F.isnan(value) | (F.abs(value) == float("inf")), "non_finite_overall_score").when(value.isNull(), "invalid_overall_score")


def run_status(ok: Column, failed: Column) -> Column:
    """The error of a run that found no case at all; null for any other."""
    return F.when((F.coalesce(ok, F.lit(0)) == 0) & (F.coalesce(failed, F.lit(0)) == 0), "no_cases_discovered")


def hazard_level(raw: Column, error_type: Column) -> Column:
    """A level given as a whole number, held within 1 to 5; else the prior of the error type."""
    prior = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PRIOR_LEVEL.items() for x in kv)), F.coalesce(error_type, F.lit("mismatched_finding"))), F.lit(OTHER_LEVEL))
    whole = F.when(raw.rlike(r"^[+-]?\d+$"), raw.try_cast("decimal(38,0)"))
    return F.when(whole.isNull(), prior).otherwise(F.least(F.greatest(whole, F.lit(1)), F.lit(5)).cast("int"))


def first_named(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def lenient_likert(raw: Column) -> Column:
    """A score given as text, rounded half to even and held within 1 to 5; 1 if it is no finite number."""
    value = raw.try_cast("double")
    bounded = F.least(F.greatest(value, F.lit(0.0)), F.lit(6.0))
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(fine, F.least(F.greatest(F.rint(bounded), F.lit(1.0)), F.lit(5.0)).cast("int")).otherwise(1)


def strict_likert(raw: Column, explanation: Column) -> Column:
    """Why a score does not hold: not a whole number from 1 to 5, or without an explanation; null if it holds."""
    value = raw.try_cast("double")
    whole = F.coalesce((value == F.floor(value)) & value.between(1, 5), F.lit(False))
    return F.when(~whole, "score_must_be_1_to_5").when(F.coalesce(F.trim(explanation), F.lit("")) == "", "explanation_missing")


def benchmark_blockers(declared: DataFrame, rows: DataFrame) -> DataFrame:
    """A row (blocker) for each model that has not got exactly the declared cases, and for each repeated pair.

    Both tables hold case_id and model. Fewer than two models cannot be unequal. Models are counted, no pair of rows is formed.
    """
    pairs = rows.groupBy("case_id", "model").agg(F.count(F.lit(1)).alias("copies"))
    twice = pairs.where("copies > 1").select(F.concat_ws(":", F.lit("duplicate"), "case_id", "model").alias("blocker"))
    cases = declared.select("case_id").distinct().withColumn("declared", F.lit(1))
    seen = pairs.join(cases, "case_id", "left").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count("declared").alias("hits"))
    models = declared.select("model").unionByName(rows.select("model")).distinct().join(seen, "model", "left").na.fill(0, ["n", "hits"])
    scope = cases.agg(F.count(F.lit(1)).alias("wanted"))
    counted = models.join(F.broadcast(scope)).join(F.broadcast(models.agg(F.count(F.lit(1)).alias("models"))))
    unequal = counted.where("models > 1 AND (hits <> wanted OR n <> hits)")
    return unequal.select(F.concat(F.lit("coverage:"), "model").alias("blocker")).unionByName(twice)


def selection(summary: DataFrame, blockers: DataFrame) -> DataFrame:
    """One row: blocked, with the most important reason and the number of blockers; or the provisional winner.

    The winner has the lowest clinical_cer_mean, then truncation_count, then the highest negation_token_accuracy_mean, then the
    first name.
    """
    head = F.when(F.col("blocker").contains(":"), F.substring_index("blocker", ":", 1)).otherwise("")
    kinds = F.create_map(*(F.lit(x) for k, (rank, why) in BLOCKERS.items() for x in (k, f"{rank}{why}")))
    worst = blockers.agg(F.count(F.lit(1)).alias("blockers"), F.min(F.coalesce(F.try_element_at(kinds, head), F.lit("".join(map(str, BLOCKERS[""]))))).alias("why"))
    order = F.struct("clinical_cer_mean", "truncation_count", (-F.col("negation_token_accuracy_mean")).alias("n"), "model")
    best = summary.agg(F.min_by("model", order).alias("model"))
    reason = F.when(F.col("blockers") > 0, F.substring("why", 2, 100)).when(F.col("model").isNull(), "no_evaluated_candidates")
    out = worst.join(F.broadcast(best)).withColumn("reason", reason)
    return out.select(F.when(F.col("reason").isNull(), "provisional").otherwise("blocked").alias("status"), "reason", F.when(F.col("reason").isNull(), F.col("model")).alias("primary_model"), "blockers")


def adjudicated(errors: DataFrame, judgements: DataFrame, least_confidence: float = 0.8) -> DataFrame:
    """Errors (case_id, error_index, error_type) with the disposition that takes effect and the error type after it.

    judgements: at most one row for a case and index, with disposition, confidence and suggested_type. An error without one, or
    with too little confidence, is held back as ``abstain``; ``retained`` is false for unsupported errors only.
    """
    said = F.when(F.col("disposition").isNull() | ~F.coalesce(F.col("confidence") >= least_confidence, F.lit(False)), "abstain").otherwise(F.col("disposition"))
    out = errors.join(judgements, ["case_id", "error_index"], "left").withColumn("judged", F.col("disposition").isNotNull())
    out = out.withColumn("effective", said).withColumn("original_type", F.when(F.col("effective") == "incorrect_error_type", F.col("error_type")))
    kind = F.when(F.col("effective") == "incorrect_error_type", F.col("suggested_type")).otherwise(F.col("error_type"))
    return out.withColumn("error_type", kind).withColumn("retained", F.col("effective") != "unsupported")


def adjudication_counts(judged: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda value: F.count_if(F.col("effective") == value)
    return judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("deterministic"), F.count_if("retained").alias("retained"), n("unsupported").alias("rejected"),
        n("incorrect_error_type").alias("modified"), n("abstain").alias("abstained"), F.bool_and("judged").alias("complete"),
    )


def page_blockers(pages: DataFrame) -> DataFrame:
    """Cases (case_id) whose pages (page, retained, chars, warnings) may not be used, with the reasons, sorted.

    Reasons: a retained page without text, a warning of truncation or emptiness, page numbers that are not 1 to n once each.
    """
    warned = F.exists(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: w.rlike("truncat|empty"))
    by = pages.groupBy("case_id").agg(
        F.bool_or(F.col("retained") & (F.coalesce("chars", F.lit(0)) == 0)).alias("a"), F.bool_or(warned).alias("b"),
        (~((F.min("page") == 1) & (F.max("page") == F.count(F.lit(1))) & (F.countDistinct("page") == F.count(F.lit(1))))).alias("c"),
    )
    reasons = F.array_compact(F.array(F.when(F.col("a"), "empty_page"), F.when(F.coalesce("c", F.lit(True)), "page_sequence"), F.when(F.col("b"), "page_warning")))
    return by.select("case_id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def hazard_alignment(primary: DataFrame, review: DataFrame) -> DataFrame:
    """(case_id, error_index, problem) where a review does not fit the primary judgement position by position.

    Problems: missing_review, extra_review, type_mismatch. A case with any of them must not be compared.
    """
    key = ["case_id", "error_index"]
    both = primary.select(*key, F.col("error_type").alias("__p")).join(review.select(*key, F.col("error_type").alias("__r")), key, "full")
    problem = F.when(F.col("__r").isNull(), "missing_review").when(F.col("__p").isNull(), "extra_review").when(F.col("__p") != F.col("__r"), "type_mismatch")
    return both.select(*key, problem.alias("problem")).where("problem IS NOT NULL")


def set_relation(one: DataFrame, two: DataFrame, keys: list[str], item: str) -> DataFrame:
    """How the sets of items of a key relate: equal, subset, superset, overlap or disjoint; a key that one side lacks has an empty set there."""
    a = one.select(*keys, item).distinct().withColumn("__a", F.lit(1))
    b = two.select(*keys, item).distinct().withColumn("__b", F.lit(1))
    counts = a.join(b, [*keys, item], "full").groupBy(*keys).agg(F.count("__a").alias("a"), F.count("__b").alias("b"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("c"))
    both = F.col("c")
    relation = F.when((both == F.col("a")) & (both == F.col("b")), "equal").when(both == F.col("a"), "subset").when(both == F.col("b"), "superset").when(both > 0, "overlap").otherwise("disjoint")
    return counts.select(*keys, relation.alias("relation"))


def filled_hazard(level: Column, error_type: Column, explanation: Column, action: Column) -> Column:
    """A struct of a hazard with what it lacks: the level by ``hazard_level``, a stock explanation, and a review if relevant."""
    kind = F.coalesce(F.nullif(error_type, F.lit("")), F.lit("mismatched_finding"))
    return F.struct(
        kind.alias("error_type"), hazard_level(level, kind).alias("hazard_level"),
        first_named(explanation, F.concat(F.lit("estimated from the kind of error: "), kind)).alias("explanation"), first_named(action, F.lit("review_if_relevant")).alias("recommended_action"),
    )


def count_problems(found: DataFrame, declared: DataFrame) -> DataFrame:
    """field, found and declared where the counts of a run's artifacts are not those its summary declares; a field that one side lacks counts as null there."""
    joined = found.select("field", F.col("value").alias("found")).join(declared.select("field", F.col("value").alias("declared")), "field", "full")
    return joined.where(~F.col("found").eqNullSafe(F.col("declared")))
