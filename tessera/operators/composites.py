"""Compositions over reports and their provenance: merging, fallback chains, formal runs, judge coverage, winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import quality
from tessera.functions.text import deidentified, personal_data

#: Tiers and sources whose reports never stand for a model's own output.
BLOCKED_TIERS = ("mock", "debug_fallback")
BLOCKED_SOURCES = ("mock", "mock_fallback", "fallback", "local_vlm_fallback")


def _over(later: Column, earlier: Column) -> Column:
    return F.map_concat(F.map_filter(earlier, lambda k, v: ~F.map_contains_key(later, k)), later)


def merged_provenance(*parts: Column) -> Column:
    """String maps merged, later ones first; ``fallback_used`` is true if any part has it with a value other than false."""
    empty = F.create_map().cast("map<string,string>")
    out = empty
    flags = F.lit(False)
    for part in parts:
        given = F.coalesce(part, empty)
        out = _over(given, out)
        flag = F.try_element_at(given, F.lit("fallback_used"))
        flags = flags | F.coalesce(flag != "false", F.lit(False))
    return F.when(flags, _over(F.create_map(F.lit("fallback_used"), F.lit("true")), out)).otherwise(out)


def blocking_fallback(tier: Column, source: Column, fallback_used: Column) -> Column:
    """Whether a report is a fallback that must not be evaluated. ``fallback_used`` is text; a value that is neither true nor
    false blocks, and a true one does but for exploratory reports."""
    flag = F.lower(fallback_used)
    bad = F.coalesce(~flag.isin("true", "false"), F.lit(False))
    named = F.coalesce(F.lower(tier).isin(*BLOCKED_TIERS), F.lit(False)) | F.coalesce(F.lower(source).isin(*BLOCKED_SOURCES), F.lit(False))
    used = F.coalesce(flag == "true", F.lit(False)) & F.coalesce(F.lower(tier) != "exploratory_fresh", F.lit(True))
    return bad | named | used


def quality_gated(reports: DataFrame) -> DataFrame:
    """Reports (report, modality, evidence_tier, source, fallback_used, warnings) with ``passed`` and the warnings it adds, each once.

    With a column ``body_part`` a failed report is also warned of another part of the body.
    """
    foreign = F.size(quality.foreign_terms(F.col("report"), F.col("modality"))) > 0
    blocked = blocking_fallback(F.col("evidence_tier"), F.col("source"), F.col("fallback_used"))
    part = F.size(quality.foreign_body_terms(F.col("report"), F.col("body_part"))) > 0 if "body_part" in reports.columns else F.lit(False)
    failed = foreign | blocked
    found = F.array_compact(F.array(F.when(failed, "quality_gate_failed"), F.when(blocked, "fallback_generation"), F.when(failed & part, "body_part_mismatch"), F.when(foreign, "modality_mismatch")))
    old = F.coalesce("warnings", F.array().cast("array<string>"))
    return reports.withColumns({"passed": ~(foreign | blocked), "warnings": F.concat(old, F.array_except(found, old))})


def formal_problem(reports: DataFrame, keys: list[str], sources: list[str]) -> DataFrame:
    """For each group with reports (model, evidence_tier, source, report) that may not be in a formal run, how many and the
    message of all of them by name, equal ones once: ``model:tier:problem|problem`` joined by commas. It grows with the registry
    of models, not with the reports."""
    problems = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("evidence_tier") == "formal_fresh", F.lit(False)), "non_formal_evidence_tier"),
        F.when(~F.coalesce(F.col("source").isin(*sources), F.lit(False)), "unsupported_formal_source"),
        F.when(quality.stripped(F.coalesce("report", F.lit(""))) == "", "empty_report"),
    ))
    text = F.concat_ws(":", F.coalesce("model", F.lit("")), F.coalesce("evidence_tier", F.lit("")), F.array_join(problems, "|"))
    kinds = reports.where(F.size(problems) > 0).groupBy(*keys, text.alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    out = kinds.groupBy(*keys).agg(F.sum("__n").alias("invalid"), F.array_sort(F.collect_list("__t")).alias("__all"))
    return out.select(*keys, "invalid", F.array_join("__all", ",").alias("message"))


def with_fallback(wanted: DataFrame, local: DataFrame, fallback: DataFrame, mock: bool) -> DataFrame:
    """Each wanted (case_id, model) with its local report if it has text, else the fallback's, else an explicit ``none`` row.

    local and fallback hold case_id, model and report, at most one row for a pair; the fallback's tier is mock or exploratory.
    """
    key = ["case_id", "model"]
    shown = lambda rows, name: rows.select(*key, F.nullif(quality.stripped(F.col("report")), F.lit("")).alias(name))
    out = wanted.select(*key).join(shown(local, "__l"), key, "left").join(shown(fallback, "__f"), key, "left")
    tier = F.when(F.col("__l").isNotNull(), "fresh").when(F.col("__f").isNotNull(), "mock" if mock else "exploratory_fresh").otherwise("none")
    return out.select(*key, F.coalesce("__l", "__f", F.lit("")).alias("report"), tier.alias("evidence_tier"), (F.col("__l").isNull() & F.col("__f").isNotNull()).alias("fallback_used"))


def batch_outputs(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Cases with the last output row (pos, case_id, report) that names them; rows with a blank case are passed over."""
    named = outputs.where(F.coalesce(F.trim("case_id"), F.lit("")) != "").groupBy("case_id").agg(F.max_by(F.struct("report"), "pos").alias("__o"))
    out = cases.join(named, "case_id", "left")
    return out.withColumns({"report": F.coalesce(F.col("__o.report"), F.lit("")), "failed": F.col("__o").isNull()}).drop("__o")


def rejected_models(requested: DataFrame, registry: DataFrame, selected: DataFrame) -> DataFrame:
    """(model, reason) for each requested model (pos, model) that was not selected: not_found or incompatible; by first request."""
    first = requested.groupBy("model").agg(F.min("pos").alias("pos"))
    known = registry.select("model").distinct().withColumn("__known", F.lit(True))
    left = first.join(selected.select("model").distinct(), "model", "left_anti").join(known, "model", "left")
    return left.select("pos", "model", F.when(F.col("__known"), "incompatible").otherwise("not_found").alias("reason"))


def judge_coverage(requested: DataFrame, answers: DataFrame, ids: DataFrame) -> DataFrame:
    """(case_id, problem, n) where a judge's answers (case_id, error_index, cited: array of ids) do not fit the request.

    Every requested index once: missing_index, extra_index, repeated_index; every cited id must be in ids (case_id, id): unknown_id.
    """
    want = requested.select("case_id", "error_index").distinct().withColumn("__w", F.lit(1))
    got = answers.groupBy("case_id", "error_index").agg(F.count(F.lit(1)).alias("__n"))
    both = want.join(got, ["case_id", "error_index"], "full")
    kind = F.when(F.col("__n").isNull(), "missing_index").when(F.col("__w").isNull(), "extra_index").when(F.col("__n") > 1, "repeated_index")
    cited = answers.select("case_id", F.explode("cited").alias("id")).join(ids.select("case_id", "id").distinct(), ["case_id", "id"], "left_anti")
    rows = both.select("case_id", kind.alias("problem")).where("problem IS NOT NULL").unionByName(cited.select("case_id", F.lit("unknown_id").alias("problem")))
    return rows.groupBy("case_id", "problem").agg(F.count(F.lit(1)).alias("n"))


def benchmark_results(reports: DataFrame) -> DataFrame:
    """Reports with personal data masked and warned of, and a status: succeeded if text is left, else failed."""
    found = F.size(personal_data(F.coalesce("report", F.lit("")))) > 0
    clean = F.when(found, deidentified(F.col("report"))).otherwise(F.coalesce("report", F.lit("")))
    old = F.coalesce("warnings", F.array().cast("array<string>"))
    add = F.when(found & ~F.array_contains(old, "pii_redacted"), F.concat(old, F.array(F.lit("pii_redacted")))).otherwise(old)
    status = F.when(quality.stripped(clean) != "", "succeeded").otherwise("failed")
    return reports.withColumns({"warnings": add, "status": status, "report": clean})


def source_isolated(result_flag: Column, report_flag: Column) -> Column:
    """Why a generation may have seen its reference; null only if both flags are given and false."""
    no = lambda c: F.coalesce(~c, F.lit(False))
    return F.when(~no(result_flag), "generation_result").when(~no(report_flag), "generated_report")


def reconstructed_report(findings: DataFrame) -> DataFrame:
    """The report of a case from its findings (case_id, pos, source_text): the texts that are not blank, one a line, by position."""
    shown = F.when(F.coalesce(F.trim("source_text"), F.lit("")) != "", F.struct("pos", "source_text"))
    return findings.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda s: s["source_text"]), "\n").alias("report"))


def frozen_winner(repeats: DataFrame, declared: DataFrame) -> DataFrame:
    """One row: the winner, if there are two or more repeats (repeat, case_id, model, winner, clean), all clean, all of exactly
    the declared pairs, all with one winner; else the reasons why not."""
    pairs = declared.select("case_id", "model").distinct().withColumn("__d", F.lit(1))
    each = repeats.join(pairs, ["case_id", "model"], "left").groupBy("repeat").agg(
        F.countDistinct("case_id", "model").alias("n"), F.count_if(F.col("__d").isNull()).alias("extra"), F.bool_and(F.coalesce("clean", F.lit(False))).alias("clean")
    )
    names = repeats.agg(F.min("winner").alias("winner"), F.max("winner").alias("last"), F.count_if(F.col("winner").isNull()).alias("unnamed"))
    total = pairs.agg(F.count(F.lit(1)).alias("wanted"))
    full = each.join(F.broadcast(total)).agg(
        F.count(F.lit(1)).alias("repeats"), F.count_if((F.col("n") != F.col("wanted")) | (F.col("extra") > 0)).alias("partial"), F.count_if(~F.col("clean")).alias("unclean")
    )
    agree = F.coalesce((F.col("winner") == F.col("last")) & (F.col("unnamed") == 0), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.col("repeats") < 2, "too_few_repeats"), F.when(F.col("partial") > 0, "incomplete_coverage"),
        F.when(F.col("unclean") > 0, "repeat_not_clean"), F.when(~agree, "winners_disagree"),
    ))
    out = full.join(F.broadcast(names)).withColumn("reasons", reasons)
    won = F.when(F.size("reasons") == 0, F.col("winner"))
    return out.select(won.alias("winner"), F.when(won.isNotNull(), F.sha2(F.concat_ws("|", won, F.col("repeats").cast("string")), 256)).alias("freeze_id"), "reasons")
