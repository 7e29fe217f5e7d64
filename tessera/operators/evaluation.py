"""Summaries of an evaluation: hazards, agreement between runs of a judge, distributions, rates and gates over evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.numbers import finite, half_up

#: From these levels on a hazard is more than trivial, and material; what a judge may recommend.
NONTRIVIAL, MATERIAL = 2, 3
ACTIONS = ("no_action", "review_if_relevant", "radiologist_review", "urgent_review")
#: Fixed value: what marks a score that no judge gave.
MOCK_MARK = "Deterministic MVP"


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """A rounded share; null of nothing."""
    return half_up(part / F.nullif(whole, F.lit(0)), digits)


def numeric_summary(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """count, mean, min and max of the finite values, rounded to 4 places; null without a value."""
    kept = F.when(finite(F.col(value)), F.col(value))
    out = rows.groupBy(*keys).agg(F.count(kept).alias("count"), F.avg(kept).alias("mean"), F.min(kept).alias("min"), F.max(kept).alias("max"))
    return out.select(*keys, "count", *(half_up(F.col(c), 4).alias(c) for c in ("mean", "min", "max")))


def distribution(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """min, median (halfway between the middle two of an even number) and max."""
    return rows.groupBy(*keys).agg(F.min(value).alias("min"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("max"))


def consensus_level(level: Column, disputed: Column, decision: Column) -> Column:
    """The level of an error: the first judge's, or the decision (struct abstain, hazard_level) where a reviewer disputes it; else null."""
    decided = F.when(~F.coalesce(decision["abstain"], F.lit(False)), decision["hazard_level"])
    return F.when(disputed, decided).otherwise(level)


def case_hazards(errors: DataFrame, level: str = "level") -> DataFrame:
    """For each case its errors, highest level (0 without one), material and more than trivial errors, and unresolved ones."""
    x = F.col(level)
    return errors.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("errors"), F.coalesce(F.max(x), F.lit(0)).alias("max_level"), F.count_if(x >= MATERIAL).alias("material"),
        F.count_if(x >= NONTRIVIAL).alias("nontrivial"), F.count_if(x.isNull()).alias("unresolved"),
    )


def evaluation_summary(cases: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of cases: cases, those with an error, with a material and an unresolved one, errors, the mean of highest levels.

    Errors are reduced to cases before they meet them.
    """
    joined = cases.join(case_hazards(errors), "case_id", "left").fillna(0, ["errors", "max_level", "material", "nontrivial", "unresolved"])
    out = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("errors") > 0).alias("with_errors"), F.count_if(F.col("material") > 0).alias("with_material"),
        F.count_if(F.col("unresolved") > 0).alias("with_unresolved"), F.sum("errors").alias("errors"), F.sum("material").alias("material"), F.sum("nontrivial").alias("nontrivial"),
        half_up(F.avg("max_level"), 4).alias("mean_max_level"), F.max("max_level").alias("max_level"),
    )
    return out.withColumn("material_rate", rate(F.col("with_material"), F.col("cases")))


def histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """kind, value and n for each column, in one pass; null and empty values count as ``unknown``."""
    named = rows.select(*(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")).alias(c) for c in columns))
    return named.unpivot([], columns, "kind", "value").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def retest_consistency(first: DataFrame, repeats: DataFrame, case: str = "case_id") -> DataFrame:
    """How often repeats of a judge agree with its first run, error by error: exactly, within one level, and in the action.

    ``first`` has case, index, level, action and ``fallback``; ``repeats`` also ``repeat``. A repeat with another number of
    errors is not compared. Where any run fell back to rules the case is blocked and has no rates.
    """
    size = first.groupBy(case).agg(F.count(F.lit(1)).alias("size"), F.bool_or("fallback").alias("fell"))
    sizes = repeats.groupBy(case, "repeat").agg(F.count(F.lit(1)).alias("n"), F.bool_or("fallback").alias("f"))
    runs = size.join(sizes, case, "left").groupBy(case).agg((1 + F.count("repeat")).alias("runs"), F.bool_or(F.col("fell") | F.coalesce("f", F.lit(False))).alias("blocked"))
    fit = sizes.join(size, case).where("n = size").select(case, "repeat")
    other = repeats.join(fit, [case, "repeat"]).select(case, "index", F.col("level").alias("l"), F.col("action").alias("a"))
    both = first.join(other, [case, "index"])
    compared = both.groupBy(case).agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(F.col("level") == F.col("l")).alias("e"), F.count_if(F.abs(F.col("level") - F.col("l")) <= 1).alias("w"), F.count_if(F.col("action") == F.col("a")).alias("r"),
    )
    out = runs.join(compared, case, "left").withColumn("compared", F.when(~F.col("blocked"), F.coalesce("compared", F.lit(0))).otherwise(0))
    shares = [rate(F.col(c), F.col("compared")).alias(name) for c, name in (("e", "exact_rate"), ("w", "within_one_rate"), ("r", "action_rate"))]
    return out.select(case, "runs", F.when(F.col("blocked"), "blocked").otherwise("complete").alias("status"), F.col("compared").cast("long").alias("compared"), *shares)


def likert_mean(scores: Column) -> Column:
    """The mean of an array of scores from 1 to 5, others left out, to 4 places; 0.0 without one."""
    valid = F.filter(scores, lambda s: finite(s) & s.between(1, 5))
    return F.when(F.size(valid) > 0, half_up(F.aggregate(valid, F.lit(0.0), lambda a, s: a + s) / F.size(valid), 4)).otherwise(0.0)


def weakest(names: list[str], scores: Column) -> Column:
    """The name of the first lowest score from 1 to 5 in an array in the names' order; null without one."""
    named = F.filter(F.zip_with(scores, F.array(*map(F.lit, names)), lambda s, n: F.struct(s.alias("s"), n.alias("n"))), lambda x: x["s"].between(1, 5))
    least = F.array_min(F.transform(named, lambda x: x["s"]))
    return F.element_at(F.filter(named, lambda x: x["s"] == least), 1)["n"]


def proxy_rates(findings: Column, cases: Column, generated: Column, failed: Column, real: Column, transcripts: Column) -> list[Column]:
    """Findings by case, the share of reports that pass the gate (0 without reports), and that of real transcripts."""
    passed = F.when(generated > 0, half_up(1 - failed / generated, 4)).otherwise(0.0)
    return [half_up(findings / F.greatest(cases, F.lit(1)), 4).alias("finding_density"), passed.alias("pass_rate"), half_up(real / F.greatest(transcripts, F.lit(1)), 4).alias("real_rate")]


def honesty_audit(scores: DataFrame) -> DataFrame:
    """How much of the scores no judge gave: count, mocked and their share, by backend. ``scores`` has backend and explanation."""
    mocked = F.coalesce(F.col("explanation").contains(MOCK_MARK), F.lit(False))
    out = scores.groupBy(F.coalesce(F.nullif("backend", F.lit("")), F.lit("unknown")).alias("backend")).agg(F.count(F.lit(1)).alias("total"), F.count_if(mocked).alias("mock"))
    return out.withColumn("mock_ratio", half_up(F.col("mock") / F.greatest("total", F.lit(1)), 4))


def evidence_gate(families: DataFrame) -> DataFrame:
    """passed and the failed families' names of a claim: all its families of evidence must have passed, and there must be one."""
    ok = F.coalesce(F.col("passed"), F.lit(False))
    return families.groupBy("claim").agg(F.bool_and(ok).alias("passed"), F.array_join(F.array_sort(F.collect_set(F.when(~ok, F.col("family")))), ";").alias("failed"))


def dashboard(counts: dict[str, DataFrame]) -> DataFrame:
    """field and value: how many rows each table has."""
    parts = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("field"), "value") for name, df in counts.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def long_format(rows: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Each column of a summary as rows of keys, field, value and source."""
    fields = [c for c in rows.columns if c not in keys]
    texts = rows.select(*keys, *(F.col(c).cast("string").alias(c) for c in fields))
    return texts.unpivot(keys, fields, "field", "value").withColumn("source", F.lit(source))


def duplicates(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each row after the first of its key, with both places."""
    line = Window.partitionBy(*keys).orderBy(order)
    placed = rows.withColumns({"first_row": F.min(order).over(Window.partitionBy(*keys)), "__n": F.row_number().over(line)})
    return placed.where("__n > 1").select(*keys, "first_row", F.col(order).alias("row"))


def merged_verdicts(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict from those of all parts of a case: abstain before issues_found before pass, with the least confidence.

    ``chunks`` has verdict, confidence and ``issues`` (JSON texts, counted once each).
    """
    issues = F.array_distinct(F.flatten(F.collect_list("issues")))
    out = chunks.groupBy(*keys).agg(F.bool_or(F.col("verdict") == "abstain").alias("a"), F.bool_or(F.col("verdict") == "issues_found").alias("i"), F.min("confidence").alias("confidence"), F.size(issues).cast("long").alias("issues"))
    return out.select(*keys, F.when(F.col("a"), "abstain").when(F.col("i") | (F.col("issues") > 0), "issues_found").otherwise("pass").alias("verdict"), "confidence", "issues")


def chunk(rows: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Adds ``chunk``: rows of a key in order, ``size`` in each."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / size).cast("int"))


def evidence_budget(text: Column, total: int = 3000, longest: int = 600) -> Column:
    """The sentences of a text in order as structs (start, length), each cut to ``longest`` and all of them to ``total`` characters.

    Blank sentences are passed over and cost nothing.
    """
    parts = F.split(F.coalesce(text, F.lit("")), "(?<=[。！？；;.!?])")
    none = F.array().cast("array<struct<start:int,length:int>>")
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("used"), none.alias("out"))

    def step(state: Column, part: Column) -> Column:
        size = F.least(F.char_length(part), F.lit(longest), F.lit(total) - state["used"])
        shown = F.substr(part, F.lit(1), size)
        kept = (size > 0) & shown.rlike(r"(?U)\S")
        more = F.array(F.struct(state["at"].alias("start"), size.alias("length")))
        return F.struct((state["at"] + F.char_length(part)).alias("at"), (state["used"] + F.when(kept, size).otherwise(0)).alias("used"), F.when(kept, F.concat(state["out"], more)).otherwise(state["out"]).alias("out"))

    return F.aggregate(parts, begin, step)["out"]


def judgement_problems(index: Column, candidate_type: Column, error_type: Column, level: Column, explanation: Column, action: Column, confidence: Column, abstain: Column, evidence: Column) -> Column:
    """What is wrong with a judgement of an error candidate; evidence must name it as e1, e2, ... by its index from 0."""
    return F.array_compact(F.array(
        F.when(F.coalesce(error_type, F.lit("")) == "", "missing_error_type").when(error_type != candidate_type, "error_type_mismatch"),
        F.when(~F.coalesce(level.between(1, 5), F.lit(False)), "hazard_level"), F.when(F.trim(F.coalesce(explanation, F.lit(""))) == "", "explanation"),
        F.when(~F.coalesce(action.isin(*ACTIONS), F.lit(False)), "recommended_action"), F.when(~F.coalesce(confidence.between(0, 1), F.lit(False)), "confidence"),
        F.when(abstain.isNull(), "abstain"), F.when(~F.coalesce(F.array_contains(evidence, F.concat(F.lit("e"), (index + 1).cast("string"))), F.lit(False)), "evidence_ids"),
    ))


def case_metrics(cases: DataFrame, alignment: DataFrame, hazards: DataFrame, agreement: DataFrame) -> DataFrame:
    """One row a case with its alignment metrics, hazards and the judges' agreement; a part that a case lacks is null, its counts 0.

    The parts have case_id and at most one row a case, as ``alignment_metrics``, ``case_hazards`` and ``level_agreement`` make them.
    """
    out = cases.select("case_id")
    for part in (alignment, hazards, agreement):
        out = out.join(part, "case_id", "left")
    return out.fillna(0, [c for c in ("n_cand", "n_ref", "errors", "max_level", "material", "nontrivial", "unresolved", "compared") if c in out.columns])


def extraction_coverage(reports: DataFrame, findings: DataFrame, items: str) -> DataFrame:
    """For each report its findings, their share of the expected items (a column of ``reports``, at least 1), and a warning without any."""
    counts = findings.groupBy("case_id").agg(F.count(F.lit(1)).alias("__n"))
    n = F.coalesce("__n", F.lit(0))
    joined = reports.select("case_id", items).join(counts, "case_id", "left")
    return joined.select("case_id", n.alias("findings"), F.least(F.lit(1.0), n / F.greatest(items, F.lit(1))).alias("coverage"), F.when(n == 0, "no_findings_extracted").alias("warning"))
