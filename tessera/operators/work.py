"""Work lists, attempts, selections and references between artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Errors that a reader can learn from.
ACTIONABLE = ("false_finding", "omission_finding", "incorrect_location", "incorrect_severity")
#: Fields of an error that may hold the finding it is about, in order.
FINDING_FIELDS = ("finding", "candidate", "reference", "a", "b")
#: Cases that the manifest lacks come after all others.
LAST = 10**9


def selected_counts(reports: DataFrame, selected: DataFrame) -> DataFrame:
    """For each model how often it was selected, added up once for each of its reports. ``selected`` has a row a selection."""
    counts = selected.groupBy("model").agg(F.count(F.lit(1)).alias("__n"))
    rows = reports.groupBy("model").agg(F.count(F.lit(1)).alias("reports"))
    return rows.join(counts, "model", "left").select("model", "reports", (F.col("reports") * F.coalesce("__n", F.lit(0))).alias("selected"))


def run_details(runs: DataFrame, stages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Runs with the arrays of their stages and artifacts, ordered by id; both are gathered before they meet the runs."""
    gathered = lambda df, key: df.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in df.columns if c not in ("run_id", key)]))).alias(key.replace("_id", "s")))
    return runs.join(gathered(stages, "stage_id"), "run_id", "left").join(gathered(artifacts, "artifact_id"), "run_id", "left")


def unbound(audits: DataFrame, primaries: DataFrame, keys: list[str]) -> DataFrame:
    """Audits that are of no primary result or of another one: keys and problem. Both have ``digest``."""
    joined = audits.join(primaries.select(*keys, F.col("digest").alias("__own")), keys, "left")
    problem = F.when(F.col("__own").isNull(), "missing_primary").when(~F.col("digest").eqNullSafe(F.col("__own")), "hash_mismatch")
    return joined.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def targeted(findings: DataFrame, errors: DataFrame) -> DataFrame:
    """Findings of a case that an actionable error is about, by any of its FINDING_FIELDS; of a case without one its first finding.

    ``findings`` has case_id, finding_id and pos; ``errors`` case_id, error_type and the fields as ids. Ids match in any case.
    """
    acted = errors.where(F.col("error_type").isin(*ACTIONABLE))
    named = acted.select("case_id", F.explode(F.array_compact(F.array(*(F.nullif(F.lower(F.col(c)), F.lit("")) for c in FINDING_FIELDS)))).alias("__id")).distinct()
    marked = findings.withColumn("__id", F.lower("finding_id")).join(named.withColumn("__hit", F.lit(True)), ["case_id", "__id"], "left")
    any_ = named.select("case_id").distinct().withColumn("__any", F.lit(True))
    case = Window.partitionBy("case_id")
    first = F.col("pos") == F.min("pos").over(case)
    return marked.join(any_, "case_id", "left").withColumn("__first", first).where(F.col("__hit") | (F.col("__any").isNull() & F.col("__first"))).select(*findings.columns)


def attempts(stages: DataFrame, order: str) -> DataFrame:
    """Adds ``attempt``: the number of a start among those of its run and stage, from 1."""
    return stages.withColumn("attempt", F.row_number().over(Window.partitionBy("run_id", "stage").orderBy(order)))


def stage_starts(events: DataFrame, order: str) -> DataFrame:
    """Starts of stages with ``legal``: whether the run's status was running then. ``events`` has run_id, stage (null for the run) and status."""
    line = Window.partitionBy("run_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    status = F.last(F.when(F.col("stage").isNull(), F.col("status")), ignorenulls=True).over(line)
    return events.withColumn("legal", F.coalesce(status == "running", F.lit(False))).where("stage IS NOT NULL AND status = 'started'")


def ranked_entries(entries: DataFrame, body_part: Column, keys: list[str]) -> DataFrame:
    """Adds ``rank`` among the entries of a key: fresh ones first, then those for the part of the body, then by name."""
    fits = F.exists("body_parts", lambda p: F.lower(p) == F.lower(body_part)) | (F.size("body_parts") == 0)
    return entries.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy((~F.col("fresh")).cast("int"), (~fits).cast("int"), "entry")))


def in_manifest_order(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``ordinal``: a case's place in the manifest, LAST for one that is not there; sort by it."""
    return rows.join(manifest.select("case_id", F.col("ordinal").alias("__o")), "case_id", "left").withColumn("ordinal", F.coalesce("__o", F.lit(LAST))).drop("__o")


def limited(rows: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """The first n rows in an order; all of them for null. n must be a whole number of 0 or more."""
    if n is None:
        return rows
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError("a limit is a whole number of 0 or more")
    return rows.orderBy(*order).limit(n)


def work_list(cases: DataFrame, candidates: list[str], repeats: int) -> DataFrame:
    """A blocked row for each case, candidate and repeat from 1; candidates and repeats are configuration and become an array."""
    return cases.select("case_id", F.explode(F.array(*map(F.lit, candidates))).alias("candidate")).select(
        "case_id", "candidate", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"), F.lit("blocked").alias("status")
    )


def with_results(work: DataFrame, results: DataFrame) -> DataFrame:
    """The work list with the status of its results; a row without one has ``problem`` missing_result, a result without a row is extra_result."""
    keys = ["case_id", "candidate", "repeat"]
    joined = work.withColumn("__w", F.lit(True)).join(results.select(*keys, F.col("status").alias("__s")), keys, "full")
    problem = F.when(F.col("__w").isNull(), "extra_result").when(F.col("__s").isNull(), "missing_result")
    return joined.select(*keys, F.coalesce("__s", "status").alias("status"), problem.alias("problem"))


def candidate_class(error: Column, quality: Column, text: Column) -> Column:
    """succeeded, review_required or blocked: what became of a candidate's run."""
    return F.when(error.isNotNull() | (F.trim(F.coalesce(text, F.lit(""))) == "") | (quality == "blocked"), "blocked").when(quality == "review_required", "review_required").otherwise("succeeded")


def class_counts(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs by class; those of the role ``audit`` only checks others and are counted apart."""
    audit = F.col("role") == "audit"
    names = ("succeeded", "review_required", "blocked")
    return runs.groupBy(*keys).agg(*(F.count_if(~audit & (F.col("class") == n)).alias(n) for n in names), F.count_if(audit).alias("audits"))


def protocol_rows(protocols: DataFrame, experiments: DataFrame) -> DataFrame:
    """Protocols in their fixed order with their experiment's status, ``missing_inputs`` without one."""
    joined = protocols.join(experiments.select("experiment_id", F.col("status").alias("__s")), "experiment_id", "left")
    return joined.select("ordinal", "experiment_id", "title", F.coalesce("__s", F.lit("missing_inputs")).alias("status"))


def evidence_status(rows: Column, ready: Column) -> Column:
    return F.when(rows > 0, "evidence_available").when(ready, "ready_for_generation").otherwise("missing_inputs")


def catalog(**tables: DataFrame) -> DataFrame:
    """kind and name of every capability, once each."""
    out = None
    for kind, df in tables.items():
        part = df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).cast("string").alias("name"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def passed_with_place(candidates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Candidates that passed the gate, with the place they had among all and the one they have now, both from 0."""
    line = Window.partitionBy(*keys).orderBy(order)
    placed = candidates.withColumn("old_index", F.row_number().over(line) - 1)
    return placed.where("passed").withColumn("new_index", F.row_number().over(line) - 1)


def decided(disputes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Disputed errors of a case with ``outcome``: resolved, abstained, undecided, ambiguous (several decisions) or stale (of another input).

    Both have case_id, error_index and input_sha256; decisions also ``abstain``.
    """
    keys = ["case_id", "error_index"]
    found = decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("input_sha256").alias("__sha"), F.bool_or("abstain").alias("__a"))
    joined = disputes.join(found, keys, "left")
    outcome = F.when(F.col("__n").isNull(), "undecided").when(F.col("__n") > 1, "ambiguous").when(F.col("__sha") != F.col("input_sha256"), "stale").when(F.col("__a"), "abstained").otherwise("resolved")
    return joined.withColumn("outcome", outcome).select(*disputes.columns, "outcome")


def identified(references: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """The id of the finding that a reference means by equal ``keys``; null, with ``matches``, unless exactly one does."""
    named = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), F.min("finding_id").alias("__id"))
    joined = references.join(named, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return joined.withColumn("finding_id", F.when(F.col("matches") == 1, F.col("__id"))).drop("__id")


def effective_statistics(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """reader, metric and mean: the stored statistics of a reader that has any, else the computed ones."""
    has = stored.select("reader").distinct()
    return stored.select("reader", "metric", "mean").unionByName(computed.join(has, "reader", "left_anti").select("reader", "metric", "mean"))


def report_education(reports: DataFrame) -> DataFrame:
    """status, weakest dimension and score, and the mean of valid scores. ``reports`` has report_id and scores (map of dimension to score).

    A score counts if it is a whole number from 1 to 5; dimensions count in the order of their names; without one: blocked.
    """
    valid = F.array_sort(F.transform(F.map_entries(F.map_filter("scores", lambda _, s: s.between(1, 5) & (s == F.floor(s)))), lambda e: F.struct(e["value"].alias("s"), e["key"].alias("n"))))
    rows = reports.withColumn("__v", valid).withColumn("__w", F.element_at(F.when(F.size("__v") > 0, F.col("__v")), 1))
    total = F.aggregate(F.transform("__v", lambda x: x["s"].cast("double")), F.lit(0.0), lambda a, s: a + s)
    mean = F.when(F.size("__v") > 0, F.floor(total / F.size("__v") * 10000 + 0.5) / 10000)
    return rows.select(
        "report_id", F.when(F.size("__v") > 0, "suggestions_generated").otherwise("blocked_insufficient_data").alias("status"),
        F.col("__w.n").alias("weakest_metric"), F.col("__w.s").alias("weakest_score"), mean.alias("overall_score"),
    )


def reader_education(gaps: DataFrame, below: float = -1.0) -> DataFrame:
    """The first reader's metrics to work on: those ``below`` the others' mean, without any the lowest (ties included).

    ``gaps`` has reader, metric, mean and gap (null without other readers).
    """
    first = gaps.agg(F.min("reader").alias("reader"))
    own = gaps.join(F.broadcast(first), "reader")  # one row
    line = Window.partitionBy("reader")
    marked = own.withColumns({"__weak": F.coalesce(F.col("gap") < below, F.lit(False)), "__low": F.col("mean") == F.min("mean").over(line)})
    marked = marked.withColumn("__any", F.bool_or("__weak").over(line))
    return marked.where(F.col("__weak") | (~F.col("__any") & F.col("__low"))).select("reader", "metric", "mean", "gap")


def file_digests(files: DataFrame) -> DataFrame:
    """path, length and SHA-256 of rows of Spark's ``binaryFile`` source, for an inventory; sort by path to show it."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def with_documents(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Cases with their document as a struct, null without one; of several documents of a case the first by path."""
    fields = F.struct(*[c for c in documents.columns if c != "case_id"])
    first = documents.groupBy("case_id").agg(F.min_by(fields, "path").alias("document"))
    return cases.join(first, "case_id", "left")


def registry_entries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models of a registry (id, body as JSON) with their types and defaults, and the entries that break a type with the field.

    name defaults to the id, modalities to unknown, ready to false, temperature to 0.0; ``legacy`` marks entries without a
    schema version, whose single ``modality`` is read as the list.
    """
    value = F.try_parse_json("body")
    given = lambda path: F.try_variant_get(value, path, "string").isNotNull()
    get = lambda path, kind: F.try_variant_get(value, path, kind)
    kinds = {"$.ready": "boolean", "$.temperature": "double", "$.modalities": "array<string>"}
    wrong = F.array_compact(F.array(F.when(value.isNull(), "body"), *(F.when(given(path) & get(path, kind).isNull(), path) for path, kind in kinds.items())))
    legacy = get("$.schema_version", "string").isNull()
    one = F.when(legacy & given("$.modality"), F.array(get("$.modality", "string")))
    good = rows.where(F.size(wrong) == 0).select(
        "id", F.coalesce(get("$.name", "string"), "id").alias("name"), F.coalesce(get("$.modalities", "array<string>"), one, F.array(F.lit("unknown"))).alias("modalities"),
        F.coalesce(get("$.ready", "boolean"), F.lit(False)).alias("ready"), F.coalesce(get("$.temperature", "double"), F.lit(0.0)).alias("temperature"), legacy.alias("legacy"),
    )
    return good, rows.where(F.size(wrong) > 0).select("id", F.explode(wrong).alias("field"))


def experiment_rows(counts: DataFrame, ready: DataFrame, protocols: DataFrame) -> DataFrame:
    """Each protocol's experiment with its evidence: n rows and a status. ``counts`` has experiment_id and n, ``ready`` the ids that could be made."""
    joined = protocols.join(counts, "experiment_id", "left").join(ready.select("experiment_id").distinct().withColumn("__ready", F.lit(True)), "experiment_id", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("ordinal", "experiment_id", n.alias("n"), evidence_status(n, F.coalesce("__ready", F.lit(False))).alias("status"))
