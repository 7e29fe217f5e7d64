"""Rules over artifacts: contracts, packages, provenance, frozen evidence, migration. Each gives a row for what is wrong."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import values as V
from tessera.functions.numbers import finite
from tessera.operators.coverage import violations


def contract_problems(artifacts: DataFrame, contracts: dict[str, dict[str, str]]) -> DataFrame:
    """kind, id and rule of each required field that an artifact (kind, id, payload as JSON) lacks or has in another type.

    A contract names JSON paths and Spark types. A payload that is no JSON object breaks only that rule; a kind without a contract is ``unknown_kind``.
    """
    body = F.try_parse_json("payload")
    is_object = F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False))
    broken = F.array(F.lit("unknown_kind"))
    for kind, fields in contracts.items():
        wrong = F.array_compact(F.array(*(F.when(F.try_variant_get(body, path, of).isNull(), path) for path, of in fields.items())))
        broken = F.when(F.col("kind") == kind, F.when(is_object, wrong).otherwise(F.array(F.lit("no_object")))).otherwise(broken)
    return artifacts.select("kind", "id", F.explode(broken).alias("rule"))


def contract_counts(artifacts: DataFrame, contracts: dict[str, dict[str, str]]) -> DataFrame:
    """Artifacts of each kind, and how many keep their contract."""
    bad = contract_problems(artifacts, contracts).select("kind", "id").distinct().withColumn("__bad", F.lit(1))
    return artifacts.join(bad, ["kind", "id"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("artifacts"), F.count_if(F.col("__bad").isNull()).alias("valid"))


def real_judge_problems(cases: DataFrame, evaluations: DataFrame, judgements: DataFrame) -> DataFrame:
    """case_id and rule where a case is not evaluated by real judges from end to end.

    ``evaluations`` has case_id and kind (reference, candidate, pair): one of each. ``judgements`` has case_id, role (primary,
    reviewer), provider, model, host, attempts and fallback: both roles, at least one attempt, no fallback, and two different judges.
    """
    counted = evaluations.groupBy("case_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("reference", "candidate", "pair")))
    judge = F.struct("provider", "model", "host")
    roles = judgements.groupBy("case_id").agg(
        F.count_if(F.col("role") == "primary").alias("primary"), F.count_if(F.col("role") == "reviewer").alias("reviewer"),
        F.max(F.when(F.col("role") == "primary", judge)).alias("__p"), F.max(F.when(F.col("role") == "reviewer", judge)).alias("__r"),
        F.bool_and(F.coalesce(F.col("attempts") >= 1, F.lit(False))).alias("tried"), F.bool_and(~F.coalesce("fallback", F.lit(True))).alias("real"),
    )
    joined = cases.select("case_id").join(counted, "case_id", "left").join(roles, "case_id", "left")
    rules = {f"one_{k}": F.col(k) == 1 for k in ("reference", "candidate", "pair", "primary", "reviewer")}
    rules |= {"attempts": F.col("tried"), "no_fallback": F.col("real"), "independent": F.col("__p").isNotNull() & F.col("__r").isNotNull() & V.independent(F.col("__p"), F.col("__r"))}
    return violations(joined, "case_id", rules)


def preflight(cases: DataFrame, models: DataFrame, real_text: bool) -> DataFrame:
    """kind (blocker, warning), reason and n of what a run over the cases would meet, without starting it.

    ``cases`` has report_text, image_paths and provenance; ``models`` has ready. Reasons with n of 0 have no row.
    """
    blank = F.trim(F.coalesce("report_text", F.lit(""))) == ""
    found = cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(blank).alias("missing_report_text"), F.count_if(F.size(F.coalesce("image_paths", F.array())) == 0).alias("missing_images"),
        F.count_if(~F.coalesce(F.col("provenance") == "real", F.lit(False))).alias("unreal"),
    ).crossJoin(models.agg(F.count_if("ready").alias("ready")))  # one row each
    reasons = [
        ("blocker", "no_cases", (F.col("cases") == 0).cast("long")), ("blocker", "no_ready_model", (F.col("ready") == 0).cast("long")),
        ("blocker" if real_text else "warning", "text_not_real", F.col("unreal")), ("warning", "missing_report_text", F.col("missing_report_text")), ("warning", "missing_images", F.col("missing_images")),
    ]
    rows = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), n.alias("n")) for kind, reason, n in reasons))
    return found.select(F.explode(rows).alias("r")).select("r.*").where("n > 0")


def package_problems(cases: DataFrame, files: DataFrame) -> DataFrame:
    """id and problem of an annotation package.

    ``cases`` has case_id, path, reader_a, reader_b, adjudication (states), has_content and status. Problems: duplicate_case,
    duplicate_path, adjudicated_before_readers, content_before_start, status_mismatch, missing_file, unlisted_file.
    """
    done = lambda c: F.col(c) == "complete"
    begun = F.greatest(*(F.when(F.col(c) != "not_started", 1).otherwise(0) for c in ("reader_a", "reader_b", "adjudication"))) == 1
    all_done = done("reader_a") & done("reader_b") & done("adjudication")
    status = F.when(all_done, "complete").when(begun, "in_progress").otherwise("not_started")
    seen = cases.withColumns({"__c": F.count(F.lit(1)).over(Window.partitionBy("case_id")), "__p": F.count(F.lit(1)).over(Window.partitionBy("path"))})
    listed = files.select("path").distinct().withColumn("__f", F.lit(True))
    rules = {
        "duplicate_case": F.col("__c") == 1, "duplicate_path": F.col("__p") == 1,
        "adjudicated_before_readers": (F.col("adjudication") == "not_started") | (done("reader_a") & done("reader_b")),
        "content_before_start": begun | ~F.col("has_content"), "status_mismatch": F.col("status") == status, "missing_file": F.col("__f").isNotNull(),
    }
    own = violations(seen.join(listed, "path", "left"), "case_id", rules).distinct().select(F.col("case_id").cast("string").alias("id"), F.col("rule").alias("problem"))
    extra = files.select("path").distinct().join(cases.select("path").distinct(), "path", "left_anti")
    return own.unionByName(extra.select(F.col("path").alias("id"), F.lit("unlisted_file").alias("problem")))


def provenance_rules(f: Callable[[str], Column], text_digest: Column) -> dict[str, Column]:
    """What must hold of a candidate's provenance: its case, model, a finished run, the digest of its text, times in order, no fallback."""
    return {
        "case": f("case_id").eqNullSafe(f("declared_case")), "model": V.plain(f("model")).eqNullSafe(V.plain(f("declared_model"))), "status": f("status") == "succeeded",
        "digest": f("text_sha256") == text_digest, "times": f("finished_at") >= f("started_at"), "fallback": ~F.coalesce(f("fallback_used"), F.lit(True)),
        "attempts": f("attempts") >= 1,
    }


def result_problems(results: DataFrame, declared: DataFrame, metrics: list[str], winner: Column) -> DataFrame:
    """problem and n of a benchmark's results (case_id, model, metrics) against the declared pairs: missing, extra, repeated, non_finite, winner_not_declared."""
    keys = ["case_id", "model"]
    bad = F.lit(False)
    for m in metrics:
        bad = bad | ~F.coalesce(finite(F.col(m)), F.lit(False))
    counted = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.bool_or(bad).alias("__bad"))
    joined = declared.select(*keys).distinct().withColumn("__d", F.lit(True)).join(counted, keys, "full")
    problems = F.array_compact(F.array(
        F.when(F.col("__n").isNull(), "missing"), F.when(F.col("__d").isNull(), "extra"), F.when(F.col("__n") > 1, "repeated"), F.when(F.col("__bad"), "non_finite"),
    ))
    out = joined.select(F.explode(problems).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    named = declared.agg(F.coalesce(F.bool_or(F.col("model") == winner), F.lit(False)).alias("ok")).where("NOT ok")
    return out.unionByName(named.select(F.lit("winner_not_declared").alias("problem"), F.lit(1).cast("long").alias("n")))


def evidence_reason(path: Column, root: str, digest: Column, found_digest: Column, schema: Column, wanted_schema: str, gate: Column, found_gate: Column) -> Column:
    """Why a gate's evidence does not hold, first things first; null if it does."""
    return (
        F.when(path.isNull() | path.contains("..") | ~path.startswith(root.rstrip("/") + "/"), "path_outside_root").when(found_digest.isNull(), "missing_file")
        .when(~digest.eqNullSafe(found_digest), "hash_mismatch").when(~schema.eqNullSafe(wanted_schema), "schema_version").when(~gate.eqNullSafe(found_gate), "gate_id")
    )


def frozen_problems(families: dict[str, DataFrame]) -> DataFrame:
    """family and problems, for each family of frozen evidence whose table of problems is not empty."""
    out = None
    for name, problems in families.items():
        part = problems.agg(F.count(F.lit(1)).alias("problems")).select(F.lit(name).alias("family"), "problems")
        out = part if out is None else out.unionByName(part)
    return out.where("problems > 0")


def checkpoint_rules(f: Callable[[str], Column], wanted_input: Column, wanted_items: Column) -> dict[str, Column]:
    """What must hold for a checkpoint to be used: its stage, the digest of its input, all of its items, and who made it."""
    return {
        "stage": f("stage") == f("wanted_stage"), "input_sha256": f("input_sha256") == wanted_input, "items": f("items") == wanted_items, "complete": f("complete"),
        "provenance": F.length(F.trim(F.coalesce(f("provider"), F.lit("")))) > 0,
    }


#: Fields of a finding of the second schema, each with the names it had before.
MIGRATED = {
    "finding_id": ("finding_id", "id"), "observation": ("observation", "observation_text", "name"), "location": ("location", "anatomy", "site"),
    "severity": ("severity", "grade"), "measurement": ("measurement", "size"),
}


def migrated(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (id, payload: a flat JSON object of either schema) in the second schema, and those that cannot be migrated with a reason.

    Known fields are taken under any of their names; certainty and size are read; fields of no schema are kept in ``extra``.
    """
    fields = F.from_json("payload", "map<string,string>")
    known = {n for names in MIGRATED.values() for n in names} | {"certainty", "schema_version"}
    get = lambda *names: V.first_filled(*(F.try_element_at(F.col("__f"), F.lit(n)) for n in names))
    rows = records.withColumn("__f", F.when(F.try_parse_json("payload").isNotNull(), fields))
    reason = F.when(F.col("__f").isNull(), "no_json_object").when(get(*MIGRATED["observation"]).isNull(), "missing_observation")
    good = rows.where(reason.isNull()).select(
        "id", *(get(*names).alias(name) for name, names in MIGRATED.items() if name != "measurement"), V.certainty(get("certainty"), old=True).alias("certainty"),
        V.measurement(get(*MIGRATED["measurement"])).alias("measurement"), F.map_filter("__f", lambda k, _: ~k.isin(*sorted(known))).alias("extra"),
        (~F.coalesce(get("schema_version") == "2.0", F.lit(False))).alias("was_old"),
    )
    return good, rows.where(reason.isNotNull()).select("id", reason.alias("reason"))


def minimised(items: Column, allowed: list[str], longest: int = 600) -> Column:
    """An array of structs with only the allowed fields, texts cut to ``longest`` characters, for a payload that leaves the house."""
    return F.transform(items, lambda x: F.struct(*(F.substring(x[c].cast("string"), 1, longest).alias(c) for c in allowed)))


def merge_counters(documents: DataFrame) -> DataFrame:
    """kind, value and n of the reports in JSON documents (payload with ``reports``: model, source, warnings, quality). Unreadable documents are passed over."""
    schema = "struct<reports:array<struct<model:string,source:string,quality:string,warnings:array<string>>>>"
    reports = documents.where(F.try_parse_json("payload").isNotNull()).select(F.explode(F.from_json("payload", schema)["reports"]).alias("r")).select("r.*")
    tags = [F.struct(F.lit(c).alias("kind"), F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")).alias("value")) for c in ("model", "source", "quality")]
    warned = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.struct(F.lit("warning").alias("kind"), w.alias("value")))
    return reports.select(F.explode(F.concat(F.array(*tags), warned)).alias("t")).groupBy("t.kind", "t.value").agg(F.count(F.lit(1)).alias("n"))


def reevaluated(reports: DataFrame, originals: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Reports (case_id, model, fallback_used) with a text to evaluate anew: the original one, else one rebuilt from findings, else none.

    ``report_text_source`` says which; a rebuilt text forces ``fallback_used``.
    """
    key = ["case_id", "model"]
    shown = lambda df, name: df.select(*key, F.nullif(F.trim("report"), F.lit("")).alias(name))
    joined = reports.join(shown(originals, "__o"), key, "left").join(shown(rebuilt, "__r"), key, "left")
    source = F.when(F.col("__o").isNotNull(), "original").when(F.col("__r").isNotNull(), "reconstructed").otherwise("missing")
    return joined.withColumns({"report": F.coalesce("__o", "__r"), "report_text_source": source, "fallback_used": F.col("fallback_used") | (source == "reconstructed")}).drop("__o", "__r")


def bundle(pairs: DataFrame, **parts: DataFrame) -> DataFrame:
    """Pairs (case_id, model) with one struct for each table of results that has at most one row for a pair."""
    out = pairs
    for name, df in parts.items():
        fields = [c for c in df.columns if c not in ("case_id", "model")]
        out = out.join(df.select("case_id", "model", F.struct(*fields).alias(name)), ["case_id", "model"], "left")
    return out


def judged(rows: DataFrame, ask: Callable[[str], str], problems: Callable[[str], list[str]], rules: Callable[[str], str], retries: int = 2, text: str = "prompt") -> DataFrame:
    """Rows with a judge's answer to a text column: ``answer``, ``attempts``, ``fallback_used`` and ``failures``.

    ``ask`` calls the judge and may raise; an answer counts when ``problems`` finds none. After ``retries`` more attempts the
    answer is that of the ``rules``, and says so. Works on Arrow batches of rows on the executors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for value in batch[text]:
                failures: list[str] = []
                answer = None
                while answer is None and len(failures) <= retries:
                    try:
                        said = ask(value)
                        wrong = problems(said)
                    except Exception as error:  # noqa: BLE001
                        failures.append(str(error)[-200:])
                        continue
                    if wrong:
                        failures.append(";".join(wrong))
                    else:
                        answer = said
                found.append((rules(value) if answer is None else answer, len(failures) + (answer is not None), answer is None, failures))
            yield batch.assign(answer=[f[0] for f in found], attempts=[f[1] for f in found], fallback_used=[f[2] for f in found], failures=[f[3] for f in found])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{kinds}, answer string, attempts int, fallback_used boolean, failures array<string>")
