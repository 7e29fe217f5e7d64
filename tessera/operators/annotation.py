"""Annotation packages: blinded candidates, a reader's own part, taking a part back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.gates import annotation_status

SLOTS = ("reader_a", "reader_b", "adjudication")


def blinded(candidates: DataFrame, order: list[str], hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """(for readers, private): candidates numbered densely within their case in ``order``, as candidate-01 and model-01.

    The first has all columns but ``hidden`` and ``order``; the second only the case, the ids and the hidden columns.
    """
    n = F.row_number().over(Window.partitionBy("case_id").orderBy(*order)).cast("string")
    number = F.when(F.char_length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)
    rows = candidates.withColumns({"candidate_id": F.concat(F.lit("candidate-"), number), "blinded_model_id": F.concat(F.lit("model-"), number)})
    return rows.drop(*hidden, *order), rows.select("case_id", "candidate_id", "blinded_model_id", *hidden)


def export_slot(cases: DataFrame, slot: str) -> DataFrame:
    """Cases (slots: map of slot to status; answers: map of slot to text) with the slots of others reset, and the status anew."""
    slots = F.transform_values("slots", lambda k, v: F.when(k == slot, v).otherwise("not_started"))
    return cases.withColumns({"slots": slots, "answers": F.map_filter("answers", lambda k, v: k == slot)}).withColumn("status", annotation_status(F.col("slots")))


def import_problems(cases: DataFrame, returned: DataFrame, slot: str, identity: list[str]) -> DataFrame:
    """(case_id, problem) for what forbids taking a reader's part back; nothing may be taken unless this is empty.

    Problems: an unknown case, a changed identity, a slot that is complete already, data in the slots of others.
    """
    ours = cases.select("case_id", F.struct(*identity).alias("__identity"), F.try_element_at("slots", F.lit(slot)).alias("__slot"))
    both = returned.join(ours, "case_id", "left")
    others = F.exists(F.map_entries("slots"), lambda e: (e["key"] != slot) & (e["value"] != "not_started")) | (F.size(F.map_filter("answers", lambda k, v: k != slot)) > 0)
    unknown = F.col("__identity").isNull()
    found = F.array(
        F.when(unknown, "unknown_case"), F.when(~unknown & ~F.struct(*identity).eqNullSafe(F.col("__identity")), "identity_changed"),
        F.when(F.col("__slot") == "complete", "slot_already_complete"), F.when(others, "other_slot_has_data"),
    )
    return both.select("case_id", F.explode(F.array_compact(found)).alias("problem"))


def import_slot(cases: DataFrame, returned: DataFrame, slot: str) -> DataFrame:
    """Cases with the reader's slot and answer taken over where a part came back, and the status anew."""
    part = returned.select("case_id", F.try_element_at("slots", F.lit(slot)).alias("__s"), F.try_element_at("answers", F.lit(slot)).alias("__a"))
    out = cases.join(part, "case_id", "left")
    put = lambda name, new: F.when(F.col(new).isNull(), F.col(name)).otherwise(F.map_concat(F.map_filter(name, lambda k, v: k != slot), F.create_map(F.lit(slot), F.col(new))))
    out = out.withColumns({"slots": put("slots", "__s"), "answers": put("answers", "__a")}).drop("__s", "__a")
    return out.withColumn("status", annotation_status(F.col("slots")))
