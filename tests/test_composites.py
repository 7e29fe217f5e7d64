"""Composite operators on literal rows."""

import hashlib

from pyspark.sql import functions as F

from tessera.operators import composites as C


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_provenance_keeps_any_fallback(spark):
    m = "map<string,string>"
    data = [({"a": "1", "fallback_used": "true"}, {"a": "2", "fallback_used": "false"}), ({"a": "1"}, None), ({"fallback_used": "false"}, {"b": "x"}), ({"fallback_used": "yes"}, {})]
    found = spark.createDataFrame(data, f"x {m}, y {m}").select(C.merged_provenance(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in found] == [{"a": "2", "fallback_used": "true"}, {"a": "1"}, {"fallback_used": "false", "b": "x"}, {"fallback_used": "true"}]


def test_quality_gate(spark):
    data = [
        (1, "a ct scan", "cxr", "formal_fresh", "cli", None, ["x"]), (2, "clear", "cxr", "mock", "cli", None, None), (3, "clear", "cxr", "exploratory_fresh", "api", "true", []),
        (4, "clear", "cxr", "artifact", "api", "true", ["quality_gate_failed"]), (5, None, None, None, None, "what", None),
    ]
    df = spark.createDataFrame(data, "i int, report string, modality string, evidence_tier string, source string, fallback_used string, warnings array<string>")
    assert rows(C.quality_gated(df).select("i", "passed", "warnings"), "i") == [
        (1, False, ["x", "quality_gate_failed", "modality_mismatch"]), (2, False, ["quality_gate_failed", "fallback_generation"]), (3, True, []),
        (4, False, ["quality_gate_failed", "fallback_generation"]), (5, False, ["quality_gate_failed", "fallback_generation"]),
    ]


def test_formal_problems(spark):
    data = [("c", "m1", "formal_fresh", "cli", "text"), ("c", "m2", "mock", "cli", " "), ("c", "m3", "formal_fresh", "x", "t"), ("d", "m1", "formal_fresh", "cli", "text")]
    df = spark.createDataFrame(data, "case_id string, model string, evidence_tier string, source string, report string")
    assert rows(C.formal_problem(df, ["case_id"], ["cli"]), "case_id") == [("c", 2, "m2:mock:non_formal_evidence_tier|empty_report,m3:formal_fresh:unsupported_formal_source")]


def test_fallback_chain_and_batch_outputs(spark):
    make = lambda *r: spark.createDataFrame(list(r), "case_id string, model string, report string")
    wanted = make(("a", "m", ""), ("b", "m", ""), ("c", "m", ""))
    out = C.with_fallback(wanted, make(("a", "m", "local"), ("b", "m", " ")), make(("a", "m", "f"), ("b", "m", "f")), mock=True)
    assert rows(out, "case_id") == [("a", "m", "local", "fresh", False), ("b", "m", "f", "mock", True), ("c", "m", "", "none", False)]
    outputs = spark.createDataFrame([(1, "a", "first"), (2, "a", None), (3, " ", "x")], "pos int, case_id string, report string")
    assert rows(C.batch_outputs(wanted.select("case_id"), outputs), "case_id") == [("a", "", False), ("b", "", True), ("c", "", True)]


def test_rejected_models_and_judge_coverage(spark):
    req = spark.createDataFrame([(2, "x"), (1, "y"), (3, "x"), (4, "z")], "pos int, model string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "model string")
    assert rows(C.rejected_models(req, names("x", "z"), names("z")), "pos") == [(1, "y", "not_found"), (2, "x", "incompatible")]
    want = spark.createDataFrame([("c", i) for i in range(3)], "case_id string, error_index int")
    got = spark.createDataFrame([("c", 0, ["f1"]), ("c", 0, []), ("c", 1, ["f9"]), ("c", 7, None)], "case_id string, error_index int, cited array<string>")
    ids = spark.createDataFrame([("c", "f1")], "case_id string, id string")
    assert rows(C.judge_coverage(want, got, ids), "problem") == [("c", "extra_index", 1), ("c", "missing_index", 1), ("c", "repeated_index", 1), ("c", "unknown_id", 1)]


def test_results_isolation_and_reconstruction(spark):
    df = spark.createDataFrame([(1, "mail a@b.org", None), (2, " ", ["w"]), (3, None, None)], "i int, report string, warnings array<string>")
    assert rows(C.benchmark_results(df), "i") == [(1, "mail [email_address]", ["pii_redacted"], "succeeded"), (2, " ", ["w"], "failed"), (3, "", [], "failed")]
    flags = spark.createDataFrame([(1, False, False), (2, None, False), (3, False, True)], "i int, a boolean, b boolean")
    assert rows(flags.select("i", C.source_isolated(F.col("a"), F.col("b"))), "i") == [(1, None), (2, "generation_result"), (3, "generated_report")]
    texts = spark.createDataFrame([("c", 2, "two"), ("c", 1, "one"), ("c", 3, " "), ("d", 1, None)], "case_id string, pos int, source_text string")
    assert rows(C.reconstructed_report(texts), "case_id") == [("c", "one\ntwo"), ("d", "")]


def test_winner_freezes_only_after_clean_full_repeats(spark):
    schema = "repeat int, case_id string, model string, winner string, clean boolean"
    declared = spark.createDataFrame([("a", "m"), ("b", "m")], "case_id string, model string")
    both = [(r, c, "m", "m", True) for r in (1, 2) for c in "ab"]
    freeze = lambda data: tuple(C.frozen_winner(spark.createDataFrame(data, schema), declared).first())
    assert freeze(both) == ("m", hashlib.sha256(b"m|2").hexdigest(), [])
    assert freeze(both[:2])[2] == ["too_few_repeats"]
    assert freeze([*both[:3], (2, "b", "n", "x", False)])[2] == ["incomplete_coverage", "repeat_not_clean", "winners_disagree"]
    assert freeze([])[2] == ["too_few_repeats", "winners_disagree"]
