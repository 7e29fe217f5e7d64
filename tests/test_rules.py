"""Concepts, quality, gates, reuse, annotation, series and the further sources on literal rows."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import quality as Q
from tessera.operators import annotation, gates, ontology, reuse, series
from tessera.sources import readers

CONCEPTS = [
    ontology.Concept("opacity", "lung", ("opacity", "airspace opacity", "infiltrate"), ("clear lungs", "未见异常密度影")),
    ontology.Concept("effusion", "pleura", ("pleural effusion", "胸腔积液")),
    ontology.Concept("cardiopulmonary_abnormality", "cardiopulmonary", ("abnormality",), ("no abnormality",)),
]


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def test_evidence_is_found_exactly_or_without_space(spark):
    rows = [("a small  nodule here", " nodule "), ("左肺 上叶\n结节。", "左肺上叶结节"), ("abc", "xyz"), (None, "x"), ("", ""), ("a𝄞 b c", "bc"), ("x y", None)]
    found = values(spark, ontology.evidence_span(F.col("r"), F.col("e")), rows, "r string, e string")
    assert [f and tuple(f) for f in found] == [(9, 15, "nodule"), (0, 8, "左肺 上叶\n结节"), None, None, (0, 0, ""), (3, 6, "b c"), None]


def test_findings_agree_with_their_evidence(spark):
    c = ontology.ungrounded(F.col("l"), F.col("a"), F.lit(None).cast("string"), F.col("m"), F.col("e"))
    rows = [("left", "right_lung", [], ""), ("right", "右肺", [(12.0, "mm")], "12.00 毫米"), ("left", "左肺", [(1.5, "cm")], "11.5 cm"), (None, None, None, None), ("left", "x", [(5.0, "cm")], "5 cms")]
    assert values(spark, c, rows, "l string, a string, m array<struct<value:double,unit:string>>, e string") == [
        ["laterality_conflict"], [], ["measurement_not_in_evidence"], [], ["measurement_not_in_evidence"],
    ]


def test_code_slugs(spark):
    rows = [(" Pleural-Effusion ", "x"), ("", "Big, bad"), (None, None), ("!!", "x")]
    assert values(spark, ontology.code_slug(F.col("c"), F.col("t")), rows, "c string, t string") == ["pleural_effusion", "big_bad", "reported_finding", "reported_finding"]


def test_concepts_by_longest_spelling_and_field(spark):
    rows = [
        ("airspace_opacity", None, None), ("finding", "Clear LUNGS", "pleural effusion"), ("abnormality", "", "胸腔积液少量"), ("abnormality", "no abnormality", ""),
        (None, None, None), ("opacitys", "", ""), ("normal", "normal", "未见异常密度影。"), ("other_finding", "", ""),
    ]
    found = values(spark, ontology.concept(F.col("c"), F.col("t"), F.col("e"), CONCEPTS), rows, "c string, t string, e string")
    assert [tuple(f) for f in found] == [
        ("opacity", "canonical"), ("opacity", "normal"), ("effusion", "canonical"), ("cardiopulmonary_abnormality", "normal"),
        ("other_finding", "unmapped"), ("other_finding", "unmapped"), ("opacity", "normal"), ("other_finding", "unmapped"),
    ]


def test_negation_needs_every_mention(spark):
    rows = [("No opacity.", "opacity"), ("No opacity but an infiltrate.", "opacity"), ("no rib fracture. opacity", "opacity"), ("nothing", "opacity"), (None, "opacity"), ("未见胸腔积液", "effusion")]
    assert values(spark, ontology.negated(F.col("e"), F.col("c"), CONCEPTS), rows, "e string, c string") == [True, False, False, False, False, True]


def test_anatomy_and_canonical_findings(spark):
    rows = [("Both_Lungs", "x"), (" ", "unspecified"), (None, "heart"), (" Spleen ", "x")]
    assert values(spark, ontology.anatomy(F.col("a"), F.col("d")), rows, "a string, d string") == ["lung", None, "heart", "Spleen"]
    found = spark.createDataFrame([("", "infiltrate", "No infiltrate.", "", "present")], "observation_code string, observation_text string, evidence string, anatomy_code string, certainty string")
    r = ontology.canonical_findings(found, CONCEPTS).first()
    assert (r["concept"], r["certainty"], r["anatomy"], r["slug"]) == ("opacity", "absent", "lung", "infiltrate")


def test_truncation_and_commentary(spark):
    rows = [(None,), ("Done.",), ("short",), ("the lungs are cle",), ("heart size is Normal",), ("x\n审核时间: 2024-01-02 10:00",), ("报告医生：Li Ming",), ("胸部平片未见明显异常情况",)]
    assert values(spark, Q.looks_truncated(F.col("t")), rows, "t string") == [True, False, True, True, False, False, False, False]
    rows = [(None,), (" a\r\nb ",), ("a\r\nb  The provided image shows\nmore",), ("Unable to read",), ("x\n\ny阿里云 z",)]
    assert values(spark, Q.without_commentary(F.col("t")), rows, "t string") == ["", "a\r\nb", "a\nb", "", "x\n\ny"]


def test_foreign_terms_payloads_and_file_names(spark):
    rows = [("CT shows", "cxr"), ("Consider CT.", "cxr"), ("act", "cxr"), ("x-ray", "mri"), (None, "ct"), ("mri", "us")]
    assert values(spark, Q.foreign_terms(F.col("t"), F.col("m")), rows, "t string, m string") == [["ct"], [], [], ["x-ray"], [], []]
    rows = [("a", "text", False), ("mail me@x.org", "text", False), ("a", "text", True), ("a", None, False)]
    blocked = Q.payload_block(F.col("t"), F.col("c"), F.col("image"), ["text"])
    assert values(spark, blocked, rows, "t string, c string, image boolean") == [None, "personal_data:email_address", "image_blocked", "classification_not_allowed"]
    assert values(spark, Q.filename_modality(F.col("p")), [("/a/chest-x ray.png",), ("cxr_1.png",), ("axray.png",)], "p string") == ["cxr", "cxr", None]


def test_denominators_and_states(spark):
    rows = [(10, None, 7, 3, 0.7, 0.3), (10, 9, 7, 3, None, None), (10, None, 7, 2, 0.7, 0.2), (0, None, 0, 0, 0.0, 0.0), (4, None, 1, 3, 0.9, 2.0), (None,) * 6]
    c = gates.denominator_problems(*(F.col(x) for x in "smofab"))
    assert values(spark, c, rows, "s int, m int, o int, f int, a double, b double") == [
        [], ["totals_differ"], ["counts_do_not_sum"], [], ["rate_out_of_range", "success_rate_mismatch", "failure_rate_mismatch"], [],
    ]
    slots = [({"reader_a": "complete", "reader_b": "complete", "adjudication": "complete"},), ({"reader_a": "started"},), ({"reader_a": "not_started"},), ({},), (None,)]
    assert values(spark, gates.annotation_status(F.col("s")), slots, "s map<string,string>") == ["complete", "in_progress", "not_started", "not_started", "not_started"]
    pages = [(["agree", " Agree"],), (["agree", "disagreement"],), ([],), (["what"],), (None,)]
    assert values(spark, gates.audit_status(F.col("s")), pages, "s array<string>") == ["passed", "review_required", "blocked", "blocked", "blocked"]
    assert values(spark, gates.run_status(F.col("a"), F.col("b")), [(0, 0), (1, 0), (None, None)], "a int, b int") == ["no_cases_discovered", None, "no_cases_discovered"]


def test_scores_and_levels(spark):
    rows = [("3.5",), (None,), ("NaN",), ("-Infinity",), ("x",), ("true",)]
    assert values(spark, gates.exclusion_reason(F.col("r")), rows, "r string") == [None, "missing_overall_score", "non_finite_overall_score", "non_finite_overall_score", "invalid_overall_score", "missing_overall_score"]
    rows = [("9", "x"), ("0", "x"), (None, "omission_finding"), ("2.5", "incorrect_severity"), (None, None), ("99999999999999999999999999999999999999999", "contradiction")]
    assert values(spark, gates.hazard_level(F.col("r"), F.col("e")), rows, "r string, e string") == [5, 1, 4, 2, 3, 4]
    assert values(spark, gates.lenient_likert(F.col("r")), [("2.5",), ("3.5",), ("9e99",), ("-2",), ("x",), (None,), ("NaN",)], "r string") == [2, 4, 5, 1, 1, 1, 1]
    rows = [("3", "ok"), ("3.5", "ok"), ("6", "ok"), ("3", " "), (None, "ok")]
    assert values(spark, gates.strict_likert(F.col("r"), F.col("e")), rows, "r string, e string") == [None, "score_must_be_1_to_5", "score_must_be_1_to_5", "explanation_missing", "score_must_be_1_to_5"]


def test_blockers_and_selection(spark):
    declared = spark.createDataFrame([(c, m) for c in "ab" for m in "xy"], "case_id string, model string")
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("a", "y")], "case_id string, model string")
    found = gates.benchmark_blockers(declared, rows)
    assert sorted(r[0] for r in found.collect()) == ["coverage:y", "duplicate:a:y"]
    assert gates.benchmark_blockers(declared.where("model = 'x'"), rows.where("model = 'x'")).count() == 0
    summary = spark.createDataFrame([("x", 0.1, 2, 0.5), ("y", 0.1, 2, 0.7), ("z", 0.2, 0, 1.0)], "model string, clinical_cer_mean double, truncation_count long, negation_token_accuracy_mean double")
    assert gates.selection(summary, found).first()["reason"] == "unequal_candidate_coverage"
    assert tuple(gates.selection(summary, found.limit(0)).first()) == ("provisional", None, "y", 0)
    assert gates.selection(summary.limit(0), found.limit(0)).first()["reason"] == "no_evaluated_candidates"
    other = spark.createDataFrame([("gold",), ("duplicate:a",)], "blocker string")
    assert gates.selection(summary, other).first()["reason"] == "missing_gold_or_candidate_artifacts"


def test_adjudication_and_pages(spark):
    errors = spark.createDataFrame([("c", i, "false_finding") for i in range(5)], "case_id string, error_index int, error_type string")
    said = spark.createDataFrame(
        [("c", 0, "unsupported", 0.9, None), ("c", 1, "unsupported", 0.5, None), ("c", 2, "incorrect_error_type", 0.8, "contradiction"), ("c", 3, "supported", 1.0, None)],
        "case_id string, error_index int, disposition string, confidence double, suggested_type string",
    )
    judged = gates.adjudicated(errors, said)
    assert tuple(gates.adjudication_counts(judged, ["case_id"]).first()) == ("c", 5, 4, 1, 1, 2, False)
    assert judged.where("error_index = 2").first()["error_type"] == "contradiction"
    pages = spark.createDataFrame([("a", 1, True, 5, []), ("a", 2, False, 0, None), ("b", 1, True, 0, []), ("b", 3, True, 4, ["truncated"])], "case_id string, page int, retained boolean, chars int, warnings array<string>")
    assert [tuple(r) for r in gates.page_blockers(pages).collect()] == [("b", ["empty_page", "page_sequence", "page_warning"])]


def test_memo_computes_only_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "memo")
    asked = []

    def upper(rows):
        asked.append(sorted(r["input"] for r in rows.collect()))
        return rows.select("input_sha256", F.upper("input").alias("output"))

    inputs = lambda *v: spark.createDataFrame(list(enumerate(v)), "id int, input string")
    out, counts = reuse.get_or_compute(spark, path, "up", inputs("a", "b", "a"), upper)
    assert sorted((r["id"], r["output"]) for r in out.collect()) == [(0, "A"), (1, "B"), (2, "A")] and tuple(counts.first()) == (0, 2, 2)
    out, counts = reuse.get_or_compute(spark, path, "up", inputs("b", "c"), upper)
    assert sorted(r["output"] for r in out.collect()) == ["B", "C"] and tuple(counts.first()) == (1, 1, 1) and asked == [["a", "b"], ["c"]]
    out, counts = reuse.get_or_compute(spark, path, "other", inputs("b"), lambda r: r.select("input_sha256", F.lit(None).cast("string").alias("output")))
    assert out.first()["output"] is None and tuple(counts.first()) == (0, 1, 0)
    bad = spark.sql("SELECT sha2('q', 256) AS input_sha256, 'Q' AS output, 'x' AS output_sha256, current_timestamp() AS made_at, 'up' AS stage")
    bad.write.mode("append").partitionBy("stage").parquet(path)
    with pytest.raises(Exception, match="does not have its digest"):
        reuse.get_or_compute(spark, path, "up", inputs("q"), upper)[0].collect()
    with pytest.raises(ValueError):
        reuse.get_or_compute(spark, path, "a/b", inputs("q"), upper)


def test_artifacts_are_reused_only_if_all_is_equal(spark):
    wanted = spark.createDataFrame([("a", "1", None), ("b", "1", "x"), ("c", "1", "x"), ("d", "1", "x")], "case_id string, h string, g string")
    old = spark.createDataFrame([("a", "succeeded", "1", None), ("b", "failed", "2", "x"), ("c", "succeeded", "1", None)], "case_id string, status string, h string, g string")
    rows = reuse.reusable(wanted, old, "case_id", ["h", "g"]).orderBy("case_id").collect()
    assert [(r["decision"], r["mismatch"]) for r in rows] == [("reuse", []), ("error", ["status", "h"]), ("error", ["g"]), ("compute", [])]


def test_artifact_lookup(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    rows = lambda *r: spark.createDataFrame(list(r), "pos int, case_id string, report string")
    look = lambda *r: [tuple(x)[1:] for x in reuse.artifact_reports(cases, rows(*r)).orderBy("case_id").collect()]
    reused, lost, unclear = "artifact_reuse_not_fresh_inference", "artifact_case_not_found", "artifact_case_id_missing_for_multi_case_artifact"
    assert look((2, "a", "late"), (1, "a", "first")) == [("first", reused), ("", lost)]
    assert look((1, None, "only")) == [("only", reused)] * 2
    assert look((1, "a", "first"), (2, "", "bare")) == [("first", reused), ("", unclear)]


def test_blinding_and_reader_parts(spark):
    rows = spark.createDataFrame([("c", 2, "m2", "t2"), ("c", 1, "m1", "t1")], "case_id string, pos int, model string, report string")
    shown, private = annotation.blinded(rows, ["pos"], ["model"])
    assert sorted(tuple(r) for r in shown.collect()) == [("c", "t1", "candidate-01", "model-01"), ("c", "t2", "candidate-02", "model-02")]
    assert sorted(r["model"] for r in private.collect()) == ["m1", "m2"] and private.columns == ["case_id", "candidate_id", "blinded_model_id", "model"]
    schema = "case_id string, hash string, slots map<string,string>, answers map<string,string>"
    ours = spark.createDataFrame([("c", "h", {"reader_a": "not_started", "reader_b": "complete"}, {"reader_b": "B"})], schema)
    mine = annotation.export_slot(ours, "reader_a").first()
    assert mine["slots"] == {"reader_a": "not_started", "reader_b": "not_started"} and mine["answers"] == {} and mine["status"] == "not_started"
    back = spark.createDataFrame([("c", "h", {"reader_a": "complete", "reader_b": "not_started"}, {"reader_a": "A"})], schema)
    assert annotation.import_problems(ours, back, "reader_a", ["hash"]).count() == 0
    got = annotation.import_slot(ours, back, "reader_a").first()
    assert got["answers"] == {"reader_a": "A", "reader_b": "B"} and got["slots"] == {"reader_a": "complete", "reader_b": "complete"} and got["status"] == "in_progress"
    bad = spark.createDataFrame([("c", "x", {"reader_b": "complete"}, {"reader_a": "A"}), ("z", "h", {}, {})], schema)
    assert sorted(tuple(r) for r in annotation.import_problems(ours, bad, "reader_b", ["hash"]).collect()) == [
        ("c", "identity_changed"), ("c", "other_slot_has_data"), ("c", "slot_already_complete"), ("z", "unknown_case"),
    ]


def test_series_choice(spark):
    head = "case_id string, path string, instance int, series_uid string, rows int, columns int, description string, protocol string, sequence string"
    rows = [("a", f"p{i}", i, "big", 2, 2, None, "T1", None) for i in range(3)] + [("a", "q1", 1, "f", 2, 2, "Ax FLAIR", None, None), ("a", "q2", 1, "t", 2, 2, "T2", None, None)]
    rows += [("b", p, None, u, None, None, "flair", None, None) for p, u in (("z", "u1"), ("y", "u2"))] + [("c", "x", 1, None, 4, 4, None, None, None)]
    cases = spark.createDataFrame([("a", "mri", "Brain"), ("b", "ct", "brain"), ("c", "mri", None)], "case_id string, modality string, body_part string")
    found = series.chosen_series(spark.createDataFrame(rows, head), cases).orderBy("case_id").collect()
    assert [tuple(r) for r in found] == [
        ("a", "f:2x2", 1, "flair", "brain_mri_flair_preferred"), ("b", "u2:x", 1, "largest", "largest_series"), ("c", "unknown:4x4", 1, "largest", "largest_series"),
    ]


def test_manifests_of_any_shape(spark, tmp_path):
    def read(name, text):
        (tmp_path / name).write_text(text)
        rows, errors = readers.any_manifest(spark, str(tmp_path / name))
        return sorted(r["case_id"] or "" for r in rows.collect()), [r["error"] for r in errors.collect()]

    assert read("a.json", json.dumps([{"case_id": "1"}, {"id": "2"}, 3])) == (["1", "2"], ["entry_is_no_object"])
    assert read("b.json", json.dumps({"cases": [{"case_id": "1"}]})) == (["1"], [])
    assert read("c.json", json.dumps({"cases": 5})) == ([], ["root_must_be_list_or_cases_array"])
    assert read("d.json", "{") == ([], ["invalid_json"])
    assert read("e.jsonl", '{"case_id": "1"}\n\n{') == (["1"], ["invalid_manifest_jsonl"])


def test_small_dimensions(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>ID</t></si><si><t>Reader</t></si><si><t>case1</t></si></sst>")
        cells = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2" t="inlineStr"><is><t>Li</t></is></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    (tmp_path / "readers.xlsx").write_bytes(book.getvalue())
    dim = readers.xlsx_dimension(spark, str(tmp_path / "readers.xlsx"))
    assert [tuple(r) for r in dim.collect()] == [("case1", "Li")]
    assert readers.xlsx_dimension(spark, str(tmp_path / "none.xlsx")).count() == 0
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.yaml").write_text("id: one\nsteps: [1]")
    assert readers.yaml_dimension(spark, str(tmp_path / "p" / "*.yaml")).first()["body"] == '{"id": "one", "steps": [1]}'
    (tmp_path / "p" / "b.yaml").write_text("id: one")
    with pytest.raises(ValueError, match="one"):
        readers.yaml_dimension(spark, str(tmp_path / "p" / "*.yaml"))
    for name in ("CT/case1/Y1", "CT/case1/deep/Y2", "CT/case1/report.pdf", "CT/case2/x.txt", ".hidden/case3/Y1"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text("x")
    found = readers.discovered_cases(spark, str(tmp_path / "tree"), dim).orderBy("case_id").collect()
    assert [(r["modality_dir"], r["case_id"], len(r["image_paths"]), r["warnings"], r["reader"]) for r in found] == [
        ("CT", "case1", 2, [], "Li"), ("CT", "case2", 0, ["missing_image_files", "missing_report_pdf"], "unknown"),
    ]


def test_issues_and_runs(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x\n### H1. First **bold** | 位置: a.py:3 | more\ntail\n- **H2. Second**\n")
    found = readers.issues(spark, str(tmp_path / "a.md"), "H").collect()
    assert [tuple(r)[:3] for r in found] == [("H1", "First bold", "a.py:3"), ("H2", "Second", "")] and found[0]["full_text"].endswith("more\ntail")
    spark.createDataFrame([("a", "ok", 1), ("b", "ok", 2), ("c", "bad", 3)], "run_id string, status string, created_at int").write.parquet(str(tmp_path / "r"))
    assert [r["run_id"] for r in readers.runs(spark, str(tmp_path / "r"), 1, "ok").collect()] == ["b"]
