import json

from pyspark.sql import functions as F

from tests.cases_data import case, frame, phase, review
from wardloom.operators import cases as case_ops
from wardloom.operators import exports, grading, validation
from wardloom.reference_data import LAB_PANELS, SPECIALTY_KEYWORDS

VITALS = {"hr": 110, "bp_systolic": 120, "bp_diastolic": 80, "rr": 18, "spo2": 98.0, "temp_c": 37.5}
LAB = {"panel": "BMP", "timestamp": "T+5min", "values": [
    {"name": "K", "value": 6.6, "unit": "mEq/L", "reference_low": 3.5, "reference_high": 5.0},
    {"name": "Na", "value": 130.0, "unit": "mEq/L", "reference_low": 136.0, "reference_high": 145.0}]}
IMAGE = {"modality": "CT", "body_region": "head", "indication": "i", "impression": "bleed", "timestamp": "T+9min",
         "findings": [{"structure": "brain", "observation": "hyperdense area"}, {"structure": "skull", "observation": "intact"}]}
TWO = [
    phase(1, [("scan", False, "acceptable"), ("lyse", True, "optimal"), ("call", True, "optimal"), ("leave", False, "odd")],
          vitals={**VITALS, "gcs": 9}, lab_results=[LAB], imaging_results=[IMAGE], clinical_update="worse"),
    phase(2, [], vitals=VITALS),
]


def test_rl_episode(spark):
    row = exports.rl_episodes(frame(spark, case("a", TWO))).head()
    first, second = row["steps"]
    assert (first["step_number"], first["optimal_action"]) == (1, "p1_a2")
    assert [a["id"] for a in first["action_space"]] == ["p1_a0", "p1_a1", "p1_a2", "p1_a3"]
    assert first["reward_table"] == {"p1_a0": 0.6, "p1_a1": 1.0, "p1_a2": 1.0, "p1_a3": 0.0}
    assert first["observation"]["pending_orders"] == [] and first["observation"]["time_elapsed"] == "T+5min"
    assert len(first["observation"]["new_lab_results"]) == 1
    assert second["optimal_action"] == "" and second["reward_table"] == {} and second["action_space"] == []
    custom = exports.rl_episodes(frame(spark, case("a", TWO)), {"optimal": 10.0}).head()
    assert custom["steps"][0]["reward_table"] == {"p1_a0": 0.0, "p1_a1": 10.0, "p1_a2": 10.0, "p1_a3": 0.0}
    assert exports.rl_episodes(frame(spark, case("a", TWO)), {}).head()["steps"][0]["reward_table"]["p1_a0"] == 0.6


def test_sft_conversation(spark):
    row = exports.sft_conversations(frame(spark, case("a", TWO))).head()
    assert [t["role"] for t in row["turns"]] == ["system", "assistant", "system", "assistant"]
    assert row["turns"][0]["content"] == (
        "n1\nVitals: HR 110, BP 120/80, RR 18, SpO2 98.0%, Temp 37.5°C, GCS 9\nBMP (T+5min): K 6.6 mEq/L, Na 130.0 mEq/L"
        "\nCT head (T+9min): brain: hyperdense area; skull: intact. Impression: bleed\nUpdate: worse")
    assert row["turns"][1]["content"] == "Based on the clinical presentation, I would lyse. Reasoning: why lyse. Expected outcome: out lyse."
    assert row["turns"][2]["content"].endswith("Temp 37.5°C")
    assert row["turns"][3]["content"] == "No clinical decision options available for this phase."
    assert row["system_prompt"].startswith("You are a physician")
    wrong = exports.sft_conversations(frame(spark, case("a", TWO)), wrong_path=True).head()
    assert "I would scan." in wrong["turns"][1]["content"]
    only = [phase(1, [("x", True, "optimal"), ("y", True, "optimal")]), phase(2, [("x", False, "harmful"), ("y", False, "harmful")])]
    right = exports.sft_conversations(frame(spark, case("a", only))).head()["turns"]
    wrong = exports.sft_conversations(frame(spark, case("a", only)), wrong_path=True).head()["turns"]
    assert "would x." in right[3]["content"] and "would y." in wrong[1]["content"]


def test_export_job(spark):
    store = case_ops.store_rows(frame(
        spark, case("a", TWO, review=review(0.9)), case("bb", review=review(0.9)), case("ccc", TWO, review=review(0.1))))
    records = [json.loads(r["line"]) for r in exports.export_training(store, min_accuracy=0.5, include_wrong_paths=True).collect()]
    assert sorted(r["type"] for r in records) == ["rl_episode", "sft_conversation", "sft_wrong_path"]
    episode = next(r for r in records if r["type"] == "rl_episode")
    assert episode["steps"][1]["observation"]["vitals"]["gcs"] is None
    assert exports.export_training(store, fmt="rl").count() == 2
    assert exports.export_training(store, fmt="sft", topic="none").count() == 0


def test_fixed_tables(spark):
    assert len(LAB_PANELS) == 14 and validation.lab_panels(spark).count() == 67
    assert (len(SPECIALTY_KEYWORDS), sum(map(len, SPECIALTY_KEYWORDS.values()))) == (21, 202)
    assert validation.imaging_templates(spark).count() == 5
    lines = validation.lab_context(validation.lab_panels(spark)).head()["lab_context"].split("\n")
    assert len(lines) == 14 and lines[0].startswith("CBC: WBC 4.5-11.0 K/uL, Hgb 12.0-16.0 g/dL")


def test_lab_checks(spark):
    odd = {"panel": "BMP", "timestamp": "t", "values": [
        {"name": "K", "value": 4.25, "unit": "mEq/L", "reference_low": 3.5, "reference_high": 5.0},
        {"name": "Zz", "value": 1.0, "unit": "u", "reference_low": 0.0, "reference_high": 2.0},
        {"name": "Cr", "value": 1.0, "unit": "g", "reference_low": 0.7, "reference_high": 1.3},
        {"name": "Ca", "value": 10.5, "unit": None, "reference_low": 8.5, "reference_high": 10.5}]}
    values = validation.lab_values(frame(spark, case("a", [phase(1, lab_results=[LAB, odd])])))
    panels = validation.lab_panels(spark)
    flags = {r["name"]: r["flag"] for r in validation.flag_labs(values, panels).where("value <> 4.25").collect()}
    assert flags == {"K": "critical", "Na": "L", "Zz": None, "Cr": None, "Ca": None}
    issues = {r["name"]: r["issues"] for r in validation.check_lab_template(values, panels).collect()}
    assert issues == {"K": ["wrong precision"], "Zz": ["unknown component"], "Cr": ["wrong unit"], "Ca": ["wrong unit"]}


def test_imaging_checks(spark):
    mri = {**IMAGE, "modality": "MRI", "body_region": "head"}
    pet = {**IMAGE, "modality": "PET"}
    studies = validation.imaging_studies(frame(spark, case("a", [phase(1, imaging_results=[IMAGE, mri, pet])])))
    terms = [(r["modality"], r["foreign_term"]) for r in validation.check_imaging_terms(studies).collect()]
    assert terms == [("MRI", "hyperdense")]
    issues = sorted((r["modality"], r["issue"]) for r in validation.check_body_region(studies).collect())
    assert issues == [("MRI", "invalid body region"), ("PET", "unknown modality")]


def test_shape_checks(spark):
    phases = [
        phase(1, [("scan", True, "optimal"), ("wait", False, "harmful")], vitals=VITALS),
        phase(2, [("scan", False, "acceptable"), ("lyse", True, "optimal"), ("go", True, "optimal")], time_offset="T+1min", vitals={**VITALS, "hr": 60}),
        phase(3, [("go", True, "optimal"), ("go", False, "harmful")], time_offset="whenever"),
    ]
    cases = frame(spark, case("a", phases, difficulty="medical_student", review=review(0.69)), case("bb", difficulty="expert"))
    assert [(r["phase_number"], r["optimal"]) for r in validation.check_one_optimal(cases).collect()] == [(2, 2)]
    shape = {r["case_id"]: r for r in validation.check_difficulty_shape(cases).collect()}
    assert shape["a"]["phases_fit"] and shape["a"]["phases_off"] == 0 and shape["a"]["phase_count"] == 3
    assert not shape["bb"]["known_difficulty"] and shape["bb"]["phases_fit"] is None
    assert [r["passes"] for r in validation.score_gate(cases).collect()] == [False]
    assert [r["passes"] for r in validation.score_gate(cases, 0.6).collect()] == [True]
    assert [(r["phase_number"], r["minutes"]) for r in validation.check_offset_order(cases).collect()] == [(2, 1), (3, None)]
    deltas = {r["phase_number"]: r["hr_delta"] for r in validation.vitals_delta(cases).collect()}
    assert deltas == {1: None, 2: -50.0, 3: None}
    assert [r["phase_number"] for r in validation.vitals_delta(cases, {"hr": 40}).collect()] == [2]
    again = sorted((r["phase_number"], r["action"]) for r in validation.check_repeat_action(cases).collect())
    assert again == [(2, "scan"), (3, "go")]


def test_grading(spark):
    tree = [
        {"choice": "w1", "is_correct": False, "error_type": "catastrophic", "reasoning": "r", "outcome": "o1", "consequence": "dies"},
        {"choice": "ok", "is_correct": True, "reasoning": "r", "outcome": "o2"},
        {"choice": "w2", "is_correct": False, "error_type": "common_mistake", "reasoning": "r", "outcome": "o3"},
    ]
    cases = frame(spark, case("a", decision_tree=tree))
    answers = [(f"h{i}", "a", 1) for i in range(300)] + [("x", "a", 0), ("y", "a", 2), ("z", "a", 7), ("q", "no", 0), ("u", "a", None), ("n", None, 1)]
    graded = {r["answer_id"]: r for r in grading.grade_choices(cases, spark.createDataFrame(answers, "answer_id string, case_id string, chosen int")).collect()}
    assert len(graded) == 306
    assert [graded[k]["verdict"] for k in "zqun"] == ["unknown choice", "unknown case", "unknown choice", "unknown case"]
    assert (graded["x"]["verdict"], graded["x"]["correct_choice"], graded["x"]["consequence"]) == ("Catastrophic Error", "ok", "dies")
    assert graded["y"]["verdict"] == "Incorrect" and graded["h0"]["verdict"] == "Correct!" and graded["h0"]["correct_choice"] is None
    kinds = [r["class"] for r in grading.decision_classes(cases).orderBy("position").collect()]
    assert kinds == ["catastrophic", "correct", "other"]
