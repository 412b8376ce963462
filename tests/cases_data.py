"""A few hand-written cases."""

import json

from pyspark.sql import functions as F

from wardloom.schemas import CASE


def phase(number, decisions=(), **more):
    base = {
        "phase_number": number, "time_offset": f"T+{number * 5}min", "narrative": f"n{number}",
        "decisions": [
            {"action": a, "is_optimal": o, "quality": q, "reasoning": f"why {a}", "clinical_outcome": f"out {a}"}
            for a, o, q in decisions
        ],
        "phase_outcome": {"optimal_next_phase": None, "patient_status": "ok", "narrative_transition": "t"},
    }
    return {**base, **more}


def case(case_id, phases=(), **more):
    base = {
        "case_id": case_id, "topic": "stroke", "difficulty": "resident", "specialty": ["neurology", "radiology"],
        "patient": {"age": 60, "sex": "male", "demographics": "d"}, "vignette": "v", "decision_prompt": "p",
        "ground_truth": {"diagnosis": "dx", "optimal_next_step": "s", "rationale": "r", "key_findings": []},
        "decision_tree": [], "complications": [], "phases": list(phases), "sources": [],
        "metadata": {"generated_at": f"2024-01-0{len(case_id)}T00:00:00", "model": "m", "retry_count": 0},
    }
    return {**base, **more}


def review(accuracy, approved=True):
    return {"accuracy_score": accuracy, "pedagogy_score": 0.8, "bias_score": 0.9, "approved": approved, "notes": []}


def frame(spark, *cases):
    rows = spark.createDataFrame([(json.dumps(c),) for c in cases], "j string")
    return rows.select(F.from_json("j", CASE).alias("c")).select("c.*")
