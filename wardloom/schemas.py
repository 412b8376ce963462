"""Explicit schemas of every table. Nothing is inferred at run time."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

TEXT, INT, LONG, DOUBLE, BOOL = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()
TEXTS = ArrayType(TEXT)


def fields(**kinds: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


METADATA = fields(
    authors=TEXTS, publication_date=DateType(), specialty=TEXTS, credibility=TEXT, url=TEXT, doi=TEXT
)
DOCUMENT = fields(
    source=TEXT, source_id=TEXT, title=TEXT, content=TEXT, content_type=TEXT, metadata=METADATA
)
CHUNK = fields(chunk_id=TEXT, source_document_id=TEXT, text=TEXT, position=INT, metadata=METADATA)
# ``source`` last: it is a partition column of the stored table
KB_CHUNK = fields(
    chunk_id=TEXT, source_document_id=TEXT, text=TEXT, position=INT, metadata=METADATA,
    embedding=ArrayType(FloatType()), source=TEXT,
)

PATIENT = fields(age=INT, sex=TEXT, demographics=TEXT)
GROUND_TRUTH = fields(diagnosis=TEXT, optimal_next_step=TEXT, rationale=TEXT, key_findings=TEXTS)
CHOICE = fields(
    choice=TEXT, is_correct=BOOL, error_type=TEXT, reasoning=TEXT, outcome=TEXT, consequence=TEXT,
    next_decision=TEXT,
)
COMPLICATION = fields(trigger=TEXT, detail=TEXT, event=TEXT, outcome=TEXT)
REVIEW = fields(
    accuracy_score=DOUBLE, pedagogy_score=DOUBLE, bias_score=DOUBLE, approved=BOOL, notes=TEXTS
)
PHASE_PLAN = fields(
    phase_number=INT, time_offset=TEXT, clinical_context=TEXT, available_diagnostics=TEXTS,
    pending_diagnostics=TEXTS, decision_type=TEXT, correct_action=TEXT, key_reasoning=TEXT,
)
BLUEPRINT = fields(
    diagnosis=TEXT,
    clinical_arc=TEXT,
    phase_count=INT,
    phases=ArrayType(PHASE_PLAN),
    branching_points=ArrayType(
        fields(phase_number=INT, branch_type=TEXT, trigger_action_quality=TEXT, description=TEXT)
    ),
    expected_complications=TEXTS,
)
VITALS = fields(
    hr=INT, bp_systolic=INT, bp_diastolic=INT, rr=INT, spo2=DOUBLE, temp_c=DOUBLE, gcs=INT
)
LAB_VALUE = fields(
    name=TEXT, value=DOUBLE, unit=TEXT, reference_low=DOUBLE, reference_high=DOUBLE, flag=TEXT
)
LAB_RESULT = fields(panel=TEXT, values=ArrayType(LAB_VALUE), timestamp=TEXT)
IMAGING_FINDING = fields(structure=TEXT, observation=TEXT, severity=TEXT, laterality=TEXT)
IMAGING_RESULT = fields(
    modality=TEXT, body_region=TEXT, indication=TEXT, findings=ArrayType(IMAGING_FINDING),
    impression=TEXT, timestamp=TEXT,
)
DECISION = fields(
    action=TEXT, is_optimal=BOOL, quality=TEXT, reasoning=TEXT, clinical_outcome=TEXT,
    time_cost=TEXT, leads_to_phase=INT,
)
PHASE = fields(
    phase_number=INT,
    time_offset=TEXT,
    narrative=TEXT,
    vitals=VITALS,
    lab_results=ArrayType(LAB_RESULT),
    imaging_results=ArrayType(IMAGING_RESULT),
    clinical_update=TEXT,
    decisions=ArrayType(DECISION),
    phase_outcome=fields(optimal_next_phase=INT, patient_status=TEXT, narrative_transition=TEXT),
)
SOURCE_REFS = ArrayType(fields(type=TEXT, reference=TEXT, chunk_ids=TEXTS))
CASE_METADATA = fields(
    generated_at=TEXT, model=TEXT, retry_count=INT, total_input_tokens=LONG,
    total_output_tokens=LONG, multi_step=BOOL,
)
CASE = fields(
    case_id=TEXT,
    topic=TEXT,
    difficulty=TEXT,
    specialty=TEXTS,
    patient=PATIENT,
    vignette=TEXT,
    decision_prompt=TEXT,
    ground_truth=GROUND_TRUTH,
    decision_tree=ArrayType(CHOICE),
    complications=ArrayType(COMPLICATION),
    blueprint=BLUEPRINT,
    phases=ArrayType(PHASE),
    review=REVIEW,
    sources=SOURCE_REFS,
    metadata=CASE_METADATA,
)
CASE_STORE = fields(
    case_id=TEXT, topic=TEXT, difficulty=TEXT, specialty=TEXT, accuracy_score=DOUBLE,
    pedagogy_score=DOUBLE, bias_score=DOUBLE, model=TEXT, generated_at=TEXT, case_json=TEXT,
)

REQUEST = fields(
    request_id=TEXT, slot_id=TEXT, stage=TEXT, round=INT, system=TEXT, prompt=TEXT, schema_name=TEXT
)
RESPONSE = fields(
    request_id=TEXT, payload=TEXT, input_tokens=LONG, output_tokens=LONG, model=TEXT
)

ISSUE = fields(phase_number=INT, field=TEXT, issue=TEXT, suggested_fix=TEXT)
# The seven shapes a model answer may have
RESPONSE_SCHEMAS = {
    "case_writer": fields(
        patient=PATIENT, vignette=TEXT, decision_prompt=TEXT, ground_truth=GROUND_TRUTH, specialty=TEXTS
    ),
    "decision_tree": fields(
        decision_tree=ArrayType(CHOICE), complications=ArrayType(COMPLICATION)
    ),
    "review": REVIEW,
    "planner": fields(blueprint=BLUEPRINT, patient=PATIENT, specialty=TEXTS),
    "blueprint_review": fields(approved=BOOL, notes=TEXTS),
    "phase": fields(phase=PHASE),
    "consistency": fields(issues=ArrayType(ISSUE)),
}
# Fields that may be null or absent in an answer; all others are required
OPTIONAL_FIELDS = {
    "error_type", "consequence", "next_decision", "vitals", "gcs", "clinical_update", "time_cost",
    "leads_to_phase", "optimal_next_phase", "flag", "severity", "laterality",
}
# Arrays that count as empty when absent
DEFAULT_EMPTY_FIELDS = {"lab_results", "imaging_results", "decisions"}
