"""Fixed values.

Everything in this module is a constant that results depend on: word lists,
lookup tables, formats and thresholds. No logic lives here.
"""

# ---------------------------------------------------------------------------
# Credibility levels, best first, with their retrieval rank
# ---------------------------------------------------------------------------
CREDIBILITY_RANK = {
    "guideline": 0,
    "fda_label": 1,
    "peer_reviewed": 2,
    "curated": 3,
    "preprint": 4,
}
UNKNOWN_CREDIBILITY_RANK = 99
DEFAULT_CREDIBILITY = "preprint"

# ---------------------------------------------------------------------------
# defaults
# ---------------------------------------------------------------------------
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
LIMIT_PER_SOURCE = 20
SOURCE_CAPS = {"openfda": 100, "dailymed": 100, "clinicaltrials": 100}
RETRIEVE_LIMIT = 25
SEARCH_LIMIT = 10
LIST_LIMIT = 100
EXPORT_LIMIT = 10_000
MAX_ROUNDS = 3
MAX_RERENDER_PASSES = 2
REVIEW_THRESHOLD = 0.7
EMBEDDING_WIDTH = 384
RECENT_DAYS = 30

# ---------------------------------------------------------------------------
# Section headers that start a new chunk
# ---------------------------------------------------------------------------
DRUG_LABEL_HEADERS = [
    "INDICATIONS AND USAGE",
    "CONTRAINDICATIONS",
    "WARNINGS AND PRECAUTIONS",
    "ADVERSE REACTIONS",
    "DRUG INTERACTIONS",
    "USE IN SPECIFIC POPULATIONS",
    "OVERDOSAGE",
    "DESCRIPTION",
    "CLINICAL PHARMACOLOGY",
    "NONCLINICAL TOXICOLOGY",
    "CLINICAL STUDIES",
    "REFERENCES",
    "HOW SUPPLIED",
    "WARNINGS",
    "PRECAUTIONS",
    "DOSAGE AND ADMINISTRATION",
]
TRIAL_HEADERS = [
    "BACKGROUND",
    "OBJECTIVE",
    "OBJECTIVES",
    "STUDY DESIGN",
    "ELIGIBILITY CRITERIA",
    "INCLUSION CRITERIA",
    "EXCLUSION CRITERIA",
    "ENDPOINT",
    "ENDPOINTS",
    "INTERVENTION",
    "INTERVENTIONS",
    "STATISTICAL ANALYSIS",
    "RESULT",
    "RESULTS",
    "CONCLUSION",
    "CONCLUSIONS",
    "METHOD",
    "METHODS",
    "PROTOCOL",
]

# ---------------------------------------------------------------------------
# Landed label fields and section codes with their header
# ---------------------------------------------------------------------------
OPENFDA_SECTIONS = [
    ("indications_and_usage", "INDICATIONS AND USAGE"),
    ("dosage_and_administration", "DOSAGE AND ADMINISTRATION"),
    ("contraindications", "CONTRAINDICATIONS"),
    ("warnings", "WARNINGS"),
    ("warnings_and_cautions", "WARNINGS AND PRECAUTIONS"),
    ("adverse_reactions", "ADVERSE REACTIONS"),
    ("drug_interactions", "DRUG INTERACTIONS"),
    ("boxed_warning", "BOXED WARNING"),
    ("overdosage", "OVERDOSAGE"),
]
LOINC_SECTIONS = {
    "34067-9": "INDICATIONS AND USAGE",
    "34068-7": "DOSAGE AND ADMINISTRATION",
    "34070-3": "CONTRAINDICATIONS",
    "43685-7": "WARNINGS AND PRECAUTIONS",
    "34084-4": "ADVERSE REACTIONS",
    "34073-7": "DRUG INTERACTIONS",
    "34089-3": "DESCRIPTION",
    "34090-1": "CLINICAL PHARMACOLOGY",
    "34066-1": "BOXED WARNING",
    "34088-5": "OVERDOSAGE",
}
GUIDELINE_TYPES = ["Practice Guideline", "Guideline"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# ---------------------------------------------------------------------------
# Keywords whose presence in a text adds a specialty
# ---------------------------------------------------------------------------
SPECIALTY_KEYWORDS = {
    "neurosurgery": [
        "neurosurg", "craniotomy", "craniectomy", "laminectomy", "spinal fusion",
        "deep brain stimulation", "ventriculostomy", "neurosurgical",
    ],
    "neurology": [
        "neurology", "neurolog", "epilepsy", "seizure", "stroke", "multiple sclerosis",
        "parkinson", "dementia", "alzheimer", "neuropathy", "migraine", "meningitis",
        "encephalitis", "brain tumor", "glioblastoma",
    ],
    "cardiology": [
        "cardiology", "cardiolog", "myocardial infarction", "heart failure",
        "atrial fibrillation", "coronary artery", "echocardiogram", "cardiac", "arrhythmia",
        "pacemaker", "stent", "angioplasty",
    ],
    "cardiothoracic_surgery": [
        "cardiothoracic", "cardiac surgery", "bypass graft", "valve replacement",
        "thoracotomy", "sternotomy", "aortic dissection",
    ],
    "orthopedics": [
        "orthopedic", "orthopaedic", "fracture", "arthroplasty", "joint replacement",
        "osteotomy", "meniscus", "ligament", "tendon repair", "bone graft",
    ],
    "oncology": [
        "oncology", "oncolog", "chemotherapy", "radiation therapy", "radiotherapy", "tumor",
        "cancer", "malignancy", "metastasis", "lymphoma", "leukemia", "carcinoma", "sarcoma",
        "biopsy",
    ],
    "emergency_medicine": [
        "emergency medicine", "emergency department", "trauma", "resuscitation", "triage",
        "acute care", "emergency physician",
    ],
    "critical_care": [
        "critical care", "intensive care", "icu", "mechanical ventilation", "sepsis",
        "vasopressor", "hemodynamic", "organ failure",
    ],
    "pulmonology": [
        "pulmonology", "pulmonolog", "respiratory", "asthma", "copd", "pneumonia",
        "bronchitis", "pulmonary fibrosis", "pulmonary embolism", "lung",
    ],
    "gastroenterology": [
        "gastroenterology", "gastroenterolog", "inflammatory bowel", "crohn",
        "ulcerative colitis", "colonoscopy", "endoscopy", "hepatitis", "cirrhosis",
        "pancreatitis", "gastrointestinal",
    ],
    "nephrology": [
        "nephrology", "nephrolog", "kidney", "renal", "dialysis", "glomerulonephritis",
        "nephrotic syndrome", "chronic kidney disease",
    ],
    "endocrinology": [
        "endocrinology", "endocrinolog", "diabetes", "thyroid", "insulin", "hyperthyroidism",
        "hypothyroidism", "adrenal", "pituitary", "hormone",
    ],
    "infectious_disease": [
        "infectious disease", "infection", "antibiotic", "antimicrobial", "bacteremia",
        "fungal", "viral", "hiv", "tuberculosis", "malaria", "septicemia",
    ],
    "psychiatry": [
        "psychiatry", "psychiatr", "depression", "anxiety", "schizophrenia", "bipolar",
        "psychosis", "antidepressant", "antipsychotic", "mental health",
    ],
    "pediatrics": [
        "pediatric", "paediatric", "neonatal", "infant", "child", "childhood", "adolescent",
        "congenital",
    ],
    "obstetrics_gynecology": [
        "obstetrics", "gynecology", "gynaecology", "pregnancy", "prenatal", "postpartum",
        "cesarean", "ovarian", "uterine", "endometriosis",
    ],
    "anesthesiology": [
        "anesthesiology", "anesthesia", "anaesthesia", "sedation", "intubation",
        "regional anesthesia", "epidural", "general anesthesia",
    ],
    "radiology": [
        "radiology", "radiolog", "mri", "ct scan", "x-ray", "ultrasound", "imaging",
        "interventional radiology", "fluoroscopy",
    ],
    "dermatology": [
        "dermatology", "dermatolog", "skin", "eczema", "psoriasis", "melanoma", "dermatitis",
        "rash", "acne",
    ],
    "ophthalmology": [
        "ophthalmology", "ophthalmolog", "retinal", "glaucoma", "cataract", "intraocular",
        "vitrectomy", "corneal",
    ],
    "urology": [
        "urology", "urolog", "prostate", "bladder", "kidney stone", "nephrectomy",
        "cystoscopy", "urinary", "incontinence",
    ],
}

# ---------------------------------------------------------------------------
# Lab panels
# (component, unit, reference low, reference high, critical low, critical high, precision)
# ---------------------------------------------------------------------------
_CBC = [
    ("WBC", "K/uL", 4.5, 11.0, 2.0, 30.0, 1),
    ("Hgb", "g/dL", 12.0, 16.0, 7.0, 20.0, 1),
    ("Hct", "%", 36.0, 46.0, None, None, 1),
    ("Plt", "K/uL", 150.0, 400.0, 50.0, 1000.0, 0),
    ("MCV", "fL", 80.0, 100.0, None, None, 1),
    ("RDW", "%", 11.5, 14.5, None, None, 1),
]
_BMP = [
    ("Na", "mEq/L", 136.0, 145.0, 120.0, 160.0, 0),
    ("K", "mEq/L", 3.5, 5.0, 2.5, 6.5, 1),
    ("Cl", "mEq/L", 98.0, 106.0, None, None, 0),
    ("CO2", "mEq/L", 23.0, 29.0, None, None, 0),
    ("BUN", "mg/dL", 7.0, 20.0, None, None, 0),
    ("Cr", "mg/dL", 0.7, 1.3, None, 10.0, 2),
    ("Glucose", "mg/dL", 70.0, 100.0, 40.0, 500.0, 0),
    ("Ca", "mg/dL", 8.5, 10.5, 6.0, 13.0, 1),
]
_HEPATIC = [
    ("AST", "U/L", 10.0, 40.0, None, None, 0),
    ("ALT", "U/L", 7.0, 56.0, None, None, 0),
    ("ALP", "U/L", 44.0, 147.0, None, None, 0),
    ("Albumin", "g/dL", 3.5, 5.0, None, None, 1),
    ("Total Protein", "g/dL", 6.0, 8.3, None, None, 1),
    ("Total Bilirubin", "mg/dL", 0.1, 1.2, None, None, 1),
]
LAB_PANELS = {
    "CBC": _CBC,
    "BMP": _BMP,
    "CMP": _BMP + _HEPATIC,
    "coags": [
        ("PT", "sec", 11.0, 13.5, None, None, 1),
        ("INR", "", 0.8, 1.1, None, 5.0, 1),
        ("PTT", "sec", 25.0, 35.0, None, 100.0, 1),
        ("Fibrinogen", "mg/dL", 200.0, 400.0, 100.0, None, 0),
    ],
    "ABG": [
        ("pH", "", 7.35, 7.45, 7.1, 7.6, 2),
        ("pCO2", "mmHg", 35.0, 45.0, None, None, 0),
        ("pO2", "mmHg", 80.0, 100.0, 40.0, None, 0),
        ("HCO3", "mEq/L", 22.0, 26.0, None, None, 0),
        ("Lactate", "mmol/L", 0.5, 2.0, None, 4.0, 1),
    ],
    "CSF": [
        ("WBC", "cells/uL", 0.0, 5.0, None, None, 0),
        ("RBC", "cells/uL", 0.0, 0.0, None, None, 0),
        ("Protein", "mg/dL", 15.0, 45.0, None, None, 0),
        ("Glucose", "mg/dL", 40.0, 70.0, None, None, 0),
        ("Opening Pressure", "cmH2O", 6.0, 20.0, None, 30.0, 0),
    ],
    "troponin": [("Troponin I", "ng/mL", 0.0, 0.04, None, 0.4, 3)],
    "lipase": [("Lipase", "U/L", 0.0, 160.0, None, None, 0)],
    "d_dimer": [("D-dimer", "ng/mL", 0.0, 500.0, None, None, 0)],
    "BNP": [("BNP", "pg/mL", 0.0, 100.0, None, None, 0)],
    "UA": [
        ("pH", "", 4.5, 8.0, None, None, 1),
        ("Specific Gravity", "", 1.005, 1.03, None, None, 3),
        ("Leukocyte Esterase", "", 0.0, 0.0, None, None, 0),
        ("Nitrites", "", 0.0, 0.0, None, None, 0),
        ("Protein", "mg/dL", 0.0, 14.0, None, None, 0),
        ("Glucose", "mg/dL", 0.0, 0.0, None, None, 0),
        ("Blood", "", 0.0, 0.0, None, None, 0),
    ],
    "LFTs": [
        ("AST", "U/L", 10.0, 40.0, None, None, 0),
        ("ALT", "U/L", 7.0, 56.0, None, None, 0),
        ("ALP", "U/L", 44.0, 147.0, None, None, 0),
        ("GGT", "U/L", 9.0, 48.0, None, None, 0),
        ("Albumin", "g/dL", 3.5, 5.0, None, None, 1),
        ("Total Bilirubin", "mg/dL", 0.1, 1.2, None, None, 1),
        ("Direct Bilirubin", "mg/dL", 0.0, 0.3, None, None, 1),
    ],
    "thyroid": [
        ("TSH", "mIU/L", 0.4, 4.0, None, None, 2),
        ("Free T4", "ng/dL", 0.8, 1.8, None, None, 2),
        ("Free T3", "pg/mL", 2.3, 4.2, None, None, 1),
    ],
    "iron_studies": [
        ("Serum Iron", "mcg/dL", 60.0, 170.0, None, None, 0),
        ("TIBC", "mcg/dL", 250.0, 370.0, None, None, 0),
        ("Ferritin", "ng/mL", 12.0, 300.0, None, None, 0),
        ("Transferrin Sat", "%", 20.0, 50.0, None, None, 0),
    ],
}

# ---------------------------------------------------------------------------
# Imaging modalities, their body regions and vocabulary
# ---------------------------------------------------------------------------
IMAGING_REPORT_FORMAT = "findings → impression"
IMAGING_BODY_REGIONS = {
    "CT": ["head", "chest", "abdomen", "pelvis", "spine", "neck", "extremity"],
    "MRI": ["brain", "spine", "abdomen", "pelvis", "extremity", "chest", "neck"],
    "XR": ["chest", "abdomen", "extremity", "spine", "pelvis"],
    "US": ["abdomen", "pelvis", "neck", "extremity", "chest", "cardiac"],
    "CTA": ["head", "neck", "chest", "abdomen", "extremity"],
}
IMAGING_TERMS = {
    "CT": {
        "density": ["hyperdense", "hypodense", "isodense"],
        "enhancement": ["enhancing", "non-enhancing", "rim-enhancing"],
        "morphology": ["mass", "lesion", "collection", "effusion", "hemorrhage", "calcification"],
        "distribution": ["focal", "diffuse", "multifocal", "segmental"],
    },
    "MRI": {
        "signal": ["hyperintense", "hypointense", "isointense"],
        "sequences": ["T1-weighted", "T2-weighted", "FLAIR", "DWI", "ADC", "post-contrast"],
        "findings": ["restricted diffusion", "enhancement", "edema", "mass effect", "herniation"],
        "morphology": ["mass", "lesion", "collection", "effusion"],
    },
    "XR": {
        "density": ["opacity", "lucency", "radiopaque", "radiolucent"],
        "findings": ["consolidation", "infiltrate", "effusion", "pneumothorax", "cardiomegaly",
                     "fracture", "dislocation"],
        "distribution": ["focal", "diffuse", "bilateral", "unilateral", "lobar", "patchy"],
    },
    "US": {
        "echogenicity": ["hyperechoic", "hypoechoic", "anechoic", "isoechoic", "heterogeneous"],
        "findings": ["mass", "collection", "free fluid", "thrombus", "calculus", "dilation"],
        "flow": ["hyperemic", "avascular", "reduced flow", "absent flow", "reversal of flow"],
    },
    "CTA": {
        "vascular": ["aneurysm", "stenosis", "occlusion", "dissection", "filling defect",
                     "extravasation"],
        "density": ["hyperdense", "hypodense"],
        "morphology": ["saccular", "fusiform", "irregular", "smooth"],
    },
}

# ---------------------------------------------------------------------------
# Difficulty rules
# ---------------------------------------------------------------------------
FALLBACK_DIFFICULTY = "resident"
DIFFICULTY_RULES = {
    "medical_student": {
        "vignette": "Include most key findings with fewer distractors. Classic textbook presentation.",
        "decision_tree": "Provide 2-3 choices. One clearly correct, one common mistake, one possible catastrophic error.",
        "complications": "Simple cause-effect relationships.",
        "knowledge": "Foundational pathophysiology. Basic diagnostic and treatment knowledge.",
        "phase_count_min": 3,
        "phase_count_max": 3,
        "decisions_per_phase": "2-3",
        "quality_distribution": "1 optimal, 1 harmful/catastrophic, 0-1 suboptimal",
    },
    "resident": {
        "vignette": "Some findings missing, moderate distractors. Atypical or overlapping presentations.",
        "decision_tree": "Provide 3-4 choices with nuanced distinctions. Include management algorithm decisions.",
        "complications": "Multi-step cascades where one error leads to another.",
        "knowledge": "Management algorithms, workup prioritization, time-sensitive decisions.",
        "phase_count_min": 5,
        "phase_count_max": 5,
        "decisions_per_phase": "3-4",
        "quality_distribution": "1 optimal, 1-2 acceptable/suboptimal, 1 harmful",
    },
    "attending": {
        "vignette": "Incomplete data, many distractors, red herrings. Rare variants or multiple concurrent pathologies.",
        "decision_tree": "Provide 4-5 choices with subtle distinctions between reasonable options.",
        "complications": "System-level failures (e.g., missed consult leads to delayed OR leads to herniation).",
        "knowledge": "Nuanced judgment calls, resource constraints, ambiguity tolerance.",
        "phase_count_min": 7,
        "phase_count_max": 10,
        "decisions_per_phase": "4-5",
        "quality_distribution": "1 optimal, 2 acceptable, 1-2 suboptimal, 0-1 catastrophic",
    },
}

# ---------------------------------------------------------------------------
# Export formats and rewards
# ---------------------------------------------------------------------------
REWARDS = {
    "optimal": 1.0,
    "acceptable": 0.6,
    "suboptimal": 0.2,
    "harmful": -0.5,
    "catastrophic": -1.0,
}
SFT_SYSTEM_PROMPT = (
    "You are a physician evaluating a patient. At each step, you will receive clinical information "
    "and must decide on the next action. Explain your clinical reasoning before stating your decision."
)
SFT_ANSWER_FORMAT = (
    "Based on the clinical presentation, I would {}. Reasoning: {}. Expected outcome: {}."
)
SFT_NO_DECISIONS = "No clinical decision options available for this phase."
SFT_VITALS_FORMAT = "\nVitals: HR {}, BP {}/{}, RR {}, SpO2 {}%, Temp {}°C"
CONTEXT_SEPARATOR = "\n\n---\n\n"
MULTI_STEP_DECISION_PROMPT = "What would you do next?"
NO_PHASES_NOTE = "Blueprint has no phases"
CONSISTENCY_NOTE_PREFIX = "Consistency issue: "
