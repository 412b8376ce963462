"""Prompt texts of the generation stages.

The wording is this project's own and a parameter of every request builder: pass other ``Stage`` texts to
use other words. ``{name}`` places are filled from columns of that name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardloom.reference_data import DIFFICULTY_RULES, FALLBACK_DIFFICULTY


@dataclass(frozen=True)
class Stage:
    """One kind of model call: its texts and the shape of its answer."""

    name: str
    schema_name: str
    system: str
    prompt: str


CASE_WRITER = Stage(
    "case_writer",
    "case_writer",
    "You write clinical teaching cases that read like real encounters: incomplete, noisy, and asking for a"
    " decision. Use only what the given source passages support. Vary the patients and avoid stereotypes.",
    "Write one case.\n\nTopic: {topic}\nDifficulty: {difficulty}\nPresentation: {vignette_rule}\n"
    "Expected knowledge: {knowledge_rule}\n\nSource passages:\n{context}\n\n"
    "Give the patient (age, sex, background), the vignette, the question put to the learner, the ground"
    " truth (diagnosis, best next step, rationale, key findings) and the specialties.",
)
DECISION_TREE = Stage(
    "decision_tree",
    "decision_tree",
    "You turn a case into a decision tree with a single right choice and wrong choices that a clinician could"
    " plausibly make. Each wrong choice is marked common_mistake or catastrophic and has a consequence.",
    "Build the decision tree.\n\nVignette:\n{vignette}\n\nGround truth:\n{ground_truth}\n\n"
    "Difficulty: {difficulty}\nChoices: {decision_tree_rule}\nComplications: {complications_rule}\n\n"
    "Source passages:\n{context}\n\n"
    "Give the choices with reasoning and outcome, and the complications of late or wrong treatment.",
)
REVIEW = Stage(
    "review",
    "review",
    "You review teaching cases as a senior clinician. Score accuracy, pedagogy and freedom from bias between 0"
    " and 1. Reject whenever one score is too low and say exactly what has to change.",
    "Review this case.\n\nCase:\n{case_json}\n\nSource passages:\n{context}\n\n"
    "Lowest acceptable score: {threshold}\nApprove only if every score reaches it; otherwise list notes.",
)
PLANNER = Stage(
    "planner",
    "planner",
    "You plan multi-phase clinical simulations. You produce structure only: the arc, the phases, the decisions"
    " and the branches, all grounded in the source passages. No prose, values or reports.",
    "Plan a case.\n\nTopic: {topic}\nDifficulty: {difficulty}\nPresentation: {vignette_rule}\n"
    "Expected knowledge: {knowledge_rule}\nNumber of phases: {phase_count_min_rule}-{phase_count_max_rule}\n"
    "Decisions per phase: {decisions_per_phase_rule}\nDecision qualities: {quality_distribution_rule}\n"
    "Complications: {complications_rule}\n\nSource passages:\n{context}\n\n"
    "Give the diagnosis, the arc, each phase with time, decision type, right action and reasoning, the"
    " branching points (redirect, fork or terminal), and the complications to expect.",
)
BLUEPRINT_REVIEW = Stage(
    "blueprint_review",
    "blueprint_review",
    "You check plans of clinical simulations: sound arc, believable order and times, branches where clinicians"
    " really go wrong, and a phase count that fits the level. Approve only if all four hold.",
    "Check this plan.\n\nPlan:\n{blueprint_json}\n\nSource passages:\n{context}\n\n"
    "Approve it, or reject it with notes on what to fix.",
)
PHASE_RENDERER = Stage(
    "phase_renderer",
    "phase",
    "You write out one phase of a planned simulation: narrative, vital signs, labs with the exact units and"
    " precision of the given panels and flags H, L or critical, imaging in the words of its modality, graded"
    " decisions (optimal, acceptable, suboptimal, harmful, catastrophic; exactly one optimal) and the outcome.",
    "Write this phase.\n\nWhole plan:\n{blueprint_json}\n\nPhase:\n{phase_json}\n\n"
    "Difficulty: {difficulty}\nDecisions per phase: {decisions_per_phase_rule}\n"
    "Decision qualities: {quality_distribution_rule}\nChoices: {decision_tree_rule}\n\n"
    "Source passages:\n{context}\n\nLab panels:\n{lab_context}",
)
CONSISTENCY = Stage(
    "consistency",
    "consistency",
    "You compare the phases of one simulation: vital signs and labs must move plausibly, results cannot come"
    " before their orders, the patient's state must carry over, and nothing done may be offered again.",
    "Compare these phases.\n\n{phases_json}\n\n"
    "List every issue with phase number, field, description and fix, or an empty list.",
)
RETRY = (
    "{prompt}\n\nThe previous attempt was rejected. Every point below must be resolved, and what was right"
    " must stay:\n\n{notes}"
)

_RULE = re.compile(r"\{(\w+)_rule\}")


def rule(name: str, difficulty: Column) -> Column:
    """A difficulty rule by level; an unknown level has the rules of the fallback level."""
    table = F.create_map(*[F.lit(x) for level, r in DIFFICULTY_RULES.items() for x in (level, str(r[name]))])
    return F.coalesce(table[difficulty], F.lit(str(DIFFICULTY_RULES[FALLBACK_DIFFICULTY][name])))


def render(template: str, **values: Column) -> Column:
    """A template with its named places filled from columns."""
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif piece in values:
            parts.append(F.coalesce(values[piece].cast("string"), F.lit("")))
        elif piece.endswith("_rule"):
            parts.append(rule(piece.removesuffix("_rule"), values.get("difficulty", F.col("difficulty"))))
        else:
            parts.append(F.coalesce(F.col(piece).cast("string"), F.lit("")))
    return F.concat(*parts)


def retry_prompt(prompt: Column, notes: Column) -> Column:
    """The prompt with the reviewer's notes added; unchanged when there are none."""
    listed = F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n)), "\n")
    with_notes = render(RETRY, prompt=prompt, notes=listed)
    return F.when(F.coalesce(F.size(notes), F.lit(0)) > 0, with_notes).otherwise(prompt)
