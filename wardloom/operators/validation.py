"""Checks of cases against lab, imaging and difficulty rules.

Phases are nested in their case, so checks over several phases run inside the row: no join of phases
with each other and no shuffle. The lab table has 67 rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.dates import offset_minutes
from wardloom.functions.text import float_text
from wardloom.reference_data import (
    DIFFICULTY_RULES,
    IMAGING_BODY_REGIONS,
    IMAGING_REPORT_FORMAT,
    IMAGING_TERMS,
    LAB_PANELS,
    REVIEW_THRESHOLD,
)

# --- fixed tables as rows ----------------------------------------------------------


def lab_panels(spark: SparkSession) -> DataFrame:
    rows = [
        (panel, p, component[0], c, *component[1:])
        for p, (panel, components) in enumerate(LAB_PANELS.items())
        for c, component in enumerate(components)
    ]
    return spark.createDataFrame(
        rows,
        "panel string, panel_pos int, component string, component_pos int, unit string, "
        "reference_low double, reference_high double, critical_low double, critical_high double, "
        "precision int",
    )


def imaging_templates(spark: SparkSession) -> DataFrame:
    rows = [
        (m, IMAGING_BODY_REGIONS[m], IMAGING_TERMS[m], IMAGING_REPORT_FORMAT) for m in IMAGING_BODY_REGIONS
    ]
    return spark.createDataFrame(
        rows,
        "modality string, valid_body_regions array<string>, terminology map<string,array<string>>, "
        "report_format string",
    )


def lab_context(panels: DataFrame) -> DataFrame:
    """One text with a line per panel and its reference ranges, in declared order."""
    component = F.concat(
        F.col("component"), F.lit(" "), float_text(F.col("reference_low")), F.lit("-"),
        float_text(F.col("reference_high")), F.lit(" "), F.col("unit"),
    )
    by_panel = panels.groupBy("panel", "panel_pos").agg(
        F.array_sort(F.collect_list(F.struct("component_pos", component.alias("text")))).alias("parts")
    )
    line = F.concat(F.col("panel"), F.lit(": "), F.array_join(F.transform("parts", lambda x: x["text"]), ", "))
    lines = by_panel.agg(F.array_sort(F.collect_list(F.struct("panel_pos", line.alias("line")))).alias("lines"))
    return lines.select(F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("lab_context"))


# --- labs --------------------------------------------------------------------------


def lab_values(cases: DataFrame) -> DataFrame:
    """Every measured value of every phase, one row each."""
    return (
        cases.select("case_id", F.explode("phases").alias("phase"))
        .select("case_id", F.col("phase.phase_number"), F.explode("phase.lab_results").alias("result"))
        .select("case_id", "phase_number", F.col("result.panel"), F.posexplode("result.values").alias("value_pos", "v"))
        .select("case_id", "phase_number", "panel", "value_pos", "v.*")
    )


def _with_template(values: DataFrame, panels: DataFrame) -> DataFrame:
    template = panels.select(
        "panel",
        F.col("component").alias("name"),
        F.struct(
            "unit", "reference_low", "reference_high", "critical_low", "critical_high", "precision"
        ).alias("template"),
    )
    return values.join(template, ["panel", "name"], "left")


def flag_labs(values: DataFrame, panels: DataFrame) -> DataFrame:
    """Set ``flag``: critical beyond the critical bounds, else H or L beyond the reference, else null."""
    t, v = F.col("template"), F.col("value")
    flag = (
        F.when((v < t["critical_low"]) | (v > t["critical_high"]), F.lit("critical"))
        .when(v > t["reference_high"], F.lit("H"))
        .when(v < t["reference_low"], F.lit("L"))
    )
    return _with_template(values, panels).withColumn("flag", flag).drop("template").select(*_flagged(values))


def _flagged(values: DataFrame) -> list[str]:
    return [*values.columns, *([] if "flag" in values.columns else ["flag"])]


def check_lab_template(values: DataFrame, panels: DataFrame) -> DataFrame:
    """Values that differ from their template, with all that is wrong: unknown component, other or no unit, too many decimals."""
    t = F.col("template")
    scaled = F.col("value") * F.pow(F.lit(10.0), t["precision"])
    too_fine = F.abs(scaled - F.round(scaled)) > 1e-6
    found = F.array_compact(
        F.array(
            F.when(t.isNull(), F.lit("unknown component")),
            F.when(t.isNotNull() & ~F.col("unit").eqNullSafe(t["unit"]), F.lit("wrong unit")),
            F.when(too_fine, F.lit("wrong precision")),
        )
    )
    return _with_template(values, panels).withColumn("issues", found).where("size(issues) > 0").select(*values.columns, "issues")


# --- imaging -----------------------------------------------------------------------


def imaging_studies(cases: DataFrame) -> DataFrame:
    return (
        cases.select("case_id", F.explode("phases").alias("phase"))
        .select("case_id", F.col("phase.phase_number"), F.posexplode("phase.imaging_results").alias("study_pos", "s"))
        .select("case_id", "phase_number", "study_pos", "s.*")
    )


def _literal_map(table: Mapping[str, list[str]]) -> Column:
    return F.create_map(
        *[x for key, items in table.items() for x in (F.lit(key), F.array(*[F.lit(i) for i in items]))]
    )


_NO_WORD = r"[^\p{L}\p{N}]+"


def check_imaging_terms(
    studies: DataFrame, terms: Mapping[str, Mapping[str, list[str]]] = IMAGING_TERMS
) -> DataFrame:
    """Terms in a study's findings that belong to other modalities only, as whole words."""
    own = {m: {t for listed in groups.values() for t in listed} for m, groups in terms.items()}
    foreign = {m: sorted(set().union(*own.values()) - own[m]) for m in own}
    text = F.lower(
        F.array_join(
            F.transform("findings", lambda f: F.concat_ws(" ", f["structure"], f["observation"])), "\n"
        )
    )
    # words on both sides are set apart by one space, so a term is never found inside a word
    words = F.concat(F.lit(" "), F.regexp_replace(text, _NO_WORD, " "), F.lit(" "))

    def listed(names: list[str]) -> Column:
        spaced = [re.sub(r"[\W_]+", " ", f" {t.lower()} ") for t in names]
        return F.array(*[F.struct(F.lit(t).alias("term"), F.lit(w).alias("words")) for t, w in zip(names, spaced)])

    table = F.create_map(*[x for m, names in foreign.items() if names for x in (F.lit(m), listed(names))])[F.col("modality")]
    # the text is an element of an array of its own, so it is made once and not for each term
    used = F.flatten(F.transform(F.array(words), lambda w: F.filter(table, lambda t: F.contains(w, t["words"]))))
    used = F.transform(used, lambda t: t["term"])
    return studies.select(
        "case_id", "phase_number", "study_pos", "modality", F.explode(used).alias("foreign_term")
    )


def check_body_region(
    studies: DataFrame, regions: Mapping[str, list[str]] = IMAGING_BODY_REGIONS
) -> DataFrame:
    """Studies of an unknown modality, or of a body region their modality does not have."""
    allowed = _literal_map(regions)[F.col("modality")]
    issue = F.when(allowed.isNull(), F.lit("unknown modality")).when(
        ~F.array_contains(allowed, F.col("body_region")), F.lit("invalid body region")
    )
    return (
        studies.withColumn("issue", issue)
        .where("issue is not null")
        .select("case_id", "phase_number", "study_pos", "modality", "body_region", "issue")
    )


# --- case shape --------------------------------------------------------------------


def _size(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0))


def check_one_optimal(cases: DataFrame) -> DataFrame:
    """Phases that do not have exactly one optimal decision."""
    return (
        cases.select("case_id", F.explode("phases").alias("phase"))
        .select(
            "case_id",
            F.col("phase.phase_number"),
            _size(F.filter("phase.decisions", lambda d: d["is_optimal"])).alias("optimal"),
        )
        .where("optimal <> 1")
    )


def check_difficulty_shape(cases: DataFrame, rules: Mapping[str, Mapping] = DIFFICULTY_RULES) -> DataFrame:
    """Per case whether its phase count and every phase's decision count fit its difficulty."""

    def bound(of) -> Column:
        return F.create_map(*[F.lit(x) for level, rule in rules.items() for x in (level, of(rule))])[F.col("difficulty")]

    def decisions_range(rule: Mapping, end: int) -> int:
        return int(rule["decisions_per_phase"].split("-")[end])

    low, high = bound(lambda r: decisions_range(r, 0)), bound(lambda r: decisions_range(r, 1))
    phases = _size(F.col("phases"))
    off = F.filter("phases", lambda p: ~_size(p["decisions"]).between(low, high))
    return cases.select(
        "case_id",
        "difficulty",
        low.isNotNull().alias("known_difficulty"),
        phases.alias("phase_count"),
        phases.between(bound(lambda r: r["phase_count_min"]), bound(lambda r: r["phase_count_max"])).alias("phases_fit"),
        _size(off).alias("phases_off"),
    )


def score_gate(cases: DataFrame, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Whether all three review scores are there and reach the threshold, beside the reviewer's own decision."""
    r = F.col("review")
    scores = [r["accuracy_score"], r["pedagogy_score"], r["bias_score"]]
    lowest = F.least(*scores)
    whole = scores[0].isNotNull() & scores[1].isNotNull() & scores[2].isNotNull()
    return cases.where(r.isNotNull()).select(
        "case_id",
        lowest.alias("lowest_score"),
        (F.coalesce(lowest >= threshold, F.lit(False)) & whole).alias("passes"),
        r["approved"].alias("approved"),
    )


def _with_previous(cases: DataFrame, build) -> DataFrame:
    """One row per phase, built from the phase and the one before it (null for the first)."""
    before = F.col("phases")
    pairs = F.transform("phases", lambda p, i: build(p, F.get(before, i - 1)))
    return cases.select("case_id", F.explode(pairs).alias("x")).select("case_id", "x.*")


def check_offset_order(cases: DataFrame) -> DataFrame:
    """Phases whose time cannot be read, or is before the last one that can."""
    rows = cases.withColumn("_minutes", F.transform("phases", lambda p: offset_minutes(p["time_offset"])))

    def row(phase: Column, i: Column) -> Column:
        read = F.array_compact(F.slice("_minutes", F.lit(1), i))
        return F.struct(
            phase["phase_number"].alias("phase_number"),
            F.get("_minutes", i).alias("minutes"),
            F.try_element_at(read, F.lit(-1)).alias("previous_minutes"),
        )

    pairs = rows.select("case_id", F.explode(F.transform("phases", row)).alias("x")).select("case_id", "x.*")
    return pairs.where("minutes is null or minutes < previous_minutes")


VITALS = ("hr", "bp_systolic", "bp_diastolic", "rr", "spo2", "temp_c", "gcs")


def vitals_delta(cases: DataFrame, limits: Mapping[str, float] | None = None) -> DataFrame:
    """Change of each vital sign from the phase before; with ``limits`` only rows where one is passed."""

    def row(phase: Column, previous: Column) -> Column:
        changes = [
            (phase["vitals"][name].cast("double") - previous["vitals"][name].cast("double")).alias(f"{name}_delta")
            for name in VITALS
        ]
        return F.struct(phase["phase_number"].alias("phase_number"), *changes)

    deltas = _with_previous(cases, row)
    if not limits:
        return deltas
    over = F.lit(False)
    for name, limit in limits.items():
        over = over | F.coalesce(F.abs(F.col(f"{name}_delta")) > limit, F.lit(False))
    return deltas.where(over)


def check_repeat_action(cases: DataFrame) -> DataFrame:
    """Actions offered in a phase that were the optimal action of an earlier phase, by exact text."""
    phases = F.col("phases")

    def offered_again(phase: Column, i: Column) -> Column:
        earlier = F.slice(phases, 1, i)
        done = F.flatten(
            F.transform(
                earlier,
                lambda p: F.transform(F.filter(p["decisions"], lambda d: d["is_optimal"]), lambda d: d["action"]),
            )
        )
        offered = F.array_distinct(F.transform(phase["decisions"], lambda d: d["action"]))
        return F.transform(
            F.array_intersect(offered, done),
            lambda a: F.struct(phase["phase_number"].alias("phase_number"), a.alias("action")),
        )

    found = F.flatten(F.transform(phases, offered_again))
    return cases.select("case_id", F.explode(found).alias("x")).select("case_id", "x.*")
