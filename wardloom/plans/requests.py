"""Request and response tables of the generation stages.

Every stage turns rows that carry ``slot_id``, ``round``, ``topic``, ``difficulty`` and ``context`` into
requests. A model, whatever it is, is a batch function from requests to responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from wardloom.plans import prompts
from wardloom.plans.prompts import Stage, render, retry_prompt
from wardloom.reference_data import DIFFICULTY_RULES, FALLBACK_DIFFICULTY, REVIEW_THRESHOLD
from wardloom.schemas import (
    DEFAULT_EMPTY_FIELDS,
    OPTIONAL_FIELDS,
    RESPONSE_SCHEMAS,
)

BAD = "_corrupt_record"


# --- difficulty --------------------------------------------------------------------


def difficulty_table(spark: SparkSession) -> DataFrame:
    names = list(next(iter(DIFFICULTY_RULES.values())))
    rows = [(level, *rule.values()) for level, rule in DIFFICULTY_RULES.items()]
    kinds = ", ".join(f"{n} {'int' if n.startswith('phase_count') else 'string'}" for n in names)
    return spark.createDataFrame(rows, f"difficulty string, {kinds}")


def difficulty_rules(topics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with the rules of their level, those of the fallback level where it is unknown.

    ``valid_difficulty`` tells whether a case may be made at all: its own level must be a known one.
    """
    columns = [c for c in rules.columns if c != "difficulty"]
    packed = F.broadcast(rules.select("difficulty", F.struct(*columns).alias("own")))
    fallback = F.broadcast(
        rules.where(F.col("difficulty") == FALLBACK_DIFFICULTY).select(F.struct(*columns).alias("fallback"), F.lit(1).alias("_one"))
    )
    # both sides are the fixed three-row table
    joined = topics.withColumn("_one", F.lit(1)).join(packed, "difficulty", "left").join(fallback, "_one", "left")
    chosen = F.coalesce("own", "fallback")
    return joined.select(
        *topics.columns, F.col("own").isNotNull().alias("valid_difficulty"), *[chosen[c].alias(c) for c in columns]
    )


# --- requests ----------------------------------------------------------------------


def request_id(stage: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(stage), *[p.cast("string") for p in parts]), 256)


def _requests(rows: DataFrame, stage: Stage, prompt: Column, *parts: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Requests with the slot and round they belong to, and the ``keep`` columns needed to place answers."""
    return rows.select(
        request_id(stage.name, F.col("slot_id"), F.col("round"), *[F.col(p) for p in parts]).alias("request_id"),
        "slot_id",
        F.lit(stage.name).alias("stage"),
        F.col("round").cast("int").alias("round"),
        F.lit(stage.system).alias("system"),
        prompt.alias("prompt"),
        F.lit(stage.schema_name).alias("schema_name"),
        *keep,
    )


def _json(value: Column | str) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def case_requests(slots: DataFrame, stage: Stage = prompts.CASE_WRITER) -> DataFrame:
    return _requests(slots, stage, retry_prompt(render(stage.prompt), F.col("notes")))


def tree_requests(written: DataFrame, stage: Stage = prompts.DECISION_TREE) -> DataFrame:
    """``written`` has the writer's answer in ``writer``. The same notes as the writer's are repeated."""
    prompt = render(stage.prompt, vignette=F.col("writer.vignette"), ground_truth=_json("writer.ground_truth"))
    return _requests(written, stage, retry_prompt(prompt, F.col("notes")))


def review_requests(
    cases: DataFrame, threshold: float = REVIEW_THRESHOLD, stage: Stage = prompts.REVIEW
) -> DataFrame:
    """``cases`` has the whole case in ``case``."""
    prompt = render(stage.prompt, case_json=_json("case"), threshold=F.lit(str(threshold)))
    return _requests(cases, stage, prompt)


def plan_requests(slots: DataFrame, stage: Stage = prompts.PLANNER) -> DataFrame:
    prompt = retry_prompt(render(stage.prompt), F.col("notes"))
    return _requests(slots, stage, prompt, "plan_round", keep=("plan_round",))


def blueprint_review_requests(plans: DataFrame, stage: Stage = prompts.BLUEPRINT_REVIEW) -> DataFrame:
    """``plans`` has the planner's answer in ``plan``."""
    prompt = render(stage.prompt, blueprint_json=_json("plan.blueprint"))
    return _requests(plans, stage, prompt, "plan_round", keep=("plan_round",))


def render_requests(plans: DataFrame, lab_context: str, stage: Stage = prompts.PHASE_RENDERER) -> DataFrame:
    """One request per planned phase; ``pos`` is its place in the plan."""
    rows = plans.select("*", F.posexplode("plan.blueprint.phases").alias("pos", "planned"))
    return phase_requests(rows, lab_context, stage)


def phase_requests(rows: DataFrame, lab_context: str, stage: Stage = prompts.PHASE_RENDERER) -> DataFrame:
    """Requests for rows that hold a planned phase in ``planned``; ``render_pass`` is 0 if absent."""
    if "render_pass" not in rows.columns:
        rows = rows.withColumn("render_pass", F.lit(0))
    prompt = render(
        stage.prompt,
        blueprint_json=_json("plan.blueprint"),
        phase_json=_json("planned"),
        lab_context=F.lit(lab_context),
    )
    return _requests(rows, stage, prompt, "pos", "render_pass", keep=("pos", "render_pass"))


def consistency_requests(phases: DataFrame, stage: Stage = prompts.CONSISTENCY) -> DataFrame:
    """One request per slot over all its phases; ``phases`` has slot_id, round, pos, phase, check_pass."""
    grouped = phases.groupBy("slot_id", "round", "check_pass").agg(
        F.array_sort(F.collect_list(F.struct("pos", "phase"))).alias("listed")
    )
    listed = grouped.withColumn("phases_json", _json(F.transform("listed", lambda x: x["phase"])))
    return _requests(listed, stage, render(stage.prompt), "check_pass", keep=("check_pass",))


# --- answers -----------------------------------------------------------------------


def _complete(value: Column, kind: DataType) -> Column:
    """Whether a parsed value has all its required parts, at every depth."""
    if isinstance(kind, StructType):
        whole = F.lit(True)
        for field in kind.fields:
            part = value[field.name]
            inner = _complete(part, field.dataType)
            if field.name in OPTIONAL_FIELDS or field.name in DEFAULT_EMPTY_FIELDS:
                whole = whole & (part.isNull() | inner)
            else:
                whole = whole & part.isNotNull() & inner
        return whole
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.forall(value, lambda item: item.isNotNull() & _complete(item, kind.elementType))
    return F.lit(True)


def judged_responses(responses: DataFrame, schema_name: str) -> DataFrame:
    """All answers of one schema, read once: ``valid`` tells whether an answer is readable and whole, ``data`` is then the parsed one."""
    schema = RESPONSE_SCHEMAS[schema_name]
    with_bad = StructType([*schema.fields, StructField(BAD, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    # the parsed answer is generated as a row: a filter over it is not pushed below, where it would parse once per part it asks for
    parsed = responses.select("*", F.explode(F.array(F.from_json("payload", with_bad, options))).alias("_parsed"))
    data = F.struct(*[F.col("_parsed")[f.name].alias(f.name) for f in schema.fields])
    good = F.coalesce(
        F.col("_parsed").isNotNull() & F.col("_parsed")[BAD].isNull() & _complete(F.col("_parsed"), schema), F.lit(False)
    )
    checked = parsed.select("*", F.explode(F.array(good)).alias("valid"))
    return checked.withColumn("data", F.when(F.col("valid"), data)).drop("_parsed")


def parse_responses(responses: DataFrame, schema_name: str) -> tuple[DataFrame, DataFrame]:
    """Answers of one schema, split into (valid, rejected). ``valid`` has the parsed answer in ``data``.

    Who needs both reads each answer twice, by way of ``judged_responses`` once.
    """
    judged = judged_responses(responses, schema_name)
    return judged.where("valid").drop("valid", "payload"), judged.where("not valid").drop("valid", "data")
