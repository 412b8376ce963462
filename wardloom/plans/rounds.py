"""Batch generation in rounds.

All slots of a batch go through one stage together. Requests and responses of every stage are written to
the shared work folder and read back, so each stage starts from files: plans stay short and a lost
executor repeats one stage's tasks, not the model calls before them. The driver only counts rounds.
Answers come from a model or from recordings (``replay``).

A slot is one case to make: slot_id, slot_seq (its place in the batch), topic, difficulty.
Contexts are one row per topic: topic, context, sources.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardloom.functions.text import strings
from wardloom.plans import replay
from wardloom.plans import requests as req
from wardloom.plans.calls import ModelFn, answered
from wardloom.plans.running import running_sum
from wardloom.reference_data import (
    CONSISTENCY_NOTE_PREFIX,
    DIFFICULTY_RULES,
    MAX_RERENDER_PASSES,
    MAX_ROUNDS,
    MULTI_STEP_DECISION_PROMPT,
    NO_PHASES_NOTE,
    REVIEW_THRESHOLD,
)
from wardloom.schemas import CASE, CASE_METADATA, fields, INT, LONG, TEXT
from wardloom.session import work_path
from wardloom.tables import latest_per_key

SLOT = ("slot_id", "slot_seq", "topic", "difficulty")
CALL = fields(slot_id=TEXT, stage=TEXT, round=INT, call=INT, input_tokens=LONG, output_tokens=LONG)


@dataclass
class Job:
    """Where a batch works and what it calls.

    ``answers`` is where the model's answers are kept; a job that is given the folder of an earlier one calls the model
    for nothing that is answered there. With ``recorded`` no model is called.
    """

    spark: SparkSession
    model: ModelFn | None
    as_of: str
    max_rounds: int = MAX_ROUNDS
    threshold: float = REVIEW_THRESHOLD
    folder: str = ""
    calls_per_task: int | None = None
    answers: str = ""
    recorded: DataFrame | None = None
    contexts: DataFrame | None = None
    calls: list[DataFrame] = field(default_factory=list)
    rejected: list[DataFrame] = field(default_factory=list)
    _step: int = 0

    def __post_init__(self) -> None:
        self.folder = self.folder or work_path(self.spark, "generation")
        self.answers = self.answers or f"{self.folder}/answers"
        if (self.model is None) == (self.recorded is None):
            raise ValueError("a job needs a model or recordings")
        if self.recorded is not None:
            path = f"{self.folder}/recorded"
            self.recorded.select(*replay.RECORDED.names).write.partitionBy("stage").parquet(path)
            self.recorded = self.spark.read.schema(replay.RECORDED).parquet(path)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """The rows written to the work folder and read from there."""
        self._step += 1
        path = f"{self.folder}/{self._step:04d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def ask(self, requests: DataFrame, stage: str, *keep: str) -> DataFrame:
        """Valid answers with slot, round and ``keep`` columns; unreadable ones are set aside."""
        asked = self.stored(requests, "requests")
        if self.recorded is not None:
            answers = replay.as_of(asked, self.recorded.where(F.col("stage") == stage))
        else:
            answers = answered(asked, self.model, f"{self.answers}/{stage}", self.calls_per_task)
        once = latest_per_key(answers, "request_id", [F.col("model"), F.col("payload")])
        # the answers with their places are written once; calls, valid and bad answers are read from there
        placed = asked.select("request_id", "slot_id", "stage", "round", *keep).join(once, "request_id")
        placed = self.stored(placed, "answers")
        call = F.lit(self._step)
        self.calls.append(
            placed.select("slot_id", "stage", "round", call.alias("call"), "input_tokens", "output_tokens")
        )
        valid, bad = req.parse_responses(placed, "phase" if stage == "phase_renderer" else stage)
        self.rejected.append(bad.select("request_id", "slot_id", "stage", "round", "payload"))
        return valid

    def with_context(self, slots: DataFrame, *columns: str) -> DataFrame:
        """Slots with ``context`` or ``sources`` of their topic. Contexts are kept by topic and joined where they are read."""
        found = slots.join(self.contexts.select("topic", *columns), "topic", "left")
        if "sources" in columns:
            found = found.withColumn("sources", F.coalesce("sources", F.array().cast(CASE["sources"].dataType)))
        return found

    def all_calls(self) -> DataFrame:
        return _union(self.calls) if self.calls else self.spark.createDataFrame([], CALL)


@dataclass
class Generated:
    """Result of a batch: finished cases, failed slots, calls made, and unreadable answers."""

    cases: DataFrame
    failed: DataFrame
    calls: DataFrame
    rejected: DataFrame
    summary: DataFrame


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def case_id(slot_id: Column) -> Column:
    """A stable id, so that a repeated batch replaces its cases and does not double them."""
    return F.sha2(F.concat(F.lit("case|"), slot_id), 256)


def open_slots(slots: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slots with the context of their topic, and those whose difficulty no case can have."""
    known = F.col("difficulty").isin(list(DIFFICULTY_RULES))
    joined = slots.where(known).join(contexts, "topic", "left").withColumn(
        "sources", F.coalesce("sources", F.array().cast(CASE["sources"].dataType))
    )
    return joined.select(*SLOT, "context", "sources").withColumn("notes", strings(F.lit(None))), slots.where(~known)


def make_slots(topics: DataFrame, count: int, difficulty: str = "resident") -> DataFrame:
    """``count`` slots for each row of ``topics`` (topic and, if there, difficulty), numbered without gaps in topic order.

    The number of a slot follows from its topic's rank and its place, so no list of slots is ordered.
    """
    wanted = topics.select("topic", (F.col("difficulty") if "difficulty" in topics.columns else F.lit(difficulty)).alias("difficulty")).distinct()
    ranked = wanted.withColumn("_rank", F.row_number().over(Window.orderBy("topic", "difficulty")) - 1)
    made = ranked.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count > 0 else ranked.withColumn("_n", F.lit(0)).where("false")
    number = (F.col("_rank").cast("long") * count + F.col("_n")).alias("slot_seq")
    return made.select(F.concat_ws("|", "topic", "difficulty", F.col("_n").cast("string")).alias("slot_id"), number, "topic", "difficulty")


# --- assembly ----------------------------------------------------------------------


def _metadata(as_of: str, model: Column, multi_step: bool | None) -> Column:
    return F.struct(
        F.lit(as_of).alias("generated_at"),
        model.alias("model"),
        F.col("round").cast("int").alias("retry_count"),
        F.lit(0).cast("long").alias("total_input_tokens"),
        F.lit(0).cast("long").alias("total_output_tokens"),
        F.lit(multi_step).cast("boolean").alias("multi_step"),
    )


def _case(rows: DataFrame, parts: dict[str, Column], *keep: str) -> DataFrame:
    made = {f.name: parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CASE.fields}
    return rows.select(*keep, F.struct(*made.values()).alias("case"))


_KEEP = (*SLOT, "notes", "round")


def assemble_single(rows: DataFrame, as_of: str) -> DataFrame:
    """Cases of rows with the writer's answer, its model and the tree: slot, writer, writer_model, tree."""
    w = F.col("writer")
    return _case(
        rows,
        {
            "case_id": case_id(F.col("slot_id")),
            "topic": F.col("topic"),
            "difficulty": F.col("difficulty"),
            "specialty": w["specialty"],
            "patient": w["patient"],
            "vignette": w["vignette"],
            "decision_prompt": w["decision_prompt"],
            "ground_truth": w["ground_truth"],
            "decision_tree": F.col("tree.decision_tree"),
            "complications": F.col("tree.complications"),
            "phases": F.array(),
            "sources": F.col("sources"),
            "metadata": _metadata(as_of, F.col("writer_model"), None),
        },
        *_KEEP,
    )


def collect_phases(phases: DataFrame) -> DataFrame:
    """Phases of every slot as one array in plan order, with the model of the first."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "phase", "model")))
    return phases.groupBy("slot_id").agg(listed.alias("_listed")).select(
        "slot_id",
        F.transform("_listed", lambda x: x["phase"]).alias("phases"),
        F.get("_listed", 0)["model"].alias("phase_model"),
    )


def assemble_multi(rows: DataFrame, as_of: str) -> DataFrame:
    """Cases of rows with a plan and its phases in plan order: slot, plan, phases, phase_model."""
    plan = F.col("plan")
    first = F.get(plan["blueprint"]["phases"], 0)
    truth = F.struct(
        plan["blueprint"]["diagnosis"].alias("diagnosis"),
        first["correct_action"].alias("optimal_next_step"),
        first["key_reasoning"].alias("rationale"),
        strings(F.lit(None)).alias("key_findings"),
    )
    return _case(
        rows,
        {
            "case_id": case_id(F.col("slot_id")),
            "topic": F.col("topic"),
            "difficulty": F.col("difficulty"),
            "specialty": plan["specialty"],
            "patient": plan["patient"],
            "vignette": F.array_join(F.transform("phases", lambda p: p["narrative"]), "\n\n"),
            "decision_prompt": F.lit(MULTI_STEP_DECISION_PROMPT),
            "ground_truth": truth,
            "decision_tree": F.array(),
            "complications": F.array(),
            "blueprint": plan["blueprint"],
            "phases": F.col("phases"),
            "sources": F.col("sources"),
            "metadata": _metadata(as_of, F.col("phase_model"), True),
        },
        *_KEEP,
    )


# --- gates -------------------------------------------------------------------------


def review_gate(cases: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved, pending): cases the reviewer approved, and the others with its notes for the next round.

    The reviewer's own decision counts, not its scores. A case without a readable review stays pending.
    """
    joined = cases.join(reviews.select("slot_id", F.col("data").alias("review")), "slot_id", "left")
    joined = joined.withColumn("case", F.col("case").withField("review", F.col("review")))
    ok = F.coalesce(F.col("review.approved"), F.lit(False))
    notes = F.when(F.col("review").isNotNull(), strings(F.col("review.notes"))).otherwise(F.col("notes"))
    return joined.where(ok).drop("review"), joined.where(~ok).withColumn("notes", notes).drop("review")


def reject_empty_blueprints(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans with phases, slots whose plan has none with the note saying so)."""
    count = F.coalesce(F.size("plan.blueprint.phases"), F.lit(0))
    empty = plans.where(count == 0).withColumn("notes", F.array(F.lit(NO_PHASES_NOTE)))
    return plans.where(count > 0), empty


def affected_phases(plans: DataFrame, issues: DataFrame) -> DataFrame:
    """Planned phases that consistency issues name; of several with one number the last place."""
    named = issues.select("slot_id", F.explode("issues.phase_number").alias("phase_number")).distinct()
    planned = plans.select("*", F.posexplode("plan.blueprint.phases").alias("pos", "planned"))
    planned = planned.withColumn("phase_number", F.col("planned.phase_number"))
    last = Window.partitionBy("slot_id", "phase_number").orderBy(F.desc("pos"))
    chosen = planned.join(named, ["slot_id", "phase_number"], "left_semi")
    return chosen.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "phase_number")


def rerender(phases: DataFrame, new_phases: DataFrame) -> DataFrame:
    """Phases with the newly written ones in place of the old."""
    kept = phases.join(new_phases.select("slot_id", "pos"), ["slot_id", "pos"], "left_anti")
    return kept.unionByName(new_phases.select(*phases.columns))


def _next(pending: DataFrame, done: DataFrame, noted: list[DataFrame]) -> DataFrame:
    """Slots not done yet, with new notes where a gate has given some."""
    left = pending.join(done.select("slot_id"), "slot_id", "left_anti")
    notes = _union([n.select("slot_id", F.col("notes").alias("_notes")) for n in noted])
    joined = left.join(notes, "slot_id", "left").withColumn("notes", F.coalesce("_notes", "notes"))
    return joined.select(*SLOT, "notes")


# --- batches -----------------------------------------------------------------------


def plan_rounds(job: Job, pending: DataFrame) -> DataFrame:
    """Approved plans of the pending slots (which have notes and round).

    Notes start as the slot's and are replaced by each rejection; the slot itself keeps its own.
    """
    approved: list[DataFrame] = []
    open_ = pending
    for number in range(job.max_rounds):
        asked = open_.withColumn("plan_round", F.lit(number))
        answers = job.ask(req.plan_requests(job.with_context(asked, "context")), "planner")
        plans = job.stored(asked.join(answers.select("slot_id", F.col("data").alias("plan")), "slot_id"), "plans")
        verdicts = job.ask(req.blueprint_review_requests(job.with_context(plans, "context")), "blueprint_review")
        verdicts = verdicts.select("slot_id", F.col("data").alias("verdict"))
        judged = job.stored(plans.join(verdicts, "slot_id"), "judged")
        good = judged.where("verdict.approved")
        approved.append(good.drop("verdict", "plan_round"))
        left = open_.join(good.select("slot_id"), "slot_id", "left_anti")
        said = judged.select("slot_id", strings(F.col("verdict.notes")).alias("_notes"))
        open_ = job.stored(
            left.join(said, "slot_id", "left").withColumn("notes", F.coalesce("_notes", "notes")).drop("_notes"), "unplanned"
        )
        if open_.isEmpty():
            break
    outer = pending.select("slot_id", F.col("notes").alias("_outer"))
    plans = _union(approved).join(outer, "slot_id")
    return plans.withColumn("notes", F.col("_outer")).drop("_outer")


def _single_round(job: Job, pending: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    writer = job.ask(req.case_requests(job.with_context(pending, "context")), "case_writer")
    written = pending.join(
        writer.select("slot_id", F.col("data").alias("writer"), F.col("model").alias("writer_model")), "slot_id"
    )
    written = job.stored(written, "written")
    trees = job.ask(req.tree_requests(job.with_context(written, "context")), "decision_tree")
    whole = written.join(trees.select("slot_id", F.col("data").alias("tree")), "slot_id")
    cases = assemble_single(job.with_context(whole, "sources"), job.as_of)
    return _reviewed(job, cases)


def _reviewed(job: Job, cases: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    cases = job.stored(cases, "cases")
    reviews = job.ask(req.review_requests(job.with_context(cases, "context"), job.threshold), "review")
    approved, pending = review_gate(cases, reviews)
    return approved, [pending]


def _checked(job: Job, phases: DataFrame, check_pass: int) -> DataFrame:
    asked = req.consistency_requests(phases.withColumn("check_pass", F.lit(check_pass)))
    answers = job.ask(asked, "consistency", "check_pass")
    return job.stored(answers.select("slot_id", F.col("data.issues").alias("issues")), "issues")


def _multi_round(job: Job, pending: DataFrame, lab_context: str) -> tuple[DataFrame, list[DataFrame]]:
    plans, no_phases = reject_empty_blueprints(job.stored(plan_rounds(job, pending), "approved-plans"))
    answers = job.ask(req.render_requests(job.with_context(plans, "context"), lab_context), "phase_renderer", "pos")
    columns = ("slot_id", "round", "pos", F.col("data.phase").alias("phase"), "model")
    phases = job.stored(answers.select(*columns), "phases")
    # a slot with an unreadable phase is not complete and is tried again in the next round
    complete = (
        phases.groupBy("slot_id").agg(F.count("*").alias("_have"))
        .join(plans.select("slot_id", F.size("plan.blueprint.phases").alias("_want")), "slot_id")
        .where("_have = _want").select("slot_id")
    )
    phases = phases.join(complete, "slot_id", "left_semi")
    issues = _checked(job, phases, 0)
    for number in range(1, MAX_RERENDER_PASSES + 1):
        open_ = issues.where(F.size("issues") > 0)
        if open_.isEmpty():
            break
        again = affected_phases(plans, open_).withColumn("render_pass", F.lit(number))
        redone = job.ask(req.phase_requests(job.with_context(again, "context"), lab_context), "phase_renderer", "pos").select(*columns)
        phases = job.stored(rerender(phases, redone), "phases")
        rechecked = _checked(job, phases.join(open_.select("slot_id"), "slot_id", "left_semi"), number)
        issues = job.stored(
            issues.join(open_.select("slot_id"), "slot_id", "left_anti").unionByName(rechecked), "issues"
        )
    inconsistent = issues.where(F.size("issues") > 0).select(
        "slot_id",
        F.transform("issues", lambda i: F.concat(F.lit(CONSISTENCY_NOTE_PREFIX), i["issue"])).alias("notes"),
    )
    clean = plans.join(issues.where(F.size("issues") == 0).select("slot_id"), "slot_id", "left_semi")
    cases = assemble_multi(job.with_context(clean.join(collect_phases(phases), "slot_id"), "sources"), job.as_of)
    approved, rejected = _reviewed(job, cases)
    return approved, [*rejected, no_phases, inconsistent]


def _run_rounds(job: Job, slots: DataFrame, contexts: DataFrame, one_round) -> Generated:
    """At most ``max_rounds`` rounds over the slots still open; what is left then has failed."""
    known = F.col("difficulty").isin(list(DIFFICULTY_RULES))
    impossible = slots.where(~F.coalesce(known, F.lit(False)))
    job.contexts = job.stored(contexts.select("topic", "context", "sources"), "contexts")
    pending = job.stored(slots.where(known).select(*SLOT).withColumn("notes", strings(F.lit(None))), "pending")
    done: list[DataFrame] = []
    for number in range(job.max_rounds):
        approved, noted = one_round(job, pending.withColumn("round", F.lit(number)))
        approved = job.stored(approved.select("slot_id", "slot_seq", "case"), "approved")
        done.append(approved)
        pending = job.stored(_next(pending, approved, noted), "pending")
        if pending.isEmpty():
            break
    failed = pending.select("slot_id", "slot_seq", "topic", "difficulty").unionByName(
        impossible.select("slot_id", "slot_seq", "topic", "difficulty")
    )
    calls = job.all_calls()
    cases = with_token_totals(_union(done), slots, calls)
    return Generated(cases, failed, calls, _union(job.rejected), batch_summary(cases, failed, calls))


def generate_single(job: Job, slots: DataFrame, contexts: DataFrame) -> Generated:
    """Single-step cases: write, build the tree, review; rejected slots go round again with the notes."""
    return _run_rounds(job, slots, contexts, _single_round)


def generate_multi(job: Job, slots: DataFrame, contexts: DataFrame, lab_context: str) -> Generated:
    """Multi-step cases: plan, render phases, check and re-render, review."""
    return _run_rounds(job, slots, contexts, lambda j, pending: _multi_round(j, pending, lab_context))


# --- tokens ------------------------------------------------------------------------


def running_tokens(calls: DataFrame, ranges: int = 200) -> DataFrame:
    """Calls with the token totals of the batch up to each; needs slot_seq, round and call."""
    return running_sum(calls, "slot_seq", ("input_tokens", "output_tokens"), ("round", "call", "slot_id"), ranges)


def slot_tokens(slots: DataFrame, calls: DataFrame, ranges: int = 200) -> DataFrame:
    """Token totals of every slot, and of the batch up to and with it."""
    own = calls.groupBy("slot_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    joined = slots.select("slot_id", "slot_seq").join(own, "slot_id", "left").na.fill(0, ["input_tokens", "output_tokens"])
    return running_sum(joined, "slot_seq", ("input_tokens", "output_tokens"), ("slot_id",), ranges)


def with_token_totals(done: DataFrame, slots: DataFrame, calls: DataFrame) -> DataFrame:
    """Finished cases with the totals that stood when each was approved, failed attempts included.

    Slots are made one after the other, so these are the totals up to and with the case's own slot.
    """
    totals = slot_tokens(slots, calls).select("slot_id", "running_input_tokens", "running_output_tokens")
    m = F.col("case.metadata")
    counted = m.withField("total_input_tokens", F.col("running_input_tokens")).withField(
        "total_output_tokens", F.col("running_output_tokens")
    )
    return (
        done.join(totals, "slot_id")
        .withColumn("case", F.col("case").withField("metadata", counted.cast(CASE_METADATA)))
        .select("slot_id", "slot_seq", "case")
    )


def cases_of(generated: DataFrame) -> DataFrame:
    """The plain cases of a batch."""
    return generated.select("case.*")


def batch_summary(done: DataFrame, failed: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: cases generated, slots failed, tokens in and out."""
    zero = F.lit(0).cast("long")
    rows = _union(
        [
            done.select(F.lit(1).alias("generated"), F.lit(0).alias("failed"), zero.alias("input"), zero.alias("output")),
            failed.select(F.lit(0).alias("generated"), F.lit(1).alias("failed"), zero.alias("input"), zero.alias("output")),
            calls.select(
                F.lit(0).alias("generated"), F.lit(0).alias("failed"),
                F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"),
            ),
        ]
    )
    return rows.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (
            ("generated", "generated"), ("failed", "failed"),
            ("input", "total_input_tokens"), ("output", "total_output_tokens"),
        )]
    )
