"""Learner-answer grading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grade_choices(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Grade ``answers`` (answer_id, case_id, chosen), every one of them.

    An answer to a case that is not there has the verdict ``unknown case``, one outside the case's tree ``unknown choice``.
    Answers to a case are first cut to its distinct choices, so each case's tree is met once per choice
    however many learners answered; the graded choices then go back to the answers. Of that last join
    adaptive execution splits the part of a case that many learners answered.
    """
    tree = F.col("decision_tree")
    chosen = F.get(tree, F.col("chosen"))
    correct = F.try_element_at(F.filter(tree, lambda d: d["is_correct"]), F.lit(1))
    graded = (
        answers.select("case_id", "chosen")
        .distinct()
        .join(cases.select("case_id", "decision_tree", F.lit(True).alias("known")), "case_id", "left")
        .select(
            "case_id",
            "chosen",
            chosen["choice"].alias("choice"),
            chosen["is_correct"].alias("is_correct"),
            chosen["error_type"].alias("error_type"),
            F.when(F.col("known").isNull(), F.lit("unknown case"))
            .when(chosen.isNull(), F.lit("unknown choice"))
            .when(chosen["is_correct"], F.lit("Correct!"))
            .when(chosen["error_type"] == "catastrophic", F.lit("Catastrophic Error"))
            .otherwise(F.lit("Incorrect"))
            .alias("verdict"),
            chosen["outcome"].alias("outcome"),
            chosen["reasoning"].alias("reasoning"),
            chosen["consequence"].alias("consequence"),
            F.when(~chosen["is_correct"], correct["choice"]).alias("correct_choice"),
        )
    )
    verdicts = answers.join(graded, ["case_id", "chosen"], "left")
    # answers without a case or a choice meet nothing
    lost = F.when(F.col("case_id").isNull(), "unknown case").otherwise("unknown choice")
    return verdicts.withColumn("verdict", F.coalesce("verdict", lost))


def decision_classes(cases: DataFrame) -> DataFrame:
    """Every choice of every decision tree with its class."""
    choice = F.col("c")
    kind = (
        F.when(choice["is_correct"], F.lit("correct"))
        .when(choice["error_type"] == "catastrophic", F.lit("catastrophic"))
        .otherwise(F.lit("other"))
    )
    return cases.select("case_id", F.posexplode("decision_tree").alias("position", "c")).select(
        "case_id", "position", choice["choice"].alias("choice"), kind.alias("class"), choice["outcome"].alias("outcome")
    )
