"""Clinical trial records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions.text import has_text, text_or_empty
from wardloom.sources.base import Source, document, parsed_json

_OUTCOMES = "array<struct<measure string, timeFrame string>>"
_STUDY = (
    "protocolSection struct<"
    "identificationModule struct<nctId string, briefTitle string, officialTitle string>, "
    "statusModule struct<overallStatus string>, "
    "eligibilityModule struct<eligibilityCriteria string, sex string, minimumAge string, maximumAge string>, "
    "armsInterventionsModule struct<interventions array<struct<type string, name string, description string>>>, "
    f"outcomesModule struct<primaryOutcomes {_OUTCOMES}, secondaryOutcomes {_OUTCOMES}>, "
    "designModule struct<studyType string, phases array<string>>>"
)


def _listed(title: str, items: Column, line) -> Column:
    """A titled list, null when there is nothing to list."""
    lines = F.array_join(F.transform(items, line), "\n")
    return F.when(F.size(F.coalesce(items, F.array())) > 0, F.concat(F.lit(f"{title}:\n"), lines))


def _outcome(o: Column) -> Column:
    return F.concat(
        F.lit("- "), text_or_empty(o["measure"]), F.lit(" ("), text_or_empty(o["timeFrame"]), F.lit(")")
    )


def _intervention(i: Column) -> Column:
    return F.concat(
        F.lit("- "), text_or_empty(i["type"]), F.lit(": "), text_or_empty(i["name"]),
        F.lit(" — "), text_or_empty(i["description"]),
    )


def _trial_rows(studies: DataFrame) -> DataFrame:
    p = F.col("study.protocolSection")
    ident, eligible = p["identificationModule"], p["eligibilityModule"]
    nct_id = text_or_empty(ident["nctId"])
    title = F.when(has_text(ident["briefTitle"]), ident["briefTitle"]).otherwise(
        text_or_empty(ident["officialTitle"])
    )
    low, high = text_or_empty(eligible["minimumAge"]), text_or_empty(eligible["maximumAge"])
    ages = F.when(
        (low != "") | (high != ""), F.concat(F.lit(" (Age: "), low, F.lit(" - "), high, F.lit(")"))
    ).otherwise(F.lit(""))
    criteria = eligible["eligibilityCriteria"]
    phases = p["designModule"]["phases"]
    interventions = p["armsInterventionsModule"]["interventions"]
    outcomes = p["outcomesModule"]
    parts = [
        F.concat(F.lit("Title: "), title),
        F.concat(F.lit("NCT ID: "), nct_id),
        F.concat(F.lit("Status: "), F.coalesce(p["statusModule"]["overallStatus"], F.lit("Unknown"))),
        F.when(F.size(phases) > 0, F.concat(F.lit("Phase: "), F.array_join(phases, ", "))),
        F.when(has_text(criteria), F.concat(F.lit("Eligibility"), ages, F.lit(":\n"), criteria)),
        F.when(interventions.isNotNull(), _listed("Interventions", interventions, _intervention)),
        F.when(
            outcomes["primaryOutcomes"].isNotNull(),
            _listed("Primary Outcomes", outcomes["primaryOutcomes"], _outcome),
        ),
        F.when(
            outcomes["secondaryOutcomes"].isNotNull(),
            _listed("Secondary Outcomes", outcomes["secondaryOutcomes"], _outcome),
        ),
    ]
    return studies.select(
        *document(
            "clinicaltrials",
            nct_id,
            title,
            F.concat_ws("\n\n", *parts),
            "trial_protocol",
            "peer_reviewed",
            url=F.concat(F.lit("https://clinicaltrials.gov/study/"), nct_id),
        )
    )


TRIALS = Source(
    "clinicaltrials",
    lambda payload: parsed_json(payload, f"studies array<struct<{_STUDY}>>"),
    lambda parsed: _trial_rows(parsed.select(F.explode("parsed.studies").alias("study"))),
)


def normalize_studies(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Answers to asking for one trial: the study object itself."""
    study = F.from_json(F.col(payload), _STUDY)
    return _trial_rows(landed.select(study.alias("study")).where("study is not null"))
