"""Drug label and drug vocabulary sources."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from wardloom.functions.dates import compact_date
from wardloom.functions.text import has_text, string_array, text_or_empty
from wardloom.reference_data import LOINC_SECTIONS, OPENFDA_SECTIONS
from wardloom.schemas import TEXT, fields
from wardloom.sources.base import Source, document, parsed_json

_LABEL_PAGE = "https://dailymed.nlm.nih.gov/dailymed/drugInfo.cfm?setid="
_DRUG_PAGE = "https://mor.nlm.nih.gov/RxNav/search?searchBy=RXCUI&searchTerm="

# --- OpenFDA -----------------------------------------------------------------


def _first_value(field: Column) -> Column:
    """First entry of a list field, or the field itself where it is a plain text."""
    return F.coalesce(F.get(F.from_json(field, "array<string>"), 0), field)


def _is_filled(field: Column) -> Column:
    return has_text(field) & (field != "[]")


def _openfda_documents(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.explode("parsed.results").alias("label"))
    label = F.col("label")
    brand, generic, maker = (
        text_or_empty(F.get(label["openfda"][name], 0))
        for name in ("brand_name", "generic_name", "manufacturer_name")
    )
    set_id = text_or_empty(label["set_id"])
    title = (
        F.when((brand != "") & (generic != ""), F.concat(brand, F.lit(" ("), generic, F.lit(")")))
        .when(brand != "", brand)
        .when(generic != "", generic)
        .otherwise(set_id)
    )
    sections = [
        F.when(_is_filled(label[field]), F.concat(F.lit(f"{header}\n"), _first_value(label[field])))
        for field, header in OPENFDA_SECTIONS
    ]
    return rows.select(
        *document(
            "openfda",
            set_id,
            title,
            F.concat_ws("\n\n", *sections),
            "drug_label",
            "fda_label",
            authors=F.when(maker != "", string_array(maker)),
            publication_date=compact_date(label["effective_time"]),
            url=F.when(set_id != "", F.concat(F.lit(_LABEL_PAGE), set_id)),
        )
    )


# label fields are kept as text: an answer may hold a list or a single string
OPENFDA = Source(
    "openfda",
    lambda payload: parsed_json(
        payload,
        "results array<struct<set_id string, effective_time string, openfda struct<"
        "brand_name array<string>, generic_name array<string>, manufacturer_name array<string>>, "
        + ", ".join(f"{field} string" for field, _ in OPENFDA_SECTIONS)
        + ">>",
    ),
    _openfda_documents,
)

# --- DailyMed ----------------------------------------------------------------


PAYLOADS_AT_ONCE = 64  # labels whose sections are held as Python texts


def _sections(text: str | None) -> list[tuple[str, str]] | None:
    """``code, text`` of each coded section of a label in document order, at any depth."""
    hl7 = "{urn:hl7-org:v3}"
    if text is None or "<!DOCTYPE" in text or "<!ENTITY" in text:
        return None
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, TypeError, ValueError):
        return None
    found = []
    for section in root.iter(f"{hl7}section"):
        code, body = section.find(f"{hl7}code"), section.find(f"{hl7}text")
        if code is not None and body is not None:
            found.append((code.get("code", ""), "".join(body.itertext()).strip()))
    return found


def _sections_in_pieces(xml: pa.Array) -> pa.Array:
    """Sections of many labels; of a few of them at a time the texts are Python's, the others are held once, as Arrow."""
    kind = pa.list_(pa.struct([("code", pa.string()), ("text", pa.string())]))
    pieces = [pa.array([], kind)]
    for start in range(0, len(xml), PAYLOADS_AT_ONCE):
        found = [_sections(x.as_py()) for x in xml.slice(start, PAYLOADS_AT_ONCE)]
        named = [s if s is None else [{"code": code, "text": text} for code, text in s] for s in found]
        pieces.append(pa.array(named, kind))
    return pa.concat_arrays(pieces)


@F.arrow_udf(ArrayType(fields(code=TEXT, text=TEXT)))
def _label_sections(xml: pa.Array) -> pa.Array:
    """Coded sections of a label in document order, at any depth; null for text that is no XML or declares entities.

    Sections nest without limit and their text is mixed content, which no fixed row schema covers.
    """
    return _sections_in_pieces(xml)


def _dailymed_documents(parsed: DataFrame) -> DataFrame:
    header = F.create_map(*[F.lit(x) for pair in LOINC_SECTIONS.items() for x in pair])
    kept = F.filter(
        "parsed.sections",
        lambda s: (s["text"] != "") & s["code"].isin(list(LOINC_SECTIONS)),
    )
    body = F.transform(kept, lambda s: F.concat(header[s["code"]], F.lit("\n"), s["text"]))
    setid = F.coalesce("setid", "parsed.setid")
    title = F.coalesce("title", "parsed.title")
    return parsed.select(
        *document(
            "dailymed",
            setid,
            title,
            F.array_join(body, "\n\n"),
            "drug_label",
            "fda_label",
            url=F.concat(F.lit(_LABEL_PAGE), text_or_empty(setid)),
        )
    )


def _parse_dailymed(payload: Column) -> Column:
    sections = _label_sections(payload)
    bad = F.when(sections.isNull(), text_or_empty(payload))
    known = bad.isNull()
    # a label names itself: used where a landed row does not
    setid = F.when(known, F.xpath_string(payload, F.lit("/*/*[local-name()='setId']/@root")))
    title = F.when(known, F.trim(F.xpath_string(payload, F.lit("/*/*[local-name()='title']"))))
    return F.struct(sections.alias("sections"), setid.alias("setid"), title.alias("title"), bad.alias("_corrupt_record"))


# landed rows: payload and, from a listing, setid and title
DAILYMED = Source("dailymed", _parse_dailymed, _dailymed_documents, keys=("setid", "title"))


def dailymed_listing(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Label ids and titles of landed listing answers, to be joined with the label files."""
    listing = parsed_json(F.col(payload), "data array<struct<setid string, title string>>")
    return landed.select(F.explode(listing["data"]).alias("item")).select(
        text_or_empty(F.col("item.setid")).alias("setid"), text_or_empty(F.col("item.title")).alias("title")
    )


# --- RxNorm ------------------------------------------------------------------


def _drug(rows: DataFrame, rxcui: Column, name: Column, tty: Column) -> DataFrame:
    rxcui, name, tty = text_or_empty(rxcui), text_or_empty(name), text_or_empty(tty)
    content = F.concat(
        F.lit("Drug: "), name, F.lit("\nRxCUI: "), rxcui, F.lit("\nTerm Type: "), tty
    )
    return rows.select(
        *document(
            "rxnorm", rxcui, name, content, "drug_info", "curated", url=F.concat(F.lit(_DRUG_PAGE), rxcui)
        )
    )


def rxnorm(limit: int | None = None) -> Source:
    """Concepts of each answer in group order: all, or the first ``limit``."""

    def documents(parsed: DataFrame) -> DataFrame:
        groups = F.transform("parsed.drugGroup.conceptGroup", lambda g: g["conceptProperties"])
        concepts = F.flatten(F.array_compact(groups))
        concepts = concepts if limit is None else F.slice(concepts, 1, limit)
        rows = parsed.select(F.explode(concepts).alias("concept"))
        return _drug(rows, F.col("concept.rxcui"), F.col("concept.name"), F.col("concept.tty"))

    return Source(
        "rxnorm",
        lambda payload: parsed_json(
            payload,
            "drugGroup struct<conceptGroup array<struct<tty string, conceptProperties "
            "array<struct<rxcui string, name string, tty string>>>>>",
        ),
        documents,
    )


RXNORM = rxnorm()


def normalize_rxnorm_properties(
    landed: DataFrame, payload: str = "payload", rxcui: str = "rxcui"
) -> DataFrame:
    """Answers to asking for one concept id: a single properties object, keyed by the id asked for."""
    properties = parsed_json(F.col(payload), "properties struct<name string, tty string>")["properties"]
    rows = landed.select(properties.alias("p"), F.col(rxcui).alias("asked"))
    return _drug(rows, F.col("asked"), F.col("p.name"), F.col("p.tty"))
