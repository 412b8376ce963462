"""The driver's tables as tables of ours. Every mapping here is repeated in SQL in ``checks/oracles.py``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.text import first_line, string_array
from wardloom.operators.chunking import document_key
from wardloom.reference_data import DRUG_LABEL_HEADERS, LAB_PANELS, TRIAL_HEADERS
from wardloom.schemas import CASE, METADATA

CONTENT_TYPES = ["abstract", "full_text", "drug_label", "trial_protocol"]
CREDIBILITIES = ["guideline", "fda_label", "peer_reviewed", "curated", "preprint"]
LEVELS = ["medical_student", "resident", "attending"]
QUALITIES = ["optimal", "acceptable", "suboptimal", "harmful", "catastrophic", "other"]
MODALITIES = ["CT", "MRI", "XR", "US", "CTA", "PET"]
REGIONS = ["head", "chest", "abdomen", "brain", "cardiac", "spine"]
OBSERVATIONS = ["hyperdense mass", "Hyperintense lesion", "focal opacity", "free fluid", "filling defect", "headcount normal"]


def spread(df: DataFrame) -> DataFrame:
    """The driver's files have one split each; their rows are dealt to all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream of its file."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


def pick(items: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(i) for i in items]), index.cast("int"))


def pick_column(columns: list[Column], index: Column) -> Column:
    return F.get(F.array(*columns), index.cast("int"))


def _sectioned(text: Column, headers: list[str]) -> Column:
    """Text with a header line put before every fifth line from the third on."""

    def line(value: Column, i: Column) -> Column:
        header = pick(headers, (i / 5).cast("int") % len(headers))
        return F.when(i % 5 == 2, F.concat(header, F.lit("\n"), value)).otherwise(value)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(spread(table(spark, sf_dir, "documents")))


def as_documents(rows: DataFrame) -> DataFrame:
    doc, text = F.col("doc_id"), F.col("text")
    kind = doc % 4
    content = (
        F.when(kind == 2, _sectioned(text, DRUG_LABEL_HEADERS))
        .when(kind == 3, _sectioned(text, TRIAL_HEADERS))
        .otherwise(F.replace(text, F.lit("\n"), F.lit("\n\n")))
    )
    metadata = F.struct(
        string_array(F.col("lang")).alias("authors"),
        F.date_add(F.lit("2024-01-01").cast("date"), (doc % 365).cast("int")).alias("publication_date"),
        F.when(doc % 7 == 0, string_array(F.lit("triage_desk"), F.lit("general")))
        .otherwise(string_array()).alias("specialty"),
        pick(CREDIBILITIES, doc % 5).alias("credibility"),
        F.concat(F.lit("https://example.org/doc/"), doc.cast("string")).alias("url"),
        F.when(doc % 3 != 0, F.concat(F.lit("10.1/"), doc.cast("string"))).alias("doi"),
    ).cast(METADATA)
    return rows.select(
        "source",
        doc.cast("string").alias("source_id"),
        first_line(text).alias("title"),
        content.alias("content"),
        pick(CONTENT_TYPES, kind).alias("content_type"),
        metadata.alias("metadata"),
    )


def web_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_web_payloads(spread(table(spark, sf_dir, "pages")))


def as_web_payloads(rows: DataFrame) -> DataFrame:
    """Pages as landed answers of a scraper: title from the title element, text with tags cut out."""
    html = F.col("html")
    title = F.regexp_extract(html, r"<title>([^<]*)</title>", 1)
    body = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    page = F.struct(
        F.col("url"),
        F.when(title != "", title).alias("title"),
        F.trim(F.regexp_replace(body, r"[ \n\t\r]+", " ")).alias("markdown"),
    )
    return rows.select(
        "page_id", F.to_json(F.struct(F.array(page).alias("data"))).alias("payload")
    )


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the flat view of stored chunks."""
    vec, label = F.col("vec_id"), F.col("label")
    source = F.concat(F.lit("src"), (label % 3).cast("string"))
    return table(spark, sf_dir, "embeddings").select(
        vec.cast("string").alias("chunk_id"),
        F.concat(F.lit("chunk text "), vec.cast("string")).alias("text"),
        "embedding",
        document_key(source, vec.cast("string")).alias("source_document_id"),
        source.alias("source"),
        pick([*CREDIBILITIES, "blog"], vec % 7).alias("credibility"),
        F.concat(F.lit("s"), label.cast("string")).alias("specialty"),
        F.lit(None).cast("string").alias("doi"),
        F.lit("").alias("url"),
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of id 0, used as the one query of single-query searches."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").head()["embedding"]


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
              "l_returnflag", "l_linestatus")


def _offset() -> Column:
    """The time of an order line, relative to the start of its case."""
    amount = F.col("l_quantity").cast("int").cast("string")
    return pick_column(
        [
            F.concat(F.lit("T+"), amount, F.lit("min")), F.concat(F.lit("T+"), amount, F.lit("h")),
            F.concat(F.lit("T+"), amount, F.lit("sec")), F.concat(F.lit("T+"), amount, F.lit(" days")),
            F.concat(F.lit("T+1h"), amount, F.lit("min")), F.concat(F.lit("T+"), amount, F.lit("w")),
        ],
        F.col("l_partkey") % 6,
    )


def _phase(line: Column, number: Column) -> Column:
    """The phase of an order line, given as a struct of ``LINE_ORDER`` and its ``offset``.

    Every part has its final type at once, so that the last cast changes names of types only and copies nothing.
    """
    offset = line["offset"]
    part, supp, qty = line["l_partkey"], line["l_suppkey"], line["l_quantity"].cast("int")
    vitals = F.when(
        line["l_linenumber"] % 4 != 0,
        F.struct(
            (qty + 60).alias("hr"),
            (supp % 60 + 100).cast("int").alias("bp_systolic"),
            (supp % 30 + 60).cast("int").alias("bp_diastolic"),
            (line["l_linenumber"] + 12).cast("int").alias("rr"),
            (part % 10 + 90.5).alias("spo2"),
            ((part % 4) * 0.5 + 36.5).alias("temp_c"),
            F.when(part % 2 == 0, F.lit(15)).alias("gcs"),
        ),
    )
    known = LAB_PANELS["BMP"]

    def value(name: str, number: Column, unit: Column) -> Column:
        low, high = next(((c[2], c[3]) for c in known if c[0] == name), (0.5, 2.0))
        return F.struct(
            F.lit(name).alias("name"), number.alias("value"), unit.alias("unit"),
            F.lit(float(low)).alias("reference_low"), F.lit(float(high)).alias("reference_high"),
            F.lit(None).cast("string").alias("flag"),
        )

    lab_results = F.concat(
        F.array(
            F.struct(
                F.lit("BMP").alias("panel"),
                F.array(
                    value("K", (part % 60 + 20) / 10.0, F.lit("mEq/L")),
                    value("Na", (supp % 50 + 115) + F.when(part % 9 == 0, 0.5).otherwise(0.0), F.lit("mEq/L")),
                ).alias("values"),
                offset.alias("timestamp"),
            )
        ),
        F.when(
            supp % 3 == 0,
            F.array(
                F.struct(
                    F.when(supp % 11 == 0, F.lit("XYZ")).otherwise(F.lit("ABG")).alias("panel"),
                    F.array(
                        value("Lactate", (part % 55) / 10.0, F.when(part % 13 == 0, F.lit("mg/dL")).when(part % 13 != 1, F.lit("mmol/L")))
                    ).alias("values"),
                    offset.alias("timestamp"),
                )
            ),
        ).otherwise(F.array().cast(CASE["phases"].dataType.elementType["lab_results"].dataType)),
    )
    imaging_results = F.when(
        part % 3 == 0,
        F.array(
            F.struct(
                pick(MODALITIES, supp % 6).alias("modality"),
                pick(REGIONS, (part + supp) % 6).alias("body_region"),
                F.concat(F.lit("check "), line["l_returnflag"]).alias("indication"),
                F.array(
                    F.struct(
                        F.lit("organ").alias("structure"),
                        pick(OBSERVATIONS, (part / 3).cast("long") % 6).alias("observation"),
                        F.lit(None).cast("string").alias("severity"),
                        F.lit(None).cast("string").alias("laterality"),
                    ),
                    F.struct(
                        F.lit("field").alias("structure"),
                        F.lit("clear").alias("observation"),
                        F.lit(None).cast("string").alias("severity"),
                        F.lit(None).cast("string").alias("laterality"),
                    ),
                ).alias("findings"),
                F.lit("see findings").alias("impression"),
                offset.alias("timestamp"),
            )
        ),
    ).otherwise(F.array().cast(CASE["phases"].dataType.elementType["imaging_results"].dataType))
    def decision(j: int) -> Column:
        return F.struct(
            F.concat(F.lit("action "), ((supp + j) % 12).cast("string")).alias("action"),
            ((part % 3 == j) | (supp % 7 == j)).alias("is_optimal"),
            pick(QUALITIES, (part + j) % 6).alias("quality"),
            F.lit(f"reason {j}").alias("reasoning"),
            F.concat(F.lit("outcome "), line["l_returnflag"]).alias("clinical_outcome"),
            F.lit(None).cast("string").alias("time_cost"),
            F.lit(None).cast("int").alias("leads_to_phase"),
        )

    decisions = F.array_compact(F.array(*[F.when(part % 6 >= j, decision(j)) for j in range(1, 6)]))
    return F.struct(
        number.cast("int").alias("phase_number"),
        offset.alias("time_offset"),
        F.concat(F.lit("Line "), part.cast("string"), F.lit(" "), line["l_returnflag"]).alias("narrative"),
        vitals.alias("vitals"),
        lab_results.alias("lab_results"),
        imaging_results.alias("imaging_results"),
        F.when(
            line["l_linestatus"] == "F", F.concat(F.lit("shipped "), F.date_format(line["l_shipdate"], "yyyy-MM-dd"))
        ).alias("clinical_update"),
        decisions.alias("decisions"),
        F.struct(
            F.lit(None).cast("int").alias("optimal_next_phase"),
            line["l_linestatus"].alias("patient_status"),
            F.lit("next").alias("narrative_transition"),
        ).alias("phase_outcome"),
    ).cast(CASE["phases"].dataType.elementType)


def _choice(order: Column, j: int) -> Column:
    correct = order % 4 == j
    error = F.when((order + j) % 2 == 0, F.lit("catastrophic")).otherwise(F.lit("common_mistake"))
    return F.struct(
        F.lit(f"choice {j}").alias("choice"),
        correct.alias("is_correct"),
        F.when(~correct, error).alias("error_type"),
        F.lit(f"why {j}").alias("reasoning"),
        F.concat(F.lit("outcome "), order.cast("string")).alias("outcome"),
        F.when(~correct, F.lit(f"harm {j}")).alias("consequence"),
        F.lit(None).cast("string").alias("next_decision"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``phases_of, lines``: the lines of every order in their order."""
    line = F.struct(*LINE_ORDER, _offset().alias("offset"))
    met = F.sort_array(F.collect_list(line)).alias("lines")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("phases_of")).agg(met)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return orders.withColumn("case_id", F.col("o_orderkey").cast("string"))


def phase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, pos, phase``: the phases of ``cases``, a row each. A phase is made in a row of its own, not inside an array,
    so that its columns are compiled."""
    met = _orders(spark, sf_dir).select("case_id").hint("shuffle_hash").join(_lines(spark, sf_dir), F.col("case_id") == F.col("phases_of"))
    lines = met.select("case_id", F.posexplode("lines").alias("pos", "line"))
    return lines.select("case_id", "pos", _phase(F.col("line"), F.col("pos") + 1).alias("phase"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases, with their lines as phases.

    The lines of an order travel as the few columns they are told from; phases are made where the lines have met, and
    meet their order there in a hash table of orders, so that phases are neither shuffled nor sorted. Rows stay where
    their case id put them: what is grouped by case id afterwards moves nothing.
    """
    order, price = F.col("o_orderkey"), F.col("o_totalprice")
    met = _lines(spark, sf_dir)
    phases = met.select("phases_of", F.transform("lines", lambda x, i: _phase(x, i + 1)).alias("phases"))
    rows = _orders(spark, sf_dir).hint("shuffle_hash").join(phases, F.col("case_id") == F.col("phases_of"), "left")
    accuracy = F.floor(price) % 100 / 100.0
    review = F.struct(
        accuracy.alias("accuracy_score"),
        F.when(F.col("o_custkey") % 17 != 0, F.col("o_custkey") % 100 / 100.0).alias("pedagogy_score"),
        (order % 100 / 100.0).alias("bias_score"),
        (accuracy >= 0.7).alias("approved"),
        F.array(F.concat(F.lit("note "), order.cast("string"))).alias("notes"),
    )
    empty_phases = F.array().cast(CASE["phases"].dataType)
    columns = {
        "case_id": F.col("case_id"),
        "topic": F.col("c_mktsegment"),
        "difficulty": pick(LEVELS, order % 3),
        "specialty": F.array(F.lower("c_mktsegment"), F.col("o_orderpriority")),
        "patient": F.struct(
            (F.col("o_custkey") % 60 + 20).alias("age"), F.lit("female").alias("sex"), F.col("c_name").alias("demographics")
        ),
        "vignette": F.concat(F.lit("Case of "), F.col("c_name")),
        "decision_prompt": F.lit("What would you do next?"),
        "ground_truth": F.struct(
            F.concat(F.lit("dx "), order.cast("string")).alias("diagnosis"),
            F.lit("treat").alias("optimal_next_step"),
            F.lit("because").alias("rationale"),
            F.array(F.col("o_orderpriority")).alias("key_findings"),
        ),
        "decision_tree": F.array(*[_choice(order, j) for j in range(3)]),
        "complications": F.array(),
        "blueprint": F.lit(None),
        "phases": F.coalesce("phases", empty_phases),
        "review": F.when(order % 10 != 0, review),
        "sources": F.array(),
        "metadata": F.struct(
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
            F.concat(F.lit("model-"), F.col("o_orderstatus")).alias("model"),
            F.lit(0).alias("retry_count"),
            (order * 3).alias("total_input_tokens"),
            (order * 2).alias("total_output_tokens"),
            F.lit(True).alias("multi_step"),
        ),
    }
    return rows.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in CASE.fields])


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as learner answers: user picks the case, the event the choice."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("answer_id"),
        F.col("user_id").cast("string").alias("case_id"),
        (F.col("event_id") % 4).cast("int").alias("chosen"),
    )


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark texts as a keyword table, grouped by their first letter."""
    return (
        table(spark, sf_dir, "benchmark")
        .select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("keyword"))
        .where(F.length("keyword") >= 4)
        .distinct()
        .select(F.concat(F.lit("group_"), F.substring("keyword", 1, 1)).alias("specialty"), "keyword")
    )



def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as case slots of one batch."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("slot_id"),
        key.alias("slot_seq"),
        F.col("c_mktsegment").alias("topic"),
        pick(LEVELS, key % 3).alias("difficulty"),
    )


def topic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query vector for every market segment: the embedding whose id is the length of its name."""
    topics = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("topic")).distinct()
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topics.join(vectors, F.length("topic") == F.col("vec_id")).select("topic", "embedding")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored review answers: customer is the slot, year the round, with some broken ones."""
    order = F.col("o_orderkey")
    score = F.floor("o_totalprice") % 100 / 100.0
    body = F.struct(
        score.alias("accuracy_score"), F.lit(0.8).alias("pedagogy_score"),
        F.when(order % 11 != 0, F.lit(0.9)).alias("bias_score"), (score >= 0.7).alias("approved"),
        F.array(F.concat(F.lit("note "), order.cast("string"))).alias("notes"),
    )
    payload = F.when(order % 13 == 0, F.lit("{broken")).otherwise(F.to_json(body))
    return table(spark, sf_dir, "orders").select(
        order.cast("string").alias("request_id"),
        F.col("o_custkey").cast("string").alias("slot_id"),
        order.alias("slot_seq"),
        (F.year("o_orderdate") % 3).alias("round"),
        F.lit(0).alias("call"),
        payload.alias("payload"),
        (order % 50 + 10).alias("input_tokens"),
        (F.col("o_custkey") % 20 + 5).alias("output_tokens"),
        F.concat(F.lit("model-"), F.col("o_orderstatus")).alias("model"),
    )


# --- landed payloads of each source --------------------------------------------------


def _escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def _element(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name.split(' ')[0]}>"))


YEARS = ["2019", "2020", "2021", "soon", "2023", "2024"]
MONTHS = ["Jan", "feb", "07", "Dec", "13", "x"]


def pubmed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as article exports, one article each; every ninth is no XML."""
    doc = F.col("doc_id")
    number = doc.cast("string")
    month = F.when(doc % 7 != 0, _element("Month", pick(MONTHS, doc % 6)))
    day = F.when(doc % 4 != 0, _element("Day", (doc % 33).cast("string")))
    date = F.concat(_element("Year", pick(YEARS, (doc % 11) % 6)), F.coalesce(month, F.lit("")), F.coalesce(day, F.lit("")))
    article = F.concat(
        F.lit("<Journal><JournalIssue>"), _element("PubDate", date), F.lit("</JournalIssue></Journal>"),
        _element("ArticleTitle", F.concat(F.lit("On "), number, F.lit(" &amp; more"))),
        _element('ELocationID EIdType="doi"', F.concat(F.lit("10.1/"), number)),
        _element("Abstract", F.concat(_element('AbstractText Label="AIM"', F.concat(F.lit("a"), number)), _element("AbstractText", _escaped(F.col("text"))))),
        F.lit("<AuthorList><Author><LastName>Roe</LastName><ForeName>Ann</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList>"),
    )
    kind = F.when(doc % 5 == 0, "Guideline").otherwise("Review")
    types = _element("PublicationTypeList", _element("PublicationType", kind))
    citation = _element("MedlineCitation", F.concat(_element("PMID", number), _element("Article", article), types))
    payload = _element("PubmedArticleSet", _element("PubmedArticle", citation))
    return spread(table(spark, sf_dir, "documents")).select(F.when(doc % 9 == 8, F.lit("<broken")).otherwise(payload).alias("payload"))


def openfda_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, number = F.col("doc_id"), F.col("doc_id").cast("string")
    openfda = F.struct(
        F.when(doc % 2 == 0, F.array(F.concat(F.lit("Brand "), number))).alias("brand_name"),
        F.when(doc % 3 == 0, F.array(F.concat(F.lit("generic "), number))).alias("generic_name"),
        F.when(doc % 5 != 0, F.array(F.col("source"))).alias("manufacturer_name"),
    )
    label = F.struct(
        F.concat(F.lit("set"), number).alias("set_id"),
        F.concat(F.lit("2023"), F.lpad((doc % 14).cast("string"), 2, "0"), F.lit("15")).alias("effective_time"),
        openfda.alias("openfda"),
        F.array(F.col("text"), F.lit("ignored")).alias("warnings"),
        F.when(doc % 4 == 0, F.array(F.lit("plain"))).alias("indications_and_usage"),
    )
    return spread(table(spark, sf_dir, "documents")).select(F.to_json(F.struct(F.array(label).alias("results"))).alias("payload"))


LABEL_CODES = ["34067-9", "34084-4", "34088-5", "00000-0"]


def dailymed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that name themselves; every tenth declares an entity and is set aside."""
    doc, number = F.col("doc_id"), F.col("doc_id").cast("string")

    def section(code: Column, body: Column) -> Column:
        return F.concat(F.lit('<section><code code="'), code, F.lit('"/><text> '), body, F.lit(" </text></section>"))

    said = F.replace(_escaped(F.col("text")), F.lit("\n"), F.lit("&#10;"))  # a label lands as one line
    payload = F.concat(
        F.when(doc % 10 == 9, F.lit('<!DOCTYPE d [<!ENTITY x "y">]>')).otherwise(F.lit("")),
        F.lit('<document xmlns="urn:hl7-org:v3"><setId root="id'), number, F.lit('"/><title>Label '), number, F.lit("</title>"),
        section(pick(LABEL_CODES, doc % 4), F.concat(F.lit("<b>"), said, F.lit("</b> end"))),
        section(F.lit("34089-3"), F.lit("described")), F.lit("</document>"),
    )
    return spread(table(spark, sf_dir, "documents")).select(payload.alias("payload"))


def rxnorm_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as concepts: an answer per brand with all of its parts, in groups by type."""
    concept = F.struct(F.col("p_partkey").cast("string").alias("rxcui"), F.col("p_name").alias("name"), F.col("p_type").alias("tty"))
    groups = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.collect_list(concept).alias("conceptProperties"))
    group = F.struct(F.col("p_type").alias("tty"), "conceptProperties")
    answers_ = groups.groupBy("p_brand").agg(F.collect_list(group).alias("conceptGroup"))
    return answers_.select(F.to_json(F.struct(F.struct("conceptGroup").alias("drugGroup"))).alias("payload"))


def medrxiv_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, number = F.col("doc_id"), F.col("doc_id").cast("string")
    item = F.struct(
        F.concat(F.lit("10.1/"), number).alias("doi"), first_line(F.col("text")).alias("title"), F.lit(" A, B ; ; C ").alias("authors"),
        F.concat(F.lit("2024-"), (doc % 14).cast("string"), F.lit("-"), (doc % 31).cast("string")).alias("date"),
        F.col("text").alias("abstract"), F.when(doc % 3 == 0, F.col("lang")).otherwise("").alias("category"),
    )
    return spread(table(spark, sf_dir, "documents")).select(F.to_json(F.struct(F.array(item).alias("collection"))).alias("payload"))


def trials_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_orderkey")
    number = order.cast("string")
    ages = F.struct(
        F.concat(F.lit("Must be "), number).alias("eligibilityCriteria"), F.when(order % 2 == 0, "18 Years").alias("minimumAge"), F.lit(None).cast("string").alias("maximumAge")
    )
    outcome = F.array(F.struct(F.col("o_orderpriority").alias("measure"), F.lit("1 year").alias("timeFrame")))
    study = F.struct(
        F.struct(
            F.struct(F.concat(F.lit("NCT"), number).alias("nctId"), F.when(order % 4 != 0, F.concat(F.lit("Brief "), number)).alias("briefTitle"), F.lit("Official").alias("officialTitle")).alias("identificationModule"),
            F.struct(F.when(order % 5 != 0, F.col("o_orderstatus")).alias("overallStatus")).alias("statusModule"),
            ages.alias("eligibilityModule"),
            F.struct(F.when(order % 3 == 0, outcome).alias("primaryOutcomes")).alias("outcomesModule"),
            F.struct(F.when(order % 3 == 1, F.array(F.lit("PHASE1"), F.lit("PHASE2"))).alias("phases")).alias("designModule"),
        ).alias("protocolSection")
    )
    return table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.array(study).alias("studies"))).alias("payload"))


def curated_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, number = F.col("doc_id"), F.col("doc_id").cast("string")
    item = F.struct(number.alias("id"), first_line(F.col("text")).alias("title"), F.col("text").alias("content"), F.when(doc % 2 == 0, F.col("lang")).alias("category"), F.concat(F.lit("https://x/"), number).alias("url"))
    return spread(table(spark, sf_dir, "documents")).select(F.to_json(F.struct(F.array(item).alias("results"))).alias("payload"))


def fulltext_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, number = F.col("doc_id"), F.col("doc_id").cast("string")
    item = F.struct(number.alias("id"), first_line(F.col("text")).alias("title"), F.lit("A; B").alias("author"), F.col("text").alias("content"), F.when(doc % 2 == 0, number).alias("doi"))
    return spread(table(spark, sf_dir, "documents")).select(F.to_json(F.struct(F.array(item).alias("results"))).alias("payload"))


# --- stored answers of every schema -------------------------------------------------


def stage_answers(spark: SparkSession, sf_dir: str, schema: str) -> DataFrame:
    """Orders as answers of one schema; every seventh lacks something that is required."""
    order, number = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    whole = order % 7 != 0

    def need(value) -> Column:
        return F.when(whole, value if isinstance(value, Column) else F.lit(value))

    patient = F.struct((order % 60 + 20).alias("age"), F.lit("female").alias("sex"), F.lit("d").alias("demographics"))
    truth = F.struct(F.concat(F.lit("dx "), number).alias("diagnosis"), F.lit("treat").alias("optimal_next_step"), need("because").alias("rationale"), F.array(F.lit("k")).alias("key_findings"))

    def choice(j: int) -> Column:
        return F.struct(F.lit(f"choice {j}").alias("choice"), (order % 2 == j).alias("is_correct"), F.lit("r").alias("reasoning"), need(F.concat(F.lit("o"), number)).alias("outcome"))

    def planned(i: Column) -> Column:
        return F.struct(
            (i + 1).alias("phase_number"), F.lit("T+0").alias("time_offset"), F.lit("c").alias("clinical_context"), F.array(F.lit("CBC")).alias("available_diagnostics"),
            F.array().cast("array<string>").alias("pending_diagnostics"), F.lit("workup").alias("decision_type"),
            F.concat(F.lit("act "), number, F.lit("."), (i + 1).cast("string")).alias("correct_action"), need("k").alias("key_reasoning"),
        )

    count = (order % 4).cast("int")
    phases = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), planned)
    blueprint = F.struct(
        F.concat(F.lit("dx "), number).alias("diagnosis"), F.lit("arc").alias("clinical_arc"), count.alias("phase_count"), F.slice(phases, F.lit(1), count).alias("phases"),
        F.array().cast("array<struct<phase_number:int,branch_type:string,trigger_action_quality:string,description:string>>").alias("branching_points"),
        F.array(F.lit("late")).alias("expected_complications"),
    )
    issue = F.struct((order % 3 + 1).cast("int").alias("phase_number"), F.lit("vitals.hr").alias("field"), F.concat(F.lit("jump "), number).alias("issue"), need("smooth").alias("suggested_fix"))
    body = {
        "case_writer": F.struct(patient.alias("patient"), F.concat(F.lit("v "), number).alias("vignette"), F.lit("Next?").alias("decision_prompt"), truth.alias("ground_truth"), F.array(F.lit("s1")).alias("specialty")),
        "decision_tree": F.struct(F.array(choice(0), choice(1)).alias("decision_tree"), F.array(F.struct(*[F.lit("x").alias(c) for c in ("trigger", "detail", "event", "outcome")])).alias("complications")),
        "planner": F.struct(blueprint.alias("blueprint"), patient.alias("patient"), F.array(F.lit("s1"), F.col("o_orderpriority")).alias("specialty")),
        "blueprint_review": F.struct(need(order % 2 == 0).alias("approved"), F.array(F.lit("n")).alias("notes")),
        "consistency": F.struct(F.array(issue).alias("issues")),
    }[schema]
    return table(spark, sf_dir, "orders").select(number.alias("request_id"), number.alias("slot_id"), order.alias("slot_seq"), F.to_json(body).alias("payload"), F.lit("m").alias("model"))


def answered_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of the cases as answers; those of every seventh order have no narrative."""
    rows = phase_rows(spark, sf_dir)
    narrative = F.when(F.coalesce(F.col("case_id").cast("long") % 7 != 0, F.lit(True)), F.col("phase.narrative"))
    phase = F.col("phase").withField("narrative", narrative)
    return rows.select(F.concat_ws(".", "case_id", F.col("pos").cast("string")).alias("request_id"), F.col("case_id").alias("slot_id"), "pos", F.to_json(F.struct(phase.alias("phase"))).alias("payload"), F.lit("m").alias("model"))
