"""Queries over the driver's tables, one or more per operator. Each reads its whole input."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import fixtures, recorded
from wardloom.functions.text import preview
from wardloom.operators import cases as case_ops
from wardloom.operators import exports, grading, knowledge, search, tagging, validation, vector_index
from wardloom.operators.chunking import chunk, chunk_id
from wardloom.operators.embedding import embed, stored_idf
from wardloom.plans import prompts, requests, rounds
from wardloom.schemas import CASE, DOCUMENT
from wardloom.session import work_path
from wardloom.streaming import ingest
from wardloom.sources import registry
from wardloom.tables import latest_per_key

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _chunks(spark, sf_dir) -> DataFrame:
    return chunk(fixtures.documents(spark, sf_dir))


def _plain(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "source_document_id", "position", "text")


# --- sources ---------------------------------------------------------------------


@query
def union_sources(spark, sf_dir):
    documents = fixtures.documents(spark, sf_dir)
    web = registry.normalize(fixtures.web_payloads(spark, sf_dir), "firecrawl")
    both = registry.union_documents(documents, web)
    return both.groupBy("source", "content_type").agg(
        F.count("*").alias("documents"), F.sum(F.length("content")).alias("characters")
    )


@query
def normalize_web(spark, sf_dir):
    documents = registry.normalize(fixtures.web_payloads(spark, sf_dir), "firecrawl")
    return documents.select(
        "source", "source_id", "title", "content", "content_type",
        F.col("metadata.credibility").alias("credibility"), F.col("metadata.url").alias("url"),
    )


@query
def filter_sources(spark, sf_dir):
    documents = registry.filter_sources(fixtures.documents(spark, sf_dir), ["src1", "src7", "nowhere"])
    return documents.select("source", "source_id", "title")


@query
def limit_per_source(spark, sf_dir):
    documents = fixtures.documents(spark, sf_dir)
    order = [F.desc("metadata.publication_date"), F.col("source_id")]
    return registry.limit_per_source(documents, 20, order).select("source", "source_id")


@query
def match_any_term(spark, sf_dir):
    documents = fixtures.documents(spark, sf_dir)
    hits = registry.match_any_term(documents, "Stent rash ERENES", 20, F.col("source_id").cast("long"))
    return hits.select("source", "source_id", "title")


@query
def recent_documents(spark, sf_dir):
    documents = registry.recent(fixtures.documents(spark, sf_dir), date(2024, 6, 30), 30)
    return documents.select("source", "source_id", F.col("metadata.publication_date").cast("string").alias("published"))


@query
def get_document(spark, sf_dir):
    documents = fixtures.documents(spark, sf_dir)
    source = documents.where("source_id = '0'").head()["source"]
    found = registry.get_document(documents, source, "0")
    missing = registry.get_document(documents, source, "no such id")
    return found.unionByName(missing).select("source", "source_id", "title", "content")


def _flat(documents: DataFrame) -> DataFrame:
    m = F.col("metadata")
    return documents.select(
        "source", "source_id", "title", "content", "content_type", F.array_join(m["authors"], "|").alias("authors"),
        m["publication_date"].cast("string").alias("published"), F.array_join(m["specialty"], "|").alias("specialty"),
        m["credibility"].alias("credibility"), m["url"].alias("url"), m["doi"].alias("doi"),
    )


def _source_query(name: str, source: str, payloads) -> None:
    def run(spark, sf_dir):
        return _flat(registry.normalize(payloads(spark, sf_dir), source))

    QUERIES[name] = run


for _name, _source, _payloads in (
    ("source_pubmed", "pubmed", fixtures.pubmed_payloads), ("source_openfda", "openfda", fixtures.openfda_payloads),
    ("source_dailymed", "dailymed", fixtures.dailymed_payloads), ("source_rxnorm", "rxnorm", fixtures.rxnorm_payloads),
    ("source_medrxiv", "medrxiv", fixtures.medrxiv_payloads), ("source_trials", "clinicaltrials", fixtures.trials_payloads),
    ("source_curated", "glass", fixtures.curated_payloads), ("source_fulltext", "annas_archive", fixtures.fulltext_payloads),
):
    _source_query(_name, _source, _payloads)


@query
def source_rejected(spark, sf_dir):
    """What the article and label sources set aside: how many payloads, and how many undated articles."""
    articles = registry.rejected(fixtures.pubmed_payloads(spark, sf_dir), "pubmed")
    labels = registry.rejected(fixtures.dailymed_payloads(spark, sf_dir), "dailymed")
    pmid = F.get_json_object("payload", "$.MedlineCitation.PMID._VALUE")
    return articles.union(labels).groupBy("source").agg(F.count("*").alias("rows"), F.count(pmid).alias("undated"))


# --- chunks and tags -----------------------------------------------------------------


@query
def chunk_abstract(spark, sf_dir):
    return _plain(chunk(fixtures.documents(spark, sf_dir).where("content_type = 'abstract'")))


@query
def chunk_sections(spark, sf_dir):
    sectioned = F.col("content_type").isin("drug_label", "trial_protocol")
    return _plain(chunk(fixtures.documents(spark, sf_dir).where(sectioned)))


@query
def chunk_by_size(spark, sf_dir):
    return _plain(chunk(fixtures.documents(spark, sf_dir).where("content_type = 'full_text'"), 500, 200))


@query
def chunk_ids(spark, sf_dir):
    documents = fixtures.documents(spark, sf_dir)
    return documents.select(
        "source", "source_id", chunk_id(F.col("source"), F.col("source_id"), F.lit(0)).alias("first_chunk_id")
    )


@query
def chunk_documents(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return chunks.select(
        "chunk_id", "position", F.length("text").alias("characters"),
        F.col("metadata.credibility").alias("credibility"),
        F.array_join("metadata.authors", ",").alias("authors"),
        preview(F.col("text")).alias("preview"),
    )


def _tags(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.array_join("metadata.specialty", ",").alias("specialty"))


@query
def tag_specialty(spark, sf_dir):
    return _tags(tagging.tag_specialty(_chunks(spark, sf_dir)))


@query
def tag_with_table(spark, sf_dir):
    return _tags(tagging.tag_with_table(_chunks(spark, sf_dir), fixtures.search_terms(spark, sf_dir)))


@query
def tag_by_join(spark, sf_dir):
    """The same keyword table as if it were too large to be broadcast."""
    return _tags(tagging.tag_with_table(_chunks(spark, sf_dir), fixtures.search_terms(spark, sf_dir), small=0))


@query
def specialty_counts(spark, sf_dir):
    tagged = tagging.tag_specialty(_chunks(spark, sf_dir))
    return (
        tagged.select(F.split("source_document_id", ":")[0].alias("source"), F.explode_outer("metadata.specialty").alias("specialty"))
        .groupBy("source", "specialty")
        .agg(F.count("*").alias("chunks"))
    )


# --- knowledge table and search --------------------------------------------------------


@query
def ingest_summary(spark, sf_dir):
    return knowledge.ingest_summary(fixtures.documents(spark, sf_dir), _chunks(spark, sf_dir))


@query
def ingest_summary_of_documents(spark, sf_dir):
    return knowledge.ingest_summary_of(fixtures.documents(spark, sf_dir))


@query
def kb_flat_metadata(spark, sf_dir):
    return knowledge.flat_metadata(_chunks(spark, sf_dir)).drop("text")


def _stored_chunks(kb: DataFrame) -> DataFrame:
    """All of a stored chunk; its vector as the number of terms and the sum of squares."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return kb.select(
        "chunk_id", "source", "position", "text", F.array_join("metadata.specialty", ",").alias("specialty"),
        "metadata.credibility", F.array_join("metadata.authors", ",").alias("authors"),
        F.coalesce("metadata.doi", F.lit("")).alias("doi"), F.size("embedding").alias("width"), F.round(total, 4).alias("norm"),
    )


def _unsourced(documents: DataFrame) -> DataFrame:
    """Documents, some of them from a source without a name."""
    return documents.withColumn("source", F.when(F.col("source") == "src3", F.lit("")).otherwise(F.col("source")))


@query
def kb_upsert(spark, sf_dir):
    """All documents, then the abstracts again in two versions of which the later counts."""
    kb = knowledge.knowledge_table(spark, work_path(spark, "kb"))
    documents = _unsourced(fixtures.documents(spark, sf_dir))
    kb.upsert(knowledge.knowledge_rows(documents))
    abstracts = documents.where("content_type = 'abstract'")
    early = abstracts.withColumn("content", F.concat(F.lit("zz early "), "content"))
    late = abstracts.withColumn("content", F.concat("content", F.lit(" again"))).withColumn(
        "metadata", F.col("metadata").withField("publication_date", F.date_add("metadata.publication_date", 1))
    )
    kb.upsert(knowledge.knowledge_rows(knowledge.single_version(early.unionByName(late))))
    return _stored_chunks(kb.read())


@query
def kb_increment(spark, sf_dir):
    """All documents, then a hundredth of them with other text: read as increments that are not merged yet."""
    kb = knowledge.knowledge_table(spark, work_path(spark, "kb"))
    documents = _unsourced(fixtures.documents(spark, sf_dir))
    kb.upsert(knowledge.knowledge_rows(documents))
    few = documents.where("content_type = 'abstract' AND cast(source_id AS long) % 100 = 0")
    kb.upsert(knowledge.knowledge_rows(few.withColumn("content", F.lit("changed"))))
    return _stored_chunks(kb.read())


@query
def kb_count(spark, sf_dir):
    return knowledge.count_chunks(_chunks(spark, sf_dir))


@query
def embed_chunks(spark, sf_dir):
    """Vectors under stored frequencies; sums by place tell where each weight stands."""
    chunks = _chunks(spark, sf_dir)
    embedded = embed(chunks, idf=stored_idf(chunks, work_path(spark, "idf")))
    vector = F.transform("embedding", lambda x: x.cast("double"))

    def total(of):
        return F.aggregate(F.transform(vector, of), F.lit(0.0), lambda s, x: s + x)

    return embedded.select(
        "chunk_id", F.size("embedding").alias("width"), F.round(total(lambda x: x * x), 4).alias("norm"),
        F.size(F.filter(vector, lambda x: x != 0)).alias("filled"), F.round(F.array_max(vector), 4).alias("heaviest"),
        F.round(total(lambda x: x), 4).alias("total"), F.round(total(lambda x, i: x * i), 3).alias("by_place"),
        F.round(total(lambda x, i: x * (i % 7)), 4).alias("by_seventh"),
    )


@query
def search_topk(spark, sf_dir):
    kb = fixtures.knowledge(spark, sf_dir)
    hits = search.search(kb, fixtures.query_vector(spark, sf_dir), 10)
    return hits.select("chunk_id", "text", "source", F.round("score", 6).alias("score"))


@query
def search_by_source(spark, sf_dir):
    kb = fixtures.knowledge(spark, sf_dir)
    hits = search.search(kb, fixtures.query_vector(spark, sf_dir), 10, source="src1")
    return hits.select("chunk_id", "text", "source", F.round("score", 6).alias("score"))


def _queries(kb: DataFrame) -> DataFrame:
    return kb.select(F.col("chunk_id").alias("query_id"), "embedding")


@query
def search_many(spark, sf_dir):
    kb = fixtures.knowledge(spark, sf_dir)
    hits = search.search_many(kb.select("chunk_id", "embedding", "source"), _queries(kb), 10)
    return hits.select("query_id", "chunk_id", "source", "rank", F.round("score", 6).alias("score"))


def _vector_index(spark, sf_dir):
    return vector_index.build(fixtures.knowledge(spark, sf_dir).select("chunk_id", "embedding", "source"), 64)


@query
def search_by_lists(spark, sf_dir):
    """Exact search of every chunk's neighbours through the inverted lists and their bounds."""
    index = _vector_index(spark, sf_dir)
    hits = vector_index.search_exact(index, _queries(index.rows), 10)
    return hits.select("query_id", "chunk_id", "source", "rank", F.round("score", 6).alias("score"))


@query
def search_approx(spark, sf_dir):
    index = _vector_index(spark, sf_dir)
    hits = vector_index.search_approx(index, _queries(index.rows), 10)
    return hits.select("query_id", "chunk_id", "source", "rank", F.round("score", 6).alias("score"))


@query
def search_recall(spark, sf_dir):
    """Of the ten nearest chunks of every chunk, how many the approximate search finds, and whether that is 95 in a hundred over all."""
    kb = fixtures.knowledge(spark, sf_dir)
    near = search.search_many(kb.select("chunk_id", "embedding"), _queries(kb), 10).select("query_id", "chunk_id")
    found = search_approx(spark, sf_dir).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    both = near.join(found, ["query_id", "chunk_id"], "left")
    path = work_path(spark, "recall")
    both.groupBy("query_id").agg(F.count("*").alias("nearest"), F.count("hit").alias("found")).write.parquet(path)
    counted = spark.read.parquet(path)
    reached = counted.agg((100 * F.sum("found") >= 95 * F.sum("nearest")).alias("reached"))
    return counted.crossJoin(F.broadcast(reached))


def _letters(texts: list[str]):
    """A stand-in for an embedding model: how often each of five letters occurs, and one."""
    import numpy as np

    return np.array([[*(t.count(c) for c in "aeinr"), 1] for t in texts], dtype=np.float32)


@query
def embed_plugin(spark, sf_dir):
    embedded = embed(_chunks(spark, sf_dir), fn=_letters)
    return embedded.select("chunk_id", *[F.col("embedding")[i].cast("long").alias(f"e{i}") for i in range(6)])


@query
def search_by_text(spark, sf_dir):
    """Benchmark texts as queries over all chunks, both embedded by the same model."""
    kb = embed(_chunks(spark, sf_dir), fn=_letters).select("chunk_id", "embedding")
    asked = fixtures.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    hits = search.search_text(kb, asked, 3, _letters)
    return hits.select("query_id", "rank", F.round("score", 6).alias("score"))


@query
def retrieve_rerank(spark, sf_dir):
    kb = fixtures.knowledge(spark, sf_dir)
    hits = search.retrieve(kb, fixtures.query_vector(spark, sf_dir), 25)
    return hits.withColumn("score", F.round("score", 6))


def _topics(spark, sf_dir) -> DataFrame:
    kb = fixtures.knowledge(spark, sf_dir)
    return kb.select(F.concat(F.lit("topic "), "chunk_id").alias("topic"), "embedding")


@query
def format_context(spark, sf_dir):
    hits = search.retrieve_many(fixtures.knowledge(spark, sf_dir), _topics(spark, sf_dir))
    return search.format_context(hits, by=("topic",))


@query
def source_refs(spark, sf_dir):
    hits = search.retrieve_many(fixtures.knowledge(spark, sf_dir), _topics(spark, sf_dir))
    refs = search.source_refs(hits, by=("topic",))
    return refs.select("topic", F.posexplode("sources").alias("pos", "r")).select(
        "topic", "pos", F.col("r.type").alias("type"), F.col("r.reference").alias("reference"),
        F.array_join("r.chunk_ids", ",").alias("chunk_ids"),
    )


# --- case store ----------------------------------------------------------------------


def _store(spark, sf_dir) -> DataFrame:
    return case_ops.store_rows(fixtures.cases(spark, sf_dir))


_LISTED = ("case_id", "topic", "difficulty", "specialty", "accuracy_score", "model", "generated_at")


@query
def list_cases(spark, sf_dir):
    rows = case_ops.list_rows(_store(spark, sf_dir), topic="BUILDING", difficulty="resident", min_accuracy=0.5)
    return rows.select(*_LISTED)


@query
def list_cases_unfiltered(spark, sf_dir):
    return case_ops.list_rows(_store(spark, sf_dir), topic="", difficulty="", limit=20).select(*_LISTED)


@query
def case_get(spark, sf_dir):
    found = case_ops.get_case(_store(spark, sf_dir), "17")
    return found.select(
        "case_id", "topic", F.size("phases").alias("phases"), F.col("review.accuracy_score").alias("accuracy_score"),
        F.size("decision_tree").alias("choices"), F.col("patient.demographics").alias("demographics"),
    )


@query
def case_count(spark, sf_dir):
    return case_ops.count_cases(_store(spark, sf_dir))


@query
def case_upsert(spark, sf_dir):
    """All cases saved, then those of one difficulty replaced."""
    store = case_ops.case_table(spark, work_path(spark, "cases"))
    cases = fixtures.cases(spark, sf_dir)
    case_ops.upsert_cases(store, cases)
    replaced = cases.where("difficulty = 'attending'").withColumn("topic", F.lit("REPLACED"))
    case_ops.upsert_cases(store, replaced)
    rows = store.read()
    return rows.groupBy("topic", "difficulty").agg(
        F.count("*").alias("cases"), F.count("accuracy_score").alias("reviewed"),
        F.count(F.get_json_object("case_json", "$.case_id")).alias("decoded"),
    )


@query
def multi_step_cases(spark, sf_dir):
    cases = case_ops.multi_step_cases(fixtures.cases(spark, sf_dir))
    return cases.select("case_id", F.size("phases").alias("phases"))


@query
def export_jsonl(spark, sf_dir):
    lines = case_ops.export_jsonl(_store(spark, sf_dir), difficulty="attending")

    def path(name):
        return F.get_json_object("line", name)

    return lines.select(
        "case_id", path("$.topic").alias("topic"), path("$.difficulty").alias("difficulty"),
        path("$.patient.age").cast("long").alias("age"), path("$.ground_truth.diagnosis").alias("diagnosis"),
        path("$.decision_tree[1].choice").alias("second_choice"), path("$.metadata.model").alias("model"),
        path("$.phases[0].narrative").alias("first_narrative"),
    )


@query
def case_summary(spark, sf_dir):
    return case_ops.case_summary(fixtures.cases(spark, sf_dir))


# --- exports -------------------------------------------------------------------------


def _steps(episodes: DataFrame) -> DataFrame:
    steps = episodes.select("case_id", "difficulty", F.explode("steps").alias("s"))
    return steps.select("case_id", "difficulty", "s.*")


@query
def rl_steps(spark, sf_dir):
    return _steps(exports.rl_episodes(fixtures.cases(spark, sf_dir))).select(
        "case_id", "difficulty", "step_number", "optimal_action",
        F.size("action_space").alias("actions"),
        F.col("observation.narrative").alias("narrative"),
        F.col("observation.time_elapsed").alias("time_elapsed"),
        F.size("observation.pending_orders").alias("pending_orders"),
        F.size("observation.new_lab_results").alias("labs"),
        F.size("observation.new_imaging_results").alias("imaging"),
        F.col("observation.vitals.hr").alias("hr"),
    )


def _rewards(episodes: DataFrame) -> DataFrame:
    steps = _steps(episodes)
    return steps.select("case_id", "step_number", "reward_table", F.explode("action_space").alias("a")).select(
        "case_id", "step_number", F.col("a.id").alias("action_id"), F.col("a.description").alias("description"),
        F.col("a.quality").alias("quality"), F.col("reward_table")[F.col("a.id")].alias("reward"),
    )


@query
def rl_rewards(spark, sf_dir):
    return _rewards(exports.rl_episodes(fixtures.cases(spark, sf_dir), {}))


@query
def rl_rewards_custom(spark, sf_dir):
    return _rewards(exports.rl_episodes(fixtures.cases(spark, sf_dir), {"optimal": 10.0, "harmful": -3.0}))


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select("case_id", F.posexplode("turns").alias("turn", "t")).select(
        "case_id", "turn", F.col("t.role").alias("role"), F.col("t.content").alias("content")
    )


@query
def sft_turns(spark, sf_dir):
    return _turns(exports.sft_conversations(fixtures.cases(spark, sf_dir)))


@query
def sft_wrong_path(spark, sf_dir):
    return _turns(exports.sft_conversations(fixtures.cases(spark, sf_dir), wrong_path=True))


@query
def export_training(spark, sf_dir):
    """All records, read back from their lines: what is told and what is answered in each phase."""
    lines = exports.export_training(_store(spark, sf_dir), min_accuracy=0.2, include_wrong_paths=True)
    shape = (
        "case_id string, steps array<struct<observation:struct<narrative:string,time_elapsed:string>>>, "
        "turns array<struct<role:string,content:string>>"
    )
    record = lines.select("type", F.from_json("line", shape).alias("r")).select("type", "r.*")
    steps = record.where("type = 'rl_episode'").select("type", "case_id", F.posexplode("steps").alias("pos", "s"))
    turns = record.where("type <> 'rl_episode'").select("type", "case_id", "turns", F.posexplode("turns").alias("at", "t"))
    told = turns.where("at % 2 = 0").select(
        "type", "case_id", (F.col("at") / 2).cast("int").alias("pos"), F.col("t.content").alias("said"),
        F.get("turns", F.col("at") + 1)["content"].alias("answered"),
    )
    return steps.select("type", "case_id", "pos", F.col("s.observation.narrative").alias("said"), F.col("s.observation.time_elapsed").alias("answered")).union(told)


@query
def case_decode(spark, sf_dir):
    """Stored cases, a tenth of them with broken JSON."""
    broken = F.when(F.col("case_id").cast("long") % 10 == 3, F.lit('{"case_id": ')).otherwise(F.col("case_json"))
    rows = _store(spark, sf_dir).withColumn("case_json", broken)
    good = case_ops.decode_cases(rows).select("case_id", F.lit(False).alias("unreadable"), "topic", F.size("phases").alias("phases"))
    bad = case_ops.unreadable_cases(rows)
    return good.unionByName(bad.select("case_id", F.lit(True).alias("unreadable")), allowMissingColumns=True)


# --- validation ------------------------------------------------------------------------


@query
def lab_flags(spark, sf_dir):
    values = validation.lab_values(fixtures.cases(spark, sf_dir))
    return validation.flag_labs(values, validation.lab_panels(spark)).select(
        "case_id", "phase_number", "panel", "name", "value", "flag"
    )


@query
def lab_conformance(spark, sf_dir):
    values = validation.lab_values(fixtures.cases(spark, sf_dir))
    return validation.check_lab_template(values, validation.lab_panels(spark)).select(
        "case_id", "phase_number", "panel", "name", "value", "unit", F.array_join("issues", "; ").alias("issues")
    )


def _all_labs(spark, sf_dir) -> DataFrame:
    """A value for every order line, over all components of the panels in turn; some with another unit or finer than allowed."""
    panels = validation.lab_panels(spark)
    order = Window.orderBy("panel_pos", "component_pos")
    numbered = panels.withColumn("at", F.row_number().over(order) - 1)
    lines = fixtures.table(spark, sf_dir, "lineitem").withColumn("at", ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 67).cast("int"))
    spread_ = (F.col("l_partkey") % 41 - 10) / 20.0 * (F.col("reference_high") - F.col("reference_low"))
    value = F.when(F.col("l_linenumber") % 2 == 0, F.round(F.col("reference_low") + spread_, 0)).otherwise(F.round(F.col("reference_low") + spread_, 4))
    unit = F.when(F.col("l_suppkey") % 9 == 0, F.lit("odd")).otherwise(F.col("unit"))
    return lines.join(numbered, "at").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "panel", F.col("component").alias("name"), value.alias("value"), unit.alias("unit")
    )


@query
def lab_flags_all(spark, sf_dir):
    flagged = validation.flag_labs(_all_labs(spark, sf_dir), validation.lab_panels(spark))
    return flagged.groupBy("panel", "name", "flag").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10000).cast("long")).alias("total"))


@query
def lab_conformance_all(spark, sf_dir):
    found = validation.check_lab_template(_all_labs(spark, sf_dir), validation.lab_panels(spark))
    return found.groupBy("panel", "name", F.array_join("issues", "; ").alias("issues")).agg(F.count("*").alias("n"))


@query
def lab_panels_used(spark, sf_dir):
    """Measured values per panel and component, with the panel's place and precision."""
    values = validation.lab_values(fixtures.cases(spark, sf_dir)).groupBy("panel", "name").agg(F.count("*").alias("n"))
    panels = validation.lab_panels(spark)
    return panels.join(values, (values.panel == panels.panel) & (values.name == panels.component), "left").select(
        panels.panel, "panel_pos", "component", "component_pos", "unit", "precision", F.coalesce("n", F.lit(0)).alias("n")
    )


@query
def imaging_terms(spark, sf_dir):
    return validation.check_imaging_terms(validation.imaging_studies(fixtures.cases(spark, sf_dir)))


@query
def imaging_regions(spark, sf_dir):
    return validation.check_body_region(validation.imaging_studies(fixtures.cases(spark, sf_dir)))


@query
def one_optimal(spark, sf_dir):
    return validation.check_one_optimal(fixtures.cases(spark, sf_dir))


@query
def difficulty_shape(spark, sf_dir):
    return validation.check_difficulty_shape(fixtures.cases(spark, sf_dir))


@query
def score_gate(spark, sf_dir):
    return validation.score_gate(fixtures.cases(spark, sf_dir))


@query
def offset_order(spark, sf_dir):
    return validation.check_offset_order(fixtures.cases(spark, sf_dir))


@query
def vitals_delta(spark, sf_dir):
    return validation.vitals_delta(fixtures.cases(spark, sf_dir))


@query
def vitals_jumps(spark, sf_dir):
    return validation.vitals_delta(fixtures.cases(spark, sf_dir), {"hr": 30, "spo2": 5}).select(
        "case_id", "phase_number", "hr_delta", "spo2_delta"
    )


@query
def repeat_action(spark, sf_dir):
    return validation.check_repeat_action(fixtures.cases(spark, sf_dir))


# --- grading -----------------------------------------------------------------------------


@query
def grade_answers(spark, sf_dir):
    return grading.grade_choices(fixtures.cases(spark, sf_dir), fixtures.answers(spark, sf_dir))


@query
def decision_classes(spark, sf_dir):
    return grading.decision_classes(fixtures.cases(spark, sf_dir))


# --- generation ----------------------------------------------------------------------------


def _contexts(spark, sf_dir) -> DataFrame:
    hits = search.retrieve_many(fixtures.knowledge(spark, sf_dir), fixtures.topic_vectors(spark, sf_dir))
    return search.contexts(hits, by=("topic",))


def _lab_context(spark) -> str:
    # the fixed panel table, one short text
    return validation.lab_context(validation.lab_panels(spark)).head()["lab_context"]


def _attempts(spark, sf_dir) -> DataFrame:
    """The orders of a customer as the rounds of its slot."""
    orders = fixtures.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("slot_id"), "o_orderkey")
    return recorded.rounds_of(orders)


def _replayed(spark, answers: DataFrame) -> rounds.Job:
    return rounds.Job(spark, None, "2024-01-01T00:00:00", recorded=answers)


@query
def generate_single_step(spark, sf_dir):
    job = _replayed(spark, recorded.single(_attempts(spark, sf_dir)))
    made = rounds.generate_single(job, fixtures.slots(spark, sf_dir), _contexts(spark, sf_dir))
    c = F.col("case")
    return made.cases.select(
        "slot_id", c["case_id"].alias("case_id"), c["topic"].alias("topic"), c["difficulty"].alias("difficulty"),
        c["vignette"].alias("vignette"), c["ground_truth"]["diagnosis"].alias("diagnosis"),
        c["metadata"]["retry_count"].alias("retry_count"), F.size(c["sources"]).alias("sources"),
        c["metadata"]["total_input_tokens"].alias("total_input_tokens"),
        c["metadata"]["total_output_tokens"].alias("total_output_tokens"),
        F.size(c["decision_tree"]).alias("choices"), c["review"]["approved"].alias("approved"),
    )


@query
def generate_single_step_summary(spark, sf_dir):
    job = _replayed(spark, recorded.single(_attempts(spark, sf_dir)))
    return rounds.generate_single(job, fixtures.slots(spark, sf_dir), _contexts(spark, sf_dir)).summary


@query
def generate_multi_step(spark, sf_dir):
    job = _replayed(spark, recorded.multi(_attempts(spark, sf_dir)))
    made = rounds.generate_multi(
        job, fixtures.slots(spark, sf_dir), _contexts(spark, sf_dir), _lab_context(spark)
    )
    c = F.col("case")
    return made.cases.select(
        "slot_id", c["topic"].alias("topic"), c["vignette"].alias("vignette"),
        c["ground_truth"]["optimal_next_step"].alias("optimal_next_step"), F.size(c["phases"]).alias("phases"),
        c["metadata"]["retry_count"].alias("retry_count"),
        c["metadata"]["total_input_tokens"].alias("total_input_tokens"),
        c["metadata"]["total_output_tokens"].alias("total_output_tokens"),
    )


@query
def prompt_requests(spark, sf_dir):
    opened, _ = rounds.open_slots(fixtures.slots(spark, sf_dir), _contexts(spark, sf_dir))
    asked = requests.case_requests(opened.withColumn("round", F.lit(0)))
    return asked.select("request_id", "slot_id", "stage", "round", "prompt", "schema_name")


@query
def make_slots(spark, sf_dir):
    topics = fixtures.table(spark, sf_dir, "customer").select(F.col("c_name").alias("topic"))
    return rounds.make_slots(topics, 4, "attending")


@query
def generate_to_export(spark, sf_dir):
    """Two slots for every customer as topic, cases made for them of its even and odd orders, saved and exported."""
    customers = fixtures.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("topic"))
    slot_id = F.concat_ws("|", "topic", F.lit("resident"), (F.col("o_orderkey") % 2).cast("string")).alias("slot_id")
    orders = fixtures.table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(slot_id, "o_orderkey")
    job = _replayed(spark, recorded.single(recorded.rounds_of(orders)))
    contexts = customers.select("topic", F.concat(F.lit("known of "), "topic").alias("context")).distinct().withColumn(
        "sources", F.array().cast(CASE["sources"].dataType))
    made = rounds.generate_single(job, rounds.make_slots(customers, 2), contexts)
    store = case_ops.case_table(spark, work_path(spark, "cases"))
    case_ops.upsert_cases(store, rounds.cases_of(made.cases))
    return case_ops.export_jsonl(store.read()).select(
        F.get_json_object("line", "$.topic").alias("topic"), F.get_json_object("line", "$.vignette").alias("vignette")
    )


@query
def plan_requests(spark, sf_dir):
    opened, _ = rounds.open_slots(fixtures.slots(spark, sf_dir), _contexts(spark, sf_dir))
    asked = requests.plan_requests(opened.withColumn("round", F.lit(0)).withColumn("plan_round", F.lit(0)))
    return asked.select("slot_id", "stage", "prompt", "schema_name")


def _written(spark, sf_dir) -> DataFrame:
    """Cases as slots with a writer's answer, the whole case and a plan of their own phases."""
    phase = F.struct(F.lit(1).alias("phase_number"), F.col("vignette").alias("correct_action"))
    blueprint = F.struct(F.col("ground_truth.diagnosis").alias("diagnosis"), F.array(phase).alias("phases"))
    writer = F.struct("vignette", "ground_truth").alias("writer")
    return fixtures.cases(spark, sf_dir).select(
        F.col("case_id").alias("slot_id"), F.lit(0).alias("round"), F.lit(0).alias("plan_round"), F.array().cast("array<string>").alias("notes"),
        "topic", "difficulty", F.concat(F.lit("known of "), "topic").alias("context"), writer, F.struct("case_id", "topic", "difficulty").alias("case"), F.struct(blueprint.alias("blueprint")).alias("plan"),
    )


def _prompts(asked: DataFrame) -> DataFrame:
    return asked.select("slot_id", "stage", "prompt", "schema_name")


@query
def tree_requests(spark, sf_dir):
    return _prompts(requests.tree_requests(_written(spark, sf_dir)))


@query
def review_requests(spark, sf_dir):
    return _prompts(requests.review_requests(_written(spark, sf_dir), 0.7))


@query
def blueprint_review_requests(spark, sf_dir):
    return _prompts(requests.blueprint_review_requests(_written(spark, sf_dir)))


@query
def phase_requests(spark, sf_dir):
    return _prompts(requests.render_requests(_written(spark, sf_dir), "LABS"))


@query
def consistency_requests(spark, sf_dir):
    phases = fixtures.cases(spark, sf_dir).select(
        F.col("case_id").alias("slot_id"), F.lit(0).alias("round"), F.lit(0).alias("check_pass"), "topic", "difficulty",
        F.posexplode(F.transform("phases", lambda p: F.struct(p["phase_number"].alias("n"), p["narrative"].alias("said")))).alias("pos", "phase"),
    )
    return _prompts(requests.consistency_requests(phases))


@query
def retry_prompts(spark, sf_dir):
    prompt = F.concat(F.lit("prompt "), "case_id")
    return fixtures.cases(spark, sf_dir).select(
        "case_id", prompts.retry_prompt(prompt, F.col("review.notes")).alias("prompt")
    )


@query
def difficulty_rules(spark, sf_dir):
    topics = fixtures.cases(spark, sf_dir).select(
        "case_id", F.when(F.col("topic") == "BUILDING", F.lit("expert")).otherwise(F.col("difficulty")).alias("difficulty")
    )
    return requests.difficulty_rules(topics, requests.difficulty_table(spark))


def _reviews(spark, sf_dir):
    return requests.parse_responses(fixtures.responses(spark, sf_dir), "review")


@query
def parse_responses(spark, sf_dir):
    valid, _ = _reviews(spark, sf_dir)
    return valid.select(
        "request_id", "slot_id", "round", F.col("data.accuracy_score").alias("accuracy_score"),
        F.col("data.approved").alias("approved"), F.col("data.notes")[0].alias("note"),
    )


@query
def rejected_responses(spark, sf_dir):
    _, bad = _reviews(spark, sf_dir)
    return bad.select("request_id", "payload")


_KEYS = {
    "case_writer": "data.ground_truth.diagnosis", "decision_tree": "data.decision_tree[1].outcome", "planner": "data.specialty[1]",
    "blueprint_review": "cast(data.approved as string)", "consistency": "data.issues[0].issue",
}


@query
def parse_stages(spark, sf_dir):
    """Answers of five more schemas, readable ones with a value from inside."""
    parts = []
    for schema, key in _KEYS.items():
        valid, bad = requests.parse_responses(fixtures.stage_answers(spark, sf_dir, schema), schema)
        parts.append(valid.select(F.lit(schema).alias("schema_name"), "request_id", F.lit(True).alias("valid"), F.expr(key).alias("value")))
        parts.append(bad.select(F.lit(schema).alias("schema_name"), "request_id", F.lit(False).alias("valid"), F.lit(None).cast("string").alias("value")))
    return rounds._union(parts)


@query
def parse_phases(spark, sf_dir):
    judged = requests.judged_responses(fixtures.answered_phases(spark, sf_dir), "phase")
    return judged.select("request_id", F.col("data.phase.narrative").alias("narrative"), F.when(F.col("valid"), F.size("data.phase.decisions")).alias("decisions"))


def _slot_rows(valid: DataFrame) -> DataFrame:
    return valid.select(
        "slot_id", "slot_seq", F.lit("topic").alias("topic"), F.lit("resident").alias("difficulty"), F.array().cast("array<string>").alias("notes"),
        (F.col("slot_seq") % 3).cast("int").alias("round"), F.array().cast(CASE["sources"].dataType).alias("sources"), "data", "model",
    )


@query
def assemble_single(spark, sf_dir):
    """Stored answers of writer and tree as cases."""
    writer, _ = requests.parse_responses(fixtures.stage_answers(spark, sf_dir, "case_writer"), "case_writer")
    tree, _ = requests.parse_responses(fixtures.stage_answers(spark, sf_dir, "decision_tree"), "decision_tree")
    rows = _slot_rows(writer).withColumnRenamed("data", "writer").withColumnRenamed("model", "writer_model")
    rows = rows.join(tree.select("slot_id", F.col("data").alias("tree")), "slot_id")
    c = F.col("case")
    return rounds.assemble_single(rows, "2024-01-01").select(
        "slot_id", c["case_id"].alias("case_id"), c["vignette"].alias("vignette"), c["patient"]["age"].alias("age"),
        c["ground_truth"]["diagnosis"].alias("diagnosis"), c["decision_tree"][1]["outcome"].alias("second_outcome"),
        F.size(c["complications"]).alias("complications"), c["metadata"]["retry_count"].alias("retry_count"), c["metadata"]["model"].alias("model"),
    )


def _planned(spark, sf_dir) -> DataFrame:
    plans, _ = requests.parse_responses(fixtures.stage_answers(spark, sf_dir, "planner"), "planner")
    return _slot_rows(plans).withColumnRenamed("data", "plan").drop("model")


@query
def assemble_multi(spark, sf_dir):
    """Stored plans with the stored phases of the same order as cases."""
    valid, _ = requests.parse_responses(fixtures.answered_phases(spark, sf_dir), "phase")
    phases = rounds.collect_phases(valid.select("slot_id", "pos", F.col("data.phase").alias("phase"), "model"))
    good, _ = rounds.reject_empty_blueprints(_planned(spark, sf_dir))
    c = F.col("case")
    return rounds.assemble_multi(good.join(phases, "slot_id"), "2024-01-01").select(
        "slot_id", c["vignette"].alias("vignette"), c["ground_truth"]["diagnosis"].alias("diagnosis"),
        c["ground_truth"]["optimal_next_step"].alias("optimal_next_step"), F.size(c["phases"]).alias("phases"),
        F.size(c["blueprint"]["phases"]).alias("planned"), c["specialty"][1].alias("specialty"), c["metadata"]["multi_step"].alias("multi_step"),
    )


@query
def empty_plans(spark, sf_dir):
    _, empty = rounds.reject_empty_blueprints(_planned(spark, sf_dir))
    return empty.select("slot_id", F.array_join("notes", "; ").alias("notes"))


@query
def affected_phases(spark, sf_dir):
    """Planned phases that stored consistency answers name."""
    issues, _ = requests.parse_responses(fixtures.stage_answers(spark, sf_dir, "consistency"), "consistency")
    found = rounds.affected_phases(_planned(spark, sf_dir), issues.select("slot_id", F.col("data.issues").alias("issues")))
    return found.select("slot_id", "pos", F.col("planned.correct_action").alias("action"))


def _latest_reviews(spark, sf_dir) -> DataFrame:
    valid, _ = _reviews(spark, sf_dir)
    return latest_per_key(valid, "slot_id", [F.col("slot_seq")])


def _gated(spark, sf_dir):
    slots = fixtures.slots(spark, sf_dir).select(
        "slot_id", F.array(F.lit("old note")).alias("notes"), F.struct("topic", F.lit(None).alias("review")).alias("case")
    )
    return rounds.review_gate(slots, _latest_reviews(spark, sf_dir))


@query
def review_gate(spark, sf_dir):
    approved, _ = _gated(spark, sf_dir)
    return approved.select(
        "slot_id", F.col("case.topic").alias("topic"), F.col("case.review.accuracy_score").alias("accuracy_score")
    )


@query
def retry_round(spark, sf_dir):
    _, pending = _gated(spark, sf_dir)
    return pending.select("slot_id", F.array_join("notes", "; ").alias("notes"))


def _phase_rows(spark, sf_dir) -> DataFrame:
    rows = fixtures.cases(spark, sf_dir).select("case_id", F.posexplode("phases").alias("pos", "phase"))
    return rows.select(F.col("case_id").alias("slot_id"), "pos", "phase", F.lit("m").alias("model"))


@query
def rerender_phases(spark, sf_dir):
    """Phases without decisions written anew."""
    phases = _phase_rows(spark, sf_dir)
    new = phases.where(F.size("phase.decisions") == 0).withColumn(
        "phase", F.col("phase").withField("narrative", F.concat(F.lit("new "), "phase.narrative"))
    )
    return rounds.rerender(phases, new).select("slot_id", "pos", F.col("phase.narrative").alias("narrative"))


@query
def collect_phases(spark, sf_dir):
    gathered = rounds.collect_phases(_phase_rows(spark, sf_dir))
    vignette = F.array_join(F.transform("phases", lambda p: p["narrative"]), "\n\n")
    return gathered.select("slot_id", vignette.alias("vignette"), F.size("phases").alias("phases"), "phase_model")


@query
def batch_summary(spark, sf_dir):
    approved, pending = _gated(spark, sf_dir)
    calls = fixtures.responses(spark, sf_dir).select("slot_id", "input_tokens", "output_tokens")
    return rounds.batch_summary(approved, pending, calls)


@query
def running_tokens(spark, sf_dir):
    calls = fixtures.responses(spark, sf_dir)
    return rounds.running_tokens(calls).select(
        "request_id", "running_input_tokens", "running_output_tokens"
    )


@query
def lab_context(spark, sf_dir):
    """The lab text with the number of measured values it has to explain."""
    values = validation.lab_values(fixtures.cases(spark, sf_dir)).agg(F.count("*").alias("values"))
    return values.select(F.lit(_lab_context(spark)).alias("lab_context"), "values")


# --- streaming -------------------------------------------------------------------------------


def _streamed(spark, sf_dir, name, to_documents) -> tuple[DataFrame, str]:
    folder = work_path(spark, "stream")
    kb = knowledge.knowledge_table(spark, f"{folder}/kb")
    run = ingest.ingest_documents(
        fixtures.stream(spark, sf_dir, name), to_documents, kb, f"{folder}/state", f"{folder}/progress"
    )
    run.awaitTermination()
    return kb.read(), f"{folder}/progress"


@query
def stream_ingest(spark, sf_dir):
    def to_documents(batch):
        return registry.normalize(fixtures.as_web_payloads(batch), "firecrawl")

    stored, _ = _streamed(spark, sf_dir, "pages", to_documents)
    return stored.select("chunk_id", "source_document_id", "source", "position", "text")


def _landed_files(spark, payloads: DataFrame, files: int) -> str:
    """Payloads as files of a folder, several to a file and one line each."""
    folder = work_path(spark, "landed")
    payloads.repartition(files).write.text(folder)
    return folder


def _streamed_labels(spark, sf_dir):
    """Labels that land as files and come in several micro-batches; one file lands twice."""
    folder = work_path(spark, "stream")
    landed = _landed_files(spark, fixtures.dailymed_payloads(spark, sf_dir).select("payload"), 6)
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 2).load(landed).withColumnRenamed("value", "payload")
    kb = knowledge.knowledge_table(spark, f"{folder}/kb")
    for state in ("first", "again"):  # the second run has lost its state and sees all files anew
        run = ingest.ingest_source(stream, registry.source("dailymed"), kb, f"{folder}/{state}", f"{folder}/progress", f"{folder}/quarantine")
        run.awaitTermination()
    return kb, folder


@query
def stream_labels(spark, sf_dir):
    kb, _ = _streamed_labels(spark, sf_dir)
    return kb.read().select("source_document_id", "position", "text")


@query
def stream_quarantine(spark, sf_dir):
    _, folder = _streamed_labels(spark, sf_dir)
    rows = ingest.read_quarantine(spark, f"{folder}/quarantine")
    return rows.select("source", F.regexp_extract("payload", 'root="([^"]*)"', 1).alias("label"))


@query
def stream_batches(spark, sf_dir):
    """Totals over several micro-batches."""
    _, folder = _streamed_labels(spark, sf_dir)
    rows = ingest.read_progress(spark, f"{folder}/progress").where("is_total")
    return rows.agg(F.count_distinct("batch_id").alias("batches"), F.sum("documents").alias("documents"))


@query
def stream_versions(spark, sf_dir):
    """Documents in three deliveries, with a restart between: newer abstracts come before, after and between older ones."""
    folder = work_path(spark, "stream")
    documents = _unsourced(fixtures.documents(spark, sf_dir))
    third = F.when(F.col("content_type") == "abstract", F.col("source_id").cast("long") % 3).otherwise(F.lit(2))
    newer = documents.withColumn("content", F.concat("content", F.lit(" again"))).withColumn(
        "metadata", F.col("metadata").withField("publication_date", F.date_add("metadata.publication_date", 1))
    )
    deliveries = [
        newer.where(third == 0).unionByName(documents.where(third > 0)),
        documents.where(third == 0).unionByName(newer.where(third == 1)),
        documents.where(third < 2),
    ]
    kb = knowledge.knowledge_table(spark, f"{folder}/kb")
    for delivery in deliveries:
        delivery.write.mode("append").parquet(f"{folder}/landed")
        stream = spark.readStream.schema(DOCUMENT).parquet(f"{folder}/landed")
        ingest.ingest_versions(stream, lambda landed: landed, kb, f"{folder}/state").awaitTermination()
    return _stored_chunks(kb.read())


@query
def stream_progress(spark, sf_dir):
    _, path = _streamed(spark, sf_dir, "documents", fixtures.as_documents)
    return ingest.read_progress(spark, path)
