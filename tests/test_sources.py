import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from wardloom.reference_data import SOURCE_CAPS
from wardloom.sources import articles, drugs, registry, trials
from wardloom.sources.base import Source

PUBMED = """<?xml version="1.0"?>
<PubmedArticleSet>
 <PubmedArticle><MedlineCitation><PMID Version="1">11</PMID>
  <Article><Journal><JournalIssue><PubDate><Year>2023</Year><Month>Feb</Month><Day>31</Day></PubDate></JournalIssue></Journal>
   <ArticleTitle>Effect at p &lt; 0.05 &amp; more</ArticleTitle>
   <ELocationID EIdType="pii">x1</ELocationID><ELocationID EIdType="doi">10.1/abc</ELocationID>
   <Abstract><AbstractText Label="AIM">To see.</AbstractText><AbstractText>Plain &gt; labelled.</AbstractText><AbstractText Label="END"/></Abstract>
   <AuthorList><Author><LastName>Roe</LastName><ForeName>Ann</ForeName></Author><Author><LastName>Solo</LastName></Author>
    <Author><CollectiveName>The Group</CollectiveName></Author><Author><ForeName>Nameless</ForeName></Author></AuthorList>
  </Article><PublicationTypeList><PublicationType UI="D1">Practice Guideline</PublicationType></PublicationTypeList>
 </MedlineCitation></PubmedArticle>
 <PubmedArticle><MedlineCitation><PMID>12</PMID>
  <Article><Journal><JournalIssue><PubDate><Year>2022</Year><Month>07</Month></PubDate></JournalIssue></Journal>
   <ArticleTitle>Before <i>inside</i> after</ArticleTitle>
   <Abstract><AbstractText Label="RESULT">CO<sub>2</sub> rose</AbstractText></Abstract>
   <PublicationTypeList><PublicationType>Guideline</PublicationType></PublicationTypeList>
  </Article></MedlineCitation></PubmedArticle>
 <PubmedArticle><MedlineCitation><PMID>13</PMID></MedlineCitation></PubmedArticle>
 <PubmedArticle><PubmedData/></PubmedArticle>
 <PubmedArticle><MedlineCitation><PMID>14</PMID>
  <Article><Journal><JournalIssue><PubDate><Year>soon</Year></PubDate></JournalIssue></Journal><ArticleTitle>T</ArticleTitle></Article>
 </MedlineCitation></PubmedArticle>
 <PubmedArticle><MedlineCitation><PMID>15</PMID><Article><ArticleTitle/></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""


def landed(spark, *payloads):
    rows = [(p if isinstance(p, str) else json.dumps(p),) for p in payloads]
    return spark.createDataFrame(rows, "payload string")


def by_id(df):
    return {r["source_id"]: r for r in df.collect()}


def test_pubmed(spark):
    df = landed(spark, PUBMED, "<broken")
    docs = by_id(registry.normalize(df, "pubmed"))
    assert set(docs) == {"11", "12", "15"}
    first = docs["11"]
    assert first["title"] == "Effect at p < 0.05 & more"
    assert first["content"] == "AIM: To see.\n\nPlain > labelled.\n\nEND: "
    assert first["content_type"] == "abstract"
    meta = first["metadata"]
    assert meta["authors"] == ["Roe Ann", "Solo", "The Group"]
    assert meta["publication_date"] == date(2023, 2, 1)
    assert meta["credibility"] == "guideline"
    assert (meta["doi"], meta["url"]) == ("10.1/abc", "https://pubmed.ncbi.nlm.nih.gov/11/")
    second = docs["12"]
    assert (second["title"], second["content"]) == ("Before ", "RESULT: CO")
    assert second["metadata"]["publication_date"] == date(2022, 1, 1)
    assert second["metadata"]["credibility"] == "peer_reviewed"
    assert second["metadata"]["authors"] == [] and second["metadata"]["doi"] is None
    assert docs["15"]["title"] == "" and docs["15"]["metadata"]["publication_date"] is None
    both = by_id(articles.PUBMED_BOTH_TYPE_PLACES.normalize(df))
    assert both["12"]["metadata"]["credibility"] == "guideline"
    set_aside = [r["payload"] for r in registry.rejected(df, "pubmed").collect()]
    assert set_aside[0] == "<broken" and len(set_aside) == 2 and '"soon"' in set_aside[1]
    assert [r["source_id"] for r in articles.unreadable_years(df).collect()] == ["14"]


def test_article_exports_are_read_in_pieces(spark, tmp_path):
    (tmp_path / "export.xml").write_text(PUBMED)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        df = articles.landed_articles(spark, str(tmp_path / "export.xml"))
        assert df.rdd.getNumPartitions() > 2
        whole = registry.normalize(landed(spark, PUBMED), "pubmed")
        key = lambda d: sorted(map(repr, d.collect()))
        assert key(registry.normalize(df, "pubmed")) == key(whole)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_labels_without_listing_name_themselves(spark):
    xml = '<document xmlns="urn:hl7-org:v3"><setId root="q1"/><title> My <b>label</b> </title><section><code code="34084-4"/><text>x</text></section></document>'
    doc = registry.normalize(landed(spark, xml, '<!DOCTYPE d [<!ENTITY a "b">]><d/>'), "dailymed").collect()
    assert [(d["source_id"], d["title"]) for d in doc] == [("q1", "My label")]


def test_openfda(spark):
    full = {
        "set_id": "s1", "effective_time": "20230115",
        "openfda": {"brand_name": ["Brandol", "x"], "generic_name": ["genericum"], "manufacturer_name": ["Maker"]},
        "boxed_warning": ["Careful."], "indications_and_usage": ["For pain.", "ignored"], "warnings": "[plain] text",
    }
    brand = {"set_id": "s2", "openfda": {"brand_name": ["OnlyBrand"]}, "effective_time": "20239999", "warnings": []}
    neither = {"set_id": "s3", "effective_time": "2023"}
    docs = by_id(registry.normalize(landed(spark, {"results": [full, brand]}, {"results": [neither]}, {}), "openfda"))
    assert docs["s1"]["title"] == "Brandol (genericum)"
    assert docs["s1"]["content"] == "INDICATIONS AND USAGE\nFor pain.\n\nWARNINGS\n[plain] text\n\nBOXED WARNING\nCareful."
    assert docs["s1"]["metadata"]["publication_date"] == date(2023, 1, 15)
    assert docs["s1"]["metadata"]["authors"] == ["Maker"]
    assert docs["s1"]["metadata"]["url"].endswith("setid=s1")
    assert (docs["s2"]["title"], docs["s2"]["content"]) == ("OnlyBrand", "")
    assert docs["s2"]["metadata"]["publication_date"] is None
    assert docs["s3"]["title"] == "s3" and docs["s3"]["metadata"]["authors"] == []


def test_dailymed(spark):
    xml = """<document xmlns="urn:hl7-org:v3"><component><structuredBody>
      <section><code code="34084-4"/><text> Nausea <b>and</b> rash </text>
        <section><code code="34088-5"/><text>Too much</text></section></section>
      <section><code code="00000-0"/><text>unknown</text></section>
      <section><code code="34067-9"/><text>  </text></section>
      <section><text>no code</text></section>
    </structuredBody></component></document>"""
    df = spark.createDataFrame([("a", "Label A", xml), ("b", "Label B", "<oops")], "setid string, title string, payload string")
    docs = by_id(registry.normalize(df, "dailymed"))
    assert set(docs) == {"a"}
    assert docs["a"]["content"] == "ADVERSE REACTIONS\nNausea and rash\n\nOVERDOSAGE\nToo much"
    assert docs["a"]["title"] == "Label A" and docs["a"]["metadata"]["credibility"] == "fda_label"
    assert registry.rejected(df, "dailymed").count() == 1
    listing = drugs.dailymed_listing(landed(spark, {"data": [{"setid": "a", "title": "Label A", "spl_version": 3}]}))
    assert [tuple(r) for r in listing.collect()] == [("a", "Label A")]


def test_rxnorm_limit_crosses_groups(spark):
    group = lambda *ids: {"tty": "SCD", "conceptProperties": [{"rxcui": i, "name": f"n{i}", "tty": "SCD"} for i in ids]}
    answer = {"drugGroup": {"conceptGroup": [group("1", "2"), {"tty": "BN"}, group("3", "4")]}}
    docs = by_id(drugs.rxnorm(3).normalize(landed(spark, answer)))
    assert set(docs) == {"1", "2", "3"}
    assert docs["3"]["content"] == "Drug: n3\nRxCUI: 3\nTerm Type: SCD"
    one = spark.createDataFrame([("9", json.dumps({"properties": {"name": "nine", "tty": "IN"}}))], "rxcui string, payload string")
    assert by_id(drugs.normalize_rxnorm_properties(one))["9"]["content"] == "Drug: nine\nRxCUI: 9\nTerm Type: IN"


def test_medrxiv(spark):
    item = {"doi": "10.1/x", "title": "T", "authors": " A, B ; ; C ", "date": "2024-03-05", "abstract": "Abs", "category": "cardiology"}
    bad = {"doi": "10.1/y", "title": "U", "authors": "", "date": "someday", "abstract": "Z", "category": ""}
    docs = by_id(registry.normalize(landed(spark, {"collection": [item, bad]}), "medrxiv"))
    assert docs["10.1/x"]["metadata"]["authors"] == ["A, B", "C"]
    assert docs["10.1/x"]["metadata"]["publication_date"] == date(2024, 3, 5)
    assert docs["10.1/x"]["metadata"]["specialty"] == ["cardiology"]
    assert docs["10.1/y"]["metadata"]["publication_date"] is None and docs["10.1/y"]["metadata"]["specialty"] == []


def test_trials(spark):
    full = {"protocolSection": {
        "identificationModule": {"nctId": "N1", "briefTitle": "Brief", "officialTitle": "Official"},
        "statusModule": {"overallStatus": "RECRUITING"}, "designModule": {"phases": ["PHASE1", "PHASE2"]},
        "eligibilityModule": {"eligibilityCriteria": "Adults", "minimumAge": "18 Years"},
        "armsInterventionsModule": {"interventions": [{"type": "DRUG", "name": "X", "description": "daily"}]},
        "outcomesModule": {"primaryOutcomes": [{"measure": "Death", "timeFrame": "1y"}], "secondaryOutcomes": []},
    }}
    bare = {"protocolSection": {"identificationModule": {"nctId": "N2", "officialTitle": "Only official"}}}
    docs = by_id(registry.normalize(landed(spark, {"studies": [full, bare]}), "clinicaltrials"))
    assert docs["N1"]["content"] == (
        "Title: Brief\n\nNCT ID: N1\n\nStatus: RECRUITING\n\nPhase: PHASE1, PHASE2\n\n"
        "Eligibility (Age: 18 Years - ):\nAdults\n\nInterventions:\n- DRUG: X — daily\n\nPrimary Outcomes:\n- Death (1y)"
    )
    assert docs["N2"]["content"] == "Title: Only official\n\nNCT ID: N2\n\nStatus: Unknown"
    assert by_id(trials.normalize_studies(landed(spark, full)))["N1"]["title"] == "Brief"


def test_curated_fulltext_web(spark):
    curated = by_id(registry.normalize(landed(spark, {"results": [{"id": "g1", "title": "G", "content": "c", "category": "k"}, {"id": "g2"}]}), "glass"))
    assert curated["g1"]["metadata"]["specialty"] == ["k"] and curated["g2"]["metadata"]["specialty"] == []
    full = by_id(registry.normalize(landed(spark, {"results": [{"id": "f1", "author": "A; B", "content": "c", "doi": "d"}, {"id": "f2", "author": ""}]}), "annas_archive"))
    assert full["f1"]["metadata"]["authors"] == ["A", "B"] and full["f2"]["metadata"]["authors"] == []
    assert full["f1"]["content_type"] == "full_text"
    web = by_id(registry.normalize(landed(spark, {"data": [{"url": "u1", "markdown": "# m"}, {"url": "u2", "title": "T"}]}), "firecrawl"))
    assert (web["u1"]["title"], web["u1"]["content"]) == ("u1", "# m") and web["u2"]["title"] == "T"
    scraped = spark.createDataFrame([("u3", json.dumps({"data": {"markdown": "x"}}))], "url string, payload string")
    assert by_id(articles.normalize_scrapes(scraped))["u3"]["title"] == "u3"


def test_bad_source_leaves_others(spark):
    both = registry.normalize_all({"medrxiv": landed(spark, "{"), "firecrawl": landed(spark, {"data": [{"url": "u"}]})})
    assert [r["source"] for r in both.collect()] == ["firecrawl"]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "source string, source_id string, title string, content string")


def test_limits_and_filters(spark):
    rows = [("hot", str(i), f"t{i}", "c") for i in range(500)] + [("cold", "1", "Title STROKE", "c")]
    docs = _docs(spark, rows)
    limited = registry.limit_per_source(docs, 20, F.col("source_id").cast("int"), salts=4)
    kept = sorted(int(r["source_id"]) for r in limited.collect() if r["source"] == "hot")
    assert kept == list(range(20)) and limited.count() == 21
    many = docs.withColumn("source", F.when(F.col("source") == "hot", F.lit("openfda")).otherwise(F.col("source")))
    assert registry.limit_per_source(many, 300, caps=SOURCE_CAPS).count() == 101
    assert registry.limit_per_source(many, 300).count() == 301
    assert registry.filter_sources(docs, ["cold", "none"]).count() == 1
    assert registry.filter_sources(docs, None).count() == 501
    assert registry.match_any_term(docs, "xyz stroke").count() == 1
    assert registry.match_any_term(docs, "  ").count() == 0
    assert registry.get_document(docs, "cold", "1").count() == 1
    assert registry.get_document(docs, "cold", "2").count() == 0


def test_register_source(spark):
    from wardloom.sources.base import document, parsed_json

    source = Source(
        "mine", lambda p: parsed_json(p, "id string"),
        lambda parsed: parsed.select(*document("mine", F.col("parsed.id"), F.lit("t"), F.lit("c"), "note", "curated")),
    )
    registry.register_source(source)
    assert [r["source_id"] for r in registry.normalize(landed(spark, {"id": "7"}, "x"), "mine").collect()] == ["7"]
    wrong = Source("wrong", lambda p: parsed_json(p, "id string"), lambda parsed: parsed.select("parsed.id"))
    with pytest.raises(ValueError):
        wrong.normalize(landed(spark, {"id": "7"}))


def test_payloads_of_whole_texts(spark, tmp_path):
    """Line breaks, marks and long texts go through the parsing of articles, labels and preprints."""
    text = "first <b> & line\nsecond \"line\"\n\n" + "x &amp; y > z\n" * 12_000 + "last"
    spark.createDataFrame([(1, text, "src", "en")], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    said = {
        "pubmed": (fixtures.pubmed_payloads, f"AIM: a1\n\n{text}"), "openfda": (fixtures.openfda_payloads, f"WARNINGS\n{text}"),
        "dailymed": (fixtures.dailymed_payloads, f"ADVERSE REACTIONS\n{text} end\n\nDESCRIPTION\ndescribed"), "medrxiv": (fixtures.medrxiv_payloads, text),
    }
    for source, (payloads, content) in said.items():
        landed_ = payloads(spark, str(tmp_path))
        assert [r["content"] for r in registry.normalize(landed_, source).collect()] == [content], source


def test_labels_are_cut_in_pieces_that_hold_few_texts():
    import tracemalloc

    import pyarrow as pa

    body = "long text " * 2_000
    label = f'<document xmlns="urn:hl7-org:v3"><section><code code="34084-4"/><text> {body}</text></section></document>'
    payloads = pa.array([label, None, "<broken", "<!DOCTYPE d>" + label] * 200)
    tracemalloc.start()
    found = drugs._sections_in_pieces(payloads)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found.null_count == 600 and found[0].as_py() == [{"code": "34084-4", "text": body.strip()}]
    assert most < 40 * len(label)  # of 200 labels
    assert drugs._sections_in_pieces(payloads.slice(0, 0)).to_pylist() == []
