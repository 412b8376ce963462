import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wardloom.functions.dates import offset_minutes, pubmed_date
from wardloom.functions.text import WHITESPACE, float_text, preview, strip
from wardloom.operators.chunking import chunk, split_by_size, split_sections
from wardloom.operators.tagging import tag_specialty, tag_with_table
from wardloom.reference_data import DRUG_LABEL_HEADERS, SPECIALTY_KEYWORDS

META = "struct<authors:array<string>,publication_date:date,specialty:array<string>,credibility:string,url:string,doi:string>"


def documents(spark, *rows):
    df = spark.createDataFrame(list(rows), "source string, source_id string, content string, content_type string")
    meta = F.struct(
        F.array(F.lit("A")), F.lit(None), F.array(F.lit("zeta"), F.lit("alpha")), F.lit("curated"), F.lit(None), F.lit(None)
    ).cast(META)
    return df.withColumn("title", F.lit("t")).withColumn("metadata", meta)


def by_rule(content, size, overlap):
    """The size rule in plain Python."""
    paragraphs = [p for p in (x.strip() for x in re.split(r"\n\n+", content)) if p]
    out, held = [], []
    for p in paragraphs:
        if held and sum(map(len, held)) + len(p) > size:
            out.append("\n\n".join(held))
            keep = len(held)
            while keep > 0 and sum(map(len, held[keep - 1 :])) <= overlap:
                keep -= 1
            held = held[keep:]
        held.append(p)
    return out + ["\n\n".join(held)] if held else [content]


@pytest.mark.parametrize("size,overlap", [(500, 50), (60, 40), (60, 0), (30, 100)])
def test_size_split_is_the_rule(spark, size, overlap):
    rng = random.Random(size + overlap)
    texts = ["", "  \n\n ", "one"]
    for _ in range(150):
        parts = ["é" * rng.randint(0, 45) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 14))]
        texts.append(rng.choice(["\n\n", "\n\n\n", "\n \n"]).join(parts))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_by_size(F.col("t"), size, overlap).alias("c"))
    for r in rows.collect():
        assert r["c"] == by_rule(r["t"], size, overlap), r["t"]


def test_sections(spark):
    text = "intro\nWARNINGS\nbe careful\nWARNINGS AND PRECAUTIONS\nmore\nnot WARNINGS here\nBOXED WARNING\nstays\nOVERDOSAGE"
    texts = [text, "no header at all", "WARNINGS\n", "\n \nDESCRIPTION\nx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", split_sections(F.col("t"), DRUG_LABEL_HEADERS).alias("c")).collect()}
    assert got[0] == [
        "intro\n", "WARNINGS\n\nbe careful\n",
        "WARNINGS AND PRECAUTIONS\n\nmore\nnot WARNINGS here\nBOXED WARNING\nstays\n", "OVERDOSAGE\n",
    ]
    assert got[1] == ["no header at all"]
    assert got[2] == ["WARNINGS\n\n"]
    assert got[3] == ["DESCRIPTION\n\nx"]


def test_chunks(spark):
    docs = documents(
        spark,
        ("p", "1", "Sentence one. Sentence two.\n\nEnd.", "abstract"),
        ("d", "2", "INDICATIONS AND USAGE\nA\nCONTRAINDICATIONS\nB\nADVERSE REACTIONS\nC", "drug_label"),
        ("t", "3", "Title: x\n\nInterventions:\n- y", "trial_protocol"),
        ("e", "4", "  ", "abstract"),
        ("f", "5", "a\n\nb", "other"),
    )
    rows = chunk(docs, 1, 0).collect()
    again = chunk(docs, 1, 0).collect()
    assert sorted(r["chunk_id"] for r in rows) == sorted(r["chunk_id"] for r in again)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["source_document_id"], []).append(r)
    assert [r["text"] for r in by_doc["p:1"]] == ["Sentence one. Sentence two.\n\nEnd."]
    assert [r["text"][:5] for r in sorted(by_doc["d:2"], key=lambda r: r["position"])] == ["INDIC", "CONTR", "ADVER"]
    assert len(by_doc["t:3"]) == 1 and "e:4" not in by_doc
    assert [(r["position"], r["text"]) for r in sorted(by_doc["f:5"], key=lambda r: r["position"])] == [(0, "a"), (1, "b")]
    assert by_doc["f:5"][0]["metadata"]["credibility"] == "curated"
    assert hashlib.sha256(b"d:2:1").hexdigest() in {r["chunk_id"] for r in rows}


def tags_of(df):
    return {r["chunk_id"]: r["metadata"]["specialty"] for r in df.collect()}


def chunks_of(spark, texts):
    docs = documents(spark, *[("s", str(i), t, "abstract") for i, t in enumerate(texts)])
    return chunk(docs).withColumn("chunk_id", F.col("source_document_id"))


def by_keyword(text, table):
    return {s for s, words in table.items() if any(w in text.lower() for w in words)}


def test_tags_match_a_plain_search(spark):
    rng = random.Random(3)
    words = [w for listed in SPECIALTY_KEYWORDS.values() for w in listed]
    texts = ["nothing here", "A difficult crash", "Craniotomy done", "cardiac surgeryneurosurgical"]
    texts += ["".join(rng.choice([w, w[:-1], w.upper(), "x", " "]) for w in rng.choices(words, k=12)) or "x" for _ in range(120)]
    got = tags_of(tag_specialty(chunks_of(spark, texts)))
    for i, text in enumerate(texts):
        found = by_keyword(text, SPECIALTY_KEYWORDS)
        wanted = sorted(found | {"zeta", "alpha"}) if found else ["zeta", "alpha"]
        assert got[f"s:{i}"] == wanted, text


def test_whole_words(spark):
    texts = ["a difficult crash", "in the ICU, rash", "cardiac surgery", "cardiacs"]
    got = tags_of(tag_specialty(chunks_of(spark, texts), whole_words=True))
    assert got["s:0"] == ["zeta", "alpha"]
    assert got["s:1"] == ["alpha", "critical_care", "dermatology", "zeta"]
    assert got["s:2"] == ["alpha", "cardiology", "cardiothoracic_surgery", "zeta"]
    assert got["s:3"] == ["zeta", "alpha"]


def test_keyword_table_broadcast_and_shuffled(spark):
    rng = random.Random(5)
    table = {f"g{g}": ["".join(rng.choices("abcé. ", k=rng.randint(1, 6))) for _ in range(15)] for g in range(5)}
    table["hot"] = ["a"]
    texts = ["".join(rng.choices("abcéX. ", k=rng.randint(1, 40))) + "q" for _ in range(100)]
    chunks = chunks_of(spark, texts)
    rows = [(s, w) for s, words in table.items() for w in words] + [("none", "")]
    keywords = spark.createDataFrame(rows, "specialty string, keyword string")
    plan = tag_with_table(chunks, keywords)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    literal, sliced = tags_of(tag_with_table(chunks, keywords)), tags_of(tag_with_table(chunks, keywords, small=0))
    assert literal == sliced
    for row in chunks.collect():
        found = by_keyword(row["text"], table)
        wanted = sorted(found | {"zeta", "alpha"}) if found else ["zeta", "alpha"]
        assert literal[row["chunk_id"]] == wanted


def test_runs_meet_their_keywords_beside_the_text(spark):
    table = {f"g{g:03d}": [f"w{g:03d}"] for g in range(150)} | {"hot": ["w00", "w14"]}
    texts = ["w000 and w064", "w063 W149", "nothing", "w000 and w064", " ".join(f"w{g:03d}" for g in range(150))]
    chunks = chunks_of(spark, texts)
    keywords = spark.createDataFrame([(s, w) for s, words in table.items() for w in words], "specialty string, keyword string")
    tagged = tag_with_table(chunks, keywords)
    text = tagged._jdf.queryExecution().executedPlan().toString()
    # neither candidates nor chunks are sorted, and no text is carried through a shuffle but the chunks' own
    assert "SortMergeJoin [_key" not in text and "ShuffledHashJoin [_key" in text
    assert all("_text" not in line for line in text.split("\n") if "Exchange hashpartitioning" in line)
    tags = tags_of(tagged)
    for i, said in enumerate(texts):
        found = by_keyword(said, table)
        assert tags[f"s:{i}"] == (sorted(found | {"zeta", "alpha"}) if found else ["zeta", "alpha"])


def test_a_large_keyword_table_meets_texts_in_blocks(spark):
    rng = random.Random(6)
    table = {f"g{g}": ["".join(rng.choices("abcé\U0001f600. ", k=rng.randint(1, 6))) for _ in range(15)] for g in range(5)}
    texts = ["".join(rng.choices("abcéX\U0001f600. ", k=rng.randint(1, 40))) + "q" for _ in range(60)]
    chunks = chunks_of(spark, texts)
    keywords = spark.createDataFrame([(s, w) for s, words in table.items() for w in words], "specialty string, keyword string")
    tagged = tag_with_table(chunks, keywords, small=0, word_slice=20, text_block=300)
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    # only a sample of texts is cut into runs that are joined; texts and keywords meet in groups
    assert "FlatMapCoGroupsInArrow" in plan and plan.count("(?s)(?=(.") == 5
    tags = tags_of(tagged)
    for row in chunks.collect():
        found = by_keyword(row["text"], table)
        assert tags[row["chunk_id"]] == (sorted(found | {"zeta", "alpha"}) if found else ["zeta", "alpha"])


def test_rows_of_one_id_keep_their_own_tags(spark):
    chunks = chunks_of(spark, ["a stroke", "a kidney"]).withColumn("chunk_id", F.lit("same"))
    keywords = spark.createDataFrame([("neuro", "stroke"), ("nephro", "kidney"), (None, "a"), ("x", None)], "specialty string, keyword string")
    tags = sorted(sorted(set(r["metadata"]["specialty"]) & {"neuro", "nephro"}) for r in tag_with_table(chunks, keywords).collect())
    assert tags == [["nephro"], ["neuro"]]
    assert tag_with_table(chunks, keywords.where("false")).count() == 2


def test_float_text(spark):
    values = [0.0, -0.0, 98.0, 36.6, 1e-3, 1e-4, 1.5e-4, 1e-5, -2.5e-5, 1.25e-7, 9999999.0, 1e7, 12345678.9, 1e15, 1e16, 1.5e16, 1e100, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", float_text(F.col("v")).alias("t")).collect():
        assert r["t"] == repr(r["v"])


def test_small_expressions(spark):
    df = spark.createDataFrame([("T+0", 0.0), ("T+1h30min", 90.0), ("T+2d", 2880.0), ("later", None), ("T+30sec", 0.5), ("T+1w", None),
                                ("T+1.5h", 90.0), ("t + 90 minutes", 90.0), ("T+", None), ("T+2 days 1 hr", 2940.0), ("T+1h30", None), (None, None)], "t string, m double")
    assert all(r["m"] == r["got"] for r in df.select("m", offset_minutes(F.col("t")).alias("got")).collect())
    one = spark.createDataFrame([(WHITESPACE + "a b" + WHITESPACE, "x" * 201, "2024", "FEB", "x")], "s string, l string, y string, m string, d string")
    row = one.select(strip(F.col("s")).alias("s"), preview(F.col("l")).alias("l"), pubmed_date(F.col("y"), F.col("m"), F.col("d")).cast("string").alias("d")).head()
    assert (row["s"], row["l"], row["d"]) == ("a b", "x" * 200 + "...", "2024-02-01")


def test_blocks_of_paragraphs_change_nothing(spark, monkeypatch):
    import random

    from wardloom.operators import chunking

    rng = random.Random(2)
    texts = ["\n\n".join("x" * rng.randint(1, 60) for _ in range(rng.choice([0, 1, 2, 7, 40, 300]))) for _ in range(40)] + ["", " \n\n ", "a\n\n\n\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")

    def chunks():
        found = df.select("n", chunking.split_by_size(df["text"], 100, 30).alias("parts")).collect()
        return {r["n"]: r["parts"] for r in found}

    def plain(text):
        paragraphs = [p for p in (p.strip() for p in text.replace("\n\n\n\n", "\n\n").split("\n\n")) if p]
        done, held = [], []
        for p in paragraphs:
            if held and sum(map(len, held)) + len(p) > 100:
                done.append("\n\n".join(held))
                while held and sum(map(len, held)) > 30:
                    held.pop(0)
            held.append(p)
        return done + ["\n\n".join(held)] if held else [text]

    want = {i: plain(t) for i, t in enumerate(texts)}
    assert chunks() == want
    for block in (1, 3):
        monkeypatch.setattr(chunking, "PARAGRAPHS", block)
        assert chunks() == want
