import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.cases_data import case, frame, phase, review
from wardloom.operators import cases as case_ops
from wardloom.operators import knowledge, search, vector_index
from wardloom.operators.embedding import embed, fit_idf, stored_idf
from wardloom.schemas import KB_CHUNK
from wardloom.session import work_path
from wardloom.tables import latest_per_key


def test_latest_per_key_with_a_hot_key(spark):
    rows = [("hot", i) for i in range(1000)] + [("cold", 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    assert sorted(map(tuple, latest_per_key(df, "k", [F.col("v")]).collect())) == [("cold", 1), ("hot", 999)]


def kb_rows(spark, *rows):
    df = spark.createDataFrame(list(rows), "chunk_id string, source string, text string, x float, y float, credibility string")
    meta = F.struct(
        F.array(F.lit("A"), F.lit("B")), F.lit(None), F.array(F.lit("s1"), F.lit("s2")), F.col("credibility"), F.lit(None), F.lit("d")
    ).cast(KB_CHUNK["metadata"].dataType)
    return df.select(
        "chunk_id", F.concat("source", F.lit(":1")).alias("source_document_id"), "text", F.lit(0).alias("position"),
        meta.alias("metadata"), F.array("x", "y").alias("embedding"), "source",
    )


def test_upsert_twice_replaces_and_keeps(spark, tmp_path):
    kb = knowledge.knowledge_table(spark, str(tmp_path / "kb"))
    assert kb.count() == 0
    first = kb_rows(spark, *[(f"c{i}", f"s{i % 2}", f"t{i}", 1.0, 0.0, "curated") for i in range(20)])
    kb.upsert(first)
    kb.upsert(first)
    assert kb.count() == 20
    before = kb.read()
    kb.upsert(kb_rows(spark, ("c3", "s1", "new", 1.0, 0.0, "curated"), ("c99", "odd/1=x", "z", 0.0, 1.0, "curated")))
    kb.upsert(first.where("false"))
    texts = {r["chunk_id"]: (r["source"], r["text"]) for r in kb.read().collect()}
    assert len(texts) == 21 and texts["c3"] == ("s1", "new") and texts["c99"] == ("odd/1=x", "z") and texts["c4"] == ("s0", "t4")
    # a reader of the version before still sees that version
    assert {r["text"] for r in before.collect()} == {f"t{i}" for i in range(20)}
    assert kb.read().columns == KB_CHUNK.names


def test_a_row_that_moves_to_another_source_leaves_the_first(spark, tmp_path):
    kb = knowledge.knowledge_table(spark, str(tmp_path / "kb"))
    kb.upsert(kb_rows(spark, ("c", "s1", "old", 1.0, 0.0, "curated"), ("d", "s1", "stays", 1.0, 0.0, "curated")))
    kb.upsert(kb_rows(spark, ("c", "s2", "new", 1.0, 0.0, "curated")))
    assert [r["text"] for r in kb.read("s1").collect()] == ["stays"]
    assert [r["text"] for r in kb.read("s2").collect()] == ["new"]


def test_a_job_that_dies_leaves_the_table_as_it_was(spark, tmp_path):
    kb = knowledge.knowledge_table(spark, str(tmp_path / "kb"))
    first = kb_rows(spark, *[(f"c{i}", "s", "old", 1.0, 0.0, "curated") for i in range(20)])
    kb.upsert(first)
    with pytest.raises(Exception, match="broken"):
        kb.upsert(first.withColumn("text", F.when(F.col("chunk_id") == "c7", F.raise_error(F.lit("broken"))).otherwise(F.lit("new"))))
    assert {r["text"] for r in kb.read().collect()} == {"old"}
    kb.upsert(first.withColumn("text", F.lit("new")))
    assert [r["text"] for r in kb.read().collect()] == ["new"] * 20


def _bytes(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_an_upsert_writes_its_own_rows_only(spark, tmp_path):
    kb = knowledge.knowledge_table(spark, str(tmp_path / "kb"))
    kb.upsert(kb_rows(spark, *[(f"c{i}", f"s{i % 4}", f"text {i} " * 50, float(i), 0.5, "curated") for i in range(3000)]))
    whole = _bytes(tmp_path / "kb")
    kb.upsert(kb_rows(spark, *[(f"c{i}", "s1", "new", 1.0, 0.0, "curated") for i in range(1, 41, 4)]))
    assert _bytes(tmp_path / "kb") - whole < 0.1 * whole
    assert kb.count() == 3000 and kb.read().where("text = 'new'").count() == 10


def test_rows_of_sources_without_a_name_stay(spark, tmp_path):
    for source in ("", None):
        kb = knowledge.knowledge_table(spark, str(tmp_path / f"kb{source}"))
        kb.upsert(kb_rows(spark, *[(f"a{i}", source, "t", 1.0, 0.0, "curated") for i in range(20)]))
        kb.upsert(kb_rows(spark, *[(f"b{i}", source, "t", 1.0, 0.0, "curated") for i in range(20)], ("a3", source, "new", 1.0, 0.0, "curated")))
        rows = kb.read().collect()
        assert len(rows) == 40 and {r["source"] for r in rows} == {source}
        assert [r["text"] for r in rows if r["chunk_id"] == "a3"] == ["new"]


def test_repeated_keys_in_one_upsert(spark, tmp_path):
    kb = knowledge.knowledge_table(spark, str(tmp_path / "kb"))
    kb.upsert(kb_rows(spark, ("a", "s", "1", 1.0, 0.0, "curated"), ("a", "s", "2", 1.0, 0.0, "x"), ("a", "s", "2", 1.0, 0.0, "y"), ("b", "s", "1", 1.0, 0.0, "z")))
    rows = {r["chunk_id"]: r["text"] for r in kb.read().collect()}
    assert kb.count() == 2 and rows["b"] == "1"
    again = knowledge.knowledge_table(spark, str(tmp_path / "again"))
    again.upsert(kb_rows(spark, ("b", "s", "1", 1.0, 0.0, "z"), ("a", "s", "2", 1.0, 0.0, "y"), ("a", "s", "1", 1.0, 0.0, "curated")))
    assert {r["chunk_id"]: r["text"] for r in again.read().collect()} == rows
    dated = kb_rows(spark, ("a", "s", "1", 1.0, 0.0, "x"), ("a", "s", "2", 1.0, 0.0, "x"), ("a", "s", "3", 1.0, 0.0, "x"))
    day = F.when(F.col("text") == "2", F.lit("2024-01-02")).when(F.col("text") == "1", F.lit("2024-01-01")).cast("date")
    kb.upsert(dated.withColumn("metadata", F.col("metadata").withField("publication_date", day)))
    assert {r["chunk_id"]: r["text"] for r in kb.read().collect()} == {"a": "2", "b": "1"}


def test_one_version_of_a_document(spark):
    from wardloom.schemas import DOCUMENT

    def doc(i, content, day):
        meta = {"authors": [], "publication_date": day, "specialty": [], "credibility": "c", "url": None, "doi": None}
        return ("s", i, "t", content, "abstract", meta)

    from datetime import date
    rows = [doc("1", "old", date(2024, 1, 1)), doc("1", "new", date(2024, 1, 2)), doc("2", "a", None), doc("2", "a", None), doc("3", "x", None)]
    df = spark.createDataFrame(rows, DOCUMENT)
    assert sorted((r["source_id"], r["content"]) for r in knowledge.single_version(df).collect()) == [("1", "new"), ("2", "a"), ("3", "x")]


def test_source_filter_prunes_files(spark, tmp_path):
    kb = knowledge.knowledge_table(spark, str(tmp_path / "kb"))
    kb.upsert(kb_rows(spark, *[(f"c{i}", f"s{i % 4}", "t", 1.0, 0.0, "curated") for i in range(16)]))
    plan = kb.read("s1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    assert kb.read("s1").count() == 4


def test_search_retrieve_and_context(spark):
    kb = knowledge.flat_metadata(kb_rows(
        spark, ("a", "s1", "ta", 1.0, 0.0, "preprint"), ("b", "s1", "tb", 0.9, 0.1, "guideline"),
        ("c", "s2", "tc", 0.0, 1.0, "guideline"), ("d", "s2", "td", 1.0, 0.0, None), ("z", "s2", "tz", 0.0, 0.0, "odd"),
    ))
    hits = search.search(kb, [2.0, 0.0], 3).collect()
    assert [r["chunk_id"] for r in hits] == ["a", "d", "b"]
    assert hits[0]["score"] == pytest.approx(1.0) and hits[2]["score"] == pytest.approx(0.9 / np.hypot(0.9, 0.1), abs=1e-6)
    assert [r["chunk_id"] for r in search.search(kb, [2.0, 0.0], 10, source="s2").collect()] == ["d", "c", "z"]
    found = search.retrieve(kb, [1.0, 0.0], 3).orderBy("place")
    assert [(r["chunk_id"], r["credibility"], r["credibility_rank"]) for r in found.collect()] == [
        ("b", "guideline", 0), ("a", "preprint", 4), ("d", "preprint", 4)]
    assert search.format_context(found).head()["context"] == (
        "[Source 1] (guideline, s1)\ntb\n\n---\n\n[Source 2] (preprint, s1)\nta\n\n---\n\n[Source 3] (preprint, s2)\ntd")
    assert [r["reference"] for r in search.source_refs(found).head()["sources"]] == ["s1:1", "s1:1", "s2:1"]


def _random_kb(spark, n=400, width=16):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((n, width)).astype(np.float32)
    vectors[5] = vectors[6] = vectors[7]
    vectors[9] = 0
    df = spark.createDataFrame([(f"k{i:03d}", v.tolist()) for i, v in enumerate(vectors)], "chunk_id string, embedding array<float>")
    return df.repartition(5), vectors


def _exact(vectors, k):
    v = vectors.astype(np.float64)
    norms = np.linalg.norm(v, axis=1)
    unit = v / np.where(norms > 0, norms, 1)[:, None]
    scores = np.round(unit @ unit.T, 9)
    ids = np.array([f"k{i:03d}" for i in range(len(v))])
    return {ids[q]: [ids[i] for i in np.lexsort((ids, -scores[q]))[:k]] for q in range(len(v))}


def test_search_many_is_exact_in_blocks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        kb, vectors = _random_kb(spark)
        queries = kb.withColumnRenamed("chunk_id", "query_id").where("query_id <> 'k009'")
        wanted = _exact(vectors, 7)
        got = {}
        for r in search.search_many(kb, queries, 7, block=150).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same = sum([got[q][i + 1] for i in range(7)] == wanted[q] for q in got)
    assert len(got) == 399
    # the three equal vectors may differ in the last bit between batches, all else is exact
    assert same >= 396 and all(set(got["k005"][i] for i in (1, 2, 3)) == {"k005", "k006", "k007"} for _ in [0])
    assert search.search_many(kb, queries.where("false"), 7).count() == 0


def _hits(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["chunk_id"], round(r["score"], 9))
    return got


def test_lists_give_the_exact_rows_and_the_asked_recall(spark):
    kb, vectors = _random_kb(spark)
    queries = kb.withColumnRenamed("chunk_id", "query_id")
    index = vector_index.build(kb, 16)
    assert index.sizes.sum() == 400 and len(index.centroids) == 20
    wanted = _hits(search.search_many(kb, queries, 10))
    got = _hits(vector_index.search_exact(index, queries, 10))
    assert {q: [s for _, s in sorted(h.values())] for q, h in got.items()} == {q: [s for _, s in sorted(h.values())] for q, h in wanted.items()}
    assert sum(got[q] == wanted[q] for q in wanted) >= 396  # equal vectors may differ in the last bit
    for visited, least in ((None, 0.95), (20, 1.0), (8, 0.5)):
        near = _hits(vector_index.search_approx(index, queries, 10, visited=visited))
        names = {q: {c for c, _ in h.values()} for q, h in wanted.items()}
        assert sum(c in names[q] for q, h in near.items() for c, _ in h.values()) >= least * 4000 - 8
    # fewer hits than asked for: every list is visited
    assert _hits(vector_index.search_exact(index, queries.limit(3), 500)) and all(len(h) == 400 for h in _hits(vector_index.search_exact(index, queries.limit(3), 500)).values())


def test_bounds_leave_out_most_lists_of_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    middle = rng.standard_normal((30, 24))
    v = middle[rng.integers(0, 30, 900)] + rng.standard_normal((900, 24)) * 0.1
    kb = spark.createDataFrame([(f"c{i}", [float(x) for x in row]) for i, row in enumerate(v)], "chunk_id string, embedding array<float>")
    queries = kb.withColumnRenamed("chunk_id", "query_id")
    index = vector_index.build(kb, 24)
    first, further = vector_index.visits(index, queries, 5)
    met = sum(index.sizes[r["code"]] for r in further.select("code").collect())
    assert first.count() == 4500 and met < 0.1 * 900 * 900
    assert _hits(vector_index.search_exact(index, queries, 5)) == _hits(search.search_many(kb, queries, 5))
    assert vector_index.probes(index, 5) <= 4


def test_blocks_grow_with_the_rows(spark, monkeypatch):
    kb, _ = _random_kb(spark)
    queries = kb.withColumnRenamed("chunk_id", "query_id")
    wanted = _hits(search.search_many(kb, queries, 3))

    def blocks(df):
        sized = df.withColumn("width", F.size("embedding"))
        return search.block_counts(sized, 4, "n", ["width"]).head()["n"]

    # 400 rows of blocks of 4 would travel 100 times
    assert blocks(kb) == 8 and blocks(kb.unionByName(kb)) == 8 and blocks(kb.limit(10)) == 3
    assert _hits(search.search_many(kb, queries, 3, 4, 4)) == wanted
    monkeypatch.setattr(search, "BLOCK_CELLS", 20 * 16)
    assert blocks(kb) == 20
    index = vector_index.build(kb, 16)
    monkeypatch.setattr(search, "CHUNK_BLOCK", 10)
    monkeypatch.setattr(search, "BLOCK_CELLS", 1 << 22)
    assert vector_index._shelves(index).max() + 1 <= 16  # 50 rows and not 10 make one


def test_a_query_is_a_row_per_shelf_of_lists(spark, monkeypatch):
    kb, vectors = _random_kb(spark)
    queries = kb.withColumnRenamed("chunk_id", "query_id")
    index = vector_index.build(kb, 16)
    first, further = vector_index._first_and_further(index, queries, 10)
    assert vector_index._visiting(further, index).count() <= 400  # one shelf holds all, whatever the number of lists
    monkeypatch.setattr(search, "CHUNK_BLOCK", 100)
    shelves = vector_index._shelves(index)
    assert 4 <= shelves.max() + 1 <= 8 and (np.diff(shelves) >= 0).all()
    rows = vector_index._visiting(further, index).collect()
    assert sum(len(r["lists"]) for r in rows) == further.select(F.explode("lists")).count()
    assert all({int(shelves[i]) for i in r["lists"]} == {r["code"]} for r in rows) and len({(r["query_id"], r["code"]) for r in rows}) == len(rows)
    wanted, got = _hits(search.search_many(kb, queries, 10)), _hits(vector_index.search_exact(index, queries, 10))
    assert sum(got[q] == wanted[q] for q in wanted) >= 396  # equal vectors may differ in the last bit


def test_recall_is_told_per_query_as_its_sql_finds_it(spark, tmp_path):
    import duckdb

    from checks.oracles import ORACLES
    from checks.queries import QUERIES

    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in row], i % 4) for i, row in enumerate(rng.standard_normal((150, 64)).astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query_id"], r["nearest"], r["found"], r["reached"]) for r in QUERIES["search_recall"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    wanted = con.execute(f"SELECT query_id, nearest, found, reached FROM ({ORACLES['search_recall']}) ORDER BY query_id").fetchall()
    assert got == sorted(wanted) and len(got) == 150
    assert all(n == 10 for _, n, _, _ in got) and len({f for _, _, f, _ in got}) > 1


def test_index_of_odd_vectors(spark):
    rows = [("n", None), ("e", []), ("h", [1.0, None]), ("w", [1.0] * 5), ("z", [0.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [-1.0, 0.0])]
    kb = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    index = vector_index.build(kb, 2, lists=2)
    assert index.rows.where("list IS NULL").count() == 4
    queries = kb.withColumnRenamed("chunk_id", "query_id")
    usable = kb.where("chunk_id in ('z', 'a', 'b', 'c')")
    wanted = _hits(search.search_many(usable, queries.where("query_id in ('z', 'a', 'b', 'c')"), 3))
    assert _hits(vector_index.search_exact(index, queries, 3)) == wanted == _hits(vector_index.search_approx(index, queries, 3, visited=2))
    empty = vector_index.build(kb.limit(0), 2)
    assert vector_index.search_exact(empty, queries, 3).count() == 0 == vector_index.search_approx(empty, queries, 3).count()


def test_odd_vectors_and_a_hot_code(spark):
    kb, vectors = _random_kb(spark)
    odd = spark.createDataFrame([("n", None), ("e", []), ("h", [1.0, None]), ("w", [1.0] * 5)], "chunk_id string, embedding array<float>")
    both = kb.union(odd)
    assert search.unsearchable(both).count() == 3
    queries = both.withColumnRenamed("chunk_id", "query_id")
    got = search.search_many(both, queries, 3, block=50, chunk_block=30).collect()
    assert {r["query_id"] for r in got} == {f"k{i:03d}" for i in range(400)} | {"w"}
    assert [r["chunk_id"] for r in got if r["query_id"] == "w"] == ["w"]
    # a single list of all rows, cut into blocks
    wanted = _exact(vectors, 3)
    one = both.select("chunk_id", "embedding", F.lit(0).alias("code")).where("chunk_id like 'k%'")
    found = search.best_of_codes(one, search.named(queries).withColumn("code", F.lit(0)), 3, chunk_block=30, query_block=50)
    assert sum(r["chunk_id"] in wanted[r["query_id"]] for r in found.collect()) >= 3 * 396
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in text and "hashpartitioning(width" in text


def test_search_by_text(spark):
    chunks = spark.createDataFrame([("a", "heart failure"), ("b", "kidney stones")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "stones in the kidney")], "query_id string, text string")
    best = search.search_text(embed(chunks), asked, 1).head()
    assert (best["chunk_id"], best["text"], best["rank"]) == ("b", "kidney stones", 1)


def test_embedding(spark):
    df = spark.createDataFrame([("a", "Heart failure heart"), ("b", "--- !!"), ("c", "Kidney stones")], "id string, text string")
    rows = {r["id"]: np.array(r["embedding"]) for r in embed(df).collect()}
    assert all(len(v) == 384 for v in rows.values())
    assert np.linalg.norm(rows["a"]) == pytest.approx(1, abs=1e-6) and not rows["b"].any()
    again = {r["id"]: np.array(r["embedding"]) for r in embed(df.repartition(3)).collect()}
    assert all((rows[k] == again[k]).all() for k in rows)
    assert sorted(rows["a"][rows["a"] > 0]) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    weighted = {r["id"]: np.array(r["embedding"]) for r in embed(df, idf=fit_idf(df)).collect()}
    assert np.linalg.norm(weighted["c"]) == pytest.approx(1, abs=1e-6)
    kept = stored_idf(df, work_path(spark, "idf"))
    assert {r["id"]: r["embedding"] for r in embed(df, idf=kept).collect()} == {i: v.tolist() for i, v in weighted.items()}
    blank = spark.createDataFrame([(None,), ("",), ("...",)], "text string")
    assert [set(r["embedding"]) for r in embed(blank, idf=kept).collect()] == [{0.0}] * 3
    plugged = embed(df, fn=lambda texts: np.array([[len(t), 1.0] for t in texts]), batch=2)
    assert {r["id"]: r["embedding"] for r in plugged.collect()}["b"] == [6.0, 1.0]


def test_ingest_summary(spark):
    docs = spark.createDataFrame([("s1", "1", "a\n\nb", "x"), ("s1", "2", " ", "abstract"), ("s2", "3", "c", "abstract")],
                                 "source string, source_id string, content string, content_type string")
    rows = {(r["source"], r["is_total"]): (r["documents"], r["chunks"]) for r in knowledge.ingest_summary_of(docs, 1, 0).collect()}
    assert rows == {("s1", False): (2, 2), ("s2", False): (1, 1), (None, True): (3, 3)}


def test_case_store(spark, tmp_path):
    store = case_ops.case_table(spark, str(tmp_path / "cases"))
    a = case("a", review=review(0.9))
    b = case("bb", topic="sepsis", difficulty="attending", review=review(0.5), phases=[phase(1), phase(2)])
    c = case("ccc")
    del c["metadata"]["model"], c["metadata"]["generated_at"]
    case_ops.upsert_cases(store, frame(spark, a, b, c), as_of="2023-01-01T00:00:00")
    case_ops.upsert_cases(store, frame(spark, {**a, "vignette": "newer", "metadata": {**a["metadata"], "generated_at": "2024-02-01"}}))
    rows = store.read()
    assert case_ops.count_cases(rows).head()["cases"] == 3
    assert case_ops.get_case(rows, "a").head()["vignette"] == "newer" and case_ops.get_case(rows, "x").head() is None
    stored = {r["case_id"]: r for r in rows.collect()}
    assert stored["ccc"]["model"] == "" and stored["ccc"]["generated_at"] == "2023-01-01T00:00:00" and stored["ccc"]["accuracy_score"] is None
    assert stored["a"]["specialty"] == "neurology,radiology"
    ids = lambda df: [r["case_id"] for r in df.collect()]
    assert ids(case_ops.list_cases(rows)) == ["a", "bb", "ccc"]
    assert ids(case_ops.list_cases(rows, topic="sepsis")) == ["bb"]
    assert ids(case_ops.list_cases(rows, difficulty="attending")) == ["bb"]
    assert ids(case_ops.list_cases(rows, min_accuracy=0.8)) == ["a"]
    assert ids(case_ops.list_cases(rows, topic="", limit=2)) == ["a", "bb"]
    assert ids(case_ops.multi_step_cases(case_ops.list_cases(rows))) == ["bb"]
    assert [r["line"] for r in case_ops.case_summary(case_ops.list_cases(rows)).collect()] == [
        "[a] stroke (resident) — accuracy: 0.90", "[bb] sepsis (attending) — accuracy: 0.50", "[ccc] stroke (resident) — accuracy: 0.00"]
    path = str(tmp_path / "out")
    case_ops.write_lines(case_ops.export_jsonl(rows, topic="sepsis"), path)
    assert spark.read.text(path).count() == 1
    case_ops.write_cases(frame(spark, a, b), str(tmp_path / "batch"))
    assert spark.read.text(str(tmp_path / "batch")).count() == 2


def test_legacy_case_without_phases(spark):
    rows = spark.createDataFrame([('{"case_id":"old","topic":"t"}',)], "case_json string")
    old = case_ops.decode_cases(rows)
    assert old.head()["phases"] == [] and case_ops.multi_step_cases(old).count() == 0
