import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_decontaminate import expected
from wardloom.llm import ordinal

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_plain_versions(spark, tmp_path):
    rng = random.Random(7)
    good, bad = [f"w{i}" for i in range(400)], [f"bad{i}%%%" for i in range(50)]
    items = [(i, " ".join(rng.choices(good, k=20))) for i in range(5)]
    docs, labels = [], []
    for i in range(240):
        words = rng.choices(bad if i % 4 == 0 else good, k=rng.randrange(40, 90))
        if i % 10 == 1:
            words[5:5] = rng.choice(items)[1].split()
        if i % 7 == 2 and docs:
            words = docs[rng.randrange(len(docs))][1].split()
            words[rng.randrange(len(words))] = "edit"
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int("%" not in docs[i][1]), 0))
    docs += [docs[9], (None, docs[3][1], "en", "s", 0), (500, None, None, None, None)]
    docs += [(None, " ".join(rng.choices(good, k=50)), "en", "s", 0)] * 2  # copies without an id
    docs += [(5, docs[6][1], "en", "s", 0), (6, docs[7][1], "en", "s", 0)]  # ids that repeat with the text of others
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    left = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        if k == 0:
            ratings = ordinal.grades_of(spark.read.parquet(f"{tmp_path}/labels.parquet"))
            scored = ordinal.graded(now, ratings, 2, 2).where("selected").collect()
            chosen = {r.doc_id for r in scored}
            left = [d for d in left if d[0] in chosen]
            assert all("%" not in d[1] for d in left if d[1])
        elif k == 1:
            first = {}
            for n, _, c in brute.jaccard_groups([(n, d[1]) for n, d in enumerate(left)]):
                key = (left[n][0] is None, left[n][0] or 0, n)
                first[c] = min(first.get(c, key), key)
            left = [left[n] for _, _, n in first.values()]
        else:
            hit = {d for d, _, _ in expected([(n, d[1]) for n, d in enumerate(left)], items)}
            left = [d for n, d in enumerate(left) if n not in hit]
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        assert now.columns == [c.split()[0] for c in DOCS.split(", ")]
        assert sorted(map(tuple, now.collect()), key=repr) == sorted(left, key=repr), name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out if r.piece == 0) == sorted(str(d[0]) for d in left)
    load = {}
    for r in out:
        load[r.sequence_id] = load.get(r.sequence_id, 0) + r.length
    assert max(load.values()) <= 2048 and len(load) == -(-sum(load.values()) // 2048)
