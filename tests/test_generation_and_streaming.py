import json
import math
import os
import pathlib
import subprocess
import sys
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import recorded
from wardloom.operators import knowledge
from wardloom.plans import prompts, replay, requests, rounds, running
from wardloom.plans.running import running_sum
from wardloom.sources import registry
from wardloom.streaming import ingest


def test_retry_prompt(spark):
    df = spark.createDataFrame([("p", ["fix a", "fix b"]), ("p", []), ("p", None)], "p string, n array<string>")
    plain = [r[0] for r in df.select(prompts.retry_prompt(F.col("p"), F.col("n"))).collect()]
    assert plain[0].startswith("p\n\n") and plain[0].endswith("- fix a\n- fix b") and plain[1:] == ["p", "p"]


def test_prompts_hold_their_rules(spark):
    slot = spark.createDataFrame([("1", 0, "stroke", "attending", "CTX", None), ("2", 0, "stroke", "expert", "CTX", ["n"])],
                                 "slot_id string, round int, topic string, difficulty string, context string, notes array<string>")
    rows = {r["slot_id"]: r["prompt"] for r in requests.plan_requests(slot.withColumn("plan_round", F.lit(0))).collect()}
    assert "7-10" in rows["1"] and "4-5" in rows["1"] and "CTX" in rows["1"] and "stroke" in rows["1"]
    assert "5-5" in rows["2"] and rows["2"].endswith("- n")


def test_difficulty_rules(spark):
    topics = spark.createDataFrame([("a", "attending"), ("b", "expert")], "topic string, difficulty string")
    rows = {r["topic"]: r for r in requests.difficulty_rules(topics, requests.difficulty_table(spark)).collect()}
    assert rows["a"]["phase_count_max"] == 10 and rows["a"]["valid_difficulty"]
    assert rows["b"]["phase_count_max"] == 5 and not rows["b"]["valid_difficulty"]


def test_parse_responses(spark):
    decision = {"action": "go", "is_optimal": True, "quality": "optimal", "reasoning": "r", "clinical_outcome": "o"}
    outcome = {"optimal_next_phase": None, "patient_status": "stable", "narrative_transition": "t"}
    phase = {"phase": {"phase_number": 1, "time_offset": "T+0", "narrative": "n", "decisions": [decision], "phase_outcome": outcome}}
    half = json.loads(json.dumps(phase))
    half["phase"]["vitals"] = {"hr": 80}
    bare = json.loads(json.dumps(phase))
    del bare["phase"]["decisions"]
    missing = json.loads(json.dumps(phase))
    del missing["phase"]["decisions"][0]["reasoning"]
    rows = [("ok", json.dumps(phase)), ("bare", json.dumps(bare)), ("half", json.dumps(half)), ("missing", json.dumps(missing)),
            ("broken", "{"), ("empty", None), ("other", "{}"), ("type", json.dumps({"phase": "text"}))]
    valid, bad = requests.parse_responses(spark.createDataFrame(rows, "request_id string, payload string"), "phase")
    assert {r["request_id"] for r in valid.collect()} == {"ok", "bare"}
    assert {r["request_id"] for r in bad.collect()} == {"half", "missing", "broken", "empty", "other", "type"}


def test_running_sum(spark):
    df = spark.createDataFrame([(i // 3, i % 3, i) for i in range(100)], "seq long, call int, v long")
    rows = running_sum(df, "seq", ("v",), ("call",), ranges=7).orderBy("seq", "call").collect()
    assert len(rows) == 100
    total = 0
    for r in rows:
        total += r["v"]
        assert r["running_v"] == total
    assert running_sum(df.where("false"), "seq", ("v",), ("call",)).count() == 0


def test_running_sum_splits_a_hot_sequence_number(spark):
    hot = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(5000)).alias("seq"), F.col("id").alias("call"), F.lit(1).alias("v"))
    summed = running_sum(hot, "seq", ("v",), ("call",), ranges=10)
    assert [r["running_v"] for r in summed.orderBy("seq", "call").collect()] == list(range(1, 20_001))
    found = running._bounds(hot, ("seq", "call"), 10)
    ranged = hot.withColumn("b", found).withColumn("k", F.struct("seq", "call")).withColumn("r", F.expr("size(filter(b, x -> x < k))"))
    counts = [r["count"] for r in ranged.groupBy("r").count().collect()]
    assert len(counts) >= 10 and max(counts) < 20_000 / 4


ORDERS = {n: [n * 37 + k * (n % 5 + 1) for k in range(n % 5)] for n in range(40)}


def _attempts(spark):
    rows = [(str(n), o) for n, orders in ORDERS.items() for o in orders]
    return recorded.rounds_of(spark.createDataFrame(rows, "slot_id string, o_orderkey long"))


def _batch(spark, tmp_path, difficulty="resident", count=len(ORDERS), **job):
    slots = spark.createDataFrame([(str(n), n, "stroke", difficulty) for n in range(count)], "slot_id string, slot_seq long, topic string, difficulty string")
    contexts = spark.createDataFrame([("stroke", "CTX")], "topic string, context string").withColumn(
        "sources", F.array(F.struct(F.lit("pubmed").alias("type"), F.lit("pubmed:1").alias("reference"), F.array(F.lit("c")).alias("chunk_ids"))))
    job = {"model": None, **job}
    return rounds.Job(spark, as_of="2024-01-01T00:00:00", folder=str(tmp_path / "job"), **job), slots, contexts


def _asked(n):
    """Order by round, as far as answers of this or an earlier round exist."""
    own = sorted(ORDERS[n])[:3]
    return [(r, own[min(r, len(own) - 1)], r < len(own)) for r in range(3)] if own else []


def test_single_step_rounds(spark, tmp_path):
    job, slots, contexts = _batch(spark, tmp_path, recorded=recorded.single(_attempts(spark)))
    made = rounds.generate_single(job, slots, contexts)
    got = {int(r["slot_id"]): r["case"] for r in made.cases.collect()}
    done, tokens, running, broken = {}, 0, {}, set()
    for n in ORDERS:
        for r, o, _ in _asked(n):
            written = o % 13 != 0
            tokens += (3 if written else 1) * (10 + o % 7)
            broken |= {(n, r)} if not written else set()
            if written and o % 3 == 0:
                done[n] = (r, f"vignette {o}")
                break
        running[n] = tokens
    assert {n: (c["metadata"]["retry_count"], c["vignette"]) for n, c in got.items()} == done
    assert {n: c["metadata"]["total_input_tokens"] for n, c in got.items()} == {n: running[n] for n in done}
    assert {int(r["slot_id"]) for r in made.failed.collect()} == set(ORDERS) - set(done)
    assert {(int(r["slot_id"]), r["round"]) for r in made.rejected.collect()} == broken and broken
    assert all(c["sources"][0]["reference"] == "pubmed:1" and c["review"]["approved"] for c in got.values())
    summary = made.summary.head()
    assert (summary["generated"], summary["failed"], summary["total_input_tokens"]) == (len(done), len(ORDERS) - len(done), tokens)


def test_multi_step_rounds(spark, tmp_path):
    job, slots, contexts = _batch(spark, tmp_path, recorded=recorded.multi(_attempts(spark)))
    made = rounds.generate_multi(job, slots, contexts, "LABS")
    got = {int(r["slot_id"]): r["case"] for r in made.cases.collect()}
    done, tokens = {}, 0
    for n in ORDERS:
        for r, o, fresh in _asked(n):
            count = 0 if o % 11 == 10 else 2 + o % 3
            lasting, passing = o % 7 == 6, o % 5 == 3 and o % 7 != 6 and fresh
            calls = 4 if fresh and o % 2 else 2
            calls += (count + 5 if lasting else count + 4 if passing else count + 2) if count else 0
            tokens += calls * (10 + o % 7)
            if count and not lasting and o % 3 == 0:
                said = [f"phase {i} of {o}" + (" mended" if passing and i == 1 else "") for i in range(1, count + 1)]
                done[n] = (r, said, f"action {o}.1", f"dx {o}" + (" revised" if o % 2 else ""))
                break
    found = {
        n: (c["metadata"]["retry_count"], [p["narrative"] for p in c["phases"]], c["ground_truth"]["optimal_next_step"], c["ground_truth"]["diagnosis"])
        for n, c in got.items()
    }
    assert found == done and any("mended" in d[1][0] for d in done.values()) and {d[0] for d in done.values()} == {0, 1, 2}
    assert all(c["vignette"] == "\n\n".join(p["narrative"] for p in c["phases"]) and c["metadata"]["multi_step"] for c in got.values())
    summary = made.summary.head()
    assert (summary["generated"], summary["total_input_tokens"]) == (len(done), tokens)


def test_answers_as_of_the_round(spark):
    rows = [("s", "planner", 0, r, a, f"{r}.{a}", 1, 1, "m") for r, a in ((0, 0), (0, 1), (2, 0), (2, 0))]
    rows += [("s", "phase_renderer", 1, 0, 0, "p", 1, 1, "m"), ("t", "planner", 0, 1, 0, None, 1, 1, "m"), (None, "planner", 0, 0, 0, "none", 1, 1, "m")]
    table = spark.createDataFrame(rows, replay.RECORDED)
    asked = [(f"{r}.{a}", "s", "planner", r, a) for r in range(4) for a in range(3)]
    asked += [("t0", "t", "planner", 0, 0), ("t1", "t", "planner", 1, 0), ("u", "u", "planner", 3, 0)]
    requests_ = spark.createDataFrame(asked, "request_id string, slot_id string, stage string, round int, plan_round int")
    got = {r["request_id"]: r["payload"] for r in replay.as_of(requests_, table).collect()}
    want = {"0.0": "0.0", "0.1": "0.1", "0.2": "0.1", "1.0": "0.1", "1.1": "0.1", "1.2": "0.1", "t1": None}
    assert got == want | {f"{r}.{a}": "2.0" for r in (2, 3) for a in range(3)}
    placed = requests_.where("request_id = 'u'").withColumns({"slot_id": F.lit("s"), "stage": F.lit("phase_renderer"), "pos": F.lit(1)})
    assert [r["payload"] for r in replay.as_of(placed, table).collect()] == ["p"]
    assert replay.as_of(placed.withColumn("pos", F.lit(0)), table).isEmpty() and replay.as_of(requests_, table.where("false")).isEmpty()


def test_a_job_has_a_model_or_recordings(spark, tmp_path):
    with pytest.raises(ValueError):
        _batch(spark, tmp_path)


def _model_of(answers):
    """A model that answers a stage with a fixed text."""

    def answer(batch):
        return pd.DataFrame({"request_id": batch["request_id"], "payload": [answers[s] for s in batch["stage"]],
                             "input_tokens": 1, "output_tokens": 1, "model": "m"})

    return answer


def _texts(spark):
    """Stage texts of a slot whose case is written well and rejected."""
    rows = recorded.single(recorded.rounds_of(spark.createDataFrame([("s", 1)], "slot_id string, o_orderkey long"))).collect()
    return {r["stage"]: r["payload"] for r in rows}


def test_retry_prompt_reaches_writer_and_tree(spark, tmp_path):
    seen, plain = str(tmp_path / "seen"), _model_of(_texts(spark))

    def spy(batch: pd.DataFrame) -> pd.DataFrame:
        with open(seen, "a") as f:
            f.writelines(json.dumps([r.stage, int(r.round), "- fix 1" in r.prompt]) + "\n" for r in batch.itertuples())
        return plain(batch)

    job, slots, contexts = _batch(spark, tmp_path, count=1, model=spy, max_rounds=2)
    rounds.generate_single(job, slots, contexts).cases.collect()
    with open(seen) as f:
        calls = sorted(json.loads(line) for line in f)
    assert calls == [["case_writer", 0, False], ["case_writer", 1, True], ["decision_tree", 0, False],
                     ["decision_tree", 1, True], ["review", 0, False], ["review", 1, False]]


def test_a_repeated_job_calls_for_what_is_left_only(spark, tmp_path):
    seen, plain = str(tmp_path / "seen"), _model_of(_texts(spark))

    def failing(batch: pd.DataFrame) -> pd.DataFrame:
        if any(r.stage == "decision_tree" and r.slot_id == "17" for r in batch.itertuples()) and not os.path.exists(seen + ".down"):
            open(seen + ".down", "w").close()
            raise RuntimeError("out of quota")
        with open(seen, "a") as f:
            f.writelines(r.request_id + "\n" for r in batch.itertuples())
        return plain(batch)

    kept = {"model": failing, "max_rounds": 2, "answers": str(tmp_path / "answers"), "calls_per_task": 9}
    job, slots, contexts = _batch(spark, tmp_path / "first", count=30, **kept)
    with pytest.raises(Exception, match="out of quota"):
        rounds.generate_single(job, slots, contexts)
    before = len(open(seen).readlines())
    for name in ("again", "third"):
        job, slots, contexts = _batch(spark, tmp_path / name, count=30, **kept)
        made = rounds.generate_single(job, slots, contexts)
        assert made.summary.head()["total_input_tokens"] == 30 * 2 * 3
    calls = open(seen).read().split()
    assert 30 <= before < len(calls) == len(set(calls)) == 30 * 2 * 3


LOST = """
import os, sys
from pyspark.sql import functions as F
from wardloom.plans.calls import answered
from wardloom.session import build_session
import pandas as pd

folder = sys.argv[1]
spark = build_session("lost", "local[2,4]", **{"spark.ui.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"})

def model(batch):
    if "33" in set(batch["slot_id"]) and not os.path.exists(folder + "/down"):
        open(folder + "/down", "w").close()
        os._exit(1)
    with open(folder + "/seen", "a") as f:
        f.writelines(i + chr(10) for i in batch["request_id"])
    return pd.DataFrame({"request_id": batch["request_id"], "payload": "p", "input_tokens": 1, "output_tokens": 1, "model": "m"})

text = F.col("id").cast("string")
asked = spark.range(100).select(
    F.sha2(text, 256).alias("request_id"), text.alias("slot_id"), F.lit("s").alias("stage"), F.lit(0).alias("round"),
    F.lit("").alias("system"), F.lit("").alias("prompt"), F.lit("s").alias("schema_name"))
got = answered(asked, model, folder + "/answers", calls_per_task=50, calls_per_file=1).collect()
assert len(got) == len({r["request_id"] for r in got}) == 100, len(got)
spark.stop()
"""


def test_a_lost_worker_repeats_no_kept_call(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", LOST, str(tmp_path)], cwd=root, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    calls = (tmp_path / "seen").read_text().split()
    assert (tmp_path / "down").exists() and len(calls) == len(set(calls)) == 100


def test_context_is_written_by_topic_and_in_requests_only(spark, tmp_path):
    job, slots, contexts = _batch(spark, tmp_path, count=6, model=_model_of(_texts(spark)), calls_per_task=2)
    rounds.generate_single(job, slots, contexts).cases.count()
    holding = set()
    folders = [p for p in pathlib.Path(job.folder).iterdir() if p.name != "answers"]
    for folder in folders:
        if "context" in spark.read.parquet(str(folder)).columns:
            holding.add(folder.name.split("-", 1)[1])
    assert holding == {"contexts"}
    first = spark.read.parquet(str(next(p for p in folders if p.name.endswith("requests"))))
    assert first.where("prompt LIKE '%CTX%' OR prompt LIKE '%ontext%'").count() == first.count()


def test_slots_are_numbered_without_gaps(spark):
    topics = spark.createDataFrame([("b", "attending"), ("a", "resident"), ("a", "resident")], "topic string, difficulty string")
    rows = sorted((r["slot_seq"], r["topic"], r["difficulty"]) for r in rounds.make_slots(topics, 2).collect())
    assert rows == [(0, "a", "resident"), (1, "a", "resident"), (2, "b", "attending"), (3, "b", "attending")]
    assert rounds.make_slots(topics, 0).count() == 0


def test_unknown_difficulty_fails(spark, tmp_path):
    approved = _texts(spark) | {"review": json.dumps({"accuracy_score": 1, "pedagogy_score": 1, "bias_score": 1, "approved": True, "notes": []})}
    job, slots, contexts = _batch(spark, tmp_path, count=2, model=_model_of(approved))
    mixed = slots.withColumn("difficulty", F.when(F.col("slot_seq") == 1, F.lit("expert")).otherwise(F.col("difficulty")))
    made = rounds.generate_single(job, mixed, contexts)
    assert [r["slot_id"] for r in made.failed.collect()] == ["1"] and made.cases.count() == 1


def test_rerender_touches_named_phases_only(spark):
    phases = spark.createDataFrame([("s", i, f"old{i}") for i in range(3)] + [("t", 0, "keep")], "slot_id string, pos int, phase string")
    new = spark.createDataFrame([("s", 1, "new1")], "slot_id string, pos int, phase string")
    rows = sorted(map(tuple, rounds.rerender(phases, new).collect()))
    assert rows == [("s", 0, "old0"), ("s", 1, "new1"), ("s", 2, "old2"), ("t", 0, "keep")]


def test_an_older_version_that_comes_late_changes_nothing(spark, tmp_path):
    from wardloom.schemas import DOCUMENT

    kb = knowledge.knowledge_table(spark, str(tmp_path / "kb"))
    landed = str(tmp_path / "landed")

    def deliver(*versions):
        rows = [("s", i, "t", text, "abstract", {"authors": ["a"], "publication_date": day and date.fromisoformat(day), "specialty": [], "credibility": "c", "url": None, "doi": None})
                for i, day, text in versions]
        spark.createDataFrame(rows, DOCUMENT).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(DOCUMENT).parquet(landed)
        ingest.ingest_versions(stream, lambda d: d, kb, str(tmp_path / "state"), str(tmp_path / "progress")).awaitTermination()
        return {r["source_document_id"]: r["text"] for r in kb.read().collect()}

    first = deliver(("1", "2024-02-02", "new"), ("1", "2024-02-01", "old"), ("2", None, "undated"), ("3", "2024-01-01", "x"), (None, None, "no id"))
    assert first["s:1"] == "new" and first["s:2"] == "undated" and len(first) == 4
    second = deliver(("1", "2024-01-01", "late"), ("2", "2023-01-01", "dated"), ("3", "2024-01-01", "same day"), ("4", None, ""))
    assert second == first | {"s:2": "dated", "s:3": "same day"}
    assert deliver(("2", None, "undated again")) == second
    counts = ingest.read_progress(spark, str(tmp_path / "progress")).where("is_total").orderBy("batch_id").collect()
    assert [(r["documents"], r["chunks"]) for r in counts] == [(4, 4), (3, 2)]  # the last let nothing through
    assert kb.read().where("source_document_id = 's:1'").head()["metadata"]["authors"] == ["a"]


def _land(folder, name, *items):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"data": [{"url": u, "title": "t", "markdown": m} for u, m in items]}))


def test_stream_equals_batch_and_repeats(spark, tmp_path):
    landed = tmp_path / "landed"
    kb = knowledge.knowledge_table(spark, str(tmp_path / "kb"))

    def run(state):
        ingest.stream_ingest(spark, str(landed), "firecrawl", kb, str(tmp_path / state), str(tmp_path / "progress")).awaitTermination()

    _land(landed, "a.json", ("u1", "Stroke\n\ncare"), ("u2", "second"))
    (landed / "bad.json").write_text("{")
    run("state")
    _land(landed, "b.json", ("u2", "second changed"), ("u3", "third"))
    run("state")
    texts = {r["source_document_id"]: r["text"] for r in kb.read().collect()}
    assert texts == {"firecrawl:u1": "Stroke\n\ncare", "firecrawl:u2": "second changed", "firecrawl:u3": "third"}
    run("state")
    run("state-lost")
    assert kb.count() == 3
    chunked = {r["batch_id"]: (r["documents"], r["chunks"]) for r in ingest.read_progress(spark, str(tmp_path / "progress")).where("is_total").collect()}
    assert chunked[1] == (2, 2)
    batch = knowledge.knowledge_rows(registry.normalize(
        spark.read.text(str(landed / "a.json"), wholetext=True).withColumnRenamed("value", "payload"), "firecrawl"))
    stored = {r["chunk_id"]: r for r in kb.read().collect()}
    for row in batch.where("text = 'Stroke\n\ncare'").collect():
        same = stored[row["chunk_id"]]
        assert same["metadata"]["specialty"] == ["neurology"] == row["metadata"]["specialty"]
        assert all(math.isclose(x, y) for x, y in zip(row["embedding"], same["embedding"]))
    counts = ingest.read_progress(spark, str(tmp_path / "progress")).where("is_total").collect()
    assert {r["batch_id"] for r in counts} == {0, 1}
