"""What building, decoding and answering of cases shuffles and parses."""

import json

from pyspark.sql import functions as F

from checks import fixtures
from checks.queries import QUERIES
from tests.test_plans import plan
from wardloom.operators import cases as case_ops
from wardloom.plans import requests, rounds


def order_tables(spark, path):
    spark.sql("select 7L c_custkey, 'Ann' c_name, 'BUILDING' c_mktsegment").write.parquet(f"{path}/customer.parquet")
    spark.sql(
        "select id o_orderkey, 7L o_custkey, 10.5D o_totalprice, '1-URGENT' o_orderpriority, 'O' o_orderstatus, "
        "timestamp'2024-01-01' o_orderdate from range(1, 4)"
    ).write.parquet(f"{path}/orders.parquet")
    spark.sql(
        "select 1L + id % 2 l_orderkey, 60 + id l_partkey, id l_suppkey, cast(9 - id as int) l_linenumber, 2.0D l_quantity, "
        "1.0D l_extendedprice, timestamp'2024-01-01' l_shipdate, 'N' l_returnflag, 'O' l_linestatus from range(6)"
    ).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_phases_are_made_after_the_only_shuffle_of_lines(spark, tmp_path):
    cases = fixtures.cases(spark, order_tables(spark, tmp_path))
    phases = cases.select(F.col("case_id").alias("slot_id"), F.posexplode("phases").alias("pos", "phase"), F.lit("m").alias("model"))
    gathered = rounds.collect_phases(phases)
    text = plan(gathered)
    assert text.count("Exchange hashpartitioning") == 2 and "RoundRobin" not in text and "SortMergeJoin" not in text
    got = {r["slot_id"]: [(p["phase_number"], p["time_offset"], p["narrative"]) for p in r["phases"]] for r in gathered.collect()}
    assert {r["case_id"]: len(r["phases"]) for r in cases.collect()} == {"1": 3, "2": 3, "3": 0}
    assert {k: [n for n, _, _ in v] for k, v in got.items()} == {"1": [1, 2, 3], "2": [1, 2, 3]}
    assert [said for _, _, said in got["1"]] == ["Line 64 N", "Line 62 N", "Line 60 N"]


def test_an_answer_is_parsed_once(spark):
    body = json.dumps({"approved": True, "notes": ["n"]})
    answers = spark.createDataFrame([("a", body), ("b", "{broken"), ("c", "{}"), ("d", None)], "request_id string, payload string")
    valid, bad = requests.parse_responses(answers, "blueprint_review")
    assert plan(valid.select("request_id", "data.approved")).count("from_json(") == 1
    assert plan(bad).count("from_json(") == 1
    assert [r["request_id"] for r in valid.collect()] == ["a"] and sorted(r["request_id"] for r in bad.collect()) == ["b", "c", "d"]


def test_a_stored_case_is_parsed_once(spark):
    rows = spark.createDataFrame([("a", '{"case_id": "a"}'), ("b", "{broken"), ("c", None)], "case_id string, case_json string")
    assert plan(case_ops.decode_cases(rows)).count("from_json(") == 1
    assert plan(case_ops.unreadable_cases(rows)).count("from_json(") == 1
    assert [(r["case_id"], r["phases"]) for r in case_ops.decode_cases(rows).collect()] == [("a", [])]


def test_readable_and_other_answers_are_told_apart_in_one_pass(spark, tmp_path):
    body = json.dumps({"approved": True, "notes": ["n"]})
    answers = spark.createDataFrame([("a", body), ("b", "{broken"), ("c", "{}"), ("d", None)], "request_id string, payload string")
    judged = requests.judged_responses(answers, "blueprint_review")
    assert {r["request_id"]: (r["valid"], r["data"] and r["data"]["approved"]) for r in judged.collect()} == {
        "a": (True, True), "b": (False, None), "c": (False, None), "d": (False, None)}
    found = QUERIES["parse_phases"](spark, order_tables(spark, tmp_path))
    assert plan(found).count("from_json(") == 1
    got = {r["request_id"]: (r["narrative"], r["decisions"]) for r in found.collect()}
    assert len(got) == 6 and got["1.0"] == ("Line 64 N", 4) and got["2.2"] == ("Line 61 N", 1)


def test_phases_as_rows_are_the_phases_of_the_cases(spark, tmp_path):
    folder = order_tables(spark, tmp_path)
    listed = fixtures.cases(spark, folder).select("case_id", F.posexplode("phases").alias("pos", "phase"))
    rows = fixtures.phase_rows(spark, folder)
    assert sorted(rows.collect()) == sorted(listed.collect()) and rows.count() == 6
    assert "transform(" not in plan(rows)
