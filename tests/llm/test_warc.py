import base64
import hashlib
import random

from wardloom.llm import warc

PAGES = "page_id long, url string, html string"


def plain(rows, least=0):
    groups = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= least:
            groups[h or ""] = min(p, groups.get(h or "", p))
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        first = groups.get(h or "")
        revisit = first is not None and first != p and len(data) >= least
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def result(records):
    return sorted(map(tuple, records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_round_trip_and_order(spark, monkeypatch):
    for name, value in {"RUN_ROWS": 7, "RANGE_ROWS": 40, "ROLL": 4000}.items():
        monkeypatch.setattr(warc, name, value)
    rng = random.Random(6)
    rows = [(i, f"http://{rng.choice('abc')}.Example.com/{rng.randrange(5)}?é={rng.randrange(3)}", rng.choice(["", "same", "é\r\n\r\nWARC/1.1\r\n", f"page {i} " * 50])) for i in range(300)]
    rows += [(None, None, None), (None, "x", "same"), (None, None, "alone"), (3, rows[3][1], rows[3][2]), (400, "http://a\r\nb.com/\n", "z" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], PAGES + ", stamp int, first string").repartition(5)
    for least in (0, 10):
        index, records = warc.archived(df, least)
        assert result(records) == plain(rows, least)
        entries = index.orderBy("range_no", "place").collect()
        keys = [warc.sort_key(tuple(e)[2:]) for e in entries]
        assert keys == sorted(keys) and len(keys) == len(rows)
    assert index.select("range_no").distinct().count() > 3
    index, records = warc.archived(spark.createDataFrame([], PAGES))
    assert records.count() == 0 and index.count() == 0


def test_loser_tree_merges_any_runs():
    rng = random.Random(2)
    for k in range(12):
        runs = [sorted(rng.choices(range(20), k=rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)
