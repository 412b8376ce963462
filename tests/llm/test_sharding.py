import hashlib
import random

from wardloom.llm import sharding

SCHEMA = "doc_id long, text string"


def bits(key):
    return format(int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:14], 16), "056b")


def plain(rows, limit):
    """Shard of each row while ids are enough to split by."""
    out = {}

    def split(members, prefix):
        total = sum(b for _, b in members)
        if total <= limit or len(members) == 1 or len(prefix) == 56:
            for d, b in members:
                out[d] = (b, prefix, len(prefix), total, len(members))
            return
        for bit in "01":
            part = [(d, b) for d, b in members if bits(d).startswith(prefix + bit)]
            if part:
                split(part, prefix + bit)

    split(rows, "")
    return out


def test_shards_are_those_of_splitting_one_bit_at_a_time(spark):
    rng = random.Random(4)
    rows = [(i, "é" * rng.randrange(0, 60)) for i in range(800)] + [(5000, "x" * 4000), (None, "n"), (6000, None)]
    for limit in (10**9, 2000, 150):
        got = {r.doc_id: tuple(r)[1:] for r in sharding.sharded(spark.createDataFrame(rows, SCHEMA), limit).collect()}
        assert got == plain([(d, len((t or "").encode())) for d, t in rows], limit)


def test_one_key_with_most_rows_is_split_and_nothing_is_lost(spark, tmp_path):
    rows = [(1, "x" * 100)] * 300 + [(i, "y" * 50) for i in range(2, 100)] + [(None, "z" * 90)] * 40
    df = spark.createDataFrame([(d, t, "s", i) for i, (d, t) in enumerate(rows)], SCHEMA + ", shard_bytes string, row_id int")
    got = sharding.sharded(df, 1000).collect()
    assert sorted((str(r.doc_id), r.bytes) for r in got) == sorted((str(d), len(t)) for d, t in rows)
    total = {}
    for r in got:
        total[r.shard] = total.get(r.shard, 0) + r.bytes
    assert all(r.shard_bytes == total[r.shard] <= 1000 for r in got)
    names = sorted(total)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    sharding.write_shards(df, 1000, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.select("shard").distinct().count() == len(total)
    assert sharding.sharded(spark.createDataFrame([], SCHEMA), 10).count() == 0
