"""Extendible hashing: shards under a byte limit, by a directory over prefixes of a hash.

A row's hash is that of its key, and behind it that of its place in the table, so rows of one key can be told apart
once the bits of the key are used up. A shard is named by the bits its rows begin with. All rows start in one bucket of no
bits; only a bucket over the limit is split on the next bit. ``LEVEL`` bits are looked at in one pass: sizes are summed
for each prefix of an open bucket first, so a group has at most ``2 ** LEVEL`` sums whatever its rows, and its part of
the directory is made from those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.llm.work import saved, take

LEVEL = 8
WORD = 56  # bits of each of the two hashes that are used; a multiple of LEVEL


def key_hash(key: Column) -> Column:
    """The first 56 bits of the MD5 of a key's text, as a whole number; a null key counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, WORD // 4), 16, 10).cast("long")


def _directory(limit: int):
    """Splits one open bucket by the sums of its next bits: for each cell the shard it falls in, or that it stays open."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parent, depth = group["parent"].iloc[0], int(group["depth"].iloc[0])
        size, count = np.zeros(1 << LEVEL, np.int64), np.zeros(1 << LEVEL, np.int64)
        size[group["cell"]] = group["bytes"]
        count[group["cell"]] = group["rows"]
        out = []

        def split(low: int, bits: int) -> None:
            high = low + (1 << (LEVEL - bits))
            total, rows = int(size[low:high].sum()), int(count[low:high].sum())
            if not rows:
                return
            closed = total <= limit or rows == 1
            if closed or bits == LEVEL:
                name = parent + (format(low >> (LEVEL - bits), f"0{bits}b") if bits else "")
                cells = [c for c in range(low, high) if count[c]]
                out.extend((parent, c, name, depth + bits, total, rows, closed) for c in cells)
                return
            split(low, bits + 1)
            split((low + high) // 2, bits + 1)

        split(0, 0)
        return pd.DataFrame(out, columns=["parent", "cell", "shard", "depth", "shard_bytes", "shard_rows", "closed"])

    return run


def assigned(rows: DataFrame, limit: int) -> DataFrame:
    """``row_id, shard, depth, shard_bytes, shard_rows`` for ``(row_id, hash, bytes)`` with unique row ids."""
    open_rows = rows.select("row_id", "hash", F.xxhash64("row_id").alias("second"), "bytes").withColumn("parent", F.lit(""))
    done = []
    depth = 0
    while True:
        word, used = divmod(depth, WORD)
        source = F.col("hash") if word == 0 else F.shiftrightunsigned("second", 64 - WORD)
        cell = F.shiftright(source, WORD - LEVEL - used).bitwiseAND((1 << LEVEL) - 1).cast("int")
        celled = open_rows.withColumn("cell", cell)
        sums = celled.groupBy("parent", "cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")).withColumn("depth", F.lit(depth))
        schema = "parent string, cell int, shard string, depth int, shard_bytes long, shard_rows long, closed boolean"
        directory = sums.groupBy("parent").applyInPandas(_directory(limit), schema)
        placed = saved(celled.join(directory, ["parent", "cell"]), "placed")
        done.append(placed.where("closed").select("row_id", "shard", "depth", "shard_bytes", "shard_rows"))
        depth += LEVEL
        if depth == 2 * WORD or placed.where("NOT closed").isEmpty():
            # after all bits of both hashes no two rows are left together but by a collision of 112 bits
            done.append(placed.where("NOT closed").select("row_id", "shard", "depth", "shard_bytes", "shard_rows"))
            break
        open_rows = placed.where("NOT closed").select("row_id", "hash", "second", "bytes", F.col("shard").alias("parent"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def sharded(docs: DataFrame, limit: int) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): ``doc_id, bytes, shard, depth, shard_bytes, shard_rows``.

    ``shard`` is the text of the bits that name the shard, ``depth`` their number. No shard is over ``limit`` bytes unless a single row is;
    that row is a shard of its own. Bytes are those of the text in UTF-8; a null text has none. Rows of one id, nulls too, stay
    together as long as they fit. An empty table gives an empty result.
    """
    docs = take(docs, doc_id="long", text="string")
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), key_hash(F.col("doc_id")).alias("hash"))
    rows = saved(rows.withColumn("row_id", F.monotonically_increasing_id()), "rows")
    return rows.join(assigned(rows, limit), "row_id").select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, limit: int, path: str) -> None:
    """All columns of ``docs`` as Parquet, a folder ``shard=...`` for each shard (``shard=_`` if one holds all)."""
    staged = saved(docs.withColumn("_row_id", F.monotonically_increasing_id()), "staged")
    plain = take(staged, doc_id="long", text="string", _row_id="long")
    rows = plain.select(
        F.col("_row_id").alias("row_id"), key_hash(F.col("doc_id")).alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")
    )
    names = assigned(rows, limit).select(F.col("row_id").alias("_row_id"), F.concat(F.lit("_"), "shard").alias("_shard"))
    out = staged.join(names, "_row_id").drop("_row_id").withColumnRenamed("_shard", "shard")
    out.repartition("shard").write.partitionBy("shard").parquet(path)
