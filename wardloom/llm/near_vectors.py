"""Embedding near-duplicates: int8 tile products with error bounds, full precision only where they leave doubt.

A unit vector u is held as ``s q`` with q of int8 and an error e = u - s q whose length is known exactly. The
product of two such vectors is then known to within ``(1 + |e_u|) |e_v| + |e_u|``: below the threshold by more
than that, a pair is no link; above it by more than that, it is one; the pairs between are computed again from
the given components in double precision. Integer products of up to 1000 dimensions are exact in float32, so
tiles run through the matrix product of the numeric library.

Equal vectors are one class with a weight before anything is compared. Classes are dealt to blocks by hash, and
every two blocks meet in one group, which holds two blocks and no more. A tile gives counts per vector and a
spanning set of its links, never the links themselves, so a dense cluster costs rows in proportion to its members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.work import components, saved, take

BLOCK = 8192  # vectors of a block
LEAST_BLOCKS = 8  # so that a small table is still spread over tasks
TILE = 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers in -127..127 (as float32), their scale and the length of the error, for unit rows in double."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None])
    error = np.linalg.norm(x - q * scale[:, None], axis=1)
    return q.astype(np.float32), scale, error


def _linked(x, y, quant_x, quant_y, threshold) -> np.ndarray:
    """Which pairs of rows are links, as a boolean tile. x, y: the given components in double."""
    (qx, sx, ex), (qy, sy, ey) = quant_x, quant_y
    product = qx @ qy.T
    # a first look with the largest bound of the tile, a little widened for the rounding of this comparison
    widest = ex.max() + ey.max() + ex.max() * ey.max() + 1e-5
    product *= sy.astype(np.float32)
    rows, cols = np.nonzero(product >= ((threshold - widest) / sx).astype(np.float32)[:, None])
    tile = np.zeros(product.shape, bool)
    if not len(rows):
        return tile
    near = product[rows, cols].astype(np.float64) * sx[rows]
    bound = ex[rows] + ey[cols] + ex[rows] * ey[cols] + 1e-5
    sure = near - bound >= threshold
    tile[rows[sure], cols[sure]] = True
    doubt = np.flatnonzero(~sure & (near + bound >= threshold))
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    for at in range(0, len(doubt), 1 << 15):
        r, c = rows[doubt[at : at + (1 << 15)]], cols[doubt[at : at + (1 << 15)]]
        exact = np.einsum("ij,ij->i", x[r], y[c]) >= threshold * (norm_x[r] * norm_y[c])
        tile[r[exact], c[exact]] = True
    return tile


def _spanning(tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of true cells that connect all that the true cells connect, at most rows + columns."""
    rows, cols = np.nonzero(tile)
    if len(rows) <= sum(tile.shape):
        return rows, cols
    out_r, out_c = [], []
    row_new, col_new = tile.any(1), tile.any(0)
    for start in np.flatnonzero(row_new).tolist():
        if not row_new[start]:
            continue
        row_new[start] = False
        front = np.array([start])
        while len(front):
            part = tile[front]
            reached = np.flatnonzero(part.any(0) & col_new)
            if not len(reached):
                break
            col_new[reached] = False
            out_r.append(front[part[:, reached].argmax(0)])
            out_c.append(reached)
            part = tile[:, reached]
            front = np.flatnonzero(part.any(1) & row_new)
            row_new[front] = False
            out_r.append(front)
            out_c.append(reached[part[front].argmax(1)])
    return np.concatenate(out_r), np.concatenate(out_c)


def _compare(threshold):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names = table.column("name").to_numpy()
        weight = table.column("weight").to_numpy()
        side = table.column("side").to_numpy()
        raw = b"".join(table.column("vector").to_pylist())
        x = np.frombuffer(raw, np.float32).reshape(len(names), -1).astype(np.float64)
        q, scale, error = quantised(x / np.linalg.norm(x, axis=1)[:, None])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        right = left if within else right
        counts = np.zeros(len(names), np.int64)
        a, b = [], []
        for i in range(0, len(left), TILE):
            r = left[i : i + TILE]
            for j in range(i if within else 0, len(right), TILE):
                c = right[j : j + TILE]
                tile = _linked(x[r], x[c], (q[r], scale[r], error[r]), (q[c], scale[c], error[c]), threshold)
                if within and i == j:
                    np.fill_diagonal(tile, False)
                if not tile.any():
                    continue
                counts[r] += tile @ weight[c]
                if not (within and i == j):
                    counts[c] += tile.T @ weight[r]
                edge_r, edge_c = _spanning(tile)
                a.append(names[r[edge_r]])
                b.append(names[c[edge_c]])
        hit = np.flatnonzero(counts)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        # one table for both: counts have no b
        return pa.table(
            {
                "a": pa.array(np.concatenate([names[hit], a])),
                "b": pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(b)]),
                "links": pa.array(np.concatenate([counts[hit], np.zeros(len(a), np.int64)])),
            }
        )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding; others are ignored): ``vec_id, n_links, component_id, kept``.

    Two vectors are linked when their cosine in double precision is ``threshold`` or more. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest vec_id reachable, ``kept`` tells whether that is the row's own.

    Vectors that are null, empty, zero or hold nulls, NaN or infinities are linked with nothing; vectors of
    different lengths are not linked with each other. Repeated rows are linked and come back repeated. A row
    without vec_id counts as a link of others, has a null component if no row with an id is reachable, and is never
    kept. An empty table gives an empty result. Equal vectors are told by a 64-bit hash of their bytes.
    """
    rows = take(vectors, vec_id="long", embedding="array<float>")
    number = F.transform("embedding", lambda x: x.cast("double"))
    squares = F.aggregate(number, F.lit(0.0), lambda total, x: total + x * x)  # null, NaN or infinite if a component is
    good = F.coalesce(squares > 0, F.lit(False)) & F.coalesce(squares < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(squares), F.lit(True))
    rows = rows.withColumn("good", good).withColumn("name", F.when(F.col("good"), F.xxhash64("embedding", F.size("embedding"))))
    named = saved(rows.select("vec_id", "name"), "vectors-named")
    classes = (
        rows.where("good").groupBy("name").agg(F.count("*").alias("weight"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"))
    )

    def packed(batches):
        for batch in batches:
            vectors_ = batch.column("embedding")
            raw = vectors_.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            at = np.concatenate([[0], np.cumsum(vectors_.value_lengths().to_numpy())])
            data = pa.array([raw[s:e].tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())
            yield pa.record_batch(
                [batch.column("name"), batch.column("weight"), batch.column("least"), pa.array(np.diff(at), pa.int64()), data],
                ["name", "weight", "least", "size", "vector"],
            )

    classes = saved(classes.mapInArrow(packed, "name long, weight long, least long, size long, vector binary"), "vector-classes")
    blocks = max(LEAST_BLOCKS, -(-classes.count() // BLOCK))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "name", "weight", "vector", "size",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    found = saved(met.groupBy("size", "low", "high").applyInArrow(_compare(threshold), "a long, b long, links long"), "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("name")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "name")
    about = classes.select("name", "weight", "least").join(counts, "name", "left").join(roots, "name", "left")
    about = about.withColumn("root", F.coalesce("root", "name"))
    least = about.groupBy("root").agg(F.min("least").alias("component_id"))
    about = about.join(least, "root").select("name", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = named.join(about, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
