"""Hard negatives by inner product, from cover trees over norm-augmented candidates.

Candidates x become whole numbers. Inside a block, one more coordinate ``sqrt(M^2 - |x|^2)`` puts all of them on a
sphere of radius M, the block's greatest norm, and adds nothing to an inner product with a query, whose own is zero. So
the angle between a query and a candidate on that sphere says the score, and a node whose candidates lie within an angle
``t`` of its centre has scores between ``|q| M cos(f + t)`` and ``|q| M cos(f - t)``, ``f`` being the query's angle to the centre.

A tree is built level by level: the centres below a node are a net, far apart from each other, that covers the node's
candidates within a radius smaller by ``BASE``, and each node keeps the greatest angle it really has. A search goes down
best first, for all queries of a group at once: nodes whose bounds lie outside a query's window, or below the scores it has
already, are left out for this query, and candidates below the others are verified by their exact scores.

Blocks hold one label each: the rows nearest to one pivot, split by hash where they are many. Pivots come from a bounded
sample of the rows (``PIVOTS``), which decides how well blocks are pruned, never what is found. Groups of queries first meet
a summary of every block (its root, and some of its candidates, whose scores are first thresholds); only the queries that a
block can serve are sent to it.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.llm.work import saved, take

BLOCK = 2048  # candidates of a block
BLOCK_BYTES = 1 << 23  # of their numbers, whatever the width
LEAF = 16
BASE = 1.5
SEEDS = 32  # candidates of a block that its summary holds
PIVOTS, PIVOT_BYTES = 1024, 1 << 25
ANCHORS = 512  # anchors of a group
SUMMARIES = 128  # summaries of blocks that meet a group in one task
VISITS = 4  # visits of a group to a block that a task makes
LOWEST = -(1 << 62)  # no score of two rows is outside of +-2^62, see `candidates`


# --- rows of numbers as bytes ------------------------------------------------------------------------------


def packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as held:
        return {name: held[name] for name in held.files}


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the shortest type."""
    top = int(np.abs(x).max()) if x.size else 0
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def matrix(rows: list[bytes]) -> np.ndarray:
    """Rows of whole numbers, the shorter ones ending in zeros."""
    found = [np.frombuffer(raw, {2: "<i2", 4: "<i4", 8: "<i8"}[raw[0]], offset=1) for raw in rows]
    out = np.zeros((len(found), max(map(len, found), default=0)), np.int64)
    for i, row in enumerate(found):
        out[i, : len(row)] = row
    return out


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def scores(q: np.ndarray, x: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products of rows of whole numbers; ``top`` bounds the product of their norms."""
    if top < 1 << 52:  # then no partial sum leaves the range in which doubles are exact
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T  # wraps on the way, but the result fits


# --- a tree ------------------------------------------------------------------------------------------------


def _parts(near: np.ndarray, middle: int, members: np.ndarray, away: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Members dealt to centres that cover them within a radius smaller by ``BASE``: the farthest member becomes one until all are."""
    enough = float(away.max()) / BASE**2
    centres, owner = [middle], np.zeros(len(members), np.int64)
    while True:
        far = int(away.argmax())
        if away[far] <= enough:
            break
        other = 1 - near[members[far], members]
        owner[other < away] = len(centres)
        away = np.minimum(away, other)
        centres.append(int(members[far]))
    order = owner.argsort(kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(centres)))
    return list(zip(centres, np.split(members[order], ends[:-1])))


def grown(x: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree over the rows of ``x``: each node's centre and angle, its child nodes, and the rows directly below it.

    Nodes are numbered level by level. The children of node i are nodes ``child_at[i]`` to ``child_at[i + 1]``, its rows
    ``rows[row_at[i] : row_at[i + 1]]``. Parts of one row are no nodes, but rows of the node above.
    """
    real = x.astype(np.float64)
    squares = (real * real).sum(1)
    top = float(squares.max())
    extra = np.sqrt(np.maximum(top - squares, 0))
    near = np.clip((real @ real.T + np.outer(extra, extra)) / (top or 1.0), -1, 1)  # cosines on the sphere
    rounding = 1e-9
    centre, angle, rows, child_at, row_at = [], [], [], [1], [0]
    waiting = [(0, np.arange(len(x)))]
    while waiting:
        following = []
        for middle, members in waiting:
            away = 1 - near[middle, members]  # half the square of the distance, by the square of M
            radius = float(away.max())
            centre.append(middle)
            angle.append(np.arccos(max(1 - radius - rounding, -1.0)))
            direct, below = [members], []
            if len(members) > LEAF and radius > rounding:
                parts = _parts(near, middle, members, away)
                direct, below = [part for _, part in parts if len(part) == 1], [part for part in parts if len(part[1]) > 1]
            rows += direct
            following += below
            child_at.append(child_at[-1] + len(below))
            row_at.append(row_at[-1] + sum(map(len, direct)))
        waiting = following
    return {
        "centre": np.array(centre), "angle": np.array(angle), "top": np.array([np.sqrt(top)]),
        "child_at": np.array(child_at), "row_at": np.array(row_at), "rows": np.concatenate(rows),
    }


def bounds(score: np.ndarray, lengths: np.ndarray, top: float, angle) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score below nodes of an angle, for queries of these norms whose scores with the centres are given."""
    reach = lengths[:, None] * top
    turn = np.arccos(np.clip(np.divide(score, reach, out=np.zeros(score.shape), where=reach > 0), -1, 1))
    slack = 1e-7 * reach + 1e-3  # covers the rounding of the angles
    return reach * np.cos(np.minimum(turn + angle, np.pi)) - slack, reach * np.cos(np.maximum(turn - angle, 0)) + slack


class Found:
    """The best ``k`` scores of each query so far, with ids: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()  # below `least` a score is of no use
        self.score, self.id = np.full((n, k), LOWEST), np.zeros((n, k), np.int64)

    def add(self, queries: np.ndarray, score: np.ndarray, good: np.ndarray, ids: np.ndarray) -> None:
        """Scores of ``queries`` (rows) with the candidates ``ids`` (columns), where ``good``."""
        some = good.any(1)
        if not some.any():
            return
        queries, score, good = queries[some], score[some], good[some]
        if score.shape[1] > self.k:
            best = np.where(good, score, LOWEST)
            good &= score >= np.partition(best, -self.k, axis=1)[:, -self.k, None]
        row, column = np.nonzero(good)
        held_row, held_column = np.nonzero(self.score[queries] > LOWEST)
        rows = np.concatenate([row, held_row])
        all_scores = np.concatenate([score[row, column], self.score[queries[held_row], held_column]])
        all_ids = np.concatenate([ids[column], self.id[queries[held_row], held_column]])
        order = np.lexsort((all_ids, -all_scores, rows))
        rows, all_scores, all_ids = rows[order], all_scores[order], all_ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        at = queries[rows[keep]], place[keep]
        self.score[at], self.id[at] = all_scores[keep], all_ids[keep]
        self.least[queries] = np.maximum(self.least[queries], self.score[queries, -1])


def searched(tree: dict, x: np.ndarray, ids: np.ndarray, names: np.ndarray, asked: dict, alive: np.ndarray, found: Found) -> int:
    """Best-first descent of one tree for the queries ``alive``; gives the number of scores computed."""
    q, who, lengths, high, own = asked["x"], asked["anchor"], asked["length"], asked["high"], asked["name"]
    top = float(tree["top"][0])
    reach = float(lengths[who[alive]].max(initial=0)) * top
    computed, count = 0, 1
    waiting = [(-np.inf, 0, 0, alive, np.full(len(alive), np.inf))]
    while waiting:
        _, _, node, queries, upper = heapq.heappop(waiting)
        queries = queries[upper >= found.least[queries]]  # thresholds have risen since the node was put here
        if not len(queries):
            continue
        vectors = q[who[queries]]
        rows = tree["rows"][tree["row_at"][node] : tree["row_at"][node + 1]]
        if len(rows):
            score = scores(vectors, x[rows], reach)
            computed += score.size
            good = (score >= found.least[queries, None]) & (score <= high[queries, None]) & (own[who[queries], None] != names[None, rows])
            found.add(queries, score, good, ids[rows])
        children = np.arange(tree["child_at"][node], tree["child_at"][node + 1])
        if len(children):
            score = scores(vectors, x[tree["centre"][children]], reach)
            computed += score.size
            low, upper = bounds(score, lengths[who[queries]], top, tree["angle"][children])
            possible = (upper >= found.least[queries, None]) & (low <= high[queries, None])
            upper = np.minimum(upper, high[queries, None])
            for k, child in enumerate(children.tolist()):
                some = np.flatnonzero(possible[:, k])
                if len(some):
                    count += 1
                    heapq.heappush(waiting, (-float((upper[some, k] - found.least[queries[some]]).max()), count, child, queries[some], upper[some, k]))
    return computed


# --- tables ------------------------------------------------------------------------------------------------


def candidates(rows: DataFrame, scale: int) -> DataFrame:
    """``name, vec_id, label, x``: rows that take part, numbered, their components as whole numbers; written once."""
    number = F.col("embedding")
    whole = F.transform(number, lambda v: F.floor(F.lit(float(scale)) * v))
    finite = F.forall(number, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    square = F.aggregate(number, F.lit(0.0), lambda total, v: total + (F.abs(v) * scale + 1) * (F.abs(v) * scale + 1))
    taking_part = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(F.coalesce(finite, F.lit(False)))
    # by the two norms no score of the rows that are left is outside of +-2^62
    fitting = taking_part.where(square < float(1 << 62)).select("vec_id", "label", whole.alias("x"))

    def run(batches):
        for batch in batches:
            x = batch.column("x")
            flat = x.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]).astype(np.int64)
            parts = [narrow(flat[s:e]) for s, e in zip(at[:-1], at[1:])]
            raw = [bytes([part.itemsize]) + part.tobytes() for part in parts]
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(raw, pa.binary())], ["vec_id", "label", "x"])

    return saved(fitting.mapInArrow(run, "vec_id long, label long, x binary").withColumn("name", F.monotonically_increasing_id()), "candidates")


def forest(rows: DataFrame) -> DataFrame:
    """``block, label, tree, summary`` of every block of candidates; written once."""
    n, widest = rows.agg(F.count("*"), F.max(F.length("x"))).head()
    size = max(LEAF, min(BLOCK, BLOCK_BYTES // max(widest or 1, 1)))
    limit = max(1, min(PIVOTS, PIVOT_BYTES // (4 * max(widest or 1, 1)), -(-n // size)))
    chosen = rows.select("name", "label", "x").orderBy(F.xxhash64("name"), "name").limit(limit).collect()
    pivots: dict[int, np.ndarray] = {label: matrix([bytes(r.x) for r in chosen if r.label == label]) for label in {r.label for r in chosen}}

    def nearest(batches):
        for batch in batches:
            labels = batch.column("label").to_numpy()
            cell = np.zeros(len(labels), np.int64)
            for label in np.unique(labels).tolist():
                own = np.flatnonzero(labels == label)
                middle = pivots.get(label)
                if middle is None or len(middle) == 1:
                    continue
                x = matrix([batch.column("x")[i].as_py() for i in own.tolist()]).astype(np.float64)
                width = max(x.shape[1], middle.shape[1])
                x, centre = fitted(x, width), fitted(middle, width).astype(np.float64)
                cell[own] = ((centre * centre).sum(1) - 2 * (x @ centre.T)).argmin(1)
            yield pa.record_batch([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    dealt = rows.mapInArrow(nearest, "vec_id long, label long, x binary, name long, cell long")
    dealt = saved(dealt, "dealt")
    sizes = dealt.groupBy("label", "cell").agg(F.ceil(F.count("*") / size).alias("slices"))
    cut = dealt.join(sizes, ["label", "cell"]).withColumn("slice", F.pmod(F.xxhash64("name"), "slices"))

    def run(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, [("vec_id", "ascending"), ("name", "ascending")])
        table = table.take(order).combine_chunks()
        x = matrix(table.column("x").to_pylist())
        ids, names = table.column("vec_id").to_numpy(), table.column("name").to_numpy()
        tree = grown(x)
        seeds = np.linspace(0, len(x) - 1, min(SEEDS, len(x))).astype(np.int64)
        top = {"top": tree["top"], "angle": tree["angle"][:1], "centre": narrow(x[tree["centre"][:1]])}
        block = int(names.min())  # a row's number names the block: each row is in one
        return pa.table({
            "block": pa.array([block]), "label": table.column("label").slice(0, 1),
            "tree": pa.array([packed(x=narrow(x), ids=ids, names=names, **tree)], pa.binary()),
            "summary": pa.array([packed(seeds=narrow(x[seeds]), seed_names=names[seeds], **top)], pa.binary()),
        })

    return saved(cut.groupBy("label", "cell", "slice").applyInArrow(run, "block long, label long, tree binary, summary binary"), "forest")


def best(queries: DataFrame, anchors: int, trees: DataFrame, k: int, same_label: bool) -> DataFrame:
    """The first ``k`` candidates of each query: ``name, low, high, score, vec_id``.

    Queries are ``name, label, x, low, high``: an anchor's number, label and numbers, and the window its scores must be in.
    Only rows of the anchor's label, or of others, are found, and never the anchor itself. ``anchors`` is their number.
    """
    groups, parts = max(1, -(-anchors // ANCHORS)), max(1, -(-trees.count() // SUMMARIES))
    window = "name long, low long, high long"

    def gathered(table: pa.Table) -> pa.Table:
        name, low, high = (table.column(c).to_numpy() for c in ("name", "low", "high"))
        names, first, anchor = np.unique(name, return_index=True, return_inverse=True)
        x = matrix(table.column("x").take(pa.array(first)).to_pylist())
        label = table.column("label").to_numpy()[first]
        return pa.table({"group": table.column("group").slice(0, 1), "asked": pa.array([packed(x=narrow(x), name=names, label=label, anchor=anchor, low=low, high=high)], pa.binary())})

    asked = queries.withColumn("group", F.pmod(F.xxhash64("name"), F.lit(groups)))
    asked = saved(asked.groupBy("group").applyInArrow(gathered, "group long, asked binary"), "asked")

    def routed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "asked": pa.array([], pa.binary())})
        asked = unpacked(left.column("asked")[0].as_py())
        q, who, low, high = asked["x"].astype(np.int64), asked["anchor"], asked["low"], asked["high"]
        lengths = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        found, every, meetings = Found(len(who), k, low), np.arange(len(who)), []
        for block, label, raw in zip(right.column("block").to_pylist(), right.column("label").to_pylist(), right.column("summary").to_pylist()):
            summary = unpacked(raw)
            queries_ = every[(asked["label"][who] == label) == same_label]
            if not len(queries_):
                continue
            width = max(q.shape[1], summary["seeds"].shape[1])
            own, top = fitted(q, width)[who[queries_]], float(summary["top"][0])
            reach = float(lengths.max()) * top
            score = scores(own, fitted(summary["seeds"].astype(np.int64), width), reach)
            names = summary["seed_names"]
            good = (score >= found.least[queries_, None]) & (score <= high[queries_, None]) & (asked["name"][who[queries_], None] != names[None])
            found.add(queries_, score, good, names)  # only the scores count here
            middle = scores(own, fitted(summary["centre"].astype(np.int64), width), reach)
            under, upper = bounds(middle, lengths[who[queries_]], top, summary["angle"])
            meetings.append((block, queries_, under[:, 0], upper[:, 0]))
        blocks, sent = [], []
        for block, queries_, under, upper in meetings:
            queries_ = queries_[(upper >= found.least[queries_]) & (under <= high[queries_])]
            if len(queries_):
                names, anchor = np.unique(who[queries_], return_inverse=True)
                blocks.append(block)
                sent.append(packed(x=narrow(q[names]), name=asked["name"][names], anchor=anchor, low=low[queries_], high=high[queries_], least=found.least[queries_]))
        return pa.table({"block": pa.array(blocks, pa.int64()), "asked": pa.array(sent, pa.binary())})

    tops = trees.select("block", "label", "summary", F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"))
    left = asked.withColumn("part", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))
    right = tops.withColumn("group", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")))
    meet = left.groupBy("group", "part").cogroup(right.groupBy("group", "part")).applyInArrow(routed, "block long, asked binary")
    visits = saved(meet, "visits")

    def visited(batches):
        for batch in batches:
            for raw, raw_tree in zip(batch.column("asked"), batch.column("tree")):
                asked, tree = unpacked(raw.as_py()), unpacked(raw_tree.as_py())
                width = max(asked["x"].shape[1], tree["x"].shape[1])
                asked["x"], x = (fitted(m["x"].astype(np.int64), width) for m in (asked, tree))
                asked["length"] = np.sqrt((asked["x"].astype(np.float64) ** 2).sum(1))
                found = Found(len(asked["anchor"]), k, asked["least"])
                searched(tree, x, tree["ids"], tree["names"], asked, np.arange(len(asked["anchor"])), found)
                at, place = np.nonzero(found.score > LOWEST)
                columns = [asked["name"][asked["anchor"][at]], asked["low"][at], asked["high"][at], found.score[at, place], found.id[at, place]]
                yield pa.record_batch([pa.array(c) for c in columns], ["name", "low", "high", "score", "vec_id"])

    tasks = max(1, -(-visits.count() // VISITS))
    work = visits.join(trees.select("block", "tree"), "block").select("asked", "tree").repartition(tasks)
    hits = work.mapInArrow(visited, f"{window}, score long, vec_id long")
    order = Window.partitionBy("name", "low", "high").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: str, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from vec_id, embedding, label; others are ignored.

    Components x become ``floor(scale * x)``, a score is the inner product of two rows, higher scores and then smaller ids
    come first. Anchors are the rows for which the SQL condition ``anchor`` holds. An anchor's positives are its first other
    rows of the same label; for each of them the first rows of other labels are returned whose score is from ``least`` to ``most``
    percent of the positive's.

    Rows with a null vec_id, label or vector, or with a null, NaN or infinite component, take no part; nor do rows so long
    that a score may not fit a long number (norms of 2^31 after scaling). Components that a shorter vector lacks are zeros.
    Repeated rows are rows of their own: copies of an anchor are its positives, and each copy returns its rows. An anchor
    without positives, or a positive without negatives in its window, returns none. An empty table gives an empty result.
    """
    rows = candidates(take(vectors, vec_id="long", label="long", embedding="array<double>"), scale)
    asking = rows.where(F.expr(anchor))
    anchors = asking.count()
    trees = forest(rows)
    whole = asking.select("name", "label", "x", F.lit(LOWEST + 1).alias("low"), F.lit(-LOWEST).alias("high"))
    first = best(whole, anchors, trees, positives, True)
    first = first.select("name", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("place").alias("positive_place"))
    first = saved(first, "positives")
    # 100 * score in least * positive .. most * positive; a positive's score below zero leaves no window
    low = F.expr(f"-floor(-({least} * cast(positive_score AS decimal(38, 0))) / 100)").cast("long")
    high = F.expr(f"floor({most} * cast(positive_score AS decimal(38, 0)) / 100)").cast("long")
    framed = first.withColumn("low", low).withColumn("high", high).where("low <= high")
    windows = framed.select("name", "low", "high").distinct().join(asking.select("name", "label", "x"), "name")
    second = best(windows, anchors, trees, negatives, False)
    second = second.select("name", "low", "high", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = framed.join(second, ["name", "low", "high"]).join(asking.select("name", F.col("vec_id").alias("anchor_id")), "name")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
