"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens. Pieces that fill a sequence alone are done. The others
are dealt to blocks of bounded size by hash, and each block is packed by several islands, each with a population
of its own. An individual is a division of the block's pieces into bins. Crossover injects whole well-filled
bins of one parent into the other, removes the bins that hold a piece twice, and puts the displaced pieces back
by best fit, the longest first. After each epoch an island's elite moves to the next island of its block, as rows of a
table. An island stops as soon as it needs no more bins than the total length demands.

Only lengths and bin numbers travel; token ids stay where they were made.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.tokens import Encoder
from wardloom.llm.work import saved, take

CAPACITY = 2048
BLOCK = 8192  # pieces of a block, about
ISLANDS, EPOCHS = 3, 2
POPULATION, GENERATIONS, ELITE = 4, 8, 2
_SHIFT = 24  # bins of a block are numbered below this power of two


# --- tokens ------------------------------------------------------------------------------------------------


def pieces(docs: DataFrame, encoder_args: tuple, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if kept, ``ids``: the documents' tokens with an end token, cut.

    Only documents longer than the capacity are cut; their first piece takes what is left over.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        encoder = Encoder(*encoder_args)
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            held = 0

            def flush():
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = list(rows)[: 6 if keep_ids else 5]
                return pa.record_batch([pa.array(rows[k], t) for k, t in zip(names, types)], names)

            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.each(batch.column("text"))):
                ids = np.array([*found, end_id], "<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                    own = ids[s:e]
                    for name, value in zip(rows, (doc_id, k, s, e - s, zlib.crc32(own.tobytes()), own.astype(np.int32) if keep_ids else None)):
                        rows[name].append(value)
                held += len(ids)
                if held >= 1 << 20:
                    yield flush()
                    held = 0
                    for values in rows.values():
                        values.clear()
            if held:
                yield flush()

    return docs.mapInArrow(run, schema)


# --- bins --------------------------------------------------------------------------------------------------


class Bins:
    """Open bins, found by the room that is left."""

    def __init__(self, capacity: int, load: np.ndarray) -> None:
        self.capacity, self.n = capacity, len(load)
        self.by_room = sorted((capacity - int(x)) << _SHIFT | k for k, x in enumerate(load.tolist()) if x < capacity)

    def put(self, length: int) -> int:
        """The bin with the least room that is enough, or a new one."""
        at = bisect.bisect_left(self.by_room, length << _SHIFT)
        if at < len(self.by_room):
            key = self.by_room.pop(at)
            room, k = key >> _SHIFT, key & ((1 << _SHIFT) - 1)
        else:
            room, k, self.n = self.capacity, self.n, self.n + 1
        if room > length:
            bisect.insort(self.by_room, (room - length) << _SHIFT | k)
        return k


def _filled(bin_of: np.ndarray, lengths: np.ndarray, todo: np.ndarray, load: np.ndarray, capacity: int) -> np.ndarray:
    """The division completed by best fit of the pieces ``todo`` in the order given."""
    bins = Bins(capacity, load)
    bin_of = bin_of.copy()
    bin_of[todo] = [bins.put(x) for x in lengths[todo].tolist()]
    return bin_of


def _tidy(bin_of: np.ndarray) -> np.ndarray:
    return np.unique(bin_of, return_inverse=True)[1].astype(np.int32)


def fitness(bin_of: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Bins, then minus the mean square of how full they are: less is better."""
    load = np.bincount(bin_of, lengths)
    load = load[load > 0]
    return len(load), -float(np.mean((load / capacity) ** 2))


def seeded(lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Best fit in an order that falls with length, disturbed."""
    order = np.argsort(-lengths * rng.uniform(0.7, 1.3, len(lengths)), kind="stable")
    return _filled(np.full(len(lengths), -1), lengths, order, np.zeros(0), capacity)


def crossed(one: np.ndarray, other: np.ndarray, lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """``one`` with about half the well-filled bins of ``other``; see the module's text."""
    load = np.bincount(other, lengths)
    good = load >= np.quantile(load, 0.5)
    chosen = good & (rng.random(len(load)) < 0.5)
    injected = chosen[other]
    hit = np.zeros(one.max() + 1, bool)
    hit[one[injected]] = True  # bins of `one` that hold a piece that is injected
    displaced = np.flatnonzero(hit[one] & ~injected)
    child = np.where(injected, other + one.max() + 1, one)
    child[displaced] = -1
    kept = child >= 0
    child[kept] = _tidy(child[kept])
    load = np.bincount(child[kept], lengths[kept]) if kept.any() else np.zeros(0)
    displaced = displaced[np.argsort(-lengths[displaced], kind="stable")]
    return _filled(child, lengths, displaced, load, capacity)


def loosened(bin_of: np.ndarray, lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Mutation: the emptiest bins and a few others are broken up and their pieces put back by best fit."""
    load = np.bincount(bin_of, lengths)
    broken = (load <= np.quantile(load, 0.02)) | (rng.random(len(load)) < 0.02)
    todo = np.flatnonzero(broken[bin_of])
    child = bin_of.copy()
    child[todo] = -1
    kept = child >= 0
    child[kept] = _tidy(child[kept])
    load = np.bincount(child[kept], lengths[kept]) if kept.any() else np.zeros(0)
    return _filled(child, lengths, todo[np.argsort(-lengths[todo], kind="stable")], load, capacity)


def evolved(lengths: np.ndarray, elites: list[np.ndarray], seed: int, capacity: int = CAPACITY) -> list[np.ndarray]:
    """The best individuals of an island after an epoch, the best first."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity)
    people = [(fitness(e, lengths, capacity), e) for e in elites]
    people.sort(key=lambda p: p[0])
    while len(people) < POPULATION and (not people or people[0][0][0] > least):
        person = seeded(lengths, capacity, rng)
        people.append((fitness(person, lengths, capacity), person))
        people.sort(key=lambda p: p[0])
    for _ in range(GENERATIONS):
        if people[0][0][0] <= least:
            break
        children = []
        for _ in range(POPULATION // 2):
            one, other = rng.integers(0, len(people), 2)
            child = crossed(people[min(one, other)][1], people[max(one, other)][1], lengths, capacity, rng)
            child = loosened(_tidy(child), lengths, capacity, rng)
            children.append((fitness(child, lengths, capacity), _tidy(child)))
        people = sorted(people + children, key=lambda p: p[0])[:POPULATION]
    return [_tidy(e) for _, e in people[:ELITE]]


# --- islands -----------------------------------------------------------------------------------------------

_ELITE_SCHEMA = "block long, island int, bins int, score double, bin_of binary"


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, lengths = table.column("piece_id").to_numpy(), table.column("length").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], lengths[order]


def _epoch(number: int, capacity: int):
    def run(key, members: pa.Table, elites: pa.Table) -> pa.Table:
        if not members.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(("block", "island", "bins", "score", "bin_of"), (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary()))})
        block, island = (x.as_py() for x in key)
        _, lengths = _ordered(members)
        arrived = [np.frombuffer(x.as_buffer(), np.int32) for x in elites.column("bin_of")]
        best = evolved(lengths, arrived, 1000 * number + 10 * block % 1_000_003 + island, capacity)
        scores = [fitness(e, lengths, capacity) for e in best]
        return pa.table(
            {
                "block": pa.array([block] * len(best), pa.int64()), "island": pa.array([island] * len(best), pa.int32()),
                "bins": pa.array([s[0] for s in scores], pa.int32()), "score": pa.array([s[1] for s in scores]),
                "bin_of": pa.array([e.astype(np.int32).tobytes() for e in best], pa.binary()),
            }
        )

    return run


def _placed(key, members: pa.Table, best: pa.Table) -> pa.Table:
    ids, lengths = _ordered(members)
    bin_of = np.frombuffer(best.column("bin_of")[0].as_buffer(), np.int32) if members.num_rows else np.zeros(0, np.int32)
    order = np.argsort(bin_of, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.flatnonzero(np.diff(bin_of[order], prepend=-1))
    offset = before - np.repeat(before[first], np.diff(np.append(first, len(order))))
    return pa.table(
        {"piece_id": pa.array(ids[order], pa.int64()), "sequence_id": pa.array((key[0].as_py() << _SHIFT) + bin_of[order].astype(np.int64)),
         "offset": pa.array(offset.astype(np.int64))}
    )


def placements(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``piece_id, sequence_id, offset`` for ``(piece_id, length)`` with unique ids and lengths of 1 to ``capacity``."""
    full = sized.where(F.col("length") == capacity).select("piece_id", (-1 - F.col("piece_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = sized.where(F.col("length") < capacity)
    blocks = max(1, round(short.count() / BLOCK))
    members = short.withColumn("block", F.pmod(F.xxhash64("piece_id"), F.lit(blocks)))
    settled = members.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    elites = sized.sparkSession.createDataFrame([], _ELITE_SCHEMA)
    for number in range(EPOCHS):
        # an island keeps its elite and gets that of the island before it
        moved = elites.union(elites.withColumn("island", (F.col("island") + 1) % ISLANDS))
        elites = saved(
            settled.groupBy("block", "island").cogroup(moved.groupBy("block", "island")).applyInArrow(_epoch(number, capacity), _ELITE_SCHEMA),
            "elites",
        )
    best = elites.groupBy("block").agg(F.min_by("bin_of", F.struct("bins", "score", "island")).alias("bin_of"))
    placed = members.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(_placed, "piece_id long, sequence_id long, offset long")
    return full.union(placed)


def pack(docs: DataFrame, encoder_args: tuple, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text; others are ignored).

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if kept, ``ids``. Sequences hold at most ``capacity``
    tokens, without gaps. A null or empty text is its end token alone. Repeated rows are packed each time; a null
    doc_id stays null. An empty table gives an empty result. Texts of any length are taken whole.
    """
    docs = take(docs, doc_id="long", text="string")
    cut = saved(pieces(docs, encoder_args, capacity, keep_ids=keep_ids).withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    return cut.join(placements(cut.select("piece_id", "length"), capacity), "piece_id").drop("piece_id")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of packed pieces that kept their ids."""
    part = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # never more than a sequence holds
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(part, lambda p: p["ids"])).alias("ids"))
