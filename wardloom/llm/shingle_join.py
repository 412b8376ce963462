"""N-gram Jaccard join: documents whose word shingle sets are similar, found by PartEnum signatures.

Sets of nearly equal size are compared inside a size band. Two sets of one band whose Jaccard similarity is at
least t differ in at most ``k = floor(2 hi (1 - t) / (1 + t))`` elements, ``hi`` being the band's largest size.
Their domain is cut by a hash of the element into ``k // 2 + 1 + e`` groups of ``PARTS`` = 3 partitions each. At least
``1 + e`` groups then hold one of the differing elements or none, and leaving out one partition of such a group leaves
equal elements on both sides. So every subset of two partitions of every group is enumerated, and a signature is the
subset's number with a hash of what it holds. Bands with k below ``SMALL`` have ``k + 1 + e`` single partitions instead,
of which at least ``1 + e`` are equal. Only subsets that hold something give signatures, and a group is poor if one of
its subsets holds nothing. A set with at most e poor groups meets its like in one of the others; a set with more also gives
signatures under the next partitioning, and so on until one fits it; of two such sets the first to stop makes the pair meet.
A set gives signatures for its own band and the next, so that it meets all sets it can be similar to.

A wide sketch has one parity bit of the elements in each of about as many parts as there are elements, a sketch in
at most ``SKETCH_BITS`` parts. Each element in which two sets differ turns at most one bit, so the count of unlike bits
bounds the difference from below: sketches never drop a link. Buckets are compared by sketches as wide as the band
needs, and no pair is written before.

Equal sets are one class from the start. Then links are looked for in two rounds: first each member of a bucket
beside the bucket's first member and the one before it, which ties large groups of near copies together with
a number of pairs linear in the rows; then only members that lie in different components by then and that sketches
leave possible, each pair about once. For that, buckets with the same smallest set meet in one place, so that a set and its
sketch travel once for all of these buckets. No list of all pairs in a group of links is made. A task holds at most one
slice of the sets that meet beside another.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.text import mix, pieces, sequence_hash, shingle_hashes, word_hashes
from wardloom.llm.work import components, saved, take

WORDS = 5
PERCENT = 80
PARTS, SMALL = 3, 8
LEAST_BITS, SKETCH_BITS = 8, 11  # a sketch has as many parts as a power of two between these
SLICE = 1024  # sets of a head compared at once
ROW = 512  # a set's signatures under one head are cut into a row for each so many shingles
FIRST = 8  # signatures of a set by which a pair's first common one is told
ROWS_OUT = 1 << 16
FILTER_BITS = 24  # size of the filter of wanted documents, fixed: 2 MB

_INT = np.int64
_ODD, _SKETCH_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Distinct shingles, sorted; with fewer words than ``size`` the whole sequence is one; without words none."""
    if len(words) < size:
        return np.array([sequence_hash(words)], np.uint64) if len(words) else np.zeros(0, np.uint64)
    found = shingle_hashes(words, size)
    found.sort()
    fresh = np.empty(len(found), bool)
    fresh[0] = True
    np.not_equal(found[1:], found[:-1], out=fresh[1:])
    return found[fresh]


def set_id(elements: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number; sets of equal elements share it."""
    total = (elements * (elements >> np.uint64(32) | _ODD)).sum(dtype=np.uint64)
    return int(mix(np.array([total ^ (np.uint64(len(elements)) << np.uint64(40))], np.uint64)).view(_INT)[0])


def wide_sketch(elements: np.ndarray) -> np.ndarray:
    """Parity of the number of elements in each part, eight parts a byte; as many parts as elements or up to twice as many.

    A sketch of half as many parts is the first half of the bytes with the second half over it.
    """
    bits = max(LEAST_BITS, (len(elements) - 1).bit_length())
    parts = (elements * _SKETCH_ODD >> np.uint64(32) & np.uint64((1 << bits) - 1)).astype(_INT)
    parity = np.bincount(parts, minlength=1 << bits).astype(np.uint8) & 1
    # byte b holds the parts b, b + bytes, b + 2 bytes ...: bytes fold as parts do
    return np.packbits(parity.reshape(8, -1), axis=0)[0]


def folded(wide: np.ndarray, size: int) -> np.ndarray:
    """Sketches (along the last axis) of ``size`` bytes, from wider ones."""
    while wide.shape[-1] > size:
        half = wide.shape[-1] // 2
        wide = wide[..., :half] ^ wide[..., half:]
    return wide


def sketch(elements: np.ndarray) -> np.ndarray:
    return folded(wide_sketch(elements), 1 << SKETCH_BITS - 3)


def unlike(one: bytes, other: bytes) -> int:
    """Parts of unlike parity at the narrower of two widths."""
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum(dtype=_INT))


def bands(percent: int, largest: int) -> np.ndarray:
    """First size of each band: a set in one band is similar at most to sets in it and the next to it."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * 100 // percent + 1)
    edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges, _INT)


@functools.lru_cache(4096)
def _odd(band: int, attempt: int) -> tuple[np.uint64, np.uint64]:
    """A multiplier that deals elements to partitions, and a salt for what the partitions hold."""
    a, b = mix(np.array([(band << 8) + attempt, (band << 8) + attempt + (1 << 50)], np.uint64) + np.uint64(77))
    return a | np.uint64(1), b


@functools.lru_cache(4)
def _edges(percent: int) -> list[int]:
    return bands(percent, 1 << 40).tolist()


def signatures(elements: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All signatures of a set; see the module's text."""
    n = len(elements)
    if not n:
        return np.zeros(0, np.uint64)
    edges = _edges(percent)
    own = bisect.bisect_right(edges, n) - 1
    content = elements * (elements >> np.uint64(29) | _ODD)
    out = []
    for band in (own, own + 1):
        high = edges[band + 1] - 1
        k = 2 * high * (100 - percent) // (100 + percent)
        many, parts = (k // 2 + 1, PARTS) if k >= SMALL else (k + 1, 1)
        spare = many // 8 + (k >= SMALL)
        groups = many + spare
        count = groups * parts
        for attempt in range(64):
            odd, salt = _odd(band, attempt)
            part = (elements * odd >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
            part = part.astype(np.uint16 if count < 1 << 16 else np.uint32)  # short numbers are sorted by radix
            order = part.argsort(kind="stable")
            held = np.bincount(part, minlength=count)
            first = np.cumsum(held) - held
            filled = np.flatnonzero(held)
            sums = np.zeros(count, np.uint64)
            sums[filled] = np.add.reduceat(content[order], first[filled])
            if parts > 1:  # of each group, the subsets that leave one partition out
                held, sums = held.reshape(-1, parts), sums.reshape(-1, parts)
                held, sums = held.sum(1, keepdims=True) - held, sums.sum(1, keepdims=True) - sums
            else:
                held, sums = held[:, None], sums[:, None]
            index = np.arange(count, dtype=np.uint64).reshape(held.shape)
            some = held > 0
            out.append(mix(mix(sums[some] + salt) + index[some]))
            if int((~some).any(1).sum()) <= spare:
                break
        else:  # so small a set that every partitioning leaves it sparse: it also meets its like by size alone
            out.append(mix(np.array([salt ^ _ODD], np.uint64)))
    return np.concatenate(out)


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    """The set of each row in turn."""
    for piece in pieces(batch):
        hashes, at = word_hashes(piece.column("text"))
        for i in range(piece.num_rows):
            yield shingle_set(hashes[at[i] : at[i + 1]], words)


def described(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, set_id`` and the sketches of every document."""

    def run(batches):
        for batch in batches:
            rows = []
            for s in _sets(batch, words):
                wide = wide_sketch(s)
                rows.append((len(s), set_id(s), folded(wide, 1 << SKETCH_BITS - 3).tobytes(), wide.tobytes()))
            n, ids, parity, wide = zip(*rows) if rows else ((), (), (), ())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(parity, pa.binary()), pa.array(wide, pa.binary())],
                ["doc_id", "n_shingles", "set_id", "sketch", "wide"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_id long, sketch binary, wide binary")


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``signature, set_id`` of every set; a set seen before in the same task is not given again while it is remembered."""

    def run(batches):
        seen: set[int] = set()
        sig, ids, held = [], [], 0

        def flush():
            return pa.record_batch([pa.array(np.concatenate(sig).view(_INT)), pa.array(np.concatenate(ids))], ["signature", "set_id"])

        for batch in batches:
            for elements in _sets(batch, words):
                name = set_id(elements)
                if name in seen or not len(elements):
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(name)
                own = signatures(elements, percent)
                sig.append(own)
                ids.append(np.full(len(own), name))
                held += len(own)
                if held >= ROWS_OUT:
                    yield flush()
                    sig, ids, held = [], [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "signature long, set_id long")


def _shared(signed: DataFrame) -> DataFrame:
    """Rows of signatures that two different sets or more have, one row for each set: ``signature, set_id, head, before``.

    ``head`` is the first set of the bucket and ``before`` the one ahead of this row, both null in a bucket's first
    row. Reads sorted rows in one pass and holds no bucket.
    """

    def batch_of(sig, ids, head, before, first):
        nulls = np.asarray(first, bool)
        return pa.record_batch(
            [pa.array(sig), pa.array(ids), pa.array(head, pa.int64(), mask=nulls), pa.array(before, pa.int64(), mask=nulls)],
            ["signature", "set_id", "head", "before"],
        )

    def run(batches):
        last_sig = last_id = last_head = None
        pending = False  # the row before has not been given yet

        for batch in batches:
            sig, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            keep = np.ones(len(sig), bool)  # not a copy of the row before
            keep[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
            keep[0] = last_sig != sig[0] or last_id != ids[0]
            sig, ids = sig[keep], ids[keep]
            if not len(sig):
                continue
            goes_on = last_sig == sig[0]
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            new[0] = not goes_on
            member = ~new
            member[:-1] |= ~new[1:]
            lead = np.where(new, np.arange(len(sig)), -1)
            lead = np.maximum.accumulate(lead)
            head = np.where(lead >= 0, ids[lead], last_head if goes_on else 0)
            before = np.concatenate([[last_id if goes_on else 0], ids[:-1]])
            if goes_on and pending:
                yield batch_of(np.array([last_sig]), np.array([last_id]), np.array([0]), np.array([0]), [True])
            yield batch_of(sig[member], ids[member], head[member], before[member], new[member])
            last_sig, last_id, last_head, pending = int(sig[-1]), int(ids[-1]), int(head[-1]), not bool(member[-1])

    ordered = signed.repartition("signature").sortWithinPartitions("signature", "set_id")
    return ordered.mapInArrow(run, "signature long, set_id long, head long, before long")


class Sketches:
    """Sketches of rows, of several widths."""

    def __init__(self, raw: list[bytes]) -> None:
        self.size = np.array([len(x) for x in raw], _INT)
        self.at = np.zeros(len(raw), _INT)
        self.rows = {}
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == size)
            self.at[own] = np.arange(len(own))
            self.rows[size] = np.frombuffer(b"".join([raw[i] for i in own.tolist()]), np.uint8).reshape(-1, size)

    def _folded(self, rows: np.ndarray, size: int) -> np.ndarray:
        out = np.empty((len(rows), size), np.uint8)
        for own, held in self.rows.items():
            here = np.flatnonzero(self.size[rows] == own)
            if len(here):
                out[here] = folded(held[self.at[rows[here]]], size)
        return out.view(np.uint64)

    def unlike(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Parts of unlike parity of each pair of rows, at the narrower of the two widths."""
        out = np.zeros(len(left), _INT)
        size = np.minimum(self.size[left], self.size[right])
        for width in np.unique(size).tolist():
            own = np.flatnonzero(size == width)
            step = max(1, (1 << 22) // width)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                out[part] = np.bitwise_count(self._folded(left[part], width) ^ self._folded(right[part], width)).sum(-1, dtype=_INT)
        return out


def _pairs_batch(a, b) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _chained(buckets: DataFrame) -> DataFrame:
    """Of each bucket, every member with the first and with the one before it."""
    rows = buckets.where("head IS NOT NULL")
    both = rows.select("set_id", F.col("head").alias("other")).union(rows.select("set_id", "before"))
    return both.select(F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b")).distinct()


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and wide sketches leave possible: every link is among them."""
    one = reps.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("wide").alias("wide_a"))
    two = reps.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("wide").alias("wide_b"))

    def run(batches):
        for batch in batches:
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            far = [unlike(x.as_py(), y.as_py()) for x, y in zip(batch.column("wide_a"), batch.column("wide_b"))]
            good = np.array(far, _INT) * (100 + percent) <= (100 - percent) * n
            yield _pairs_batch(batch.column("a").to_numpy()[good], batch.column("b").to_numpy()[good])

    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.join(one, "a").join(two, "b").where(sized).mapInArrow(run, "a long, b long")


def _crossed(buckets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket that lie in different components and that sizes and sketches leave possible.

    ``buckets`` has ``signature, set_id, head, root, n_shingles``. Buckets of one head, their smallest set, hold much the
    same sets, so they meet together: a set comes there once, with its sketch and all its signatures in these buckets. The
    sets of a head are cut into slices, and each two slices meet in a group of their own, so that no task holds more than
    two slices at once, and the groups of a large head go to many tasks.
    """

    def run(batches):
        rest = None  # the last meeting of the batches so far may go on in the next

        def columns(batch):
            names = ("head", "low", "high", "side", "set_id", "n_shingles", "root")
            held = batch.column("signatures")
            lists = np.split(held.flatten().to_numpy(), np.cumsum(held.value_lengths().to_numpy())[:-1])
            objects = np.empty((2, batch.num_rows), object)
            objects[0, :], objects[1, :] = batch.column("sketch").to_pylist(), lists
            first = batch.column("first").flatten().to_numpy().reshape(-1, FIRST)
            return [*[batch.column(c).to_numpy() for c in names], *objects, first]

        def smallest(pairs, common):
            """Each pair once, with the smallest signature that it has in common here."""
            pairs, common = np.concatenate(pairs), np.concatenate(common)
            order = np.lexsort((common, pairs))
            pairs, common = pairs[order], common[order]
            fresh = np.ones(len(pairs), bool)
            fresh[1:] = pairs[1:] != pairs[:-1]
            return pairs[fresh], common[fresh]

        def compare(head, low, high, side, ids, n, root, raw, lists, first):
            sketches = Sketches(raw.tolist())
            new = (np.diff(head) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
            meeting = np.concatenate([[0], np.cumsum(new)])
            row = np.repeat(np.arange(len(ids)), [len(x) for x in lists])
            sig = np.concatenate(lists)
            order = np.lexsort((sig, meeting[row]))
            row, sig = row[order], sig[order]
            bucket = np.concatenate([[0], np.cumsum((np.diff(sig) != 0) | (np.diff(meeting[row]) != 0))])
            # each row with the one d places after it, as long as any two are of one bucket
            left, d = np.arange(len(row)), 0
            pairs, common, held = [np.zeros(0, _INT)], [np.zeros(0, _INT)], 0
            while len(left):
                d += 1
                left = left[: np.searchsorted(left, len(row) - d)]
                left = left[bucket[left] == bucket[left + d]]
                i, j = row[left], row[left + d]
                good = (root[i] != root[j]) & ((low[i] == high[i]) | (side[i] != side[j]))
                i, j = i[good], j[good]
                sized = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                i, j = i[sized], j[sized]
                pairs.append(np.minimum(i, j) * len(ids) + np.maximum(i, j))
                common.append(sig[left][good][sized])
                held += len(i)
                if held > 1 << 22:
                    pairs, common, held = *[[x] for x in smallest(pairs, common)], 0
            pairs, common = smallest(pairs, common)
            i, j = np.divmod(pairs, len(ids))
            near = sketches.unlike(i, j) * (100 + percent) <= (100 - percent) * (n[i] + n[j])
            i, j, common = i[near], j[near], common[near]
            if len(i):
                # a pair is written at its first common signature, as far as both sets' first ones tell
                one, two = first[i], first[j]
                earlier = (one[:, :, None] == two[:, None, :]).any(2) & (one < common[:, None])
                i, j = ids[i[~earlier.any(1)]], ids[j[~earlier.any(1)]]
                if len(i):  # a set of several rows is compared by each
                    yield _pairs_batch(*np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1), axis=0).T)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = columns(batch)
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            head, low, high = now[:3]
            last = (head == head[-1]) & (low == low[-1]) & (high == high[-1])
            done = len(head) - int(last.sum())
            rest = [x[done:] for x in now]
            if done:
                yield from compare(*[x[:done] for x in now])
        if rest is not None:
            yield from compare(*rest)

    ends = buckets.groupBy("signature").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    mixed = buckets.join(ends.where("r0 <> r1").select("signature"), "signature", "left_semi")
    # the signatures of a long set go to several rows, so that no row is long
    row = F.pmod(F.xxhash64("signature"), 1 + F.floor(F.col("n_shingles") / ROW)).alias("row")
    members = mixed.groupBy("head", "set_id", "root", "n_shingles", row).agg(F.collect_list("signature").alias("signatures"))
    members = saved(members.drop("row"), "members")
    sizes = members.groupBy("head").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    cut = members.join(sizes, "head").withColumn("slice", F.pmod(F.xxhash64("set_id"), F.col("slices")).cast("int"))
    # a slice meets itself and every other: (low, high) names the meeting, side tells which of the two a row is
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "head", "set_id", "root", "n_shingles", "signatures",
        F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"),
        (F.col("slice") > F.col("other")).cast("int").alias("side"),
    )
    first = members.groupBy("set_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("signatures"))), 1, FIRST).alias("first"))
    first = first.select("set_id", F.concat("first", F.array_repeat(F.lit((1 << 63) - 1), FIRST - F.size("first"))).alias("first"))
    about = reps.select("set_id", "sketch").join(first, "set_id")
    ordered = met.join(about, "set_id").repartition("head", "low", "high").sortWithinPartitions("head", "low", "high")
    return ordered.mapInArrow(run, "a long, b long")


def _marked(ids: DataFrame) -> np.ndarray:
    """A bit for each possible hash of the ids: 2 MB whatever their number."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits")
    )
    found = words.toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that are links, by the sets themselves. Only documents that stand for a set in a pair are read in full."""
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    ids = wanted.join(reps.select("set_id", F.col("rep").alias("doc_id")), "set_id").select("doc_id").distinct()
    marked = _marked(ids)  # a filter lets few others through; what it lets through in excess falls out of the join

    def run(batches):
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((marked[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)))
            for elements in _sets(batch, words):
                yield pa.record_batch(
                    [pa.array([set_id(elements)], pa.int64()), pa.array([elements.tobytes()], pa.binary())], ["set_id", "elements"]
                )

    texts = docs.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)))
    sets = texts.mapInArrow(run, "set_id long, elements binary").dropDuplicates(["set_id"])
    sets = saved(sets.join(wanted, "set_id", "left_semi"), "sets")
    left = sets.select(F.col("set_id").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("set_id").alias("b"), F.col("elements").alias("right"))

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([one, two])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(one) + len(two) - common))
            good = np.array(good, bool)
            yield _pairs_batch(batch.column("a").to_numpy()[good], batch.column("b").to_numpy()[good])

    return pairs.join(left, "a").join(right, "b").mapInArrow(check, "a long, b long")


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): ``doc_id, n_shingles, component_id``.

    Two documents are linked when ``100 * |A and B| >= percent * |A or B|`` for their sets of ``words``-word shingles.
    ``component_id`` is the smallest doc_id reachable by links, itself included.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. A text of fewer
    words is one shingle. Repeated rows come back repeated, in one component. Rows of one doc_id with different
    texts are documents of their own. A null doc_id is linked with nothing and has a null component. An empty
    table gives an empty result. Texts of any length are taken whole. Sets are told apart by 64-bit hashes.
    """
    docs = take(docs, doc_id="long", text="string")
    about = saved(described(docs, words), "sets-about")
    known = docs.where("doc_id IS NOT NULL")
    reps = (
        about.where("doc_id IS NOT NULL AND n_shingles > 0")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
    )
    reps = saved(reps, "set-reps")
    buckets = saved(_shared(_signed(known, words, percent)), "buckets")
    first = saved(_likely(_chained(buckets), reps, percent), "pairs")
    links = saved(_verified(known, reps, first, words, percent), "links")
    roots = components(links)
    placed = reps.select("set_id", "n_shingles").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    placed = placed.withColumn("root", F.coalesce("root", "set_id"))
    rooted = buckets.select("signature", "set_id", F.coalesce("head", "set_id").alias("head")).join(placed, "set_id")
    second = _crossed(rooted, reps, percent).distinct().join(first, ["a", "b"], "left_anti")
    second = saved(second, "pairs")  # ruled out by sketches already, as wide as those of all but very long sets
    more = saved(_verified(known, reps, second, words, percent), "links")
    roots = components(links.union(more))
    classes = reps.select("set_id", "rep").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    classes = classes.withColumn("root", F.coalesce("root", "set_id"))
    smallest = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = classes.join(smallest, "root").select("set_id", "component_id")
    return about.join(labels, "set_id", "left").select(
        "doc_id", "n_shingles",
        F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
