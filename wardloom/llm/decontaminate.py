"""Benchmark passages inside documents, found by the CGK embedding and bit sampling, then checked by edit distance.

The CGK embedding walks over a word sequence x: at step j it writes the word it stands on and goes on by one if a
random bit of (j, word) says so. Two sequences at a small edit distance walk apart at an edit and fall into
step again soon, so their embeddings differ in few places. A repetition takes its own random bits and its own
few steps (``SAMPLED``); windows and items that write the same words there meet. Repetitions are as many as it takes to
reach the target recall, measured beforehand on a thousand random copies with the greatest number of edits that still
counts, whatever the number of items: repetitions are added until enough of the copies have been met.

A window begins at a word and is as long as the shortest item of a band of like lengths; of the items as many of
their first words are walked. Equal words write the same, so exact passages always meet. Walks start only where a window can be near an item at all: a word that no item has costs an edit, so a stretch
with too many such words rules its windows out. This loses nothing. Every candidate is checked exactly, by the
bit-parallel search for the item within the stretch.

The pass over documents is a projection without any shuffle. Items travel to the tasks in blocks of bounded size;
a larger benchmark takes several passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.text import HashTable, mix, pieces, word_hashes
from wardloom.llm.work import take

PERCENT_EDITS = 20  # an item of n words matches within floor(n * 20 / 100) word edits
SAMPLED = 3
TARGET = 0.95
COPIES = 1000  # random copies that a group of items is measured by
COPY_WORDS = 1 << 22  # words of these copies, which bounds their number for items of thousands of words
GROUPS = 8
ITEM_WORDS = 1 << 20  # words of the items that travel to the tasks at once: 8 MB
SCHEMA = "doc_id long, item_id long, n_words long, distance long, start_word long, end_word long"
_STEP = np.uint64(0xA24BAED4963EE407)


def allowed(n):
    return n * PERCENT_EDITS // 100


def _bits(symbols: np.ndarray, repetition: int) -> np.ndarray:
    """64 random bits for each word; step j uses bit j modulo 64 of the word's hash for step j // 64."""
    return mix(symbols ^ mix(np.array([repetition + 1], np.uint64)))


def walked(symbols: np.ndarray, starts: np.ndarray, stop: np.ndarray, repetition: int, steps: np.ndarray) -> np.ndarray:
    """What walks from ``starts`` write at the given steps, as one hash each.

    A walk that reaches ``stop`` (the end of its text) stays there and writes nothing.
    """
    place = starts.copy()
    key = np.zeros(len(starts), np.uint64)
    last = int(steps[-1])
    wanted = set(steps.tolist())
    for block in range(last // 64 + 1):
        bits = _bits(symbols, repetition * 1000 + block)
        for j in range(block * 64, min(last + 1, block * 64 + 64)):
            if j in wanted:
                key = mix(key * _STEP + np.where(place < stop, symbols[place], np.uint64(0)))
            on = (bits[place] >> np.uint64(j % 64) & np.uint64(1)).astype(place.dtype)
            place += on * (place < stop)
    return key


def edited(item: np.ndarray, edits: int, rng) -> np.ndarray:
    """The item after so many random edits by new words, at different places, of which none undoes another."""
    kinds = dict(zip(rng.choice(len(item), edits, replace=False).tolist(), rng.integers(0, 3, edits).tolist()))
    fresh = iter(rng.integers(1, 1 << 62, edits).tolist())
    out: list[int] = []
    deleted = False
    for i, w in enumerate(item.tolist()):
        kind = kinds.get(i, -1)
        if kind == 2 and (i == 0 or deleted):  # a new word before all others is no edit, and one for a deleted word is one in all
            kind = 0
        deleted = kind == 1
        if kind in (0, 2):
            out.append(next(fresh))
        if kind in (-1, 2):
            out.append(w)
    return np.array(out, np.uint64)


class Band:
    """Items of similar numbers of words, with the keys they meet windows by."""

    def __init__(self, low: int, items: list[int], words: list[np.ndarray], seed: int) -> None:
        self.items = np.array(items)
        lengths = np.array([len(words[i]) for i in items])
        self.low, self.longest = low, int(lengths.max())
        edits = allowed(lengths)
        # from where a passage begins, as many words as it has at least hold at most as many foreign ones as it has edits:
        # for each number of edits the fewest words
        fewest: dict[int, int] = {}
        for n, k in zip((lengths - edits).tolist(), edits.tolist()):
            fewest[k] = min(fewest.get(k, n), max(1, n))
        self.gates = sorted(fewest.items())
        self.symbols = np.concatenate([*(words[i] for i in items), np.zeros(1, np.uint64)])
        ends = np.cumsum(lengths)
        self.size = int(lengths.min())  # a window is as long as the shortest item of its band
        self.starts = ends - lengths
        self.stops = self.starts + self.size
        rng = np.random.default_rng(seed)
        reach = max(1, self.size * 3 // 2)  # a walk goes on every second step: by then it is through most of a window
        self.draw = lambda: np.sort(rng.choice(reach, min(SAMPLED, reach), replace=False))
        self.rounds: list[tuple[int, np.ndarray]] = []
        for group in self._alike(lengths):
            self._reach_target([words[i] for i in group], np.random.default_rng(seed + 1), seed)

    def _alike(self, lengths: np.ndarray) -> list[np.ndarray]:
        """The items in at most ``GROUPS`` groups of like shares of edits: rare lengths are measured for themselves."""
        kinds = sorted(set(lengths.tolist()), key=lambda n: (-allowed(n) / n, n))
        return [self.items[np.isin(lengths, part)] for part in np.array_split(kinds, min(GROUPS, len(kinds)))]

    def _reach_target(self, words: list[np.ndarray], rng, seed: int) -> None:
        """Adds repetitions until the target share of random copies of these items is met, by two standard errors.

        Every copy has the greatest number of edits and is judged by itself, by the repetitions that the search takes.
        However few the items, there are as many copies.
        """
        n = max(100, min(COPIES, COPY_WORDS // (2 * self.size)))
        wanted = n * TARGET + 2 * np.sqrt(n * TARGET * (1 - TARGET))
        order = rng.permutation(len(words))
        flat, own, starts, copies = [], [], [], []
        at = 0
        for c in range(n):
            item = words[order[c % len(words)]]
            copy = edited(item, allowed(len(item)), rng)
            # windows further on in the copy that the gates let pass meet the item as well
            shifts = range(1 + min(8, max(0, len(copy) - max(1, len(item) - allowed(len(item))))))
            after = rng.integers(1, 1 << 62, self.size).astype(np.uint64)
            text = np.concatenate([copy, after])[: self.size + shifts[-1]]
            flat += [item[: self.size], text, np.zeros(1, np.uint64)]
            own.append(at)
            starts += [at + self.size + k for k in shifts]
            copies += [c] * len(shifts)
            at += self.size + len(text) + 1
        flat, own, starts, copies = np.concatenate(flat), np.array(own), np.array(starts), np.array(copies)
        met = np.zeros(n, bool)
        r = 0
        while r == 0 or met.sum() < wanted:
            if r == len(self.rounds):
                self.rounds.append((seed + r, self.draw()))
            left = np.flatnonzero(~met)
            other = np.flatnonzero(~met[copies])
            begin = np.concatenate([own[left], starts[other]])
            key = walked(flat, begin, begin + self.size, *self.rounds[r])
            item_key = np.zeros(n, np.uint64)
            item_key[left] = key[: len(left)]
            met[copies[other[key[len(left) :] == item_key[copies[other]]]]] = True
            r += 1

    def keys(self) -> list[tuple[int, np.ndarray, HashTable, np.ndarray, np.ndarray]]:
        """Per repetition: seed, steps, the keys that items have, and the items of each key."""
        out = []
        for r, steps in self.rounds:
            own = walked(self.symbols, self.starts, self.stops, r, steps)
            order = np.argsort(own, kind="stable")
            unique, first = np.unique(own[order], return_index=True)
            out.append((r, steps, HashTable(unique), np.append(first, len(own)), self.items[order]))
        return out


def banded(words: list[np.ndarray]) -> list[Band]:
    """Items with words, in bands of lengths that grow by half."""
    bands: dict[int, list[int]] = {}
    edges = [1, 2, 3, 5, 8]
    while edges[-1] < max((len(w) for w in words), default=0):
        edges.append(edges[-1] * 3 // 2)
    for i, w in enumerate(words):
        if len(w):
            bands.setdefault(int(np.searchsorted(edges, len(w), "right")), []).append(i)
    return [Band(edges[b - 1], items, words, 7000 * b) for b, items in sorted(bands.items())]


def within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least number of word edits between the item and any stretch of the text, and where the first such stretch ends."""
    n = len(item)
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for at, w in enumerate(text.tolist()):
        eq = places.get(w, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, at + 1
    return best, end


def _openings(band: Band, foreign: np.ndarray) -> np.ndarray:
    """Words at which a passage of the band can begin, by the number of foreign words that follow.

    A count may run over the end of its text; words beyond the last text count as none.
    """
    n = len(foreign)
    total = np.concatenate([[0], np.cumsum(foreign, dtype=np.int32)])
    can = np.zeros(n, bool)
    for most, span in band.gates:
        span = min(span, n)
        inside = n - span + 1
        can[:inside] |= total[span:] - total[:inside] <= most
        can[inside:] |= total[n] - total[inside:n] <= most
    return np.flatnonzero(can)


def _candidates(band: Band, keys, symbols, at, foreign) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, item) of windows that meet an item in any repetition."""
    starts = _openings(band, foreign)
    if not len(starts):
        return
    stop = np.minimum(at[np.searchsorted(at, starts, "right")], starts + band.size)
    # walks read only the words after their starts: the others are left out
    opened = np.zeros(len(symbols) + band.size + 1, np.int32)
    opened[starts] += 1
    opened[starts + band.size + 1] -= 1
    near = np.flatnonzero(np.cumsum(opened)[: len(symbols)])
    place = np.searchsorted(near, starts)
    part, part_stop = np.append(symbols[near], np.zeros(1, np.uint64)), place + (stop - starts)
    for r, steps, table, first, items in keys:
        row = table.find(walked(part, place, part_stop, r, steps))
        hit = np.flatnonzero(row >= 0)
        if not len(hit):
            continue
        count = first[row[hit] + 1] - first[row[hit]]
        begin = np.repeat(first[row[hit]], count)
        step = np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)
        yield np.repeat(starts[hit], count), items[begin + step]


def _finder(items: list[tuple[int | None, np.ndarray]]):
    """A function that makes, in a task, one that gives the passages of these items in an Arrow batch.

    Each is ``row, item_id, n_words, distance, first word, word beyond the last``.
    """
    ids = [i for i, _ in items]
    words = [w for _, w in items]
    bands = banded(words)

    def made():
        keyed = [(band, band.keys()) for band in bands]
        table = HashTable(np.unique(np.concatenate(words)))

        def find(batch: pa.RecordBatch) -> list[tuple]:
            hashes, at = word_hashes(batch.column("text"))
            symbols = np.append(hashes, np.zeros(1, np.uint64))
            foreign = table.find(hashes) < 0
            found: dict[tuple[int, int], list[int]] = {}
            for band, keys in keyed:
                for starts, hit in _candidates(band, keys, symbols, at, foreign):
                    docs = np.searchsorted(at, starts, "right") - 1
                    for d, i, s in zip(docs.tolist(), hit.tolist(), starts.tolist()):
                        found.setdefault((d, i), []).append(s)
            out = []
            for (d, i), starts in found.items():
                best = _best(hashes[at[d] : at[d + 1]], words[i], np.unique(starts) - at[d])
                if best is not None:
                    out.append((d, ids[i], len(words[i]), *best))
            return out

        return find

    return made


def _best(text: np.ndarray, item: np.ndarray, starts: np.ndarray) -> tuple[int, int, int] | None:
    """Distance, first and last word (beyond) of the stretch nearest to the item, around the given starts; None if too far."""
    n, most = len(item), allowed(len(item))
    best = None
    cuts = np.flatnonzero(np.diff(starts) > n) + 1  # starts near each other are looked at together
    for group in np.split(starts, cuts):
        low, high = max(0, int(group[0]) - most), min(len(text), int(group[-1]) + n + 2 * most)
        part = text[low:high]
        distance, end = within(item, part)
        if distance <= most and (best is None or distance < best[0]):
            back = part[max(0, end - n - most) : end][::-1]
            best = distance, low + end - _reach(item[::-1], back, distance), low + end
    return best


def _reach(item: np.ndarray, text: np.ndarray, distance: int) -> int:
    """Words of the shortest beginning of ``text`` at that distance from the whole item."""
    row = np.arange(len(item) + 1)
    steps = np.arange(len(item) + 1)
    if row[-1] == distance:
        return 0
    for at, w in enumerate(text):
        cost = np.minimum(row[1:] + 1, row[:-1] + (item != w))
        row = np.minimum.accumulate(np.concatenate([[at + 1], cost]) - steps) + steps
        if row[-1] <= distance:
            return at + 1
    return len(text)


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_words, distance, start_word, end_word`` of each row of ``docs`` and item of ``benchmark`` it holds.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Words are those of ``text.word_hashes``. A
    document holds an item of n words when a stretch of its words is within ``floor(n * 20 / 100)`` word edits of it; the
    nearest stretch is given, of equal ones the first. Pairs reported are always true, and exact passages are always found;
    of those with as many edits as allowed, ``TARGET`` are expected to be.

    Null and empty texts hold nothing, and items without words are held by none. Repeated rows of documents are each
    reported; repeated items (equal ids and texts) once. Null ids stay null. Empty tables give an empty result. Texts
    of any length are taken whole.
    """
    docs = take(docs, doc_id="long", text="string")
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def runner(made):
        def run(batches):
            find = made()
            for piece in (p for batch in batches for p in pieces(batch)):
                out = find(piece)
                row, *rest = (pa.array([o[k] for o in out], pa.int64()) for k in range(6))
                yield pa.record_batch([piece.column("doc_id").take(row), *rest], names)

        return run

    for listed in _slices(benchmark):
        found = found.union(docs.mapInArrow(runner(_finder(listed)), SCHEMA))
    return found


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item of ``benchmark``; see ``passages``."""

    def runner(made):
        def run(batches):
            find = made()
            for piece in (p for batch in batches for p in pieces(batch)):
                clean = np.ones(piece.num_rows, bool)
                clean[[o[0] for o in find(piece)]] = False
                yield piece.filter(pa.array(clean))

        return run

    for listed in _slices(benchmark):
        docs = docs.mapInArrow(runner(_finder(listed)), docs.schema)
    return docs


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The items with words, in slices of about ``ITEM_WORDS`` words."""
    items = take(benchmark, item_id="long", text="string").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    slices = max(1, -(-int(size) // (2 * ITEM_WORDS)))  # a word and the space after it have two characters at least
    for k in range(slices):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).toArrow()
        hashes, at = word_hashes(own.column("text"))
        listed = [(i, hashes[s:e]) for i, s, e in zip(own.column("item_id").to_pylist(), at[:-1], at[1:]) if e > s]
        if listed:
            yield sorted(listed, key=lambda x: (x[0] is None, x[0] or 0, x[1].tobytes()))
