"""A gated recurrent language model scores whole documents.

The output is factored: a softmax over classes, then a softmax over the words of the class. The ``HEAD`` most
frequent words are dealt to classes by rank and have softmax weights of their own. All other words fall into
classes by how they end; inside such a class the distribution is that of the training counts plus one, with one
more slot for words never seen, so probabilities over the seen words and these slots add up to one. The sum of
log probabilities therefore splits in two: what depends on the order of words is computed by the network, and
what depends only on which rare words a text has comes from a join with the counts of all words.

Training is truncated backpropagation in numpy: documents are laid end to end on parallel lanes, windows of
``STEPS`` steps are propagated back, and the state is carried from window to window and cleared where a document
begins. Scoring uses the same lanes, so a document of any length is scored with its whole history. Each
training document is seen once: a round trains every partition from the same weights on its share, and the
weights are averaged in proportion to the words. Shares grow from round to round, so that later rounds start
from weights that all partitions hold in common.

Counts cover all training documents. What is sent to all tasks is bounded: ``LEXICON`` frequent words and the weights.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.text import HashTable, mix, pieces, word_hashes
from wardloom.llm.work import saved, take

HEAD, HEAD_CLASSES = 1024, 16  # words with weights of their own, and their classes
TAIL_CLASSES = 32
LEXICON = 1 << 18  # words whose counts travel to all tasks; others are joined
HIDDEN = 16
LANES, STEPS = 256, 16
COUNTED_AT_ONCE = 1 << 22  # words
TEXT_AT_ONCE = 1 << 23  # bytes laid on lanes together: long documents then rarely outlast the others
ROUNDS = ((0, 1), (1, 4), (4, 16))  # sixteenths of the training documents
RATE = 0.006

PER_CLASS = HEAD // HEAD_CLASSES
CLASSES = HEAD_CLASSES + TAIL_CLASSES
START = HEAD + TAIL_CLASSES  # the input before the first word
END = int(mix(np.array([0xE0D], np.uint64)).view(np.int64)[0])  # the end of a text stands in the counts under this name
LN10 = float(np.log(10))


def held_out(ids: list[int | None]) -> np.ndarray:
    """Which documents are kept from training: crc32 of the id as text, modulo 7, is 2. A null id counts as empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids], bool)


def tail_class(endings: np.ndarray) -> np.ndarray:
    return (mix(endings.astype(np.uint64) + np.uint64(1)) >> np.uint64(59)).astype(np.int32)


# --- counts ------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, tail, c`` over all training documents; the end of a text is one of the words."""

    def run(batches):
        held, size = [], 0

        def flush():
            words, tails = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(words)
            words, tails = words[order], tails[order]
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, int)
            counts = np.diff(np.append(first, len(words)))
            return pa.record_batch(
                [pa.array(words[first].view(np.int64)), pa.array(tails[first].astype(np.int32)), pa.array(counts)], ["word", "tail", "c"]
            )

        texts = 0
        for batch in batches:
            batch = batch.filter(pa.array(~held_out(batch.column("doc_id").to_pylist())))
            for piece in pieces(batch, size=TEXT_AT_ONCE):
                texts += piece.num_rows
                words, _, endings = word_hashes(piece.column("text"), endings=True)
                held.append((words, tail_class(endings)))
                size += len(words)
                if size >= COUNTED_AT_ONCE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        if texts:
            yield pa.record_batch([pa.array([END]), pa.array([-1], pa.int32()), pa.array([texts])], ["word", "tail", "c"])

    found = docs.mapInArrow(run, "word long, tail int, c long")
    return found.groupBy("word").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


class Lexicon:
    """What all tasks know of the counts: totals, and the most frequent words with their ranks."""

    def __init__(self, counts: DataFrame) -> None:
        step = F.floor(F.log2("c") * 8)
        bins = {int(r[0]): r[1:] for r in counts.groupBy(step.alias("b")).agg(F.count("*"), F.sum("c")).collect()}
        self.n, self.v = sum(r[1] for r in bins.values()), sum(r[0] for r in bins.values())
        room, least = LEXICON, None
        for b in sorted(bins, reverse=True):  # bins of counts, as many from the top as fit
            room -= bins[b][0]
            if room < 0:
                break
            least = b
        if least is None:  # not even the first bin fits: its first words, so that the places with weights are taken
            first = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(min(HEAD, LEXICON))
            top = counts.where(F.col("word") == END).unionByName(first).toArrow()
        else:
            top = counts.where((step >= least) | (F.col("word") == END)).toArrow()
        words, tails, c = (top.column(x).to_numpy() for x in ("word", "tail", "c"))
        order = np.lexsort((words, -c, words != END))  # the end first, then by count
        self.words, self.tails, self.c = words[order].view(np.uint64), tails[order].astype(np.int32), c[order].astype(np.int64)
        self.head = min(HEAD, len(order))
        per_tail = {r[0]: (r[1], r[2]) for r in counts.groupBy("tail").agg(F.sum("c"), F.count("*")).collect()}
        self.tail_n = np.array([per_tail.get(t, (0, 0))[0] for t in range(TAIL_CLASSES)], np.int64)
        self.tail_v = np.array([per_tail.get(t, (0, 0))[1] for t in range(TAIL_CLASSES)], np.int64)
        for t, k in zip(self.tails[: self.head], self.c[: self.head]):
            if t >= 0:
                self.tail_n[t] -= k
                self.tail_v[t] -= 1

    def known(self) -> dict:
        """Plain arrays that travel to the tasks."""
        return {k: getattr(self, k) for k in ("words", "tails", "c", "n", "v", "head", "tail_n", "tail_v")}


# --- the network -------------------------------------------------------------------------------------------


def first_weights(known: dict) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(1)
    h = HIDDEN

    def small(*shape):
        return (rng.normal(size=shape) / np.sqrt(h)).astype(np.float32)

    head = np.zeros(HEAD)
    head[: known["head"]] = known["c"][: known["head"]]
    by_class = np.concatenate([head.reshape(HEAD_CLASSES, PER_CLASS).sum(1), known["tail_n"]]) + 0.5
    words = np.where(np.arange(HEAD) < known["head"], np.log(head + 1), -30)
    return {
        "embed": small(START + 1, h), "wx": small(h, 3 * h), "wh": small(h, 3 * h), "b": np.zeros(3 * h, np.float32),
        "bn": np.zeros(h, np.float32), "wc": 0.1 * small(h, CLASSES), "bc": np.log(by_class / by_class.sum()).astype(np.float32),
        "wo": 0.1 * small(HEAD_CLASSES, h, PER_CLASS), "bo": words.reshape(HEAD_CLASSES, PER_CLASS).astype(np.float32),
    }


def _exp(logits):
    """Exponentials, in place, and their sums per row. Logits are small: states lie between -1 and 1."""
    np.minimum(logits, 60, out=logits)
    np.exp(logits, out=logits)
    return logits, logits.sum(1)


def _unroll(w, inputs, keep, state):
    """States of each step of a window, with what going back needs."""
    steps, lanes = inputs.shape
    h = HIDDEN
    given = (w["embed"][inputs.ravel()] @ w["wx"] + w["b"]).reshape(steps, lanes, 3 * h)
    states, before, inner, new = (np.empty((steps, lanes, h), np.float32) for _ in range(4))
    gates = np.empty((steps, lanes, 2 * h), np.float32)
    wh, bn = w["wh"], w["bn"]
    for t in range(steps):
        np.multiply(state, keep[t][:, None], out=before[t])
        carried = before[t] @ wh
        g = np.add(given[t, :, : 2 * h], carried[:, : 2 * h], out=gates[t])
        g *= 0.5  # the sigmoid is a tanh of half the argument
        np.tanh(g, out=g)
        g += 1
        g *= 0.5
        np.add(carried[:, 2 * h :], bn, out=inner[t])
        n = np.multiply(g[:, :h], inner[t], out=new[t])
        n += given[t, :, 2 * h :]
        np.tanh(n, out=n)
        state = np.subtract(before[t], n, out=states[t])
        state *= g[:, h:]
        state += n
    return states, state, (before, gates, inner, new)


def _output(w, states, targets, valid, grads=None):
    """Natural log probability of each target given the states; with ``grads`` also what flows back."""
    flat = states.reshape(-1, HIDDEN)
    shape, targets, rows = targets.shape, targets.ravel(), np.arange(targets.size)
    head = targets < HEAD
    classes = np.where(head, targets // PER_CLASS, targets - HEAD + HEAD_CLASSES)
    p, total = _exp(flat @ w["wc"] + w["bc"])
    out = np.log(p[rows, classes] / total)
    back = None
    if grads is not None:
        p /= total[:, None]
        p[rows, classes] -= 1
        if not valid.all():
            p *= valid.ravel()[:, None]
        grads["wc"], grads["bc"] = flat.T @ p, p.sum(0)
        back = p @ w["wc"].T
        grads["wo"], grads["bo"] = np.zeros_like(w["wo"]), np.zeros_like(w["bo"])
    mine = np.flatnonzero(head & valid.ravel())
    mine = mine[np.argsort(classes[mine].astype(np.uint8), kind="stable")]
    cuts = np.searchsorted(classes[mine], np.arange(HEAD_CLASSES + 1)).tolist()
    own, words, place = flat[mine], targets[mine] % PER_CLASS, np.arange(len(mine))
    p = np.empty((len(mine), PER_CLASS), np.float32)
    for k in range(HEAD_CLASSES):
        at = slice(cuts[k], cuts[k + 1])
        np.matmul(own[at], w["wo"][k], out=p[at])
        p[at] += w["bo"][k]
    p, total = _exp(p)
    out[mine] += np.log(p[place, words] / total)
    if grads is not None:
        p /= total[:, None]
        p[place, words] -= 1
        inner = np.empty_like(own)
        for k in range(HEAD_CLASSES):
            at = slice(cuts[k], cuts[k + 1])
            grads["wo"][k], grads["bo"][k] = own[at].T @ p[at], p[at].sum(0)
            np.matmul(p[at], w["wo"][k].T, out=inner[at])
        back[mine] += inner
    return out.reshape(shape), back


def _descend(w, inputs, keep, trail, back, grads):
    """Gradients of the recurrent part; nothing flows back beyond the window."""
    steps, lanes = inputs.shape
    h = HIDDEN
    before, gates, inner, new = trail
    r, z = gates[..., :h], gates[..., h:]
    back = back.reshape(steps, lanes, h)
    to_new = (1 - z) * (1 - new * new)
    to_z = (before - new) * z * (1 - z)
    to_r = inner * r * (1 - r)
    flow = np.empty((steps, lanes, 3 * h), np.float32)
    fresh = np.empty((steps, lanes, h), np.float32)
    wh_t = np.ascontiguousarray(w["wh"].T)
    down = np.zeros((lanes, h), np.float32)
    for t in range(steps - 1, -1, -1):
        down += back[t]
        d_new = np.multiply(down, to_new[t], out=fresh[t])
        f = flow[t]
        np.multiply(d_new, to_r[t], out=f[:, :h])
        np.multiply(down, to_z[t], out=f[:, h : 2 * h])
        np.multiply(d_new, r[t], out=f[:, 2 * h :])
        down *= z[t]
        down += f @ wh_t
        down *= keep[t][:, None]
    flat = flow.reshape(-1, 3 * h)
    grads["wh"] = before.reshape(-1, h).T @ flat
    grads["bn"] = flat[:, 2 * h :].sum(0)
    flat[:, 2 * h :] = fresh.reshape(-1, h)
    ids = inputs.ravel()
    grads["wx"] = w["embed"][ids].T @ flat
    grads["b"] = flat.sum(0)
    d_in = flat @ w["wx"].T
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    grads["embed"] = (ids[order][first], np.add.reduceat(d_in[order], first))


class Adam:
    def __init__(self, w):
        self.w, self.step = w, 0
        self.m, self.s = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}

    def update(self, grads, scale):
        self.step += 1
        rate = RATE * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            rows = slice(None)
            if k == "embed":
                rows, g = g  # only the inputs of this window move
            g = g * np.float32(scale)
            np.clip(g, -0.1, 0.1, out=g)
            self.m[k][rows] = m = 0.9 * self.m[k][rows] + 0.1 * g
            self.s[k][rows] = s = 0.99 * self.s[k][rows] + 0.01 * g * g
            self.w[k][rows] -= np.float32(rate) * m / (np.sqrt(s) + np.float32(1e-6))


# --- lanes -------------------------------------------------------------------------------------------------


def laid_out(symbols: np.ndarray, at: np.ndarray, end: int):
    """Documents end to end on lanes, the longest first, each next one on the shortest lane.

    Gives inputs, targets, whether the state is kept and the document of each cell (-1: none), lane by lane,
    the fullest lane first.
    """
    lengths = np.diff(at) + 1
    lanes = min(LANES, len(lengths), max(16, int(lengths.sum()) // 1024))  # little text: fewer lanes, more steps
    filled = np.zeros(lanes, np.int64)
    place = np.empty((len(lengths), 2), np.int64)
    for doc in np.argsort(-lengths, kind="stable").tolist():
        lane = int(filled.argmin())
        place[doc] = lane, filled[lane]
        filled[lane] += lengths[doc]
    order = np.argsort(-filled, kind="stable")
    rank = np.empty(lanes, np.int64)
    rank[order] = np.arange(lanes)
    targets = np.zeros((lanes, int(filled.max())), np.int32)
    inputs = np.zeros_like(targets)
    doc_of = np.full(targets.shape, -1, np.int32)
    keep = np.ones(targets.shape, np.float32)
    for doc, (lane, s) in enumerate(place.tolist()):
        lane, e = rank[lane], s + int(lengths[doc])
        words = symbols[at[doc] : at[doc + 1]]
        targets[lane, s : e - 1] = words
        targets[lane, e - 1] = end
        inputs[lane, s] = START
        inputs[lane, s + 1 : e] = words
        doc_of[lane, s:e] = doc
        keep[lane, s] = 0
    return inputs, targets, keep, doc_of, filled[order]


def windows(layout):
    """``inputs, targets, keep, document`` of each window, step by step, over the lanes that still hold something."""
    inputs, targets, keep, doc_of, filled = layout
    for t in range(0, inputs.shape[1], STEPS):
        live = int((filled > t).sum())
        cut = (slice(0, live), slice(t, t + STEPS))
        yield tuple(np.ascontiguousarray(x[cut].T) for x in (inputs, targets, keep, doc_of))


def train(w, layout, adam):
    state = np.zeros((len(layout[0]), HIDDEN), np.float32)
    for inputs, targets, keep, doc_of in windows(layout):
        valid = doc_of >= 0
        states, state, trail = _unroll(w, inputs, keep, state[: inputs.shape[1]])
        grads = {}
        _, back = _output(w, states, targets, valid, grads)
        _descend(w, inputs, keep, trail, back, grads)
        adam.update(grads, 1 / valid.sum())


def log10_of(w, layout, n_docs):
    """Sum of log10 probabilities that the network gives for each document."""
    total = np.zeros(n_docs)
    state = np.zeros((len(layout[0]), HIDDEN), np.float32)
    for inputs, targets, keep, doc_of in windows(layout):
        valid = doc_of >= 0
        states, state, _ = _unroll(w, inputs, keep, state[: inputs.shape[1]])
        logp, _ = _output(w, states, targets, valid)
        valid = valid.ravel()
        total += np.bincount(doc_of.ravel()[valid], logp.ravel()[valid], n_docs)
    return total / LN10


# --- over the corpus ---------------------------------------------------------------------------------------


def _symbols(find, words, endings):
    """Head words by rank, all others by the class of their ending."""
    rank = find(words)
    return np.where(rank >= 0, rank, HEAD + tail_class(endings))


def packed(w):
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unpacked(flat, like):
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _round(docs: DataFrame, known: dict, flat: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Weights after one share of the training documents, averaged over the partitions."""
    part = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(16))
    mine = docs.where((part >= share[0]) & (part < share[1]))

    def learn(batches):
        w = unpacked(flat, first_weights(known))
        adam, seen = Adam(w), 0
        find = HashTable(known["words"][: known["head"]]).find
        for batch in batches:
            batch = batch.filter(pa.array(~held_out(batch.column("doc_id").to_pylist())))
            for piece in pieces(batch, size=TEXT_AT_ONCE):
                words, at, endings = word_hashes(piece.column("text"), endings=True)
                train(w, laid_out(_symbols(find, words, endings), at, 0), adam)
                seen += len(words) + piece.num_rows
        if seen:
            yield pa.record_batch([pa.array([(packed(w) * np.float64(seen)).tobytes()], pa.binary()), pa.array([float(seen)])], ["sum", "seen"])

    def add(batches):
        total, seen = 0, 0.0
        for batch in batches:
            for data, n in zip(batch.column("sum"), batch.column("seen")):
                total = total + np.frombuffer(data.as_buffer(), np.float64)
                seen += n.as_py()
        if seen:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([seen])], ["sum", "seen"])

    schema = "sum binary, seen double"
    many = mine.rdd.getNumPartitions()
    # sums of sums: no task reads more than about the square root of the partitions, the driver four rows
    sums = mine.mapInArrow(learn, schema).repartition(max(1, round(many**0.5))).mapInArrow(add, schema)
    rows = sums.repartition(min(4, max(1, round(many**0.5)))).mapInArrow(add, schema).collect()
    if not rows:
        return flat
    return sum(np.frombuffer(r[0], np.float64) for r in rows) / sum(r[1] for r in rows)


def _scored(docs: DataFrame, known: dict, flat: np.ndarray) -> DataFrame:
    """All that bounded knowledge gives; words outside the lexicon are listed with their numbers."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, net double, rare array<struct<word:long,tail:int,n:int>>"
    rare_type = pa.list_(pa.struct([("word", pa.int64()), ("tail", pa.int32()), ("n", pa.int32())]))
    slots = known["n"] + known["v"] + 1
    in_class = np.log10(known["tail_n"] + known["tail_v"] + 1)

    def run(batches):
        w = unpacked(flat, first_weights(known))
        find = HashTable(known["words"]).find
        logs = np.log10(known["c"] + 1.0)
        for batch in batches:
            for piece in pieces(batch, size=TEXT_AT_ONCE):
                n = piece.num_rows
                words, at, endings = word_hashes(piece.column("text"), endings=True)
                row, tail = find(words), tail_class(endings)
                net = log10_of(w, laid_out(np.where((row >= 0) & (row < known["head"]), row, HEAD + tail), at, 0), n)
                doc = np.repeat(np.arange(n), np.diff(at))
                seen = row >= 0
                hit = np.zeros(len(words))
                hit[seen] = logs[row[seen]]
                end = np.log10((known["c"][0] if len(known["c"]) else 0) + 1.0)  # the end stands first
                base = np.bincount(doc, hit, n) + end
                base -= (np.bincount(doc, seen, n) + 1) * np.log10(slots)
                flat_tail = seen & (row >= known["head"])
                net += np.bincount(doc[flat_tail], hit[flat_tail] - in_class[tail[flat_tail]], n)
                # words that are not in the lexicon, once for each document
                other = np.flatnonzero(~seen)
                other = other[np.lexsort((words[other], doc[other]))]
                fresh = np.ones(len(other), bool)
                fresh[1:] = (words[other][1:] != words[other][:-1]) | (doc[other][1:] != doc[other][:-1])
                first = np.flatnonzero(fresh)
                times = np.diff(np.append(first, len(other))).astype(np.int32)
                chosen = other[first]
                inner = pa.StructArray.from_arrays(
                    [pa.array(words[chosen].view(np.int64)), pa.array(tail[chosen]), pa.array(times)], fields=list(rare_type.value_type)
                )
                cuts = np.searchsorted(doc[chosen], np.arange(n + 1)).astype(np.int32)
                ids = piece.column("doc_id")
                known_here = np.bincount(doc, seen, n) + (len(known["c"]) > 0)
                yield pa.record_batch(
                    [ids, pa.array(held_out(ids.to_pylist())), pa.array(np.diff(at) + 1), pa.array(known_here.astype(np.int64)),
                     pa.array(base), pa.array(net), pa.ListArray.from_arrays(pa.array(cuts), inner, type=rare_type)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "net", "rare"],
                )

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored).

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: whether the document was kept from training,
    its tokens with the end, how many of them the training texts have, the number of training tokens, the log10
    probability under counts plus one, and that of the network.

    A null or empty text is the end token alone. Repeated rows are scored, and learned from, each time. A null
    doc_id counts as the empty text where documents are divided. An empty table gives an empty result; without
    training documents all counts are zero. Words are told apart by 64-bit hashes.
    """
    docs = take(docs, doc_id="long", text="string")
    counts = saved(word_counts(docs), "word-counts")
    known = Lexicon(counts).known()
    flat = packed(first_weights(known))
    for share in ROUNDS:
        flat = _round(docs, known, flat, share)
    scored = saved(_scored(docs, known, flat).withColumn("row_id", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.*")
    c = F.coalesce(F.col("c"), F.lit(0))
    in_class = F.array(*[F.lit(float(x)) for x in np.log10(known["tail_n"] + known["tail_v"] + 1.0)])
    more = (
        rare.join(counts.select("word", "c"), "word", "left")
        .groupBy("row_id")
        .agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * (F.log10(c + 1) - float(np.log10(known["n"] + known["v"] + 1.0)))).alias("more_base"),
            F.sum(F.col("n") * (F.log10(c + 1) - F.element_at(in_class, F.col("tail") + 1))).alias("more_score"),
        )
    )
    zero = F.lit(0.0)
    return scored.drop("rare").join(more, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(known["n"])).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("net") + F.coalesce("more_score", zero)).alias("score"),
    )
