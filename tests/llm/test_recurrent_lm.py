import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from wardloom.llm import recurrent_lm as lm

SCHEMA = "doc_id long, text string"


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def base(rows):
    train = [brute.words(t) + [None] for d, t in rows if not held(d)]
    counts = Counter(w for ws in train for w in ws)
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        ws = brute.words(t) + [None]
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        out.append((d, held(d), len(ws), sum(counts[w] > 0 for w in ws), n, score))
    return out


def text(rng, language):
    """Words of one language follow each other, and one word in two fixes the next."""
    words, w = [], 0
    for _ in range(rng.randrange(5, 80)):
        w = (w + 1) % 40 if rng.random() < 0.5 else rng.randrange(40)
        words.append(f"{language}{w}{language}")
    return " ".join(words)


def test_base_and_held_out_score(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, text(rng, rng.choice("abc")) + (f" rare{i}" if i % 5 == 0 else "")) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (None, "a1a A1A"), (7, rows[7][1]), (2002, "a1a " * 30_000), (2003, "never seen")]
    monkeypatch.setattr(lm, "LEXICON", 60)  # so that some words are joined
    monkeypatch.setattr(lm, "HEAD", 1024)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", word string, c int").repartition(4)
    got = sorted(lm.score_documents(df).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    wanted = sorted(base(rows), key=lambda r: (str(r[0]), r[2]))
    for g, w in zip(got, wanted, strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9)
        assert g.score <= 0 and math.isfinite(g.score)
    out = [g for g in got if g.held_out and g.n_tokens < 100]
    gain = sum(g.score - g.base_score for g in out) / sum(g.n_tokens for g in out)
    assert gain > 0.2, gain


def test_empty_tables_and_no_training(spark):
    assert lm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    only = [i for i in range(100) if held(i)][:3]
    got = lm.score_documents(spark.createDataFrame([(i, "a b") for i in only], SCHEMA)).collect()
    assert all((g.n_tokens, g.n_known, g.train_tokens, g.base_score) == (3, 0, 0, 0.0) for g in got)


def known():
    c = np.array([900, 500, 300, 200, 100, 50, 20, 5])
    tails = np.full(lm.TAIL_CLASSES, 3)
    return {"words": np.arange(8, dtype=np.uint64), "tails": np.zeros(8, int), "c": c, "n": int(c.sum()) + 96, "v": 40, "head": 8, "tail_n": tails, "tail_v": tails}


def weights(seed=4):
    rng = np.random.default_rng(seed)
    w = lm.first_weights(known())
    return {k: (v + 0.3 * rng.normal(size=v.shape)).astype(np.float64) for k, v in w.items()}


def layout(seed=5, docs=30):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 40, docs)
    symbols = np.where(rng.random(lengths.sum()) < 0.7, rng.integers(0, 8, lengths.sum()), lm.HEAD + rng.integers(0, lm.TAIL_CLASSES, lengths.sum())).astype(np.int32)
    return symbols, np.concatenate([[0], np.cumsum(lengths)])


def test_state_is_carried_and_cleared(monkeypatch):
    """A document's score is that of the plain recurrence over it alone, whatever lane and window it lies in."""
    monkeypatch.setattr(lm, "LANES", 4)
    w = weights()
    symbols, at = layout()
    got = lm.log10_of(w, lm.laid_out(symbols, at, 0), len(at) - 1)
    h = lm.HIDDEN
    for d in range(len(at) - 1):
        words = symbols[at[d] : at[d + 1]].tolist()
        state, total = np.zeros(h), 0.0
        for x, y in zip([lm.START, *words], [*words, 0]):
            a, c = w["embed"][x] @ w["wx"] + w["b"], state @ w["wh"]
            r, z = (1 / (1 + np.exp(-(a[s] + c[s]))) for s in (slice(0, h), slice(h, 2 * h)))
            new = np.tanh(a[2 * h :] + r * (c[2 * h :] + w["bn"]))
            state = (1 - z) * new + z * state
            logits = state @ w["wc"] + w["bc"]
            k = y // lm.PER_CLASS if y < lm.HEAD else y - lm.HEAD + lm.HEAD_CLASSES
            total += logits[k] - np.log(np.exp(logits).sum())
            if y < lm.HEAD:
                inner = state @ w["wo"][k] + w["bo"][k]
                total += inner[y % lm.PER_CLASS] - np.log(np.exp(inner).sum())
        assert got[d] == pytest.approx(total / lm.LN10, rel=1e-3)


def test_gradients_are_those_of_the_window():
    w = weights()
    symbols, at = layout(docs=6)
    inputs, targets, keep, doc_of = next(lm.windows(lm.laid_out(symbols, at, 0)))
    valid, first = doc_of >= 0, np.random.default_rng(1).normal(size=(inputs.shape[1], lm.HIDDEN))

    def loss():
        states, _, _ = lm._unroll(w, inputs, keep, first)
        logp, _ = lm._output(w, states.astype(np.float64), targets, valid)
        return -logp[valid].sum()

    states, _, trail = lm._unroll(w, inputs, keep, first)
    grads = {}
    _, back = lm._output(w, states, targets, valid, grads)
    lm._descend(w, inputs, keep, trail, back, grads)
    rows, values = grads["embed"]
    grads["embed"] = np.zeros_like(w["embed"])
    grads["embed"][rows] = values
    rng = np.random.default_rng(6)
    for name in w:
        direction = rng.normal(size=w[name].shape)
        kept, step = w[name].copy(), 2e-3
        w[name] = kept + step * direction
        up = loss()
        w[name] = kept - step * direction
        down = loss()
        w[name] = kept
        slope = (grads[name] * direction).sum()
        assert (up - down) / (2 * step) == pytest.approx(slope, rel=0.05, abs=0.3), name


def test_lengths_are_balanced_and_all_words_placed(monkeypatch):
    monkeypatch.setattr(lm, "LANES", 3)
    symbols, at = layout(docs=17)
    inputs, targets, keep, doc_of, filled = lm.laid_out(symbols, at, 0)
    assert (doc_of >= 0).sum() == len(symbols) + 17 == filled.sum()
    assert (inputs == lm.START).sum() == 17 and list(filled) == sorted(filled, reverse=True)
    empty = lm.laid_out(np.zeros(0, np.int32), np.zeros(2, np.int64), 0)
    assert empty[1].shape == (1, 1)


@pytest.mark.parametrize("lexicon", [1, 8, 41])
def test_ties_at_the_top_do_not_empty_the_lexicon(spark, monkeypatch, lexicon):
    """All counts are one, the end's as well: more words than the lexicon has places for."""
    monkeypatch.setattr(lm, "LEXICON", lexicon)
    rows = [(0, " ".join(f"w{i}" for i in range(40)))]
    assert not lm.held_out([0])[0]
    found = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).head()
    assert (found.n_tokens, found.n_known, found.train_tokens) == (41, 41, 41)
    assert found.base_score == pytest.approx(41 * np.log10(2 / (41 + 42)))
