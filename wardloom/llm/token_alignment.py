"""Cross-tokenizer alignment over exactly deduplicated texts.

Rows are shuffled by their full text, so that each distinct text is tokenised and aligned once, however many rows
repeat it. Two tokenizers' tokens of one text are linked where their byte ranges overlap, and cut into groups at the
byte offsets where a token of each ends. The corpus-wide count of a pair of ids is the sum over texts of the links that
hold it, times the text's number of rows. Measures that need these counts come from a second pass over the links, which
are kept as sorted differences; measures are joined to the documents by a digest of the text at the end.

The table of pair counts has at most one row for each pair of ids, whatever the corpus. Tasks look counts up in slices of
it of a fixed number of pairs, one pass over the kept links for each slice. Texts with very many rows are few (at most
``HOT`` can have more than their share), so their measures go to the documents by a broadcast and the others by a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.text import pieces
from wardloom.llm.tokens import Encoder, Pieces
from wardloom.llm.work import saved, take
from wardloom.session import work_path

SLICE = 1 << 21  # pairs looked up at once: about 36 MB in a task
HOT = 1000  # a text with more than one in so many rows is hot
PIECE = 1 << 21  # bytes of the texts aligned together
HELD = 1 << 18  # pairs of ids a task counts before it gives them out
TEXTS = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, times binary"
NO_TOKENS = dict(n_a=0, n_b=0, n_groups=0, n_links=0, n_best=0, count_sum=0, groups_sha256="")


class Vocabulary:
    """What the ids of one tokenizer stand for, and how they are written in a list of groups."""

    def __init__(self, bytes_of_ids: list[bytes], last: bytes) -> None:
        self.bytes_of_ids = bytes_of_ids
        self.lengths = np.array([len(x) for x in bytes_of_ids], np.int64)
        # an id before another of its group, and the last one of its group on this side
        self.written = [b"%d%s" % (k, mark) for mark in (b",", last) for k in range(len(bytes_of_ids))]

    def covers(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.bytes_of_ids.__getitem__, ids)) == raw


class Aligner:
    """Both tokenizers; each of the arguments is what its class takes."""

    def __init__(self, byte_args: tuple, piece_path: str) -> None:
        self.encoder, self.model = Encoder(*byte_args, special=False), Pieces(piece_path)
        self.a = Vocabulary(self.encoder.bytes_of_ids(), b"|")
        self.b = Vocabulary(self.model.bytes_of_ids(), b";")
        self.width = len(self.b.bytes_of_ids)  # a pair of ids is one number: a * width + b
        self.written = self.a.written + self.b.written

    def aligned(self, texts: pa.Array) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Measures of each text, and its distinct pairs of ids, in order, with the number of links that hold each."""
        n = len(texts)
        ids_a, ids_b, valid = [], [], np.zeros(n, bool)
        for i, (text, a, b) in enumerate(zip(texts, self.encoder.each(texts, " "), self.model.each(texts))):
            raw = text.as_py()
            if raw:
                raw = b" " + raw.encode()
                valid[i] = self.a.covers(a, raw) and self.b.covers(b, raw)
            ids_a.append(np.array(a if valid[i] else (), np.int64))
            ids_b.append(np.array(b if valid[i] else (), np.int64))
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.concatenate(ids) if n else np.zeros(0, np.int64) for ids in (ids_a, ids_b))
        at_a, at_b = (np.concatenate([[0], np.cumsum(x)]) for x in (n_a, n_b))
        # byte offsets over all texts one after another; both sides have the same bytes
        end_a, end_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        size = int(end_a[-1]) if len(end_a) else 0
        ends_a, ends_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        ends_a[end_a], ends_b[end_b] = True, True
        count_a, count_b, cuts = (np.cumsum(x, dtype=np.int64) for x in (ends_a, ends_b, ends_a & ends_b))
        # the tokens of the other side that a token of this side overlaps are those from `low` to `high`
        low, high = count_b[end_a - self.a.lengths[a]], count_b[end_a - 1]
        many = high - low + 1
        first = np.cumsum(many) - many
        link_b = np.arange(int(many.sum()), dtype=np.int64) + np.repeat(low - first, many)
        pair = np.repeat(a, many) * self.width + b[link_b]
        total = np.concatenate([[0], np.cumsum(many)])[at_a]
        byte_at = np.concatenate([[0], end_a])[at_a]
        out = {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(np.concatenate([[0], cuts])[byte_at + 1]), "n_links": np.diff(total)}
        out["groups_sha256"] = self._digests(a, b, end_a, end_b, count_a, count_b, cuts, at_a, at_b, valid)
        links, times = [], []
        for i in range(n):
            own, counts = np.unique(pair[total[i] : total[i + 1]], return_counts=True)
            links.append(own)
            times.append(counts)
        return out, links, times

    def _digests(self, a, b, end_a, end_b, count_a, count_b, cuts, at_a, at_b, valid) -> list[str]:
        """Of each text, the digest of its groups as ``a1,a2|b1;a3|b2,b3``; empty for a text without tokens."""
        # a token's place among the tokens of both sides, group by group, those of the first side ahead
        ends = np.flatnonzero(np.diff(np.concatenate([[0], cuts])))  # offsets at which groups end
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        b_before = np.concatenate([[0], count_b[ends]])[group_a]
        a_until = count_a[ends][group_b]
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = (np.append(np.diff(group) != 0, True)[: len(group)] for group in (group_a, group_b))
        order[np.arange(len(a)) + b_before] = a + last_a * len(self.a.bytes_of_ids)
        order[np.arange(len(b)) + a_until] = b + last_b * self.width + len(self.a.written)
        out, written = [], self.written.__getitem__
        for i, good in enumerate(valid.tolist()):
            part = order[at_a[i] + at_b[i] : at_a[i + 1] + at_b[i + 1]].tolist()
            out.append(hashlib.sha256(b"".join(map(written, part))[:-1]).hexdigest() if good else "")
        return out


def _kept(links: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct pairs as differences, and how many links hold each; numbers in the narrowest of three widths."""

    def narrow(x):
        width = next(w for w in (1, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w - 1)
        return bytes([width]) + x.astype(f"<i{width}" if width > 1 else np.uint8).tobytes()

    return narrow(np.diff(links, prepend=0)), narrow(times)


def _read(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 4: "<i4", 8: "<i8"}[raw[0]], offset=1).astype(np.int64)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of the weights of each, in whole numbers."""
    order = keys.argsort(kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def aligned_texts(docs: DataFrame, byte_args: tuple, piece_path: str) -> DataFrame:
    """One row for each distinct text that is not empty, written to the shared folder: its key, its number of rows, measures and links."""
    texts = docs.where("text IS NOT NULL AND text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    texts = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text")

    def run(batches):
        aligner = Aligner(byte_args, piece_path)
        for batch in batches:
            for piece in pieces(batch, size=PIECE):
                found, links, times = aligner.aligned(piece.column("text"))
                kept = [_kept(x, y) for x, y in zip(links, times)]
                columns = [piece.column("key"), piece.column("copies"), *[pa.array(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links")]]
                columns += [pa.array(found["groups_sha256"], pa.string()), *[pa.array([x[k] for x in kept], pa.binary()) for k in (0, 1)]]
                yield pa.record_batch(columns, [field.split()[0] for field in TEXTS.split(", ")])

    path = work_path(docs.sparkSession, "aligned")
    texts.mapInArrow(run, TEXTS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(TEXTS).parquet(path)


def pair_counts(texts: DataFrame) -> DataFrame:
    """``pair, count``: how many links of all rows hold each pair of ids, from the table of ``aligned_texts``."""

    def run(batches):
        held, size = [], 0

        def flush():
            keys, sums = _summed(*[np.concatenate(x) for x in zip(*held)])
            return pa.record_batch([pa.array(keys), pa.array(sums)], ["pair", "count"])

        for batch in batches:
            for copies, links, times in zip(batch.column("copies").to_pylist(), batch.column("links"), batch.column("times")):
                held.append((np.cumsum(_read(links.as_py())), _read(times.as_py()) * copies))
                size += len(held[-1][0])
                if size >= HELD:
                    held = [_summed(*[np.concatenate(x) for x in zip(*held)])]
                    size = len(held[0][0])
                    if size >= HELD // 2:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return texts.select("copies", "links", "times").mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def _looked_up(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, n_best, count_sum`` of each text, summed over one pass for each slice of the counts."""
    spark = texts.sparkSession
    slices = max(1, -(-counts.count() // SLICE))
    passes = None
    for k in range(slices):
        # sorted by the driver: a slice has a bounded number of rows
        rows = counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k).toArrow()
        pair = rows.column("pair").to_numpy()
        order = pair.argsort()
        known = spark.sparkContext.broadcast(
            (pair[order], rows.column("count").to_numpy()[order], rows.column("best").to_numpy(zero_copy_only=False)[order])
        )

        def run(batches, known=known):
            pairs, count, best = known.value
            for batch in batches:
                rows = []
                for raw, times in zip(batch.column("links"), batch.column("times")):
                    own, times = np.cumsum(_read(raw.as_py())), _read(times.as_py())
                    at = np.searchsorted(pairs, own)
                    at[at == len(pairs)] = 0
                    here = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
                    at, times = at[here], times[here]
                    rows.append((int(times[best[at]].sum()), int((count[at] * times).sum())))
                n_best, count_sum = zip(*rows) if rows else ((), ())
                yield pa.record_batch([batch.column("key"), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], ["key", "n_best", "count_sum"])

        found = texts.select("key", "links", "times").mapInArrow(run, "key binary, n_best long, count_sum long")
        passes = found if passes is None else passes.union(found)
    return passes.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")) if slices > 1 else passes


def aligned(docs: DataFrame, byte_args: tuple, piece_path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    The first tokenizer encodes a space and the text, the second the text, to which it adds a space. ``n_links`` counts
    the pairs of tokens that overlap in bytes; ``n_best`` those whose pair of ids is the commonest, or as common as it, of all
    pairs with the second id; ``count_sum`` is the sum of the pair's count over the links.

    Null and empty texts, and texts that one of the tokenizers does not keep byte by byte, have no tokens: zeros and an
    empty digest. Texts of any length are taken whole. Repeated texts count as often as they are there, whatever their
    ids; repeated rows and rows without doc_id come back as they are. An empty table gives an empty result.
    """
    docs = take(docs, doc_id="long", text="string")
    named = saved(docs.select("doc_id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("key")), "docs-named")
    texts = aligned_texts(docs, byte_args, piece_path)
    width = len(Pieces(piece_path).bytes_of_ids())
    counts = saved(pair_counts(texts), "pair-counts")
    counts = counts.withColumn("id_b", F.col("pair") % width)
    most = counts.groupBy("id_b").agg(F.max("count").alias("most"))
    counts = saved(counts.join(most, "id_b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-counts")
    found = saved(texts.drop("links", "times").join(_looked_up(texts, counts), "key"), "measures")
    # at most HOT texts can have more than a share of 1 / HOT of all rows
    share = (found.agg(F.sum("copies")).head()[0] or 0) // HOT
    hot, cold = (found.where(F.col("copies") > share if k else F.col("copies") <= share).drop("copies") for k in (True, False))
    if share:
        rest = named.join(F.broadcast(hot.select("key")), "key", "left_anti").where("key IS NOT NULL").join(cold, "key")
        known = named.join(F.broadcast(hot), "key").unionByName(rest)
    else:  # fewer rows than HOT
        known = named.join(found.drop("copies"), "key")
    none = named.where("key IS NULL").select("key", "doc_id", *[F.lit(v).cast("string" if v == "" else "long").alias(k) for k, v in NO_TOKENS.items()])
    return known.unionByName(none).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
