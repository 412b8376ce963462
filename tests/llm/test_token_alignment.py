import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wardloom.llm import token_alignment as align
from wardloom.llm.queries import encoder_args
from wardloom.llm.tokens import RUN, Encoder

PIECE_PATH = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte.encode_special_tokens = True
    return byte, sentencepiece.SentencePieceProcessor(model_file=PIECE_PATH)


def ranges(parts):
    at, out = 0, []
    for ident, raw in parts:
        out.append((ident, at, at + len(raw)))
        at += len(raw)
    return out


def plain(libraries, rows):
    """Measures by the rules, one text and one link after another, with the libraries' own decoding."""
    byte, piece = libraries
    marks = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of, extra = {chr(b): b for b in marks}, 256
    for b in range(256):
        if b not in marks:
            byte_of[chr(extra)] = b
            extra += 1
    about, counts = [], Counter()
    for _, text in rows:
        links, groups, n = [], [], (0, 0)
        if text:
            a = ranges([(i, bytes(byte_of[c] for c in byte.id_to_token(i))) for i in byte.encode(" " + text, add_special_tokens=False).ids])
            b = ranges([(i, bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode()) for i in piece.encode(text)])
            joined_a = b"".join(bytes(byte_of[c] for c in byte.id_to_token(i)) for i, _, _ in a)
            joined_b = b"".join(bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode() for i, _, _ in b)
            if joined_a == joined_b == (" " + text).encode():
                n = len(a), len(b)
                links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e] if len(a) * len(b) < 4_000_000 else None
                cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
                start = 0
                for cut in cuts:
                    groups.append("|".join(",".join(str(x) for x, s, e in side if start < e <= cut) for side in (a, b)))
                    start = cut
        about.append((n, groups, links))
        counts.update(links)
    most = Counter()
    for (_, y), c in counts.items():
        most[y] = max(most[y], c)
    return [
        (doc, *n, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for (doc, _), (n, groups, links) in zip(rows, about)
    ]


TEXTS = ["The cat sat on the mat.", "The cat sat on the mat.", "the the the The", "café naïve 漢字 \U0001f600", "a  b   c\n\n\td", " ", "\n", "x", "<|endoftext|> <s></s> <unk> <0x41>",
         "▁ mark", "a▁b", "\x00\x01 z", "ﬁne é  　", None, "", "password = 'ab12cd34'", "Ouwhean thré thstion " * 20, "1234567 3.14159", "﻿bom", "\U0010ffff", "a" * 300 + " " * 300 + "漢" * 60]


def test_measures_equal_the_plain_ones(spark, libraries):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[0]), (None, TEXTS[3]), (None, None)]
    df = spark.createDataFrame([(a, b, "x", b) for a, b in rows], "doc_id long, text string, key string, links string")
    out = align.aligned(df, encoder_args(), PIECE_PATH)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(plain(libraries, rows), key=repr)


def test_slices_and_hot_texts_change_nothing(spark, libraries, monkeypatch):
    rows = [(i, TEXTS[i % 7] if i % 3 else "hot text of many rows") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(plain(libraries, rows), key=repr)
    assert sorted(map(tuple, align.aligned(df, encoder_args(), PIECE_PATH).collect()), key=repr) == want
    for name, value in (("SLICE", 7), ("HOT", 10), ("PIECE", 50), ("HELD", 8)):
        monkeypatch.setattr(align, name, value)
    assert sorted(map(tuple, align.aligned(df, encoder_args(), PIECE_PATH).collect()), key=repr) == want


def test_no_tokens_at_all(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.aligned(empty, encoder_args(), PIECE_PATH).collect() == []
    none = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert {tuple(r) for r in align.aligned(none, encoder_args(), PIECE_PATH).collect()} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)}


def test_long_runs_keep_the_first_librarys_ids():
    import pyarrow as pa

    encoder = Encoder(*encoder_args())
    for text in (" " * 1_000_000, "a" * 1_000_000, "\n" * 1_000_000, "漢" * 300_000, (" " * 255 + "　") * 2000, "ab " * (RUN // 2) + " " * (RUN - 1) + "x", "<|endoftext|> a"):
        assert list(encoder.each(pa.array([text, None]))) == [encoder.ids(text), []]
