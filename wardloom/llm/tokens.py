"""Token ids of texts by public tokenizer files, and the bytes that each id stands for."""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

RUN = 256  # characters of one kind, white space or other, from which on the file's own library is used
_WHITE = r"\s\x0B\x{85}\p{Z}"
LONG_RUN = f"[{_WHITE}]{{{RUN}}}|[^{_WHITE}]{{{RUN}}}"
SPACE_MARK = "▁"


class Encoder:
    """Ids of a byte-level tokenizer file.

    The ids are those of the file's own library, for which a special token's string in a text is plain text unless
    ``special`` is true. Where the file has an equal vocabulary of ranks beside it, ordinary text goes through the faster of
    the two. Texts that hold a special token's string, or a run of ``RUN`` characters without a change between white space
    and other characters, go through the first: the faster one splits by a backtracking pattern that fails on very
    long runs, and its time grows with the square of a run.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None, special: bool = True) -> None:
        self.path, self.special = path, special
        with open(path, encoding="utf-8") as source:
            self.reserved = [t["content"] for t in json.load(source).get("added_tokens", [])]
        self.fast = None
        if ranks_path and pattern:
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def exact(self) -> Tokenizer:
        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = not self.special
        return found

    def ids(self, text: str) -> list[int]:
        """By the file's own library."""
        return self.exact.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def each(self, texts: pa.Array, before: str = "") -> Iterator[list[int]]:
        """Ids of ``before`` and each text in turn; null is like empty."""
        slow = pc.match_substring_regex(texts, LONG_RUN)
        for word in self.reserved:
            slow = pc.or_(slow, pc.match_substring(texts, word))
        for text, no in zip(texts, pc.fill_null(slow, False)):
            text = before + (text.as_py() or "")
            yield self.ids(text) if self.fast is None or no.as_py() else self.fast.encode_ordinary(text)

    def bytes_of_ids(self) -> list[bytes]:
        """The bytes of each id: an entry's characters stand for bytes, as is usual for byte-level vocabularies."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
        vocabulary = self.exact.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for entry, at in vocabulary.items():
            ordinary = all(c in byte_of for c in entry) and entry not in self.reserved
            out[at] = bytes(byte_of[c] for c in entry) if ordinary else entry.encode()
        return out


class Pieces:
    """Ids of a sentence piece model."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def each(self, texts: pa.Array) -> list[list[int]]:
        return self.model.encode([text or "" for text in texts.to_pylist()], num_threads=1)

    def bytes_of_ids(self) -> list[bytes]:
        """A piece's text in UTF-8 with the mark as a space; a byte piece is its byte."""
        out = []
        for at in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(at)
            out.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(at) else piece.replace(SPACE_MARK, " ").encode())
        return out
