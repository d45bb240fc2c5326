"""Token ids of whole texts from a public tokenizer file, with repeated words encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tagtide.llm.words import WordRows, slices

# Letters of ASCII and Latin-1, and ASCII signs. In words of these and digits alone, the vocabulary's pre-tokens are
# what _PIECES finds; a single run of letters or of signs is a pre-token by itself.
_SMALL, _SIGN = "a-zß-öø-ÿ", r"!-/:-@\[-`{-~"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_SMALL}]+|[0-9]|[{_SIGN}]+")
_ODD = re.compile(rf"[^{_SMALL}{_SIGN}0-9]|<\|")
_SINGLE = re.compile(rf"[{_SMALL}]+|[!-&(-/:-@\[-`{{-~]+")


def _byte_names() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts (UTF-8 bytes) to little-endian unsigned 32-bit ids.

    For byte-level vocabularies that lower-case, drop white space and part
    letters from signs: a text's ids are its words' ids one after another, and a
    word's those of its pre-tokens. Each is encoded by the tokenizers library
    when a worker first meets it; up to ``limit`` words are remembered.
    """

    def __init__(self, path: str, limit: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.size = max(self.whole.get_vocab(with_added_tokens=True).values()) + 1
        self.names = _byte_names()
        self.rows = WordRows(self._of_words, np.uint32, limit)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        """A single run of letters or signs goes straight to the vocabulary's merges."""
        if not _SINGLE.fullmatch(piece):
            return self._whole([piece])[0]
        name = piece if piece.isascii() else "".join([self.names[b] for b in piece.encode()])
        return [x.id for x in self.whole.model.tokenize(name)]

    def _of_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        known: dict[str, list[int]] = {}
        odd = []
        for k, word in enumerate(words):
            low = word.decode("utf-8", "replace").lower()
            if _ODD.search(low):
                odd.append(k)
                continue
            ids: list[int] = []
            for piece in _PIECES.findall(low):
                if piece not in known:
                    known[piece] = self._piece(piece)
                ids += known[piece]
            out[k] = np.array(ids, np.uint32)
        for k, ids in zip(odd, self._whole([words[k].decode("utf-8", "replace") for k in odd]), strict=True):
            out[k] = np.array(ids, np.uint32)
        return out

    def encode(self, column: pa.Array, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row behind the last, ids of these rows, each row's bounds) over a text column.

        Every text's ids are followed by the id ``end``; a null text is empty.
        """
        for first, stop, words in slices(column, lower=False):
            ids, sizes = self.rows.of(words)
            places = np.concatenate([[0], np.cumsum(sizes)])[words.bounds]  # where each text's ids start
            yield first, stop, np.insert(ids, places[1:], end), places + np.arange(stop - first + 1)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder of a file, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
