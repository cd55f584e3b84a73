"""Tokens of whole texts by a cache of the runs between blanks."""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

CACHED = 600_000   # entries; a full cache is emptied, which costs time and changes nothing
MARKS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte: itself, or for unprintable bytes the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


def _le(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordwiseEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers, equal to the library's for the whole text.

    It holds for a tokenizer that drops blanks and whose normalizer and pre-tokenizer work within a blank-free run
    (``word_bpe_49k.json``). A run of letters and one mark is the letters and the mark, as the pre-tokenizer parts
    them. Words of Latin-1 letters, whose lower case and composed form are plain, go to the library's merge model
    directly; all else to the library's whole encoder.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.cache: dict[str, bytes] = {"": b""}

    def _learn(self, word: str) -> bytes:
        got = self.cache.get(word)
        if got is None:
            if word.isalpha() and max(word) <= "ÿ":
                word_bytes = word.lower()
                if not word.isascii():
                    word_bytes = word_bytes.encode().decode("latin-1").translate(self.letters)
                ids = [t.id for t in self.merge(word_bytes)]
            elif word[-1] in MARKS and word[:-1].isalpha():
                return self._put(word, self._learn(word[:-1]) + self._learn(word[-1]))
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            got = self._put(word, _le(ids))
        return got

    def _put(self, word: str, ids: bytes) -> bytes:
        self.cache[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        words = re.split("[ \n\t\r]", text) if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ")
        for word in set(words).difference(self.cache):
            self._learn(word)
        out = b"".join(map(self.cache.__getitem__, words))
        if len(self.cache) > CACHED:
            self.cache = {"": b""}
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordwiseEncoder:
    """One encoder per Python worker, so its cache serves all tasks there."""
    return WordwiseEncoder(path)
