"""The built-in text embedder: signed hashes of words and letter triples."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import Protocol

import numpy as np

#: Letters with marks and what they fold to.
FOLD = str.maketrans(
    "ÁÉÍÓÚÜÑáéíóúüñÀÈÌÒÙÇàèìòùçÂÊÎÔÛâêîôûÄËÏÖÅÃÕäëïöåãõ",
    "aeiouunaeiouunaeioucaeioucaeiouaeiouaeioaaoaeioaao",
)
#: ASCII is lower-cased and letters with marks are folded.
_PLAIN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") | FOLD
#: Words and chunks that are remembered between texts, and characters that such a word has at most.
REMEMBER, KNOWN_CHARS = 1 << 17, 64
ROOTS = np.array([t**0.5 for t in range(1 << 12)])
_WORDS = re.compile(r"[^\W_]+")


class Embedder(Protocol):
    """What the engine needs of an embedder."""

    dims: int

    def vector(self, text: str) -> np.ndarray: ...


class HashEmbedder:
    def __init__(self, dims: int = 256) -> None:
        if dims < 8 or dims % 8:
            raise ValueError("dims must be a multiple of 8")
        self.dims = dims
        self._forget()

    def _forget(self) -> None:
        #: Each known word's chunks by number, and where and with which sign a chunk counts.
        self.words: dict[str, np.ndarray] = {}
        self.numbers: dict[str, int] = {}
        self.slots, self.signs = np.zeros(1024, np.int64), np.zeros(1024)

    def __reduce__(self):
        return type(self), (self.dims,)  # what is remembered stays where it is

    def _number(self, chunk: str) -> int:
        found = self.numbers.get(chunk)
        if found is None:
            found = self.numbers[chunk] = len(self.numbers)
            if found == len(self.slots):
                self.slots, self.signs = np.resize(self.slots, 2 * found), np.resize(self.signs, 2 * found)
            raw = chunk.encode()
            self.slots[found] = zlib.crc32(raw) % self.dims
            self.signs[found] = -1.0 if zlib.crc32(b"s" + raw) & 1 else 1.0
        return found

    def _chunks(self, word: str) -> np.ndarray:
        """The numbers of a word and of its letter triples; spellings that fold to one word share them."""
        found = self.words.get(word)
        if found is None:
            plain = word.translate(_PLAIN)
            found = np.array([self._number(f"p:{plain}"), *[self._number(f"t:{plain[i : i + 3]}") for i in range(len(plain) - 2)]], np.int32)
            if len(word) <= KNOWN_CHARS:
                self.words[word] = found
        return found

    def vector(self, text: str) -> np.ndarray:
        """Chunks are summed in the order of their first occurrence, so a sum is the same whatever is remembered."""
        words = Counter(_WORDS.findall(text))  # folding makes no word of two and no two of one
        if not words:
            return np.zeros(self.dims)
        parts = [self._chunks(w) for w in words]
        numbers = np.concatenate(parts)
        times = np.bincount(numbers, np.repeat(np.fromiter(words.values(), float, len(words)), [len(x) for x in parts]))
        first = np.array(list(dict.fromkeys(numbers.tolist())))
        times = times[first]
        roots = ROOTS[times.astype(np.int64)] if times.max() < len(ROOTS) else np.array([t**0.5 for t in times.tolist()])
        v = np.bincount(self.slots[first], self.signs[first] * roots, self.dims)
        if len(self.numbers) > REMEMBER or len(self.words) > REMEMBER:
            self._forget()
        return v
