"""Words of many texts at once: runs of letters, digits and underscores, without case, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: An odd multiplier that is 3 modulo 8, so that its powers differ in a low bit.
BASE = 0x9E3779B97F4A7C13
_OTHER = re.compile(r"\W")


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def kinds() -> np.ndarray:
    """For each code point: 1 for letters, digits and the underscore, 2 for white space, else 0."""
    return np.fromiter((1 if c.isalnum() or c == "_" else 2 if c.isspace() else 0 for c in map(chr, range(0x110000))), np.uint8, 0x110000)


@lru_cache(1)
def values() -> np.ndarray:
    """For each code point a hash of its lower-case letter (the first, where one letter becomes two)."""
    return mix(np.fromiter((ord(chr(c).lower()[0]) for c in range(0x110000)), np.uint64, 0x110000), 1)


@lru_cache(16)
def powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Sums:
    """Polynomial hashes modulo 2^64 of any ranges of a sequence, from its prefix sums."""

    def __init__(self, sequence: np.ndarray, base: int = BASE):
        bits = max(10, len(sequence).bit_length())
        self.inverse = powers(pow(base, -1, 1 << 64), bits)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sequence * powers(base, bits)[: len(sequence)], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def bounds(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in a sequence of `kinds`."""
    step = np.diff(np.concatenate([[0], (kind == 1).view(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def slabs(texts, chars: int = 1 << 19) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(numbers, pieces): the texts in order, in lists of about `chars` characters; longer texts in pieces cut between words."""
    numbers, pieces, size = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            stop = len(text)
            if stop - at > chars:
                stop = max(text.rfind(" ", at, at + chars), text.rfind("\n", at, at + chars))
                if stop <= at:
                    found = _OTHER.search(text, at + chars)
                    stop = found.start() if found else len(text)
            numbers.append(k)
            pieces.append(text[at:stop])
            size, at = size + stop - at, stop
            if size >= chars:
                yield np.array(numbers), pieces
                numbers, pieces, size = [], [], 0
            if at >= len(text):
                break
    if numbers:
        yield np.array(numbers), pieces


def hashed(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each piece) of a slab."""
    code = code_points("\n".join(pieces))
    begin, end = bounds(kinds()[code])
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
    return mix(Sums(values()[code]).of(begin, end), 2), np.diff(np.searchsorted(begin, ends), prepend=0)


def hashes_of(text: str) -> np.ndarray:
    return hashed([text])[0]


class Vocabulary:
    """Numbers of given word hashes; looking up many words costs a few array steps."""

    def __init__(self, hashes: np.ndarray, bits: int = 18):
        self.hashes, self.shift = np.unique(hashes), np.uint64(64 - bits)
        first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.first = first[:-1].astype(np.int32)
        self.deep = int(np.diff(first).max(initial=0))
        self.padded = np.append(self.hashes, np.zeros(self.deep + 1, np.uint64))

    def __len__(self) -> int:
        return len(self.hashes)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, len(self) for words that are not in it."""
        out = np.full(len(words), len(self), np.int32)
        at = self.first[words >> self.shift]
        for j in range(self.deep):
            hit = (self.padded[at + j] == words) & (at + j < len(self))
            out[hit] = at[hit] + j
        return out
