"""Byte-level BPE from a tokenizers .json file: its ranks, and exact ids at the speed of a compiled regular expression."""

from __future__ import annotations

import json
import re

#: Fixed value: the public pattern that splits text before byte-level BPE merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same language without look-ahead; equal to PATTERN on texts where no two white-space characters meet.
PLAIN_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
_WIDE_SPACE = re.compile(r"\s\s")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks of byte strings, ids of special strings) of a byte-level BPE .json file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    symbols = byte_symbols()
    ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return ranks, special


class Encoder:
    """Ids of a text as the tokenizers library gives them by default: special strings inside a text become their ids."""

    def __init__(self, path: str):
        import tiktoken

        ranks, special = load_vocabulary(path)
        self.special = special
        self.full = tiktoken.Encoding("full", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.plain = tiktoken.Encoding("plain", pat_str=PLAIN_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.full.encode(text, allowed_special="all")
        if _WIDE_SPACE.search(text):
            return self.full.encode_ordinary(text)
        return self.plain.encode_ordinary(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
