"""Byte-level BPE token ids of whole texts, with a memory of words per worker.

The ids are those of the tokenizer's plain call without added special tokens: a
text that spells out one of the vocabulary's special tokens has that token's id.

The pre-tokeniser of this vocabulary never joins a text across a single space
or a single line break between other characters. A text whose white space is
only that is therefore cut at those places, and each word, with the space
before it, is encoded once and then remembered. Any other text is encoded as a
whole. The ids are the same either way; tests hold them against each other.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words remembered by a worker before it starts afresh; bounds its memory only.
MEMORY = 1_500_000
#: White space that the fast way does not know, or that stands side by side.
_PLAIN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_WIDE = re.compile("[\x85\xa0 ᠎ -‏    ⁠　﻿]")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class _Words(dict):
    """Encoded words: little-endian 32-bit ids of ``lead + word``."""

    def __init__(self, encode, model, lead: str):
        super().__init__()
        self.encode, self.model, self.lead = encode, model, lead
        self.ends, self.letters = {c: encode(c) for c in ",."}, _byte_letters()

    def one(self, word: str) -> bytes:
        """A word of letters only is one piece for the model, without the pre-tokeniser."""
        pieces = self.model.tokenize((self.lead + word).encode().decode("latin-1").translate(self.letters))
        return array("I", [p.id for p in pieces]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        last = word[-1:]
        if word.isalpha():
            got = self.one(word)
        elif last in self.ends and word[:-1].isalpha():
            got = self[word[:-1]] + self.ends[last]
        else:
            got = self.encode(self.lead + word)
        self[word] = got
        return got


class TextCoder:
    """Encodes texts with a ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._encode = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self._inner, self._first = _Words(self._encode, tokenizer.model, " "), _Words(self._encode, tokenizer.model, "")
        self._break = self._encode("\n")

    def encode(self, text: str) -> bytes:
        """The ids of one text, little-endian unsigned 32-bit."""
        if not text:
            return b""
        if any(x in text for x in _PLAIN) or any(x in text for x in self._special) or text[0].isspace() or text[-1].isspace() or (not text.isascii() and _WIDE.search(text)):
            return self._encode(text)
        inner, first = self._inner, self._first
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(first[words[0]] + b"".join(map(inner.__getitem__, words[1:])))
        return self._break.join(lines)


@lru_cache(maxsize=2)
def coder(path: str) -> TextCoder:
    """This process's coder for a tokenizer file."""
    return TextCoder(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
