"""Ids of byte-level vocabularies in JSON, by the faster library where it can."""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Blanks in a row from which the pattern's backtracking is left to the other library, which needs
#: no stack for it. The faster one gives up at a million.
LONG_BLANKS = 50_000
BLANKS = re.compile(r"\s\s++")


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks of a byte-level vocabulary in JSON, in which printable characters stand for bytes:
    themselves where printable, else the characters from 256 on, in order; and the ids of its added
    tokens, at which a text is split before the merges."""
    with open(path, encoding="utf-8") as file:
        return parsed_vocabulary(file.read())


def parsed_vocabulary(text: str) -> tuple[dict[bytes, int], dict[str, int]]:
    content = json.loads(text)
    added = {token["content"]: token["id"] for token in content["added_tokens"]}
    for token in content["added_tokens"]:
        if token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError(f"{token['content']} takes part of its surroundings")
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable}
    others = (b for b in range(256) if b not in set(printable))
    byte_of |= {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {
        bytes(byte_of[c] for c in token): rank
        for token, rank in content["model"]["vocab"].items()
        if token not in added
    }
    return ranks, added


def has_long_blanks(text: str) -> bool:
    return any(m.end() - m.start() >= LONG_BLANKS for m in BLANKS.finditer(text))


class ByteLevel:
    """Encodes texts by a vocabulary given as its JSON. With ``added``, strings of added tokens get
    their own ids; else they are plain text."""

    def __init__(self, vocabulary: str, added: bool):
        self.vocabulary, self.added = vocabulary, added
        self.ranks, tokens = parsed_vocabulary(vocabulary)
        largest = max([*self.ranks.values(), *tokens.values()], default=0)
        #: Bytes that any id fits in, as a number type.
        self.width = "<u2" if largest < 1 << 16 else "<u4"
        self.encoding = tiktoken.Encoding(
            "byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks,
            special_tokens=tokens if added else {},
        )
        self._slow: Tokenizer | None = None

    def encode(self, text: str) -> np.ndarray:
        if has_long_blanks(text):
            if self._slow is None:
                self._slow = Tokenizer.from_str(self.vocabulary)
                self._slow.encode_special_tokens = not self.added
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, "<u4")
        if self.added:
            return np.array(self.encoding.encode(text, allowed_special="all"), "<u4")
        return np.array(self.encoding.encode_ordinary(text), "<u4")
