"""Ids of words, each distinct word encoded once per Python worker (and again when it was forgotten)."""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Distinct words whose ids a worker remembers, in each of two generations.
CACHED_WORDS = 500_000
#: Marks after a word of letters are split off and encoded apart by byte-level tokenizers.
MARKS = ".,!?;:"
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as the letters from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def id_type(tokenizer) -> np.dtype:
    return np.dtype("<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


class WordIds(dict):
    """Ids (as bytes) of words, each of which stands after a space; a word not yet known is encoded when it is looked up.

    lower: the tokenizer drops the space and lower-cases; else the space is the first letter of the word.
    """

    def __init__(self, tokenizer, lower: bool):
        super().__init__()
        self.tokenizer, self.lower, self.dtype = tokenizer, lower, id_type(tokenizer)
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.space = "" if lower else " "
        self.marks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def of(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each list of words."""
        if len(self) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        look = self.__getitem__
        return [b"".join(map(look, words)) for words in texts]

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encoded(word)
        self[word] = ids
        return ids

    def _encoded(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if not (core.isalpha() and (core.isascii() or LATIN.fullmatch(core))):
            return self.library([self.space + word])[0]
        if after := word[len(core) :]:
            if after not in self.marks:
                self.marks[after] = self.library([after])[0]
            return self[core] + self.marks[after]
        if self.lower and (low := core.lower()) != core:
            return self[low]
        # a word of letters is one unit of the tokenizer: its model alone gives the ids
        spelt = self.space + core
        letters = spelt if self.lower and spelt.isascii() else spelt.encode().decode("latin-1").translate(self.letters)
        return self._packed([t.id for t in self.tokenizer.model.tokenize(letters)])
