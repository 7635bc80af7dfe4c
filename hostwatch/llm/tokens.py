"""Token ids of whole texts with the tokenizers library, through a cache of words.

A byte-level BPE splits a text into pieces first, and no piece holds a space behind a character that is no white
space.  So a text may be cut before every such space, and the ids of "<space>word" are the same in every text.
"""

from __future__ import annotations

import re
import zlib
from array import array

#: Words kept in each of the two generations of the cache; only time depends on it.
CACHED_WORDS = 400_000
#: Longer words are encoded each time.
LONGEST_CACHED = 64

#: Words behind which a text may be cut at a space: others end with white space, or what might be white space, or are empty.
_SAFE_END = re.compile(r"[\w!-~¡-ɏ]\Z").search
#: A piece of letters, and signs of ASCII without the apostrophe, which are a piece of their own.
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: Lines that begin with a letter, behind no white space: the line feed is then a piece of its own.
_LINES = re.compile(r"[^\n]*[\w!-~¡-ɏ](?:\n[A-Za-zÀ-ÖØ-öø-ÿ](?:[^\n]*[\w!-~¡-ɏ])?)+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary, by the byte's number."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + n) for n, b in enumerate(others)}}


class _Words(dict):
    """Ids (as bytes) by word, None for words behind which a text may not be cut; the words of the generation before are kept until the next one is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old[word] if word in self.old else self.encode(word) if _SAFE_END(word) else None
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers, special tokens not added."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.words, self.first, self.signs = _Words(self._spaced), _Words(self._started), _Words(self._direct)
        self.line_feed = self._direct("\n")

    def _direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _spaced(self, word: str) -> bytes:
        return self._word(" ", word, self.words)

    def _started(self, word: str) -> bytes:
        return self._word("", word, self.first)

    def _word(self, before: str, word: str, known: _Words) -> bytes:
        found = _LETTERS(word)
        if found:
            letters = (before + found[1]).encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            return ids + self.signs[found[2]] if found[2] else ids
        if "\n" in word and _LINES(word):
            head, *lines = word.split("\n")
            return self.line_feed.join([known[head], *map(self.first.__getitem__, lines)])
        return self._direct(before + word)

    def encode(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            head, *words = text.split(" ")
            try:
                return b"".join([self.first[head], *map(self.words.__getitem__, words)])
            except TypeError:  # a word behind which the text may not be cut
                pass
        return self._mixed(text)

    def _mixed(self, text: str) -> bytes:
        """A text with spaces at which it may not be cut, or with the string of a special token."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._direct(text)
        head, *parts = re.split(r"(?<=[\w!-~¡-ɏ]) ", text)
        return self._direct(head) + b"".join([self.words[p] if _SAFE_END(p) else self._spaced(p) for p in parts])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32(ids) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
