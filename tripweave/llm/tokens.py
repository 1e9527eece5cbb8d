"""Token ids of whole texts, as little-endian 32-bit numbers."""

from __future__ import annotations

import array
import re
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import regex

#: Characters whose normal form, case and class do not depend on the Unicode version at hand, and of which just the blank
#: and the tab to the carriage return are white space. Other texts go through the tokenizer as a whole.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e¡-įı-ɏ]*")

#: The pattern of pieces written in the vocabulary file.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

_SPACE = re.compile(r"[\t-\r\x20]")


def _segments(text: str, size: int) -> Iterator[str]:
    """Consecutive parts of about ``size`` characters, cut only at white space, which no token spans."""
    begin = 0
    while len(text) - begin > size:
        cut = _SPACE.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is visible, else the next one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


class _Memory(dict):
    """What a function gives for a key, kept."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


class Encoder:
    """A tokenizer file with a bounded memory of words and their pieces.

    Words repeat; each is cut into pieces and encoded once and then looked up, which is several times as fast as encoding
    whole texts. For vocabularies with the pattern above that lower-case and drop white space. As the tokenizer has it by default, the
    strings of its special tokens stand for these tokens; texts with one go through it as a whole.
    """

    def __init__(self, path: str, memory: int = 200_000, segment: int = 250_000):
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.model.get_added_tokens_decoder().values()]
        self.merge = self.model.model.tokenize
        self.memory, self.segment = memory, segment
        self.letters = _byte_letters()
        self.words = _Memory(self._word)
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        a = array.array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[piece] = self._packed([t.id for t in self.merge(letters)])
        return ids

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word)
        if word[-1] in ".," and word[:-1].isalpha():
            return self._piece(word[:-1]) + self._piece(word[-1])
        return b"".join(map(self._piece, _PIECES.findall(word)))

    def _by_word(self, texts: list[list[str]]) -> list[bytes]:
        if len(self.words) > self.memory or len(self.pieces) > self.memory:
            self.words.clear()
            self.pieces.clear()
        return [b"".join(map(self.words.__getitem__, t)) for t in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; empty for an empty text."""
        parts = [(i, s) for i, t in enumerate(texts) for s in _segments(t, self.segment)]
        low = [s.lower() for _, s in parts]
        plain = [bool(_PLAIN.fullmatch(s)) and not any(t in x for t in self.special) for (_, s), x in zip(parts, low, strict=True)]
        out: list[list[bytes]] = [[] for _ in texts]
        found = iter(self._by_word([x.split() for x, p in zip(low, plain, strict=True) if p]))
        for (i, s), p in zip(parts, plain, strict=True):
            out[i].append(next(found) if p else self._packed(self.model.encode(s, add_special_tokens=False).ids))
        return [b"".join(x) if len(x) != 1 else x[0] for x in out]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, one per Python worker."""
    return Encoder(path)
