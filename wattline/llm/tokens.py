"""Fast exact encoding with a public word-level BPE tokenizer.

The tokenizer drops white space, lower-cases and splits into letter runs, digits and symbol runs, so a text's
ids are those of its white-space separated words one after another. Words repeat; their ids are kept.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
import regex

#: Fixed value: how the tokenizer splits normalised text.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters only are split here; others go to the tokenizer as they are.
PLAIN = regex.compile(r"[!-~¡-¬®-ɏ]+")
MOST_WORDS = 700_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Words(dict):
    """Bytes of a word, A-Z lower-cased -> bytes of its ids (native order). Forgets all beyond ``MOST_WORDS``."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            spelled = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            found = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            ids = self._piece(word.decode())
        elif word[:-1].isalpha() and word.isascii() and not word[-1:].isdigit() and 32 < word[-1] < 127:
            ids = self._piece(word[:-1].decode()) + self._piece(word[-1:].decode())
        else:
            ids = self._other(word.decode())
        self[word] = ids
        return ids

    def _other(self, word: str) -> bytes:
        text = unicodedata.normalize("NFC", word)
        if not PLAIN.fullmatch(text):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        lowered = "".join([c.lower() for c in text])
        if lowered.isalpha():
            return self._piece(lowered)
        return b"".join([self._piece(p) for p in SPLIT.findall(lowered)])

    def trim(self) -> None:
        if len(self) > MOST_WORDS:
            self.clear()
        if len(self.pieces) > MOST_WORDS:
            self.pieces.clear()


class EncoderCache:
    """One encoder per tokenizer file and Python worker."""

    _made: dict[str, EncoderCache] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.words = Words(tokenizer)

    @classmethod
    def of(cls, path: str) -> EncoderCache:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def ids(self, text: bytes, *end: int) -> np.ndarray:
        """Ids of a UTF-8 text, then the given ids; little-endian unsigned 32-bit."""
        out = b"".join(map(self.words.__getitem__, text.lower().split())) + np.array(end, dtype="<u4").tobytes()
        self.words.trim()
        return np.frombuffer(out, dtype="<u4")
