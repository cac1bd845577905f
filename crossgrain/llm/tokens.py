"""Ids of whole texts by a public tokenizer that drops white space, piece by piece."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np

TOKENIZER = "word_bpe_49k.json"
#: Pieces whose ids a worker remembers, in two generations. Results don't depend on it.
REMEMBERED = 400_000
#: Characters of a text that are split at once, about.
SLICE = 1 << 20
#: Texts of these characters and white space are split here; the tokenizer itself takes other words.
LEAST, MOST = 0x21, 0x24F
SPACE = r"\x20\x09-\x0D"


def _class(kind: str) -> str:
    """The characters up to MOST of a general category, as ranges of a regular expression's class."""
    codes = [c for c in range(LEAST, MOST + 1) if unicodedata.category(chr(c)).startswith(kind)]
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


PLAIN = re.compile(rf"[{SPACE}\x21-\x7e\xa1-{chr(MOST)}]*")
#: How the tokenizer splits a word, once composed and in lower case (fixed by its file), for these characters.
PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_class('L')}]+|[{_class('N')}]|[^{SPACE}{_class('L')}{_class('N')}]+")
BOUNDED = re.compile(f"\n|{PIECES.pattern}")
BREAK = re.compile(f"[{SPACE}]")

_workers: dict[str, WordTokenizer] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Known(dict):
    """Ids by piece, made at the first look-up; half of those remembered are older ones."""

    def __init__(self, tokens: WordTokenizer, older: dict):
        super().__init__()
        self.tokens, self.older = tokens, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.tokens.piece(piece)
        self[piece] = ids
        return ids


class WordTokenizer:
    """A text's ids are those of its words' pieces in a row, since splits never span white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table = byte_characters()
        self.known = Known(self, {})

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """The worker's own, kept for later tasks."""
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def turn(self) -> None:
        if len(self.known) > REMEMBERED // 2:
            self.known = Known(self, dict(self.known))

    def plain(self, text: str) -> bytes:
        """Ids of a text of plain characters."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        self.turn()
        return b"".join(map(self.known.__getitem__, PIECES.findall(text.lower())))

    def word(self, word: bytes) -> bytes:
        """word: holds no white space."""
        text = word.decode()
        return self.plain(text) if PLAIN.fullmatch(text) else self.direct(text)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all, as 64-bit numbers. Words hold no white space."""
        found, bound = [], b"\xff" * 4
        for a in range(0, len(words), 4096):
            text = b"\n".join(words[a : a + 4096]).decode() + "\n"
            if PLAIN.fullmatch(text):
                if not text.isascii():
                    text = unicodedata.normalize("NFC", text)
                self.turn()
                # line feeds bound words, and no piece holds one
                known = self.known.__getitem__
                found += [bound if p == "\n" else known(p) for p in BOUNDED.findall(text.lower())]
            else:
                for w in words[a : a + 4096]:
                    found += (self.word(w), bound)
        ids = np.frombuffer(b"".join(found), "<u4")
        at = np.flatnonzero(ids == 0xFFFFFFFF)
        return np.diff(at, prepend=-1) - 1, ids[ids != 0xFFFFFFFF].astype(np.int64)

    def ids(self, text: bytes | None) -> bytes:
        """Little-endian 32-bit ids. Null: none."""
        if not text:
            return b""
        if b"<|" in text:  # may hold a special token's string, which has its own id
            return self.direct(text.decode())
        found = []
        for part in slices(text.decode()):
            if PLAIN.fullmatch(part):
                found.append(self.plain(part))
            else:
                found += map(self.word, part.encode().split())
        return b"".join(found)


def slices(text: str) -> Iterator[str]:
    """The text in parts of about SLICE characters, cut at white space."""
    first = 0
    while len(text) - first > SLICE and (at := BREAK.search(text, first + SLICE)):
        yield text[first : at.start()]
        first = at.start()
    yield text[first:]
