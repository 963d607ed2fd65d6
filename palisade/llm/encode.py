"""Whole-text encoding with a tokenizer library, one white-space unit at a time.

A unit is a run of white space with the word after it. Neither the byte-level nor
the word-end tokenizers join anything across the start of a unit, so a text's ids
are its units' ids in a row; each unit is encoded once and kept, for all tasks that a
Python worker runs. Units of plain characters are cut where the tokenizer's splitter
cuts them, and their pieces go to the library's merge model; other units go through
the whole library. A text that holds the string of a special token, or characters that
Python and the library differ on, is given to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache
from string import punctuation

import numpy as np

#: Units of a generation, of all an encoder's maps together. A worker keeps two generations at most, and what a
#: run of texts (`slices`) adds before they are counted: about UNIT_BYTES each.
KEPT_UNITS = 150_000
UNIT_BYTES = 250
#: Python and the libraries differ on whether these are white space.
_UNCERTAIN = "\x1c\x1d\x1e\x1f"
_UNITS = re.compile(r"\s*\S+|\s+")
#: White space other than the space and the line feed.
_OTHER_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0                　"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Characters that no normalisation changes, whose case is one to one and whose class is sure.
_PLAIN = re.compile(f"[ -~\n{_LETTERS}]*")
_WORD = re.compile(f"[{_LETTERS}]+")
#: Where the splitters cut plain units.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACED_PIECES = re.compile(rf"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_WORD_PIECES = re.compile(rf"{_CONTRACTIONS}|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")


def as_bytes(ids: Iterable[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class Known(dict):
    """ids by unit, learned where missing. A new generation takes over what is still in use."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn, self.older = learn, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            ids = self.learn(unit)
        self[unit] = ids
        return ids

    def turn(self) -> None:
        self.older = dict(self)
        self.clear()


class UnitEncoder:
    """Maps texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, library, keeps_space: bool, kept: int = KEPT_UNITS):
        self.library, self.keeps_space, self.kept = library, keeps_space, kept
        self.specials = [token.content for token in library.get_added_tokens_decoder().values()]
        self.alphabet, self.merge = byte_alphabet(), library.model.tokenize
        self.units = Known(self._unit)
        #: By what follows a single space; a key that begins with a line feed has none before it.
        self.spaced = Known(self._spaced)

    def _whole(self, text: str) -> bytes:
        return as_bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _merged(self, shown: str) -> bytes:
        return array("I", [x.id for x in self.merge(shown)]).tobytes()

    def _spaced(self, key: str) -> bytes:
        if key.isascii() and key.isalpha():  # one piece, whatever the splitter
            return self._merged(f"{self.alphabet[32]}{key}")
        # Nor does it cut a word or a run of marks at its end anywhere else: most of what is new needs no splitter.
        body = key.rstrip(punctuation)
        begun = body[:1] == "\n"
        word = body[begun:]
        if word.isalpha() and (word.isascii() or _WORD.fullmatch(word)):
            if body == key and not begun:
                return self._merged(self.alphabet[32] + word.encode().decode("latin-1").translate(self.alphabet))
            ids = self.units["\n"] + self.units[word] if begun else self.spaced[word]
            return ids if body == key else ids + self.units[key[len(body) :]]
        return self._unit(key if key[:1] == "\n" else f" {key}")

    def _unit(self, unit: str) -> bytes:
        if unit.isascii() and unit.isalpha():
            if self.keeps_space or unit.islower():
                return self._merged(unit)
            return self.units[unit.lower()]
        if not _PLAIN.fullmatch(unit):
            return self._whole(unit)
        if self.keeps_space:
            pieces = _SPACED_PIECES.findall(unit)
        else:
            pieces = _WORD_PIECES.findall(unit.lower())
        if pieces != [unit]:
            return b"".join(self.spaced[p[1:]] if p[0] == " " and not p.isspace() else self.units[p] for p in pieces)
        if unit.isascii():
            shown = unit.replace(" ", self.alphabet[32]).replace("\n", self.alphabet[10])
        else:
            shown = unit.encode().decode("latin-1").translate(self.alphabet)
        return self._merged(shown)

    def _text(self, text: str) -> bytes:
        if any(c in text for c in _UNCERTAIN) or any(token in text for token in self.specials):
            return self._whole(text)
        if not self.keeps_space:
            return b"".join(map(self.units.__getitem__, text.split()))
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or any(c in text for c in _OTHER_SPACES):
            return b"".join(map(self.units.__getitem__, _UNITS.findall(text)))
        # Every run of white space is one character here.
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.units[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.units) + len(self.spaced) > self.kept:
            self.units.turn()
            self.spaced.turn()
        return list(map(self._text, texts))


def byte_alphabet() -> dict[int, str]:
    """The character of each byte: itself if it is printable, else the next one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def library_encoder(path: str, keeps_space: bool, kept: int = KEPT_UNITS) -> UnitEncoder:
    """Of a tokenizers file, kept for all tasks of a worker. A tokenizer that drops white space also lower-cases."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    return UnitEncoder(Tokenizer.from_file(path), keeps_space, kept)


def slices(texts: list[str], characters: int = 1 << 20) -> Iterable[list[str]]:
    """texts in runs of about so many characters, so that a batch needs little memory."""
    run, n = [], 0
    for text in texts:
        run.append(text)
        n += len(text)
        if n >= characters:
            yield run
            run, n = [], 0
    if run:
        yield run
