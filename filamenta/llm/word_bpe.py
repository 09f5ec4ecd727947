"""Exact ids of a word-end BPE vocabulary file, word by word.

The file is one of the tokenizers library: NFC, white space to one space, lower
case; words split off by its pattern; byte-level BPE whose last symbol in a word
ends in </w>. Words are encoded once and remembered, as bytes of little-endian
unsigned 32-bit ids. Texts made only of ASCII and Latin-1 letters are split here;
any other text is split at spaces and line feeds (which no word crosses) and
those pieces that aren't plain go through the library itself. A text that holds
the beginning of a special token goes through the library whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

from .common import held_for

_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
_WORD = re.compile(r"[a-zß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\t-\r 0-9a-zß-öø-ÿ]+")
_PIECE = re.compile(r"[^ \n]+")
#: Symbols from which a word counts as long unsplit text.
LONG = 256
#: Words that a Python worker remembers; then it starts again.
REMEMBERED = 600_000


def _byte_symbols() -> list[str]:
    """The usual printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = json.load(open(path, encoding="utf-8"))["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        self.unranked = len(self.rank)
        self.token = [""] * self.library.get_vocab_size(with_added_tokens=True)
        for t, i in self.library.get_vocab(with_added_tokens=True).items():
            self.token[i] = t
        self.symbol = _byte_symbols()
        self.known: dict[str, bytes] = {}

    def symbols(self, word: str) -> list[str]:
        out = [self.symbol[b] for b in word.encode()]
        out[-1] += "</w>"
        return out

    def merged(self, parts: list[str]) -> list[str]:
        """The symbols (changed in place) after all merges, lowest rank first, leftmost first."""
        find, none = self.rank.get, self.unranked
        ranks = [find(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = find((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = find((parts[i], parts[i + 1]), none)
        return parts

    def word(self, word: str) -> bytes:
        if len(word) > 64:
            return self._by_library(word)
        ids = self.ids
        return np.array([ids[p] for p in self.merged(self.symbols(word))], "<u4").tobytes()

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _remember(self, word: str, ids: bytes) -> bytes:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = ids
        return ids

    def words(self, text: str) -> list[str] | None:
        """The words of a plain text; None if it isn't plain."""
        return _WORD.findall(text.lower()) if _PLAIN.fullmatch(text) else None

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return self._by_library(text)
        words = self.words(text)
        if words is not None:
            get = self.known.get
            parts = [get(w) or self._remember(w, self.word(w)) for w in words]
            return b"".join(parts)
        out = []
        for piece in _PIECE.findall(text):
            words = self.words(piece)
            if words is None:
                key = "\x00" + piece  # a word has no such beginning, as words are plain and pieces here aren't
                out.append(self.known.get(key) or self._remember(key, self._by_library(piece)))
            else:
                out += [self.known.get(w) or self._remember(w, self.word(w)) for w in words]
        return b"".join(out)


def load(path: str) -> WordBpe:
    """One vocabulary a Python worker, with the words that it remembers, until it works for another operator."""
    return held_for(f"vocabulary {path}", lambda: WordBpe(path))
