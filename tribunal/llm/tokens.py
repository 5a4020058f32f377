"""Token ids and counts through a word cache.

Both cached schemes cut a text only where the tokenizer itself always cuts, so the ids of the pieces, joined, are the ids of the text; each
distinct piece goes through the tokenizers library once per worker (as long as the bounded cache keeps it).
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import give_back

#: Bounds of a worker's caches: pieces, parts of them, and characters in the parts.
MAX_PIECES, MAX_PARTS, MAX_CHARS = 900_000, 900_000, 32_000_000
#: Pieces that a worker keeps from one task to the next. Workers outlive their tasks, and what they hold stands beside all later stages.
REST = 150_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Numbers the pieces it is asked for; new ones wait in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, piece):
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class PieceCache:
    """ids and counts of texts. `split` gives a text's pieces, `parts` what to encode for a piece: the ids of the parts, joined, are the piece's."""

    def __init__(self, path: str, split, parts):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self._split, self._parts = Tokenizer.from_file(path), split, parts
        self._model = self.tokenizer.model
        self._known: dict[str, bytes] = {}
        self._clear()

    def _clear(self):
        self._pieces, self._chars = _Pieces(), 0
        self._len, self._start, self._ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self._seen = np.zeros(0, np.int64)

    def _prune(self, most: int = MAX_PIECES // 2):
        """Keep the pieces that were seen most, of those seen twice or more, since most of the rare ones never come again."""
        keep = np.flatnonzero(self._seen > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-self._seen[keep], kind="stable")[:most]])
        names, lens, start = list(self._pieces), self._len[keep], self._start[keep]
        self._pieces = _Pieces()
        self._pieces.update((names[k], i) for i, k in enumerate(keep.tolist()))
        self._ids = self._ids[np.arange(lens.sum()) + np.repeat(start - (np.cumsum(lens) - lens), lens)]
        self._len, self._start, self._seen = lens, np.cumsum(lens) - lens, self._seen[keep] // 2

    def rest(self):
        """After a task: keep what the next one is likely to need, and give the rest of the memory back."""
        self._prune(REST)
        self._known, self._chars = {}, 0
        give_back()

    def _learn(self):
        new, self._pieces.new = self._pieces.new, []
        if not new:
            return
        if len(self._known) > MAX_PARTS or self._chars > MAX_CHARS:
            self._known, self._chars = {}, 0
        known, parts_of, tokenize = self._known, self._parts, self._model.tokenize
        whole, found = [], []
        for p in new:
            parts = parts_of(p)
            for x in parts:
                if x not in known:
                    self._chars += len(x)
                    if _PLAIN.fullmatch(x):  # one word: no special string, no normalising, one call of the model
                        x_bytes = x.replace(" ", "\u0120") if x.isascii() else "".join([_AS_CHARS[b] for b in x.encode()])
                        known[x] = array("I", [t.id for t in tokenize(x_bytes)]).tobytes()
                    else:
                        known[x] = b""
                        whole.append(x)
            found.append(parts)
        for i in range(0, len(whole), 1024):
            for x, e in zip(whole[i : i + 1024], self.tokenizer.encode_batch_fast(whole[i : i + 1024], add_special_tokens=False), strict=True):
                known[x] = array("I", e.ids).tobytes()
        raw = [b"".join([known[x] for x in parts]) for parts in found]
        lens, n = np.array(list(map(len, raw)), np.int64) >> 2, len(self._ids)
        self._start = np.concatenate((self._start, n + np.cumsum(lens) - lens))
        self._len = np.concatenate((self._len, lens))
        self._ids = np.concatenate((self._ids, np.frombuffer(b"".join(raw), np.uint32)))

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._pieces) > MAX_PIECES:
            self._prune()
        numbers: list[int] = []
        off = [0]
        get = self._pieces.__getitem__
        for t in texts:
            numbers.extend(map(get, self._split(t)))
            off.append(len(numbers))
        self._learn()
        number = np.array(numbers, np.int64)
        self._seen = np.bincount(number, minlength=len(self._pieces)) + np.pad(self._seen, (0, len(self._pieces) - len(self._seen)))
        return number, np.array(off, np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        number, off = self._numbers(texts)
        total = np.concatenate(([0], np.cumsum(self._len[number])))
        return total[off[1:]] - total[off[:-1]]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and n + 1 offsets of each text's."""
        number, off = self._numbers(texts)
        lens = self._len[number]
        total = np.concatenate(([0], np.cumsum(lens)))
        where = np.arange(total[-1]) + np.repeat(self._start[number] - total[:-1], lens)
        return self._ids[where], total[off]


_CACHES: dict[tuple, PieceCache] = {}


def piece_cache(path: str, split, parts) -> PieceCache:
    """This worker's cache, which its tasks share."""
    key = (path, split.__name__, parts.__name__)
    if key not in _CACHES:
        _CACHES.clear()  # one at a time bounds the memory
        _CACHES[key] = PieceCache(path, split, parts)
    return _CACHES[key]


_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
#: A word and the signs behind it, of which none starts a contraction or a special string.
_WORD = re.compile(f"({_LETTERS})([.,!?:;%$&#*)-]*)")
_WORDS = re.compile(f"({_LETTERS})([.,]?)(?:(\n)({_LETTERS})([.,]?))?")
#: Also characters that are white space by some libraries' tables only.
_DOUBT = "\\s\u180e\u200b\ufeff"
_SPACES = re.compile(f"[{_DOUBT}] ")
_CUT = re.compile(f"(?<=[^{_DOUBT}])(?= )")


_PLAIN = re.compile(f" ?{_LETTERS}")


def _byte_chars() -> list[str]:
    """Byte-level vocabularies write a printable Latin-1 byte as its character and the n-th other byte as code point 256 + n."""
    out, n = [], 0
    for b in range(256):
        shown = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
        out.append(chr(b if shown else 256 + n))
        n += not shown
    return out


_AS_CHARS = _byte_chars()


def split_words(text: str) -> list[str]:
    """For a tokenizer that lower-cases, drops white space and never lets a token span it."""
    return text.replace("\n", " ").split(" ")


def word_parts(piece: str) -> list[str]:
    if piece.isascii() and piece.isalpha():
        return [piece.lower()]
    m = _WORD.fullmatch(piece)
    return [x for x in (m[1].lower(), m[2]) if x] if m else [piece]


def split_before_spaces(text: str) -> list:
    """For byte-level BPE: a token holds a space only in front, so any space after a non-space starts a token. A 1-tuple is taken as it is."""
    if _SPACES.search(text):
        return [(p,) for p in _CUT.split(text)]
    first, *rest = text.split(" ")
    return [(first,), *rest]


def spaced_parts(piece) -> list[str]:
    """A str piece has a space in front. Letters end at a point or comma, and a line break between words is a token."""
    if not isinstance(piece, str):
        return [piece[0]]
    m = _WORDS.fullmatch(piece)
    return [x for x in (" " + m[1], *m.groups("")[1:]) if x] if m else [" " + piece]
