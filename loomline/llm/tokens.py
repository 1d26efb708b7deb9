"""Exact ids of a lower-casing word BPE at array speed.

The tokenizer file's own pipeline (NFC, spaces, lower case, a split at letters, single
digits and the rest) never lets a token cross white space, and within ASCII and Latin-1
letters its split is decidable on bytes. So a block of texts is cut into units by byte
classes, units are told apart by their hashes all at once, checked on their bytes, and
only units that this worker hasn't met go through the ``tokenizers`` library. A word with anything else in it (an apostrophe,
other letters, a special token's ``<|``) is one unit and goes through the whole
tokenizer, so ids equal those of encoding the text as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .common import ASCII_LOWER, Block, ranges, runs, span_hashes

SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, *range(9, 14)]] = SPACE
_CLASS[97:123] = LETTER
_CLASS[48:58] = DIGIT


def _printable() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable Latin-1, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else more))
        more += b not in plain
    return out


BYTE_CHAR = _printable()


def _alike(b: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each unit, equal for equal bytes, and the first unit of each number. Equal hashes are checked on the bytes; should they lie, the bytes themselves are compared."""
    codes = pd.factorize(span_hashes(b, start, end))[0]
    if not len(codes):
        return codes, codes
    first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
    size, model = end - start, start[first][codes]
    same = (size == size[first][codes]).all()
    if same:
        each = ranges(start, size)
        same = (b[each] == b[each + np.repeat(model - start, size)]).all()
    if not same:
        codes = pd.factorize(np.array([data[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)], object))[0]
        first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
    return codes, first


class WordBpe:
    """One worker's tokenizer and the ids of the units it has met, at most ``keep`` of them (then it starts anew)."""

    def __init__(self, path: str, keep: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model = self.tokenizer.model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def _learn(self, unit: bytes, whole: bool) -> int:
        if whole:
            ids = self.tokenizer.encode(unit.decode("utf-8", "replace"), add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.model.tokenize("".join([BYTE_CHAR[b] for b in unit]))]
        i, end = len(self.known), self.used + len(ids)
        if i == len(self.at):
            self.at, self.count = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.count, np.zeros_like(self.count)))
        while end > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : end] = ids
        self.at[i], self.count[i], self.used = self.used, len(ids), end
        self.known[unit] = i
        return i

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        b = ASCII_LOWER[block.buf]
        lead = np.flatnonzero(b[:-1] == 0xC3)
        lead = lead[(b[lead + 1] != 0x97) & (b[lead + 1] != 0xB7)]
        second = lead + 1
        upper = second[b[second] <= 0x9E]
        kind = _CLASS[b]
        b[upper] += 0x20
        kind[lead] = kind[second] = LETTER
        odd = (b >= 0x80) & (kind == OTHER) | (b == 0x27)
        odd[:-1] |= (b[:-1] == 0x3C) & (b[1:] == 0x7C)
        if odd.any():
            start, end = runs(kind != SPACE)
            seen = np.concatenate(([0], np.cumsum(odd)))
            bad = seen[end] > seen[start]
            kind[ranges(start[bad], (end - start)[bad])] = WHOLE
        edge = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) + 1
        edge = np.concatenate(([0], edge, [len(b)]))
        start, end = edge[:-1], edge[1:]
        real = kind[start] != SPACE
        start, end = start[real], end[real]
        data = b.tobytes()
        codes, first = _alike(b, data, start, end)
        if len(self.known) + len(first) > self.keep and self.known:
            self._clear()
        get, rows = self.known.get, []
        for i, j, whole in zip(start[first].tolist(), end[first].tolist(), (kind[start[first]] == WHOLE).tolist(), strict=True):
            unit = data[i:j]
            at = get(unit)
            rows.append(self._learn(unit, whole) if at is None else at)
        rows = np.asarray(rows, np.int64)
        units = rows[codes] if len(codes) else rows
        count = self.count[units]
        ids = self.flat[ranges(self.at[units], count)]
        ends = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(start, block.at)]
        return ids, np.diff(ends)


_tokenizers: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The worker's own copy."""
    if path not in _tokenizers:
        _tokenizers[path] = WordBpe(path)
    return _tokenizers[path]


#: The split of the byte-level BPE's pre-tokenizer, a fixed value of its file format.
BYTE_UNITS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpeCounts(dict):
    """Token counts of a byte-level BPE (no normalizer, the usual split) by unit; a worker encodes a unit once. At most ``keep`` units are held, then it starts anew."""

    def __init__(self, path: str, keep: int = 300_000) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.model, self.keep = Tokenizer.from_file(path).model, keep
        self.units = regex.compile(BYTE_UNITS).findall

    def __missing__(self, unit: str) -> int:
        n = len(self.model.tokenize("".join([BYTE_CHAR[b] for b in unit.encode()])))
        if len(unit) <= 64:
            if len(self) >= self.keep:
                self.clear()
            self[unit] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        return sum(map(self.__getitem__, self.units(text)))


_counts: dict[str, ByteBpeCounts] = {}


def byte_bpe_counts(path: str) -> ByteBpeCounts:
    """The worker's own copy."""
    if path not in _counts:
        _counts[path] = ByteBpeCounts(path)
    return _counts[path]
