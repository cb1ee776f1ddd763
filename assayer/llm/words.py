"""Words, lines and shingles of many texts at once, as arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

U = np.uint64
#: Bytes of texts worked on at a time; a longer line is taken whole.
BLOCK = 1 << 20
#: Bits of the table of common shingles; what falls on one of its bits by chance counts as common too.
SLOTS = 1 << 16
BASE = 0x9E3779B97F4A7C15


def cleaned(text: str) -> bytes:
    """The text in lower case, with spaces for what is neither ASCII nor a letter or digit."""
    low = text.lower()
    if not low.isascii():
        for c in set(low):
            if c > "\x7f" and not c.isalnum():
                low = low.replace(c, " ")
    return low.encode("utf-8", "surrogatepass")


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: whether it belongs to a word of letters and digits, whether it isn't white space, and a random number."""
    byte = np.arange(256)
    letters = (byte >= 128) | ((byte >= 48) & (byte < 58)) | ((byte >= 97) & (byte < 123))
    return letters, (byte != 32) & ((byte < 9) | (byte > 13)), np.random.default_rng(11).integers(1, 1 << 64, 256, np.uint64)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to n at least."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n + 1, 2 * BLOCK), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of values, by sums of values times powers: the same wherever the run stands."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Words:
    """Of the words of a block: hash, bytes and line, the lines being numbered through all texts; and how many lines there are."""

    hashes: np.ndarray
    sizes: np.ndarray
    line: np.ndarray
    lines: int

    def grouped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, first word, number of words) of the lines that have words."""
        first = np.flatnonzero(np.diff(self.line, prepend=-1))
        return self.line[first], first, np.diff(first, append=len(self.line))


def words_of(blob: bytes, letters: bool = True) -> Words:
    """Words of letters and digits of cleaned texts, or else those between white space."""
    inside, solid, number = tables()
    raw = np.frombuffer(blob, np.uint8)
    edges = np.flatnonzero(np.diff((inside if letters else solid)[raw].view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    breaks = np.flatnonzero(raw == 10)
    return Words(runs(number[raw], starts, ends), ends - starts, np.searchsorted(breaks, starts), len(breaks) + 1)


def blocks_of(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of texts of about BLOCK bytes together."""
    first = total = 0
    for n, size in enumerate(sizes):
        if total and total + size > BLOCK:
            yield first, n
            first, total = n, 0
        total += size
    if sizes:
        yield first, len(sizes)


def simhashes(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits that over half of them have.

    Eight counters hold eight bits each, in lanes of a byte; runs of over 255 hashes are counted in parts.
    """
    parts = (counts + 254) // 255
    run = np.repeat(np.arange(len(counts)), parts)
    at = (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)) * 255 + starts[run]
    ones = np.zeros((len(counts), 64), np.int64)
    first = np.cumsum(parts) - parts
    if len(run):
        stop = starts[-1] + counts[-1]
        for j in range(8):
            lanes = np.add.reduceat((hashes[:stop] >> U(j)) & U(0x0101010101010101), at).view(np.uint8).reshape(-1, 8)
            ones[:, j::8] = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
    bits = 2 * ones > counts[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_keys(words: Words, starts: np.ndarray, counts: np.ndarray, width: int, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, run) of each shingle of width words in a row of each run of words; of a run of fewer words, one for all of them.

    Keys are ordered as similar texts are looked for: first what isn't common (in marks), then what has more letters, since
    long words are rare, then by hash.
    """
    windows = np.where((counts < width) & (counts > 0), 1, np.maximum(0, counts - width + 1))
    run = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[run]
    last = starts[run] + counts[run] - 1
    key, letters = np.zeros(len(run), np.uint64), np.zeros(len(run), np.int64)
    for k in range(width):
        inside = at + k <= last  # all, but in runs of fewer words
        place = np.minimum(at + k, last)
        key = np.where(inside, mixed((key ^ words.hashes[place]) * U(BASE)), key)
        letters += np.where(inside, words.sizes[place], 0)
    keys = ((1023 - np.minimum(letters, 1023)).astype(np.uint64) << U(52)) | (key >> U(12))
    if marks is not None:
        slot = (keys & U(SLOTS - 1)).astype(np.int64)
        keys |= ((marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(np.uint64) << U(62)
    return keys, run


def first_of_each(keys: np.ndarray, run: np.ndarray, count: int | np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first count distinct keys of each run (all if None), in order; count may be given for each run."""
    order = np.lexsort((keys, run)) if len(run) and run[-1] >= 1 << 20 else np.argsort((run.astype(np.uint64) << U(43)) | (keys >> U(20)))
    keys, run = keys[order], run[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (run[1:] != run[:-1])
    keys, run = keys[new], run[new]
    if count is None:
        return keys, run
    begin = np.flatnonzero(np.diff(run, prepend=-1))
    place = np.arange(len(run)) - np.repeat(begin, np.diff(begin, append=len(run)))
    held = place < (count if isinstance(count, int) else count[run])
    return keys[held], run[held]


def marks_of(common: list[int]) -> np.ndarray | None:
    """The table of common shingles; None if there are none."""
    if not common:
        return None
    slot = np.unique(np.array(common, np.int64) & (SLOTS - 1))
    bits = np.zeros(SLOTS // 8, np.uint8)
    np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    return bits
