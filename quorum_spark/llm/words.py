"""Words of whole texts as NumPy arrays: boundaries and 64-bit hashes for all texts of an Arrow batch at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. What decides whether words are equal are BLAKE2b digests
(`digests`), or their bytes where these are few; windows of words hash pairs of halves of them. Features of
classifiers use polynomials modulo 2**64 (`hashes`), for which different words of the same hash can be written on purpose.
Both depend on nothing but the word's bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: As separators: all of ASCII but letters and digits, and line feeds alone.
MARKS, LINES = np.array([c < 128 and not chr(c).isalnum() for c in range(256)]), np.arange(256) == 10
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE, CHAIN, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Bytes of a word that 128 bits hold with its length; masks of the first bytes of eight; constants of a permutation's rounds.
SHORT = 15
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ROUNDS = BASE * np.arange(1, 7, dtype=np.uint64)
#: Bytes of text that are handled at once, unless one text alone is longer.
PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which every input bit changes half of the output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `most` bytes of text each, or one row."""
    arr = batch.column(batch.schema.get_field_index(column))
    _, off = raw(arr)
    at, n = 0, len(arr)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()


@cache
def _trim():
    """glibc's malloc_trim, None with other libraries."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and what one stage has used would stay beside the next one's."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins and ends; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


class Words:
    """Words of a list of texts. `starts`, `ends`: byte positions of each; text i has words `at[i]` to `at[i + 1]`."""

    def __init__(self, arr: pa.Array, lower: bool = False, spaces: np.ndarray = SPACE):
        self.buf, self.off = raw(arr)
        if lower:
            self.buf = LOWER[self.buf]
        n = len(self.buf)
        space = spaces[self.buf]
        self.space = space
        first = np.zeros(n + 1, bool)
        first[self.off] = True
        start, end = ~space, ~space
        start[1:] &= space[:-1] | first[1:-1]
        end[:-1] &= space[1:] | first[1:-1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.at = np.searchsorted(self.starts, self.off)

    def __len__(self) -> int:
        return len(self.off) - 1

    def hashes(self, base: np.uint64 = BASE) -> np.ndarray:
        """A hash of each word; another base gives another one."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        begin = np.zeros(len(lens), np.int64)
        np.cumsum(lens[:-1], out=begin[1:])
        powers = np.multiply.accumulate(np.full(int(lens.max()), base, np.uint64))
        place = np.arange(int(lens.sum())) - np.repeat(begin, lens)
        values = (self.buf[~self.space].astype(np.uint64) + np.uint64(1)) * powers[place]
        return mix(np.add.reduceat(values, begin) ^ (lens.astype(np.uint64) << np.uint64(48)))

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """The halves of 128 bits that name each word. Of words of up to SHORT bytes they are the bytes and the length themselves, permuted, so no two are alike; longer ones have BLAKE2b digests."""
        lens = self.ends - self.starts
        eight = np.ndarray(len(self.buf) + 8, np.dtype("<u8"), np.concatenate([self.buf, np.zeros(16, np.uint8)]), strides=(1,))
        low = eight[self.starts] & _FIRST[np.minimum(lens, 8)]
        high = eight[np.minimum(self.starts + 8, len(self.buf))] & _FIRST[np.clip(lens - 8, 0, 7)] | lens.astype(np.uint64) << np.uint64(56)
        for k in range(0, len(_ROUNDS), 2):
            high ^= mix(low + _ROUNDS[k])
            low ^= mix(high + _ROUNDS[k + 1])
        known: dict[bytes, tuple] = {}
        text = self.buf.data
        for i in np.flatnonzero(lens > SHORT).tolist():
            word = text[self.starts[i] : self.ends[i]].tobytes()
            if word not in known:
                known[word] = np.frombuffer(blake2b(word, digest_size=16).digest(), np.uint64)
            low[i], high[i] = known[word]
        return low, high

    def doc_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self)), np.diff(self.at))

    def kept(self, keep: np.ndarray | None = None) -> list[memoryview]:
        """Each text's words, or those with keep true, joined by one space, in UTF-8."""
        if keep is None:
            keep = np.ones(len(self.starts), bool)
        lens = np.where(keep, self.ends - self.starts + 1, 0)
        index = np.repeat(self.starts, lens) + np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        out = np.append(self.buf, np.uint8(32))[index]
        sums = np.concatenate([[0], np.cumsum(lens)])
        out[sums[1:][keep] - 1] = 32
        view, at = memoryview(out), sums[self.at]
        return [view[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


def windows(h: np.ndarray, at: np.ndarray, k: int, chain: np.uint64 = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that lie in one text, and the index of the first word of each."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = _runs(h, k, chain)
    room = np.repeat(at[1:], np.diff(at))[:n] - np.arange(n) >= k
    pos = np.flatnonzero(room)
    return acc[pos], pos


def _runs(h: np.ndarray, k: int, chain: np.uint64) -> np.ndarray:
    """Hashes of all runs of k numbers: runs of powers of two from two halves each, then those of which k is made, the longest first."""
    acc, have, part, size = None, 0, h, 1
    parts = [(1, h)]
    while size * 2 <= k:
        part, size = mix(part[:-size] * chain + part[size:]), size * 2
        parts.append((size, part))
    n = len(h) - k + 1
    for size, part in reversed(parts):
        if have + size <= k:
            own = part[have : have + n]
            acc, have = own if acc is None else mix(acc * chain + own), have + size
    return acc


def sequence_hash(h: np.ndarray) -> np.uint64:
    """The hash of one run of words of any length, equal to that of `windows` for the same words."""
    return _runs(h, len(h), CHAIN)[0]


def shingle_sets(words: Words, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, as signed 64-bit numbers; with fewer words, of the whole sequence; without words, none."""
    h, _ = words.digests()
    sh, pos = windows(h, words.at, k)
    lo = np.searchsorted(pos, words.at)
    for i in range(len(words)):
        a, b = lo[i], lo[i + 1]
        if b > a:
            s = np.sort(sh[a:b].view(np.int64))
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif words.at[i + 1] > words.at[i]:
            yield np.array([sequence_hash(h[words.at[i] : words.at[i + 1]])], np.uint64).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
