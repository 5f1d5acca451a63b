"""Word and shingle hashes of Arrow text columns, with numpy inside the tasks of ``mapInArrow``.

Texts are handled as UTF-8 bytes: both word definitions of this package split at ASCII bytes only,
so no byte of a longer character is ever a separator. A batch is walked in blocks of about
``BLOCK`` bytes, which bounds the memory of a task; a longer text is cut at separators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
ROWS = 1023  # rows of a block: their number shares 64 bits with 54 bits of hash
SPACES = [0x20, *range(0x09, 0x0E)]
NOT_ALNUM = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]  # of lower-cased text

_K = np.uint64(0x9E3779B97F4A7C15)
_KINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * BLOCK)
        one = np.ones(1, np.uint64)
        _POWERS[:] = [np.cumprod(np.concatenate([one, np.full(size - 1, k, np.uint64)])) for k in (_K, _KINV)]
    return _POWERS[0][:n], _POWERS[1][:n]


def bounds(data: np.ndarray, is_word: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; no run passes a position in ``cut``."""
    inside = is_word[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if cut is not None:
        before[cut[(cut > 0) & (cut < len(data))]] = False
        after[cut[cut > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_table(separators: list[int]) -> np.ndarray:
    """256 flags: which bytes belong to words."""
    table = np.ones(256, bool)
    table[separators] = False
    return table


def _hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the lower-cased bytes of each run."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)


def _cuts(data: np.ndarray, is_word: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of a long text, cut at separators; a single longer word stays whole."""
    at = 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data):
            back = np.flatnonzero(~is_word[data[at:to]])
            if len(back) and back[-1] > 0:
                to = at + int(back[-1])
                break
            to = min(len(data), to + BLOCK)
        yield data[at:to]
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def blocks(at: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``ROWS`` rows with about ``size`` bytes together, or one longer row."""
    row, n = 0, len(at) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        to = min(to, n, row + ROWS)
        yield row, to
        row = to


def hashed_words(column: pa.Array, separators: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of rows: first row, row after the last, word hashes, and the words' row offsets."""
    is_word = word_table(separators)
    data, at = text_bytes(column)
    for row, to in blocks(at):
        part, cut = data[at[row] : at[to]], at[row : to + 1] - at[row]
        if to - row == 1:
            found = [_hash_runs(p, *bounds(p, is_word)) for p in _cuts(part, is_word)]
            words = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield row, to, words, np.array([0, len(words)])
            continue
        start, end = bounds(part, is_word, cut)
        yield row, to, _hash_runs(part, start, end), np.searchsorted(start, cut)


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 54-bit hashes of the k-word shingles of each row, and their offsets.

    A row with fewer words has its whole sequence as the only shingle, one without words none.
    """
    size = np.diff(at)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), count)
    first = np.repeat(at[:-1] - np.cumsum(count) + count, count) + np.arange(len(row))
    value = np.zeros(len(row), np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    short = np.repeat(np.minimum(size, k), count)
    for j in range(k):
        word = padded[first + j]
        if len(short) and j >= short.min():
            word = np.where(j < short, word, np.uint64(j + 1))
        value = value * _STEP + word
    key = np.sort(row.astype(np.uint64) << np.uint64(54) | mix(value) >> np.uint64(10))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    row = (key >> np.uint64(54)).astype(np.int64)
    return key & np.uint64((1 << 54) - 1), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))])
