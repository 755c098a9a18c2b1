"""Word shingles of whole texts in NumPy, straight from Arrow buffers.

Words are runs of bytes outside x20 and x09-x0D with A-Z lower-cased; a text's set
holds a 64-bit hash of each distinct run of WIDTH words, or of the whole sequence
where it has fewer. A null text, or one without words, has the empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text hashed at once; a longer word makes its block longer.
BLOCK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coefficients(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers fixed by seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_PLACES = coefficients(64, 1)
_TURNS = coefficients(WIDTH, 2)


def _places(n: int) -> np.ndarray:
    global _PLACES
    if n > len(_PLACES):
        table = coefficients(n, 1)
        if n > 1 << 16:
            return table  # not kept: one very long word
        _PLACES = table
    return _PLACES


def _hash_block(raw: np.ndarray) -> np.ndarray:
    """A hash of each word of raw."""
    word = _WORD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    lengths = edge[1::2] - edge[::2]
    if not len(lengths):
        return np.empty(0, np.uint64)
    offs = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(lengths.sum()) - np.repeat(offs, lengths)
    terms = _LOWER[raw[word]] * _places(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, offs) + lengths.astype(np.uint64))


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each word of one text, block by block."""
    if len(raw) <= BLOCK:
        return _hash_block(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw) and _WORD[raw[end - 1]]:  # on to the end of the word
            gap = np.flatnonzero(~_WORD[raw[end : end + BLOCK]])
            end += int(gap[0]) + 1 if len(gap) else min(BLOCK, len(raw) - end)
        out.append(_hash_block(raw[at:end]))
        at = end
    return np.concatenate(out)


def _runs(words: np.ndarray) -> np.ndarray:
    n = len(words) - WIDTH + 1
    if n < 1:
        total = np.uint64(len(words))
        for k, w in enumerate(words):
            total = total + w * _TURNS[k]
        return mix(np.array([total], np.uint64))
    total = np.full(n, WIDTH, np.uint64)
    for k in range(WIDTH):
        total += words[k : k + n] * _TURNS[k]
    return mix(total)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The offsets, bytes and null flags of an Arrow string column, without a copy."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), np.asarray(column.is_null())


def shingle_sets(column: pa.Array):
    """The sorted distinct shingle hashes (uint64) of each text of column, one text at a time.

    Short texts are hashed together, a block at a time; the results are the same.
    """
    if not len(column):
        return
    offsets, data, null = buffers(column)
    i, n = 0, len(column)
    with np.errstate(over="ignore"):
        while i < n:
            j = i + 1
            while j < n and offsets[j + 1] - offsets[i] <= BLOCK // 4:
                j += 1
            if j == i + 1:
                words, cuts = word_hashes(data[offsets[i] : offsets[j]]), None
            else:  # texts are joined by one space, so that words end with their text
                lens = np.diff(offsets[i : j + 1])
                raw = np.full(int(lens.sum()) + (j - i), 32, np.uint8)
                begin = np.concatenate(([0], np.cumsum(lens + 1)))
                keep = np.ones(len(raw), bool)
                keep[begin[1:] - 1] = False
                raw[keep] = data[offsets[i] : offsets[j]]
                words = _hash_block(raw)
                word = _WORD[raw]
                first = word & ~np.concatenate(([False], word[:-1]))
                cuts = np.concatenate(([0], np.cumsum(first)))[begin]
            for k in range(i, j):
                own = words if cuts is None else words[cuts[k - i] : cuts[k - i + 1]]
                yield np.empty(0, np.uint64) if null[k] or not len(own) else np.unique(_runs(own))
            i = j
