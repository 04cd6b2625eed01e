"""Word shingles of whole batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .substrings import _buffers, _mix, _powers

CHUNK = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def pieces(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) for whole texts of about a chunk in all."""
    data, at = _buffers(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + chunk, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(data: np.ndarray, at: np.ndarray, apart: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to) of each word; words never cross texts.  ``apart``: bytes between words."""
    inside = ~apart[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = at[1:-1]
    cut = cut[cut < len(data)]
    starts[cut] = inside[cut]
    first = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = cut[cut > 0]
    ends[cut - 1] = inside[cut - 1]
    # few texts hold many words
    return np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(first, at))), first, np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes, A-Z folded; a stretch costs the same at any length."""
    up, down = _powers(max(2 * CHUNK, len(data)) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLD[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return _mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word, A-Z folded."""
    text, first, last = word_spans(data, at)
    return text, span_hashes(data, first, last) if len(text) else np.zeros(0, np.uint64)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted: one array and its offsets.

    A text of fewer words has its whole sequence as one shingle.
    """
    text, word = word_hashes(data, at)
    n = len(at) - 1
    have = np.bincount(text, minlength=n)
    begin = np.concatenate([[0], np.cumsum(have)])
    # the hash of a run of words is a sum over places, so any width costs the same
    value = word.copy()
    for k in range(1, min(width, len(word))):
        value[: len(word) - k] = _mix(value[: len(word) - k] * _STEP + word[k:])
    sets, size = [], np.zeros(n + 1, np.int64)
    for i in range(n):
        a, b = begin[i], begin[i + 1]
        if b - a >= width:
            own = np.unique(value[a : b - width + 1])
        elif b > a:
            h = word[a : a + 1].copy()
            for k in range(a + 1, b):
                h = _mix(h * _STEP + word[k : k + 1])
            own = _mix(h + np.uint64(b - a))
        else:
            continue
        sets.append(own)
        size[i + 1] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(size)
