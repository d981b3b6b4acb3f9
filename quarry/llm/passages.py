"""Numeric features of passages: what a passage looks like, not which words it has."""

from __future__ import annotations

import numpy as np

from quarry.llm import words as W

#: Words of a passage.
PASSAGE = 48

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other sign
_CLASS[0x61:0x7B] = 1  # lower
_CLASS[0x41:0x5B] = 2  # upper
_CLASS[0x30:0x3A] = 3  # digit
_CLASS[0x80:] = 4  # part of a non-ASCII character
_CLASS[[0x20, *range(0x09, 0x0E)]] = 5  # space
_CLASS[[0x2C, 0x2E, 0x3B, 0x3A, 0x27, 0x28, 0x29, 0x3F, 0x2D, 0x22]] = 6  # common punctuation
CLASSES = 7
LAGS = (1, 2, 3, 4, 5, 6)
FEATURES = CLASSES + 6 + len(LAGS) + 4


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, first passage of each text and one more). A text without words is one passage of zeros."""
    words = W.split(data, at, W.NON_SPACE, lower=False)
    counts = words.counts
    per = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros((int(first[-1]), FEATURES), dtype=np.float64)
    if not len(words.starts):
        return out, first
    owner = words.text_of()
    inside = np.arange(len(owner)) - words.first[owner]
    passage = first[owner] + inside // PASSAGE
    n = np.bincount(passage, minlength=len(out)).astype(np.float64)
    n[n == 0] = 1
    length = (words.ends - words.starts).astype(np.float64)
    # bytes by class: running counts at word ends
    kinds = _CLASS[data]
    size = np.bincount(passage, weights=length, minlength=len(out))
    size[size == 0] = 1
    per_class = np.empty((len(owner), CLASSES))
    for k in range(CLASSES):
        upto = np.concatenate([[0], np.cumsum(kinds == k)])
        per_class[:, k] = upto[words.ends] - upto[words.starts]
        out[:, k] = np.bincount(passage, weights=per_class[:, k], minlength=len(out)) / size
    mean = lambda x: np.bincount(passage, weights=x, minlength=len(out)) / n
    at_k = CLASSES
    shouted = ((per_class[:, 2] > 0) & (per_class[:, 1] == 0) & (length > 1)).astype(float)
    signed = (per_class[:, 0] > 0).astype(float)
    lone = ((per_class[:, 0] == length) & (length <= 2)).astype(float)
    last = kinds[words.ends - 1]
    ending = (last == 0).astype(float)
    for x in (shouted, signed, lone, ending, length / 8, (length > 24).astype(float)):
        out[:, at_k] = mean(x)
        at_k += 1
    hashes = words.hashes()
    for lag in LAGS:
        same = np.zeros(len(owner))
        if len(owner) > lag:
            same[lag:] = (hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag])
        out[:, at_k] = mean(same)
        at_k += 1
    deviation = mean((length / 8) ** 2) - mean(length / 8) ** 2
    order = np.lexsort((hashes, passage))
    new = np.ones(len(owner))
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order], weights=new, minlength=len(out)) / n
    starts_upper = ((per_class[:, 2] > 0) & (kinds[words.starts] == 2)).astype(float)
    for x in (np.sqrt(np.maximum(deviation, 0)), distinct, mean(starts_upper), np.minimum(n / PASSAGE, 1)):
        out[:, at_k] = x
        at_k += 1
    return out, first
