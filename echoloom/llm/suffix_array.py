"""Suffix arrays by induced sorting, on numpy arrays.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost S suffixes of each run
are sorted first; all others follow from them in two scans. A scan goes bucket by bucket, a bucket wave by wave: the
entries a wave adds to its own bucket are the next wave, so every step is an array operation and each suffix is
moved once.
"""

from __future__ import annotations

import numpy as np

END, SEPARATOR, FIRST = 0, 1, 2
ALPHABET = 256 + FIRST


def classify(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end mark is."""
    n = len(text)
    smaller = np.zeros(n, bool)
    smaller[-1] = True
    differs = np.flatnonzero(text[:-1] != text[1:])
    if len(differs):
        # A run of equal symbols has the type of its last position.
        runs = np.diff(np.concatenate([[-1], differs]))
        smaller[:differs[-1] + 1] = np.repeat(text[differs] < text[differs + 1], runs)
    return smaller


def _place(out, at, text, entries, smaller, want, step):
    """Put the left neighbours of ``entries`` that have type ``want`` into their buckets, in order."""
    left = entries - 1
    left = left[left >= 0]
    left = left[smaller[left] == want]
    if not len(left):
        return
    symbols = text[left]
    order = np.argsort(symbols, kind="stable")
    left, symbols = left[order], symbols[order]
    counts = np.bincount(symbols, minlength=len(at))
    rank = np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts)
    out[at[symbols] + rank if step > 0 else at[symbols] - 1 - rank] = left
    at += step * counts


def induce(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix array that follows from the sorted leftmost S suffixes."""
    counts = np.bincount(text, minlength=alphabet)
    tails = np.cumsum(counts)
    heads = tails - counts
    symbols = text[leftmost]
    held = np.bincount(symbols, minlength=alphabet)
    seeds = np.concatenate([[0], np.cumsum(held)])
    by_symbol = leftmost[np.argsort(symbols, kind="stable")]
    out = np.full(len(text), -1, np.int64)
    at = heads.copy()
    for c in np.flatnonzero(counts):
        done = heads[c]
        while done < at[c]:
            wave = out[done:at[c]].copy()
            done = at[c]
            _place(out, at, text, wave, smaller, False, 1)
        if held[c]:
            _place(out, at, text, by_symbol[seeds[c]:seeds[c + 1]], smaller, False, 1)
    larger_end, at = at, tails.copy()
    for c in np.flatnonzero(counts)[::-1]:
        done = tails[c]
        while at[c] < done:
            wave = out[at[c]:done][::-1].copy()
            done = at[c]
            _place(out, at, text, wave, smaller, True, -1)
        if larger_end[c] > heads[c]:
            _place(out, at, text, out[heads[c]:larger_end[c]][::-1].copy(), smaller, True, -1)
        if c == text[-1]:
            # The end mark has no right neighbour that could induce it.
            out[heads[c]] = len(text) - 1
    return out


def _names(text: np.ndarray, places: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost S substrings, given in text order, from their sorted order; equal ones share a rank."""
    lengths = np.append(np.diff(places), 0) + 1
    a, b = order[:-1], order[1:]
    same = lengths[a] == lengths[b]
    alive = np.flatnonzero(same)
    offset = 0
    while len(alive):
        equal = text[places[a[alive]] + offset] == text[places[b[alive]] + offset]
        same[alive[~equal]] = False
        alive = alive[equal]
        offset += 1
        alive = alive[offset < lengths[a[alive]]]
    names = np.empty(len(places), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    return names


def _ranked(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: names of 1, 2, 4, … neighbours at a time until all differ."""
    width, top = 1, int(names.max()) + 1
    while top < len(names):
        follow = np.zeros(len(names), np.int64)
        follow[:-width] = names[width:] + 1
        pairs = names * (top + 1) + follow
        _, names = np.unique(pairs, return_inverse=True)
        top, width = int(names.max()) + 1, 2 * width
    return np.argsort(names, kind="stable")


def suffix_array(text: np.ndarray, alphabet: int = ALPHABET) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order; its last symbol must be ``END`` and occur nowhere else."""
    if len(text) < 2:
        return np.arange(len(text))
    smaller = classify(text)
    places = np.flatnonzero(smaller & np.concatenate([[False], ~smaller[:-1]]))
    rough = induce(text, smaller, places, alphabet)
    number = np.full(len(text), -1, np.int64)
    number[places] = np.arange(len(places))
    order = number[rough]
    order = order[order >= 0]
    names = _names(text, places, order)
    if len(places) > 1 and names.max() + 1 < len(places):
        order = _ranked(names)
    return induce(text, smaller, places[order], alphabet)


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """By position: symbols shared with the suffix before it in the array, up to a separator.

    Where the symbols to the left are equal too, the value is that of the left neighbour less one; only the other
    positions are compared.
    """
    before = np.full(len(text), -1, np.int64)
    before[array[1:]] = array[:-1]
    known = before > 0
    at = np.flatnonzero(known)
    at = at[at > 0]
    follows = np.zeros(len(text), bool)
    left = text[at - 1]
    follows[at] = (left == text[before[at] - 1]) & (left >= FIRST)
    own = np.flatnonzero(~follows & (before >= 0))
    shared = np.zeros(len(text), np.int64)
    other = before[own]
    offset = 0
    while len(own):
        # The end mark occurs once and separators count as different, so no comparison runs off the end.
        x = text[own + offset]
        equal = (x == text[other + offset]) & (x >= FIRST)
        shared[own[~equal]] = offset
        own, other = own[equal], other[equal]
        offset += 1
    source = np.maximum.accumulate(np.where(follows, 0, np.arange(len(text))))
    return shared[source] - (np.arange(len(text)) - source)
