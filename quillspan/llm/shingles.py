"""Words, shingles and Order MinHash sketches of whole batches of texts at once (numpy, no loop over words)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _S30)
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


def _seed(i: int) -> np.uint64:
    return mix(np.array([i * 0x9E3779B97F4A7C15 % 2**64], dtype=np.uint64))[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, offsets of each text in it); words are separated by white space."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(lists) else lists.values
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    coded = words.dictionary_encode()
    known = np.asarray(coded.dictionary.to_pandas(), dtype=object)
    hashes = pd.util.hash_array(known, categorize=False) if len(known) else np.zeros(0, np.uint64)
    flat = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    if len(known) and (known == "").any():  # a blank text is one empty word
        size = np.diff(offsets)
        empty = pd.util.hash_array(np.array([""], dtype=object), categorize=False)[0]
        keep = flat != empty
        owner = np.repeat(np.arange(len(size)), size)
        flat = flat[keep]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(size)))]).astype(np.int64)
    return flat, offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words, offsets of each text); texts of fewer words have none."""
    n = np.diff(offsets)
    m = np.maximum(n - k + 1, 0)
    to = np.concatenate([[0], np.cumsum(m)]).astype(np.int64)
    at = np.arange(to[-1]) + np.repeat(offsets[:-1] - to[:-1], m)
    h = np.zeros(to[-1], np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[at + j])
    return h, to


def sequence_keys(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each sequence of hashes, as two 64-bit numbers; sequences must not be empty."""
    at = (np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64)
    a = mix(h + at * np.uint64(0x9E3779B97F4A7C15))
    b = mix(h ^ mix(at + np.uint64(0xD1B54A32D192ED03)))
    return np.add.reduceat(a, offsets[:-1]), np.add.reduceat(b, offsets[:-1])


def occurrence_labelled(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in which the n-th occurrence in a text differs from the others, distinct hashes per text)."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, owner))
    s, o = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    out = h.copy()
    again = nth > 0
    out[order[again]] = mix(s[again] + nth[again].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return out, np.bincount(o[new], minlength=len(n))


def first_occurrences(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text without those that stood in it before, offsets of each text in them)."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((h, owner))  # stable: the first of equal ones comes first
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    keep = np.zeros(len(h), bool)
    keep[order[new]] = True
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(offsets) - 1))]).astype(np.int64)


def order_minhash(labelled: np.ndarray, offsets: np.ndarray, sketches: int, size: int) -> np.ndarray:
    """Order MinHash with ``size`` k-mers a sketch: the smallest labelled k-mers under a hash of each
    sketch, put in the order in which they stand in the text. (texts, sketches) of 64-bit numbers;
    texts must not be empty. A text of fewer k-mers has those it has."""
    starts, n = offsets[:-1], np.diff(offsets)
    out = np.empty((len(n), sketches), np.uint64)
    three = np.uint64(3)
    for t in range(sketches):
        v = mix(labelled ^ _seed(2 * t + 1))
        least, place = [], []
        for _ in range(size):
            m = np.minimum.reduceat(v, starts)
            p = np.flatnonzero(v == np.repeat(m, n))
            own = np.searchsorted(offsets, p, side="right") - 1
            p = p[np.concatenate([[True], own[1:] != own[:-1]])]  # of equal values the first
            v[p] = _TOP
            least.append(m)
            place.append(p)
        order = np.argsort(np.stack(place, 1), axis=1, kind="stable")
        kmers = np.take_along_axis(np.stack(least, 1), order, 1)
        h = np.full(len(n), _seed(2 * t + 2))
        for j in range(size):
            h = mix(h * three + kmers[:, j])
        out[:, t] = h
    return out
