"""Words of Arrow batches as flat numpy arrays, and rolling hashes over them.

A word is a run of bytes other than space and \\x09-\\x0D, which is what
``bytes.split()`` yields. A batch's words are laid end to end; ``ends`` says
where each text ends, so windows that would cross a text are masked out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def flat(texts: list[bytes | None], lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts, and the number of words of each. Null: no words."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            w = (t.lower() if lower else t).split()
            counts[i] = len(w)
            words += w
    return words, counts


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a column of texts, the place of each word among them, and the
    number of words of each text: what ``flat`` yields, with Python objects for distinct words alone."""
    if not pa.types.is_string(texts.type):
        texts = texts.view(pa.string()) if pa.types.is_binary(texts.type) else texts.cast(pa.string())
    split = pc.ascii_split_whitespace(texts)
    counts, words = pc.list_value_length(split).fill_null(0).to_numpy().astype(np.int64), split.flatten()
    said = pc.binary_length(words).to_numpy() > 0  # white space at an end, or nothing else, leaves an empty word
    if not said.all():
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[said], minlength=len(counts))
        words = words.filter(pa.array(said))
    got = words.dictionary_encode()
    return got.dictionary, got.indices.to_numpy(), counts


def sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text. Null: none."""
    return pc.binary_length(texts).fill_null(0).to_numpy()


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, past the last) of runs of rows whose sizes add up to at most ``most``; a larger row stands alone."""
    total, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(total):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values, order-sensitive: entry i is for h[i:i+k]."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers_to(n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def window_starts(counts: np.ndarray, k: int) -> np.ndarray:
    """Flat positions at which a run of k words lies within one text."""
    keep = counts >= k
    n, first = counts[keep] - k + 1, starts_of(counts)[keep]
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
