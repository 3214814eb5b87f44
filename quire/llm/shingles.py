"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9DDFEA08EB382D69)
_ODD = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xE7037ED1A0B428DB)
        return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes that are no ASCII white space), and how many each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), per_text
    letters = data[inside].astype(np.uint64) + np.uint64(1)
    before = np.cumsum(inside) - 1
    first = before[starts]
    lengths = np.diff(first, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(lengths.max()) - 1, _BASE))), dtype=np.uint64)
        sums = np.add.reduceat(letters * powers[place], first)
        return mixed(sums + lengths.astype(np.uint64) * _ODD[2]), per_text


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct n-word shingle hashes; fewer words are one shingle, none an empty array."""
    words, counts = word_hashes(texts)
    with np.errstate(over="ignore"):
        odd = _ODD[np.arange(n) % 8] + np.arange(n, dtype=np.uint64) // np.uint64(8) * np.uint64(2)
        full = len(words) - n + 1
        runs = np.zeros(max(full, 0), np.uint64)
        for i in range(n if full > 0 else 0):
            runs += words[i : i + full] * odd[i]
        runs = mixed(runs)
        at = 0
        for c in counts:
            if c >= n:
                yield np.unique(runs[at : at + c - n + 1])
            elif c:
                yield mixed((words[at : at + c] * odd[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c) * _ODD[7])
            else:
                yield words[:0]
            at += c


def in_chunks(batches: Iterator, column: str = "text", most: int = 1 << 22) -> Iterator[tuple[dict[str, list], list[bytes]]]:
    """Arrow batches cut into runs of rows with about `most` bytes of text; null texts are empty."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).cast("binary").to_pylist()]
        rest = {name: batch.column(name).to_pylist() for name in batch.schema.names if name != column}
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= most or i == len(texts) - 1:
                yield {k: v[at : i + 1] for k, v in rest.items()}, texts[at : i + 1]
                at, size = i + 1, 0
