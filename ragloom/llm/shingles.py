"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes of text that are hashed together.
BLOCK = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: Words are separated by the space and the five control characters from tab to return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the multiplier and of its inverse, modulo 2^64."""
    if 0 not in _tables or len(_tables[0][0]) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _MULTIPLIER, np.uint64), np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            _tables[0] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _tables[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that similar inputs spread evenly."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[flat]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(flat) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=total[1:])
        hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, bounds), prepend=0)


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; A-Z count as a-z.

    A text with fewer words than ``size`` has its whole sequence as the only
    shingle; a text without words, or null, has none.
    """
    out: list[np.ndarray] = []
    block: list[bytes] = []
    total = 0
    for text in [*texts, None]:
        last = text is None and len(out) + len(block) == len(texts)
        if not last:
            block.append((text or "").encode("utf-8", "replace").lower())
            total += len(block[-1]) + 1
        if block and (last or total >= BLOCK):
            words, counts = word_hashes(block)
            at = 0
            with np.errstate(over="ignore"):
                salted = [mix(words + np.uint64(k + 1)) for k in range(size)]
                for n in counts.tolist():
                    take = min(n, size)
                    m = n - take + 1 if n else 0
                    h = np.full(m, take, np.uint64)
                    for k in range(take):
                        h += salted[k][at + k : at + k + m]
                    out.append(np.unique(mix(h)))
                    at += n
            block, total = [], 0
    return out
