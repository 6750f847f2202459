"""Anchors of a text: positions that equal stretches of bytes choose alike.

Every 400-byte string gets one anchor, the position of the smallest hash of
eight bytes in its middle part (the leftmost of equals). Equal strings have
their anchors at the same offset, so comparing the surroundings of anchors
finds every repeated string, with about one suffix in a hundred.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix, powers

#: Bytes that are hashed together.
BLOCK = 1 << 20


def anchors(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, length: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, position in ``flat`` and hash of the surroundings of every anchor.

    ``flat`` holds the texts at ``starts``. The anchor of the string at p is in
    [p + margin, p + length - margin); its surroundings reach ``margin`` bytes
    to both sides and so lie within the string.
    """
    n = len(flat)
    window = length - 2 * margin
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    grams = np.zeros(n, np.uint64)
    for k in range(8):
        grams |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    # 40 bits of hash above 24 bits of position: minima fall on the leftmost
    low = (mix(grams) & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < window:
        step = min(width, window - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    owner_of = np.repeat(np.arange(len(lens)), np.maximum(lens - length + 1, 0))
    first = np.cumsum(np.maximum(lens - length + 1, 0)) - np.maximum(lens - length + 1, 0)
    p = starts[owner_of] + np.arange(len(owner_of)) - first[owner_of]
    at = (low[p + margin] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.r_[True, (at[1:] != at[:-1]) | (owner_of[1:] != owner_of[:-1])] if len(at) else np.zeros(0, bool)
    at, owner = at[new], owner_of[new]
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        around = mix((total[at + margin] - total[at - margin]) * down[at - margin])
    return owner, at, around.view(np.int64)
