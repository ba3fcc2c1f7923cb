"""Sets of word shingles: their hashes, min-hash bands, fingerprints and similarities, in numpy.

Words are split at ASCII white space and lower-cased in ASCII. Texts of fewer than WIDTH words have one shingle of all of
them; null and empty texts have the empty set, and two empty sets count as alike. Each of BANDS bands has ROWS min-hashes.
"""

from __future__ import annotations

import numpy as np

from .common import _LOWER, _SPACE, U64, mix, run_hashes, runs

WIDTH, LEAST = 5, 0.8
BANDS, ROWS, GROUP = 32, 5, 256
_RANDOM = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS + 64), dtype=U64) | U64(1)


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and each row's range of them."""
    starts, bounds = runs(~_SPACE[raw], offsets)
    word = run_hashes(_LOWER[raw] * ~_SPACE[raw], starts)
    number = np.diff(bounds)
    at, last = np.arange(len(word)), np.repeat(bounds[1:], number)
    out = np.zeros(len(word), U64)
    for k in range(min(width, len(word))):
        rest = len(word) - k
        out[:rest] += np.where(at[:rest] + k < last[:rest], word[k:] * _RANDOM[0, -1 - k], U64(0))
    whole = (at + width <= last) | ((at == np.repeat(bounds[:-1], number)) & np.repeat(number < width, number))
    return mix(out[whole]), np.concatenate([[0], np.cumsum(whole)])[bounds]


def band_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BANDS keys of each row."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(bounds) - 1, BANDS), U64)
    out[:] = np.arange(BANDS, dtype=U64)
    if len(full):
        for band in range(BANDS):
            key = np.full(len(full), band + 1, U64)
            for j in range(band * ROWS, (band + 1) * ROWS):
                key = mix(key ^ np.minimum.reduceat((hashes ^ _RANDOM[1, j]) * _RANDOM[0, j], bounds[full]))
            out[full, band] = key
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row's shingles, and each row's range of them."""
    hashes, bounds = shingles(raw, offsets, width)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])) if len(hashes) else np.zeros(0, bool)
    return hashes[new], np.searchsorted(row[new], np.arange(len(bounds)))


def set_fingerprints(hashes: np.ndarray, bounds: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """A bit is set where over half of the row's hashes have it; zero for an empty row."""
    count = np.zeros((len(bounds) - 1, 64), np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for a in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[a : a + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.append(True, row[a + 1 : a + len(bits)] != row[a : a + len(bits) - 1]))
        count[row[a + first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * count > np.diff(bounds)[:, None], axis=1).view(">u8").ravel().astype(U64)


def joined_by_similarity(sets: list[np.ndarray], fp: np.ndarray, least: float = LEAST, radius: int = 64) -> list[tuple[int, int]]:
    """A tree of links for each component of the sets of distinct hashes; only fingerprints within the radius are looked at."""
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    code = [codes[e - n : e] for e, n in zip(ends, size, strict=True)]
    own, out, left = np.zeros(len(codes) + 1, bool), [], np.arange(len(sets))
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            fit = np.flatnonzero((np.minimum(size[left], size[i]) >= least * np.maximum(size[left], size[i])) & (np.bitwise_count(fp[left] ^ fp[i]) <= radius))
            if not len(fit):
                continue
            own[code[i]] = True
            shared = np.array([np.count_nonzero(own[code[j]]) for j in left[fit]])
            own[code[i]] = False
            union = size[left[fit]] + size[i] - shared
            # in whole numbers: 4 of 5 are 0.8
            near = fit[shared * 1_000_000 >= round(least * 1_000_000) * union]
            out += [(i, int(j)) for j in left[near]]
            todo += [int(j) for j in left[near]]
            left = np.delete(left, near)
    return out
