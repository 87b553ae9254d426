"""SuperMinHash signatures of word-shingle sets, in NumPy.

An element draws, from its own hash, a random permutation of the registers and
one fraction per step.  At step ``j`` it offers ``j + fraction`` to the register
that its permutation holds at ``j``.  The ranks that one element offers are thus
spread over all registers, which lowers the variance of the estimate, and no step
above the largest register value can change anything, so steps end early.

Registers are unsigned 64-bit numbers: the step in the upper 8 bits, the fraction
in the lower 56.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the splitmix64 generator.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
BLOCK = 32_768  # elements at a time
SLICE = 300_000  # bytes of text hashed at a time, to stay in cache; one longer text goes alone

_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of unsigned 64-bit numbers."""
    x = x + GOLDEN
    x ^= x >> np.uint64(30)
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def _byte_table() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256, dtype=np.uint64)
    upper = (codes >= 65) & (codes <= 90)
    codes[upper] += np.uint64(32)  # A-Z count as a-z
    space = (np.arange(256) == 32) | ((np.arange(256) >= 9) & (np.arange(256) <= 13))
    values = splitmix(codes + np.uint64(1 << 20))
    values[space] = 0
    return values, space


BYTE_VALUE, IS_SPACE = _byte_table()


def _power(which: str, base: int, n: int) -> np.ndarray:
    if which in _powers and n <= len(_powers[which]):
        return _powers[which][:n]
    out = np.full(max(n, SLICE + 1), base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= SLICE + 1:  # those of one very long text are not kept
        _powers[which] = out
    return out[:n]


def up_powers(n: int) -> np.ndarray:
    return _power("up", _BASE, n)


def down_powers(n: int) -> np.ndarray:
    return _power("down", _INVERSE, n)


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash and the start of each word of ``blob``.

    A word is a run of bytes other than ASCII white space.  Its hash is a
    polynomial over random byte values, brought back to the word's own start and
    mixed, so that equal words have equal hashes wherever they stand.
    """
    raw = np.frombuffer(blob, np.uint8)
    space = IS_SPACE[raw]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate(([True], space[:-1]))) if len(raw) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sums = np.add.reduceat(BYTE_VALUE[raw] * up_powers(len(raw)), starts)
    return splitmix(sums * down_powers(len(raw))[starts]), starts


def _slices(texts: list[str | None]):
    part, size = [], 0
    for at, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if part and size + len(raw) > SLICE:
            yield part
            part, size = [], 0
        part.append((at, raw))
        size += len(raw) + 1
    if part:
        yield part


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each whole text, the sorted distinct 64-bit hashes of its word ``width``-grams.

    A-Z are lower-cased; words are runs of anything but ASCII white space.  Fewer
    than ``width`` words make one shingle; no words, or null, make none.
    """
    sets: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    for part in _slices(texts):
        hashes, starts = word_hashes(b"\n".join(raw for _, raw in part))
        sizes = np.fromiter((len(raw) + 1 for _, raw in part), np.int64, len(part))
        edges = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
        mixed = hashes
        grams = [hashes]
        for k in range(1, width):
            mixed = splitmix(mixed[: max(0, len(hashes) - k)]) + hashes[k:]
            grams.append(mixed)
        for (at, _), lo, hi in zip(part, edges[:-1], edges[1:], strict=True):
            n = min(width, hi - lo)
            if n:  # the width goes into the hash: a short text never equals a part of a longer one
                sets[at] = np.unique(splitmix(grams[n - 1][lo : hi - n + 1] ^ np.uint64(n)))
    return sets


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    return shingle_sets([text], width)[0]


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A row of ``m`` registers for each set; an empty set keeps ``EMPTY`` throughout."""
    assert 0 < m <= 255
    sig = np.full((len(sets), m), EMPTY, np.uint64)
    flat, top = sig.reshape(-1), np.full(len(sets), EMPTY, np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(-sizes, kind="stable")  # sets of like size need like numbers of steps
    if not sizes.sum():
        return sig
    elements, owner = np.concatenate([sets[i] for i in order]), np.repeat(order, sizes[order])
    first = np.arange(m, dtype=np.uint8)
    seeds = splitmix(np.arange(1, m + 1, dtype=np.uint64))
    for at in range(0, len(elements), BLOCK):
        h, doc = elements[at : at + BLOCK], owner[at : at + BLOCK]
        perm = np.empty((len(h), m), np.uint8)
        perm[:] = first
        cells, row = perm.reshape(-1), np.arange(len(h)) * m
        docs = np.unique(doc)
        for j in range(m):
            live = top[doc] >= np.uint64(j << 56)
            if not live.all():
                h, doc, row = h[live], doc[live], row[live]
                if not len(h):
                    break
                docs = docs[top[docs] >= np.uint64(j << 56)]
            draw = splitmix(h ^ seeds[j])
            pick = row + (((draw >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64) + j
            register = cells[pick]
            cells[pick] = cells[row + j]
            draw *= GOLDEN
            draw ^= draw >> np.uint64(32)
            np.minimum.at(flat, doc * m + register, np.uint64(j << 56) | (draw >> np.uint64(8)))
            top[docs] = sig[docs].max(axis=1)
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` registers; the band's number is part of the key."""
    bands = sig.shape[1] // rows
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    for k in range(rows):
        key = splitmix(key) ^ splitmix(parts[:, :, k].copy())
    return splitmix(key)
