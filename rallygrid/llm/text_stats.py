"""Counts of whole texts: words, characters, repeated lines and repeated word windows."""

from __future__ import annotations


import numpy as np

from .superminhash import IS_SPACE, down_powers, splitmix, up_powers

#: The characters counted as symbols, and the window of repeated words.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

_PLAIN = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 21))
_PLAIN[IS_SPACE] = 0

#: Column of each count in the rows of ``counts``.
NAMES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_distinct",
    "n_top", "n_upper", "n_lower", "n_digits", "n_marks", "n_wide", "n_twins", "n_ended",
]
AT = {name: k for k, name in enumerate(NAMES)}
_CODES = np.arange(256)
_CLASSES = np.stack(
    [
        np.isin(_CODES, [ord(c) for c in SYMBOLS]),
        (_CODES >= 65) & (_CODES <= 90),
        (_CODES >= 97) & (_CODES <= 122),
        (_CODES >= 48) & (_CODES <= 57),
        np.isin(_CODES, [ord(c) for c in "!?"]),
        _CODES >= 192,  # a byte that begins a character beyond ASCII
        IS_SPACE,
        (_CODES < 128) | (_CODES >= 192),  # a byte that begins a character
    ],
    axis=1,
).astype(np.int64)


def _plain_hashes(raw: np.ndarray) -> np.ndarray:
    space = IS_SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = up_powers(len(raw)), down_powers(len(raw))
    return splitmix(np.add.reduceat(_PLAIN[raw] * up, starts) * down[starts])


def _repeated(hashes: np.ndarray, window: int) -> int:
    """Words that lie in a window of ``window`` words which the text holds twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    mixed = hashes[:n].copy()
    for k in range(1, window):
        mixed = splitmix(mixed) + hashes[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def counts(text: str | None) -> np.ndarray:
    """The counts of one whole text, in the order of ``NAMES``; null counts as empty.

    Words are runs of anything but ASCII white space, lines are split at line feeds.
    ``n_dup_lines`` counts lines with a word that equal an earlier line,
    ``n_repeat_words`` words in 8-word windows found twice or more, ``n_top`` the
    commonest word, ``n_twins`` words equal to the one before, ``n_ended`` lines
    that end in a full stop, question mark or exclamation mark.
    """
    out = np.zeros(len(NAMES), np.int64)
    text = text or ""
    blob = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(blob, np.uint8)
    symbols, upper, lower, digits, marks, wide, space, points = np.bincount(raw, minlength=256) @ _CLASSES
    hashes = _plain_hashes(raw)
    lines = blob.split(b"\n")
    seen: set[bytes] = set()
    dup = ended = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
        ended += line.endswith((b".", b"!", b"?"))
    distinct, top, twins = 0, 0, 0
    if len(hashes):
        ordered = np.sort(hashes)
        cuts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
        distinct, top = len(cuts) - 1, int(np.diff(cuts).max())
        twins = int(np.count_nonzero(hashes[1:] == hashes[:-1]))
    out[:] = (
        len(hashes), points - space, symbols, dup, _repeated(hashes, WINDOW), len(lines), points, distinct,
        top, upper, lower, digits, marks, wide, twins, ended,
    )
    return out


def count_rows(texts: list[str | None]) -> np.ndarray:
    return np.stack([counts(t) for t in texts]) if texts else np.empty((0, len(NAMES)), np.int64)
