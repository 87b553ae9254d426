"""Byte-level BPE by dynamic programming over prefixes.

Each byte prefix of a split match has one valid last token: the one that ends the
prefix's BPE encoding.  A token ``t`` that ends the prefix of ``j`` bytes is that one
if it is an encoding by itself and the pair of the last token of the shorter prefix
and ``t`` is left alone by the merges.  The table of last tokens holds the encodings
of all prefixes, so appending bytes is exact, and after an edit only the entries near
it change.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import ahocorasick
import regex

from .tokens import WORDS, Memo

NONE = 1 << 62
#: Bounds of what a worker remembers: pairs of tokens, and of each of its two memos half
#: the words; at some 130 and 250 bytes an entry, 65 and 300 MB.
PAIRS, REMEMBERED = 500_000, 300_000


class Vocabulary:
    """A rank vocabulary: byte strings and their ranks, which are the ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self._sizes = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern).findall
        self.decimal = {i: b"%d" % i for i in self.bytes}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._ends = ahocorasick.Automaton()  # finds all tokens that end at each byte
        for raw, token in ranks.items():
            if self.halves(token):
                self._ends.add_word(raw.decode("latin-1"), (token, len(raw)))
        self._ends.make_automaton()
        self._matches = Memo(self.match, REMEMBERED)
        self._memo = Memo(lambda word: self._words(" " + word), REMEMBERED)

    @staticmethod
    @lru_cache(maxsize=4)
    def of_file(path: str, pattern: str) -> Vocabulary:
        """The vocabulary of a file of base64 byte strings and ranks; kept by each worker."""
        with open(path, "rb") as file:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, file))}, pattern)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; None if the merges never give it.

        A single byte is its own halves.
        """
        if token not in self._halves:
            raw = self.bytes[token]
            self._halves[token] = (token, token) if len(raw) == 1 else self._last_merge(raw)
        return self._halves[token]

    def _last_merge(self, raw: bytes) -> tuple[int, int] | None:
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], NONE), k) for k in range(len(parts) - 1))
            if rank == NONE:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if all(p in self.ranks for p in parts) else None

    def stays(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` apart when they stand side by side.

        The merges that made the two are undone from the latest, and at each point it
        is seen whether the tokens at the seam would have merged before it.
        """
        a, b, limit = left, right, NONE
        while True:
            if self.ranks.get(self.bytes[a] + self.bytes[b], NONE) < limit:
                return False
            single_a, single_b = len(self.bytes[a]) == 1, len(self.bytes[b]) == 1
            if single_a and single_b:
                return True
            if single_b or not single_a and a > b:
                # the left token was made later; a merge at the seam of equal rank would have come after it
                limit, a = a, self.halves(a)[1]
            else:
                # the right token was made later; at equal rank the merge at the seam, further left, comes first
                limit, b = b + 1, self.halves(b)[0]

    def extend(self, last: list[int], raw: bytes, upto: int | None = None) -> None:
        """Add to ``last``, the last token of each prefix of ``raw`` so far, those up to ``upto``."""
        pairs, n = self._pairs, len(last)
        upto = len(raw) if upto is None else upto
        back = max(0, n - self.longest)
        known, add = pairs.get, last.append
        for end, (token, size) in self._ends.iter(raw[back:upto].decode("latin-1")):
            if end + back < n:
                continue
            before = end + back - size
            if before >= 0:
                ok = known(key := last[before] << 32 | token)
                if ok is None:
                    ok = pairs[key] = self.stays(last[before], token)
                if not ok:
                    continue
            add(token)
            n += 1
        if n != upto:
            raise ValueError("a byte of the text is not in the vocabulary")
        if len(pairs) > PAIRS:
            pairs.clear()

    def walk(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens holds for its longest prefix."""
        out, j, size = [], len(last) - 1, self._sizes
        while j >= 0:
            out.append(token := last[j])
            j -= size[token]
        return out[::-1]

    def match(self, text: str) -> tuple[int, ...]:
        """The ids of one split match; a match that is a token is that token."""
        raw = text.encode()
        if (whole := self.ranks.get(raw)) is not None:
            return (whole,)
        last: list[int] = []
        self.extend(last, raw)
        return tuple(self.walk(last))

    def _words(self, text: str) -> tuple[int, ...]:
        parts = self.split(text)
        return self._matches[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable(map(self._matches.__getitem__, parts)))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        first, *rest = WORDS.split(text)
        return [*self._words(first), *chain.from_iterable(map(self._memo.__getitem__, rest))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class PrefixTable:
    """One split match under edits: the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last, self.computed = vocabulary, b"", [], 0
        self.append(raw)

    def append(self, raw: bytes) -> None:
        """Add bytes at the end; no entry so far changes."""
        self.raw += raw
        self.computed += len(raw)
        self.vocabulary.extend(self.last, self.raw)

    def replace(self, start: int, end: int, raw: bytes) -> None:
        """Put ``raw`` in place of bytes ``start`` to ``end``.

        Entries are computed anew from ``start`` until as many entries after the edit
        as the longest token has bytes are what they were; what follows can't differ.
        """
        old, tail = self.last, len(self.raw) - end
        self.raw = self.raw[:start] + raw + self.raw[end:]
        self.last, same = old[:start], 0
        while len(self.last) < len(self.raw):
            j = len(self.last) + 1
            self.vocabulary.extend(self.last, self.raw, j)
            self.computed += 1
            back = len(self.raw) - j  # bytes after this prefix
            same = same + 1 if back < tail and self.last[-1] == old[len(old) - 1 - back] else 0
            if same >= self.vocabulary.longest:
                self.last += old[len(old) - back :] if back else []
                break

    def encode(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.raw)
        return [whole] if whole is not None else self.vocabulary.walk(self.last)
