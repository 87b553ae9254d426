"""Byte-level BPE encoding of whole texts, a remembered word at a time."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space before anything but white space always begins a match of the pattern, so
#: a text can be cut there and its parts encoded apart.
WORDS = re.compile(r" (?=\S)")
REMEMBERED, LONGEST = 100_000, 64


class Memo(dict):
    """What ``encode`` gives for each word, of at most twice ``most`` words.

    When it holds ``most`` words they become the older ones, in place of those before
    them.  An older word that comes again is taken over, so frequent words stay
    however many rare ones pass.
    """

    def __init__(self, encode, most: int = REMEMBERED):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, word: str):
        code = self.older.get(word)
        if code is None:
            code = self.encode(word)
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = code
        return code


class WordEncoder:
    """Encode texts to little-endian unsigned 32-bit ids."""

    def __init__(self, encode):
        self._one = lambda text: array("I", encode(text)).tobytes()
        self._memo = Memo(lambda word: self._one(" " + word))

    def encode(self, text: str) -> bytes:
        first, *rest = WORDS.split(text)
        return self._one(first) + b"".join(map(self._memo.__getitem__, rest))

    @staticmethod
    @lru_cache(maxsize=4)
    def of_json(path: str) -> WordEncoder:
        """The encoder of a tokenizers JSON file; kept by each worker.

        Where the file is a byte-level BPE whose merges rank as their ids do, the
        words go through the quicker rank encoder, which gives the same ids; any
        other file goes through the tokenizers library, text by text.
        """
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ranks = _ranks(spec)
        if ranks:
            return WordEncoder(tiktoken.Encoding("json", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return TextEncoder(lambda text: tokenizer.encode(text, add_special_tokens=False).ids)


class TextEncoder(WordEncoder):
    """For vocabularies whose texts may not be cut at spaces."""

    def encode(self, text: str) -> bytes:
        return self._one(text)


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings and ranks of a byte-level BPE; None if its merges don't rank as its ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("ignore_merges"):
        return None
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    letters = _letters()
    special = {x["content"] for x in spec.get("added_tokens", [])}
    words = {w: i for w, i in model["vocab"].items() if w not in special}
    if None in merged or merged != sorted(merged) or len(words) != len(merged) + 256 or not all(c in letters for w in words for c in w):
        return None
    return {bytes(letters[c] for c in w): i for w, i in words.items()}
