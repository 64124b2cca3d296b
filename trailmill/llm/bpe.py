"""Byte-pair tokenizers read from a file: pre-token patterns, offline proof of whole tokens, merges.

The patterns agree with the ``tokenizers`` library on every code point but those in ``RARE``; texts that hold
one of these, or the string of a special token, go to the library as a whole.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import regex

# The pre-token patterns of the two files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Code points whose class or lower case differs between Unicode versions, libraries or with their neighbours.
RARE = regex.compile(
    r"[\x1c-\x1fΣ՘֋֌࢏౜೜Ᲊ₏₝-₟Ɤ-ꟿ꭬꭭\U00010000-\U0010ffff]"
)


def is_plain(text: str, specials: list[str]) -> bool:
    """Whether the patterns hold for the text: nothing rare in it and no special token."""
    if any(s in text for s in (*specials, "\x1c", "\x1d", "\x1e", "\x1f", "Σ")):
        return False
    if text.isascii() or np.frombuffer(text.encode("utf-32-le"), "<u4").max() < 0x558:  # the least other rare one
        return True
    return not RARE.search(text)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE model: ranks of its merges, and which strings are whole tokens."""

    def __init__(self, spec: str) -> None:
        self.spec = spec
        self.specials = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.chars = byte_chars()
        self.spelling = dict(enumerate(self.chars))

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        """Read when first asked for: who merges by the library doesn't hold them."""
        return {tuple(pair): i for i, pair in enumerate(json.loads(self.spec)["model"]["merges"])}

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec)

    def merge(self, pieces: list[str]) -> list[str]:
        """Apply the merge of lowest rank, the leftmost first, until none applies.

        The pieces are a linked list, and the pairs that can merge wait in a heap; a pair that has changed meanwhile is
        passed over. So the work grows with the length times its logarithm.
        """
        ranks, n = self.ranks, len(pieces)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        held: list[str | None] = list(pieces)
        heap = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(pieces, pieces[1:])) if pair in ranks]
        heapify(heap)
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if held[i] != left or j >= n or held[j] != right:
                continue
            held[i], held[j], after[i] = left + right, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (rank := ranks.get((held[x], held[y]))) is not None:
                    heappush(heap, (rank, x, held[x], held[y]))
        return [p for p in held if p is not None]

    def spelled(self, pre_token: str) -> str:
        return pre_token.encode().decode("latin-1").translate(self.spelling)

    def whole_tokens(self) -> list[str]:
        """The vocabulary's strings, as text, that merge into exactly one token: the proof is the merge itself."""
        of_char = {c: b for b, c in enumerate(self.chars)}
        found = []
        for entry in json.loads(self.spec)["model"]["vocab"]:
            try:
                text = bytes(of_char[c] for c in entry).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # a special token, or part of a character: never a whole pre-token
            if self.merge(list(entry)) == [entry]:
                found.append(text)
        return found


class TokenCounter(dict):
    """pre-token -> number of tokens. Proven whole tokens are there from the start; the rest is merged when met."""

    LIMIT = 300_000

    def __init__(self, spec: str, whole: list[str]) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.bpe, self.find = ByteBpe(spec), regex.compile(BYTE_PATTERN).findall
        self.whole = whole

    def __missing__(self, pre_token: str) -> int:
        if len(self) >= self.LIMIT + len(self.whole):
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = len(self.bpe.merge(list(self.bpe.spelled(pre_token))))
        if len(pre_token) < 40:
            self[pre_token] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not is_plain(text, self.bpe.specials):
            return len(self.bpe.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, self.find(text)))


class WordIds(dict):
    """chunk of normalised text between white space -> its ids as little-endian 32-bit numbers, for a tokenizer with
    word ends. No pre-token spans white space, so a chunk's ids don't depend on its neighbours."""

    LIMIT = 300_000

    def __init__(self, spec: str) -> None:
        super().__init__()
        self.bpe, self.find = ByteBpe(spec), regex.compile(WORD_PATTERN).findall
        self.numbers = [i.to_bytes(4, "little") for i in range(self.bpe.library.get_vocab_size(with_added_tokens=True))]
        self.merged = self.bpe.library.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        if chunk.isascii() and chunk.isalpha():  # one pre-token, spelled as it is
            found = self.merged(chunk)
        else:
            found = [t for p in self.find(chunk) for t in self.merged(self.bpe.spelled(p))]
        ids = b"".join([self.numbers[t.id] for t in found])
        if len(chunk) < 40:
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not is_plain(text, self.bpe.specials):
            ids = self.bpe.library.encode(text, add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return b"".join(map(self.__getitem__, text.lower().split()))
