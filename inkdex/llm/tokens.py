"""Token ids of the word-level vocabulary, by way of a memo of words.

White space never joins tokens in this vocabulary, so a text's ids are those of
its white-space-separated words, one after another.  Each worker keeps the ids
of the words that it has met.

Ids are those of the library as it reads the file: the strings of the special
tokens (``<|startoftext|>``, ``<|endoftext|>``) in a text become those tokens, whether
others are added or not.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import regex
import tiktoken

MEMO_WORDS = 150_000
_END = b"\xff"  # stands for the end-of-word mark; never occurs in UTF-8
_memo: dict[str, "WordMemo"] = {}


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, back to bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """A memo of at most twice ``limit`` entries: when the young half is full, it becomes the old half."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordMemo(Memo):
    """Word (bytes without ASCII white space) to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__(MEMO_WORDS)
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.special = {t["content"].encode(): struct.pack("<I", t["id"]) for t in whole["added_tokens"]}
        self.cut = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        back = _byte_of()
        ranks = {}
        for token, i in model["vocab"].items():
            end = token.endswith("</w>")
            raw = bytes(back[c] for c in (token[:-4] if end else token))
            ranks[raw + _END if end else raw] = i
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.plain = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")  # for ASCII
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.beyond = regex.compile("[^\x00-ɏ]")

    def make(self, word: bytes) -> bytes:
        encode = self.core.encode_single_piece
        if word.isascii():
            low = word.lower()
            if low.isalpha():
                ids = encode(low + _END)
            else:
                ids = [i for p in self.plain.findall(low) for i in encode(p + _END)]
        else:
            text = word.decode("utf-8", "replace")
            if self.beyond.search(text):  # outside the Latin blocks: leave normal forms and case to the library
                ids = self.slow.encode(text, add_special_tokens=False).ids
            else:
                text = unicodedata.normalize("NFC", text).lower()
                ids = [i for p in self.split.findall(text) for i in encode(p.encode() + _END)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: bytes) -> bytes:
        if self.cut and any(t in text for t in self.special):
            return b"".join(self.special.get(p) or b"".join(map(self.__getitem__, p.split())) for p in self.cut.split(text))
        return b"".join(map(self.__getitem__, text.split()))


def words(path: str) -> WordMemo:
    """This process's memo for the vocabulary file."""
    if path not in _memo:
        _memo[path] = WordMemo(path)
    return _memo[path]
