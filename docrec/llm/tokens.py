"""Byte-level BPE token ids of whole texts, one bytes object of little-endian 32-bit ids for each text.

The vocabulary is read from a tokenizer file of the ``tokenizers`` library and its ids are the result. Words repeat, so
ids are looked up in a bounded cache of words; only new words are encoded. Texts with characters whose class could be
read differently go to the tokenizer itself, whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: The split pattern of byte-level BPE, as published with that vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for the characters of PLAIN, for the faster standard library.
SPLIT_PLAIN = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧₠-₿]")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Of PLAIN, all but white space other than space and line end, and control characters.
NOT_SIMPLE = re.compile("[^\n\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧₠-₿]")
CACHED_WORDS = 500_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Words(dict):
    """Ids of words, encoded when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        value = self[word] = self.encode(word)
        return value


class Ids:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, self.added = byte_symbols(), [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        self.encode = encode = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split, self.split_plain = regex.compile(SPLIT).findall, re.compile(SPLIT_PLAIN).findall
        self.word = Words(lambda w: array("I", encode(w)).tobytes())
        self.mark = {c: self.word[c] for c in ".,;:!?"}
        self.opens = np.zeros(max(ranks.values()) + 1, bool)  # ids that begin with a space or a line end
        self.opens[[i for token, i in ranks.items() if token[:1] in b" \n"]] = True
        self.chunk: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        for cache in (self.word, self.chunk):
            if len(cache) > CACHED_WORDS:
                cache.clear()
        if any(t in text for t in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if NOT_SIMPLE.search(text) or not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", " \n", "\n ")):
            if SEPARATORS.search(text):
                return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            return b"".join(map(self.word.__getitem__, (self.split if NOT_PLAIN.search(text) else self.split_plain)(text)))
        # single spaces and line ends only: chunks, each with the space or line end before it, do not touch each other
        head, *keys = text.replace("\n", " \n").split(" ")
        return b"".join([*map(self.word.__getitem__, self.split_plain(head)), *self._chunks(keys)])

    def forget(self) -> None:
        """Give the memory of both caches back: a worker process goes on to tasks of other kinds, which need no words."""
        self.word.clear(), self.chunk.clear()
        self.mark = {c: self.word[c] for c in self.mark}

    def _chunks(self, keys: list[str]) -> list[bytes]:
        """Ids of all chunks; those not seen before are encoded in one go and told apart by the space or line end that opens each."""
        get, mark = self.chunk.get, self.mark
        values = list(map(get, keys))
        new = []
        for i, value in enumerate(values):
            if value is None:
                key = keys[i]
                if key[-1] in mark and (value := get(key[:-1])):
                    values[i] = value + mark[key[-1]]
                else:
                    new.append(i)
        if new:
            ids_ = array("I", self.encode("".join([k if k[0] == "\n" else f" {k}" for k in map(keys.__getitem__, new)])))
            at = (4 * np.flatnonzero(self.opens[np.frombuffer(ids_, np.uint32)])).tolist()
            if len(at) != len(new):
                raise ValueError("chunks and their ids do not match")
            data = ids_.tobytes()
            for i, a, b in zip(new, at, [*at[1:], len(data)]):
                values[i], key = data[a:b], keys[i]
                if key.isalpha():
                    self.chunk[key] = data[a:b]
                elif key[-1] in mark and key[:-1].isalpha():
                    self.chunk[key[:-1]] = data[a : b - 4]
        return values


@lru_cache(maxsize=2)
def ids(path: str | None) -> Ids:
    """One for each worker process. Without a path, the public 50k byte-level vocabulary installed on the executors."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Ids(path)
