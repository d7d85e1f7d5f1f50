"""Ids of whole texts by the tokenizers library, with each distinct word encoded once.

Byte-level BPE never merges across its pre-tokens, so a text's ids are its pre-tokens' ids one after another. Texts made of
plain Latin-1 characters are split here by the tokenizer's own splitting rule and each distinct pre-token goes to the library
once per worker; any other text goes to the library whole. Both ways give the same ids (tests compare them).
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
DIGITS = "0-9²³¹¼½¾"
#: Any character outside tab, line ends, printable ASCII and printable Latin-1.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xff]")
#: How the two tokenizers split a text (their pre-tokenizers' patterns, over Latin-1).
SPLITS = {
    "byte": re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+"),
}
#: The normalisers and pre-tokenisers, as tokenizer files state them, that split like that; any other file's texts go to the library whole.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
KNOWN = {
    "byte": (None, _BYTE_LEVEL | {"use_regex": True}),
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]},
    ),
}
#: Distinct pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 400_000


class WordEncoder:
    """kind: "byte" (case kept) or "word" (lower case, white space dropped)."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.folded = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.normalized]
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        plain = stated["model"].get("dropout") is None and not stated.get("truncation") and not stated.get("padding")
        #: Whether this file splits as ``kind`` does, so that words may be encoded one by one.
        self.by_words = plain and (stated["normalizer"], stated["pre_tokenizer"]) == KNOWN[kind]
        self.split, self.lower, self.known = SPLITS[kind].findall, kind == "word", {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(i)}I", *i) for i in (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))]

    def _whole(self, text: str) -> bool:
        """Whether the library must see the text as it is: its added tokens are found before the text is split."""
        return not self.by_words or bool(OTHER.search(text)) or any(t in text for t in self.added) or bool(self.folded) and any(t in text.lower() for t in self.folded)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        whole = [i for i, t in enumerate(texts) if self._whole(t)]
        out: list = [None] * len(texts)
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = ids
        plain = [i for i, x in enumerate(out) if x is None]
        words = [self.split(texts[i].lower() if self.lower else texts[i]) for i in plain]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set().union(*words).difference(self.known)) if words else []
        self.known.update(zip(new, self._library(new)))
        get = self.known.__getitem__
        for i, w in zip(plain, words):
            out[i] = b"".join(map(get, w))
        return out


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> WordEncoder:
    """One per worker process; what it remembers lasts from task to task."""
    return WordEncoder(path, kind)
