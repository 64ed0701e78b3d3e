"""Encode texts word by word with a public tokenizer, remembering the words already encoded.

Such a tokenizer normalises a text, splits it by a pattern and merges inside each
piece alone, so the ids of a text are those of its pieces in order.  Most pieces
of a text have been seen before; they are looked up.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

#: Words remembered by one Python worker; beyond the bound words are encoded each time, so memory stays flat.
CACHED_WORDS = 400_000
#: White space, printable ASCII and Latin letters, on which the installed pattern engines agree about letters, digits
#: and case; a text with any other character goes to the tokenizer whole.
_UNSURE = "[^\t-\r\x20-\x7e\xa0-\u024f]"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


class _Words(dict):
    def __init__(self, model, mapped, limit: int):
        super().__init__()
        self.model, self.mapped, self.limit = model, mapped, limit

    def __missing__(self, word: str) -> bytes:
        inner = word if word.isascii() else self.mapped(word)[0][0]
        ids = array("I", [t.id for t in self.model.tokenize(inner)]).tobytes()
        if len(self) < self.limit:
            self[word] = ids
        return ids


class WordEncoder:
    """``encode(text)`` gives the ids as unsigned little-endian 32-bit integers in one byte string."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        kinds = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        first, *rest = (parts["pre_tokenizer"] or {}).get("pretokenizers", [None])
        self.by_word = kinds == _NORMALIZERS and first is not None and first["type"] == "Split" and first["invert"] and (
            [(s["type"], s.get("use_regex"), s.get("add_prefix_space")) for s in rest] == [("ByteLevel", False, False)]
        )
        if self.by_word:
            pattern = first["pattern"]["Regex"]
            plain = pattern.replace("[\\p{L}]", "[a-z]").replace("[\\p{N}]", "[0-9]").replace("\\p{L}\\p{N}", "a-z0-9")
            self.words, self.ascii_words = regex.compile(pattern).findall, re.compile(plain, re.ASCII).findall
            self.unsafe = re.compile(_UNSURE).search
            mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            self.known = _Words(self.tokenizer.model, mapped, cached_words)

    def encode(self, text: str) -> bytes:
        if not self.by_word or self.unsafe(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if text.isascii():
            words = self.ascii_words(text.lower())
        else:
            words = self.words(unicodedata.normalize("NFC", text).lower())
        return b"".join(map(self.known.__getitem__, words))
