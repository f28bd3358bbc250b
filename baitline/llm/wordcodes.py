"""Token ids of whole texts by a tokenizer file, each distinct pre-token encoded once per task.

For a byte-level tokenizer the texts are cut into pre-tokens here, and only
pre-tokens not met before go through the library's merges.  The cut uses the
same pattern as the library; for characters on which Unicode versions of the two
regular-expression engines may differ, a text goes to the library whole.  So do
texts with a special token's string, and every text of other kinds of tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: The pre-token pattern of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of Latin letters (to U+024F), in classes that the faster standard engine knows.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
NOT_LATIN = r"[^\x00-\u024f]"
#: Characters outside these blocks, assigned for long, are left to the library.
ODD = r"[^\x00-՗֐-ࢀऀ-௿‐- ₠-⯿　-ꀀ가-힣＀-￯]"
#: Pre-tokens a task remembers before it starts anew, and the longest of them.
REMEMBERED, LONGEST = 400_000, 200


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


def _little(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" and array("I").itemsize == 4 else np.array(ids, "<u4").tobytes()


class Coder:
    """Ids of texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, special: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        with open(path, encoding="utf-8") as lines:
            form = json.load(lines)
        cut = form.get("pre_tokenizer") or {}
        self.plain = (
            form.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
            and not cut.get("add_prefix_space") and not form["model"].get("ignore_merges")
        )
        self.added = [t["content"] for t in form.get("added_tokens", ()) if special or not t["special"]]
        self.merge = self.library.model.tokenize
        self.odd, self.not_latin = regex.compile(ODD).search, re.compile(NOT_LATIN).search
        self.split, self.split_latin = regex.compile(PATTERN).findall, re.compile(LATIN).findall
        self.letters = {b: letter for b, letter in enumerate(byte_letters())}
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        body = word.removeprefix(" ")
        if body.isascii() and body.isprintable() and " " not in body:  # these bytes stand for themselves
            shown = word.replace(" ", self.letters[32])
        else:
            shown = word.encode().decode("latin-1").translate(self.letters)
        ids = _little([token.id for token in self.merge(shown)])
        if len(word) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        latin = text.isascii() or not self.not_latin(text)
        if not self.plain or any(t in text for t in self.added) or not latin and self.odd(text):
            return _little(self.library.encode(text, add_special_tokens=False).ids)
        known, encode = self.known.get, self._word
        words = self.split_latin(text) if latin else self.split(text)
        return b"".join([known(w) or encode(w) for w in words])


@lru_cache(maxsize=2)
def coder(path: str, special: bool = True) -> Coder:
    """One coder per worker.  With ``special`` the strings of special tokens in a text become these tokens."""
    return Coder(path, special)
