"""Encoding of texts by a public tokenizer file, through caches of their parts.

For a tokenizer that lowers case, drops white space and never joins over it, the ids of a text
are those of its blank-delimited parts in order, and those of a part are the ids of its
pre-tokens. Each worker keeps both kinds it met; only new pre-tokens go to the library. A text
with characters outside a plain set, or with one of the tokenizer's special strings, goes to
the library whole, as does every text for tokenizers of another build.
"""

from __future__ import annotations

import json
import os
import re
import struct

#: Characters whose lower case, normal form and blanks are the same in Python and the library.
_OTHER = re.compile("[^\t\n\r -~ -ɏ‐-‧‰-⁞€]")
#: Longer parts are encoded but not kept.
_LONGEST_KEPT = 64


def _byte_letters() -> dict[int, str]:
    """The usual letters for bytes: printable Latin-1 stands for itself, others follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Kept(dict):
    """A cache that makes what it misses and keeps it if the key is short."""

    def __init__(self, make, seed: dict | None = None):
        super().__init__(seed or {})
        self.make = make

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= _LONGEST_KEPT:
            self[key] = value
        return value


class PretokenEncoder:
    """Values of texts: ``of_ids`` of a list of ids, put together by ``join``.

    ``of_ids`` and ``join`` are ``len`` and ``sum`` to count, or a packing into bytes and
    ``b"".join``. ``frequent`` seeds the cache of parts and is never forgotten; of other parts
    and of pre-tokens at most ``limit`` each are kept between texts. The caches only save time.
    """

    def __init__(self, path: str, of_ids, join, frequent: dict | None = None, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.special = [t["content"] for t in config.get("added_tokens") or []]
        self.pattern = _splitting_pattern(config)
        self.find = regex.compile(self.pattern).findall if self.pattern else None
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.model = self.tokenizer.model
        self.of_ids, self.join, self.limit = of_ids, join, limit
        self.frequent = frequent or {}
        self.words = _Kept(self._word)
        self.parts = _Kept(self._part, self.frequent)

    def plain(self, text: str) -> bool:
        """Whether ``text`` may be encoded part by part."""
        return (
            self.pattern is not None
            and not _OTHER.search(text)
            and not any(s in text for s in self.special)
        )

    def value(self, text: str):
        if not self.plain(text):
            return self.of_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.words) > self.limit:
            self.words.clear()
        if len(self.parts) > self.limit + len(self.frequent):
            self.parts.clear()
            self.parts.update(self.frequent)
        return self.join(map(self.parts.__getitem__, text.lower().split()))

    def _part(self, part: str):
        return self.join(map(self.words.__getitem__, self.find(part)))

    def _word(self, word: str):
        spelled = word.encode().decode("latin-1").translate(self.letters)
        return self.of_ids([t.id for t in self.model.tokenize(spelled)])


_encoders: dict[tuple, PretokenEncoder] = {}


def counting_encoder(path: str, frequent: dict | None = None) -> PretokenEncoder:
    """This worker's encoder whose values are token counts; tasks share its caches."""
    if (path, "count") not in _encoders:
        _encoders[path, "count"] = PretokenEncoder(path, len, sum, frequent)
    return _encoders[path, "count"]


def packing_encoder(path: str) -> PretokenEncoder:
    """This worker's encoder whose values are ids as little-endian 32-bit numbers."""
    if (path, "ids") not in _encoders:
        _encoders[path, "ids"] = PretokenEncoder(path, _packed_ids, b"".join)
    return _encoders[path, "ids"]


def _packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _splitting_pattern(config: dict) -> str | None:
    """The pattern of pre-tokens, if the tokenizer lowers case and splits texts at every blank."""
    steps = (config.get("normalizer") or {}).get("normalizers", [])
    splits = (config.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    first, rest = splits[0], splits[1:]
    pattern = first.get("pattern", {}).get("Regex", "")
    known = (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and pattern.endswith(r"[^\s\p{L}\p{N}]+")
        and [s.get("type") for s in rest] == ["ByteLevel"]
        and not rest[0].get("use_regex", True)
        and not rest[0].get("add_prefix_space", True)
    )
    return pattern if known else None
