"""Whole-text encoding with public tokenizer files, cached by white-space units."""

from __future__ import annotations

import os
import re
import struct
from array import array
from functools import lru_cache

#: Units that one worker keeps.
CACHE = 600_000

#: White space (or what one of the pattern engines takes for it) beyond space, \t, \n, \v, \f, \r.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def odd_space(text: str) -> bool:
    if text.isascii():
        return any(c in text for c in "\x1c\x1d\x1e\x1f")
    return ODD_SPACE.search(text) is not None


class Generations:
    """A bounded cache in two dictionaries: what is found in the old one moves to the new one; when the new one is full,
    the old one is dropped and the new one takes its place, so what is in use stays."""

    def __init__(self, size: int):
        self.half = max(1, size // 2)
        self.new, self.old = {}, {}

    def find(self, key: str) -> bytes | None:
        """Value of a key that is not in ``new``, or None."""
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Encoder:
    """Ids of whole texts by a ``tokenizers`` BPE file, equal to ``encode(text, add_special_tokens=False)``.

    Special tokens' strings in a text are ordinary text. A text's ids are those of its units in order, and the units
    last met are kept with their ids. Units are the pre-tokenizer's pieces, or, where it drops white space, the words
    between it, which are cut into pieces when they are met. ASCII is cut by an ASCII form of the pattern. Texts with
    white space that the two pattern engines may class differently, and files of another make, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core already
        import json

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        spec = json.loads(self.whole.to_str())
        pre, norm = spec["pre_tokenizer"], spec["normalizer"]
        self.units = Generations(CACHE)
        self.normal = pattern = None
        self.split = None  # units of a text that is not ASCII
        if spec["model"]["type"] == "BPE" and norm is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            pattern = public_tokenizers.PATTERN
        elif (spec["model"]["type"] == "BPE" and norm and [n["type"] for n in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]
              and pre["type"] == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"]):
            pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
            self.normal = self.whole.normalizer.normalize_str
        if pattern:
            self.pieces = regex.compile(pattern).findall
            self.ascii_pieces = re.compile(pattern.replace(r"[\p{L}]", "[A-Za-z]").replace(r"[\p{N}]", "[0-9]")
                                           .replace(r"\p{L}+|", "[A-Za-z]+|").replace(r"\p{N}+|", "[0-9]+|")
                                           .replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), re.ASCII).findall
            self.split, self.ascii_split = (self.pieces, self.ascii_pieces) if self.normal is None else (str.split, str.split)
        self.token = self.whole.model.tokenize
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte-level alphabet keeps
        rest = [b for b in range(256) if b not in shown]
        self.alphabet = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}

    def _unit(self, unit: str) -> bytes:
        out = self.units.find(unit)
        if out is None:
            if self.normal is None:
                pieces = [unit]
            elif unit.isascii():
                pieces = self.ascii_pieces(unit.lower())
            else:
                pieces = self.pieces(self.normal(unit))
            ids = array("I")
            for p in pieces:
                ids.extend([t.id for t in self.token(p.encode().decode("latin-1").translate(self.alphabet))])
            out = ids.tobytes()
            if len(unit) < 64:
                self.units.keep(unit, out)
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers (null: none)."""
        if not text:
            return b""
        if self.split is None or odd_space(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        get, new = self.units.new.get, self._unit
        return b"".join([get(u) or new(u) for u in (self.ascii_split if text.isascii() else self.split)(text)])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
