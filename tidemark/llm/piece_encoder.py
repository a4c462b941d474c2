"""Exact, cached encoding with the ``tokenizers`` library.

A text is cut only where the tokenizer's own pre-tokenisation must cut it, each cut piece is encoded by
the library once and its ids are kept as little-endian bytes; a text is then one ``bytes.join``.
Tokenizers or texts for which the cuts are not proven are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Letters and punctuation that every Unicode version classes alike.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PUNCT = r"!-&(-/:-@\[-`{-~"

#: A cut stands (a) between a safe letter and white space, a digit or ASCII punctuation other than the
#: apostrophe, (b) after a single line feed before a letter, (c) between any visible character and white space.
#: No alternative of the supported pre-tokenisation patterns matches across one of these places.
PIECES = re.compile(rf" ?[{LETTERS}]+(?=[ \t\n\r0-9{PUNCT}]|\Z)|\n(?=[{LETTERS}])| ?[{PUNCT}]+(?=[ \n]|\Z)|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")

#: White space that not every engine counts as such, and letters whose lower case depends on what surrounds them.
UNSURE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿Σİ]")

#: Fixed value: the split pattern of the word-level tokenizer for which the cuts are proven.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: A piece that is one pre-token: the merge model can be asked for it directly.
ONE = re.compile(rf" ?(?:[{LETTERS}]+|[{PUNCT}]+)")


def _byte_letters() -> dict[int, str]:
    """Fixed values of byte-level vocabularies: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def _cuts_proven(spec: dict) -> bool:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
        return True
    parts = pre.get("pretokenizers", [])
    return (
        pre.get("type") == "Sequence"
        and len(parts) == 2
        and parts[0].get("pattern") == {"Regex": WORD_PATTERN}
        and parts[0].get("behavior") == "Removed"
        and parts[1].get("type") == "ByteLevel"
        and [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    )


class PieceEncoder(dict):
    """Piece -> ids as little-endian uint32 bytes. ``most`` bounds the entries kept."""

    def __init__(self, path: str, most: int = 500_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut = _cuts_proven(spec)
        self.words = self.cut and spec["pre_tokenizer"]["type"] == "Sequence"
        self.model = self.library.model
        self.added = [x["content"] for x in spec.get("added_tokens", [])]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = np.asarray(self.piece_ids(piece), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def piece_ids(self, piece: str) -> list[int]:
        """The library's ids of a piece cut by PIECES; a single pre-token goes to its merge model at once."""
        if ONE.fullmatch(piece) is None:
            return self.library.encode(piece, add_special_tokens=False).ids
        if self.words:
            piece = piece.lstrip(" ").lower()
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_LETTERS))]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.cut or UNSURE.search(text) or any(x in text for x in self.added):
            return self.whole(text)
        if len(text) > 1 << 20:  # no list of all pieces at once
            return b"".join(self[m.group()] for m in PIECES.finditer(text))
        return b"".join(map(self.__getitem__, PIECES.findall(text)))


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One per Python worker and tokenizer."""
    return PieceEncoder(path)
