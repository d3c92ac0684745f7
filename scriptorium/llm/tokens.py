"""Token ids of whole texts by a public byte-level BPE tokenizer.

The library's own pipeline spends most of its time on words it has met before.
Here a text of ASCII and Latin letters is cut by the same pre-token pattern, and
the library's model encodes each distinct pre-token once per worker process. The
cache is emptied when full, so memory is bounded. Any other text goes piece by
piece: it is cut before a single space that follows a non-space character, where
both pre-tokenizers always cut, and pieces with other characters take the
library's whole pipeline. All ways give the ids of the whole text.
"""

from __future__ import annotations

import json
import re
from array import array

#: Pre-tokens kept per worker process, and characters of a pre-token that may be kept.
CACHE_SIZE, CACHE_CHARS = 800_000, 64

#: Letters without the capital dotted I, whose lower case is two characters; all are stable under NFC.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
_SIMPLE = re.compile(rf"[\t-\r\x20-\x7e{LETTERS}]*")
_CUT = re.compile(r"(?<=\S)(?= )")
_SHORT = "'(?:s|t|re|ve|m|ll|d)"
#: The two pre-token patterns over such texts, with and without the space before a word.
_WORDS = re.compile(rf"[{LETTERS}]+|[0-9]|{_SHORT}|[^\s{LETTERS}0-9]+")
_SPACED = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+|{_SHORT}| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
_ENCODERS: dict = {}


def _byte_marks() -> dict[int, str]:
    """Byte-level BPE's printable stand-in of each byte: itself if printable, else 256, 257, ... in order."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = {}, 256
    for b in range(256):
        out[b] = chr(b if b in kept else more)
        more += b not in kept
    return out


class _Codes(dict):
    """Ids of a pre-token as little-endian bytes, made when first asked for."""

    def __init__(self, tokenize):
        self.tokenize, self.marks = tokenize, _byte_marks()

    def __missing__(self, word: str) -> bytes:
        code = array("I", [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.marks))]).tobytes()
        if len(word) <= CACHE_CHARS:
            self[word] = code
        return code


class PieceEncoder:
    """``path``: a tokenizer file whose pre-tokens are those of _WORDS (lower-cased) or _SPACED."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            self.lower = json.load(f)["normalizer"] is not None
        self.cut = (_WORDS if self.lower else _SPACED).findall
        self.plain = lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self.codes = _Codes(tokenizer.model.tokenize)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text (null: none)."""
        if not text:
            return b""
        if len(self.codes) > CACHE_SIZE:
            self.codes.clear()
        if _SIMPLE.fullmatch(text):
            return self._simple(text)
        return b"".join([self._simple(p) if _SIMPLE.fullmatch(p) else self.plain(p) for p in _CUT.split(text)])

    def _simple(self, text: str) -> bytes:
        return b"".join(map(self.codes.__getitem__, self.cut(text.lower() if self.lower else text)))


def encoder(path: str) -> PieceEncoder:
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
