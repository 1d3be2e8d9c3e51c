"""Splitting text into the pieces that byte-pair encoders work on, and a bounded cache of encoded pieces.

Both public vocabularies split text with a regular expression before any merge, and merges never cross a piece. So a
text is the concatenation of its pieces' ids, and a piece met before need not be encoded again. Texts with characters on
which Python's classes and the tokenizer's differ (fractions, unassigned code points, separators 1C-1F) or with special
strings take the library's own splitting; `plain` decides.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from tokenizers import Tokenizer

# fixed values: the split patterns of the two public vocabularies, in Python's character classes
_LETTERS, _DIGITS, _OTHER = r"[^\W\d_]", r"\d", r"(?:[^\s\w]+|_+)+"
BYTE_PIECES = re.compile(rf" ?{_LETTERS}+|'s|'t|'re|'ve|'m|'ll|'d| ?{_DIGITS}+| ?{_OTHER}|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"{_LETTERS}+|'s|'t|'re|'ve|'m|'ll|'d|{_DIGITS}|{_OTHER}")
# the same for texts below U+0100, whose classes are a bitmap
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN_BYTE_PIECES = re.compile(rf" ?[{_LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+")
LATIN_WORD_PIECES = re.compile(rf"[{_LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s0-9{_LATIN}]+")

_plain: set[str] = set()
_latin = {chr(i) for i in range(256) if unicodedata.category(chr(i)) != "No" and not 0x1C <= i <= 0x1F}


def _is_plain(character: str) -> bool:
    return unicodedata.category(character) not in ("Cn", "Nl", "No") and not "\x1c" <= character <= "\x1f"


def plain(text: str) -> bool:
    """Whether Python's character classes split this text as the tokenizer does."""
    unknown = set(text) - _plain
    if unknown:
        good = {c for c in unknown if _is_plain(c)}
        _plain.update(good)
        return len(good) == len(unknown)
    return True


def byte_pieces(text: str) -> list[str] | None:
    """Pieces of a text under the byte-level pattern; None if the text is not plain."""
    if _latin.issuperset(letters := set(text)):
        return LATIN_BYTE_PIECES.findall(text)
    return BYTE_PIECES.findall(text) if _plain.issuperset(letters) or plain(text) else None


def word_pieces(text: str) -> list[str] | None:
    """The same under the word pattern, for a text in lower case."""
    if _latin.issuperset(letters := set(text)):
        return LATIN_WORD_PIECES.findall(text)
    return WORD_PIECES.findall(text) if _plain.issuperset(letters) or plain(text) else None


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """The library's tokenizer, once per process, with truncation and padding off.

    Its own threads are off, too: a task has one core, and threads that wait for short batches keep others busy.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=4)
def special_strings(path: str) -> dict[str, int]:
    return {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}


class PieceCache:
    """Pieces and what they encode to, at most `limit` of them in two generations: what is not asked for while one
    generation fills up is forgotten with the older one. Very long pieces are never kept."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 400_000, longest: int = 64):
        self.encode, self.half, self.longest = encode, max(1, limit // 2), longest
        self.known: dict = {}
        self.older: dict = {}

    def __call__(self, pieces: list[str]) -> list:
        """The values of the pieces, in order."""
        values = list(map(self.known.get, pieces))
        if None not in values:
            return values
        absent = list({p for p, v in zip(pieces, values) if v is None})
        found = {p: v for p, v in zip(absent, map(self.older.get, absent)) if v is not None}
        missing = [p for p in absent if p not in found]
        found.update(zip(missing, self.encode(missing)))
        values = [found[p] if v is None else v for p, v in zip(pieces, values)]
        for piece, value in found.items():
            if len(piece) <= self.longest:
                if len(self.known) >= self.half:
                    self.known, self.older = {}, self.known
                self.known[piece] = value
        return values
