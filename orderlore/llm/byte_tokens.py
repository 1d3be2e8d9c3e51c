"""Ids of texts under a byte-level vocabulary of the tokenizers library, piece by piece."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from orderlore.llm.pieces import PieceCache, byte_pieces, special_strings, tokenizer

END_ID = 2


class ByteEncoder:
    """Encodes as the library does with add_special_tokens=False; each distinct piece meets the library once."""

    def __init__(self, path: str):
        self.library, self.special = tokenizer(path), tuple(special_strings(path))
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache = PieceCache(self._missing, limit=1_000_000)

    def _missing(self, pieces: list[str]) -> list[bytes]:
        encoded = self.library.encode_batch_fast(pieces, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}{self.code}", *ids) for ids in (e.ids for e in encoded)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned integers of `dtype`."""
        pieces = None if any(s in text for s in self.special) else byte_pieces(text)
        if pieces is not None:
            return b"".join(self.cache(pieces))
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)
