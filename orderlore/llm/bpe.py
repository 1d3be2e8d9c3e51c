"""Byte-pair encoding and decoding with word ends (operator 3).

A word is a short list of parts. Beside the parts stands an array of ranks, one for each adjacent pair; the pair with the
smallest rank (the leftmost of equals) is merged by deleting the boundary between its parts, after which only the ranks of
the two neighbours are looked up anew. Words are short, so scanning the array beats any heap. A run of letters without end
(base64, DNA) would take quadratic time that way; words of more than `LONG` parts are merged in the same order through a
heap over a linked list instead.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlore.llm.pieces import PieceCache, plain, special_strings, tokenizer, word_pieces
from orderlore.llm.tables import map_arrow

NO_RANK = 1 << 62
LONG = 400


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Vocabulary, merge ranks and the rank-array encoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.library, self.special = tokenizer(path), special_strings(path)
        pairs = (m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"])
        of = self.vocabulary
        self.merges = {(of[a] << 20) | of[b]: (rank, of[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        letters = byte_letters()
        self.inner = [of.get(x) for x in letters]
        self.last = [of.get(x + self.suffix) for x in letters]
        self.cache = PieceCache(lambda words: [np.asarray(self.word(w), "<i4").tobytes() for w in words])
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.raw: dict[int, bytes] = {}
        self.names = {i: t for t, i in [*self.vocabulary.items(), *self.special.items()]}

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode()
        parts = [i for i in [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]] if i is not None]
        if len(parts) > LONG:
            return self.long_word(parts)
        merges, none = self.merges, (NO_RANK, 0)
        ranks = [merges.get((a << 20) | b, none)[0] for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            parts[at] = merges[(parts[at] << 20) | parts[at + 1]][1]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = merges.get((parts[at] << 20) | parts[at + 1], none)[0]
            if at:
                ranks[at - 1] = merges.get((parts[at - 1] << 20) | parts[at], none)[0]
        return parts

    def long_word(self, parts: list[int]) -> list[int]:
        """The same merges for a word of very many parts. A heap entry is stale if its pair has changed since."""
        merges, none, end = self.merges, (NO_RANK, 0), len(parts)
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        ranks = [merges.get((a << 20) | b, none)[0] for a, b in zip(parts, parts[1:])] + [NO_RANK]
        heap = [(rank, at) for at, rank in enumerate(ranks) if rank < NO_RANK]
        heapify(heap)
        while heap:
            rank, at = heappop(heap)
            if ranks[at] != rank:
                continue
            gone = after[at]
            parts[at] = merges[(parts[at] << 20) | parts[gone]][1]
            parts[gone], ranks[gone] = -1, NO_RANK
            after[at] = after[gone]
            if after[at] < end:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0:
                    right = after[left]
                    ranks[left] = merges.get((parts[left] << 20) | parts[right], none)[0] if right < end else NO_RANK
                    if ranks[left] < NO_RANK:
                        heappush(heap, (ranks[left], left))
        return [p for p in parts if p >= 0]

    def words(self, text: str) -> list[str]:
        """Words of a text without special strings: canonical composition, lower case, split."""
        if text.isascii() or plain(text):
            lower = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
            pieces = word_pieces(lower.lower())
            if pieces is not None:
                return pieces
        normal = self.library.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers. Special strings in the text become their own ids."""
        if "<" not in text or not self.split_special.search(text):
            return b"".join(self.cache(self.words(text)))
        out, at = [], 0
        for found in self.split_special.finditer(text):
            out += self.cache(self.words(text[at : found.start()]))
            out.append(np.int32(self.special[found[0]]).tobytes())
            at = found.end()
        return b"".join(out + self.cache(self.words(text[at:])))

    def tokens(self, ids: list[int]) -> list[str]:
        return [self.names[i] for i in ids if i in self.names]

    def text(self, ids: list[int]) -> str:
        """Readable text: bytes of the letters, word ends as spaces."""
        if not self.raw:
            of = {x: b for b, x in enumerate(byte_letters())}
            for i, token in self.names.items():
                if token in self.special:
                    self.raw[i] = token.encode() + b" "
                    continue
                ends = bool(self.suffix) and token.endswith(self.suffix)
                self.raw[i] = bytes(of[c] for c in (token[: -len(self.suffix)] if ends else token)) + b" " * ends
        known = self.raw
        return b"".join(known[i] for i in ids if i in known).decode("utf-8", "replace").rstrip(" ")


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds (or replaces) the column `ids`, array<int>: the ids of the whole text, as the tokenizers library gives them
    without added special tokens, truncation or padding.

    A null text is encoded as the empty text, which has no ids. Every row and every other column passes through, so
    repeated rows and nulls stay; an empty table gives an empty result. `path` names the vocabulary file on every node.
    """
    kept = [c for c in docs.columns if c != ids]
    where = kept.index(text)
    schema = docs.select(*kept).withColumn(ids, F.lit(None).cast("array<int>")).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                data = [encoder.encode(t.as_py() or "") for t in part.column(where)]
                offsets = np.concatenate([[0], np.cumsum([len(d) // 4 for d in data])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(data), "<i4"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), flat)], [*kept, ids])

    return docs.select(*kept).mapInArrow(rows, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", readable: bool = False) -> DataFrame:
    """Adds (or replaces) the column `decoded`, string: the text of the ids.

    By default as the library decodes with skip_special_tokens=False: this vocabulary has no decoder, so the tokens stand
    joined by spaces. `readable` gives words again: bytes decoded as UTF-8, word ends as spaces. Null ids count as none,
    ids outside the vocabulary are left out; no ids give the empty text. Other columns pass through.
    """
    kept = [c for c in encoded.columns if c != decoded]
    where = kept.index(ids)
    schema = encoded.select(*kept).withColumn(decoded, F.lit(None).cast("string")).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        one = encoder.text if readable else lambda x: " ".join(encoder.tokens(x))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [one((x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, int)).tolist()) for x in part.column(where)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*kept, decoded])

    return encoded.select(*kept).mapInArrow(rows, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """Length of the ids and digests of ids and decoded text."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def encode_decode(docs: DataFrame, path: str, readable: bool = False) -> DataFrame:
    """doc_id, ids and the text decoded from them, of every document, as `encode` and `decode` give them one after the other.

    Both happen in one pass, so a task has one Python worker with one vocabulary. Null and empty texts have no ids and
    decode to the empty text; repeated rows each keep their row; an empty table gives an empty result; other columns,
    whatever their names, are left out.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        one = encoder.text if readable else lambda x: " ".join(encoder.tokens(x))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [np.frombuffer(encoder.encode(t.as_py() or ""), "<i4") for t in part.column(1)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, "<i4"), *ids])))
                texts = pa.array([one(x.tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, texts], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {id_type}, ids array<int>, decoded string")
