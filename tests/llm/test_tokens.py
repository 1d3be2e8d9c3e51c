import hashlib
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orderlore.llm import bpe, token_counts, token_files
from orderlore.llm.byte_tokens import ByteEncoder
from orderlore.llm.pieces import PieceCache

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "a", "B", "s", "'", "'s", "'re", "'LL", " ", "  ", "\n", "\t", "\r\n", "1", "22", "²", "½", "_", "__", "-", "!!", "é", "É", "ß", "Σ", "ς", "İ", "é", "中", "文", "Ⅷ",
    "\x1c", "\x1f", " ", " ", "͸", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "\u0085", "ǅ", "Ж", "ª", "º", "\U0001d400", "‍", "\x00", "the", "ing", " don't", "ﬁ",
]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def test_encoders_agree_with_the_library(libraries):
    chosen, byte, word = random.Random(1), ByteEncoder(BYTE), bpe.WordEncoder(WORD)
    for _ in range(3000):
        text = "".join(chosen.choice(PARTS) for _ in range(chosen.randint(0, 14)))
        own = np.frombuffer(byte.encode(text), byte.dtype).tolist()
        assert own == libraries[0].encode(text, add_special_tokens=False).ids, repr(text)
        ids = np.frombuffer(word.encode(text), "<i4").tolist()
        assert ids == libraries[1].encode(text, add_special_tokens=False).ids, repr(text)
        assert " ".join(word.tokens(ids)) == libraries[1].decode(ids, skip_special_tokens=False)


def test_long_words_merge_in_the_same_order(libraries):
    chosen, word = random.Random(2), bpe.WordEncoder(WORD)
    for letters in ("ab", "theandi", "abcdefghijklmnopqrstuvwxyz", "aaaé"):
        for size in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3 * bpe.LONG):
            text = "".join(chosen.choices(letters, k=size))
            ids = libraries[1].encode(text, add_special_tokens=False).ids
            assert word.word(text) == ids
            assert word.long_word([i for i in [*map(word.inner.__getitem__, text.encode()[:-1]), word.last[text.encode()[-1]]]]) == ids
    start = time.perf_counter()
    assert len(word.word("".join(chosen.choices("acgt", k=300_000)))) > 1000
    assert time.perf_counter() - start < 60


def test_one_pass_equals_two(corpus):
    for readable in (False, True):
        two = bpe.decode(bpe.encode(corpus, WORD), WORD, readable=readable).select("doc_id", "ids", "decoded")
        one = bpe.encode_decode(corpus, WORD, readable)
        assert one.columns == two.columns
        assert Counter((r[0], tuple(r[1]), r[2]) for r in one.collect()) == Counter((r[0], tuple(r[1]), r[2]) for r in two.collect())


def test_readable_text_round_trip():
    word = bpe.WordEncoder(WORD)
    for text in ("hello world", "don 't stop , now !", "naïve café 中 文", ""):
        assert word.text(np.frombuffer(word.encode(text), "<i4").tolist()) == text


def test_cache_is_bounded_and_right():
    cache = PieceCache(lambda pieces: [p.upper() for p in pieces], limit=4, longest=4)
    for pieces in (["a", "b", "a"], ["c", "d", "longer"], ["a", "longer", "e"], [], ["a", "b", "c", "d", "e", "f", "g"], ["f", "a"]):
        assert cache(pieces) == [p.upper() for p in pieces]
        assert len(cache.known) + len(cache.older) <= 4 and "longer" not in {**cache.known, **cache.older}


def test_encode_and_decode_keep_rows_and_columns(corpus, empty, texts, libraries):
    out = bpe.decode(bpe.encode(corpus, WORD), WORD)
    assert out.columns == [*corpus.columns, "ids", "decoded"]
    found = out.collect()
    assert len(found) == len(texts)
    for r in found:
        ids = libraries[1].encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == libraries[1].decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty, WORD).count() == 0


def test_digests_of_encoding(corpus, texts, libraries):
    got = Counter(tuple(r) for r in bpe.digests(bpe.encode_decode(corpus, WORD)).collect())

    def row(i, text):
        ids = libraries[1].encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return i, len(ids), sha(" ".join(map(str, ids))), sha(libraries[1].decode(ids, skip_special_tokens=False))

    assert got == Counter(row(*x) for x in texts)


def test_token_files_round_trip(corpus, empty, texts, libraries):
    shards, folder = token_files.write_tokens(corpus, BYTE)
    back = token_files.read_tokens(shards, folder).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in back) == Counter(
        (i, struct.pack(f"<{len(ids)}I", *ids)) for i, ids in ((i, [*libraries[0].encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts)
    )
    order = sorted(back, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0, *(r["n_tokens"] for r in order[:-1])]).tolist()
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    checked = {(r["start"], r["ids_crc32"]) for r in token_files.digests(token_files.read_tokens(shards, folder)).collect()}
    assert checked == {(r["start"], zlib.crc32(bytes(r["ids"]))) for r in back}
    assert token_files.read_tokens(*token_files.write_tokens(empty, BYTE)).count() == 0


def test_token_counts_use_and_fill_the_cache(spark, corpus, empty, texts, libraries):
    from orderlore.session import fresh_path

    cache = fresh_path(spark, "cache")
    expected = Counter((i, len((t or "").encode()), n, n > 100) for i, t in texts for n in [len(libraries[0].encode(t or "", add_special_tokens=False).ids)])
    for _ in range(2):
        got = token_counts.count_tokens(corpus, BYTE, cache, limit=100)
        assert Counter(tuple(r) for r in got.collect()) == expected
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in texts})
    assert token_counts.count_tokens(empty, BYTE, cache).count() == 0


def test_stored_counts_are_not_encoded_again(spark, corpus):
    from orderlore.session import fresh_path

    cache, version = fresh_path(spark, "cache"), token_counts.tokenizer_version(BYTE)
    rows = [(hashlib.sha256(b"short").digest(), version, 77), (hashlib.sha256(b"").digest(), "another version", 5)]
    spark.createDataFrame(rows, token_counts.CACHE).write.parquet(cache)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(corpus.where("doc_id in (4, 5)"), BYTE, cache).collect()}
    assert got == {4: 77, 5: 0}


def test_byte_pieces_are_remembered_over_half_a_million_others():
    """Words of natural text are that many; a piece that was forgotten goes through the library again."""
    encoder, asked = ByteEncoder(BYTE), []
    assert encoder._missing([" word", "s" * 70]) == [np.asarray(encoder.library.encode(x, add_special_tokens=False).ids, encoder.dtype).tobytes() for x in (" word", "s" * 70)]
    encoder.cache.encode = lambda pieces: asked.extend(pieces) or [b"x"] * len(pieces)
    for start in range(0, 600_000, 1000):
        encoder.cache([str(i) for i in range(start, start + 1000)])
    assert encoder.cache([str(i) for i in range(1000)]) == [b"x"] * 1000 and len(asked) == 600_000
    assert len(encoder.cache.known) + len(encoder.cache.older) <= 1_000_000
