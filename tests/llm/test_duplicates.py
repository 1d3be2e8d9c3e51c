import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orderlore.llm import components, line_dedup, simhash, suffix_dedup, suffixes


def fingerprint(text):
    words = (text or "").encode().translate(simhash._LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprints(texts):
    for _, text in texts:
        assert simhash.fingerprint(text or "") == fingerprint(text)


def grouped(values):
    """Components of fingerprints that differ in at most two bits, by brute force."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    order = sorted(root)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


@pytest.mark.parametrize("crowd", [1, 256])
def test_near_duplicates_against_brute_force(corpus, empty, texts, crowd):
    got = Counter((r["doc_id"], r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(corpus, crowd=crowd).collect())
    roots = grouped({fingerprint(t) for _, t in texts})
    smallest = {}
    for i, t in texts:
        if i is not None:
            r = roots[fingerprint(t)]
            smallest[r] = min(i, smallest.get(r, i))
    assert got == Counter((i, fingerprint(t), smallest.get(roots[fingerprint(t)])) for i, t in texts)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_clusters_and_chains(spark):
    chosen, values = random.Random(4), set()
    for _ in range(12):
        v = chosen.getrandbits(64)
        for _ in range(40):
            values.add(v)
            v ^= 1 << chosen.randrange(64)
            if chosen.random() < 0.4:
                v ^= 1 << chosen.randrange(64)
    df = spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "f bigint")
    for crowd in (2, 1000):
        found = {r["node"] & (1 << 64) - 1: r["root"] for r in components.components(simhash.links(df, crowd)).collect()}
        expected = grouped(values)
        sizes = Counter(expected.values())
        assert set(found) == {v for v in values if sizes[expected[v]] > 1}
        assert len({(found[v], expected[v]) for v in found}) == len(set(found.values())) == sum(n > 1 for n in sizes.values())


def test_one_of_each_component_stays(corpus, empty):
    left = simhash.one_of_each(corpus)
    assert left.columns == corpus.columns
    kept = Counter(r["doc_id"] for r in left.collect())
    parts = {r["component_id"] for r in simhash.near_duplicates(corpus).collect()}
    assert set(kept) == parts and all(n == 1 for i, n in kept.items() if i not in (8, 9))
    assert kept[9] == 1 or 9 not in kept
    assert simhash.one_of_each(empty).count() == 0


def without_repeats(docs, min_lines=4, min_words=50):
    """Line dedup by brute force over all pairs of windows and first places."""
    rows = sorted({(-1 if i is None else i, hashlib.md5((t or "").encode()).digest(), t) for i, t in docs}, key=lambda r: r[:2])
    lines = [[] if t is None else [x.strip(" ") for x in t.split("\n")] for *_, t in rows]
    first, gone = {}, [set() for _ in rows]
    for d, own in enumerate(lines):
        for s in range(len(own)):
            for k in range(1, min_lines + 1):
                if s + k <= len(own) and (k == min_lines or sum(len(x.split()) for x in own[s : s + k]) >= min_words):
                    q, at = first.setdefault(tuple(own[s : s + k]), (d, s))
                    if (q, at) != (d, s):
                        a, b = s, s + k
                        while a and at - (s - a) and own[a - 1] == lines[q][at - (s - a) - 1]:
                            a -= 1
                        while b < len(own) and at + b - s < len(lines[q]) and own[b] == lines[q][at + b - s]:
                            b += 1
                        gone[d].update(range(a, b))
                    break
    cut = {}
    for (i, key, t), own in zip(rows, gone):
        cut[i, key] = (t if not own else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in own), len(own))
    return Counter((i, *cut[-1 if i is None else i, hashlib.md5((t or "").encode()).digest()]) for i, t in docs)


def test_line_dedup_against_brute_force(corpus, empty, texts):
    left = line_dedup.remove_repeated_lines(corpus, removed="cut", total="all_lines")
    assert left.columns == [*corpus.columns, "cut", "all_lines"]
    assert Counter((r["doc_id"], r["text"], r["cut"]) for r in left.collect()) == without_repeats([(i, t) for i, t in texts])
    assert line_dedup.remove_repeated_lines(empty).count() == 0


def test_line_dedup_of_random_documents(spark):
    chosen = random.Random(7)
    pool = [f"line {i} " + "word " * chosen.choice([0, 0, 3, 60]) for i in range(9)]
    docs = [(i, "\n".join(chosen.choice(pool) for _ in range(chosen.randint(0, 14)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = line_dedup.remove_repeated_lines(df)
    assert Counter((r["doc_id"], r["text"], r["lines_removed"]) for r in got.collect()) == without_repeats(docs)


def test_line_dedup_is_native(corpus):
    plan = line_dedup.remove_repeated_lines(corpus)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_suffixes_are_sorted():
    chosen = random.Random(2)
    for _ in range(200):
        data = bytes(chosen.choice(b"ab") for _ in range(60)) * chosen.randint(1, 3) + b"\0" * 40
        n = chosen.randint(0, 60)
        starts = np.array([chosen.randrange(len(data) - 40) for _ in range(n)], np.int64)
        groups = np.array([chosen.randrange(3) for _ in range(n)], np.int64)
        order, same = suffixes.sort_suffixes(data, starts, groups, 24, chosen.choice([0, 8, 16]))
        keys = [(groups[i], data[starts[i] : starts[i] + 24]) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)
        assert [bool(s) for s in same] == [i > 0 and keys[i] == keys[i - 1] for i in range(n)]


def covered(docs, length=200):
    seen = Counter(t[k : k + length] for _, t in docs for k in range(len(t) - length + 1))
    out = []
    for i, t in docs:
        hit = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                hit[k : k + length] = b"\1" * length
        out.append((i, len(t), sum(hit), bytes(c for c, h in zip(t, hit) if not h)))
    return Counter(out)


@pytest.mark.parametrize("crowd", [1, 512])
def test_suffix_dedup_against_brute_force(spark, corpus, empty, texts, crowd):
    chosen = random.Random(crowd)
    base = "".join(chosen.choice("abcdefgh ") for _ in range(700))
    more = [(100 + i, base[chosen.randint(0, 300) : chosen.randint(400, 700)] + str(i) + "é" * chosen.randint(0, 9)) for i in range(30)]
    more += [(200 + i, f"{i} start " + base[100:260] + f" {i % 3} " + base[300:520]) for i in range(8)]
    docs = [(i, (t or "").encode()) for i, t in texts if i != 8] + [(i, t.encode()) for i, t in more]
    df = corpus.select("doc_id", "text").where("doc_id is null or doc_id <> 8").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = suffix_dedup.remove_repeats(df, crowd=crowd).withColumn("cut", F.col("n_bytes") - F.octet_length("kept")).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["cut"], bytes(r["kept"])) for r in got) == covered(docs)
    if crowd == 1:
        assert suffix_dedup.remove_repeats(empty).count() == 0


def test_long_texts_are_cut_into_segments(monkeypatch):
    data = np.frombuffer(bytes(random.Random(3).choice(b"abc") for _ in range(6000)), np.uint8)
    whole = suffix_dedup._anchor_rows(0, data, 200, 32)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    for a, b in zip(whole, suffix_dedup._anchor_rows(0, data, 200, 32)):
        assert np.array_equal(a, b)
