import random
import re
import string
from collections import Counter

import corpus_pipeline
import xxhash

from orderlore.llm import decontaminate, line_dedup, ranking
from orderlore.llm.tables import stored

SF = "/root/testdata/sf0.001"
lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_stages_keep_columns_and_take_effect(spark, corpus):
    docs = corpus
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert [f.simpleString() for f in out.schema] == [f.simpleString() for f in docs.schema], name
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert Counter(r["doc_id"] for r in last.collect()) == Counter(r["doc_id"] for r in docs.collect())


def test_stages_of_an_empty_table(spark, empty):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.count() == 0


def fingerprint_by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(lower)) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def one_of_each_by_hand(texts):
    """Smallest id of each component of texts whose fingerprints differ in two bits or fewer."""
    prints = {i: fingerprint_by_hand(text) for i, text in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(texts)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in texts}


def test_run_against_the_operators(spark):
    """The pipeline's documents, stage by stage, from the operators' own reports."""
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    good = {r["doc_id"] for r in ranking.classify(docs, labels).where("predicted = 1").collect()}
    first = stored(docs.where(docs["doc_id"].isin(good)), "first")
    cut = line_dedup.remove_repeated_lines(first).collect()
    second = {r["doc_id"]: r["text"] for r in cut if not r["lines_removed"] or r["text"].split()}
    third = one_of_each_by_hand(second)
    left = spark.createDataFrame([(i, t) for i, t in second.items() if i in third], "doc_id bigint, text string")
    clean = {r["doc_id"] for r in decontaminate.contamination(left, items).where("not contaminated").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == clean and len(clean) > 50


def test_near_dedup_stage_against_brute_force(spark):
    chosen = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts = {5000: "", 5001: " \n", 5002: "one two", 5003: "One two", 5004: "one two three"}
    for group in range(20):
        base = chosen.choices(words, k=chosen.randint(60, 900))
        for copy in range(6):
            own = list(base)
            for at in chosen.sample(range(len(own)), copy):
                own[at] = chosen.choice(words)
            texts[100 * group + copy] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.remove_near_duplicates(spark, docs, SF).collect()}
    assert kept == one_of_each_by_hand(texts) and len(kept) < len(texts)
