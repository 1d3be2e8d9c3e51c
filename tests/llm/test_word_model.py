import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orderlore.llm import quality_rules, word_model


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("lang", F.lit("xx"))


def test_probabilities_against_direct_kneser_ney(spark):
    chosen = random.Random(4)
    df = frame(spark, [" ".join(chosen.choice("abcde") for _ in range(12)) for _ in range(12)])
    dealt = {r["h"]: r["half"] for r in word_model.grams(df).collect()}
    halves = {half: [r["text"] for r in df.select("text", word_model.identity().alias("h")).collect() if dealt[r["h"]] != half] for half in (0, 1)}
    assert all(halves.values())
    found = {(r["a"], r["b"], r["c"]): r for r in word_model.train(df).collect()}
    code = {w: int(word_model.word_hashes(w, "xx").view("int64")[0]) for w in "abcde"} | {"^": int(word_model._START.view("int64"))}
    for half, texts in halves.items():
        counts = {3: Counter(tuple(("^ ^ " + t).split()[k : k + 3]) for t in texts for k in range(12))}
        for size in (2, 1):
            counts[size] = Counter(g[1:] for g in counts[size + 1])

        def discounts(size):
            t = [sum(n == k for n in counts[size].values()) for k in (1, 2, 3, 4)]
            if min(t) == 0:
                return [0.5, 1.0, 1.5]
            y = t[0] / (t[0] + 2 * t[1])
            return [max(0.05, min(k - 0.05, k - (k + 1) * y * t[k] / t[k - 1])) for k in (1, 2, 3)]

        def p(gram):
            lower = p(gram[1:]) if len(gram) > 1 else 1 / 6
            own = {g: n for g, n in counts[len(gram)].items() if g[:-1] == gram[:-1]}
            if not own:
                return lower
            d, n = discounts(len(gram)), own.get(gram, 0)
            cut = lambda m: d[min(m, 3) - 1]
            return ((n - cut(n) if n else 0) + sum(map(cut, own.values())) * lower) / sum(own.values())

        for gram in {tuple(("^ ^ " + r["text"]).split()[k : k + 3]) for r in df.collect() for k in range(12)}:
            assert found[tuple(code[w] for w in gram)][f"p{half}"] == pytest.approx(p(gram)), gram


def test_shuffled_words_are_rejected(spark):
    """Sentences in order stay, the same words in random order go, and a bad text's exact copy doesn't help it."""
    chosen = random.Random(6)
    sentences = [" ".join(chosen.choice(["river", "stone", "light", "meadow", "winter", "quiet", "morning", "house", "bird"]) for _ in range(9)) for _ in range(40)]
    good = [" ".join(chosen.choice(sentences) for _ in range(12)) for _ in range(200)]
    bad = []
    for text in good[:6]:
        words = text.split()
        chosen.shuffle(words)
        bad += [" ".join(words)] * 2
    rows = quality_rules.judge(frame(spark, good + bad)).where("not base_failed").collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    inside = {r["doc_id"] for r in rows}
    assert {i for i in inside if i >= 200} and not {i for i in kept if i >= 200}
    assert len(kept) > 0.9 * len({i for i in inside if i < 200})


def test_bands_reject_bad_documents_and_keep_clean_ones(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    kept = {r["quality"]: (r["n"], r["kept"]) for r in judged.join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1][1] > 0.9 * kept[1][0] and kept[0][1] < 0.7 * kept[0][0], kept


def test_band_of_equal_texts(spark):
    text = " ".join(f"w{i}" for i in range(30))
    assert quality_rules.judge(frame(spark, [text] * 5)).where("kept").count() == 5


def test_small_blocks_give_the_same_model_and_scores(spark):
    """Counts are added over blocks, whatever the texts in each, copies and languages included."""
    chosen = random.Random(8)
    texts = [" ".join(chosen.choice("abcdefgh") for _ in range(chosen.randrange(12))) for _ in range(60)]
    df = frame(spark, [*texts, *texts[:9], None]).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.lit("xx")))
    model = {words: {(r["l"], r["a"], r["b"], r["c"]): (r["p0"], r["p1"]) for r in word_model.train(df, words).collect()} for words in (7, 10_000)}
    assert len(model[7]) == word_model.train(df, 7).count() > 100
    assert model[7].keys() == model[10_000].keys() and all(model[7][g] == pytest.approx(p) for g, p in model[10_000].items())
    found = {words: sorted(map(tuple, word_model.scores(df, words).collect())) for words in (7, 10_000)}
    assert found[7] == [(h, w, pytest.approx(p, abs=2e-6)) for h, w, p in found[10_000]]
    grams = word_model.grams(df).join(word_model.train(df, 7), ["l", "a", "b", "c"])
    mean = grams.groupBy("h", "w").agg(F.avg(-F.log(F.when(F.col("half") == 0, F.col("p0")).otherwise(F.col("p1")))))
    assert found[7] == [(h, w, pytest.approx(p, abs=2e-6)) for h, w, p in sorted(map(tuple, mean.collect()))]
    assert word_model.scores(df.limit(0)).collect() == []


def test_words_move_as_packed_arrays(spark):
    """Blocks and all answers take fewer than eight bytes a word, where a row for each word took 56, and requests few rows."""
    from orderlore.llm import word_blocks

    chosen = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    df = frame(spark, [" ".join(chosen.choices(words, k=400)) for _ in range(200)]).repartition(2)
    blocks, folder = word_blocks.write_blocks(df, word_model.identity())
    files = sum((spark._jvm.java.io.File(f"{folder}/{r['block']}").length()) for r in blocks.collect())

    (codes,) = word_blocks.language_groups(blocks)

    def asks(name, replies):
        block = word_model._Block(word_blocks.read_block(folder, name), replies, codes)
        return block.keys, block.columns

    counts, sums = [], []
    for level in (1, 2, 3):
        own, of_contexts, _ = word_blocks.exchange([blocks, *counts[-1:]], asks, level, 1, f"{folder}/answers")
        counts, sums = [*counts, own], [*sums, of_contexts]
    assert files + sum(m.agg(F.sum(F.length("payload"))).first()[0] or 0 for m in [*counts, *sums]) < 8 * 80_000
    assert all(m.count() <= blocks.count() * 4 * word_blocks.ROUNDS for m in [*counts, *sums])


def test_packed_columns_and_groups():
    import numpy as np

    from orderlore.llm import word_blocks

    keys = np.sort(np.random.default_rng(1).integers(0, 2**64 - 1, 900, np.uint64, endpoint=True))
    columns = [keys, np.arange(900), np.zeros(900, int), np.full(900, 2**40)]
    for keyed in (False, True):
        assert all((a == b).all() for a, b in zip(columns, word_blocks.unpack(word_blocks.pack(*columns, keyed=keyed), keyed)))
    assert [len(x) for x in word_blocks.unpack(word_blocks.pack(keys[:0], keys[:0]))] == [0, 0]
    close = np.array([5, 2, 5, 1 << 40, 3, 2, (1 << 40) + 1], np.uint64)  # equal in their upper bits
    distinct, places, first = word_blocks.grouped(close)
    assert distinct.tolist() == [2, 3, 5, 1 << 40, (1 << 40) + 1] and (distinct[places] == close).all() and first.tolist() == [1, 4, 0, 3, 6]
