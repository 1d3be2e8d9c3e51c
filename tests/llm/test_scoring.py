import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlore.llm import decontaminate, perplexity, pii, quality_rules, ranking, spans
from orderlore.llm.tagger import Tagger

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def contaminated(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            wins[tuple(w[k : k + m])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if own := wins.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= own
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return Counter(out)


def test_decontamination_against_brute_force(spark, corpus, empty, texts):
    line = corpus.where("doc_id = 1").first()["text"].replace("\n", " ; ").upper()
    items = [(1, line[:200]), (2, line[30:140]), (3, "again"), (4, ""), (5, None), (6, "中文 ... Ünïcode"), (7, "no such words are in here at all, not one of them"), (None, "no id"), (8, "word1 other1"), (9, line[30:140])]
    benchmark = spark.createDataFrame([(*x, "y") for x in items], "item_id bigint, text string, win string")
    for bits in (22, 4):
        got = decontaminate.contamination(corpus, benchmark, filter_bits=bits).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == contaminated(texts, items)
        assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)
    clean = decontaminate.clean(corpus, benchmark)
    assert clean.columns == corpus.columns
    assert clean.count() == sum(n for (_, _, hit, _), n in contaminated(texts, items).items() if not hit)
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(corpus, benchmark.limit(0)).where("contaminated").count() == 0


def base(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and spans.luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], spans.KINDS.index(s[2])))


def test_base_spans_against_the_patterns():
    chosen = random.Random(3)
    parts = ["1", "2", "0", "255", "256", ".", "..", "@", "a", "b.c", "-", " ", "+", "(", ")", "4111111111111111", "%", "é", "x@y.zz", "\n", "+1 (555) 555-1234", "1.2.3.4", "_", "/"]
    for _ in range(20000):
        text = "".join(chosen.choice(parts) for _ in range(chosen.randint(0, 12)))
        assert spans.base_spans(text) == base(text), repr(text)


def test_gradients_of_the_tagger():
    random_, tagger = np.random.default_rng(0), Tagger(5, 1)
    x, y = random_.integers(0, 100, (3, 7)), random_.integers(0, 5, (3, 7))
    _, gradient = tagger.loss(x, y)
    for name, weights in tagger.p.items():
        at = (x[0, 0], 3) if name == "E" else tuple(random_.integers(0, s) for s in weights.shape)
        old, sides = weights[at], []
        for step in (1e-5, -1e-5):
            weights[at] = old + step
            sides.append(tagger.loss(x, y)[0])
        weights[at] = old
        assert gradient[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)


@pytest.fixture(scope="module")
def tagger():
    chosen, labelled = random.Random(5), []
    for _ in range(150):
        digits = "".join(chosen.choice("0123456789") for _ in range(15))
        card = next(digits + c for c in "0123456789" if spans.luhn(digits + c))
        pool = [f"+1 ({chosen.randint(200, 999)}) 555-{chosen.randint(1000, 9999)}", f"{chosen.choice(['joe', 'ann', 'li'])}.{chosen.randint(1, 99)}@mail{chosen.randint(1, 9)}.example.com", ".".join(str(chosen.randint(1, 255)) for _ in range(4)), card, f"token {digits[:9]}"]
        text = f"some words before {chosen.choice(pool)} and some after it"
        labelled.append({"part": text, "spans": spans.written(spans.base_spans(text))})
    x, y = pii.examples(labelled, 600)
    made = Tagger(9)
    losses = made.train(x, y, 8)
    assert losses[-1] < 0.1 * losses[0]
    return made


def test_tagger_finds_what_the_patterns_label_and_more(tagger):
    for text in ("write to ann.77@mail3.example.com please", "from 10.20.30.40 again", "at +1 (321) 555-9876 today", "nothing here", "", "token 123456789"):
        own, every = pii.find_spans([text], tagger)[0]
        assert own == base(text) and set(own) <= set(every)
    assert pii.find_spans(["some words before (293) 555-9179 and some"], tagger)[0] == ([], [(18, 32, "phone")])


def test_windows_over_a_long_stretch_agree(tagger):
    text = " ".join(f"some words before +1 ({200 + i}) 555-9{i:03d} and some after it" for i in range(40))
    own, every = pii.find_spans([text], tagger)[0]
    assert len(own) == 40 and every == own
    path = tagger.decode(pii.scores(tagger, [text]))[0]
    assert len(set(pii.tagged(path)) & set(own)) >= 25


def test_personal_data_of_all_rows(corpus, empty, texts, tagger):
    found = pii.detect(corpus, tagger).collect()
    assert Counter((r["doc_id"], tuple((s["start"], s["end"], s["kind"]) for s in r["base"])) for r in found) == Counter((i, tuple(base(t or ""))) for i, t in texts)
    digests = pii.digests(pii.detect(corpus, None)).where("doc_id = 10").first()
    assert digests["spans"] == "email:11:23,ip:27:34" and digests["n_email"] == 1 and digests["n_ip"] == 1 and digests["n_card"] == 0
    assert pii.fit(empty) is None and pii.detect(empty, tagger).count() == 0


def repeated(text, window=8):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[k : k + window]) for k in range(len(words) - window + 1))
    hit = {k + j for k in range(len(words) - window + 1) if seen[tuple(words[k : k + window])] > 1 for j in range(window)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures_against_brute_force(texts):
    chosen = random.Random(1)
    made = ["".join(chosen.choice(["a ", "b ", "c\n", "# ", "\x0b", " ", "d|"]) for _ in range(chosen.randint(0, 80))) for _ in range(300)]
    for text in [t or "" for _, t in texts] + made:
        assert quality_rules.measures(text) == repeated(text)


def test_model_against_direct_kneser_ney(spark):
    """Probabilities of the stored model sum to one over the symbols, and match a direct computation."""
    texts = ["abcabd abca", "abab cab", "dabc abd a"] * 3 + ["bbcd"]
    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    model = perplexity.load_model(perplexity.train(df))
    grams = Counter(("\x02\x02\x02" + t)[k : k + 4] for t in texts for k in range(len(t)))
    counts = {4: grams}
    for size in (3, 2, 1):
        counts[size] = Counter(g[1:] for g in counts[size + 1])

    def discounts(size):
        t = [sum(n == k for n in counts[size].values()) for k in (1, 2, 3, 4)]
        if min(t) == 0:
            return [0.5, 1.0, 1.5]
        y = t[0] / (t[0] + 2 * t[1])
        return [max(0.05, min(k - 0.05, k - (k + 1) * y * t[k] / t[k - 1])) for k in (1, 2, 3)]

    def p(gram):
        size = len(gram)
        own = {g: n for g, n in counts[size].items() if g[:-1] == gram[:-1]}
        lower = p(gram[1:]) if size > 1 else 1 / (len(counts[1]) + 1)
        if not own:
            return lower
        d, total = discounts(size), sum(own.values())
        cut = lambda n: d[min(n, 3) - 1]
        n = own.get(gram, 0)
        return (n - cut(n) if n else 0) / total + sum(map(cut, own.values())) / total * lower

    for gram in [*list(grams)[:20], "abcz", "zzza", "zabc", "\x02\x02\x02d", "bcda"]:
        hashed = perplexity.grams([gram])[0][-1:]
        assert np.exp(model.logp("xx", hashed)[0]) == pytest.approx(p(gram), rel=1e-4), gram
    for context in ("abc", "ab ", "zzz"):
        assert sum(p(context + c) for c in counts[1]) == pytest.approx(1 - (p(context + "\x01")), rel=1e-6)


def test_rules_and_bands(spark, corpus, empty, texts):
    judged = quality_rules.judge(corpus).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(tuple(r[c] for c in columns) for r in judged) == Counter((i, *repeated(t or "")) for i, t in texts)
    for r in judged:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(empty).count() == 0
    chosen = random.Random(2)
    common = [" ".join(chosen.choice(["river", "stone", "light", "meadow", "winter", "quiet", "morning"]) for _ in range(60)) for _ in range(150)]
    odd = " ".join("".join(chosen.choice("qxzjvkw#~^") for _ in range(7)) for _ in range(60))
    df = spark.createDataFrame([*enumerate(common), (999, odd)], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    kept = {r["doc_id"] for r in quality_rules.judge(df).where("kept").collect()}
    assert kept == set(range(150))


def test_ranking_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = ranking.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found["doc_id"]]).all()
    assert ((found["score"] >= 0.3).astype(int) == found["predicted"]).all() and found["score"].between(0, 1).all()
    rest = found[found["held_out"]]
    good, bad = ranking.accuracy(rest["quality"].to_numpy(), rest["predicted"].to_numpy())
    assert good > 0.9 and (not (rest["quality"] == 0).any() or bad > 0.8)


def test_ranking_of_odd_tables(spark, corpus, empty, texts):
    labels = spark.createDataFrame([(1, 1, "z"), (2, 1, "z"), (13, 0, "z"), (12, 0, "z"), (12, 1, "z"), (None, 0, "z"), (4, None, "z"), (777, 0, "z")], "doc_id bigint, quality int, score string")
    got = ranking.classify(corpus, labels)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(i for i, _ in texts)
    assert ranking.classify(corpus, labels.limit(0)).where("predicted = 0").count() == 0
    assert ranking.classify(empty, labels).count() == 0
    scored = ranking.score(corpus, ranking.fit(corpus, labels))
    assert scored.columns == [*(c for c in corpus.columns if c != "score"), "score"]


def test_ranking_learns_from_every_labelled_document(spark, monkeypatch):
    """Counts, mean, weights and threshold against a computation over all labelled documents at once."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where("quality in (0, 1)")
    monkeypatch.setattr(ranking, "GROUP", 1 << 30)
    ranker = ranking.fit(docs, labels)
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id").where(~ranking.held_out(F.col("doc_id"))).toPandas()
    x, y = np.array([ranking.features(t) for t in rows["text"]]), rows["quality"].to_numpy()
    assert ranker.mean == pytest.approx(x.mean(axis=0)) and ranker.scale == pytest.approx(x.std(axis=0) + 1e-6, rel=1e-3, abs=1e-6)
    raw = ranker.raw(x)
    assert ranker.threshold == pytest.approx(np.quantile(raw, np.mean(y == 0))) and ranker.spread == pytest.approx(raw.std() / 4, rel=1e-4)
    z = (x - ranker.mean) / ranker.scale
    pairs = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, x.shape[1])
    slope = 1e-3 * ranker.weights - (1 / (1 + np.exp(pairs @ ranker.weights))) @ pairs / len(pairs)
    assert np.abs(slope).max() < 1e-5


def test_ranking_spreads_a_rare_label_over_all_groups(spark, monkeypatch):
    monkeypatch.setattr(ranking, "GROUP", 8)
    shapes = spark.createDataFrame([(i, int(i % 100 > 0), [float(i)]) for i in range(400)], "doc_id bigint, quality int, x array<double>")
    groups = ranking._groups(shapes, 396, 4).collect()
    assert len(groups) == 50 and all(g["y"].count(0) == 4 for g in groups)
    assert {int(v) for g in groups for v in g["x"]} == set(range(400))
