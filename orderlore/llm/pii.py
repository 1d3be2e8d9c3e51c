"""Personal data: base patterns and a character-level BiLSTM-CRF tagger (operator 6).

The base patterns find spans in their standard form. A tagger learns from these labelled spans, in the contexts in which the
corpus has them and in other spellings (no plus sign, other separators), and proposes further spans. It reads the text
around every digit and at-sign, without which no kind of span exists, in overlapping windows. The emission scores of
all windows over a stretch are averaged, with more weight the farther a character is from a window's edge, and the whole
stretch is decoded at once. A proposed span counts if its digits or parts satisfy its kind and it touches no base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlore.llm.spans import KINDS, base_spans, luhn, written
from orderlore.llm.tagger import Tagger, symbols

SAMPLE, WINDOWS, EPOCHS = 2000, 1536, 10
LENGTH, STRIDE, MARGIN = 64, 32, 24
_ANCHOR = re.compile("[0-9@]+")
_HOST = re.compile(r"[^\s@]+@[^\s@]+\.[^\s@.]+")


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text that hold all its digits and at-signs with MARGIN characters on both sides; close ones are one."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def valid(kind: str, text: str) -> bool:
    """Whether a proposed span can be of its kind."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == "email":
        return bool(_HOST.fullmatch(text))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and not re.search("[A-Za-z]", text)


def labelled_stretches(docs: DataFrame, size: int = SAMPLE) -> list[dict]:
    """At most `size` stretches with their base spans: those with the smallest hash of document and place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"doc_id": [], "at": [], "part": [], "spans": []}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                spans = base_spans(text)
                for a, b in stretches(text):
                    b = min(b, a + 4 * LENGTH)
                    own = [(s - a, e - a, k) for s, e, k in spans if a <= s and e <= b]
                    for key, value in zip(found, (doc_id, a, text[a:b], written(own))):
                        found[key].append(value)
            yield pa.RecordBatch.from_pydict(found, pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("part", pa.string()), ("spans", pa.string())]))

    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = text.mapInArrow(rows, "doc_id bigint, at bigint, part string, spans string")
    chosen = parts.orderBy(F.xxhash64("doc_id", "at", "part"), "part").limit(size).toArrow()
    return sorted(chosen.to_pylist(), key=lambda r: (r["part"], r["spans"]))


def _respelled(kind: str, text: str, random: np.random.Generator) -> str:
    """Another spelling of a span."""
    way = random.integers(4)
    if kind == "phone":
        if way == 0:
            return text
        plain = text.lstrip("+") if way > 1 else text
        return re.sub(r"[ ().-]+", " .-/"[random.integers(4)], plain).strip(" .-/") if way == 3 else plain
    if kind == "card" and way == 3:
        digits = re.sub("[^0-9]", "", text)
        return " -./"[random.integers(4)].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return text.upper() if kind == "email" and way == 3 else text


def examples(labelled: list[dict], size: int = WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tag rows (0 none, then first and further characters of each kind), half of them respelled."""
    random, xs, ys = np.random.default_rng(seed), [], []
    with_spans = [r for r in labelled if r["spans"]]
    without = [r for r in labelled if not r["spans"]]
    for i in range(size if with_spans else 0):
        pool = without if without and i % 4 == 0 else with_spans
        row = pool[random.integers(len(pool))]
        spans = [s.split(":") for s in filter(None, row["spans"].split(","))]
        text, tags, at = "", [], 0
        for kind, a, b in sorted(spans, key=lambda s: int(s[1])):
            a, b = int(a), int(b)
            if a < at:
                continue
            piece = row["part"][a:b]
            piece = _respelled(kind, piece, random) if random.random() < 0.5 else piece
            first = 1 + 2 * KINDS.index(kind)
            text, tags = text + row["part"][at:a] + piece, tags + [0] * (a - at) + [first] + [first + 1] * (len(piece) - 1)
            at = b
        text, tags = text + row["part"][at:], tags + [0] * (len(row["part"]) - at)
        start = random.integers(max(1, len(text) - LENGTH + 1))
        own = symbols(text)[start : start + LENGTH]
        xs.append(np.pad(own, (0, LENGTH - len(own))))
        ys.append(np.pad(np.array(tags[start : start + LENGTH], np.int64), (0, LENGTH - len(own))))
    return np.array(xs).reshape(len(xs), LENGTH), np.array(ys).reshape(len(ys), LENGTH)


def fit(docs: DataFrame, size: int = SAMPLE, windows: int = WINDOWS, epochs: int = EPOCHS) -> Tagger | None:
    """Tagger trained on at most `size` labelled stretches; none if the corpus has no base span."""
    x, y = examples(labelled_stretches(docs, size), windows)
    if not len(x):
        return None
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.train(x, y, epochs)
    return tagger


def scores(tagger: Tagger, parts: list[str], block: int = 256) -> list[np.ndarray]:
    """Emission scores of every character of each part, averaged over the overlapping windows."""
    weight = np.minimum(np.arange(1, LENGTH + 1), np.arange(LENGTH, 0, -1)).astype(float)
    places, rows = [], []
    for i, part in enumerate(parts):
        own = symbols(part)
        for start in range(0, max(1, len(own) - LENGTH + STRIDE), STRIDE):
            piece = own[start : start + LENGTH]
            places.append((i, start, len(piece)))
            rows.append(np.pad(piece, (0, LENGTH - len(piece))))
    sums = [np.zeros((len(p), tagger.tags)) for p in parts]
    weights = [np.zeros((len(p), 1)) for p in parts]
    for at in range(0, len(rows), block):
        emitted = tagger.emissions(np.array(rows[at : at + block]))
        for (i, start, n), e in zip(places[at : at + block], emitted):
            sums[i][start : start + n] += e[:n] * weight[:n, None]
            weights[i][start : start + n] += weight[:n, None]
    return [s / w for s, w in zip(sums, weights)]


def tagged(path: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of a row of tags."""
    out, start, kind = [], -1, -1
    for at, tag in enumerate([*path.tolist(), 0]):
        own = (tag - 1) // 2 if tag else -1
        if start >= 0 and (own != kind or tag % 2):
            out.append((start, at, KINDS[kind]))
            start = -1
        if tag and start < 0:
            start, kind = at, own
    return out


def find_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    if tagger is None:
        return [(b, b) for b in base]
    where = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    paths = tagger.decode(scores(tagger, [texts[i][a:b] for i, a, b in where]))
    added: list[list] = [[] for _ in texts]
    for (i, a, _), path in zip(where, paths):
        for s, e, kind in tagged(path):
            span = (a + s, a + e, kind)
            if valid(kind, texts[i][span[0] : span[1]]):
                added[i].append(span)
    out = []
    for own, more in zip(base, added):
        # characters of base spans, counted up to each place, tell in one step whether a span touches any
        taken = np.zeros(max([e for _, e, _ in own + more], default=0) + 1, np.int64)
        for s, e, _ in own:
            taken[s:e] = 1
        upto = np.concatenate([[0], np.cumsum(taken)])
        free = [x for x in more if upto[x[1]] == upto[x[0]]]
        out.append((own, sorted(own + free, key=lambda x: (x[0], KINDS.index(x[2])))))
    return out


def detect(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, base (array of kind, start, end; code points, end exclusive) and spans (base and added) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = find_spans(part.column("text").to_pylist(), model.value)
                columns = [pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in f[i]] for f in found], kind) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "base", "spans"])

    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return text.mapInArrow(rows, f"doc_id bigint, base {spans}, spans {spans}")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data of every row, with a tagger trained on the documents given.

    Null texts are empty and have no spans; null and repeated ids keep one row per input row; an empty table, or one
    without any base span, trains nothing and adds nothing; other columns are ignored.
    """
    return detect(docs, fit(docs))


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""

    def text(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
