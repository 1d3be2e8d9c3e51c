"""Operators 11 to 13 against brute force, on corpora with nulls, ties, repeats and hot groups."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from orderlore.llm import prefix_trie, vector_codes, warc
from orderlore.llm.tables import filesystem

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, node string, depth int"
PAGES = "page_id bigint, url string, html string, digest int, rid string"
VECTORS = "vec_id bigint, embedding array<float>, label int, code string, sums int"


def trie_by_hand(rows, group=20):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn, role or "", text or ""))

    def order(t):
        return (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest())

    own = {c: [t[1:] for t in sorted(v, key=order)] for c, v in convs.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, group)), [])[:h] + turns[h:]
    members, children, sums = {}, {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for n in members:
        if n:
            children.setdefault(n[:-1], []).append(n)
    for n in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children.get(n, [])]
        words = len(re.findall(r"[^\x20\x09-\x0d]+", n[-1][1])) if n else 0
        sums[n] = (sum(x for x, _ in below) or 1, sum(y for _, y in below) + (len(members[n]) - 1) * words)
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n))
        parent = min(members[n[:-1]]) if n else None
        out.append((min(m), len(n), parent, len(m), len(children.get(n, [])), *sums[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


@pytest.fixture(scope="module")
def conversations():
    made = random.Random(3)
    said = ["a b", "a  c", "", None, "été x", "long " * 3000]
    rows = [(c, t, made.choice(["user", "bot", None]), made.choice(said)) for c in range(60) for t in range(made.randint(1, 6))]
    rows += [(c, t, "user", "the same") for c in range(200, 420) for t in range(3)]  # exact copies
    rows += [(c, 0, "user", "first turn") for c in range(500, 620)] + [(c, 1, "user", str(c)) for c in range(500, 620)]
    rows += [(1001, t, "user", str(t % 7)) for t in range(900)] + [(1002, t, "user", str(t % 7)) for t in range(900)]  # long ones
    rows += [(3, None, "user", "null first"), (None, 1, "user", "no conversation"), (7, 1, "bot", "tie"), (7, 1, "bot", "tie"), (7, 1, None, "tie"), (-45, 0, "user", "x")]
    rows += [(761, 0, "u", "few")]  # no first conversation of its group
    return rows


def _trie(df, **layout):
    found = prefix_trie.prefix_trie(df, **layout).drop("node").collect()
    return sorted((tuple(r) for r in found), key=lambda r: r[:2])


@pytest.mark.parametrize("layout", [{}, {"crowd": 3, "span": 50, "queue": 5}])
def test_trie(spark, conversations, layout):
    df = spark.createDataFrame([(*r, "x", 1) for r in conversations], CONVERSATIONS)
    assert _trie(df, **layout) == trie_by_hand(conversations)


def test_trie_of_nothing(spark):
    assert _trie(spark.createDataFrame([], CONVERSATIONS)) == []
    assert _trie(spark.createDataFrame([(None, 1, "user", "x", "", 0)], CONVERSATIONS)) == []


def test_long_conversation_spans_tasks(spark):
    rows = [(5, t, "user", f"turn {t}", "", 0) for t in range(3000)]
    turns = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("conv_id conv", "turn", "unhex(md5(text)) key")
    rolled = prefix_trie.roll(turns, ["turn"])
    assert len(rolled.select("conv").rdd.glom().filter(len).collect()) > 1
    value, want = 0, {}
    for t in range(3000):
        value = (value * prefix_trie.BASE + int.from_bytes(hashlib.md5(f"turn {t}".encode()).digest(), "big")) % prefix_trie.PRIME
        want[t] = (t + 1, value)
    assert {r["turn"]: (r["place"], int.from_bytes(r["node"], "big")) for r in rolled.collect()} == want


def test_queue_spills_and_adds_up():
    made, queue, want = random.Random(1), prefix_trie.SpillingQueue(10), {}
    for _ in range(500):
        rank, node = made.randint(-3, 3), bytes([made.randint(0, 9)]) * 16
        queue.push(rank, node, 1, 2, 3)
        want[rank, node] = want.get((rank, node), 0) + 1
    assert len(queue.runs) > 1
    for (rank, node), n in sorted(want.items()):
        assert queue.take(rank, node) == (n, 2 * n, 3 * n)
    assert queue.take(4, bytes(16)) == (0, 0, 0)


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max(len(r[1]) for r in kept)
    x = np.zeros((len(kept), -(-longest // parts) * parts), np.int64)
    for i, r in enumerate(kept):
        x[i, : len(r[1])] = np.floor(1024 * np.array(r[1], np.float32).astype(np.float64))
    x = x.reshape(len(kept), parts, -1)
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [x[first, p].copy() for p in range(parts)]

    def nearest():
        squares = [((x[:, p, None] - books[p]) ** 2).sum(2) for p in range(parts)]
        return [s.argmin(1) for s in squares], sum(s.min(1) for s in squares)

    for _ in range(rounds):
        code, _ = nearest()
        for p in range(parts):
            for e in range(len(first)):
                if (code[p] == e).any():
                    books[p][e] = x[code[p] == e, p].sum(0) // (code[p] == e).sum()
    code, error = nearest()
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1)).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{code[p][i]:02x}" for p in range(parts)), int(error[i]), by_label[r[2]], digest) for i, r in enumerate(kept)), key=repr)


def _codes(spark, rows, b=None, **sizes):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], VECTORS).repartition(5)
    return sorted((tuple(r) for r in vector_codes.digests(*vector_codes.compress(df, b=b, **sizes)).collect()), key=repr)


@pytest.mark.parametrize("b", [None, 1, 6])
def test_codes(spark, b):
    made = np.random.default_rng(5)
    rows = [(i, made.normal(size=13).round(2).tolist(), int(made.integers(4)) if i % 9 else None) for i in range(700)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(300)]  # one very common vector
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")], 2), (2003, [float("inf")], None), (2004, [], 3), (2005, [0.5], 3)]
    rows += [(8, rows[8][1], 2), (None, [0.25] * 13, 1)]  # a repeated row, a null id
    assert _codes(spark, rows, b, entries=40) == codes_by_hand(rows, entries=40)


def test_codes_on_a_grid_of_ties(spark):
    rows = [(i, [float(i % 3), float(i // 3 % 3), 0.0, 0.0] * 4, i % 2) for i in range(200)]
    assert _codes(spark, rows, 2) == codes_by_hand(rows)


def test_codes_of_large_components(spark):
    rows = [(i, [(-1) ** i * 60000.0 + i, i * 37.5, 0.0, 1e4], 0) for i in range(120)]
    assert _codes(spark, rows, entries=10) == codes_by_hand(rows, entries=10)
    with pytest.raises(ValueError, match="too large"):
        _codes(spark, [(1, [1e30], 0)])


def test_codes_of_nothing(spark):
    assert _codes(spark, [(1, None, 0)]) == []
    found, books = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert found.count() == 0 and books.shape[1] == 0


def test_bounds_spare_distances(spark):
    """In later rounds few parts need all entries, and b follows."""
    made = np.random.default_rng(7)
    rows = [(i, (made.normal(size=16) + 20 * (i % 5)).tolist(), 0, "", 0) for i in range(1000)]
    x = np.floor(1024 * np.array([r[1] for r in rows])).astype(np.int64)[:, :4]
    book = x[:16].copy()
    state = vector_codes._ranked(x, book, 5, True)
    moved = book + 1
    moves = np.sqrt(((moved - book) ** 2).sum(1).astype(float))
    code, error, near, low, outer, needed = vector_codes._settle(x, moved, moves, state[0], *state[2:], 5, True)
    squares = ((x[:, None] - moved) ** 2).sum(2)
    assert (code == squares.argmin(1)).all() and (error == squares.min(1)).all()
    assert (needed == 0).mean() > 0.8 and (needed > 5).mean() < 0.05
    true = np.sqrt(squares.astype(float))
    assert (low <= np.take_along_axis(true, near.astype(int), 1)).all()


def archive_by_hand(rows, least=0):
    first = {}
    for page, _, html in rows:
        first[html or ""] = min(first.get(html or "", (True, 0)), (page is None, page or 0))
    seen, out = set(), []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = html in seen if html else "" in seen
        revisit = revisit and len(payload) >= least
        seen.add(html or "")
        none, page_id = first[html or ""]
        out.append((page, len(payload), digest, "revisit" if revisit else "response", page_id if revisit and not none else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages():
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(300)]
    rows += [(1000 + i, None, "<b>copy</b>") for i in range(150)] + [(5, "http://a/5", "<p>5</p>" * 5), (5, "x\r\ny: z", "<b>copy</b>")]
    return rows + [(None, "u", "<i>no id</i>"), (None, "u", "<i>no id</i>"), (2000, "u", None), (2001, "u", ""), (2002, "ü", "€\r\n\r\nWARC/1.1\r\n" * 40000)]


@pytest.mark.parametrize("least", [0, 100])
def test_archives(spark, pages, least):
    df = spark.createDataFrame([(*r, 1, "x") for r in pages], PAGES).repartition(4, "page_id")
    index, folder = warc.write_archives(df, least_bytes=least, frame_bytes=2000, bundle_bytes=4000)
    assert sorted((tuple(r) for r in warc.read_back(index, folder).collect()), key=repr) == archive_by_hand(pages, least)
    assert index.select("record_id").distinct().count() == len(pages)
    by_page = {r["page_id"]: r for r in warc.read_archives(index, folder).collect()}
    assert by_page[2002]["payload"].decode() == pages[-1][2] and by_page[2002]["url"] == "ü"
    # any reader of Zstandard unpacks a bundle, the seek table being a skippable frame
    files, place = filesystem(folder)
    row = index.groupBy("bundle").agg({"size": "sum"}).first()
    with files.open_input_file(f"{place}/{row['bundle']}") as file:
        data = file.read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(whole) == row["sum(size)"] and whole.startswith(b"WARC/1.1\r\n")


def test_records_by_name(spark, pages):
    df = spark.createDataFrame([(*r, 1, "x") for r in pages], PAGES)
    index, folder = warc.write_archives(df, frame_bytes=500)
    wanted = index.orderBy("record_id").limit(9)
    asked = wanted.select("record_id").union(wanted.select("record_id")).union(spark.createDataFrame([("none",)], "record_id string"))
    found = warc.read_records(index, folder, asked).collect()
    assert sorted(r["record_id"] for r in found) == sorted(r["record_id"] for r in wanted.collect())


def test_a_changed_payload_is_noticed():
    record = b"".join(warc._record("<urn:x>", 1, "u", warc._digest(b"abc"), b"abd", None, warc.WHEN))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(record, 0, True)


def test_archives_of_nothing(spark):
    index, folder = warc.write_archives(spark.createDataFrame([], PAGES))
    assert index.count() == 0 and warc.read_back(index, folder).count() == 0
