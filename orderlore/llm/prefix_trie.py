"""Prefix trie of conversations by time-forward processing (operator 11).

A node is named by a rolling 127-bit value over the digests of its turns, so the value of a whole conversation can be put
together from those of its pieces. Turns are dealt by ranges of (conversation, place): a conversation of very many turns
spans several tasks, each of which rolls its own piece, and one row a task carries the value on to the next.

Subtree totals go up the trie without following pointers. Nodes are sorted by falling depth (Spark's external sort); a
node takes the messages addressed to it from a priority queue, adds its own figures and sends the sum to its parent, which
comes later in that order. The queue writes sorted runs to disk beyond a bound. A shard is a subtree that at most
`crowd` conversations enter; it is passed by one task with others of its kind. What the roots of the shards send is added up for
each receiver, and a last pass takes it through the nodes above them, of which there are few: more than `crowd`
conversations enter each. Conversations of over `span` turns are passed in bands of levels, from the deepest.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlore.llm.tables import stored

GROUP, LEAST_CROWD, SPAN, QUEUE, CHUNK = 20, 32, 1 << 14, 200_000, 4096
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big")
ROOT = bytes(16)
_WORD = r"[^\x20\x09-\x0D]+"
_ENTRY = struct.Struct(">q16s3q")
_STEP = "depth bigint, node binary, shard binary, conv_id bigint, parent binary, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, sent boolean"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """Sums for receivers, least (rank, node) first. Beyond `limit` entries the heap goes to disk as a sorted run, in
    which entries of one receiver are added up; runs are merged as they are read."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.fronts, self.runs = limit, [], [], []

    def push(self, rank: int, node: bytes, *sums: int) -> None:
        heapq.heappush(self.heap, (rank, node, *sums))
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        run = tempfile.TemporaryFile()  # noqa: SIM115  goes when it is closed, at the end of the task at the latest
        last: list = []
        for entry in sorted(self.heap):
            if last and tuple(last[:2]) == entry[:2]:
                last[2:] = [a + b for a, b in zip(last[2:], entry[2:])]
                continue
            if last:
                run.write(_ENTRY.pack(*last))
            last = list(entry)
        run.write(_ENTRY.pack(*last))
        run.seek(0)
        self.heap = []
        self.runs.append(run)
        self._advance(len(self.runs) - 1)

    def _advance(self, run: int) -> None:
        if data := self.runs[run].read(_ENTRY.size):
            heapq.heappush(self.fronts, (_ENTRY.unpack(data), run))
        else:
            self.runs[run].close()

    def take(self, rank: int, node: bytes) -> tuple[int, int, int]:
        """The sums of all that was sent to one receiver."""
        found = (0, 0, 0)
        while self.heap and self.heap[0][:2] == (rank, node):
            found = tuple(a + b for a, b in zip(found, heapq.heappop(self.heap)[2:]))
        while self.fronts and self.fronts[0][0][:2] == (rank, node):
            entry, run = heapq.heappop(self.fronts)
            found = tuple(a + b for a, b in zip(found, entry[2:]))
            self._advance(run)
        return found


def _bytes(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _roll_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place, node and parent of each turn, as if its task's first turn began a conversation."""
    part, conv, place, value = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        places, nodes, parents = [], [], []
        for c, key in zip(batch.column("conv").to_pylist(), batch.column("key").to_pylist()):
            if c != conv:
                conv, place, value = c, 0, 0
            parents.append(_bytes(value))
            place, value = place + 1, (value * BASE + int.from_bytes(key, "big")) % PRIME
            places.append(place)
            nodes.append(_bytes(value))
        own = [pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "part", "place", "node", "parent"])


def _carried(rolled: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Conversation, places and value that each task takes over from those before it; tasks that begin afresh have none."""
    ends = rolled.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "place", "node")).alias("last"))
    found, conv, place, value = {}, None, 0, 0
    for row in ends.orderBy("part").collect():  # one row a task
        end, here = row["last"], int.from_bytes(row["last"]["node"], "big")
        if row["first"] == conv:
            found[row["part"]] = (conv, place, value)
        if end["conv"] == conv:
            place, value = place + end["place"], (value * pow(BASE, end["place"], PRIME) + here) % PRIME
        else:
            conv, place, value = end["conv"], end["place"], here
    return found


def _join_pieces(carried: dict[int, tuple[int, int, int]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if any(p in carried for p in batch.column("part").unique().to_pylist()):
                place, node, parent, out = (batch.schema.get_field_index(n) for n in ("place", "node", "parent", "conv"))
                columns = [c.to_pylist() if i in (place, node, parent, out) else c for i, c in enumerate(batch.columns)]
                for i, part in enumerate(batch.column("part").to_pylist()):
                    conv, before, value = carried.get(part, (None, 0, 0))
                    if columns[out][i] == conv:
                        n = columns[place][i]
                        columns[parent][i] = _bytes((value * pow(BASE, n - 1, PRIME) + int.from_bytes(columns[parent][i], "big")) % PRIME)
                        columns[node][i] = _bytes((value * pow(BASE, n, PRIME) + int.from_bytes(columns[node][i], "big")) % PRIME)
                        columns[place][i] = before + n
                batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) if isinstance(c, list) else c for c, t in zip(columns, batch.schema)], batch.schema.names)
            yield batch

    return rows


def roll(turns: DataFrame, order: list[str]) -> DataFrame:
    """Adds place (from 1), node and parent to turns (conv, key and others), which are ordered by `order` within conv."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartitionByRange(parts, "conv", *order).sortWithinPartitions("conv", *order)
    schema = ", ".join(f"{n} {t}" for n, t in turns.dtypes) + ", part int, place bigint, node binary, parent binary"
    rolled = stored(dealt.mapInArrow(_roll_pieces, schema), "trie-turns")
    carried = _carried(rolled)
    return (stored(rolled.mapInArrow(_join_pieces(carried), schema), "trie-turns") if carried else rolled).drop("part")


def rebuilt(conversations: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """All conversation ids (conv), and the turns of the rebuilt conversations: conv, words, place, node, parent."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text))))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), "turn", key.alias("key"), F.regexp_count(text, F.lit(_WORD)).cast("bigint").alias("words"))
    own = roll(turns, ["turn", "key"]).select("conv", "key", "words", "place")
    shared = F.when(F.col("conv") % group == 0, F.lit(0)).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % 4)
    own = own.withColumn("shared", shared)
    convs = own.where("place = 1").select("conv", "shared")
    heads = own.where("place <= 3").select(F.col("conv").alias("base"), "key", "words", "place")
    taken = convs.where("shared > 0").withColumn("base", F.col("conv") - F.col("conv") % group)
    taken = taken.join(heads, "base").where("place <= shared").select("conv", F.col("place").alias("at"), "key", "words")
    kept = own.where("place > shared").select("conv", (F.col("place") + 3).alias("at"), "key", "words")
    return convs.select("conv"), roll(taken.union(kept), ["at"]).select("conv", "words", "place", "node", "parent")


def _pass_totals(span: int, low: bool, queue: int):
    """One task's part of a pass: rows by falling depth, messages from earlier passes before the node they are for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, schema = SpillingQueue(queue), None
        for batch in batches:
            schema, out = batch.schema, []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                depth, node, shard, conv_id, parent, n_convs, children, leaves, saved, sent = r
                if sent:
                    waiting.push(-depth, node, children, leaves, saved)
                    continue
                got = waiting.take(-depth, node)
                children, leaves, saved = got[0], got[1] or 1, got[2] + saved
                out.append((depth, node, shard, conv_id, parent, n_convs, children, leaves, saved, False))
                if depth == 0:
                    continue
                top = not low or node == shard
                if top == (not low) and (depth - 1) // span == depth // span:
                    waiting.push(1 - depth, parent, 1, leaves, saved)
                else:
                    out.append((depth - 1, parent, None if top else shard, None, None, None, 1, leaves, saved, True))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema.names)

    return rows


def _subtrees(nodes: DataFrame, deepest: int, span: int, queue: int) -> DataFrame:
    """The columns of _STEP for all nodes; `shard` is null for those above the shards."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("depth").desc(), "node", F.col("sent").desc()]
    names = [c.split()[0] for c in _STEP.split(", ")]
    done, messages = [], None
    for band in range(deepest // span, -1, -1):
        for low in (True, False):
            own = nodes.where((F.floor(F.col("depth") / span) == band) & (F.col("shard").isNotNull() == low))
            if messages is not None:
                own = own.unionByName(messages.where((F.floor(F.col("depth") / span) == band) & (F.col("shard").isNotNull() == low)))
            dealt = own.repartition(parts, "shard") if low else own.repartition(1)
            out = stored(dealt.select(names).sortWithinPartitions(*order).mapInArrow(_pass_totals(span, low, queue), _STEP), "trie-pass")
            done.append(out.where("not sent"))
            # a receiver with very many children gets one row a task before anything is dealt out
            new = out.where("sent").groupBy("depth", "node", "shard").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
            new = new.selectExpr("depth", "node", "shard", "cast(null as bigint) conv_id", "cast(null as binary) parent", "cast(null as bigint) n_convs", "n_children", "n_leaves", "saved_tokens", "true sent")
            messages = new if messages is None else messages.unionByName(new)
    total = done[0]
    for more in done[1:]:
        total = total.unionByName(more)
    return total


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node over its chunks, which come in order; only the running digest is held."""
    node, digest = None, None
    for batch in batches:
        out = []
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if n == node:
                digest.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append((node, digest.hexdigest()))
            node, digest = n, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pydict({"node": [n for n, _ in out], "ends_sha256": [d for _, d in out]}, pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [digest.hexdigest()]}, pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))


def _ends(rows: DataFrame) -> DataFrame:
    """node and the digest of the ids of the conversations that end there, for nodes where any does."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = rows.groupBy("conv").agg(F.max(F.struct("depth", "node")).alias("end"))
    chunk = F.floor(F.col("conv") / CHUNK).alias("chunk")  # ids are distinct, so a chunk is bounded
    chunks = last.groupBy(F.col("end.node").alias("node"), chunk).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    dealt = chunks.repartition(parts, "node").sortWithinPartitions("node", "chunk").select("node", "ids")
    return dealt.mapInArrow(_hash_ends, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, crowd: int | None = None, span: int = SPAN, queue: int = QUEUE) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and node, the node's name.

    Conversations are rebuilt from the first turns of their group's first one. Turns are ordered by turn, null first; equal turns
    of one conversation by the digest of role and text, so repeated rows count as turns of their own. Null roles and
    texts are empty; rows without a conv_id belong to no conversation and are left out. `%` keeps the sign of a negative id.
    A conversation without turns ends at the root. An empty table gives no node. Other columns are ignored. `crowd`
    (by default an eighth of what a task has on average), `span` and `queue` change the work's layout, never the result.
    """
    spark = conversations.sparkSession
    convs, turns = rebuilt(conversations, group)
    roots = convs.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("words"))
    rows = stored(turns.select("conv", F.col("place").alias("depth"), "node", "parent", "words").union(roots), "trie-rows")
    nodes = rows.groupBy("node", "depth").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("words").alias("words"))
    nodes = stored(nodes, "trie-nodes")
    many, deepest = nodes.agg(F.max("n_convs"), F.max("depth")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    crowd = crowd or max(LEAST_CROWD, (many or 0) // (8 * parts))
    crowded = nodes.where(F.col("n_convs") > crowd).select("node", F.lit(True).alias("crowded"))
    # the first node of each conversation that few enter is the root of its shard
    cuts = rows.join(crowded, "node", "left").where("crowded is null").groupBy("conv").agg(F.min(F.struct("depth", "node")).alias("cut"))
    cuts = stored(cuts.select(F.col("conv").alias("conv_id"), F.col("cut.node").alias("shard")), "trie-shards")
    figures = ["depth", "node", "shard", "conv_id", "parent", "n_convs", "0L n_children", "0L n_leaves", "(n_convs - 1) * words saved_tokens", "false sent"]
    low = nodes.where(F.col("n_convs") <= crowd).join(cuts, "conv_id").selectExpr(figures)
    above = nodes.where(F.col("n_convs") > crowd).withColumn("shard", F.lit(None).cast("binary")).selectExpr(figures)
    placed = stored(low.unionByName(above), "trie-placed")
    totals = _subtrees(placed, deepest or 0, span, queue)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = totals.join(parents, "parent", "left").join(stored(_ends(rows), "trie-ends"), "node", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"), "node")
