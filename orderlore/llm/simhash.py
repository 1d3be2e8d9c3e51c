"""SimHash near-duplicates by pigeonhole blocks (operator 4).

A fingerprint of 64 bits is cut into four blocks of 16. Two fingerprints that differ in at most two bits agree on at least
two whole blocks, so they meet in one of six tables, each keyed by a pair of blocks (32 bits). Pairs that meet are
verified by their Hamming distance. Equal fingerprints are folded before anything is joined.

A table's bucket may hold very many different fingerprints, as the variants of one text do. Buckets of more than
`crowd` fingerprints are not joined with themselves: each of their fingerprints stands under every value at distance one
or less (only the 32 bits outside the two shared blocks can differ). Two fingerprints differ in at most two bits exactly
if they stand under a common value, and all that stand under one value differ in at most two bits. So tying each to the
smallest under every value gives the same components with a number of rows in proportion to the bucket, not to its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlore.llm.components import components
from orderlore.llm.tables import LOWER, UPPER, stored, text_key

SEED, SHINGLE, DISTANCE, CROWD = 42, 3, 2, 256
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BLOCKS = [0xFFFF << (16 * i) for i in range(4)]
_TABLES = [sum(pair) for pair in combinations(_BLOCKS, 2)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text as an unsigned integer; 0 for a text without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((digest(s, SEED) for s in joined), ">u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key and fingerprint (its 64 bits as a signed bigint) of every row; a null text counts as empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [fingerprint(t.as_py() or "", shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(np.array(bits, np.uint64).view(np.int64))], ["doc_id", "key", "fingerprint"])

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    return keyed.mapInArrow(rows, "doc_id bigint, key binary, fingerprint bigint")


def _buckets(distinct: DataFrame) -> DataFrame:
    """Each fingerprint under its six keys, with the number of fingerprints under the key; lone ones are dropped."""
    keys = F.array(*[F.struct(F.lit(t).alias("mask"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(_TABLES)])
    keyed = distinct.select("f", F.explode(keys).alias("k")).select("f", "k.mask", "k.key")
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    return stored(keyed.join(sizes, ["mask", "key"]), "simhash-buckets")


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs a, b of different fingerprints (column f) that connect all that differ in two bits or fewer."""
    buckets = _buckets(distinct)
    small = buckets.where(F.col("n") <= crowd).select("mask", "key", "f")
    other = small.withColumnRenamed("f", "g")
    near = (F.col("f") < F.col("g")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= DISTANCE)
    met = small.join(other, (small["mask"] == other["mask"]) & (small["key"] == other["key"]) & near)
    pairs = met.select(F.col("f").alias("a"), F.col("g").alias("b")).distinct()

    crowded = buckets.where(F.col("n") > crowd)
    free = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in _TABLES])
    under = crowded.select("f", F.explode(F.element_at(free, F.col("mask") + 1)).alias("bit")).select("f", F.col("f").bitwiseXOR(F.col("bit")).alias("value")).distinct()
    least = under.groupBy("value").agg(F.min("f").alias("least"), F.count("*").alias("n")).where("n > 1")
    tied = under.join(least, "value").where("f <> least").select(F.col("least").alias("a"), F.col("f").alias("b"))
    return pairs.union(tied.distinct())


def _grouped(docs: DataFrame, shingle: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the rows, and the root fingerprint of each distinct one with the smallest doc_id that has it."""
    marked = stored(fingerprints(docs, shingle), "simhash")
    distinct = stored(marked.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct.select("f"), crowd))
    return marked, distinct.join(roots, distinct["f"] == roots["node"], "left").select("f", "first_id", F.coalesce("root", "f").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (signed bigint) and component_id, the smallest doc_id reachable over links, of every row.

    Words are split at ASCII white space after A-Z is lowered; a text of fewer than `shingle` words is one shingle;
    null and empty texts have fingerprint 0 and are linked like any other. Rows with equal ids each keep their row; a
    null id never names a component (a component of null ids only has a null component_id). An empty table gives an
    empty result; other columns are ignored.
    """
    marked, rooted = _grouped(docs, shingle, crowd)
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    membership = stored(rooted.join(named, "root").select(F.col("f").alias("fingerprint"), "component_id"), "simhash-groups")
    return marked.join(membership, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """All columns of one row of each component: the one with the smallest doc_id, then the smallest digest of its text.

    A null id is taken only if the component has no other. Of rows equal in id and text any one stays.
    """
    marked, rooted = _grouped(docs, shingle, crowd)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("best")
    firsts = marked.groupBy(F.col("fingerprint").alias("f")).agg(best, F.count("*").alias("n"))
    chosen = rooted.select("f", "root").join(firsts, "f").groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.key")
    return rows_of(docs, marked, chosen)


def rows_of(docs: DataFrame, marked: DataFrame, chosen: DataFrame) -> DataFrame:
    """All columns of one row for each doc_id and key of `chosen`; `marked` has doc_id and key of all rows."""
    chosen = stored(chosen, "chosen")
    rows = marked.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    sized = chosen.alias("c").join(rows.alias("r"), F.expr("c.doc_id <=> r.doc_id and c.key = r.key")).select("c.*", "r.n")
    sized = stored(sized, "chosen")

    def among(picked: DataFrame) -> DataFrame:
        return docs.join(picked, docs["doc_id"].eqNullSafe(picked["doc_id"]) & (text_key(docs["text"]) == picked["key"]), "left_semi")

    single, several = sized.where("n = 1"), sized.where("n > 1")
    if several.isEmpty():
        return among(single)
    # repeated rows are numbered within their own task and id; the first of the first task stays
    numbered = among(several).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))
    numbered = numbered.withColumn("key", text_key(F.col("row.text"))).groupBy(F.col("row.doc_id").alias("id"), "key").agg(F.min_by("row", "at").alias("row"))
    return among(single).unionByName(numbered.select("row.*"))
