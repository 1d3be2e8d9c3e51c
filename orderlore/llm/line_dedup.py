"""Line deduplication by winnowing over line hashes (operator 2), DataFrame functions only.

A document is the sequence of its lines' digests. From every line on, the shortest run that is long enough (`min_lines`
lines, or fewer with `min_words` words together) is a window; its smallest digest is a fingerprint. Two runs that are equal
and long enough share the window at their first line, hence its fingerprint, so none is missed:
 1. fingerprints that stand at one place only are dropped with their windows;
 2. a window's first place in the corpus (by doc_id, then digest of the text, then line) is joined to its later places;
 3. matches on one diagonal (same two documents, same shift) that touch are one run, which is extended both ways while the
    lines of the two documents agree;
 4. the lines of these later runs are deleted. The earlier lines they agree with may be deleted for still earlier
    ones, but the first place of a run always stays.
Every later place is tied to the first place only, so a group of copies gives as many rows as it has members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlore.llm.tables import stored, text_key

MIN_LINES, MIN_WORDS = 4, 50

# lines of `text`, their digests and their numbers of words
_LINES = "split(coalesce(text, ''), '\n', -1)"
_DIGESTS = "transform(lines, x -> unhex(md5(trim(x))))"
_WORDS = "transform(lines, x -> regexp_count(x, '[^\\\\x20\\\\x09-\\\\x0D]+'))"


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, key and the digests h and numbers of words w of the lines; rows equal in id and text are one."""
    lines = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.expr(_LINES).alias("lines"))
    return stored(lines.select("doc_id", "key", F.expr(_DIGESTS).alias("h"), F.expr(_WORDS).alias("w")), "line-digests")


def windows(lines: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, s (first line), k (number of lines), f (fingerprint), at (its line), cid (digest of the content)."""
    enough = f"filter(sequence(1, {min_lines}), k -> s + k <= size(h) + 1 and (k = {min_lines} or aggregate(slice(w, s, k), 0L, (a, x) -> a + x) >= {min_words}))"
    sized = lines.where("size(h) > 0").select("*", F.expr(f"filter(transform(sequence(1, size(h)), s -> struct(s as s, array_min({enough}) as k)), x -> x.k is not null)").alias("own"))
    each = sized.select("doc_id", "key", "h", F.explode("own").alias("o")).select("doc_id", "key", F.col("o.s").alias("s"), F.col("o.k").alias("k"), F.expr("slice(h, o.s, o.k)").alias("c"))
    least = F.array_min("c")
    content = F.unhex(F.md5(F.concat_ws("", F.transform("c", F.hex))))
    return each.select("doc_id", "key", "s", "k", least.alias("f"), (F.col("s") + F.array_position("c", least) - 1).cast("int").alias("at"), content.alias("cid"))


def _first(*columns: str):
    return F.min(F.struct(*columns)).alias("first")


def repeated_runs(lines: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, a, b: the runs of lines (from 1, both ends included) that repeat a run which starts earlier."""
    every = stored(windows(lines, min_lines, min_words), "line-windows")
    places = every.groupBy("f").agg(F.min(F.struct("doc_id", "key", "at")).alias("low"), F.max(F.struct("doc_id", "key", "at")).alias("high"))
    shared = every.join(places.where("not (low <=> high)").select("f"), "f", "left_semi")
    first = shared.groupBy("cid").agg(_first("doc_id", "key", "s"), F.count("*").alias("n")).where("n > 1").select("cid", "first")
    met = shared.join(first, "cid").where("struct(doc_id, key, s) > first")
    pairs = met.select("doc_id", "key", "s", (F.col("s") + F.col("k") - 1).alias("e"), F.col("first.doc_id").alias("q_id"), F.col("first.key").alias("q_key"), (F.col("s") - F.col("first.s")).alias("shift"))
    diagonal = Window.partitionBy("doc_id", "key", "q_id", "q_key", "shift").orderBy("s")
    before = F.max("e").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    opened = pairs.withColumn("opens", F.coalesce((F.col("s") > before + 1).cast("int"), F.lit(1)))
    runs = opened.withColumn("run", F.sum("opens").over(diagonal)).groupBy("doc_id", "key", "q_id", "q_key", "shift", "run").agg(F.min("s").alias("a"), F.max("e").alias("b"))
    runs = stored(runs, "line-runs")
    content = lines.groupBy("doc_id", "key").agg(F.first("h").alias("h"))
    own = runs.alias("r").join(content.alias("p"), F.expr("r.doc_id <=> p.doc_id and r.key = p.key")).select("r.*", "p.h")
    both = own.alias("o").join(content.alias("q"), F.expr("o.q_id <=> q.doc_id and o.q_key = q.key")).select("o.*", F.col("q.h").alias("g"))
    # the nearest line on each side on which the two documents differ; a document's edge counts as one
    differs = "i <= shift or i - shift > size(g) or h[i - 1] <> g[i - 1 - shift]"
    left = f"if(a = 1, 0, coalesce(array_max(filter(sequence(1, greatest(a - 1, 1)), i -> {differs})), 0))"
    right = f"if(b = size(h), b + 1, coalesce(array_min(filter(sequence(least(b + 1, size(h)), size(h)), i -> {differs})), size(h) + 1))"
    return both.select("doc_id", "key", (F.expr(left) + 1).alias("a"), (F.expr(right) - 1).alias("b"))


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, removed: str = "lines_removed", total: str = "lines_total") -> DataFrame:
    """All rows and columns, with `text` freed of later repeated runs, and the counts `removed` and `total` added.

    Lines are split at line feeds and compared after blanks at their ends are cut. Null texts stay null and have no
    lines; empty texts stay as they are. Null ids come before all others. Rows equal in id and text are one document and
    lose the same lines. An empty table gives an empty result. Columns that have the names of the counts are replaced.
    """
    lines = line_digests(docs)
    runs = repeated_runs(lines, min_lines, min_words)
    by_doc = stored(runs.groupBy("doc_id", "key").agg(F.collect_set(F.struct("a", "b")).alias("runs")), "line-removals")
    same = docs["doc_id"].eqNullSafe(by_doc["doc_id"]) & (text_key(docs["text"]) == by_doc["key"])
    others = [docs[c] for c in docs.columns if c not in ("text", removed, total)]
    # one small row a document on the right: hashed, so that the texts need not be sorted
    joined = docs.join(by_doc.hint("shuffle_hash"), same, "left").select(F.struct(*others).alias("row"), docs["text"].alias("text"), by_doc["runs"].alias("runs"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.expr(_LINES)))
    stay = F.expr(f"filter({_LINES}, (x, i) -> not exists(runs, r -> i + 1 between r.a and r.b))")
    cut = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    gone = F.when(F.col("runs").isNull(), 0).otherwise(n - F.size(stay))
    columns = [cut.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in (removed, total)]
    return joined.select(*columns, gone.cast("bigint").alias(removed), n.cast("bigint").alias(total))
