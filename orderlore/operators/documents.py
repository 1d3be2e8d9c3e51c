"""Field by field comparison of nested documents with their ground truth (D).

Documents are VARIANT values, which keep a field that is null apart from a field that is absent.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlore.functions.fields import outcomes_of
from orderlore.functions.numeric import ratio
from orderlore.functions.similarity import indel_ratio_above
from orderlore.functions.text import allow_repeated_keys, strip
from orderlore.session import materialise

NUMBER_TOLERANCE = 0.01
PARTIAL_RATIO = 0.80
LEVELS_AT_ONCE = 4
LONG_PAIR = 1 << 20
TRUTH_KEYS = ("0_expected", "expected")


def document(text: Column) -> Column:
    """Text as a document. Of a key that occurs twice the last value counts, whatever the session's own setting."""
    allow_repeated_keys()
    return F.parse_json(text)


def lenient_document(text: Column) -> Column:
    """The text as JSON, else its part from the first to the last brace, else an empty object.

    A text that begins with a letter JSON can't begin with is not tried whole, since a parse that fails costs several that don't.
    """
    allow_repeated_keys()
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    first = F.left(text, F.lit(1))
    is_prose = first.between("A", "Z") | first.between("a", "z") & ~first.isin("t", "f", "n")
    return F.coalesce(F.when(~is_prose, F.try_parse_json(text)), F.try_parse_json(inner), F.parse_json(F.lit("{}")))


def stem(path: Column) -> Column:
    """File name without folders and the .pdf or .json ending."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.(?:pdf|json))?$", 1)


def tag_predictions(predictions: DataFrame, document_type: str) -> DataFrame:
    """The predicted document's type and source file travel as two more leaves."""
    return predictions.withColumn("document_type", F.lit(document_type))


def pair_documents(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """Predictions (prediction_file, origin_file, document) with the truth (path, document) of
    the same stem; predictions without an origin or a truth are left out."""
    p = predictions.where(F.coalesce("origin_file", F.lit("")) != "").withColumn("stem", stem(F.col("origin_file")))
    t = truths.select(stem(F.col("path")).alias("stem"), F.col("document").alias("truth"))
    return p.join(t, "stem")


def truth_body(document: Column) -> Column:
    """The expected fields of a truth file."""
    return F.coalesce(*[F.try_variant_get(document, f"$['{k}']", "variant") for k in TRUTH_KEYS])


def _opened(node: Column, lists: bool) -> Column:
    """The fields of an object (and the elements of a list, if asked for) with their paths; NULL for anything else."""
    separator = "\u0000" if lists else "."
    path = lambda k: F.when(node["path"] == "", k).otherwise(F.concat_ws(separator, node["path"], k))
    fields = F.transform(
        F.map_entries(F.try_variant_get(node["leaf"], "$", "map<string,variant>")),
        lambda e: F.struct(path(e["key"]).alias("path"), e["value"].alias("leaf")),
    )
    if not lists:
        return fields
    kept = lambda part: F.when(F.size(part) > 0, part)
    elements = F.transform(
        F.try_variant_get(node["leaf"], "$", "array<variant>"),
        lambda v, i: F.struct(path(F.format_string("%09d", i)).alias("path"), v.alias("leaf")),
    )
    return F.coalesce(kept(fields), kept(elements))


def leaf_nodes(document: Column, levels: int, lists: bool = False) -> Column:
    """The leaves of a document as an array of (path, leaf), built inside its row.

    Each step replaces the objects of the list by their fields and keeps the leaves. `levels` is the number of steps:
    what is nested deeper stays closed.
    """
    nodes = F.array(F.struct(F.lit("").alias("path"), document.alias("leaf")))
    for _ in range(levels):
        nodes = F.flatten(F.transform(nodes, lambda node: F.coalesce(_opened(node, lists), F.array(node))))
    return nodes


def _join_paths(at: Column, below: Column, separator: str) -> Column:
    return F.when(below == "", at).when(at == "", below).otherwise(F.concat_ws(separator, at, below))


def _may_be_deep() -> Column:
    """Whether `leaf` may be a list of more than LEVELS_AT_ONCE levels: one that has no more brackets can't be."""
    json = F.to_json("leaf")
    brackets = F.length(json) - F.length(F.translate(json, "[{", ""))
    return F.coalesce((F.left(json, F.lit(1)) == "[") & (brackets > LEVELS_AT_ONCE), F.lit(False))


def _level_by_level(flat: DataFrame, is_open: Column, lists: bool) -> DataFrame:
    """Opens what `is_open` tells of the rows (path, leaf and others) until nothing is left, LEVELS_AT_ONCE levels a step.

    Each step's rows are written, and only those still open are looked into again, so documents may be nested to any
    depth; those of few levels cost one step.
    """
    separator, done = "\u0000" if lists else ".", []
    others = [c for c in flat.columns if c not in ("path", "leaf")]
    while True:
        step = materialise(flat.withColumns({"_open": is_open, "_doubtful": _may_be_deep()}), "document-leaves")
        done.append(step.where("not _open").drop("_open"))
        still = step.where("_open").drop("_open", "_doubtful")
        if still.isEmpty():
            return reduce(DataFrame.unionByName, done)
        deeper = still.select(*others, F.col("path").alias("_at"), F.explode(leaf_nodes(F.col("leaf"), LEVELS_AT_ONCE, lists)).alias("_f"))
        flat = deeper.select(*others, _join_paths(F.col("_at"), F.col("_f.path"), separator).alias("path"), F.col("_f.leaf").alias("leaf"))


def _all_leaves(rows: DataFrame, nodes: str) -> DataFrame:
    """Rows of an array of nodes (path, leaf and others), objects of any depth opened."""
    others = [c for c in rows.columns if c != nodes]
    flat = rows.select(*others, F.explode(nodes).alias("_f")).select(*others, "_f.*")
    return _level_by_level(flat, F.schema_of_variant("leaf").startswith("OBJECT"), lists=False)


def _typed(leaf: Column, json: Column) -> tuple[Column, Column]:
    """Text and number of a leaf, where it is one; the first character of its JSON tells the kind."""
    first = F.left(json, F.lit(1))
    text = F.when(first == '"', F.try_variant_get(leaf, "$", "string"))
    number = F.when(first == "t", 1.0).when(first == "f", 0.0).when(first.rlike("[-0-9]"), json.try_cast("double"))
    return text, number


def _canonical(json: Column) -> Column:
    """JSON in which whole numbers have no decimals; strings are taken as units and stay as they are."""
    return F.regexp_replace(json, r'("(?:[^"\\]++|\\.)*+")|(?<=[\d])\.0+(?=[,\]}]|$)', "$1")


def _element(node: Column) -> Column:
    """An element of a list by type: text, number, or the JSON of null and of empty containers."""
    json = F.to_json(node["leaf"])
    text, number = _typed(node["leaf"], json)
    return F.struct(node["path"].alias("path"), text.alias("text"), number.alias("number"), F.when(text.isNull() & number.isNull(), _canonical(json)).alias("other"))


def _is_open(json: Column) -> Column:
    """JSON of an object or list with anything in it."""
    return F.coalesce(json.rlike(r"^[\[{]") & ~json.isin("{}", "[]"), F.lit(False))


def typed_leaves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the column `leaf` by its JSON, its text or number, and for a list its typed elements, in order of place.

    `keys` and path name a row, and `_doubtful` tells of which lists the levels are counted. Lists of up to LEVELS_AT_ONCE levels are opened inside their row; the elements of those
    that hold more become rows, which are opened level by level and gathered again.
    """
    others = [c for c in rows.columns if c not in ("leaf", "_doubtful")]
    rows = rows.select(*others, "leaf", F.to_json("leaf").alias("json"), "_doubtful")
    text, number = _typed(F.col("leaf"), F.col("json"))
    is_list = F.left("json", F.lit(1)) == "["
    elements = F.when(is_list, F.array_sort(F.transform(leaf_nodes(F.col("leaf"), LEVELS_AT_ONCE, lists=True), _element)))
    is_deep = F.col("_doubtful") & F.coalesce(F.exists(elements, lambda e: _is_open(e["other"])), F.lit(False))
    whole = rows.select(*others, "json", text.alias("text"), number.alias("number"), elements.alias("items"), "leaf", is_deep.alias("_deep"))
    shallow = whole.where("not _deep").drop("_deep", "leaf")
    deep = whole.where("_deep").drop("_deep")
    if deep.isEmpty():
        return shallow
    named = [*keys, "path"]
    lists = deep.select(*[F.col(k).alias(f"_{k}") for k in named], F.explode(leaf_nodes(F.col("leaf"), LEVELS_AT_ONCE, lists=True)).alias("_f"))
    opened = _level_by_level(lists.select(*[f"_{k}" for k in named], "_f.path", "_f.leaf"), _is_open(F.to_json("leaf")), lists=True)
    gathered = opened.groupBy(*[f"_{k}" for k in named]).agg(F.array_sort(F.collect_list(_element(F.struct("path", "leaf")))).alias("items"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in named])
    return shallow.unionByName(deep.drop("items", "leaf").join(gathered, same).drop(*[f"_{k}" for k in named]))


def flatten(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, json, text, number, items) with dotted paths, for documents of any depth. Objects are opened,
    everything else is a leaf, and an empty object leaves nothing."""
    nodes = df.select(key, leaf_nodes(F.col(document), LEVELS_AT_ONCE).alias("_nodes"))
    return typed_leaves(_all_leaves(nodes, "_nodes"), [key])


def match_class(truth: str = "t", predicted: str = "p") -> Column:
    """Exact, partial or wrong. Numbers agree within 1 % of the larger, texts after trimming and
    lower-casing, or partially when similar; lists agree if all their elements do, number by number and text by text."""
    t, p = (lambda c: F.col(f"{truth}.{c}")), (lambda c: F.col(f"{predicted}.{c}"))
    close = F.abs(t("number") - p("number")) <= NUMBER_TOLERANCE * F.greatest(F.abs(t("number")), F.abs(p("number")))
    a, b = F.lower(strip(t("text"))), F.lower(strip(p("text")))
    other = t("text").isNull() & p("text").isNull() & t("number").isNull() & p("number").isNull()
    return (
        F.when(F.coalesce(close | (t("number") == p("number")), F.lit(False)), "exact")
        .when(F.coalesce(t("items") == p("items"), F.lit(False)), "exact")
        .when(F.coalesce(other & (t("json") == p("json")), F.lit(False)), "exact")
        .when(F.coalesce(a == b, F.lit(False)), "exact")
        .when(F.coalesce(indel_ratio_above(a, b, PARTIAL_RATIO), F.lit(False)), "partial")
        .otherwise("wrong")
    )


def compare_fields(pairs: DataFrame, key: str = "prediction_file") -> DataFrame:
    """D06, row level: (key, path, outcome) with outcome exact, partial, wrong, missing or extra.

    Both documents of a pair lie in one row and are compared there, so no leaf is shuffled or written. Pairs that this can't
    settle go through `_compare_leaves`: those of more than LONG_PAIR bytes, of a document with two leaves of one path, and
    those that share their key, whose leaves count once a path.
    """
    fields = outcomes_of(truth_body(F.col("truth")), F.col("document"), NUMBER_TOLERANCE, PARTIAL_RATIO, LONG_PAIR)
    done = materialise(pairs.select(key, fields.alias("fields")), "document-fields").withColumn("_hash", F.xxhash64(key))
    unsettled = (F.count("*") > 1) | F.bool_or(F.col("fields").isNull())
    again = materialise(done.groupBy("_hash").agg(unsettled.alias("_again")).where("_again").select("_hash"), "document-again")
    listed = lambda rows: rows.select(key, F.inline("fields"))
    if again.isEmpty():
        return listed(done)
    rest = pairs.withColumn("_hash", F.xxhash64(key)).join(again, "_hash", "left_semi").drop("_hash")
    return listed(done.join(again, "_hash", "left_anti")).unionByName(_compare_leaves(rest, key))


def _compare_leaves(pairs: DataFrame, key: str) -> DataFrame:
    """The same as rows of leaves, however long the documents are and however often a key or a path occurs.

    Both documents of a pair are opened in one pass, and once more from where they go deeper. Their leaves meet in an
    aggregate on (key, path), which joins most of them before the shuffle, and the leaves of one long document are spread over
    many tasks.
    """
    side = lambda document, is_truth: F.transform(
        leaf_nodes(document, LEVELS_AT_ONCE),
        lambda n: F.struct(F.lit(is_truth).alias("is_truth"), n["path"].alias("path"), n["leaf"].alias("leaf")),
    )
    both = F.concat(side(truth_body(F.col("truth")), True), side(F.col("document"), False))
    leaves = typed_leaves(_all_leaves(pairs.select(key, both.alias("_nodes")), "_nodes"), [key, "is_truth"])
    leaf = F.struct("json", "text", "number", "items")
    met = leaves.groupBy(key, "path").agg(
        F.max(F.when(F.col("is_truth"), leaf)).alias("t"), F.max(F.when(~F.col("is_truth"), leaf)).alias("p")
    )
    outcome = F.when(F.col("p").isNull(), "missing").when(F.col("t").isNull(), "extra").otherwise(match_class())
    return met.select(key, "path", outcome.alias("outcome"))


def report(fields: DataFrame, key: str = "prediction_file") -> DataFrame:
    """Counts, precision, recall and F1 per prediction. Extra fields do not count as wrong."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    counts = fields.groupBy(key).agg(
        n("exact").alias("tp"),
        n("partial", "wrong").alias("fp"),
        n("missing").alias("fn"),
        n("wrong").alias("wrong_fields"),
        n("partial").alias("partial_matches"),
        n("extra").alias("extra_fields"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(ratio(tp, tp + fp)), zero(ratio(tp, tp + fn))
    f1 = zero(ratio(2 * precision * recall, precision + recall))
    return counts.withColumns({"precision": F.bround(precision, 3), "recall": F.bround(recall, 3), "f1": F.bround(f1, 3)})
