"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlore.llm import bpe, decontaminate, line_dedup, ranking, simhash
from orderlore.llm.tables import read_table, stored, workers_find_package


def _free_name(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking scores at its cut or above. Null and empty texts are scored as the empty text;
    without labels of both kinds all stay."""
    workers_find_package(spark)
    ranker = ranking.fit(docs, read_table(spark, sf_dir, "labels"))
    score = _free_name(docs, "score")
    return ranking.score(docs, ranker, score).where(F.col(score) >= ranker.cut).select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut, and n_chars follows the text. A document that loses all its words goes; one
    that had none before stays."""
    removed, total = _free_name(docs, "lines_removed"), _free_name(docs, "lines_total")
    cut = line_dedup.remove_repeated_lines(docs, removed=removed, total=total)
    left = cut.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    sizes = [F.when(F.col(removed) == 0, F.col(c)).otherwise(F.length("text")).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return left.select(*sizes)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash near-dedup (three-word shingles, at most two differing bits) stays: the one
    with the smallest id, then the smallest digest of its text. Texts without words, null ones too, are linked like any
    other; of repeated rows one stays; a null id stays only where a component has no other; an empty table stays empty."""
    workers_find_package(spark)
    return simhash.one_of_each(docs, shingle=3)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any ten consecutive words of a benchmark item go (or all words of a shorter item). Null and empty texts
    have no words and stay, as does every repeated row that is clean; without benchmark items all stay."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them, one row for each document, repeated ones included. Null and empty
    texts have no ids and decode to the empty text."""
    workers_find_package(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_decode(docs, path, readable=True).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", reject_low_quality),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("bpe", to_tokens),
]

#: The first stage learns a classifier and the third computes fingerprints, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents` of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
