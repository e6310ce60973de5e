"""A corpus from raw documents to token ids: five stages, each by one operator of ``tagloom.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns
the columns of ``documents``; the last adds n_tokens, ids (little-endian unsigned 32-bit integers)
and round_trip (whether decoding the ids gives the text back). Rows that share a doc_id share a
verdict; null and empty texts are rejected by the first stage, a null doc_id is kept as it is and has no
near duplicate; columns other than those of ``documents`` are dropped; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, decontaminate, jaccard, line_dedup, quality_rules
from tagloom.llm.common import discard, in_small_batches, materialize, table, without
from tagloom.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, n_chars counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage hands its texts to Python some hundreds at a time, whenever its rows are read: this setting of the session stays."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        in_small_batches(spark)
        return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return _documents(quality_rules.keep_documents(docs, model))


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated windows of lines; a document that loses all its words goes."""
    kept = line_dedup.dedup(docs)
    return _documents(kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, for each group of linked documents."""
    found = jaccard.join(docs)
    goes = found.groupBy("doc_id").agg(F.max("component_id").alias("head")).where("head < doc_id").select("doc_id")
    return _documents(without(docs, goes, "doc_id"))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the benchmark's passages; a document that has no word left goes."""
    cleaned = decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return _documents(cleaned.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    coded = bpe.encode(spark, docs.select(*COLUMNS), vocabulary_path(), decoded=True)
    return coded.withColumn("round_trip", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))).drop("decoded")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]
#: The field over lines and the exact token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, in a table in the shared folder; those of the others are deleted once they are read."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        kept = materialize(stage(spark, docs, sf_dir), "stage")
        if k:
            discard(docs)
        docs = kept
    return docs
