r"""Exact dedup by a tree of merges of sorted digest runs, with DataFrame functions alone.

Two texts are equal if they are identical once A-Z are lower-cased. Texts are read once and never
shuffled: each row becomes a fingerprint of some 70 bytes (SHA-256, bytes, a second hash of another
kind, doc_id, row number), and the fingerprints of one partition, combined and sorted, are a run.

1. Up. Runs are exchanged between partners in binomial rounds, ``ROUNDS`` of which are done at once:
   run r meets the runs that have the same r div 2**ROUNDS. Their rows are dealt by (new run, digest),
   come together sorted, and one row for each text is left, with the identifier that stays and the
   number of rows. A merged run lies over as many tasks as its digests fill, so no task ever holds a
   run. Rows are merged only if all three of SHA-256, size and second hash agree, at every level.
2. Down. What the last run says of texts that occur more than once goes back the same way: each level
   meets the level above by (run, digest). A text is in a run at most once, so that whatever share of
   the rows one text holds, it adds at most 2**ROUNDS rows to a key of any join; only the lowest join
   meets rows, those of one partition.

Every level is written to the shared folder, so that a lost executor costs one level at most; levels
are deleted when the result is written.

Defined results: a null text counts as empty, and empty texts are equal to each other; of equal texts
the row with the largest (or smallest) doc_id stays, a null doc_id only if there is no other; of rows
that share that doc_id and text one stays, which of them is not defined; an empty table gives an
empty result; other columns, whatever their names, are ignored by :func:`groups` and kept by :func:`dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import discard, materialize, without

ROUNDS = 5
KEY = ("sha", "size", "mark")
ROW_BITS = 33  # monotonically_increasing_id: the partition lies above this bit
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalized(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null as empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() is the same, and faster, where all characters are ASCII
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fingerprints(docs: DataFrame, row: Column) -> DataFrame:
    """doc_id, row, run and the digests (sha, size, mark) of every row."""
    text = normalized(F.col("text"))
    told = docs.select("doc_id", row.alias("row"), text.alias("norm"))
    return told.select("doc_id", "row", F.shiftright("row", ROW_BITS).alias("run"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), F.octet_length("norm").alias("size"), F.xxhash64("norm").alias("mark"))


def merge(runs: DataFrame, rounds: int, keep: str) -> DataFrame:
    """The runs that agree in run div 2**rounds as one, sorted by digest: one row (run, digest, best, n) for each text."""
    best = F.max("best") if keep == "largest" else F.min("best")
    met = runs.withColumn("run", F.shiftright("run", rounds)).groupBy("run", *KEY).agg(best.alias("best"), F.sum("n").alias("n"))
    return met.sortWithinPartitions("run", *KEY)


def _told(marks: DataFrame, keep: str) -> DataFrame:
    """doc_id, row, keep_id, group_size, kept and text_sha256 of every fingerprint."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")
    # a null sorts first: never the largest, and put last by its flag where the smallest stays
    place = F.struct("doc_id", "row") if keep == "largest" else F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    levels = [materialize(merge(marks.select("run", *KEY, place.alias("best"), F.lit(1).cast("long").alias("n")), 0, keep), "digest-runs")]
    runs = (levels[0].agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        levels.append(materialize(merge(levels[-1], ROUNDS, keep), "digest-runs"))
        runs = -(-runs // (1 << ROUNDS))
    # texts that occur once need no answer
    told = levels[-1].where("n > 1").select(F.col("run").alias("up"), *KEY, "best", "n")
    for level in reversed(levels[:-1]):
        told = level.select("run", *KEY, F.shiftright("run", ROUNDS).alias("up")).join(told, ["up", *KEY]).select(F.col("run").alias("up"), *KEY, "best", "n")
    met = marks.withColumn("up", F.col("run")).join(told, ["up", *KEY], "left")
    alone = F.col("n").isNull()
    out = met.select(
        "doc_id", "row", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
    out = materialize(out, "digest-groups")
    discard(*levels)
    return out


def groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    >>> groups(spark.read.parquet("documents"))  # doctest: +SKIP
    """
    marks = materialize(fingerprints(docs, F.monotonically_increasing_id()), "digests")
    told = _told(marks, keep)
    discard(marks)
    return told.drop("row")


def dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns.

    The rows are written once, so that their numbers hold; the rows that go are named by number, and a
    bitmap of fixed size tells which rows need a look. Names that begin with two underscores are reserved.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "digest-rows")
    marks = materialize(fingerprints(rows, F.col("__row")), "digests")
    told = _told(marks, keep)
    out = materialize(without(rows, told.where("not kept").select(F.col("row").alias("__row")), "__row").select(*docs.columns), "exact-dedup")
    discard(marks, told, rows)
    return out
