r"""Line dedup by overlapping three-line windows.

A text is its \n-split lines. Every three consecutive lines make a window, and a text of fewer lines is
one window. Repeated passages of fewer than three lines are beyond the method, as are those that begin or
end in mid-line. With ``long_line``, which is off unless given, a line of more words than that is a window of its
own as well, and so are two lines that have more words only together. Windows without a word are passed over. Windows are
hashed to 128 bits; of equal windows in the whole corpus the first (by doc_id, then by a hash of the
text, then by position) stays, and the lines that later ones cover are removed, covered positions of
a text being merged. Where a later window overlaps the first one in its text (the same line four times in
a row), the lines that both cover go as well.

Shuffled are 128-bit hashes with positions, once to find the first of each window (counts and
minima are combined before the exchange, so that a window in a third of all texts is no burden) and
once for the join that names the later ones, a plain equi-join that Spark may split where it is
skewed; and then the texts, to meet their covered positions, but only those that a bitmap of fixed size
does not tell to have none.

Defined results: a null text stays null, an empty one empty; a null doc_id sorts first; rows equal in
doc_id and text count as one document and get the same result; a text that loses all its lines
becomes empty; an empty table gives an empty result; other columns stay, and those that bear the names
of new ones are replaced (names that begin with two underscores are reserved).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import discard, materialize, sieve, sifted, slices

WIDTH = 3
SLICE = 4_000_000
SPAN = "array<struct<pos:int,size:int>>"


def window_spans(lines: list[bytes], width: int = WIDTH, long_line: int | None = None) -> list[tuple[int, int]]:
    """(first line, number of lines) of each window that has a word."""
    blank = [not x or x.isspace() for x in lines]
    size = min(width, len(lines))
    spans = [(i, size) for i in range(len(lines) - size + 1) if not all(blank[i : i + size])]
    if long_line is not None and size > 1:
        # words are counted only where there is room for so many
        roomy = [len(x) > 2 * long_line for x in lines]
        long = [r and len(x.split()) > long_line for r, x in zip(roomy, lines, strict=True)]
        spans += [(i, 1) for i, x in enumerate(long) if x]
    if long_line is not None and size > 2:
        words: dict[int, int] = {}
        for i in range(len(lines) - 1):
            if not (long[i] or long[i + 1]) and len(lines[i]) + len(lines[i + 1]) >= 2 * long_line:
                for k in (i, i + 1):
                    if k not in words:
                        words[k] = len(lines[k].split())
                if words[i] + words[i + 1] > long_line:
                    spans.append((i, 2))
    return spans


def _key() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def windows(docs: DataFrame, width: int = WIDTH, long_line: int | None = None) -> DataFrame:
    """One row for each window: its hash (a, b), its document (doc_id, row) and its place (pos, size)."""

    def each(batches):
        for batch in (part for b in batches for part in slices(b, 2, SLICE)):
            digests, owners, places = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                lines = (text or b"").split(b"\n")
                for i, size in window_spans(lines, width, long_line):
                    digests.append(hashlib.blake2b(b"\n".join(lines[i : i + size]), digest_size=16, person=b"%d" % size).digest())
                    owners.append(k)
                    places.append((i, size))
                if len(digests) >= 50_000:
                    yield _window_rows(batch, digests, owners, places)
                    digests, owners, places = [], [], []
            if digests:
                yield _window_rows(batch, digests, owners, places)

    return docs.select(F.col("doc_id").cast("long"), _key().alias("row"), F.col("text").cast("binary")).mapInArrow(each, "a bigint, b bigint, doc_id bigint, row bigint, pos int, size int")


def _window_rows(batch: pa.RecordBatch, digests: list[bytes], owners: list[int], places: list[tuple[int, int]]) -> pa.RecordBatch:
    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    p = np.array(places, np.int32)
    own = pa.array(owners, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column(0).take(own), batch.column(1).take(own), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["a", "b", "doc_id", "row", "pos", "size"])


def covered(docs: DataFrame, width: int = WIDTH, long_line: int | None = None) -> DataFrame:
    """doc_id, row and the spans of lines to remove, for the documents that have any."""
    every = materialize(windows(docs, width, long_line), "line-windows")
    place = F.struct("doc_id", "row", "pos")
    repeated = every.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = every.join(repeated, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    told = materialize(later.groupBy("doc_id", "row").agg(F.collect_set(F.struct("pos", "size")).alias("spans")), "line-spans")
    discard(every)
    return told


def dedup(docs: DataFrame, width: int = WIDTH, long_line: int | None = None) -> DataFrame:
    """``docs`` with the lines of repeated windows removed from ``text``, n_lines and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    spans = covered(docs, width, long_line).select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    keyed = sifted(docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": _key()}), "__id", sieve(spans, "__doc"))
    may, rest = keyed.where("__may"), keyed.where("not __may")
    met = may.join(spans.hint("merge"), may["__id"].eqNullSafe(spans["__doc"]) & (may["__key"] == spans["__row"]), "left").select(*(may[c] for c in names), "__spans")
    met = met.unionByName(rest.select(*names, F.lit(None).cast(SPAN).alias("__spans")))
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def each(batches):
        for batch in (part for b in batches for part in slices(b, at, SLICE)):
            texts, totals, gone = [], [], []
            for text, cut in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                lines = text.split("\n") if text else []
                out = np.zeros(len(lines) + 1, np.int64)
                for s in cut or []:
                    out[s["pos"]] += 1
                    out[s["pos"] + s["size"]] -= 1
                hit = np.cumsum(out)[:-1] > 0
                texts.append("\n".join(x for x, h in zip(lines, hit.tolist(), strict=True) if not h) if cut else text)
                totals.append(len(lines))
                gone.append(int(hit.sum()))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], schema.names)

    return met.mapInArrow(each, schema)
