"""Sharding by histogram sort, with DataFrame functions alone.

The sort key is (62 bits of xxhash64 of the text, doc_id): equal texts lie side by side, so a
group of copies stays in one shard unless the group is larger than the tolerance allows. Each round
counts the exact bytes of the rows in every cell between probe keys, keeps the probes that meet the
tolerance as splitters, and lays new probes inside the cell that holds an unmet target. Only these
counts (at most ``probes`` cells for each of ``n_shards - 1`` targets) come to the driver. When all
splitters stand, one exchange deals the rows out.

Slots are numbered without a task for a whole shard: rows of a shard are dealt over hashed
buckets, numbered there, and shifted by the sizes of the buckets before.

Defined results: a null text has no bytes and counts 1, as an empty one; a null doc_id sorts first;
repeated rows are kept, each with a slot of its own; any 64-bit doc_id is taken; an empty table gives an empty result; columns
that are in the way of the new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import materialize

KEY_BITS = 62
ROWS_PER_BUCKET, BYTES_PER_BUCKET = 200_000, 64_000_000


@dataclass(frozen=True)
class Span:
    """Keys [low, high) of text hashes, or of doc_ids below one text hash; ``before`` bytes lie below."""

    low: int
    high: int
    before: int
    text_hash: int | None = None


@dataclass(frozen=True)
class Splitter:
    """Rows from this key on belong to the next shard."""

    text_hash: int
    doc_id: int | None = None


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def id_key(doc_id: Column) -> Column:
    """doc_id, nulls as the least number there is; decimal, so that differences fit."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).cast("decimal(20,0)")


def _cells(spans: list[Span], probes: int) -> Column:
    """The number of the cell that a row falls in: span number * probes + place in the span; null outside."""
    cell = None
    for i, s in enumerate(spans):
        key, unit, inside = ("h", "L", F.lit(True)) if s.text_hash is None else ("d", "BD", F.col("h") == s.text_hash)
        here = inside & F.expr(f"{key} >= {s.low}{unit} and {key} < {s.high}{unit}")
        place = F.expr(f"cast(({key} - {s.low}{unit}) div {_step(s, probes)}{unit} as long)") + i * probes
        cell = F.when(here, place) if cell is None else cell.when(here, place)
    return cell


def _step(s: Span, probes: int) -> int:
    return max(1, -(-(s.high - s.low) // probes))


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float, probes: int = 256) -> tuple[list[Splitter], int, int]:
    """Splitters between ``n_shards`` shards of nearly equal bytes, and the numbers of rows and bytes.

    ``keys`` has h (text hash), d (doc_id) and size. Each pass reads it once.
    """
    waiting: dict[int, Span] = {t: Span(0, 1 << KEY_BITS, 0) for t in range(1, n_shards)}
    found: dict[int, Splitter] = {}
    total = rows = None
    while waiting:
        spans = sorted(set(waiting.values()), key=lambda s: (s.low, s.high, s.text_hash or -1))
        counted: dict[int, list] = {}
        for r in (
            keys.withColumn("cell", _cells(spans, probes)).where("cell is not null").groupBy("cell")
            .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
            .orderBy("cell").collect()
        ):
            counted.setdefault(r.cell // probes, []).append(r)
        if total is None:
            total, rows = (sum(r[k] for r in counted.get(0, [])) for k in ("bytes", "n"))
            if not total:
                return [], 0, 0
        slack = tolerance * total / n_shards
        for t, span in list(waiting.items()):
            target, below, near = total * t / n_shards, span.before, None
            for r in counted[spans.index(span)]:
                if below + r.bytes >= target:
                    near = r
                    break
                below += r.bytes
            single = near.h0 == near.h1 and near.d0 == near.d1
            start, end = below, below + near.bytes
            at = Splitter(near.h0) if span.text_hash is None else Splitter(span.text_hash, int(near.d0))
            after = Splitter(near.h1 + 1) if span.text_hash is None else Splitter(span.text_hash, int(near.d1) + 1)
            gap, splitter = (target - start, at) if target - start <= end - target else (end - target, after)
            if gap <= slack or single:
                found[t] = splitter
                del waiting[t]
            elif near.h0 == near.h1:
                waiting[t] = Span(int(near.d0), int(near.d1) + 1, below, near.h0)
            else:
                waiting[t] = Span(near.h0, near.h1 + 1, below)
    return [found[t] for t in range(1, n_shards)], rows, total


def shard(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.001) -> DataFrame:
    """``docs`` with size (bytes plus 1), shard and slot.

    >>> shard(spark.read.parquet("documents"), 16)  # doctest: +SKIP
    """
    docs = docs.drop("size", "shard", "slot")
    keyed = docs.withColumns({"__h": text_key(F.col("text")), "__d": id_key(F.col("doc_id")), "size": text_bytes(F.col("text")) + 1})
    keys = materialize(keyed.select(F.col("__h").alias("h"), F.col("__d").alias("d"), "size"), "shard-keys")
    splitters, rows, total = find_splitters(keys, n_shards, tolerance)

    def shard_of(h: Column, d: Column) -> Column:
        out = F.lit(0)
        for s in splitters:
            past = h >= s.text_hash if s.doc_id is None else (h > s.text_hash) | ((h == s.text_hash) & (d >= F.expr(f"{s.doc_id}BD")))
            out = out + past.cast("int")
        return out.cast("int")

    buckets = max(16, -(-rows // (n_shards * ROWS_PER_BUCKET)), -(-total // (n_shards * BYTES_PER_BUCKET)))
    bucket_of = lambda h, d: F.pmod(F.xxhash64(d.cast("string"), h), F.lit(buckets))
    sizes = keys.select(shard_of(F.col("h"), F.col("d")).alias("shard"), bucket_of(F.col("h"), F.col("d")).alias("__b")).groupBy("shard", "__b").count()
    before = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    if n_shards * buckets <= 1_000_000:  # 16 MB of rows at most
        offsets = F.broadcast(offsets)
    placed = keyed.withColumns({"shard": shard_of(F.col("__h"), F.col("__d")), "__b": bucket_of(F.col("__h"), F.col("__d"))})
    rank = F.row_number().over(Window.partitionBy("shard", "__b").orderBy("__d", "__h"))
    return (
        placed.withColumn("__rank", rank).join(offsets, ["shard", "__b"])
        .withColumn("slot", (F.col("__offset") + F.col("__rank") - 1).cast("long"))
        .drop("__h", "__d", "__b", "__rank", "__offset")
    )
