r"""WARC: archives written by Spark's text writer, read back by boundary-chain verification.

Writing. A record is its header, a blank line, the payload, and two line ends. Rows go through
Spark's own text writer with the two line ends as line separator, so archives are plain or gzip
WARC/1.0 files on any file system that Spark can write to. Of records with equal payloads of at
least ``MIN_REVISIT`` bytes, that with the smallest page_id is a response and the others are
revisits that refer to it and carry no payload.

Reading. Spark's text reader splits the archives at every ``WARC/1.0`` line, also at those inside
payloads; the reader divides large plain archives among tasks. Each such place is a candidate with
an offset and, if its header can be read, the offset of its successor: header, payload and line ends
further on. Pointer jumping from each file's start keeps the candidates that the chain reaches: in
every round the reached set grows by a jump of twice the length, so a file of n records takes about
log2(n) rounds of joins on (file, offset), each written to the shared folder. Pieces between two
reached offsets belong to the record before them and are put together again.

No step needs a file, or all payloads of one key, in a single task; a round sorts or joins offsets
alone, and payloads are joined to their verdict once.

Defined results: null html is an empty payload; a null url is written as an empty URI; repeated
page_ids each get a record of their own (among equal payloads the smallest page_id, then the smallest
url, is the response; of rows that agree in both, any one, and the rest revisit it); a null page_id is
smallest only where all are null; bytes after a broken record in a file are not reached and not returned; an empty table writes
and reads nothing.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.common import discard, materialize, new_path

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 100
RECORDS_PER_FILE = 20_000
EPOCH = "2024-01-01T00:00:00Z"  # records bear a fixed date, so that a second run writes the same bytes
PIECE = "file string, block bigint, offset bigint, size bigint, next bigint, head binary, body binary"
LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$")


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and size, with ``first_id``: the response's page_id if the record is a revisit, else null.

    Only digests and ids are shuffled to find the first of equal payloads; counts are combined before.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "payload_bytes": F.octet_length("payload").cast("long")})
    light = materialize(rows.where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "url", "digest"), "warc-digests")
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    shared = light.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = (
        light.join(shared, "digest").groupBy("page_id", "url", "digest").agg(F.first("first").alias("first"))
        .select(_id_text(), "url", "digest", F.col("first.page_id").alias("first_id"), (~place.eqNullSafe(F.col("first"))).alias("later"))
    )
    keys = ["__id", "url", "digest"]
    met = rows.withColumn("__id", _id_text()).join(copies, keys, "left")
    # rows that agree in all three keys: the join has brought them together already
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    told = met.withColumn("nth", nth).withColumn("revisit", F.coalesce(F.col("later") | (F.col("later").isNotNull() & (F.col("nth") > 1)), F.lit(False)))
    return told.withColumn("first_id", F.when(F.col("revisit"), F.col("first_id"))).drop("later", "__id")


def _id_text() -> F.Column:
    return F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("__id")


def _uuid(*parts: F.Column) -> F.Column:
    """A name for what the parts, of which any may be null, tell together."""
    h = F.md5(F.to_json(F.array(*[p.cast("string") for p in parts])).cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _record(r: DataFrame) -> F.Column:
    """The record as one string, without the line ends that close it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    one_line = F.regexp_replace("url", r"[\r\n]", "%0A")
    return F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), _uuid(F.col("page_id"), F.col("url"), F.col("digest"), F.col("nth")), F.lit(">"))),
        line("WARC-Date", F.lit(EPOCH)), line("WARC-Target-URI", one_line), line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("WARC-Refers-To-Page", F.coalesce(F.col("first_id").cast("string"), F.lit(""))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")),
    )


def write(pages: DataFrame, path: str, compression: str = "gzip", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` (page_id, url, html) as archives under ``path``."""
    plan_records(pages).select(_record(pages).alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The stretches between candidate places: file, offset within its block, size, the successor's distance, head and body.

    Offsets count decompressed bytes. ``next`` is null where no header can be read.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary")
    )

    def each(batches):
        key, at = None, 0
        for batch in batches:
            out = []
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (file, block):
                    key, at = (file, block), 0
                    # the first piece of a file stands before its first candidate and is no candidate
                    lead = block == 0
                else:
                    lead = False
                value = value or b""
                if lead and not value:
                    continue
                size = len(value) + (0 if lead else len(MAGIC))
                head, gap, body = value.partition(b"\r\n\r\n")
                found = None if lead or not gap else LENGTH.search(head)
                out.append((file, block, at, size, len(MAGIC) + len(head) + 4 + int(found[1]) + len(END) if found else None, head, body if found else value[len(head) :]))
                at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, TYPES, strict=True)], NAMES)

    return raw.mapInArrow(each, PIECE)


NAMES = [x.split()[0] for x in PIECE.split(", ")]
TYPES = [pa.string(), *[pa.int64()] * 4, pa.binary(), pa.binary()]


def block_starts(light: DataFrame) -> DataFrame:
    """Where each block of a file begins, from the sizes of the blocks before: (file, block, start). One row for each block is sorted."""
    sizes = light.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))


def reachable(links: DataFrame, starts: DataFrame) -> DataFrame:
    """The offsets that a chain of links reaches, by pointer jumping.

    links: file, offset, next. starts: file, offset. Round k joins the reached offsets with jumps of
    2**k links and squares the jumps; it ends when a round reaches nothing new.
    """
    jumps, reached, k = links.select("file", "offset", "next"), starts.select("file", "offset"), 0
    known = reached.count()
    old: list[DataFrame] = []
    while True:
        grown = reached.join(jumps.hint("merge"), ["file", "offset"]).select("file", F.col("next").alias("offset"))
        reached = materialize(reached.unionByName(grown).distinct(), f"warc-reached-{k}")
        now = reached.count()
        discard(*old[:1])
        if now == known:
            discard(*old[1:])
            return reached
        known, k = now, k + 1
        after = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("then"))
        jumps = materialize(jumps.join(after.hint("merge"), ["file", "next"]).select("file", "offset", F.col("then").alias("next")), f"warc-jumps-{k}")
        discard(*old[1:])
        old = [reached, jumps]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: file, offset, head (text) and payload (bytes)."""
    parts = pieces(spark, path)
    light = materialize(parts.select("file", "block", F.col("offset").alias("place"), "size", "next"), "warc-candidates")
    begin = F.col("place") + F.col("start")
    links = materialize(light.join(block_starts(light), ["file", "block"]).select("file", "block", "place", begin.alias("offset"), "size", (begin + F.col("next")).alias("next")), "warc-links")
    candidates = links.where("next is not null")
    reached = reachable(candidates, candidates.where("offset = 0").select("file", "offset"))
    owned = _owners(links.join(reached.withColumn("own", F.lit(True)), ["file", "offset"], "left"))
    got = parts.withColumnRenamed("offset", "place").drop("size", "next").join(owned, ["file", "block", "place"])
    body = lambda c, size: F.substring(c, F.lit(1), size)
    single = got.where("whole").select("file", "owner", "head", body(F.col("body"), F.octet_length("body") - len(END)).alias("payload"))
    again = F.concat(F.lit(MAGIC).cast("binary"), F.col("head"), F.when(F.col("next").isNotNull(), F.lit("\r\n\r\n").cast("binary")).otherwise(F.lit(b"")), F.col("body"))
    piece = F.struct("offset", F.when(F.col("offset") == F.col("owner"), F.col("body")).otherwise(again).alias("bytes"), "head")
    several = (
        got.where("not whole").groupBy("file", "owner", "owner_next")
        .agg(F.array_sort(F.collect_list(piece)).alias("all"), F.sum("size").alias("size")).where("owner + size >= owner_next")
        .select("file", "owner", F.col("all")[0]["head"].alias("head"), F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["bytes"])), "")).alias("bytes"))
        .select("file", "owner", "head", body(F.col("bytes"), F.octet_length("bytes") - len(END)).alias("payload"))
    )
    return single.unionByName(several).select("file", F.col("owner").alias("offset"), F.col("head").cast("string").alias("head"), "payload")


def _owners(pieces: DataFrame) -> DataFrame:
    """Each piece with the reached record that it lies in (owner, owner_next), and whether that record is this piece alone.

    Within a block the last reached offset is carried forward; a block's own carry comes from the blocks before it.
    """
    mark = F.when(F.col("own"), F.struct("offset", "next"))
    inside = Window.partitionBy("file", "block").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.groupBy("file", "block").agg(F.max(mark).alias("last")).select("file", "block", F.last("last", ignorenulls=True).over(before).alias("carry"))
    owner = F.coalesce(F.last(mark, ignorenulls=True).over(inside), F.col("carry"))
    told = pieces.join(carry, ["file", "block"]).withColumn("o", owner).where("o is not null and offset < o.next")
    return told.select("file", "block", "place", "offset", "size", "next", F.col("o.offset").alias("owner"), F.col("o.next").alias("owner_next"), ((F.col("offset") == F.col("o.offset")) & (F.col("offset") + F.col("size") == F.col("o.next"))).alias("whole"))


def fields(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records that :func:`write` made.

    A response's bytes and digest are those of the payload as read; a revisit bears them in its header.
    """
    line = lambda name: F.regexp_extract("head", rf"(?md)^{name}: ?([^\r\n]*)", 1)
    revisit = line("WARC-Type") == "revisit"
    number = lambda name: F.nullif(line(name), F.lit("")).try_cast("bigint")
    return records.select(
        number("X-Page-ID").alias("page_id"), F.when(revisit, number("X-Payload-Length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(line("WARC-Payload-Digest"), "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        line("WARC-Type").alias("record_type"), F.when(revisit, number("WARC-Refers-To-Page")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives into the shared folder, read them back, and tell each record's fields."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return fields(read(pages.sparkSession, path))
