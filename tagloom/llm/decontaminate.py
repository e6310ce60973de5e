r"""Benchmark decontamination: an FM-index over each training shard, searched for benchmark windows.

Words are runs of digits, ASCII letters (case folded) and characters from U+0080 on. A window is 10
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A
document word inside any occurrence of a window is hit.

Each task reads documents into shards of at most ``SHARD_WORDS`` indexed words. Words are coded by
the benchmark's vocabulary; a stretch of known words that is shorter than the shortest window cannot
hold one and is left out of the index, which is exact. Windows are found by backward search through
wavelet-tree ranks, occurrences are located by sampled suffix positions, and the hit words of a
document are merged into removal spans.

Windows are searched in blocks of at most about ``BLOCK_BYTES`` of benchmark text, one after the other:
a block is read, broadcast and searched for in the whole texts, its hits are written, and its broadcast is
given up before the next is read. So what the driver and a worker hold has a fixed bound, whatever the
benchmark's size.

Defined results: null texts have no words; items without words have no window; a null item_id or
doc_id is kept as null (a null item is not listed); repeated items count once by id; repeated document rows give
repeated results where one block is enough, and results of rows with equal doc_id are told apart by
their text otherwise; texts are read whole; an empty table on either side gives counts of zero or no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import discard, materialize, slices
from tagloom.llm.fm_index import FmIndex

WINDOW = 10
SHARD_WORDS = 1 << 18
SHARD_BYTES = 8_000_000
SLICE = 1_000_000
BLOCK_BYTES = 4_000_000
#: ASCII letters are folded; every byte that is in no word becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = "doc_id bigint, row bigint, n_words bigint, n_hit bigint, items array<bigint>, spans array<struct<start:bigint,end:bigint>>, cuts array<struct<start:bigint,end:bigint>>"
FIELDS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", SPAN), ("cuts", SPAN)])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """The distinct windows of some benchmark items, coded by their own vocabulary from 1."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW):
        self.codes: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            coded = [self.codes.setdefault(w, len(self.codes) + 1) for w in words_of(text)]
            size = min(window, len(coded))
            for i in range(len(coded) - size + 1 if size else 0):
                owners.setdefault(tuple(coded[i : i + size]), set()).add(item)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for w in owners:
            by_length.setdefault(len(w), []).append(w)
        self.groups = [(size, np.array(ws, np.int64), [sorted(i for i in owners[w] if i is not None) for w in ws]) for size, ws in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans become one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([first[1:], [True]])
    return starts[first], ends[last]


class Shard:
    """Documents whose stretches of known words are indexed together."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple[int | None, int, int, bytes | None]] = []  # doc_id, row key, number of words, text if it has stretches
        self.parts: list[np.ndarray] = []
        self.origin: list[tuple[int, int, int]] = []  # start in the indexed string, document, first word
        self.size = self.bytes = 0

    def add(self, doc_id: int | None, row: int, text: bytes) -> None:
        words = words_of(text)
        get = self.windows.codes.get
        coded = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], coded != 0, [0]])))
        stretches = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= self.windows.shortest]
        for a, b in stretches:
            self.origin.append((self.size, len(self.docs), a))
            self.parts += [coded[a:b], np.zeros(1, np.int64)]
            self.size += b - a + 1
        self.docs.append((doc_id, row, len(words), text if stretches else None))
        self.bytes += 200 + len(text) * bool(stretches)

    def full(self) -> bool:
        return self.size >= SHARD_WORDS or self.bytes >= SHARD_BYTES

    def results(self) -> pa.RecordBatch:
        """One row for each document, in the order they came."""
        starts: dict[int, list[int]] = {}
        ends: dict[int, list[int]] = {}
        items: dict[int, set[int]] = {}
        if self.parts:
            index = FmIndex(np.concatenate(self.parts) + 1)  # separators are 1
            begin, doc, word = np.array(self.origin).T
            for size, patterns, owners in self.windows.groups:
                low, high = index.search(patterns + 1)
                hit = np.flatnonzero(high > low)
                which, place = index.locate(low[hit], high[hit])
                at = np.searchsorted(begin, place, side="right") - 1
                d, w = doc[at], word[at] + place - begin[at]
                for k in np.argsort(d, kind="stable").tolist():
                    i = int(d[k])
                    starts.setdefault(i, []).append(int(w[k]))
                    ends.setdefault(i, []).append(int(w[k]) + size)
                    items.setdefault(i, set()).update(owners[hit[which[k]]])
        rows = []
        for i, (doc_id, row, n, text) in enumerate(self.docs):
            if i not in starts:
                rows.append((doc_id, row, n, 0, [], [], []))
                continue
            a, b = merge_spans(np.array(starts[i]), np.array(ends[i]))
            told = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            rows.append((doc_id, row, n, int((b - a).sum()), sorted(items[i]), told, char_spans(text, a, b)))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=FIELDS)


def char_spans(text: bytes, starts: np.ndarray, ends: np.ndarray) -> list[dict[str, int]]:
    """Code points from the first to the last word of each span of words."""
    at = np.array([m.span() for m in WORD.finditer(text.translate(FOLD))])
    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # code points up to and with each byte
    return [{"start": int(points[a]) - 1, "end": int(points[b - 1])} for a, b in zip(at[starts, 0], at[ends - 1, 1], strict=True)]


def find_in_block(docs: DataFrame, shared: Broadcast) -> DataFrame:
    def each(batches):
        shard = Shard(shared.value)
        for batch in (part for b in batches for part in slices(b, 2, SLICE)):
            for doc_id, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard.add(doc_id, row, text or b"")
                if shard.full():
                    yield shard.results()
        if shard.docs:
            yield shard.results()

    return docs.select(F.col("doc_id").cast("long"), _row_key().alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(each, SCHEMA)


def block_count(benchmark: DataFrame) -> int:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // BLOCK_BYTES))


def benchmark_blocks(benchmark: DataFrame, n: int, window: int = WINDOW) -> Iterator[Broadcast]:
    """The windows of the benchmark, broadcast in ``n`` blocks of about ``BLOCK_BYTES`` of text; rows are dealt by a hash of item_id and text."""
    share = benchmark.sparkSession.sparkContext.broadcast
    rows = benchmark.select(F.col("item_id").cast("long").alias("item"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield share(Windows(sorted(((r.item, bytes(r.text)) for r in rows.where(block == k).toLocalIterator()), key=str), window))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of the items that occur), spans (hit words), cuts (code points)."""
    n = block_count(benchmark)
    if n == 1:
        return find_in_block(docs, next(benchmark_blocks(benchmark, 1, window))).drop("row")
    merged = _hits_of_blocks(docs, benchmark, n, window)
    own = docs.select(F.col("doc_id").cast("long"), _row_key().alias("row"), _word_count(F.col("text")).alias("n_words"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    pairs = "array<struct<start:bigint,end:bigint>>"
    return own.join(merged, own["doc_id"].eqNullSafe(merged["__doc"]) & (own["row"] == merged["__row"]), "left").select(
        "doc_id", "n_words", F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0)).cast("long").alias("n_hit"),
        none(F.col("items"), "array<bigint>").alias("items"), none(F.col("spans"), pairs).alias("spans"), none(F.col("cuts"), pairs).alias("cuts"),
    )


def _hits_of_blocks(docs: DataFrame, benchmark: DataFrame, n: int, window: int) -> DataFrame:
    """__doc, __row, items, spans and cuts of the documents that any block hits; of equal rows one tells. Only hits are shuffled."""
    every, parts = None, []
    for shared in benchmark_blocks(benchmark, n, window):
        parts.append(materialize(find_in_block(docs, shared).where("n_hit > 0").dropDuplicates(["doc_id", "row"]), "benchmark-hits"))
        shared.destroy()
        every = parts[-1] if every is None else every.unionByName(parts[-1])
    merged = every.groupBy("doc_id", "row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"), _merged(F.flatten(F.collect_list("cuts"))).alias("cuts"),
    )
    told = materialize(merged.withColumnsRenamed({"doc_id": "__doc", "row": "__row"}), "benchmark-merged")
    discard(*parts)
    return told


def _word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.lower(text), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))), F.lit(0)).cast("long")


def _merged(spans: F.Column) -> F.Column:
    """Overlapping and touching spans of an array become one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(done) == 0, F.array(s)).when(s["start"] <= last["end"], joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, step)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every removal span cut out of ``text``.

    Every block of the benchmark searches the whole text, and a text is cut once. Where one block is
    enough, that is one pass beside the row; else the texts are joined with the merged spans of all blocks.
    """
    n = block_count(benchmark)
    if n == 1:
        return _clean_in_one_pass(docs, next(benchmark_blocks(benchmark, 1, window)))
    merged = _hits_of_blocks(docs, benchmark, n, window)
    words = merged.select("__doc", "__row", F.col("spans").alias("__spans"))
    keyed = docs.withColumn("__key", _row_key())
    met = keyed.join(words, keyed["doc_id"].cast("long").eqNullSafe(words["__doc"]) & (keyed["__key"] == words["__row"]), "left")
    names, at = docs.columns, docs.columns.index("text")

    def each(batches):
        for batch in (part for b in batches for part in slices(b, at, SLICE)):
            texts = [t if not s else cut_text(t, word_cuts(t, s)) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return met.select(*(keyed[c] for c in names), "__spans").mapInArrow(each, docs.schema)


def word_cuts(text: str, spans: list[dict[str, int]]) -> list[dict[str, int]]:
    """The cuts in code points of merged spans of words."""
    return char_spans(text.encode(), np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))


def _clean_in_one_pass(docs: DataFrame, shared: Broadcast) -> DataFrame:
    names, at = docs.columns, docs.columns.index("text")

    def each(batches):
        shard, held = Shard(shared.value), []

        def flush():
            cuts = shard.results().column("cuts").to_pylist()
            for part in held:
                own, cuts = cuts[: part.num_rows], cuts[part.num_rows :]
                columns = list(part.columns)
                if any(own):
                    columns[at] = pa.array([cut_text(t, c) if c else t for t, c in zip(part.column(at).to_pylist(), own, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)
            held.clear()

        for batch in batches:
            for part in slices(batch, at, SLICE):
                for text in part.column(at).cast(pa.binary()).to_pylist():
                    shard.add(None, 0, text or b"")
                held.append(part)
                if shard.full() or sum(p.nbytes for p in held) > SHARD_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(each, docs.schema)


def cut_text(text: str, cuts: list[dict[str, int]]) -> str:
    """``text`` without its cuts (in code points)."""
    out, at = [], 0
    for c in cuts:
        out.append(text[at : c["start"]])
        at = c["end"]
    return "".join([*out, text[at:]])


def _row_key() -> F.Column:
    """Tells rows with equal doc_id apart by their text."""
    return F.xxhash64("text")
