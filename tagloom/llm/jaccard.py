r"""N-gram Jaccard join: a blocked sparse product of the incidence of documents and shingles.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Documents with equal sets form a
class, and links are sought between classes. The product runs block by block, a block being the
shingles that one hash partition holds, over rows that the size bounds leave. Linked sets of sizes
n and m share at least 4 (n + m) / 9 members and differ in at most (n + m) / 9.

1. Prefix. Under any common order of shingles, the first n - ceil(0.8 n) + 1 members of a set are its
   prefix. Only prefixes are dealt out as entries of the incidence matrix, with their place. The order
   puts shingles that many documents hold last (counted within bounded stretches of the corpus and
   summed; the count only orders, so that being a lower bound costs time and no links).
2. Product. Entries are dealt by shingle and sorted, and a block is multiplied with itself: every pair
   of classes that meet at a shingle with few classes, whose sizes and places allow a link, adds one to
   the pair's overlap within the block. The blocks' overlaps are summed pair by pair.
3. Bound. Members that two sets share lie in both prefixes or behind the end of the one that ends
   first, so that a pair's overlap is at most the accumulated count, plus the shingles with many classes
   in both prefixes, which the product passes on uncounted, plus max(ceil(0.8 n), ceil(0.8 m)) - 1.
   Pairs for which this is below 4 (n + m) / 9 are discarded without a look at their texts.
4. Check. What is left is checked on whole texts: intersection and union of the two sets.
5. Hot shingles, with many classes. Sets that have a hot shingle in their prefix have all their cold
   ones there, so a pair that shares a cold one is counted already, and any other differs in all
   its cold ones: it needs a look only where these are few. Each class is first paired with leaders
   of like size (those with the fewest cold shingles, by a hashed choice of its hot ones); what still
   is in different components after that is paired in full within the bounds, so that no link is
   lost. Each class has a bitmap with the parity of its members' hashes; two bitmaps differ in no
   more bits than the sets do in members, so such a pair whose bitmaps differ in more than (n + m) / 9
   bits is discarded. Pairs in one component need no check, because the result is the components;
   copies are never expanded into all pairs.

Nothing of a hot shingle meets in one task: its entries are dealt over many blocks, leaders are found
by aggregates, and full pairing goes through an equi-join on the shingle, the step of size and two
blocks of classes. Tables that were written are deleted when their last reader is done. Texts are
shuffled only where a fixed-size bitmap of the wanted documents lets them through.

A class is named by 64 bits; among N different texts about N * N / 2**65 pairs are expected to share a
name and would be taken for equal (3e-5 pairs at 3e7 texts, and one pair at 6e9).

Defined results: null, empty and blank texts have an empty set and link with nothing; a text of
fewer than five words has one shingle, all its words; a document with a null doc_id gets no
component; rows with equal doc_id are told apart by their sets and share their id's component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import discard, materialize, sieve, sifted, slices
from tagloom.llm.components import components

WIDTH = 5
SHARE = 80  # of 100
CHUNK = 500_000  # bytes of text hashed at a time
STRETCH = 4_000_000  # shingles counted together
MOST_HOT = 400_000
LEAST_HOT = 16
SMALL_RUN = 128
BLOCK_CLASSES = 4_000
FULL_BLOCK = 1_000  # classes of one hot shingle that are paired with each other in one group
SALTS = 16
LEADERS = 4
WORDS = 4  # of 64 bits, in the small bitmap that goes with each entry of a hot shingle
SIZE_STEP = 1.25  # sizes of linked sets are at most one step apart

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MASK = (1 << 64) - 1
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SOLID = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    data = b" ".join(texts).translate(LOWER)
    a = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(SOLID[a].view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(a) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], dtype=np.uint64)])
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, first)
    weights = mix(np.arange(1, width + 1, dtype=np.uint64) * BASE)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(width):
        rolled += mix(words[i : i + n] * weights[i] + np.uint64(i))
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = mix(words[a:b] * weights[: b - a] + np.arange(b - a, dtype=np.uint64))
            out.append(mix(whole.sum(keepdims=True, dtype=np.uint64) + np.uint64((b - a) * int(BASE) & MASK)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set, from two sums over its members and their number."""
    low, high = int(s.sum(dtype=np.uint64)), int(mix(s ^ BASE).sum(dtype=np.uint64))
    both = mix(np.array([low + len(s) & MASK, high * int(BASE) & MASK], np.uint64))
    return int(mix(both[:1] + mix(both[1:] ^ BASE)).view(np.int64)[0])


def needed(n: int) -> int:
    """The fewest members that a set of n must share with any set it links with."""
    return -(-SHARE * n // 100)


def prefix(s: np.ndarray, hot: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The first members of a set that a linked set must meet, which of them are hot, and how many of the set are cold."""
    size = len(s) - needed(len(s)) + 1
    at = np.minimum(np.searchsorted(hot, s), max(0, len(hot) - 1))
    is_hot = hot[at] == s if len(hot) else np.zeros(len(s), bool)
    cold = s[~is_hot]
    late = s[is_hot][np.argsort(order[at[is_hot]], kind="stable")][: size - len(cold)] if len(cold) < size else s[:0]
    return np.concatenate([cold[:size], late]), np.arange(size) >= len(cold), len(cold)


def parity_bits(s: np.ndarray) -> bytes:
    """A bitmap of about two bits for each member (a power of two): the parity of the members that fall on each bit."""
    m = 1 << max(6, (2 * len(s) - 1).bit_length())
    at = (mix(s) & np.uint64(m - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def parity_words(s: np.ndarray) -> list[int]:
    """The same in a bitmap of one size for all sets, as integers."""
    at = (mix(s) & np.uint64(64 * WORDS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * WORDS) & 1).astype(np.uint8), bitorder="little").view("<i8").tolist()


def differing_bits(a: bytes, b: bytes) -> int:
    """In how many bits two bitmaps differ, the longer folded to the shorter; never more than the sets do in members."""
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * max(len(a), len(b))
    if len(a) < len(b):
        x, y = y, x
    while n > 8 * min(len(a), len(b)):
        n //= 2
        x = (x >> n) ^ (x & (1 << n) - 1)
    return (x ^ y).bit_count()


def describe(docs: DataFrame) -> DataFrame:
    """The class of every document (times 0: doc_id, n, h the class's name, bits, words), and counts of shingles (h, times) that recur within a stretch."""

    def each(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def frequent():
            h, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= 2
            k = int(often.sum())
            return _rows([None] * k, [None] * k, h[often].view(np.int64), times[often], [None] * k, [None] * k)

        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                ns, cids, bits, words = [], [], [], []
                for s in shingle_sets([t or b"" for t in part.column(1).to_pylist()]):
                    cid = class_of(s)
                    ns.append(len(s))
                    cids.append(cid)
                    bits.append(parity_bits(s) if len(s) else None)
                    words.append(parity_words(s) if len(s) else None)
                    if cid not in seen:
                        seen.add(cid)
                        held.append(s)
                        size += len(s)
                yield _rows(part.column(0), ns, cids, [0] * len(ns), bits, words)
                if size >= STRETCH:
                    yield frequent()
                    seen, held, size = set(), [], 0
        if held:
            yield frequent()

    def _rows(doc_id, n, h, times, bits, words):
        return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(times, pa.int64()), pa.array(bits, pa.binary()), pa.array(words, pa.list_(pa.int64()))], ["doc_id", "n", "h", "times", "bits", "words"])

    return materialize(_texts(docs).mapInArrow(each, "doc_id bigint, n bigint, h bigint, times bigint, bits binary, words array<bigint>"), "jaccard-classes")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))


def hot_shingles(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hot shingles, sorted, and their place among the hot. At most MOST_HOT: a sum of E over counts of T or more leaves no more than E / T."""
    every = counts.agg(F.sum("times")).first()[0] or 0
    least = max(LEAST_HOT, -(-every // MOST_HOT))
    got = counts.groupBy("h").agg(F.sum("times").alias("times")).where(F.col("times") >= least).toArrow()
    h = np.array(got.column("h").to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
    times = np.array(got.column("times").to_numpy(zero_copy_only=False), np.int64)
    by = np.argsort(h)
    h, times = h[by], times[by]
    place = np.empty(len(h), np.int64)
    place[np.lexsort((h, times))] = np.arange(len(h))
    return h, np.stack([place, times])


ENTRY = ("k", "h", "cid", "n", "pos", "cold")


def postings(spark: SparkSession, docs: DataFrame, hot: np.ndarray, order: np.ndarray) -> DataFrame:
    """Entries of the incidence matrix that the size bound leaves.

    k: the shingle, or one of a hot shingle's blocks; h: a hot shingle, else 0; cid: the class; n: its
    size; pos: place in its order; cold: for entries of hot shingles, how many cold ones the class has.
    """
    shared = spark.sparkContext.broadcast((hot, order))

    def each(batches):
        hot, (place, times) = shared.value
        blocks = np.maximum(1, -(-8 * times // BLOCK_CLASSES))
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                out: list[list[np.ndarray]] = [[] for _ in ENTRY]
                for s in shingle_sets([t or b"" for t in part.column(1).to_pylist()]):
                    if not len(s) or (cid := class_of(s)) in seen:
                        continue
                    seen.add(cid)
                    h, is_hot, cold = prefix(s, hot, place)
                    key = h.copy()
                    if is_hot.any():
                        own = h[is_hot]
                        block = np.uint64(cid & (1 << 63) - 1) % blocks[np.searchsorted(hot, own)].astype(np.uint64)
                        key[is_hot] = mix(own + (block + np.uint64(1)) * BASE)
                    size = len(h)
                    rows = (key.view(np.int64), np.where(is_hot, h, np.uint64(0)).view(np.int64), np.full(size, cid, np.int64), np.full(size, len(s), np.int32), np.arange(size, dtype=np.int32), np.where(is_hot, cold, 0).astype(np.int32))
                    for column, values in zip(out, rows, strict=True):
                        column.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ENTRY)
                if len(seen) > 500_000:
                    seen = set()

    return _texts(docs).mapInArrow(each, "k bigint, h bigint, cid bigint, n int, pos int, cold int")


def product(entries: DataFrame) -> DataFrame:
    """The product of each block with itself, and the entries of shingles with many classes.

    Pairs (h null): a < b, their sizes n and m, and in ``shared`` how many shingles of this block they
    were found to share. Entries: a (the class), h (the shingle), n, pos and cold.
    """

    def run_rows(parted, k, h, cid, n, pos, cold):
        first = np.concatenate([[True], (k[1:] != k[:-1]) | (cid[1:] != cid[:-1])])
        k, h, cid, n, pos, cold = (x[first] for x in (k, h, cid, n, pos, cold))
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(at, len(k)))
        many = (size > SMALL_RUN) | (h[at] != 0) | np.isin(k[at], parted)
        big = np.repeat(many, size)
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        left, right = [], []
        for width in np.unique(size[~many]).tolist():
            runs = at[(size == width) & ~many]
            x, y = np.triu_indices(width, 1)
            x, y = (runs[:, None] + x).ravel(), (runs[:, None] + y).ravel()
            # what both may share before this place, here and after it, against what a link needs
            most = np.minimum(pos[x], pos[y]) + np.minimum(n[x] - pos[x], n[y] - pos[y])
            near = 9 * most >= 4 * (n[x] + n[y])
            left.append(x[near])
            right.append(y[near])
        left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        swap = cid[left] > cid[right]
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        order = np.lexsort((cid[right], cid[left]))
        left, right = left[order], right[order]
        new = np.ones(len(left), bool)
        new[1:] = (cid[left[1:]] != cid[left[:-1]]) | (cid[right[1:]] != cid[right[:-1]])
        start = np.flatnonzero(new)
        shared = np.diff(np.append(start, len(left)))
        left, right = left[start], right[start]
        none, blank = pa.nulls(len(left), pa.int64()), pa.nulls(len(left), pa.int32())
        small = lambda x: pa.array(x.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(cid[left]), pa.array(cid[right]), none, small(n[left]), small(n[right]), small(shared), blank, blank], NAMES)
        none, blank = pa.nulls(int(big.sum()), pa.int64()), pa.nulls(int(big.sum()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(cid[big]), none, pa.array(np.where(h == 0, k, h)[big]), small(n[big]), blank, blank, small(pos[big]), small(cold[big])], NAMES)

    def each(batches):
        tail = None
        parted: list[int] = []  # keys of runs that are passed on in parts, each of which counts as large
        for batch in batches:
            now = [np.array(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
            if tail is not None:
                now = [np.concatenate(x) for x in zip(tail, now, strict=True)]
            k = now[0]
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1], side="left"))  # the last run may go on
            if len(k) - cut > 200_000:  # a run so long is passed on in parts
                cut = len(k)
                parted.append(int(k[-1]))
            if cut:
                yield from run_rows(parted, *(x[:cut] for x in now))
            tail = [x[cut:] for x in now]
        if tail is not None and len(tail[0]):
            yield from run_rows(parted, *tail)

    return entries.repartition("k").sortWithinPartitions("k", "cid").mapInArrow(each, "a bigint, b bigint, h bigint, n int, m int, shared int, pos int, cold int")


NAMES = ["a", "b", "h", "n", "m", "shared", "pos", "cold"]


def counted(parts: DataFrame, entries: DataFrame) -> DataFrame:
    """The pairs (a, b) whose overlap, summed over the blocks, allows a link."""
    pairs = parts.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    uncounted = entries.groupBy("cid").agg(F.count("*").alias("more"))
    of = lambda side: uncounted.select(F.col("cid").alias(side), F.col("more").alias(f"more_{side}"))
    rest = F.expr(f"greatest(({SHARE}L * n + 99) div 100, ({SHARE}L * m + 99) div 100) - 1")
    most = F.col("shared") + F.coalesce(F.least("more_a", "more_b"), F.lit(0)) + rest
    told = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({f"more_{x}": F.coalesce(f"more_{x}", F.lit(0)) for x in "ab"})
    return told.where(9 * most >= 4 * (F.col("n") + F.col("m"))).select("a", "b")


def within_bound(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose bitmaps (cid, n, bits) allow a link."""
    left = sketches.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = sketches.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))

    def each(batches):
        for batch in batches:
            _, _, na, nb, ba, bb = (c.to_pylist() for c in batch.columns)
            keep = [(100 + SHARE) * differing_bits(x, y) <= (100 - SHARE) * (n + m) for n, m, x, y in zip(na, nb, ba, bb, strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(each, "a bigint, b bigint")


def check(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, decided on the texts (cid, text) of both. Only texts that a pair may need are shuffled."""
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b"))
    texts = sifted(texts, "cid", sieve(ids, "cid")).where("__may").drop("__may")
    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))

    def each(batches):
        cache: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []

            def members(cid: int, column: int, i: int) -> np.ndarray:
                s = cache.get(cid)
                if s is None:
                    if len(cache) >= 200:
                        del cache[next(iter(cache))]
                    s = cache[cid] = shingle_sets([batch.column(column)[i].as_py()])[0]
                return s

            for i in range(len(a)):
                x, y = members(a[i], 2, i), members(b[i], 3, i)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= SHARE * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(each, "a bigint, b bigint")


def class_texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of one document of each wanted class. Only texts that the bitmap of wanted documents lets through are shuffled."""
    of = classes.where("n > 0 and doc_id is not null").join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    of = materialize(of, "jaccard-wanted")
    met = sifted(_texts(docs), "doc_id", sieve(of, "doc_id")).where("__may").drop("__may").join(of.hint("merge"), "doc_id")
    # repeated rows of one doc_id and text lie together already; a second text of the same class would only repeat links
    met = met.withColumn("own", F.xxhash64("text")).dropDuplicates(["doc_id", "cid", "own"]).select("cid", "text")

    def each(batches):
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                own = [class_of(s) for s in shingle_sets([t or b"" for t in part.column(1).to_pylist()])]
                yield part.filter(pa.array([x == y for x, y in zip(part.column(0).to_pylist(), own, strict=True)], pa.bool_()))

    texts = materialize(met.mapInArrow(each, "cid bigint, text binary"), "jaccard-texts")
    discard(of)
    return texts


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def leader_pairs(entries: DataFrame, labels: DataFrame, order: int) -> DataFrame:
    """Pairs of a class with leaders in other components: those of like size with the fewest cold shingles.

    Classes meet at one of their hot shingles, the first in a hashed order, which near copies mostly share.
    """
    own = entries.groupBy("cid").agg(F.min(F.struct(F.xxhash64("h", F.lit(order)).alias("x"), "h")).alias("at"), F.max("n").alias("n"), F.max("cold").alias("cold"))
    own = own.select("cid", F.col("at.h").alias("h"), "n", "cold", F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).alias("step"))
    lead = F.struct((F.col("cold") * 1000 / F.col("n")).cast("long").alias("share"), F.xxhash64("cid", F.lit(order)).alias("x"), "cid", "n")
    first = own.groupBy("h", "step").agg(F.min(lead).alias("f"))
    first = _labelled(first.select("h", "step", F.col("f.cid").alias("cid"), F.col("f.n").alias("m")), labels).select("h", F.explode(F.array(*(F.col("step") + i for i in (-1, 0, 1)))).alias("step"), F.col("cid").alias("b"), "m", F.col("label").alias("to"))
    near = F.expr(f"100L * least(n, m) >= {SHARE}L * greatest(n, m)")
    met = _labelled(own, labels).join(first, ["h", "step"]).where("label <> to").where(near)
    return met.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct()


def full_pairs(entries: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """All pairs of classes in different components that meet at a hot shingle and that the bounds leave, that of the small bitmap included.

    A link between sets that differ in all their cold shingles leaves each at most a quarter of its size cold.
    """
    small = sketches.select("cid", *[F.col("words")[i].alias(f"w{i}") for i in range(WORDS)])
    labelled = _labelled(entries.where("4L * cold <= n"), labels)
    spread = labelled.groupBy("h").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("times")).where("least <> most")
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
    spread = spread.select("h", F.ceil(F.col("times") / FULL_BLOCK).alias("blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    spread = spread.repartition("h", "salt")  # lying by h as it does, it would draw all entries of a shingle into one task
    rest = labelled.withColumn("salt", salt("cid")).join(spread, ["h", "salt"]).drop("salt").join(small, "cid")
    rest = rest.withColumns({"step": F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))), "block": F.pmod(F.xxhash64("cid", "h"), F.col("blocks"))})
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    one = rest.withColumn("other", every)
    two = rest.withColumn("other", F.col("block")).drop("block").withColumn("block", every).withColumn("step", F.explode(F.array(*(F.col("step") + i for i in (-1, 0, 1)))))
    two = two.select("h", "step", "block", "other", F.col("cid").alias("b"), F.col("n").alias("m"), F.col("pos").alias("place"), F.col("cold").alias("chill"), F.col("label").alias("to"), *[F.col(f"w{i}").alias(f"v{i}") for i in range(WORDS)])
    differ = " + ".join(f"bit_count(w{i} ^ v{i})" for i in range(WORDS))
    room = F.expr(f"9L * (n - pos) >= 4L * (n + m) and 9L * (m - place) >= 4L * (n + m) and 9L * (cold + chill) <= n + m and 9L * ({differ}) <= n + m")
    return one.join(two, ["h", "step", "block", "other"]).where("cid < b and label <> to").where(room).select(F.col("cid").alias("a"), "b").distinct()


def link_components(docs: DataFrame, classes: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, label): classes that link, directly or through others, by the smallest class name among them."""
    spark = docs.sparkSession
    hot, order = hot_shingles(counts)
    found = materialize(product(postings(spark, docs, hot, order)), "jaccard-product")
    entries = materialize(found.where("h is not null").select("h", F.col("a").alias("cid"), "n", "pos", "cold").distinct(), "jaccard-hot")
    pairs = materialize(counted(found.where("h is null"), entries), "jaccard-pairs")
    discard(found)
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(entries.select("cid")).distinct()
    texts = class_texts(docs, classes, wanted)
    links, tested = [materialize(check(pairs, texts), "jaccard-links")], [pairs]
    labels = components(links[0])
    if not entries.isEmpty():
        hot_ids = entries.select("cid").distinct()
        sketches = sifted(classes.where("n > 0").drop("doc_id"), "cid", sieve(hot_ids, "cid")).where("__may").join(hot_ids, "cid", "left_semi")
        sketches = materialize(sketches.groupBy("cid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("words").alias("words")), "jaccard-sketches")
        for k in [*range(LEADERS), None]:
            more = full_pairs(entries, labels, sketches) if k is None else leader_pairs(entries, labels, k)
            more = materialize(within_bound(more.join(_union(tested), ["a", "b"], "left_anti"), sketches), f"jaccard-more-{k}")
            tested.append(more)
            if not more.isEmpty():
                links.append(materialize(check(more, texts), f"jaccard-links-{k}"))
                discard(labels)
                labels = components(_union(links))
        discard(sketches)
    discard(entries, texts, *links, *tested)
    return labels


def _union(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for t in tables[1:]:
        every = every.union(t)
    return every


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    described = describe(docs)
    classes = described.where("times = 0").select("doc_id", "n", F.col("h").alias("cid"), "bits", "words")
    labels = link_components(docs, classes, described.where("times > 0").select("h", "times"))
    heads = classes.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("head"))
    led = heads.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = led.groupBy("label").agg(F.min("head").alias("component"))
    ids = led.join(least, "label").select("cid", "component")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    told = classes.join(ids, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, own).otherwise(F.col("doc_id")).alias("component_id"))
    told = materialize(told, "jaccard-components")
    discard(described, labels)
    return told
