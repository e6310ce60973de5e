r"""Phrase collocations from vertical positional inverted lists.

Texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and tabs, with
A-Z lower-cased. Some megabytes of texts make a block, whose words are numbered one after the other,
with a gap between pieces; a block is held as inverted lists: for each word the ascending places at
which it stands. Everything is counted per lang.

1. Words are counted in a pass of their own, combined in each task before the exchange. A word's number is a hash
   of it and its lang, of as few bits as are enough (they cost space in what is shuffled later): if a frequent word
   shared its number with any other word, more bits would be taken, so that numbers name frequent words exactly.
   Words below ``least`` go, since every part of a phrase is at least as frequent as the phrase.
2. A second pass writes each block's lists of the words that are frequent, as a bitmap tells that all tasks
   share. Its size is bounded; a word that it lets through wrongly costs time but counts for nothing in the end.
3. Within a block, the places of phrases of k words are merge-joined with the postings of the word that
   stands behind them. Places are taken only where the first k and the last k words are frequent phrases, as the
   bitmap of those tells. The join gives the lists of the block's phrases of k + 1 words.
4. List lengths are summed over the blocks: exact frequencies. Phrases below ``least`` go, the others make the
   next bitmap.

What is shuffled are counts alone: of words, and of phrases. A phrase has one row for each block at
most, whatever its frequency, and a task holds one block at a time. A bitmap has up to ``MOST_BITS`` bits; with
more than some 1e8 frequent phrases of a length it lets more and more through, which costs time.

A phrase of 2 words or more is a candidate. Cut after its first k words it scores
floor(2000000 * a / (l + r)) with a, l and r the frequencies of the phrase, its first part and its rest;
its lowest cut counts, the first of equal ones. Candidates go that stand in a longer candidate at
least 80 % as frequent. The ``top`` of each lang are found by a tree of bounded choices.

Defined results: null and empty texts have no words; a null lang counts as ``und``; a text has any
length; repeated rows count each; an empty table, or one without frequent phrases, gives an empty
result; columns other than text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import discard, materialize, slices, small_batches

LEAST = 30
LONGEST = 4
TOP = 2000
COVER = 80  # of 100
BLOCK_BYTES = 4_000_000
HELD_WORDS = 200_000
ROWS_OUT = 100_000
MOST_BITS = 1 << 28  # 32 MB
CANDIDATES_PER_BUCKET = 50_000
BUCKETS_MERGED = 16

#: A-Z to a-z; the marks between pieces to a line end.
SIGNS = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same with blanks for those marks, where only words count.
ONE_GAP = bytes(32 if b == 10 else b for b in SIGNS)
GAP = b""


def numbered_words(text: bytes) -> list[bytes]:
    """The words in order, with a ``GAP`` after each piece."""
    out: list[bytes] = []
    for piece in text.translate(SIGNS).split(b"\n"):
        words = piece.split()
        if words:
            out += words
            out.append(GAP)
    return out


def number_of(lang: str, word: bytes, seed: int) -> int:
    """A 64-bit number for a word of a lang."""
    return xxhash.xxh64_intdigest(lang.encode() + b"\n" + word, seed)


def _mask(bits: int) -> int:
    return (1 << bits) - 1 if bits < 64 else -1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(lang, word, id, f) of all words, id being the number."""

    def each(batches):
        held: dict[str, Counter[bytes]] = {}

        def rows():
            for lang, own in held.items():
                ids = np.fromiter((number_of(lang, w, seed) for w in own), np.uint64, len(own)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(ids), pa.array(list(own.values()), pa.int64())], ["lang", "word", "id", "n"])

        size = 0
        for batch in (part for b in batches for part in slices(b, 1, BLOCK_BYTES)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, Counter()).update(text.translate(ONE_GAP).split())
                    size += len(text)
            if sum(map(len, held.values())) >= HELD_WORDS or size >= 16 * BLOCK_BYTES:
                yield from rows()
                held, size = {}, 0
        yield from rows()

    counted = _texts(docs).mapInArrow(each, "lang string, word string, id bigint, n bigint")
    return counted.groupBy("lang", "word", "id").agg(F.sum("n").alias("f"))


def frequent_words(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int, int]:
    """The frequent words (lang, word, id, f), (lang, n), the number of all words, and the seed and bits of their numbers."""
    for seed in count():
        with small_batches(docs.sparkSession, 1000):
            every = materialize(word_counts(docs, seed), "words")
        words, often = every.agg(F.count("*"), F.count_if(F.col("f") >= least)).first()
        # with so many bits, one pair of equal numbers is expected in 64 tries
        for bits in range(max(1, words).bit_length() + max(1, often).bit_length() + 6, 69, 4):
            bits = min(bits, 64)
            number = F.col("id").bitwiseAND(F.lit(_mask(bits))).alias("id")
            shared = every.select(number, "f").groupBy("id").agg(F.count("*").alias("n"), F.max("f").alias("f")).where(f"n > 1 and f >= {least}")
            if shared.isEmpty():
                totals = materialize(every.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
                found = materialize(every.where(F.col("f") >= least).select("lang", "word", number, "f"), "frequent-words")
                discard(every)
                return found, totals, seed, bits
        discard(every)


def block_lists(docs: DataFrame, frequent: np.ndarray, seed: int, bits: int) -> DataFrame:
    """One row for each block: the numbers of its words that the bitmap lets through, the lengths of their lists, and the lists one after the other."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def lists(own: dict[str, dict[bytes, int]], held: list[np.ndarray]) -> pa.RecordBatch:
        at = np.concatenate(held)
        numbers = np.zeros(sum(map(len, own.values())), np.uint64)
        named = np.zeros(len(numbers), bool)
        for lang, of in own.items():
            for word, i in of.items():
                if word != GAP:
                    numbers[i], named[i] = number_of(lang, word, seed), True
        ids = numbers.view(np.int64) & _mask(bits)
        kept = named & _told(shared.value, [ids])
        sizes = np.bincount(at, minlength=len(ids))[kept]
        places = np.flatnonzero(kept[at])
        order = np.argsort(at[places], kind="stable")
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.RecordBatch.from_arrays([one(ids[kept], pa.int64()), one(sizes.astype(np.int32), pa.int32()), one(places[order].astype(np.int32), pa.int32())], ["ids", "sizes", "pos"])

    def each(batches):
        size, held = 0, []
        number = count()
        own: dict[str, dict[bytes, int]] = {}
        for batch in (part for b in batches for part in slices(b, 1, BLOCK_BYTES)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = numbered_words(text) if text else []
                if not words:
                    continue
                if lang not in own:
                    own[lang] = defaultdict(number.__next__)
                held.append(np.fromiter(map(own[lang].__getitem__, words), np.int32, len(words)))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield lists(own, held)
                    size, held, number, own = 0, [], count(), {}
        if held:
            yield lists(own, held)

    return _texts(docs).mapInArrow(each, "ids array<bigint>, sizes array<int>, pos array<int>")


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h * np.uint64(0x94D049BB133111EB)


def bitmap(phrases: DataFrame, words: list[str], rows: int) -> np.ndarray:
    """A bitmap of the phrases (columns of word numbers), about 16 bits for each and MOST_BITS at most, as unsigned 64-bit integers."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * rows - 1).bit_length()))

    def each(batches):
        for batch in batches:
            at = _mixed([np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(len(words))]) & np.uint64(bits - 1)
            at = np.unique(at)
            cell, first = np.unique(at >> np.uint64(6), return_index=True)
            held = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(held.view(np.int64))], ["cell", "held"])

    set_bits = phrases.select(*words).mapInArrow(each, "cell bigint, held bigint").groupBy("cell").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[set_bits.column("cell").to_numpy()] = set_bits.column("held").to_numpy().view(np.uint64)
    return out


def _told(held: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    at = _mixed(columns) & np.uint64(64 * len(held) - 1)
    return (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def merged_lists(ids: np.ndarray, pos: np.ndarray, sizes: np.ndarray, bitmaps: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The phrases of len(bitmaps) + 2 words of a block, as columns of word numbers, and the lengths of their lists.

    ids and sizes: the block's words and the lengths of their lists, which lie one after the other in ``pos``; bitmaps: of the
    frequent phrases of 2, 3 ... words.
    """
    # the place of each place's word in ids, and none where a piece ends or a rare word stands
    word = np.full(int(pos.max(initial=0)) + 2, -1, np.int32)
    word[pos] = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    # places where a frequent word stands; then where a frequent phrase of 2 words begins, and so on
    places = np.flatnonzero(word >= 0).astype(np.int32)
    for k, told in enumerate([*bitmaps, None], 2):
        behind = np.zeros(len(word), bool)
        behind[places] = True
        places = places[behind[places + 1]]  # what stands one place later is frequent too, and ends with the word behind
        if told is not None:
            places = places[_told(told, [ids[word[places + i]] for i in range(k)])]
    columns = [word[places + i] for i in range(len(bitmaps) + 2)]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [ids[c[first]] for c in columns], np.diff(np.append(first, len(order)))


def counted(blocks: DataFrame, bitmaps: list[np.ndarray], least: int) -> DataFrame:
    """w1, w2 ... and f: the frequent phrases of len(bitmaps) + 2 words."""
    shared = blocks.sparkSession.sparkContext.broadcast(bitmaps)
    words = [f"w{i + 1}" for i in range(len(bitmaps) + 2)]

    def each(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, pos = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in range(3))
                columns, n = merged_lists(ids, pos, sizes, shared.value)
                for a in range(0, len(n), ROWS_OUT):
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[a : a + ROWS_OUT]) for c in columns), pa.array(n[a : a + ROWS_OUT])], [*words, "n"])

    schema = ", ".join(f"{w} bigint" for w in words) + ", n bigint"
    return blocks.select("ids", "sizes", "pos").mapInArrow(each, schema).groupBy(*words).agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _parts(words: int) -> list[tuple[int, int]]:
    """Places and lengths of the shorter phrases of two words and more in a phrase."""
    return [(i, n) for n in range(2, words) for i in range(1, words - n + 2)]


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1, 2 ... ``longest`` words, each in a written table, and (lang, n), the number of words.

    ids: the numbers of the words; lang; words; f the frequency; firsts and lasts: the frequencies of its first and last 1, 2 ... words.
    """
    numbered, totals, seed, bits = frequent_words(docs, least)
    held = bitmap(numbered, ["id"], numbered.count())
    with small_batches(docs.sparkSession, 1000):
        blocks = materialize(block_lists(docs, held, seed, bits), "blocks")
    none = F.array().cast("array<bigint>")
    levels = [materialize(numbered.select(F.array("id").alias("ids"), "lang", F.array("word").alias("words"), "f", none.alias("firsts"), none.alias("lasts")), "phrases-1")]
    discard(numbered)
    bitmaps: list[np.ndarray] = []
    for k in range(2, longest + 1):
        words = [f"w{i + 1}" for i in range(k)]
        with small_batches(docs.sparkSession, 1):  # a block at a time
            found = materialize(counted(blocks, bitmaps, least), f"counted-{k}")
        of = lambda side, ids: levels[-1].select(F.col("ids").alias(ids), *[F.col(c).alias(f"{side}_{c}") for c in ("lang", "words", "f", "firsts", "lasts")])
        told = found.select(F.array(*words).alias("ids"), F.array(*words[:-1]).alias("a"), F.array(*words[1:]).alias("b"), "f")
        named = told.join(of("a", "a"), "a").join(of("b", "b"), "b").select(
            "ids", F.col("a_lang").alias("lang"), F.concat("a_words", F.slice("b_words", -1, 1)).alias("words"), "f",
            F.concat("a_firsts", F.array("a_f")).alias("firsts"), F.concat("b_lasts", F.array("b_f")).alias("lasts"),
        )
        levels.append(materialize(named, f"phrases-{k}"))
        if k < longest:
            bitmaps.append(bitmap(found, words, found.count()))
        discard(found)
    discard(blocks)
    return levels, totals


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` collocations of each lang.

    >>> mine(spark.read.parquet("documents"), least=30)  # doctest: +SKIP
    """
    levels, totals = phrases(docs, least, longest)
    every, inside = None, None
    for k, level in enumerate(levels[1:], 2):
        every = level if every is None else every.unionByName(level)
        for part in [F.slice("ids", i, n) for i, n in _parts(k)]:
            covered = level.select(part.alias("ids"), "f")
            inside = covered if inside is None else inside.unionByName(covered)
    covering = inside.groupBy("ids").agg(F.max("f").alias("most")) if inside is not None else every.select("ids", F.lit(None).cast("bigint").alias("most")).limit(0)
    # decimals: the products may pass 64 bits
    left = every.join(covering, "ids", "left").where(f"most is null or 100BD * most < {COVER}BD * f")
    cuts = F.expr("transform(sequence(1, size(firsts)), j -> struct((2000000BD * f) div (firsts[j - 1] + lasts[size(firsts) - j]) as score, j as k, firsts[j - 1] as l, lasts[size(firsts) - j] as r))")
    scored = left.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.array_min(cuts).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    buckets = max(1, -(-every.count() // CANDIDATES_PER_BUCKET))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = scored.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    while buckets > 1:  # no more than BUCKETS_MERGED * top rows of a lang meet at once
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*best))).where(F.col("rank") <= top)
        scored = scored.withColumn("bucket", F.expr(f"bucket div {BUCKETS_MERGED}"))
        buckets = -(-buckets // BUCKETS_MERGED)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    out = materialize(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(*levels, totals)
    return out
