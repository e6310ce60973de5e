r"""Spelling variants by wildcard groups, without pairs.

Words are runs of letters of at least ``least_length`` code points that occur at least ``least`` times.
Two words are near if one inserted, deleted or replaced code point makes them equal. Words are numbered
by falling count, equal counts in code-point order, so that of any words the one of the smallest number
is the best; only numbers meet in what follows.

1. Replacements. A word belongs to one group for each of its positions: (position, prefix, suffix).
   The members of a group are near to each other and a pair of near words of equal length shares one
   group, so that a group's size less one, summed over a word's groups, counts them. A group keeps its
   size and its two best words: the best near word of a member is the first, or the second for the first.
2. Insertions and deletions. Each distinct deletion of one code point from a word joins the vocabulary;
   a hit is a near word for both sides.
3. What both give is combined by word: counts are summed, numbers compared.

A word's form is its best near word if that is at least ``ratio`` times as frequent, its root the end
of the chain of forms, found by pointer jumping: counts grow along a chain, so it ends.

Prefixes, suffixes and deletions are named by 128 bits: two sums of a pseudorandom number for each (code point, position),
kept as running sums, so that a word of n code points costs n steps and n rows of fixed size, however
long it is. Among 1e10 names two are equal by chance with a probability of about 1e-19. A group has at
most as many members as the alphabet has letters, and a word at most that many times its length of
near words, so no key is hot after the counts; those are summed before the exchange.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one in
:func:`tokens`' hash; texts and words have any length; repeated rows count each; an empty table gives an
empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import discard, materialize, slices

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SLICE = 4_000_000
HELD_WORDS, HELD_BYTES = 200_000, 16_000_000
WORD_SLICE = 100_000
DROP_EVERY = 199
LEAST_LENGTH, LEAST, RATIO = 6, 5, 5
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def tokens(doc_id: int | None, text: bytes, drop_every: int = DROP_EVERY) -> Counter[str]:
    """The runs of a text and how often each occurs; a run whose crc32 with the doc_id ``drop_every`` divides loses one code point."""
    runs = Counter(RUN.findall(text.translate(LOWER).decode()))
    own = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    cut = [(run, h % len(run)) for run in runs if (h := zlib.crc32(run.encode(), own)) % drop_every == 0]
    shorter = [(run[:at] + run[at + 1 :], runs.pop(run)) for run, at in cut]
    for word, n in shorter:
        runs[word] += n
    return runs


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST, drop_every: int = DROP_EVERY) -> DataFrame:
    """(id, word, n), ids rising with falling n and then with the word; written."""

    def each(batches):
        held: Counter[str] = Counter()
        size = 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in (part for b in batches for part in slices(b, 1, SLICE)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in tokens(doc_id, text, drop_every).items() if text else ():
                    if len(word) >= least_length:
                        if word not in held:
                            size += len(word)
                        held[word] += n
                if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                    yield rows()
                    held, size = Counter(), 0
        if held:
            yield rows()

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(each, "word string, n bigint")
    words = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = materialize(words, "spelling-words")
    ranked = materialize(words.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-vocabulary")
    discard(words)
    return ranked


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signs(points: np.ndarray, places: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A pseudorandom number for each code point at its position."""
    return _spread(_spread(points.astype(np.uint64) + seed) + places.astype(np.uint64) * seed)


WHOLE, WILD, SHORTER = 0, 1, 2


def names(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, owner, x, y): for every word its own name, those of its groups, and those of its distinct deletions.

    owner is the place in ``words``, x and y are the 128 bits.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - first[owner]
    # of equal code points in a row, the deletion of any gives the same word
    fresh = (place == 0) | (points != np.concatenate([[0], points[:-1]]))
    out = []
    for seed in SEEDS:
        here, left = _signs(points, place + 1, seed), _signs(points, place, seed)  # at its position, and moved one to the left
        run, moved = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)]) for v in (here, left))
        ends = first + sizes
        length = lambda n: _spread(n.astype(np.uint64) * seed + np.uint64(1))  # noqa: E731, B023
        whole = run[ends] - run[first]
        wild = whole[owner] - here + _spread((place + 1).astype(np.uint64) ^ seed) + length(sizes[owner])
        at = np.arange(len(points))
        gone = (run[at] - run[first[owner]]) + (moved[ends[owner]] - moved[at + 1]) + length(sizes[owner] - 1)
        out.append(np.concatenate([whole + length(sizes), wild, gone[fresh]]).view(np.int64))
    kind = np.repeat(np.array([WHOLE, WILD, SHORTER], np.int8), [len(words), len(points), int(fresh.sum())])
    return kind, np.concatenate([np.arange(len(words)), owner, owner[fresh]]), *out


def named(words: DataFrame) -> DataFrame:
    """(kind, x, y, id) for every word of a vocabulary, as :func:`names` has them."""

    def each(batches):
        for batch in (part for b in batches for part in slices(b, 1, WORD_SLICE)):
            kind, owner, x, y = names(batch.column(1).to_pylist())
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))[owner]
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(x), pa.array(y), pa.array(ids)], ["kind", "x", "y", "id"])

    return words.select("id", "word").mapInArrow(each, "kind int, x bigint, y bigint, id bigint")


def near(words: DataFrame) -> DataFrame:
    """(id, n_near, best) for each word of the vocabulary that has near words."""
    every = materialize(named(words), "spelling-names")
    wild = every.where(F.col("kind") == WILD)
    # a group has one member for each letter of the alphabet at most
    top = F.slice(F.array_sort(F.collect_list("id")), 1, 2)
    groups = wild.groupBy("x", "y").agg(F.count("*").alias("size"), top.alias("top")).where("size > 1")
    replaced = wild.join(groups, ["x", "y"]).select("id", (F.col("size") - 1).alias("n"), F.when(F.col("top")[0] != F.col("id"), F.col("top")[0]).otherwise(F.col("top")[1]).alias("best"))
    whole = every.where(F.col("kind") == WHOLE).select("x", "y", F.col("id").alias("short"))
    hits = every.where(F.col("kind") == SHORTER).join(whole, ["x", "y"])
    moved = hits.select(F.explode(F.array(F.struct(F.col("id"), F.col("short").alias("best")), F.struct(F.col("short").alias("id"), F.col("id").alias("best")))).alias("h")).select("h.id", F.lit(1).cast("long").alias("n"), "h.best")
    told = materialize(replaced.unionByName(moved).groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best")), "spelling-near")
    discard(every)
    return told


def roots(links: DataFrame) -> DataFrame:
    """(id, root) for links (id, to) without cycles: the end of each chain, by pointer jumping."""
    now = materialize(links.select("id", F.col("to").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("then"))
        step = materialize(now.join(onward, "root", "left").select("id", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = step
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST, ratio: int = RATIO, drop_every: int = DROP_EVERY) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    >>> variants(spark.read.parquet("documents")).where("form is not null")  # doctest: +SKIP
    """
    words = vocabulary(docs, least_length, least, drop_every)
    met = near(words)
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    linked = words.join(met, "id").join(best, "best").where(F.col("form_n") >= F.lit(ratio) * F.col("n"))
    links = materialize(linked.select("id", F.col("best").alias("to"), "form", "form_n"), "spelling-links")
    ends = roots(links)
    named_roots = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = words.join(met.select("id", "n_near"), "id", "left").join(links.select("id", "form", "form_n"), "id", "left").join(named_roots, "id", "left")
    out = materialize(out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "spelling-variants")
    discard(words, met, links, ends)
    return out
