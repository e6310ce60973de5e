r"""Byte-level BPE encoding and decoding by speculation and verification.

A text is cut at spaces, and what stands between is cut into words by the pattern of the byte-level
scheme. For every word not seen before, a greedy longest match proposes tokens. The proposal is what BPE gives if and only if each pair of
neighbours is compatible, that is, if no merge across their border would have come before the merges
that built them. All pairs of a batch are tested together with numpy: each step undoes the later of
the two merges that made the tokens at the border, and asks whether the tokens then at the border
could have merged first. Only words with a failing pair are merged exactly: short ones together,
as rows of a matrix, long ones with a heap of ranked pairs (n log n in the word's length).

The vocabulary file is read on the driver and broadcast; it may have at most ``MAX_FILE`` bytes. A
worker keeps the tables of one vocabulary, and with them at most about ``CACHE_BYTES`` bytes of chunks
and words that it has met; a fuller cache is begun anew, which costs time and changes nothing. Texts go
through in slices of about ``SLICE`` bytes, each written on before the next is read.

Defined results: a null text is an empty one with no ids; strings of special tokens become those
tokens, as in the tokenizers library; texts of any length are encoded whole; repeated rows give
repeated results; an empty table gives an empty result; other columns stay or, if they bear the
names of new ones, are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from array import array
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tagloom.llm.common import slices

MAX_FILE = 64_000_000
CACHE_BYTES = 64_000_000
ENTRY_BYTES = 200  # of a cached string, its ids and their place, beside their characters
SLICE = 2_000_000
MATRIX_ROWS = 4_000
SHORT = 48  # bytes; longer words are merged one by one
NEVER = np.int64(1 << 40)
# Fixed value: the word pattern of byte-level BPE.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
# A word never reaches from before a space into the sign after it, so that texts may be cut there first.
SPACE, ODD_SPACE = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")


def byte_of_char() -> dict[str, int]:
    """The scheme's printable stand-ins: a byte that prints is itself, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Known(dict):
    """Ids of strings; emptied when its entries take more than ``most`` bytes or so."""

    def __init__(self, most: int):
        self.most, self.held = most, 0

    def learn(self, strings: list[str], ids: list[bytes]) -> None:
        self.update(zip(strings, ids, strict=True))
        self.held += ENTRY_BYTES * len(ids) + sum(map(len, strings)) + sum(map(len, ids))

    def trim(self) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0


class Cache:
    """Ids of chunks that follow a space, and of words."""

    def __init__(self, most: int = CACHE_BYTES):
        self.chunks, self.words = Known(most * 2 // 3), Known(most // 3)

    def trim(self) -> None:
        self.chunks.trim()
        self.words.trim()


class Bpe:
    """Tables of one vocabulary file (tokenizers' JSON, byte-level BPE)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        chars = byte_of_char()
        raw = lambda token: bytes(chars[c] for c in token)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip or need whole words are not supported")
        self.cache = Cache()
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[i, j] = (r, k)
            self.rank[k], self.left[k], self.right[k] = r, i, j
        self.byte_ids = np.array([self.ids.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.made = np.array([k for _, k in self.merges.values()], np.int64)  # by rank
        keys = np.array([i * size + j for i, j in self.merges], np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, np.append(keys[order], NEVER * size)
        self.ranks = np.append(np.array([r for r, _ in self.merges.values()], np.int64)[order], NEVER)
        self.prefixes: dict[bytes, int] = {t[:k]: -1 for t in self.ids for k in range(1, len(t))} | self.ids
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match: each match grows while some token begins with it."""
        known, n, at, out = self.prefixes.get, len(word), 0, []
        while at < n:
            end = best = at + 1
            while end <= n and (token := known(word[at:end])) is not None:
                if token >= 0:
                    last, best = token, end
                end += 1
            out.append(last)
            at = best
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of neighbours stay apart under exact merging."""
        good = np.ones(len(a), bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), NEVER)  # a merge across the border ranked below this one comes first
        while len(live):
            crossed = self.pair_rank(a, b) < limit
            good[live[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            later = ra > rb  # undone: the merge that made a, else the one that made b; of equal pairs, the left one is merged first
            limit = np.where(later, ra, rb + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, of equal ranks the leftmost."""
        tok = [self.ids[word[i : i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        heap = [(m[0], i, tok[i], tok[i + 1]) for i in range(len(tok) - 1) if (m := self.merges.get((tok[i], tok[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tok[i] != a or j >= len(tok) or tok[j] != b:
                continue
            tok[i], tok[j] = self.merges[a, b][1], -1
            after[i] = k = after[j]
            if k < len(tok):
                before[k] = i
                if m := self.merges.get((tok[i], tok[k])):
                    heapq.heappush(heap, (m[0], i, tok[i], tok[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get((tok[h], tok[i]))):
                heapq.heappush(heap, (m[0], h, tok[h], tok[i]))
        return [t for t in tok if t >= 0]

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """:meth:`merge` for many words at once, a row of a matrix for each; meant for words of like length.

        Each step merges the best pair of every row that has one, and looks up the two new pairs.
        """
        longest, n = max(map(len, words)), len(words)
        tok = np.full((n, longest), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, n)
        tok[np.arange(longest) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        pair = np.where(tok[:, 1:] >= 0, self.pair_rank(tok[:, :-1], tok[:, 1:]), NEVER)
        rows, out = np.arange(n), [None] * n
        while True:
            at = pair.argmin(1)
            go = pair[np.arange(len(rows)), at] < NEVER
            for i in np.flatnonzero(~go).tolist():
                out[rows[i]] = [t for t in tok[i].tolist() if t >= 0]
            if not go.any():
                return out
            rows, tok, pair, at = rows[go], tok[go], pair[go], at[go]
            k, width = np.arange(len(rows)), tok.shape[1]
            made = self.made[pair[k, at]]
            keep = np.arange(width) != (at + 1)[:, None]
            tok = np.concatenate([tok[keep].reshape(-1, width - 1), np.full((len(rows), 1), -1)], 1)
            tok[k, at] = made
            pair = np.concatenate([pair[keep[:, 1:]].reshape(-1, width - 2), np.full((len(rows), 1), NEVER)], 1)
            right = np.where(tok[k, np.minimum(at + 1, width - 1)] >= 0, self.pair_rank(made, tok[k, np.minimum(at + 1, width - 1)]), NEVER)
            inner = at < width - 1
            pair[k[inner], at[inner]] = right[inner]
            first = at > 0
            pair[k[first], at[first] - 1] = self.pair_rank(tok[k[first], at[first] - 1], made[first])

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact ids of each word; words are merged in groups of like length."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: list = [None] * len(words)
        short = [i for i in order if len(words[i]) <= SHORT]
        for a in range(0, len(short), MATRIX_ROWS):
            part = short[a : a + MATRIX_ROWS]
            for i, ids in zip(part, self.merge_short([words[i] for i in part]), strict=True):
                out[i] = ids
        for i in order[len(short) :]:
            out[i] = self.merge(words[i])
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        proposed = [[i] if (i := self.ids.get(w)) is not None else self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for ids in proposed for i in ids), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        inner = np.ones(max(0, len(flat) - 1), bool)
        inner[ends[:-1] - 1] = False
        at = np.flatnonzero(inner)
        pairs, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        bad = at[~self.compatible(pairs // self.size, pairs % self.size)[back]]
        failing = np.unique(np.searchsorted(ends, bad, side="right")).tolist()
        for k, ids in zip(failing, self.merge_all([raw[k] for k in failing]), strict=True):
            proposed[k] = ids
        told = array("I", chain.from_iterable(proposed))
        if sys.byteorder == "big":
            told.byteswap()
        raw, at = told.tobytes(), [0, *accumulate(map(len, proposed))]
        return [raw[4 * a : 4 * b] for a, b in pairwise(at)]

    def chunks(self, text: str):
        """Lists of chunks, and special tokens as ids. All chunks of a list but its first follow a space."""
        if self.splitter is None or not any(s in text for s in self.special):
            yield text.split(" ") if ODD_SPACE.search(text) is None else SPACE.split(text)
            return
        for k, part in enumerate(self.splitter.split(text)):
            if k % 2:
                yield self.special[part]
            elif part:
                yield SPACE.split(part)

    def encode_chunks(self, chunks: list[str], words: Known) -> list[bytes]:
        cut = list(map(WORDS.findall, chunks))
        fresh = list({w for c in cut for w in c}.difference(words))
        words.learn(fresh, self.encode_words(fresh))
        return [words[c[0]] if len(c) == 1 else b"".join(map(words.__getitem__, c)) for c in cut]

    def encode_batch(self, texts: list[str], cache: Cache) -> list[bytes]:
        """Ids of each text as bytes; fills the cache."""
        cut = [list(self.chunks(t)) for t in texts]
        fresh = list({c for parts in cut for p in parts if isinstance(p, list) for c in p[1:]}.difference(cache.chunks))
        cache.chunks.learn(fresh, self.encode_chunks([" " + c for c in fresh], cache.words))
        firsts = list({p[0] for parts in cut for p in parts if isinstance(p, list)})
        first = dict(zip(firsts, self.encode_chunks(firsts, cache.words), strict=True))
        get = cache.chunks.__getitem__
        return [b"".join(first[p[0]] + b"".join(map(get, p[1:])) if isinstance(p, list) else np.uint32(p).astype("<u4").tobytes() for p in parts) for parts in cut]

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids in UTF-8; bytes that are none become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=1)
def _tables(source: str) -> Bpe:
    return Bpe(source)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        source = f.read(MAX_FILE + 1)
    if len(source) > MAX_FILE:
        raise ValueError(f"{path} has more than {MAX_FILE} characters")
    return source


def encode(spark: SparkSession, docs: DataFrame, path: str, text_col: str = "text", decoded: bool = False, digests: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers), and the text decoded from them if asked.

    digests: instead of ids and text, their lowercase hex SHA-256, ``ids_sha256`` and ``decoded_sha256``.
    """
    source = spark.sparkContext.broadcast(read_vocabulary(path))
    new = {"n_tokens": (pa.int64(), T.LongType())}
    new |= {"ids_sha256": (pa.string(), T.StringType())} if digests else {"ids": (pa.binary(), T.BinaryType())}
    if decoded:
        new |= {"decoded_sha256": (pa.string(), T.StringType())} if digests else {"decoded": (pa.string(), T.StringType())}
    docs = docs.drop(*new)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, (_, t) in new.items())])
    at = docs.columns.index(text_col)

    def each(batches):
        bpe = _tables(source.value)
        for batch in batches:
            for part in slices(batch, at, SLICE):
                out: dict[str, list] = {k: [] for k in new}
                bpe.cache.trim()
                for ids in bpe.encode_batch([t or "" for t in part.column(at).cast(pa.string()).to_pylist()], bpe.cache):
                    out["n_tokens"].append(len(ids) // 4)
                    text = bpe.decode(ids) if decoded else b""
                    if digests:
                        out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                        if decoded:
                            out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
                    else:
                        out["ids"].append(ids)
                        if decoded:
                            out["decoded"].append(text.decode())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(out[k], t) for k, (t, _) in new.items())], [*part.schema.names, *new])

    return docs.mapInArrow(each, schema)


def decode(spark: SparkSession, tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of its ids; null ids have no text."""
    source = spark.sparkContext.broadcast(read_vocabulary(path))
    tokens = tokens.drop("decoded")
    at = tokens.columns.index(ids_col)

    def each(batches):
        bpe = _tables(source.value)
        for batch in batches:
            texts = [bpe.decode(ids or b"").decode() for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return tokens.mapInArrow(each, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())]))
