r"""Quality rules: counts of a text, and a linear-chain conditional random field over its lines.

Each line with a word is content or boilerplate; Viterbi decoding finds the most likely labels of
all lines together. A text is kept where the words in content lines make up at least
``min_content`` of its words, unless a base rule fails: fewer than 50 words, or more than half of
the words inside 3-word windows that occur twice or more.

The field's weights are learned by :func:`train` (gradient ascent on the conditional likelihood,
with forward-backward sums). No table labels single lines, so line labels are found in turns with the
weights: at first a labelled text lends its quality to all of its lines, and lines are judged one by
one; then, ``ROUNDS`` times, each text's lines are labelled by Viterbi, under the condition that most of
its words keep the text's own label, and the field is trained on these sequences. So a plain line in a
bad text counts as content. Training collects the features of all lines of at most ``TRAIN_ROWS`` texts,
made in the tasks; scoring reads every text whole. Without labelled rows of both kinds, ``DEFAULT`` is used.

Defined results: a null, empty or blank text has no words and is not kept (base_failed); repeated
rows give repeated results; ``isspace`` and ``split`` of bytes know the six blanks of the word rule
alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import labelled_sample, slices
from tagloom.llm.lines import BLANK, LINE_FEATURES, SYMBOLS, line_features, lines_with_words

TRAIN_ROWS = 1500
PIECE = 300  # lines that training steps through
SLICE = 4_000_000
ROUNDS = 3
MIN_WORDS = 50
MIN_CONTENT = 0.5
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_content_words bigint, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Crf:
    """Emission weights of content over boilerplate by feature, and the weight of two equal labels in a row."""

    emission: tuple[float, ...]
    stay: float


DEFAULT = Crf((2.0, -6.0, -6.0, -2.0, -6.0, 1.0, 1.0, 0.5, -0.5, 0.0), 0.5)


def viterbi(gain: list[float], stay: float) -> list[int]:
    """The best labels (1: content) where ``gain[i]`` is what content adds over boilerplate at line i."""
    content = boiler = 0.0
    back = []
    for g in gain:
        to_content = content + stay >= boiler
        to_boiler = content > boiler + stay
        back.append((to_content, to_boiler))
        content, boiler = max(content + stay, boiler) + g, max(content, boiler + stay)
    label = 1 if content >= boiler else 0
    out = []
    for to_content, to_boiler in reversed(back):
        out.append(label)
        label = int(to_content if label else to_boiler)
    return out[::-1]


def train(chains: list[tuple[np.ndarray, int | np.ndarray]], epochs: int = 150, rate: float = 0.5, shrink: float = 1e-3, linked: bool = True) -> Crf:
    """Fit by gradient ascent. chains: (line features, the label that all lines take, or one for each line).

    linked: whether neighbouring lines bear on each other; else ``stay`` is 0.

    A chain is cut into pieces of ``PIECE`` lines, so that no text makes the steps many; all its lines count, and only
    what lines on either side of a cut say of each other is left out. Lines are laid out place by place, longer
    pieces first, so that the pieces that reach a place are the first ones there and nothing is padded.
    Classes are weighed alike, so that the rarer one counts, and texts of a class too.
    """
    good = np.array([np.mean(label) >= 0.5 for _, label in chains])
    share = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, len(chains) - good.sum()))
    cut = [(f[a : a + PIECE], np.broadcast_to(label, len(f))[a : a + PIECE], s / len(f)) for (f, label), s in zip(chains, share, strict=True) for a in range(0, len(f), PIECE)]
    cut.sort(key=lambda c: -len(c[0]))
    sizes = np.array([len(x) for x, _, _ in cut])
    reach = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # pieces that have a line at each place
    at = np.concatenate([[0], np.cumsum(reach)])
    longest, k = int(sizes[0]), len(LINE_FEATURES)
    x, y, weight = np.zeros((int(at[-1]), k)), np.zeros(int(at[-1])), np.zeros(int(at[-1]))
    for i, (f, label, s) in enumerate(cut):
        own = at[: len(f)] + i
        x[own], y[own], weight[own] = f, label, s
    chain = np.arange(at[-1]) - np.repeat(at[:-1], reach)
    ends = at[sizes - 1] + np.arange(len(cut))
    second = np.arange(at[1], at[-1])  # lines that follow one
    ahead = second - np.repeat(reach[:-1], reach[1:])  # the lines before them
    w, stay = np.zeros(k), 0.0
    for _ in range(epochs):
        g = x @ w
        # forward and backward log sums of content (1) and boilerplate (0)
        a1, a0, b1, b0 = g.copy(), np.zeros(len(g)), np.zeros(len(g)), np.zeros(len(g))
        for t in range(1, longest):
            here, last = slice(at[t], at[t + 1]), slice(at[t - 1], at[t - 1] + reach[t])
            c, d = a1[last], a0[last]
            a1[here] += np.logaddexp(c + stay, d)
            a0[here] = np.logaddexp(c, d + stay)
        for t in range(longest - 2, -1, -1):
            here, after = slice(at[t], at[t] + reach[t + 1]), slice(at[t + 1], at[t + 2])
            c, d = b1[after] + g[after], b0[after]
            b1[here] = np.logaddexp(c + stay, d)
            b0[here] = np.logaddexp(c, d + stay)
        z = np.logaddexp(a0[ends], a1[ends])[chain]
        p = np.exp(a1 + b1 - z)
        w = w + rate * 10 * ((weight * (y - p)) @ x - shrink * w)
        if not linked:
            continue
        alike = y[second] == y[ahead]
        same = np.exp(a1[ahead] + stay + g[second] + b1[second] - z[second]) + np.exp(a0[ahead] + stay + b0[second] - z[second])
        stay = min(3.0, stay + rate * ((weight[second] * (alike - same)).sum() - shrink * stay))
    return Crf(tuple(float(v) for v in w), float(stay))


def line_labels(x: np.ndarray, words: np.ndarray, label: int, model: Crf) -> np.ndarray:
    """The labels of a text's lines by Viterbi; the likeliest others take the text's ``label`` until most words have it."""
    gain = x @ np.array(model.emission)
    out = np.array(viterbi(gain.tolist(), model.stay))
    for i in np.argsort(-gain if label else gain, kind="stable").tolist():
        if 2 * words[out == label].sum() > words.sum():
            break
        out[i] = label
    return out


def learn(texts: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = ROUNDS) -> Crf:
    """Weights and line labels in turns. texts: features and words of the lines, and the text's label."""
    model = train([(x, label) for x, _, label in texts], linked=False)
    for _ in range(rounds):
        model = train([(x, line_labels(x, words, label, model)) for x, words, label in texts])
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Crf:
    """Learn from all lines of at most ``rows`` texts (and 64 MB of them) that ``labels.quality`` marks, outside the held-out fold."""

    def each(batches):
        for batch in batches:
            chains = []
            for text in batch.column(1).to_pylist():
                lines = lines_with_words(text or b"")
                chains.append(np.array([[*line_features(x, again, len(lines)), len(x.split())] for x, again in lines]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chains, pa.binary())], ["label", "features"])

    sample = labelled_sample(docs, labels, "quality", rows).orderBy("doc_id")
    told = sample.select(F.col("label").cast("int"), F.col("text").cast("binary")).mapInArrow(each, "label int, features binary")
    rows = [(np.frombuffer(r.features).reshape(-1, len(LINE_FEATURES) + 1), r.label) for r in told.toLocalIterator() if r.features]
    return learn([(x[:, :-1], x[:, -1], label) for x, label in rows]) if len({label for _, label in rows}) == 2 else DEFAULT


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key = x[:n]
    for i in range(1, width):
        key = key * len(ids) + x[i : i + n]
        if i + 1 < width and len(ids) > 2_000_000:  # the next product would not fit
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    at = np.flatnonzero(twice)
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[at + i] = True
    return int(covered.sum())


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    solid = text.translate(None, BLANK).decode("utf-8", "replace")
    return len(words), len(solid), sum(text.count(bytes([c])) for c in SYMBOLS), sum(again for _, again in lines_with_words(text)), repeated_window_words(words)


def content_words(text: bytes, model: Crf) -> int:
    """Words in the lines that the field marks as content."""
    lines = lines_with_words(text)
    w = model.emission
    gain = [sum(a * b for a, b in zip(w, line_features(x, again, len(lines)), strict=True)) for x, again in lines]
    return sum(len(x.split()) for (x, _), label in zip(lines, viterbi(gain, model.stay), strict=True) if label)


def judge(docs: DataFrame, model: Crf = DEFAULT, min_content: float = MIN_CONTENT) -> DataFrame:
    """One row for each document: its counts, the words in content lines, and whether it is kept."""

    def each(batches):
        for batch in (part for b in batches for part in slices(b, 1, SLICE)):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, chars, symbols, dups, repeats = text_counts(text or b"")
                failed = n < MIN_WORDS or 100 * repeats > 50 * n
                content = content_words(text or b"", model)
                out.append((doc_id, n, chars, symbols, dups, repeats, content, failed, not failed and content >= min_content * n))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, TYPES, strict=True)], NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(each, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.bool_() if x.endswith("boolean") else pa.int64() for x in SCHEMA.split(", ")]


def keep_documents(docs: DataFrame, model: Crf = DEFAULT, min_content: float = MIN_CONTENT) -> DataFrame:
    """``docs`` without the rejected rows. The verdict is made beside the row, so nothing is joined or shuffled."""
    names = docs.columns
    at = names.index("text")

    def each(batches):
        for batch in (part for b in batches for part in slices(b, at, SLICE)):
            keep = []
            for text in batch.column(at).cast(pa.binary()).to_pylist():
                text = text or b""
                words = text.split()
                n = len(words)
                keep.append(n >= MIN_WORDS and 100 * repeated_window_words(words) <= 50 * n and content_words(text, model) >= min_content * n)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
