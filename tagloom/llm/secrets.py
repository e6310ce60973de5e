r"""Secret scans: fixed patterns, and sliding windows of high Shannon entropy.

Patterns (fixed values) give the base spans, leftmost and non-overlapping for each kind:
``assign`` (a key word, ``:`` or ``=``, and a value of 8 characters or more), ``access`` (``AKIA``,
16 characters or more) and ``hex`` (32 hexadecimal digits or more).

The method adds ``entropy`` spans. Candidates are the maximal runs of 20 or more characters of each
character class (hex, alnum, base64), so that a secret joined to a name or a path by ``= - _ /`` is a
candidate of its own; each is scored by its class's threshold. A window slides over the candidate; the
counts of its characters are updated by the one that enters and the one that leaves, and with them the
sum of c*log2(c), from which the entropy follows. Windows at or above the threshold are spans.
Candidates without a digit or without a letter are passed over. What the allow-list matches (known
placeholders, UUIDs) is in no window; what stands left and right of it is scored as usual. Spans are
merged over the classes, and cut where base spans lie: what stands outside stays, without separators at the cut.

Defined results: a null text is an empty one and has no span; a text of any length is scanned whole;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import slices

SLICE = 4_000_000
KINDS = ("assign", "access", "hex", "entropy")
# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run's leftmost match is the whole run, so shorter runs need not be matched and dropped
HINT = re.compile(r"(?:pass|secr|toke|api)", re.I | re.A)

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Class, its characters, and the entropy in bits from which a window counts.
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]{20,}"), 3.1), ("alnum", re.compile(r"[A-Za-z0-9]{20,}"), 3.7), ("base64", CANDIDATE, 3.9))
DEFAULT_ALLOW = ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", r"(?i)example|placeholder|changeme|dummy|xxxx+|0123456789|abcdefgh", r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
SEPARATORS = "+/_=-"
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if HINT.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def high_windows(run: str, threshold: float, width: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Merged [start, end) of the windows of ``run`` whose entropy is at least ``threshold``.

    H = log2(w) - sum(c*log2(c)) / w over the counts c of a window's characters; moving the window
    by one changes two counts.
    """
    if len(run) < width:
        return
    bits = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    most = (math.log2(width) - threshold) * width + 1e-9
    start = end = -1
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += bits[n + 1] - bits[n]
        counts[c] = n + 1
        if i >= width:
            old = run[i - width]
            n = counts[old]
            total += bits[n - 1] - bits[n]
            counts[old] = n - 1
        if i >= width - 1 and total <= most:
            if end < i - width + 1:
                if start >= 0:
                    yield start, end
                start = i - width + 1
            end = i + 1
    if start >= 0:
        yield start, end


def allowed_parts(text: str, allow: list[re.Pattern]) -> Iterator[tuple[int, str]]:
    """The candidates of ``text`` without what the allow-list matches: their parts of a window's width or more, with their starts."""
    for m in CANDIDATE.finditer(text):
        run, at = m[0], 0
        for a, b in sorted(x.span() for p in allow for x in p.finditer(run)):
            if a - at >= WINDOW:
                yield m.start() + at, run[at:a]
            at = max(at, b)
        if len(run) - at >= WINDOW:
            yield m.start() + at, run[at:]


def entropy_spans(text: str, allow: list[re.Pattern]) -> list[tuple[str, int, int]]:
    """Spans by class, not merged over the classes."""
    out = []
    for start, part in allowed_parts(text, allow):
        for _, chars, threshold in CLASSES:
            for m in chars.finditer(part):
                if DIGIT.search(m[0]) and LETTER.search(m[0]):
                    out += [("entropy", start + m.start() + a, start + m.start() + b) for a, b in high_windows(m[0], threshold)]
    return out


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Overlapping and touching spans become one."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(spans):
        if out and a <= out[-1][2]:
            out[-1] = (kind, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((kind, a, b))
    return out


def spans_of(text: str, allow: list[re.Pattern]) -> list[tuple[str, int, int]]:
    """All spans by start, then by kind as listed. Entropy spans are cut where base spans lie, so that together they cover what either found."""
    base = base_spans(text)
    taken = merged([("base", a, b) for _, a, b in base])
    ends = [b for _, _, b in taken]
    more = []

    def add(kind: str, start: int, end: int, cut: tuple[bool, bool]) -> None:
        while cut[0] and start < end and text[start] in SEPARATORS:
            start += 1
        while cut[1] and start < end and text[end - 1] in SEPARATORS:
            end -= 1
        if start < end:
            more.append((kind, start, end))

    for kind, start, end in merged(entropy_spans(text, allow)):
        k, cut = bisect_right(ends, start), False  # the first base span that ends behind the start
        while k < len(taken) and taken[k][1] < end:
            add(kind, start, taken[k][1], (cut, True))
            start, cut, k = taken[k][2], True, k + 1
        add(kind, start, end, (cut, False))
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, allow: tuple[str, ...] = DEFAULT_ALLOW) -> DataFrame:
    """doc_id and the spans of each text. allow: patterns of what is no secret within a candidate."""

    def each(batches):
        patterns = [re.compile(p) for p in allow]
        for batch in (part for b in batches for part in slices(b, 1, SLICE)):
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans_of(t or "", patterns)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, SCHEMA)


def digest(spans: DataFrame) -> DataFrame:
    """Counts by base kind, the hash of the base spans, and all spans joined, from the rows of :func:`scan`."""
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), of("entropy").alias("n_entropy"))
