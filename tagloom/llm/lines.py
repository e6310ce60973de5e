"""What a line of text looks like, as numbers; shared by the quality rules and the quality classifier."""

from __future__ import annotations

import math

#: Bytes that separate words: space, and tab to carriage return (what ``bytes.split()`` splits at).
BLANK = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".,;:"
LINE_FEATURES = ("bias", "symbols", "upper", "digits", "bangs", "stops", "long", "closed", "repeated", "alone")


def count(line: bytes, kinds: bytes) -> int:
    return len(line) - len(line.translate(None, kinds))


def line_features(line: bytes, repeated: bool, lines: int) -> list[float]:
    """Shares of kinds of characters, length, closing mark, and place of a line that has a word.

    repeated: an earlier line of the text is equal to it.
    """
    size = max(1, len(line) - count(line, BLANK))
    upper, lower = count(line, UPPER), count(line, LOWER)
    return [
        1.0,
        min(1.0, 4.0 * count(line, SYMBOLS) / size),
        upper / (upper + lower + 1.0),
        count(line, DIGITS) / size,
        min(1.0, 4.0 * line.count(b"!") / size),
        min(1.0, 8.0 * count(line, STOPS) / size),
        min(1.0, math.log1p(len(line)) / 7.0),
        1.0 if line.rstrip(BLANK)[-1:] in (b".", b"?", b"!", b'"', b":") else 0.0,
        1.0 if repeated else 0.0,
        1.0 if lines <= 2 else 0.0,
    ]


def lines_with_words(text: bytes) -> list[tuple[bytes, bool]]:
    r"""The \n-split lines that have a word, and whether an equal one came before."""
    seen: set[bytes] = set()
    out = []
    for line in text.split(b"\n"):
        if line and not line.isspace():
            out.append((line, line in seen))
            seen.add(line)
    return out
