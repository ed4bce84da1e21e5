"""Scanned pages as a reader would read them, reduced to a stream of letters.

A stream holds the letters and digits of a page in reading order, lower-cased,
without accents, with confusable letters joined, and without spaces: line and
word breaks, punctuation and the usual misreadings leave no trace in it.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Sequence

import numpy as np

#: Characters a scanner takes for one another; each class is folded to its first character.
CONFUSED = ("eoc06", "ilt1fj!|", "aunr", "hb", "s5ſ", "vy", "gq9")
#: Lines whose left edges differ by more pixels than this belong to different columns.
COLUMN_GAP = 150
#: Code points below this are folded by a table.
TABLE_END = 0x3000


def _table() -> dict[int, str]:
    joined = {ch: cls[0] for cls in CONFUSED for ch in cls}
    spelled = {"ß": "ss", "æ": "ae", "œ": "oe"}
    table = {}
    for code in [*range(TABLE_END), *range(0xFB00, 0xFB05)]:
        lower = chr(code).lower()
        plain = unicodedata.normalize("NFKD", spelled.get(lower, lower))
        table[code] = "".join(joined.get(c, c) for c in plain if c.isalnum())
    table[ord("!")] = table[ord("|")] = ""
    return table


TABLE = _table()
#: The same for code points below 256, as far as each becomes at most one letter: a byte each, and the bytes that are dropped.
BYTES = bytes(ord(TABLE[code]) if len(TABLE[code]) == 1 and TABLE[code].isascii() else code for code in range(256))
DROPPED = bytes(code for code in range(256) if not TABLE[code])
#: Code points below 256 that become several letters, or one that is not ASCII.
SEVERAL = {chr(code): TABLE[code] for code in range(256) if len(TABLE[code]) > 1 or not TABLE[code].isascii()}
_several = re.compile(f"[{''.join(map(re.escape, SEVERAL))}]")


def _spelled(match: re.Match) -> str:
    folded = SEVERAL[match[0]]
    if not folded.isascii():
        raise UnicodeError
    return folded


def _unencodable(error: UnicodeError) -> tuple[str, int]:
    """Code points beyond 255 that become ASCII letters, or nothing, are replaced; others are left to the slow way."""
    folded = error.object[error.start : error.end].translate(TABLE)
    if not folded.isascii():
        raise error
    return folded, error.end


codecs.register_error("panelforge-fold", _unencodable)


def fold(text: str) -> bytes:
    """The stream of a text, one byte or a few per letter."""
    try:
        return _several.sub(_spelled, text).encode("latin-1", "panelforge-fold").translate(BYTES, DROPPED)
    except UnicodeError:
        return text.translate(TABLE).encode("utf-8", "ignore")


def reading_order(x: np.ndarray, y: np.ndarray, page: np.ndarray | None = None) -> np.ndarray:
    """Positions of the lines page by page (``page`` ascends), column by column, each from top to bottom."""
    page = np.zeros(len(x), dtype=np.int64) if page is None else page
    by_x = np.lexsort((x, page))
    column = np.empty(len(x), dtype=np.int64)
    column[by_x] = np.cumsum(np.concatenate([np.zeros(min(1, len(x)), dtype=bool), (np.diff(x[by_x]) > COLUMN_GAP) | (np.diff(page[by_x]) > 0)]))
    return np.lexsort((y, column))


def page_streams(texts: Sequence[str | None], x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> list[bytes]:
    """The streams of pages; ``x`` and ``y`` hold the boxes of all pages one after another, ``n_x`` and ``n_y`` how many each page has.

    Where boxes are missing or do not match the lines, lines are read as they stand.
    """
    lines = [t.split("\n") if t else [] for t in texts]
    n = np.array([len(v) for v in lines], dtype=np.int64)
    page = np.arange(len(n))
    boxed = (n == n_x) & (n == n_y) & (n > 1)
    at_x, at_y = np.repeat(boxed, n_x), np.repeat(boxed, n_y)
    x, y, of = np.asarray(x, dtype=float)[at_x], np.asarray(y, dtype=float)[at_y], np.repeat(page[boxed], n[boxed])
    bad = np.zeros(len(n), dtype=bool)
    bad[of[~(np.isfinite(x) & np.isfinite(y))]] = True
    ok = ~bad[of]
    order = reading_order(x[ok], y[ok], of[ok])
    boxed &= ~bad
    begin = np.cumsum(np.where(boxed, n, 0)) - n
    turned = (order - np.repeat(begin[boxed], n[boxed])).tolist()
    out = []
    for k, v in enumerate(lines):
        if boxed[k]:
            v = [v[i] for i in turned[begin[k] : begin[k] + n[k]]]
        out.append(fold("".join(v)))
    return out


def page_stream(text: str | None, x: Sequence[int] | None, y: Sequence[int] | None) -> bytes:
    """The stream of one page."""
    x, y = (np.asarray([] if v is None else v, dtype=float) for v in (x, y))
    return page_streams([text], x, y, np.array([len(x)]), np.array([len(y)]))[0]


def word_ends(text: str) -> tuple[bytes, np.ndarray]:
    """A text's stream and where each of its words ends in it; words without a letter or digit are left out."""
    stream, ends = b"", []
    for word in text.split():
        folded = fold(word)
        if folded:
            stream += folded
            ends.append(len(stream))
    return stream, np.array(ends, dtype=np.int64)


def _eights(stream: bytes) -> np.ndarray:
    """The eight bytes from each position on as one number (the first is the lowest), zeros after the end."""
    n = len(stream)
    padded = stream + bytes(16)
    out = np.empty(n + 8, np.uint64)
    for o in range(8):
        out[o::8] = np.frombuffer(padded, "<u8", (n + 15 - o) // 8, o)
    return out


def gram_numbers(stream: bytes, q: int) -> np.ndarray:
    """Each run of ``q`` bytes (at most eight) as a number, different for different runs."""
    n = len(stream) - q + 1
    return _eights(stream)[:n] & np.uint64((1 << (8 * q)) - 1) if n > 0 else np.zeros(0, np.uint64)


def gram_hashes(stream: bytes, q: int) -> np.ndarray:
    """A 64-bit hash of each run of ``q`` bytes (9 to 16), as signed numbers."""
    n = len(stream) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    eights = _eights(stream)
    h = eights[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += (eights[8 : 8 + n] & np.uint64((1 << (8 * (q - 8))) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h.view(np.int64)
