"""Cutting texts that are too long into overlapping pieces at their own breaks.

Dynamic programming over boundary positions: a cut costs by how natural its place is, a piece by how far its length is
from an even share and by being one more. Every piece is at most the limit and repeats the last tokens of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakemill.llm.tokens import VOCABULARY, Tokens, tokens

#: What it costs to cut before: a file of a diff, a hunk, a paragraph, a line, a word, anything.
FILE, HUNK, PARAGRAPH, LINE, WORD, ANY = 0.0, 1.0, 2.0, 4.0, 16.0, 48.0
KINDS = {FILE: "file", HUNK: "hunk", PARAGRAPH: "paragraph", LINE: "line", WORD: "word", ANY: "any"}
IMBALANCE, PIECE = 20.0, 6.0
STEP = 16
_BREAK = re.compile(rb"\r\n|\n|\r")


def breaks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where lines begin (but the first), and what a cut there costs."""
    at, cost, blank = [], [], False
    start = 0
    for m in _BREAK.finditer(data):
        line_end, after = m.start(), m.end()
        blank = not data[start:line_end].strip()
        start = after
        if after >= len(data):
            break
        head = data[after : after + 11]
        at.append(after)
        cost.append(FILE if head == b"diff --git " else HUNK if head[:3] == b"@@ " else PARAGRAPH if blank else LINE)
    return np.array(at, dtype=np.int64), np.array(cost)


def boundaries(data: bytes, off: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Token positions at which the text may be cut, with costs: its breaks, and places within lines that are long.

    ``off``: byte offset of each token and the end. Positions within a character are none.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(off) - 1
    at, cost = breaks(data)
    t = np.searchsorted(off, at)
    exact = off[np.minimum(t, n)] == at
    pos, pen = t[exact], cost[exact]
    gaps = np.diff(np.r_[0, pos, n])
    wide = np.flatnonzero(gaps > limit // 16)
    if len(wide):
        whole = (raw[np.minimum(off[:-1], len(raw) - 1)] & 0xC0) != 0x80
        blank = raw[np.minimum(off[:-1], len(raw) - 1)] <= 0x20
        more, price = [], []
        lefts = np.r_[0, pos]
        for g in wide.tolist():
            a, b = int(lefts[g]), int(lefts[g] + gaps[g])
            for s in range(a + 1, b, STEP):
                e = min(s + STEP, b)
                words = np.flatnonzero(blank[s:e] & whole[s:e])
                if len(words):
                    more.append(s + int(words[0]))
                    price.append(WORD)
                    continue
                some = np.flatnonzero(whole[s:e])
                if len(some):
                    more.append(s + int(some[0]))
                    price.append(ANY)
        pos, pen = np.r_[pos, np.array(more, dtype=np.int64)], np.r_[pen, np.array(price)]
        order = np.argsort(pos, kind="stable")
        pos, pen = pos[order], pen[order]
    keep = (pos > 0) & (pos < n)
    return pos[keep], pen[keep]


def cuts(n: int, pos: np.ndarray, pen: np.ndarray, back: np.ndarray, limit: int) -> list[int]:
    """Indices into ``pos`` of the cheapest cuts of n tokens; ``back``: where the piece after each position begins.

    Raises ``ValueError`` if no choice keeps all pieces within the limit.
    """
    p = np.r_[0, pos, n].astype(np.float64)
    begin = np.r_[0, back, n].astype(np.float64)
    cost = np.r_[0.0, pen, 0.0]
    overlap = float(np.median(p[1:-1] - begin[1:-1])) if len(pos) else 0.0
    pieces = max(1, int(np.ceil((n - overlap) / max(1.0, limit - overlap))))
    even, scale = n / pieces, IMBALANCE / (limit * limit)
    best = np.full(len(p), np.inf)
    best[0] = 0.0
    came = np.zeros(len(p), dtype=np.int64)
    low = np.searchsorted(begin[:-1], p - limit)  # begin rises with position
    for j in range(1, len(p)):
        i = low[j]
        if i >= j:
            continue
        d = p[i:j] - (p[j] - even)
        d *= d
        d *= scale
        d += best[i:j]
        k = int(d.argmin())
        if d[k] < np.inf:
            best[j] = d[k] + cost[j] + PIECE
            came[j] = i + k
    if not np.isfinite(best[-1]):
        raise ValueError("no cuts keep the pieces within the limit")
    out, j = [], int(came[-1])
    while j:
        out.append(j - 1)
        j = int(came[j])
    return out[::-1]


def split_text(text: str, t: Tokens, limit: int = 2048, overlap: int = 64) -> list[tuple[int, int, int, int, float]]:
    """Pieces of a text of more than ``limit`` tokens: (first token, end token, first byte, end byte, cost of the cut before).

    Each piece begins ``overlap`` tokens before the last one's end; where that lies within a character, at the nearest
    token before that doesn't. Lengths are of the text's own tokens. If the text's places leave no way, every token is one.
    """
    data = text.encode("utf-8", "surrogatepass")
    ids = t.encode(text)
    n = len(ids)
    off = np.r_[0, np.cumsum(t.bytes_of[ids])]
    if n <= limit:
        return [(0, n, 0, len(data), 0.0)]
    raw = np.frombuffer(data, dtype=np.uint8)
    whole = np.r_[(raw[off[:-1]] & 0xC0) != 0x80, True]
    near = np.maximum.accumulate(np.where(whole, np.arange(n + 1), 0))
    pos, pen = boundaries(data, off, limit)
    try:
        chosen = cuts(n, pos, pen, near[np.maximum(pos - overlap, 0)], limit)
    except ValueError:
        pos = np.flatnonzero(whole[1:-1]) + 1
        pen = np.full(len(pos), ANY)
        chosen = cuts(n, pos, pen, near[np.maximum(pos - overlap, 0)], limit)
    ends = [int(pos[c]) for c in chosen]
    starts = [0, *(int(near[max(e - overlap, 0)]) for e in ends)]
    price = [0.0, *(float(pen[c]) for c in chosen)]
    return [(a, b, int(off[a]), int(off[b]), c) for a, b, c in zip(starts, [*ends, n], price, strict=True)]


SCHEMA = "doc_id long, piece_no long, n_pieces long, first_token long, end_token long, tokens long, overlap long, cut string"


def pieces(documents: DataFrame, limit: int = 2048, overlap: int = 64, vocabulary: str = VOCABULARY, with_text: bool = True) -> DataFrame:
    """The pieces of every document of more than ``limit`` tokens, and ``text`` of each unless told otherwise.

    ``cut``: where the piece was cut from the one before ("start" for the first). Documents within the limit, and null and
    empty texts, have no rows. Repeated rows are cut each on its own. A text of at most ``limit`` bytes has no more tokens
    than that, so it isn't tokenized.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(vocabulary)
        types = [pa.int64()] * 7 + [pa.string()] * (2 if with_text else 1)
        names = ["doc_id", "piece_no", "n_pieces", "first_token", "end_token", "tokens", "overlap", "cut", "text"][: len(types)]
        for b in batches:
            size = np.nan_to_num(np.array(pa.compute.binary_length(b.column(1)).to_numpy(zero_copy_only=False), dtype=float))
            some = np.flatnonzero(size > limit)
            ids, texts = b.column(0), b.column(1)
            for at in range(0, len(some), 200):
                these = some[at : at + 200].tolist()
                held = [texts[i].as_py() for i in these]
                over = np.flatnonzero(t.count(held) > limit)
                out: list[tuple] = []
                for k in over.tolist():
                    text = held[k]
                    data = text.encode() if with_text else b""
                    got = split_text(text, t, limit, overlap)
                    end = 0
                    for no, (a, e, x, y, price) in enumerate(got):
                        row = (ids[these[k]].as_py(), no, len(got), a, e, e - a, end - a if no else 0, KINDS[price] if no else "start")
                        out.append((*row, data[x:y].decode()) if with_text else row)
                        end = e
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), types, strict=True)], names)

    return documents.select("doc_id", "text").mapInArrow(cut_up, SCHEMA + (", text string" if with_text else ""))
