"""Sizes of texts in tokens of a public byte-level BPE vocabulary, whole batches at a time.

Byte-level BPE never joins across the pieces its pattern cuts a text into, so the tokens of a text are those of its
pieces. Pieces repeat very often: they are found with array operations, and each distinct piece is encoded once per
worker and kept. Texts with characters beyond the table of classes go through the library itself.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from functools import lru_cache

import numpy as np

#: Folder of vocabulary files, and the vocabulary used; both are parameters.
VOCABULARY = os.environ.get("LAKEMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern this vocabulary cuts texts with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a piece of text that is worked on at once.
SPAN = 500_000
#: Code points whose class is looked up here.
TABLE = 0x250
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
KEPT = 1_000_000


def _classes() -> np.ndarray:
    out = np.full(TABLE, OTHER, dtype=np.uint8)
    for c in range(TABLE):
        kind = unicodedata.category(chr(c))[0]
        if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F):
            out[c] = SPACE
        elif kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    return out


CLASS = _classes()
APOSTROPHE, BLANK = ord("'"), ord(" ")


def pieces(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of ``code`` (code points of texts that begin at ``starts``) begin, as the pattern cuts them."""
    n = len(code)
    kind = CLASS[code]
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    begin = np.ones(n, dtype=bool)
    same = kind[1:] == kind[:-1]
    begin[1:] = ~same
    begin |= first
    # the last space of a run that something follows: a blank goes with what follows, other white space stands alone
    space = kind == SPACE
    ends = np.zeros(n, dtype=bool)
    ends[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    begin |= ends
    joined = np.zeros(n, dtype=bool)
    joined[1:] = ends[:-1] & (code[:-1] == BLANK)
    begin &= ~joined
    # contractions: at an apostrophe where a piece begins
    marks = np.flatnonzero((code == APOSTROPHE) & begin)
    if len(marks):
        limit = np.append(starts[1:], n)[np.searchsorted(starts, marks, side="right") - 1]
        for m, stop in zip(marks.tolist(), limit.tolist(), strict=True):
            if m + 1 >= stop:
                continue
            a = code[m + 1]
            b = code[m + 2] if m + 2 < stop else 0
            length = 2 if a in (115, 116, 109, 100) else 3 if (a, b) in ((114, 101), (118, 101), (108, 108)) else 0
            if length:
                # the letters after it, cut off from the rest of their run
                begin[m + 1 : m + length] = False
                if m + length < stop:
                    begin[m + length] = True if not (space[m + length] and not begin[m + length]) else begin[m + length]
    return np.flatnonzero(begin)


SPREAD, TAIL = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)


def hashes_of(pieces: list[bytes]) -> np.ndarray:
    """What ``Tokens.count`` knows pieces by, one at a time: up to 7 bytes with their number, of longer ones both ends."""
    one = lambda x: int.from_bytes(x, "little")
    short = [one(x) | len(x) << 56 if len(x) <= 7 else one(x[:8]) for x in pieces]
    tail = [one(x[-8:]) if len(x) > 7 else 0 for x in pieces]
    a, b = np.array(short, dtype=np.uint64), np.array(tail, dtype=np.uint64)
    long = np.array([len(x) > 7 for x in pieces], dtype=bool)
    return np.where(long, a * TAIL ^ b, a) * SPREAD


class Tokens:
    """Counts and token lengths of texts. ``vocabulary``: a rank file as tiktoken reads it."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import regex
        import tiktoken

        self.pattern = regex.compile(PATTERN)
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("lakemill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for k, v in ranks.items():
            self.bytes_of[v] = len(k)
        self.short: tuple[np.ndarray, np.ndarray] = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        self.long: dict[bytes, int] = {}

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text's tokens."""
        return np.array(self.encoding.encode_ordinary(text), dtype=np.int64)

    def count_one(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def count(self, texts: list[str | None], words: list | None = None) -> np.ndarray:
        """Tokens of each text; a null text has 0. ``words``: gets (text numbers, hashes of pieces) per span."""
        out = np.zeros(len(texts), dtype=np.int64)
        span: list[int] = []
        held = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if held and held + len(t) > SPAN:
                self._count_span(texts, span, out, words)
                span, held = [], 0
            span.append(i)
            held += len(t)
        if span:
            self._count_span(texts, span, out, words)
        return out

    def _count_span(self, texts: list, span: list[int], out: np.ndarray, words: list | None) -> None:
        length = np.array([len(texts[i]) for i in span])
        code = np.frombuffer("".join(texts[i] for i in span).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.r_[0, np.cumsum(length)[:-1]]
        far = np.maximum.reduceat(code, starts) >= TABLE
        if far.any():
            keep = np.repeat(~far, length)
            for i in np.flatnonzero(far):
                out[span[i]] = self.count_one(texts[span[i]])
            if words is not None:
                for i in np.flatnonzero(far):
                    h = hashes_of([x.encode("utf-8", "surrogatepass") for x in self.pattern.findall(texts[span[i]])])
                    words.append((np.full(len(h), span[i]), h))
            code, length = code[keep], length[~far]
            span = [s for s, f in zip(span, far, strict=True) if not f]
            if not span:
                return
            starts = np.r_[0, np.cumsum(length)[:-1]]
        # to UTF-8: below the table's end a character takes one byte or two
        wide = code >= 0x80
        if wide.any():
            at = np.r_[0, np.cumsum(1 + wide)]
            data = np.empty(at[-1], dtype=np.uint8)
            data[at[:-1][~wide]] = code[~wide]
            data[at[:-1][wide]] = 0xC0 | code[wide] >> 6
            data[at[:-1][wide] + 1] = 0x80 | code[wide] & 0x3F
        else:
            at, data = None, code.astype(np.uint8)
        begin = pieces(code, starts)
        owner = np.searchsorted(starts, begin, side="right") - 1
        stop = np.r_[begin[1:], len(code)]
        if at is not None:
            begin, stop = at[begin], at[stop]
        size = stop - begin
        tokens = np.ones(len(begin), dtype=np.int64)
        hashes = np.zeros(len(begin), dtype=np.uint64)

        small = np.flatnonzero(size <= 7)
        padded = np.r_[data, np.zeros(8, dtype=np.uint8)]
        window = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
        key = np.ascontiguousarray(window[begin[small]]).view(np.uint64).ravel()
        key = key & ((np.uint64(1) << (size[small].astype(np.uint64) * np.uint64(8))) - np.uint64(1)) | size[small].astype(np.uint64) << np.uint64(56)
        tokens[small] = self._short_counts(key)
        hashes[small] = key

        large = np.flatnonzero(size > 7)
        raw, known = data.tobytes(), self.long
        found = [raw[a:b] for a, b in zip(begin[large].tolist(), stop[large].tolist(), strict=True)]
        counts = []
        for w in found:
            n = known.get(w)
            if n is None:
                n = len(self.encoding.encode_ordinary(w.decode()))
                if len(known) >= KEPT:
                    known.clear()
                known[w] = n
            counts.append(n)
        tokens[large] = counts
        out[span] = np.bincount(owner, weights=tokens, minlength=len(span)).astype(np.int64)
        if words is not None:
            # what a longer piece is known by: its ends and its size
            lead = np.ascontiguousarray(window[begin[large]]).view(np.uint64).ravel()
            tail = np.ascontiguousarray(window[np.maximum(stop[large] - 8, 0)]).view(np.uint64).ravel()
            hashes[large] = lead * TAIL ^ tail
            words.append((np.array(span)[owner], hashes * SPREAD))

    def _short_counts(self, key: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(key, return_inverse=True)
        keys, counts = self.short
        at = np.searchsorted(keys, distinct)
        hit = (at < len(keys)) & (keys[np.minimum(at, max(len(keys) - 1, 0))] == distinct) if len(keys) else np.zeros(len(distinct), dtype=bool)
        value = np.zeros(len(distinct), dtype=np.int64)
        value[hit] = counts[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            for i in new:
                k = int(distinct[i])
                value[i] = len(self.encoding.encode_ordinary((k & (1 << 56) - 1).to_bytes(8, "little")[: k >> 56].decode()))
            if len(keys) + len(new) > KEPT:
                keys, counts = keys[:0], counts[:0]
            keys, counts = np.r_[keys, distinct[new]], np.r_[counts, value[new]]
            order = np.argsort(keys)
            self.short = keys[order], counts[order]
        return value[back]


@lru_cache(maxsize=2)
def tokens(vocabulary: str = VOCABULARY) -> Tokens:
    """One per worker."""
    return Tokens(vocabulary)
