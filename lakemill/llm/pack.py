"""Filling containers of fixed capacity with documents, neighbours along a space-filling curve together.

A document's pieces are hashed into a vector, the vector is projected to three dimensions, and the cell it falls into
gets its Hilbert key. Documents are range-sorted by that key; each range is packed on its own, block by block along the
curve, by best fit of the larger items first into the containers left open by the blocks just before: only neighbours along
the curve share a container.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.tokens import VOCABULARY, tokens
from lakemill.session import cut

BUCKETS, DIMENSIONS, BITS = 1024, 3, 16


def projection(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of cells (rows of ``bits``-bit coordinates): cells with successive keys touch."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:  # undo the rotations of all coarser cells
        p = q - one
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        t ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(b) & one)
    return key


def keys_of(words: list, n: int, matrix: np.ndarray) -> np.ndarray:
    """Hilbert keys of n texts from the hashes of their pieces; texts without any have the key of the origin."""
    place = np.zeros((n, DIMENSIONS))
    for owner, hashes in words:
        at, row = np.unique(owner, return_inverse=True)
        bucket = (hashes >> np.uint64(54)).astype(np.int64)
        counts = np.bincount(row * BUCKETS + bucket, minlength=len(at) * BUCKETS).reshape(len(at), BUCKETS)
        v = np.log1p(counts)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        place[at] = v @ matrix
    cell = (1 / (1 + np.exp(-1.7 * place)) * (2**BITS)).astype(np.int64)
    return hilbert(np.clip(cell, 0, 2**BITS - 1)).astype(np.int64)


def sized(documents: DataFrame, vocabulary: str = VOCABULARY, curve: bool = True) -> DataFrame:
    """``doc_id, source, tokens`` and, with ``curve``, ``curve_key`` of every document; texts are read whole and left behind.

    A null text has 0 tokens. ``source`` is null where documents have none.
    """
    columns = ["doc_id", F.col("source") if "source" in documents.columns else F.lit(None).cast("string").alias("source"), "text"]
    matrix = projection()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                words: list | None = [] if curve else None
                texts = b.column(2).to_pylist()
                n = t.count(texts, words)
                out = [b.column(0), b.column(1), pa.array(n, pa.int64())]
                names = ["doc_id", "source", "tokens"]
                if words is not None:
                    out.append(pa.array(keys_of(words, len(texts), matrix), pa.int64()))
                    names.append("curve_key")
                yield pa.RecordBatch.from_arrays(out, names)

    return documents.select(*columns).mapInArrow(measure, "doc_id long, source string, tokens long" + (", curve_key long" if curve else ""))


def fill(sizes: list[int], capacity: int, block: int = 32, reach: int = 96) -> tuple[list[int], int]:
    """The container of each item, and the number of containers. Items must fit; those of size 0 go anywhere.

    Items come in order along the curve and are taken in blocks, the largest of a block first, each into the open container it
    leaves least space in. A container is closed once its first item lies more than ``reach`` before the block, so what shares
    a container lies less than ``reach + block`` places apart.
    """
    where, opened, first, n = [0] * len(sizes), [], [], 0
    for start in range(0, len(sizes), block):
        opened = [o for o in opened if first[o[1]] >= start - reach]
        for i in sorted(range(start, min(start + block, len(sizes))), key=lambda i: (-sizes[i], i)):
            size = sizes[i]
            at = bisect_left(opened, (size, -1))
            if at < len(opened):
                free, c = opened.pop(at)
                first[c] = min(first[c], i)
            else:
                free, c, n = capacity, n, n + 1
                first.append(i)
            where[i] = c
            if free - size > 0 or size == 0:
                insort(opened, (free - size, c))
    return where, n


def pack(documents: DataFrame, capacity: int = 8192, vocabulary: str = VOCABULARY, range_rows: int = 20_000, block: int = 32, reach: int = 96) -> DataFrame:
    """``container_id, doc_id, piece_no, n_pieces, start_token, tokens, place``: where every part of every document lies.

    ``place`` is the document's along the curve; within a container places differ by less than ``reach + block`` (see ``fill``).
    A document that fits is never split; a longer one becomes full containers and one rest that is packed like an item.
    Null and empty texts are items of size 0; repeated rows are items of their own; no documents, no containers. Documents
    are spread over ranges by key and a hash of ``doc_id``, so equal texts are no hot range.
    """
    measured = cut(sized(documents, vocabulary))
    rows = measured.count()
    parts = max(1, math.ceil(rows / range_rows))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        got = [f for f in frames if len(f)]
        if not got:
            return
        x = pd.concat(got, ignore_index=True)
        size = x["tokens"].to_numpy()
        n = np.maximum(1, -(-size // capacity))
        rest = size - (n - 1) * capacity
        where, used = fill(rest.tolist(), capacity, block, reach)
        doc = np.repeat(np.arange(len(x)), n)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        last = piece == n[doc] - 1
        container = np.where(last, np.array(where)[doc], 0)
        container[~last] = used + np.arange(int((~last).sum()))
        yield pd.DataFrame({
            "container_id": base + container, "doc_id": x["doc_id"].to_numpy()[doc], "piece_no": piece, "n_pieces": n[doc],
            "start_token": piece * capacity, "tokens": np.where(last, rest[doc], capacity), "place": base + doc,
        })

    along = measured.select("doc_id", "tokens", "curve_key").repartitionByRange(parts, "curve_key", F.xxhash64("doc_id"), "doc_id").sortWithinPartitions("curve_key", F.xxhash64("doc_id"), "doc_id")
    return along.mapInPandas(place, "container_id long, doc_id long, piece_no long, n_pieces long, start_token long, tokens long, place long")


def containers(packed: DataFrame, capacity: int = 8192) -> DataFrame:
    """One row per container: items, tokens, free space, and ``spread``, how far its items lie apart along the curve."""
    size = F.sum("tokens")
    return packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), size.alias("tokens"), (F.lit(capacity) - size).alias("free"), (F.max("place") - F.min("place")).alias("spread"))


def broken(packed: DataFrame, documents: DataFrame, capacity: int = 8192, reach: int = 128) -> DataFrame:
    """One row: documents placed, and how often a rule of packing is broken (0 where all is right).

    ``n_over``: containers over capacity; ``n_split``: parts of documents that fit; ``n_lost``: parts missing or placed twice;
    ``n_far``: containers whose items lie ``reach`` or more places apart.
    """
    c = containers(packed, capacity).agg(F.count(F.when(F.col("tokens") > capacity, 1)).alias("n_over"), F.count(F.when(F.col("spread") >= reach, 1)).alias("n_far"))
    d = packed.groupBy("place").agg(F.count(F.lit(1)).alias("parts"), F.countDistinct("piece_no").alias("distinct"), F.max("n_pieces").alias("n"), F.sum("tokens").alias("tokens"))
    d = d.agg(F.count(F.lit(1)).alias("n_placed"), F.count(F.when((F.col("n") > 1) & (F.col("tokens") <= capacity), 1)).alias("n_split"), F.count(F.when((F.col("parts") != F.col("n")) | (F.col("distinct") != F.col("n")), 1)).alias("n_lost"))
    n = documents.agg(F.count(F.lit(1)).alias("n_documents"))
    return n.crossJoin(c).crossJoin(d).select("n_documents", "n_placed", "n_over", "n_split", "n_lost", "n_far")  # three single rows
