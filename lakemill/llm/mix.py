"""Mixing sources to target weights by exact block quotas that a splitting tree deals out to the output shards.

Every source's documents fall into blocks by a hash; as many blocks as its quota holds are drawn, the last one up to the
document at which the quota ends. A multivariate hypergeometric splitting tree divides the numbers of drawn blocks among
the shards, each shard takes its count from the permuted blocks of each source, and documents are shuffled in their shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.llm.pack import sized
from lakemill.llm.tokens import VOCABULARY
from lakemill.operators.ordered import Scan, scan
from lakemill.session import cut


@dataclass(frozen=True)
class Quota:
    source: str
    weight: float
    max_repeats: int
    available: int
    wanted: float
    quota: int
    short: bool

    @property
    def passes(self) -> int:
        return 0 if self.available == 0 else math.ceil(self.quota / self.available)


def quotas(targets: list[tuple[str, float, int]], available: dict[str, int]) -> list[Quota]:
    """What each source gives: its weight of the total of all listed sources, at most ``max_repeats`` times its own size.

    What a source is short of is not made up by others, which keeps their shares nearest to the weights. A source listed
    more than once counts with the sum of its weights and its least ``max_repeats``; null weights and repeats are 0.
    """
    merged: dict[str, tuple[float, int]] = {}
    for source, weight, repeats in targets:
        if source is not None:
            w, r = merged.get(source, (0.0, None))
            merged[source] = (w + (weight or 0.0), (repeats or 0) if r is None else min(r, repeats or 0))
    total = sum(available.get(s, 0) for s in merged)
    out = []
    for source, (weight, repeats) in sorted(merged.items()):
        have, want = available.get(source, 0), weight * total
        most = have * repeats
        out.append(Quota(source, weight, repeats, have, want, min(round(want), most), most < want))
    return out


def split_nodes(blocks: np.ndarray, first: int, end: int, seed: int, stop: int = 1) -> list[tuple[int, int, np.ndarray]]:
    """The nodes of the splitting tree below (first, end) of at most ``stop`` shards, in order: (first, end, blocks of each source).

    Each node halves its shards and draws the left half's blocks without replacement from its own, by a seed of its own: a
    subtree comes out the same wherever it is grown.
    """
    out, todo = [], [(first, end, blocks.astype(np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b - a <= stop:
            out.append((a, b, have))
            continue
        m = (a + b) // 2
        n = int(have.sum()) * (m - a) // (b - a)
        left = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(have, n, method="marginals") if n else np.zeros_like(have)
        todo += [(m, b, have - left), (a, m, left)]
    return out


def splitting_tree(blocks: np.ndarray, shards: int, seed: int = 7) -> np.ndarray:
    """Blocks of each source for each shard: rows are shards, columns sources; columns add up to ``blocks`` exactly."""
    return np.array([have for *_, have in split_nodes(blocks, 0, shards, seed)])


#: The driver grows the tree down to at most about so many nodes; tasks grow what lies below each.
DRIVER_NODES = 4096


def deal(spark: SparkSession, names: list[str], blocks: np.ndarray, shards: int, seed: int) -> DataFrame:
    """``source, shard, place``: each drawn block of a source, by its place among them, and the shard it goes to."""
    top = split_nodes(blocks, 0, shards, seed, max(1, math.ceil(shards / DRIVER_NODES)))
    before = np.cumsum([have for *_, have in top], axis=0) - [have for *_, have in top]
    nodes = spark.createDataFrame([(a, b, have.tolist(), first.tolist()) for (a, b, have), first in zip(top, before, strict=True)], "a long, b long, have array<long>, first array<long>")

    def below(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a, b, have, first in zip(f["a"], f["b"], f["have"], f["first"], strict=True):
                at, out = np.array(first, dtype=np.int64), []
                for shard, _, n in split_nodes(np.array(have, dtype=np.int64), a, b, seed):
                    some = np.flatnonzero(n)
                    out.append(pd.DataFrame({"source": [names[i] for i in some], "shard": shard, "first": at[some], "end": (at + n)[some]}))
                    at = at + n
                yield pd.concat(out, ignore_index=True)

    runs = nodes.repartition(max(1, len(top) // 256)).mapInPandas(below, "source string, shard long, first long, end long")
    return runs.select("source", "shard", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("place"))


_USE = "doc_id long, source string, repeat long, order long, tokens long, shard long"
_USE_COLUMNS = ["doc_id", "source", "repeat", "order", "tokens", "shard"]


def _fit(block: pd.DataFrame) -> pd.DataFrame:
    """The documents of a quota's last block in hash order, without those that no longer fit."""
    block = block.sort_values(["order", "doc_id"], kind="stable")
    room, keep = int(block["room"].iloc[0]), []
    for n in block["tokens"].tolist():
        keep.append(n <= room)
        room -= n if n <= room else 0
    return block.loc[keep, _USE_COLUMNS]


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = 1 << 16, shard_tokens: int = 1 << 22, seed: int = 7, most_sources: int = 100_000) -> tuple[DataFrame, list[Quota]]:
    """The mixture: ``shard, position, doc_id, source, repeat, tokens``, and the quotas it follows.

    ``targets`` (``source, weight, max_repeats``) is held by the driver and may have at most ``most_sources`` rows; more are an
    error. The driver also holds the top of the tree, at most about 4,096 nodes of one number per source; the rest is grown in tasks. Documents
    without a target are not used; null and empty texts have no size and come along with their block. No document is used
    more than ``max_repeats`` times; each further use is one whole pass over its source, the last in part. Repeated rows of
    a document are documents of their own.
    """
    rows = targets.select("source", "weight", "max_repeats").limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} targets")
    sizes = cut(sized(documents, vocabulary, curve=False))
    listed = targets.select("source").where("source IS NOT NULL").distinct()
    have = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("tokens").alias("n")).join(listed, "source").collect()}
    plan = quotas([tuple(r) for r in rows], have)
    spark = sizes.sparkSession
    per = [(q.source, q.passes, q.quota - (q.passes - 1) * q.available, max(1, math.ceil(q.available / block_tokens))) for q in plan if q.quota > 0]
    if not per:
        return spark.createDataFrame([], "shard long, position long, doc_id long, source string, repeat long, tokens long"), plan
    rule = spark.createDataFrame(per, "source string, passes long, last_tokens long, n_blocks long")

    # every use of a document, with its block in that pass
    uses = sizes.join(F.broadcast(rule) if len(per) <= 10_000 else rule, "source").withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))))
    uses = uses.withColumn("order", F.xxhash64("doc_id", "source", "repeat", F.lit(seed))).withColumn("block", F.pmod(F.xxhash64("doc_id", "repeat", "source", F.lit(seed + 1)), "n_blocks"))
    blocks = uses.groupBy("source", "repeat", "block", "passes", "last_tokens").agg(F.sum("tokens").alias("size"))
    run = scan(blocks.withColumn("slice", F.floor(F.col("block") / 4096)), ["source", "repeat"], "slice", ["block"], [Scan("before", "size", "sum", "before")])
    # of the last pass only the blocks that begin within the quota are drawn
    room = F.when(F.col("repeat") == F.col("passes"), F.col("last_tokens") - F.col("before"))
    drawn = cut(run.withColumn("room", room).where("room IS NULL OR room > 0").select("source", "repeat", "block", "size", "room").withColumn("turn", F.xxhash64("source", "repeat", "block", F.lit(seed + 2))))

    counts = {r["source"]: (r["n"], r["t"]) for r in drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("size", F.coalesce("room", "size"))).alias("t")).collect()}
    names = sorted(counts)
    shards = max(1, math.ceil(sum(t for _, t in counts.values()) / shard_tokens))
    dealt = deal(spark, names, np.array([counts[s][0] for s in names]), shards, seed)

    ranked = scan(drawn.withColumn("one", F.lit(1).cast("long")).withColumn("slice", F.shiftright("turn", 48)), ["source"], "slice", ["turn", "repeat", "block"], [Scan("place", "one", "sum", "before")])
    home = ranked.join(dealt, ["source", "place"]).select("source", "repeat", "block", "size", "room", "shard")
    got = uses.select("doc_id", "source", "repeat", "block", "order", "tokens").join(home, ["source", "repeat", "block"])
    # of the block in which a source's quota ends, a bounded set, documents are taken while they fit
    last = got.where("room < size").groupBy("source").applyInPandas(_fit, _USE)
    got = got.where("room IS NULL OR room >= size").select(*_USE_COLUMNS).unionByName(last)
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("order", F.lit(seed + 3)), "doc_id", "repeat"))
    return got.select("shard", (place - 1).cast("long").alias("position"), "doc_id", "source", "repeat", "tokens"), plan


def shares(mixture: DataFrame, plan: list[Quota]) -> DataFrame:
    """One row per target: what was wanted, had and used, and the share of the mixture that came of it.

    ``short``: even ``max_repeats`` times the source is less than its weight of the total.
    """
    spark = mixture.sparkSession
    used = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("used_tokens"), F.max("repeat").alias("most_repeats"))
    schema = "source string, weight double, max_repeats long, available_tokens long, wanted_tokens double, quota_tokens long, short boolean"
    asked = spark.createDataFrame([(q.source, q.weight, q.max_repeats, q.available, float(q.wanted), q.quota, q.short) for q in plan], schema)
    x = asked.join(used, "source", "left").na.fill(0, ["uses", "used_tokens", "most_repeats"])
    x = x.withColumn("total_tokens", F.sum("used_tokens").over(Window.partitionBy()))  # no more rows than targets
    return x.withColumn("actual_share", F.when(F.col("total_tokens") > 0, F.col("used_tokens") / F.col("total_tokens")).otherwise(0.0)).drop("total_tokens")
