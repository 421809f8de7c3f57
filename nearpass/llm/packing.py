"""Documents packed whole into containers of fixed capacity (hierarchical multi-length packing).

For a capacity every piece is routed to a context-size tier, each half as long as the one
before. From the longest on, a tier is packed by itself: its longest piece left opens a
container, and the longest of the same tier that fit follow. Gaps are then filled from the
shorter tiers, one tier after the other, the tightest gap choosing first. Containers of
a capacity are ranked by attention work and dealt into step groups of equal size.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearpass.session import spread, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary splits text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Capacities packed by one plan; more are worked off in blocks.
CAPACITIES = 64
_PIECE = "doc_id bigint, part bigint, start_token bigint, n_tokens bigint, tier int, position bigint"
_CONTAINER = f"capacity_tokens bigint, container string, work double, pieces array<struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>>"


@dataclass(frozen=True)
class PackRules:
    """``tiers`` sizes of context; about ``shard_rows`` pieces are packed together; ``group`` containers make a step."""

    tiers: int = 6
    shard_rows: int = 20_000
    group: int = 8


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of whole texts; null and empty texts have none and are left out.

    The rank file must be at the same path on every executor. Strings of special
    tokens inside a text are ordinary text. A document given twice counts once.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for frame in frames:
            sizes = np.fromiter((len(encode(t)) for t in frame["text"]), dtype=np.int64, count=len(frame))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": sizes})

    texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    counted = texts.mapInPandas(count, "doc_id bigint, n_tokens bigint").where("n_tokens > 0")
    return counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))  # counts are deduplicated, texts aren't moved for it


class _Lengths:
    """Pieces by length, with the longest remaining length up to a bound in near constant time."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        order = np.argsort(sizes, kind="stable")
        self.order, ordered = order, sizes[order]
        self.next = np.searchsorted(ordered, np.arange(capacity + 2))
        self.end = self.next[1:].copy()
        held = np.flatnonzero(self.end > self.next[:-1])
        self.below = np.zeros(capacity + 1, dtype=np.int64)
        self.below[held] = held
        self.below = np.maximum.accumulate(self.below).tolist()
        self.next, self.end = self.next.tolist(), self.end.tolist()

    def longest(self, most: int) -> int:
        """A length of which a piece is left, at most ``most``; 0 if none."""
        below = self.below
        at = below[most]
        while at and self.next[at] >= self.end[at]:
            at = below[at - 1]
        while most and below[most] != at:  # shorten the way for later calls
            below[most], most = at, below[most] - 1 if below[most] > at else 0
        return at

    def take(self, length: int) -> int:
        at = self.next[length]
        self.next[length] += 1
        return int(self.order[at])


def tier_of(sizes: np.ndarray, capacity: int, tiers: int) -> np.ndarray:
    """Tier 0 holds more than half of the capacity, each next one half of that; the last all shorter ones."""
    return np.minimum(np.floor(np.log2(capacity / sizes)), tiers - 1).astype(np.int32)


def pack_sizes(sizes: np.ndarray, capacity: int, tiers: int = 6) -> list[list[int]]:
    """Containers as lists of piece indices, tier by tier; every size is in 1..capacity."""
    tier = tier_of(sizes, capacity, tiers) if len(sizes) else np.zeros(0, np.int32)
    routed = [np.flatnonzero(tier == t) for t in range(tiers)]
    pools = [_Lengths(sizes[r], capacity) for r in routed]
    out: list[list[int]] = []

    def fill(mine: list[int], gap: int, t: int) -> int:
        while gap and (length := pools[t].longest(gap)):
            mine.append(int(routed[t][pools[t].take(length)]))
            gap -= length
        return gap

    for t in range(tiers):
        opened: list[tuple[int, int]] = []
        while pools[t].longest(capacity):
            mine: list[int] = []
            gap = fill(mine, capacity, t)
            opened.append((gap, len(out)))
            out.append(mine)
        for shorter in range(t + 1, tiers):
            opened = [(fill(out[k], gap, shorter), k) for gap, k in sorted(opened) if gap]
    return out


def _pack_shard(rules: PackRules) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pandas().sort_values(["doc_id", "part"], kind="stable").reset_index(drop=True)
        capacity, shard = int(rows["capacity_tokens"].iloc[0]), int(rows["shard"].iloc[0])
        sizes = rows["n_tokens"].to_numpy()
        containers = pack_sizes(sizes, capacity, rules.tiers)
        count = np.array([len(c) for c in containers])
        taken = np.concatenate([np.array(c) for c in containers])
        first = np.r_[0, np.cumsum(count)[:-1]]
        held = sizes[taken]
        start = np.cumsum(held) - held
        fields = {c: pa.array(rows[c].to_numpy()[taken]) for c in ("doc_id", "part", "start_token", "n_tokens")}
        fields["tier"] = pa.array(tier_of(held, capacity, rules.tiers))
        fields["position"] = pa.array(start - np.repeat(start[first], count))
        pieces = pa.ListArray.from_arrays(pa.array(np.r_[first, len(taken)].astype(np.int32)), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
        return pa.table({
            "capacity_tokens": pa.array(np.full(len(count), capacity, np.int64)), "container": pa.array([f"{capacity}-{shard}-{k}" for k in range(len(count))]),
            "work": pa.array(np.add.reduceat(held.astype(float) ** 2, first)), "pieces": pieces,
        })

    return run


def with_step_groups(containers: DataFrame, group: int) -> DataFrame:
    """Adds ``step_group``: the containers of a capacity, ranked by attention work, dealt out forth and back.

    The rank is a container's place in its range partition plus the sizes of those before, a small row per
    partition and capacity, so no window runs over a capacity. Groups have ``group`` containers or one less.
    """
    order = [F.desc("work"), F.col("container")]
    cut = stage(containers.repartitionByRange("capacity_tokens", *order).withColumn("_pid", F.spark_partition_id()), "containers")
    sizes = cut.groupBy("capacity_tokens", "_pid").agg(F.count(F.lit(1)).alias("_n"))
    by_place = W.partitionBy("capacity_tokens").orderBy("_pid")
    before = sizes.select("capacity_tokens", "_pid", (F.sum("_n").over(by_place) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy("capacity_tokens")).alias("_total"))
    place = F.row_number().over(W.partitionBy("capacity_tokens", "_pid").orderBy(*order))
    rank = F.col("_before") + F.col("_place") - 1
    groups = F.ceil(F.col("_total") / group)
    at = rank % groups
    turned = F.when(F.floor(rank / groups) % 2 == 0, at).otherwise(groups - 1 - at)
    out = cut.withColumn("_place", place).join(F.broadcast(before), ["capacity_tokens", "_pid"])  # a row per partition and capacity
    return out.withColumn("step_group", F.concat_ws("-", "capacity_tokens", turned)).drop("_pid", "_place", "_before", "_total")


def pack_documents(counts: DataFrame, capacities: DataFrame, rules: PackRules | None = None) -> DataFrame:
    """A row per piece: its container, step group, tier and position, for every capacity.

    A document within the capacity stays whole. A longer one is cut into full containers,
    which need no packing, and a rest that is packed like any other piece. Such pieces, one a
    document at most, are dealt by hash into shards of about ``shard_rows``, each packed by itself,
    so that no task grows with the corpus; a shard leaves at most a few containers part-filled.
    Documents without tokens are in no container; capacities below 1 or null are ignored,
    equal ones merged, and many worked off in blocks.
    """
    rules = rules or PackRules()
    sized = stage(counts.select("doc_id", "n_tokens"), "tokens")
    limits = capacities.select(F.col("capacity_tokens").cast("bigint").alias("c")).where("c > 0").distinct()
    packed = None
    for block in batched((r.c for r in limits.orderBy("c").toLocalIterator()), CAPACITIES):
        containers = _packed_block(sized, block, rules)
        packed = containers if packed is None else packed.unionByName(containers)
    if packed is None:
        packed = counts.sparkSession.createDataFrame([], _CONTAINER)
    pieces = with_step_groups(packed, rules.group).select("capacity_tokens", "container", "step_group", F.explode("pieces").alias("piece"))
    return pieces.select("capacity_tokens", "container", "step_group", "piece.*")


def _packed_block(sized: DataFrame, limits: tuple[int, ...], rules: PackRules) -> DataFrame:
    """Containers of the documents for each of some capacities."""
    rests = sized.agg(*[F.count_if(F.col("n_tokens") % c != 0) for c in limits]).first()
    shards = [max(1, -(-n // rules.shard_rows)) for n in rests]
    targets = F.array(*[F.struct(F.lit(c).cast("bigint").alias("c"), F.lit(n).cast("bigint").alias("shards")) for c, n in zip(limits, shards, strict=True)])
    routed = sized.select("doc_id", "n_tokens", F.explode(targets).alias("_to")).select("doc_id", "n_tokens", F.col("_to.c").alias("capacity_tokens"), F.col("_to.shards").alias("_shards"))
    whole, rest = F.expr("n_tokens div capacity_tokens"), F.col("n_tokens") % F.col("capacity_tokens")
    loose = routed.where(rest > 0).select(
        "capacity_tokens", F.pmod(F.xxhash64("doc_id"), F.col("_shards")).alias("shard"), "doc_id", whole.alias("part"),
        (whole * F.col("capacity_tokens")).alias("start_token"), rest.alias("n_tokens"),
    )
    mixed = loose.groupBy("capacity_tokens", "shard").applyInArrow(_pack_shard(rules), _CONTAINER)
    size = F.col("capacity_tokens")
    cut = routed.where(whole > 0).select("doc_id", "capacity_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("part"))
    piece = F.struct("doc_id", "part", (F.col("part") * size).alias("start_token"), size.alias("n_tokens"), F.lit(0).alias("tier"), F.lit(0).cast("bigint").alias("position"))
    full = cut.select(size, F.concat_ws("-", size, F.lit("d"), "doc_id", "part").alias("container"), F.pow(size.cast("double"), F.lit(2.0)).alias("work"), F.array(piece).alias("pieces"))
    return mixed.unionByName(full)


def packed_corpus(documents: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER, rules: PackRules | None = None) -> DataFrame:
    return pack_documents(token_counts(spread(documents.select("doc_id", "text"), "doc_id"), tokenizer), capacities, rules)


def utilisation(packed: DataFrame) -> DataFrame:
    """``capacity_tokens, containers, tokens, used`` (share of the room that is filled)."""
    per_container = packed.groupBy("capacity_tokens", "container").agg(F.sum("n_tokens").alias("held"))
    totals = per_container.groupBy("capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("held").alias("tokens"))
    return totals.withColumn("used", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
