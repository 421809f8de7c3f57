"""Pair each event with the record of the same entity nearest in time, through x-fast tries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.session import stage

#: Resolution of a timestamp: 2**-31 day (40 microseconds), the spacing of doubles near a Julian date of today.
TICKS = 2.0**31
#: Rows of one trie; a longer run of one entity is worked off in overlapping pieces.
PIECE = 65_536
#: Rows out of a task: candidates (``wait`` null), waiting events (no ``right_id``) and the records they wait for (no ``left_id``).
_OUT = {"left_id": "Int64", "gap": "float64", "right_id": "Int64", "wait": "Int64", "jd": "float64"}


class XFastTrie:
    """Hash tables of all prefixes of sorted keys; predecessor and successor in log(bits) probes.

    A key is an entity number above ``low`` timestamp bits, so all tries of a batch share
    one set of tables. Tables are built for the prefix lengths that get probed.
    """

    def __init__(self, keys: np.ndarray, low: int):
        self.keys, self.low = keys, low
        self.tables: dict[int, tuple[pd.Index, np.ndarray]] = {}

    def _table(self, length: int) -> tuple[pd.Index, np.ndarray]:
        if length not in self.tables:
            prefixes, first = np.unique(self.keys >> (self.low - length), return_index=True)
            self.tables[length] = pd.Index(prefixes), np.r_[first, len(self.keys)]
        return self.tables[length]

    def _node(self, length: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each prefix is present, and the first and last key below it."""
        index, first = self._table(length)
        at = index.get_indexer(asked >> (self.low - length))
        return at >= 0, first[at], first[at + 1] - 1

    def neighbours(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of predecessor (<=) and successor (>=) within the entity; -1 where none."""
        before, after = np.full(len(asked), -1), np.full(len(asked), -1)
        known = np.flatnonzero(self._node(0, asked)[0]) if len(self.keys) else np.array([], int)
        low, high = np.zeros(len(asked), int), np.full(len(asked), self.low)
        open_ = known
        while len(open_):
            middle = (low[open_] + high[open_] + 1) // 2
            for length in np.unique(middle):
                who = open_[middle == length]
                hit = self._node(int(length), asked[who])[0]
                low[who[hit]] = length
                high[who[~hit]] = length - 1
            open_ = open_[low[open_] < high[open_]]
        for length in np.unique(low[known]):
            who = known[low[known] == length]
            _, first, last = self._node(int(length), asked[who])
            if length == self.low:
                before[who] = after[who] = first
                continue
            right = (asked[who] >> (self.low - int(length) - 1)) & 1 == 1
            before[who] = np.where(right, last, first - 1)
            after[who] = np.where(right, last + 1, first)
        entity = asked >> self.low
        for found in (before, after):
            inside = (found >= 0) & (found < len(self.keys))
            found[~inside] = -1
            found[inside] = np.where(self.keys[found[inside]] >> self.low == entity[inside], found[inside], -1)
        return before, after


def _match_piece(piece: pd.DataFrame, entity: np.ndarray, width: float, tolerance: float) -> pd.DataFrame:
    """Candidates of the events of a piece that is sorted by entity, block, time and id."""
    low = int(np.ceil(np.log2(width * TICKS)))
    tick = np.floor((piece["_jd"].to_numpy() - piece["_block"].to_numpy() * width) * TICKS).astype(np.int64)
    key = (entity.astype(np.int64) << low) | np.clip(tick, 0, (1 << low) - 1)
    is_event = piece["_event"].to_numpy()
    keys, first = np.unique(key[~is_event], return_index=True)  # of equal ticks the smallest id stays
    jd, ids = piece["_jd"].to_numpy()[~is_event][first], piece["_id"].to_numpy()[~is_event][first]
    asked, event_jd, event_id = key[is_event], piece["_jd"].to_numpy()[is_event], piece["_id"].to_numpy()[is_event]
    out = []
    for found in XFastTrie(keys, low).neighbours(asked):
        has = np.flatnonzero(found >= 0)
        gap = np.abs(jd[found[has]] - event_jd[has])
        near = gap <= tolerance
        out.append(pd.DataFrame({"left_id": event_id[has][near], "gap": gap[near], "right_id": ids[found[has]][near], "wait": None, "jd": np.nan}).astype(_OUT))
    return pd.concat(out, ignore_index=True)


def _matcher(keys: list[str], width: float, tolerance: float, limit: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def entities(rows: pd.DataFrame) -> np.ndarray:
        parts = [rows[k].to_numpy() for k in [*keys, "_block"]]
        new = np.zeros(len(rows), bool)
        for values in parts:
            new[1:] |= values[1:] != values[:-1]
        return np.cumsum(new)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        wait = (context.partitionId() if context else 0) << 40
        asked = False  # whether events of the first row's entity wait for its next record
        kept: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            kept.append(frame)
            size += len(frame)
            if size < limit:
                continue
            rows = pd.concat(kept, ignore_index=True)
            entity = entities(rows)
            if asked and (answer := _answer(rows, entity, wait)) is not None:
                yield answer
                asked, wait = False, wait + 1
            cut = int(np.searchsorted(entity, entity[-1]))  # whole entities end here
            if cut:
                asked = False
                yield _match_piece(rows.iloc[:cut], entity[:cut], width, tolerance)
                rows = rows.iloc[cut:]
            else:  # one entity fills the piece: end at its last record, which also opens the next piece
                records = np.flatnonzero(~rows["_event"].to_numpy())
                cut = int(records[-1]) + 1 if len(records) else 0
                if cut:
                    yield _match_piece(rows.iloc[:cut], entity[:cut], width, tolerance)
                    last = records[np.searchsorted(rows["_jd"].to_numpy()[records], rows["_jd"].iloc[cut - 1])]  # of equal times the smallest id
                    rows = pd.concat([rows.iloc[[last]], rows.iloc[cut:]])
                if len(rows) >= limit:  # events only: they have their predecessor and wait for the successor outside
                    events = rows[rows["_event"].to_numpy()]
                    if cut:
                        yield _match_piece(rows, np.zeros(len(rows), np.int64), width, tolerance)
                    yield pd.DataFrame({"left_id": events["_id"], "gap": np.nan, "right_id": None, "wait": wait, "jd": events["_jd"]}).astype(_OUT)
                    asked, rows = True, rows.iloc[:1]
            kept, size = [rows], len(rows)
        if kept:
            rows = pd.concat(kept, ignore_index=True)
            if len(rows):
                entity = entities(rows)
                if asked and (answer := _answer(rows, entity, wait)) is not None:
                    yield answer
                yield _match_piece(rows, entity, width, tolerance)

    return run


def _answer(rows: pd.DataFrame, entity: np.ndarray, wait: int) -> pd.DataFrame | None:
    """The next record after the first row, of its entity, if it has come."""
    new = np.flatnonzero((entity == entity[0]) & ~rows["_event"].to_numpy())
    new = new[new > 0]
    if not len(new):
        return None
    record = rows.iloc[new[:1]]
    return pd.DataFrame({"left_id": None, "gap": np.nan, "right_id": record["_id"], "wait": wait, "jd": record["_jd"]}).astype(_OUT)


def nearest_in_time(
    events: DataFrame, records: DataFrame, keys: list[str], event_time: str, record_time: str, event_id: str, record_id: str, tolerance: float, piece: int = PIECE
) -> DataFrame:
    """``event_id, record_id, gap``: for each event the nearest record with equal keys.

    At most ``tolerance`` (inclusive, in the unit of the times, days) away; of equally near
    records the one with the smaller id. Ids are whole numbers. Rows with a null key, id or
    time, or a NaN time, match nothing; repeated rows change nothing. Entities are split in
    time blocks of two tolerances, an event going to the one or two blocks its tolerance
    reaches, so that an entity holding a third of all rows spreads over the cluster; inside
    a block a piece of about ``piece`` rows is in memory. Events that fill a piece with no
    record among them wait in the staged result for the record that follows. Only pairs of an
    event and its two neighbours are made, never all pairs of an entity.
    """
    width = 2.0 * tolerance

    def side(df: DataFrame, time: str, ident: str, event: bool) -> DataFrame:
        jd = F.col(time).cast("double")
        block = lambda x: F.floor(x / width).cast("bigint")
        blocks = F.array_distinct(F.array(block(jd - tolerance), block(jd + tolerance))) if event else F.array(block(jd))
        known = df.where(F.col(time).isNotNull() & ~F.isnan(jd) & F.col(ident).isNotNull()).dropna(subset=keys)
        return known.select(*keys, F.explode(blocks).alias("_block"), jd.alias("_jd"), F.col(ident).cast("bigint").alias("_id"), F.lit(event).alias("_event"))

    both = side(events, event_time, event_id, True).unionByName(side(records, record_time, record_id, False))
    together = both.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "_jd", "_id")
    met = stage(together.mapInPandas(_matcher(keys, width, tolerance, piece), "left_id bigint, gap double, right_id bigint, wait bigint, jd double"), "nearest")
    records_met = met.where("left_id IS NULL").select("wait", F.col("right_id"), F.col("jd").alias("_jd"))
    late = met.where("wait IS NOT NULL AND right_id IS NULL").select("left_id", "wait", "jd").join(records_met, "wait")
    late = late.select("left_id", F.abs(F.col("_jd") - F.col("jd")).alias("gap"), "right_id").where(F.col("gap") <= tolerance)
    candidates = met.where("wait IS NULL").select("left_id", "gap", "right_id").unionByName(late)
    best = candidates.groupBy("left_id").agg(F.min(F.struct("gap", "right_id")).alias("best"))
    return best.select(F.col("left_id").alias(event_id), F.col("best.right_id").alias(record_id), F.col("best.gap").alias("gap"))
