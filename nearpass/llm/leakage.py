"""Evaluation passages inside training documents.

Items and documents are cut into windows of ``window`` words. A window, as a sequence of
word hashes, is embedded by a CGK random walk: at each step the word under the pointer is
written out, and a random bit of (step, word) decides whether the pointer moves on. Windows
at word edit distance k agree in most written places, so Hamming-LSH on sampled places finds
them: each of several repetitions has its own walk and a key over a few sampled places. Whoever
shares a key is a candidate and is verified by exact word edit distance. How many repetitions
the target recall takes is tried out; equal windows share their whole walk, so one does for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.llm.words import words
from nearpass.session import spread, stage

#: Item windows (times repetitions) up to which their keys go to the executors, about 100 bytes each; beyond, windows meet by a shuffle.
BROADCAST_WINDOWS = 400_000
#: Words whose windows are walked together.
CHUNK_WORDS = 100_000
#: Candidates compared at once.
CHUNK_PAIRS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LeakRules:
    """``recall`` is the share of windows within ``max_edits`` to be found; ``places`` of the walk go into a key."""

    window: int = 12
    max_edits: int = 0
    recall: float = 0.95
    places: int = 4
    seed: int = 20

    @property
    def steps(self) -> int:
        return 3 * self.window

    @property
    def sampled(self) -> int:
        return min(self.places, 2 * self.window)

    def repetitions(self) -> int:
        """Walks needed so that ``recall`` of windows at ``max_edits`` edits share a key with their original."""
        return _repetitions(self)


@lru_cache(maxsize=32)
def _repetitions(rules: LeakRules) -> int:
    """Tried out on random windows with random edits, with half of the missing recall in reserve."""
    rng = np.random.default_rng(rules.seed)
    pairs = 600
    missed = np.ones(pairs, bool)
    plain = rng.integers(1, 2**62, (pairs, rules.window + rules.max_edits), dtype=np.uint64)
    edited = plain.copy()
    for row in edited:
        for _ in range(rules.max_edits):
            at, kind = rng.integers(0, rules.window), rng.integers(0, 3)
            fresh = rng.integers(1, 2**62, dtype=np.uint64)
            if kind == 0:
                row[at] = fresh
            elif kind == 1:
                row[at:-1] = row[at + 1 :].copy()
                row[-1] = fresh
            else:
                row[at + 1 :] = row[at:-1].copy()
                row[at] = fresh
    starts = np.arange(pairs) * plain.shape[1]
    for r in range(256):
        missed &= cgk_keys(plain.ravel(), starts, rules, r) != cgk_keys(edited.ravel(), starts, rules, r)
        if missed.mean() <= (1 - rules.recall) / 2:
            return r + 1
    return 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(tokens: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words, kept in ``known``."""
    for t in set(tokens).difference(known):
        known[t] = xxhash.xxh64_intdigest(t) >> 1
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def cgk_keys(codes: np.ndarray, starts: np.ndarray, rules: LeakRules, repetition: int) -> np.ndarray:
    """LSH key of the window at each start: a hash of the walk's words at the sampled places."""
    rng = np.random.default_rng([rules.seed, repetition])
    sampled = sorted(rng.choice(2 * rules.window, size=rules.sampled, replace=False))
    salts = rng.integers(1, 2**63, size=rules.steps, dtype=np.uint64)
    pointer = np.zeros(len(starts), dtype=np.int64)
    key = np.full(len(starts), np.uint64(repetition + 1))
    with np.errstate(over="ignore"):
        for step in range(sampled[-1] + 1):
            inside = pointer < rules.window
            word = np.where(inside, codes[starts + np.minimum(pointer, rules.window - 1)], np.uint64(0))
            if step in sampled:
                key = _mixed(key * _MIX + word)
            pointer += (_mixed(word ^ salts[step]) & np.uint64(1)).astype(np.int64) & inside
    return key


def _edits(a: list[str], b: list[str], most: int) -> int:
    """Word edit distance, or ``most + 1`` if larger."""
    if a == b:
        return 0
    if not most:
        return 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def fingerprints(codes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A hash of all words of the window at each start."""
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            out = _mixed(out * _MIX + codes[starts + k])
    return out


class LeakIndex:
    """Sorted keys of item windows, each with its fingerprint, item and words."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, owner: np.ndarray, texts: np.ndarray, rules: LeakRules):
        order = np.argsort(keys, kind="stable")
        self.rules = rules
        self.keys, self.prints, self.owner, self.texts = keys[order], prints[order], owner[order], texts[order]
        self.codes = word_codes([w for t in self.texts for w in t.split(" ")], {}).reshape(-1, rules.window) if rules.max_edits else None

    def leaks(self, documents: list[list[str]], known: dict[str, int]) -> list[dict[int, int]]:
        """Items found in each document's words, with the smallest number of edits."""
        w = self.rules.window
        found: list[dict[int, int]] = [{} for _ in documents]
        codes, starts, ends = _windows(documents, known, w)
        first = np.r_[0, ends]
        if not len(self.keys) or not len(starts):
            return found
        for r in range(self.rules.repetitions()):
            key = cgk_keys(codes, starts, self.rules, r).view(np.int64)
            left = np.searchsorted(self.keys, key)
            hit = np.flatnonzero(self.keys[np.minimum(left, len(self.keys) - 1)] == key)
            left, right = left[hit], np.searchsorted(self.keys, key[hit], side="right")
            many = right - left
            cut = np.flatnonzero(np.diff(np.cumsum(many) // CHUNK_PAIRS)) + 1  # candidates of a bounded number at a time
            for part in np.split(np.arange(len(hit)), cut):
                at = np.repeat(hit[part], many[part])
                mine = np.arange(int(many[part].sum())) + np.repeat(left[part] - np.cumsum(many[part]) + many[part], many[part])
                near = self._near(codes, starts, hit[part], many[part], at, mine)
                at, mine = at[near], mine[near]
                owner = np.searchsorted(ends, starts[at], side="right")
                for place, doc, k in zip((starts[at] - first[owner]).tolist(), owner.tolist(), mine.tolist(), strict=True):
                    item, held = int(self.owner[k]), found[doc]
                    best = held.get(item, self.rules.max_edits + 1)
                    if best and (edits := _edits(documents[doc][place : place + w], self.texts[k].split(" "), min(best - 1, self.rules.max_edits))) < best:
                        held[item] = edits
        return found


    def _near(self, codes: np.ndarray, starts: np.ndarray, hit: np.ndarray, many: np.ndarray, at: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Candidates that may hold: equal fingerprints, or enough words found at most ``max_edits`` places away."""
        w, k = self.rules.window, self.rules.max_edits
        if not k:
            return np.repeat(fingerprints(codes, starts[hit], w).view(np.int64), many) == self.prints[mine]
        a, b = codes[starts[at][:, None] + np.arange(w)], self.codes[mine]
        kept = a == b
        for s in range(1, k + 1):
            kept[:, s:] |= a[:, s:] == b[:, :-s]
            kept[:, :-s] |= a[:, :-s] == b[:, s:]
        return kept.sum(1) >= w - k


def _windows(documents: list[list[str]], known: dict[str, int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, starts of all windows among them, and where each document ends."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    ends = np.cumsum(sizes)
    windows = np.maximum(sizes - window + 1, 0)
    shift = np.cumsum(windows) - windows
    starts = np.arange(int(windows.sum())) + np.repeat(ends - sizes - shift, windows)
    codes = np.concatenate([word_codes(d, known) for d in documents]) if len(documents) else np.zeros(0, np.uint64)
    return codes, starts, ends


def _chunks(frames: Iterator[pd.DataFrame], ident: str, text: str) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Ids and words of texts, about ``CHUNK_WORDS`` words at a time."""
    ids: list[int] = []
    texts: list[list[str]] = []
    size = 0
    for frame in frames:
        for i, t in zip(frame[ident], frame[text], strict=True):
            ids.append(i)
            texts.append(words(t))
            size += len(texts[-1])
            if size > CHUNK_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


_KEYED = "key bigint, print bigint, id bigint, words string"


def _keyed(ident: str, text: str, rules: LeakRules) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """All windows of texts with their key in every repetition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for ids, texts in _chunks(frames, ident, text):
            codes, starts, ends = _windows(texts, known, rules.window)
            owner = np.searchsorted(ends, starts, side="right")
            first = np.r_[0, ends]
            shown = [" ".join(texts[o][p : p + rules.window]) for o, p in zip(owner.tolist(), (starts - first[owner]).tolist(), strict=True)]
            prints = fingerprints(codes, starts, rules.window).view(np.int64)
            for r in range(rules.repetitions() if len(starts) else 0):
                key = cgk_keys(codes, starts, rules, r).view(np.int64)
                yield pd.DataFrame({"key": key, "print": prints, "id": np.array(ids, np.int64)[owner], "words": shown})
            if len(known) > 500_000:
                known.clear()

    return run


_FOUND = "doc_id bigint, item_id bigint, edits bigint"


def _by_index(texts: DataFrame, windows: DataFrame, rules: LeakRules) -> DataFrame:
    """One pass over the texts against the keys of all items, sent to each executor once."""
    rows = windows.toPandas()  # counted before
    held = texts.sparkSession.sparkContext.broadcast((rows["key"].to_numpy(np.int64), rows["print"].to_numpy(np.int64), rows["id"].to_numpy(np.int64), rows["words"].to_numpy(object)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = LeakIndex(*held.value, rules)
        known: dict[str, int] = {}
        for ids, documents in _chunks(frames, "doc_id", "text"):
            found = index.leaks(documents, known)
            out = [(doc, item, edits) for doc, items in zip(ids, found, strict=True) for item, edits in items.items()]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "edits"]).astype("int64")
            if len(known) > 500_000:
                known.clear()

    return texts.mapInPandas(run, _FOUND)


def _by_shuffle(texts: DataFrame, windows: DataFrame, rules: LeakRules) -> DataFrame:
    """Windows of texts and items meet on the key; a crowded key is split by AQE, or kept from the shuffle by its Bloom filter."""
    mine = texts.mapInPandas(_keyed("doc_id", "text", rules), _KEYED).withColumnsRenamed({"id": "doc_id", "words": "_mine", "print": "_print"})
    met = mine.join(windows.withColumnRenamed("id", "item_id"), "key")
    if not rules.max_edits:
        met = met.where(F.col("_print") == F.col("print"))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            edits = [_edits(a.split(" "), b.split(" "), rules.max_edits) for a, b in zip(frame["_mine"], frame["words"], strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "item_id": frame["item_id"], "edits": np.array(edits, np.int64)})

    return met.select("doc_id", "item_id", "_mine", "words").mapInPandas(verify, _FOUND).where(F.col("edits") <= rules.max_edits)


def leaked_items(documents: DataFrame, items: DataFrame, rules: LeakRules | None = None, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``doc_id, item_id, edits``: documents holding ``window`` successive words of an item's passage.

    Up to ``max_edits`` words may be inserted, dropped or replaced. Every window of every
    whole text is asked against all items, in one pass over the texts. The keys of up to
    ``broadcast_windows`` item windows, counted first, are sent to the executors; more meet the
    texts' windows by a shuffle on the key, with the same result. Null, empty and shorter texts
    or passages hold nothing; a repeated item or document changes nothing, an item with several
    passages has the windows of all; rows without id are left out.
    """
    rules = rules or LeakRules()
    wanted = items.select("item_id", "passage").where("item_id IS NOT NULL AND passage IS NOT NULL").dropDuplicates()
    texts = spread(documents.select("doc_id", "text"), "doc_id").where("doc_id IS NOT NULL AND text IS NOT NULL")
    windows = stage(wanted.mapInPandas(_keyed("item_id", "passage", rules), _KEYED).distinct(), "items")
    found = (_by_index if windows.count() <= broadcast_windows else _by_shuffle)(texts, windows, rules)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
