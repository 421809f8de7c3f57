"""Subject areas of documents by class-association rules over sentences.

A sentence is a transaction of words and a class item. Frequent patterns of up to two words
and a class are grown in parallel: frequent words first, then, for each, the frequent words it
meets in the same sentences. Every step is a count that adds up, combined where the sentences
are. Patterns with a class become rules ``words -> class``; redundant ones are pruned, and the evidence of
the rules that match a sentence is calibrated to a probability. A document gets every subject
that at least ``share`` of its sentences treat.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.llm.leakage import word_codes
from nearpass.llm.words import SENTENCE_END, joined, marked_words, split_sentences, word_runs
from nearpass.session import broadcast_if_small, spread, stage

#: Word codes worked on at once.
CHUNK_CODES = 2_000_000
_CODED = "doc_id bigint, sizes binary, codes binary"


@dataclass(frozen=True)
class SubjectRules:
    """Thresholds of mining. All sentences of all documents are mined and scored, none is left out.

    A pattern needs ``least`` sentences and ``least_share`` of all. ``rounds`` of mining follow each
    other: the first takes documents with a single label, the later ones all documents, a
    sentence carrying the subject that the rules so far give it, because a document's label
    need not hold for each of its sentences and few labels leave words unseen.
    """

    share: float = 0.25
    least: int = 4
    least_share: float = 0.0003
    confidence: float = 0.5
    lift: float = 2.0
    words: int = 2
    gain: float = 0.03
    rounds: int = 2
    probability: float = 0.5


def _find(table: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``asked`` are in the sorted table, and where."""
    if not len(table) or not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, asked), len(table) - 1)
    hit = np.flatnonzero(table[at] == asked)
    return hit, at[hit]


def _together(sentence: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Smaller item, larger item and sentence of every two items of a sentence, by their distance in its order."""
    if not len(item):
        return
    width = int(item.max()) + 1
    sentence, item = np.divmod(np.sort(sentence.astype(np.int64) * width + item), width)
    start = np.arange(len(item))
    for step in range(1, len(item)):
        start = start[start + step < len(item)]
        start = start[sentence[start] == sentence[start + step]]
        if not len(start):
            return
        for k in range(0, len(start), CHUNK_CODES):
            some = start[k : k + CHUNK_CODES]
            yield item[some], item[some + step], sentence[some]


class _Counts:
    """How often each number was added; batches are counted by themselves and merged now and then."""

    def __init__(self) -> None:
        self.keys, self.n, self.loose = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def __len__(self) -> int:
        self._merge()
        return len(self.keys[0])

    def add(self, keys: np.ndarray) -> None:
        at, distinct = pd.factorize(keys)
        self.keys.append(distinct)
        self.n.append(np.bincount(at, minlength=len(distinct)))
        self.loose += len(distinct)
        if self.loose > CHUNK_CODES:
            self._merge()

    def _merge(self) -> None:
        at, distinct = pd.factorize(np.concatenate(self.keys))
        self.n = [np.bincount(at, np.concatenate(self.n), len(distinct)).astype(np.int64)]
        self.keys, self.loose = [distinct], 0

    def rows(self, labels: int) -> pd.DataFrame:
        self._merge()
        return pd.DataFrame({"pair": self.keys[0] // labels, "label": self.keys[0] % labels, "n": self.n[0]})


@dataclass
class RuleModel:
    """Rules by the code of a word or of two, and the logistic map from evidence to probability."""

    classes: list[str]
    single: dict[int, tuple[int, float]] = field(default_factory=dict)
    pairs: dict[tuple[int, int], tuple[int, float]] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self) -> None:
        self.words = np.array(sorted(self.single), np.uint64)
        self.word_rules = np.array([self.single[int(w)] for w in self.words]).reshape(-1, 2)
        self.paired = np.array(sorted({w for pair in self.pairs for w in pair}), np.uint64)
        keys = {int(np.searchsorted(self.paired, np.uint64(a)) * len(self.paired) + np.searchsorted(self.paired, np.uint64(b))): rule for (a, b), rule in self.pairs.items()}
        self.pair_keys = np.array(sorted(keys), np.int64)
        self.pair_rules = np.array([keys[int(k)] for k in self.pair_keys]).reshape(-1, 2)

    def evidence(self, sentence: np.ndarray, codes: np.ndarray, sentences: int) -> np.ndarray:
        """Summed weights of the matching rules, by sentence and class."""
        k = len(self.classes)
        hit, at = _find(self.words, codes)
        rules = self.word_rules[at]
        out = np.zeros(sentences * k)
        out += np.bincount(sentence[hit] * k + rules[:, 0].astype(np.int64), rules[:, 1], sentences * k)
        hit, at = _find(self.paired, codes)
        for a, b, where in _together(sentence[hit], at):
            met, rule = _find(self.pair_keys, a * len(self.paired) + b)
            rules = self.pair_rules[rule]
            out += np.bincount(where[met] * k + rules[:, 0].astype(np.int64), rules[:, 1], sentences * k)
        return out.reshape(sentences, k)

    def subjects(self, sentence: np.ndarray, codes: np.ndarray, sentences: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Class of each sentence, -1 where none has a probability of ``least``, and the margin of the best."""
        if not self.classes or not sentences:
            return np.full(sentences, -1), np.zeros(sentences)
        evidence = self.evidence(sentence, codes, sentences)
        best = evidence.argmax(1)
        top = evidence[np.arange(sentences), best]
        second = np.partition(evidence, -2, axis=1)[:, -2] if len(self.classes) > 1 else np.zeros(sentences)
        sure = 1 / (1 + np.exp(-np.clip(self.slope * (top - second) + self.offset, -700, 700))) >= least
        return np.where((top > 0) & sure, best, -1), top - second


def sentence_items(text: str | None) -> list[set[str]]:
    """The set of words of each sentence that has a word."""
    if not text:
        return []
    plain = unicodedata.normalize("NFKC", joined(text)).casefold()
    return [items for s in split_sentences(plain) if (items := set(word_runs(s)))]


def coded_texts(texts: list[str], known: dict[str, int]) -> tuple[list[bytes], list[bytes]]:
    """For each text the numbers of distinct words in its sentences (int32) and the codes of these words (uint64).

    The words are those of ``sentence_items``; all texts are cut up together.
    """
    known[SENTENCE_END] = 0
    tokens: list[str] = []
    ends = []
    for text in texts:
        plain = joined(text)
        plain = plain.lower() if plain.isascii() else unicodedata.normalize("NFKC", plain).casefold()
        tokens += marked_words(plain)
        tokens.append(SENTENCE_END)
        ends.append(len(tokens))
    codes = word_codes(tokens, known)
    sentence = np.cumsum(codes == 0)
    number, distinct = pd.factorize(codes)
    fresh = ~pd.Series(sentence * len(distinct) + number).duplicated().to_numpy() & (codes != 0)
    doc = np.searchsorted(np.array(ends), np.flatnonzero(fresh), side="right")
    codes, sentence = codes[fresh], sentence[fresh]
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(codes) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(codes)]).astype(np.int32)
    of_codes, of_sizes = (np.searchsorted(d, np.arange(len(texts) + 1)).tolist() for d in (doc, doc[first]))
    cut = lambda x, at: [x[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
    return cut(sizes, of_sizes), cut(codes, of_codes)


def coded_documents(documents: DataFrame) -> DataFrame:
    """Staged ``doc_id, sizes, codes``: how many words each sentence has, and 64-bit codes of these words.

    Texts are read and cut into words once; all later steps work on these arrays. Null texts and ids are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for frame in frames:
            weight = np.cumsum([len(t) for t in frame["text"]]) // CHUNK_CODES
            for part in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(weight)) + 1):
                rows = frame.iloc[part]
                sizes, codes = coded_texts(rows["text"].tolist(), known)
                yield pd.DataFrame({"doc_id": rows["doc_id"], "sizes": sizes, "codes": codes})
                if len(known) > 500_000:
                    known.clear()

    texts = spread(documents.select("doc_id", "text"), "doc_id").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return stage(texts.mapInPandas(run, _CODED), "sentences")


@dataclass
class Batch:
    """Some documents: rows, the document of each sentence, the sentence of each code."""

    rows: pd.DataFrame
    doc: np.ndarray
    sentence: np.ndarray
    codes: np.ndarray

    @property
    def sentences(self) -> int:
        return len(self.doc)


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[Batch]:
    """About ``CHUNK_CODES`` codes of whole documents at a time."""
    for frame in frames:
        weight = np.cumsum([len(c) // 8 for c in frame["codes"]]) // CHUNK_CODES
        for part in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(weight)) + 1):
            rows = frame.iloc[part]
            sizes = np.frombuffer(b"".join(rows["sizes"]), np.int32)
            doc = np.repeat(np.arange(len(rows)), [len(b) // 4 for b in rows["sizes"]])
            yield Batch(rows, doc, np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(b"".join(rows["codes"]), np.uint64))


#: The class of each sentence of a batch; the number of classes stands for none.
Labeller = Callable[[Batch], np.ndarray]


def _by_document(batch: Batch) -> np.ndarray:
    return batch.rows["label"].to_numpy(np.int64)[batch.doc]


def _by_rules(model: RuleModel) -> Labeller:
    def run(batch: Batch) -> np.ndarray:
        found = model.subjects(batch.sentence, batch.codes, batch.sentences, 0.0)[0]  # any rule counts; the next round judges it
        return np.where(found >= 0, found, len(model.classes))

    return run


def _labelled(coded: DataFrame, labels: DataFrame, classes: list[str]) -> DataFrame:
    """The documents with exactly one known subject, and its place among the classes."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("subject")) - 1
    known = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").select("doc_id", place.cast("bigint").alias("label")).where("label >= 0")
    clear = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).where("label = _other").drop("_other")
    return stage(coded.join(broadcast_if_small(clear), "doc_id"), "labelled")


def _mine(coded: DataFrame, labeller: Labeller, classes: list[str], rules: SubjectRules) -> tuple[RuleModel, DataFrame]:
    """Frequent words, then frequent pairs of them, each with its classes; sums of counts all over.

    Also gives the counts ``word, label, n``.
    """
    none = len(classes)

    def count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(frames):
            label = labeller(batch)
            at, words = pd.factorize(batch.codes)
            n = np.bincount(at * (none + 1) + label[batch.sentence], minlength=1)
            some = np.flatnonzero(n)
            of_class = np.bincount(label, minlength=none + 1)
            yield pd.DataFrame({
                "word": np.r_[words[some // (none + 1)].astype(np.int64), np.full(none + 1, -1)] if len(words) else np.full(none + 1, -1),
                "label": np.r_[some % (none + 1), np.arange(none + 1)] if len(words) else np.arange(none + 1),
                "n": np.r_[n[some], of_class] if len(words) else of_class,
            })

    counted = stage(coded.mapInPandas(count_words, "word bigint, label bigint, n bigint").groupBy("word", "label").agg(F.sum("n").alias("n")), "words")
    of_class = np.zeros(none + 1, np.int64)
    for r in counted.where("word = -1").collect():  # a row per class
        of_class[r.label] = r.n
    total = int(of_class.sum())
    least = max(rules.least, rules.least_share * total)
    share = of_class / max(total, 1)
    bound = np.minimum(rules.lift * share, 0.5 + share / 2)  # a subject of most sentences can't be lifted far
    best = F.max(F.when(F.col("label") < none, F.struct("n", "label"))).alias("best")
    lifted = F.bool_or((F.col("label") < none) & (F.col("n") / F.col("of_word") >= F.element_at(F.array(*[F.lit(float(b)) for b in bound]), (F.col("label") + 1).cast("int"))))
    of_word = counted.where("word <> -1").groupBy("word").agg(F.sum("n").alias("of_word")).where(F.col("of_word") >= least)
    telling = counted.join(of_word, "word").groupBy("word").agg(F.first("of_word").alias("of_word"), best, lifted.alias("lifted")).where("lifted").select("word", "of_word", "best.*").toPandas()  # at most (words in a sentence / least_share) rows
    telling = telling.sort_values("word")
    words = telling["word"].to_numpy(np.uint64)
    support = {(int(w),): int(n) for w, n in zip(words, telling["of_word"], strict=True)}
    joint = {(int(w),): (int(c), int(n)) for w, c, n in zip(words, telling["label"], telling["n"], strict=True) if n >= least}

    def count_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Counts()
        for batch in _batches(frames):
            hit, at = _find(words, batch.codes)
            if not len(hit):
                continue
            label = labeller(batch)
            for a, b, where in _together(batch.sentence[hit], at):
                held.add((a * len(words) + b) * (none + 1) + label[where])
            if len(held) > CHUNK_CODES:
                yield held.rows(none + 1)
                held = _Counts()
        yield held.rows(none + 1)

    if rules.words > 1 and len(words):
        met = coded.mapInPandas(count_pairs, "pair bigint, label bigint, n bigint").groupBy("pair", "label").agg(F.sum("n").alias("n"))
        frequent = met.groupBy("pair").agg(F.sum("n").alias("of_pair"), best).where((F.col("of_pair") >= least) & (F.col("best.n") >= least)).select("pair", "of_pair", "best.*").toPandas()
        for pair, of_pair, n, c in frequent.itertuples(index=False):
            key = (int(words[pair // len(words)]), int(words[pair % len(words)]))
            support[key], joint[key] = int(of_pair), (int(c), int(n))
    return _prune(support, joint, classes, rules), counted


def _prune(support: dict, joint: dict, classes: list[str], rules: SubjectRules) -> RuleModel:
    """Keep the confident rules that no shorter rule of the same class makes redundant."""
    sure: dict[tuple[int, ...], tuple[int, float]] = {}
    for words in sorted(joint, key=lambda w: (len(w), w)):
        label, n = joint[words]
        p = (n + 0.1) / (support[words] + 1.0)
        if p < rules.confidence:
            continue
        shorter = [sure[(w,)] for w in words if len(words) > 1 and (w,) in sure]
        if any(c == label and q >= p - rules.gain for c, q in shorter):
            continue
        sure[words] = (label, p)
    weight = {w: (c, float(np.log(p / (1 - p))) + 0.05) for w, (c, p) in sure.items()}
    return RuleModel(classes, {w[0]: v for w, v in weight.items() if len(w) == 1}, {w: v for w, v in weight.items() if len(w) == 2})


def _calibrate(model: RuleModel, labelled: DataFrame) -> RuleModel:
    """Fit probability = logistic(slope * margin + offset) on a histogram of margins.

    The probability is net of label noise: a document's label that is wrong or holds for only
    some of its sentences lowers the hits of certain sentences as well.
    """

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(frames):
            best, margin = model.subjects(batch.sentence, batch.codes, batch.sentences, -1.0)
            some = best >= 0
            yield pd.DataFrame({"margin": margin[some].round(1), "right": (best == _by_document(batch))[some].astype(np.int64)})

    bins = labelled.mapInPandas(score, "margin double, right bigint").groupBy("margin").agg(F.sum("right").alias("right"), F.count(F.lit(1)).alias("n")).toPandas()
    if bins.empty:
        return model
    bins = bins.sort_values("margin")
    x, k, n = bins["margin"].to_numpy(), bins["right"].to_numpy() + 0.0, bins["n"].to_numpy() + 0.0
    upper = np.cumsum(n[::-1])[::-1] <= n.sum() / 2 + n[-1]  # the more certain half shows how far the labels hold at all
    ceiling = max(k[upper].sum() / n[upper].sum(), 0.5)
    model.slope, model.offset = _logistic(x, np.minimum(k / ceiling, n), n)
    return model


def _logistic(x: np.ndarray, k: np.ndarray, n: np.ndarray, prior: float = 20.0) -> tuple[float, float]:
    """Slope (positive) and offset for k of n at x, drawn to 1 and 0 with the weight of ``prior``."""
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((n * np.logaddexp(0, z) - k * z).sum() + prior * ((a - 1) ** 2 + b * b) / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((k - n * p) * x).sum() - prior * (a - 1), (k - n * p).sum() - prior * b])
        w = n * p * (1 - p)
        h = np.array([[(w * x * x).sum() + prior, (w * x).sum()], [(w * x).sum(), w.sum() + prior]])
        step, now = np.linalg.solve(h, g), loss(a, b)
        while np.abs(step).max() > 1e-9 and loss(a + step[0], b + step[1]) > now:
            step /= 2
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def _described(texts: dict[str, str], classes: list[str]) -> dict[int, tuple[int, float]]:
    """Weak rules of the words that only one subject's name or description has, for words no label tells about."""
    own = {c: set().union(*sentence_items(f"{c.replace('_', ' ')} {texts[c]}")) for c in classes}
    rules = {}
    for place, c in enumerate(classes):
        for w in own[c]:
            if sum(w in other for other in own.values()) == 1:
                rules[int(word_codes([w], {})[0])] = (place, 0.1)
    return rules


def fit_subjects(coded: DataFrame, labels: DataFrame, subjects: DataFrame, rules: SubjectRules | None = None) -> RuleModel:
    """Mine, prune and calibrate the rules from ``coded_documents``; without usable labels there are none.

    The subjects are a stated list; each is a column of the counts.
    """
    rules = rules or SubjectRules()
    told = subjects.where("subject IS NOT NULL").groupBy("subject").agg(F.concat_ws(" ", F.collect_set("description")).alias("description")) if "description" in subjects.columns else subjects.where("subject IS NOT NULL").select("subject", F.lit("").alias("description")).distinct()
    described = {r.subject: r.description for r in told.toLocalIterator()}
    classes = sorted(described)
    if not classes:
        return RuleModel(classes)
    labelled = _labelled(coded, labels, classes)
    if labelled.isEmpty():
        return RuleModel(classes)
    mined, counted = _mine(labelled, _by_document, classes, rules)
    model = _calibrate(mined, labelled)
    weak = _described(described, classes)
    known = counted.where(F.col("word").isin(list(weak))).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rules.least)
    for r in known.collect():  # the labels have judged these words of the descriptions
        del weak[r.word]
    model = RuleModel(classes, {**weak, **model.single}, model.pairs, model.slope, model.offset)
    for _ in range(rules.rounds - 1):
        model = _calibrate(_mine(coded, _by_rules(model), classes, rules)[0], labelled)
    return model


def subject_shares(coded: DataFrame, model: RuleModel, rules: SubjectRules | None = None) -> DataFrame:
    """``doc_id, subject, treating, sentences`` for each subject some sentence treats."""
    rules = rules or SubjectRules()

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = max(len(model.classes), 1)
        names = np.array([*model.classes, None], object)
        for batch in _batches(frames):
            best = model.subjects(batch.sentence, batch.codes, batch.sentences, rules.probability)[0]
            some = best >= 0
            held = np.bincount(batch.doc[some] * k + best[some], minlength=len(batch.rows) * k)
            at = np.flatnonzero(held)
            size = np.bincount(batch.doc, minlength=len(batch.rows))
            yield pd.DataFrame({"doc_id": batch.rows["doc_id"].to_numpy()[at // k], "subject": names[at % k], "treating": held[at], "sentences": size[at // k]})

    return coded.mapInPandas(score, "doc_id bigint, subject string, treating bigint, sentences bigint")


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rules: SubjectRules | None = None) -> DataFrame:
    """``doc_id, subject``: each subject that at least ``share`` of the document's sentences treat.

    Null, empty and contentless texts have none; a repeated document row changes nothing;
    labels that are null, unknown or name an absent document are ignored.
    """
    rules = rules or SubjectRules()
    coded = coded_documents(documents)
    model = fit_subjects(coded, labels, subjects, rules)
    shares = subject_shares(coded, model, rules)
    return shares.where(F.col("treating") >= rules.share * F.col("sentences")).select("doc_id", "subject").distinct()
