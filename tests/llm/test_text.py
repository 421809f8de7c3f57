"""Packing, leakage and subjects: round trips, brute force and held-out accuracy."""

import numpy as np
import pytest

from nearpass.llm.leakage import LeakRules, _edits, cgk_keys, leaked_items, word_codes
from nearpass.llm.packing import PackRules, pack_documents, pack_sizes, packed_corpus, tier_of, token_counts, utilisation, with_step_groups
from nearpass.llm.subjects import SubjectRules, coded_documents, coded_texts, document_subjects, fit_subjects, sentence_items
from nearpass.llm.words import split_sentences, words

DOCS = "doc_id long, text string, edits string, part long"


def test_words():
    assert words("Gavr-\naxa is­n't ﬁne​ly STRASSE ½x_y") == ["gavraxa", "isn", "t", "finely", "strasse", "1", "2x", "y"]
    assert words("semi-major a-\r\nxis") == ["semi", "major", "axis"]
    assert words(None) == words("") == words(" ... ") == []
    assert split_sentences("One is 2.5 long. Two? ¿Tres!  Rest\n\nnext") == ["One is 2.5 long.", "Two?", "¿Tres!", "Rest", "next"]
    assert len(sentence_items("A b. ... C?")) == 2


def test_texts_cut_up_together_are_those_cut_up_alone():
    texts = ["One is 2.5 long. Two one! ...\n\nTwo two?", "", "...", "Gavr-\naxa isn't ﬁne. STRASSE\x00 straße", "x" * 100_000, "a. " * 1000, "¿Qué? ¡Sí!"]
    sizes, codes = coded_texts(texts, {})
    for text, size, code in zip(texts, sizes, codes, strict=True):
        items = sentence_items(text)
        assert np.frombuffer(size, np.int32).tolist() == [len(i) for i in items]
        at = np.r_[0, np.cumsum(np.frombuffer(size, np.int32))].astype(int)
        mine = np.frombuffer(code, np.uint64)
        assert [sorted(mine[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)] == [sorted(word_codes(sorted(i), {}).tolist()) for i in items]
    assert coded_texts([], {}) == ([], [])


# packing


def test_pack_sizes_never_overflow_and_hold_everything():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 101, 5000)
    found = pack_sizes(sizes, 100)
    assert sorted(i for c in found for i in c) == list(range(5000))
    assert max(sizes[c].sum() for c in found) <= 100
    assert sizes.sum() / (100 * len(found)) > 0.99
    assert pack_sizes(np.array([], dtype=int), 10) == []


def test_tiers_decide_who_fills_a_gap():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 101, 2000)
    assert tier_of(np.array([100, 51, 50, 26, 25, 1]), 100, 3).tolist() == [0, 0, 1, 1, 2, 2]
    tiered, flat = pack_sizes(sizes, 100, 6), pack_sizes(sizes, 100, 1)
    assert sorted(map(tuple, tiered)) != sorted(map(tuple, flat)) and len(tiered) <= len(flat) + 2
    tier = tier_of(sizes, 100, 6)
    assert all(tier[c[0]] == tier[c].min() for c in tiered)  # the opener is of the longest tier in it
    # 60 and 55 open; the tighter gap (40) takes the 38 first, then the 45 goes to the 55
    assert sorted(sorted(c) for c in pack_sizes(np.array([60, 55, 38, 45]), 100, 2)) == [[0, 2], [1, 3]]


def test_step_groups_are_even(spark):
    work = np.random.default_rng(1).exponential(1.0, 323)
    rows = [(c, f"{c}-{k}", float(w), "clash") for c in (10, 20) for k, w in enumerate(work)]
    out = with_step_groups(spark.createDataFrame(rows, "capacity_tokens long, container string, work double, pieces string").repartition(5), 8).toPandas()
    for _, mine in out.groupby("capacity_tokens"):
        of_group = mine.groupby("step_group").work.agg(["sum", "size"])
        assert len(mine) == 323 and set(of_group["size"]) <= {7, 8} and of_group["sum"].max() / of_group["sum"].min() < 2.0


def test_packing_round_trip_with_long_documents_and_dirt(spark):
    counts = spark.createDataFrame([(i, int(n)) for i, n in enumerate(np.random.default_rng(2).integers(1, 900, 700))] + [(9000, 5000)], "doc_id long, n_tokens long")
    capacities = spark.createDataFrame([(1, 512), (2, 2048), (3, 2048), (4, None), (5, 0)], "capacity_id int, capacity_tokens int")
    packed = pack_documents(counts, capacities, PackRules(shard_rows=300)).toPandas()
    sizes = dict(map(tuple, counts.collect()))
    for capacity, rows in packed.groupby("capacity_tokens"):
        assert (rows.groupby("doc_id").n_tokens.sum().to_dict()) == sizes
        assert rows.groupby("container").n_tokens.sum().max() <= capacity
        parts = rows.groupby("doc_id").size()
        assert all(parts[d] == -(-n // capacity) for d, n in sizes.items())
        for _, c in rows.groupby("container"):
            c = c.sort_values("position")
            assert (c.position.to_numpy() == np.r_[0, np.cumsum(c.n_tokens)[:-1]]).all()
        long = rows[rows.doc_id == 9000].sort_values("part")
        assert (long.start_token.to_numpy() == long.part.to_numpy() * capacity).all()
    assert set(packed.capacity_tokens) == {512, 2048}
    used = {r.capacity_tokens: r.used for r in utilisation(spark.createDataFrame(packed)).collect()}
    assert min(used.values()) > 0.9


def test_token_counts_of_whole_texts(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    model.encode_special_tokens = True
    rows = [(1, "alpha <|endoftext|> beta", "", 0), (2, None, "", 0), (3, "", "", 0), (4, "word " * 50_000, "", 0), (5, "alpha <|endoftext|> beta", "", 0), (1, "alpha <|endoftext|> beta", "", 0), (None, "x", "", 0)]
    got = dict(map(tuple, token_counts(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == {i: len(model.encode(t, add_special_tokens=False).ids) for i, t in ((1, rows[0][1]), (4, rows[3][1]), (5, rows[4][1]))}
    none = spark.createDataFrame([], DOCS)
    capacities = spark.createDataFrame([(1, 512)], "capacity_id int, capacity_tokens int")
    assert packed_corpus(none, capacities).count() == 0


# leakage


ITEMS = "item_id long, passage string, text string"
VOCAB = [f"w{i}" for i in range(60)]


def leaks(spark, docs, items, rules=None, **how):
    out = leaked_items(spark.createDataFrame([(*d, "", 0) for d in docs], DOCS), spark.createDataFrame([(*i, "clash") for i in items], ITEMS), rules, **how)
    return {(r.doc_id, r.item_id): r.edits for r in out.collect()}


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(6)
    items = [(i, " ".join(rng.choice(VOCAB, 40))) for i in range(12)]
    items.append((50, items[0][1][:400]))  # shares its words with another item
    docs = []
    for d in range(80):
        w = list(rng.choice(VOCAB, 120))
        for _ in range(d % 3):
            i, at, n = rng.integers(0, 12), rng.integers(0, 25), rng.integers(9, 16)
            w[int(at) : int(at)] = items[i][1].split()[at : at + n]
        docs.append((d, ", ".join(w)))
    docs += [(200, None), (201, ""), (202, "short"), (None, items[0][1]), (0, docs[0][1])]
    grams = lambda t: {tuple(words(t)[k : k + 12]) for k in range(len(words(t)) - 11)}
    expect = {(d, i) for d, t in docs for i, p in items if d is not None and grams(t) & grams(p)}
    got = leaks(spark, docs, items + [(60, None), (61, "too short"), (None, items[0][1]), items[1]])
    assert set(got) == expect and set(got.values()) == {0}
    assert leaks(spark, docs, items, broadcast_windows=0) == got
    near = LeakRules(max_edits=1)
    assert leaks(spark, docs, items, near) == leaks(spark, docs, items, near, broadcast_windows=0)
    assert leaks(spark, [], items) == {} and leaks(spark, docs, []) == {}


def test_two_passages_of_one_item(spark):
    a, b = " ".join(VOCAB[:15]), " ".join(VOCAB[20:35])
    assert set(leaks(spark, [(1, a), (2, b)], [(7, a), (7, b)])) == {(1, 7), (2, 7)}


def test_near_leaks_reach_the_target_recall(spark):
    """Against all windows within one edit (a word dropped inside costs a second one at the end)."""
    rng = np.random.default_rng(8)
    vocab = np.array([f"v{i}" for i in range(5000)])
    items = [(i, " ".join(rng.choice(vocab, 14))) for i in range(150)]
    docs = []
    for i, p in items:
        w = p.split()
        at = int(rng.integers(2, 11))
        w[at : at + int(i % 3 != 2)] = [] if i % 3 == 1 else ["other"]
        docs.append((i, " ".join([*rng.choice(vocab, 20), *w, *rng.choice(vocab, 20)])))
    for k, least in ((1, 40), (2, 140)):
        near = lambda a, b, k=k: min(_edits(a[x : x + 12], b[y : y + 12], k) for x in range(len(a) - 11) for y in range(len(b) - 11))
        expect = {(i, i): e for (i, t), (_, p) in zip(docs, items, strict=True) if (e := near(words(t), words(p))) <= k}
        got = leaks(spark, docs, items, LeakRules(max_edits=k, recall=0.95))
        assert len(expect) >= least and set(got) <= set(expect)
        assert len(got) / len(expect) >= 0.95


def test_equal_windows_share_every_key():
    codes = word_codes(VOCAB[:20] + VOCAB[:20], {})
    for r in range(3):
        keys = cgk_keys(codes, np.array([0, 20, 5]), LeakRules(max_edits=2), r)
        assert keys[0] == keys[1] != keys[2]


# subjects


TERMS = {"sky": ["parallax", "centroid", "proper motion", "reference frame"], "code": ["unit test", "merge request", "stack trace", "lint rule"], "law": ["patent grant", "copyright notice", "embargo period", "data policy"]}


def corpus(n, seed, noise=0.0):
    rng = np.random.default_rng(seed)
    docs, truth, labels = [], {}, []
    for d in range(n):
        chosen = list(rng.choice(list(TERMS), rng.integers(0, 3), replace=False))
        sentences = []
        for s in chosen:
            sentences += [f"In practice we checked the {a} against the {b} again." for a, b in (rng.choice(TERMS[s], 2, replace=False) for _ in range(4))]
        other = [t for t in TERMS if t not in chosen]
        if len(chosen) == 2:
            sentences.append(f"By contrast the {TERMS[other[0]][0]} was revised.")  # a passing mention
        if not chosen:
            sentences = ["Thanks for the comments.", "See the notes below."]
        docs.append((d, " ".join(rng.permutation(sentences)), "", 0))
        truth[d] = set(chosen)
        given = set(chosen) if rng.random() >= noise else {str(rng.choice(list(TERMS)))}
        labels += [(d, s) for s in given]
    return docs, truth, labels


def test_subjects_on_held_out_documents(spark):
    docs, truth, labels = corpus(240, 0, noise=0.05)
    labels = [x for x in labels if x[0] < 120] + [(3, None), (4, "unknown"), (99999, "sky"), (None, "law")]
    docs += [(500, None, "", 0), (501, "", "", 0), (502, "...", "", 0), (503, docs[200][1], "", 0), docs[0]]
    subjects = spark.createDataFrame([(s, "") for s in TERMS], "subject string, description string")
    out = document_subjects(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, subject string"), subjects)
    found = out.toPandas()
    assert not found.duplicated().any()
    by = found.groupby("doc_id").subject.apply(set).to_dict()
    assert not {500, 501, 502} & set(by)
    assert by.get(503, set()) == by.get(200, set())
    hidden = range(120, 240)
    right = sum(len(by.get(d, set()) & truth[d]) for d in hidden)
    assert right / sum(len(truth[d]) for d in hidden) > 0.95
    assert right / sum(len(by.get(d, set())) for d in hidden) > 0.95


def test_subjects_without_labels(spark):
    docs, _, _ = corpus(10, 1)
    subjects = spark.createDataFrame([("sky", "")], "subject string, description string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    frame = spark.createDataFrame(docs, DOCS)
    assert document_subjects(frame, none, subjects).count() == 0
    assert document_subjects(spark.createDataFrame([], DOCS), none, subjects).count() == 0


def test_a_pair_of_words_rules_where_single_words_cannot(spark):
    """``prior``/``mass`` occur under both subjects; only their pairing tells them apart."""
    rows = []
    for k in range(60):
        rows += [(2 * k, "The prior of density was fixed. " * 3, "", 0), (2 * k + 1, "The prior of clock was fixed. " * 3, "", 0)]
    labels = [(d, "a" if d % 2 == 0 else "b") for d, *_ in rows]
    subjects = spark.createDataFrame([("a", ""), ("b", "")], "subject string, description string")
    model = fit_subjects(coded_documents(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(labels, "doc_id long, subject string"), subjects, SubjectRules(lift=1.5))
    code = lambda *w: tuple(int(c) for c in word_codes(list(w), {}))
    assert model.single[code("density")[0]][0] == 0 and model.single[code("clock")[0]][0] == 1 and code("prior")[0] not in model.single
    best, _ = model.subjects(np.array([0, 0, 0, 1, 1]), word_codes(["a", "prior", "density", "the", "clock"], {}), 2, 0.5)
    assert best.tolist() == [0, 1]


def test_two_words_that_rule_only_together(spark):
    rows = []
    for k in range(60):
        rows += [(4 * k + i, f"{x} {y} w{k % 9}. " * 2, "", 0) for i, (x, y) in enumerate((("red", "one"), ("blue", "two"), ("red", "two"), ("blue", "one")))]
    labels = [(d, "a" if d % 4 < 2 else "b") for d, *_ in rows]
    subjects = spark.createDataFrame([("a", ""), ("b", "")], "subject string, description string")
    coded = coded_documents(spark.createDataFrame(rows, DOCS))
    model = fit_subjects(coded, spark.createDataFrame(labels, "doc_id long, subject string"), subjects, SubjectRules(lift=0.9))
    assert not model.single and len(model.pairs) == 4
    best, _ = model.subjects(np.array([0, 0, 1, 1]), word_codes(["red", "one", "two", "red"], {}), 2, 0.5)
    assert best.tolist() == [0, 1]


def test_very_long_texts(spark):
    """A passage at the end of 200,000 words is found, and its sentences count as any other."""
    passage = " ".join(VOCAB[:15])
    text = "filler word " * 100_000 + passage
    assert set(leaks(spark, [(1, text), (2, "x" * 1_000_000)], [(7, passage)])) == {(1, 7)}
    docs, _, labels = corpus(120, 3)
    docs.append((900, "We checked the unit test against the lint rule. " * 20_000, "", 0))
    subjects = spark.createDataFrame([(s, "") for s in TERMS], "subject string, description string")
    out = document_subjects(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, subject string"), subjects)
    assert [r.subject for r in out.where("doc_id = 900").collect()] == ["code"]
