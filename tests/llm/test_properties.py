"""Properties of the kernels on generated input."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from nearpass.llm.leakage import LeakIndex, LeakRules, _keyed
from nearpass.llm.nearest_time import XFastTrie
from nearpass.llm.packing import pack_sizes
from nearpass.llm.words import words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), max_size=60), st.lists(st.integers(0, 2**12 - 1), max_size=30))
def test_trie_against_a_scan(keys, asked):
    keys, asked = np.unique(np.array(keys, dtype=np.int64)), np.array(asked, dtype=np.int64)
    before, after = XFastTrie(keys, 8).neighbours(asked)
    for q, b, a in zip(asked, before, after, strict=True):
        mine = [k for k in keys if k >> 8 == q >> 8]
        assert (keys[b] if b >= 0 else None) == max((k for k in mine if k <= q), default=None)
        assert (keys[a] if a >= 0 else None) == min((k for k in mine if k >= q), default=None)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_packing_loses_nothing_and_fits(sizes):
    found = pack_sizes(np.array(sizes, dtype=int), 50)
    assert sorted(i for c in found for i in c) == list(range(len(sizes)))
    held = [sum(sizes[i] for i in c) for c in found]
    assert all(h <= 50 for h in held)
    assert sum(1 for h in held if h <= 25) <= 1  # two half-empty containers would have been one


def index(passage, rules):
    rows = pd.concat([pd.DataFrame(columns=["key", "print", "id", "words"]), *_keyed("item_id", "passage", rules)(iter([pd.DataFrame({"item_id": [1], "passage": [passage]})]))])
    return LeakIndex(rows["key"].to_numpy(np.int64), rows["print"].to_numpy(np.int64), rows["id"].to_numpy(np.int64), rows["words"].to_numpy(object), rules)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), min_size=4, max_size=12))
def test_equal_windows_are_always_found(text, passage):
    rules = LeakRules(window=4)
    grams = lambda t: {tuple(t[k : k + 4]) for k in range(len(t) - 3)}
    found = index(" ".join(passage), rules).leaks([text, []], {})
    assert found == [{1: 0} if grams(text) & grams(passage) else {}, {}]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_words_are_stable(text):
    assert words(" ".join(words(text))) == words(text) or any(w != w.casefold() for w in words(text))
