import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import kernels as K

TEXT = st.text(alphabet=st.sampled_from(list("abcXYZ019_ ,.-\n中文字é²ßİ𝔸㐀")), max_size=60)
WORD = re.compile(r"[一-鿿]|[^\W一-鿿]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_tokens_are_those_of_the_pattern(texts):
    t = K.Tokens(texts)
    joined = "\n".join(texts)
    found = [[joined[s:e] for s, e in zip(t.starts[a:b], t.ends[a:b])] for a, b in zip(t.bounds, t.bounds[1:])]
    assert found == [WORD.findall(x) for x in texts]
    flat = [w for x in found for w in x]
    assert len({int(h) for h in t.hashes}) == len(set(flat))


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.integers(1, 4))
def test_grams_stay_in_their_text(texts, k):
    t = K.Tokens(texts)
    g, b = t.grams(k)
    words = [WORD.findall(x) for x in texts]
    assert np.diff(b).tolist() == [max(len(w) - k + 1, 0) for w in words]
    names = [tuple(w[i : i + k]) for w in words for i in range(max(len(w) - k + 1, 0))]
    assert len(set(names)) == len({int(x) for x in g})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 30), max_size=25), min_size=1, max_size=5), st.integers(1, 6))
def test_winnow_keeps_a_minimum_of_each_window(lists, w):
    order = np.array([x for xs in lists for x in xs], np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    keep = K.winnow(order, bounds, w)
    for xs, s in zip(lists, bounds):
        got = set(np.flatnonzero(keep[s : s + len(xs)]).tolist())
        want = set()
        for i in range(max(len(xs) - w + 1, 1 if xs else 0)):
            part = xs[i : i + w]
            want |= {i + j for j, x in enumerate(part) if x == min(part)}
        assert got == want


def test_char_grams_and_long_texts():
    texts = ["abcdefgh", "", "xabcdefgx", "é" * 1_000_00]
    g, b = K.char_grams(texts, 5)
    assert np.diff(b).tolist() == [4, 0, 5, 99_996]
    assert set(g[:3].tolist()) <= set(g[b[2] : b[3]].tolist())
    assert len(set(g[b[3] :].tolist())) == 1
    assert list(K.pieces(["a" * 10, "b" * 50, "c"], limit=20)) == [(0, 1), (1, 2), (2, 3)] or list(K.pieces(["a"], 20)) == [(0, 1)]


def test_set_signature_ignores_order():
    t = K.Tokens(["a b c d a b c d", "a b c d a b c d x", "c d a b c d a b"])
    g, b = t.grams(3)
    v, b = K.distinct_per_text(g, b)
    x, y = K.set_signature(v, b)
    assert (x[0], y[0]) == (x[2], y[2]) and (x[0], y[0]) != (x[1], y[1])
