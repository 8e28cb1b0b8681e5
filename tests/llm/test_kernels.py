"""Kernels against exhaustive search."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phasegrid.llm.bpe import Codec
from phasegrid.llm.embed_dedup import Code, code_words, list_decode, rotation
from phasegrid.llm.html_extract import main_text, min_cut
from phasegrid.llm.mixing import apportion
from phasegrid.llm.substring import sliding_min, window_hashes
from phasegrid.llm.tokens import words_of


@given(st.lists(st.floats(-5, 5), min_size=1, max_size=7), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_min_cut_is_minimal(scores, rnd):
    n = len(scores)
    edges = [(i, j, rnd.random() * 3) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.6]

    def cost(label):
        return sum(max(0.0, s) if not on else max(0.0, -s) for s, on in zip(scores, label)) + sum(w for i, j, w in edges if label[i] != label[j])

    assert cost(min_cut(scores, edges)) <= min(map(cost, itertools.product((False, True), repeat=n))) + 1e-6


def test_fixed_labels_pull_their_neighbours():
    assert min_cut([1e9, -0.5, -1e9, 0.5], [(0, 1, 2.0), (2, 3, 2.0)]) == [True, True, False, False]


@given(st.text(alphabet="<>/pa\"' =!-&;xdivscrt\n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(page):
    assert isinstance(main_text(page)[0], str)


CODEC = Codec(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), remember=50)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_bpe_decodes_to_the_text(text):
    assert CODEC.decode(CODEC.encode(text)) == text


@given(st.text(alphabet="abcdefgh ", min_size=1, max_size=14))
@settings(max_examples=100, deadline=None)
def test_bpe_merges_least_rank_first(text):
    sym = [CODEC.byte_id[b] for b in text.encode()]
    while len(sym) > 1:
        ranks = [(CODEC.rank.get(a << 32 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(sym, sym[1:]))]
        r, i = min(ranks)
        if r == 1 << 40:
            break
        sym[i : i + 2] = [CODEC.made[r]]
    assert CODEC.merge(text.encode()) == sym


def test_list_decoding_finds_all_filters():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((40, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    for code in (Code(codes=2, parts=2, codewords=9, height=1.5), Code(codes=1, parts=4, codewords=5, height=1.8), Code(codes=1, parts=1, codewords=30, height=1.2)):
        want = set()
        for k in range(code.codes):
            order, words = code_words(code, k, 24)
            t = (v @ rotation(code.seed, 24))[:, order]
            for f, choice in enumerate(itertools.product(range(code.codewords), repeat=code.parts)):
                c = np.concatenate([w[:, j] for w, j in zip(words, choice)])
                assert abs(np.linalg.norm(c) - 1) < 1e-9
                want |= {(int(i), k * code.codewords**code.parts + f) for i in np.flatnonzero(t @ c >= code.height / np.sqrt(24))}
        row, f = list_decode(v, code)
        assert set(zip(row.tolist(), f.tolist())) == want and len(row) == len(want)


def test_window_hashes_tell_windows_apart():
    random.seed(2)
    text = " ".join(random.choice("ab") for _ in range(400))
    words = words_of(pa.array([text]))
    for size in (1, 2, 3, 8, 13, 50):
        h = window_hashes(words, size, 23)
        w = text.split()
        naive = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        assert len(h) == len(naive) and len(set(zip(h.tolist(), naive))) == len(set(naive)) == len(set(h.tolist()))
    x = np.random.default_rng(0).integers(0, 99, 60)
    for size in (1, 2, 5, 43):
        assert sliding_min(x, size).tolist() == [x[i : i + size].min() for i in range(len(x) - size + 1)]


def test_words_are_those_of_the_pattern():
    import re

    texts = ["a b", None, "", " \x0b x\x85y  é\x1fz ", "\n", "tail "]
    w = words_of(pa.array(texts).slice(0))
    raw = w.data.tobytes()
    got = [[raw[a : a + n].decode() for a, n in zip(w.first[s:e], w.length[s:e])] for s, e in zip(w.doc[:-1], w.doc[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert words_of(pa.array(texts).slice(3, 2)).count == 2


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 101, 1234])
def test_apportionment_by_highest_quotients(spark, seats):
    votes = {"a": 340.5, "b": 0.0, "c": 12.25, "d": 99.0, "e": 98.0, "f": 1.5, "g": 3000.0}
    df = spark.createDataFrame([(k, v) for k, v in votes.items()], "k string, v double").withColumn("s", F.lit(seats))
    got = {r.k: r.q for r in apportion(df, [], ["k"], "v", "s", "q").collect()}
    want = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max((k for k in votes if votes[k]), key=lambda k: votes[k] / (2 * want[k] + 1))
        want[best] += 1
    assert got == want


def test_hot_anchors_by_bitmap(spark):
    from phasegrid.llm import substring

    anchors = [int(x) for x in np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)]
    hot, bits = substring._hot_map(spark.createDataFrame([(a,) for a in anchors[:1000]], "anchor long"))
    place = np.array(anchors) & (bits - 1)
    told = hot[place >> 3] >> (place & 7) & 1
    assert told[:1000].all() and told[1000:].mean() < 0.1
    assert not substring._hot_map(spark.createDataFrame([], "anchor long"))[0].any()
