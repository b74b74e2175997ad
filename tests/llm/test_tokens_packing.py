"""Token ids, decoding, and filling of containers."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import packing as P
from lumenfold.llm import tokens as T

NAME = "byte_bpe_50k"
TEXTS = ["", "plain words", "a\r\n\tb  c ", "naïve café é — 東京🚚", "<|endoftext|> is text", "x" * 3000, "​﻿\x00"]


@given(st.text(max_size=60))
@settings(max_examples=60, deadline=None)
def test_decoding_gives_any_text_back(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = T.encode_texts([text], NAME)[0]
    assert T.decode_ids(ids, NAME) == (text, 0, 0)
    starts, ends = T.token_offsets(ids, text, NAME)
    assert len(starts) == len(ids) and (not ids or (starts[0] == 0 and ends[-1] == len(text))) and starts == sorted(starts)


def test_cut_inside_a_character_leaves_out_its_bytes():
    ids = T.encode_texts(["ab🚚cd"], NAME)[0]
    for cut in range(1, len(ids)):
        a, _, tail = T.decode_ids(ids[:cut], NAME)
        b, head, _ = T.decode_ids(ids[cut:], NAME)
        assert "ab🚚cd".startswith(a) and "ab🚚cd".endswith(b) and (tail or head or a + b == "ab🚚cd")


def test_every_kind_of_tokenizer_loads():
    load = T.load
    assert load("byte_bpe_multi_50k")(["some text"]) and load("piece_bpe_32k")(["some text"]) and load("word_bpe_49k")(["some text"])
    with pytest.raises(FileNotFoundError):
        load("no_such_tokenizer")


def test_encode_table(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (90, None), (1, TEXTS[1])], "id int, text string").selectExpr("*", "'x' AS ids", "1 AS out")
    got = [(r.id, list(r.ids)) for r in T.encode(df, "id", "text", NAME).collect()]
    assert Counter(k for k, _ in got)[1] == 2 and dict(got)[90] == [] and dict(got)[0] == []
    assert 50256 not in dict(got)[4] and T.decode_ids(dict(got)[3], NAME)[0] == TEXTS[3]
    assert {r.id: r.n_tokens for r in T.encode(df, "id", "text", NAME, counts_only=True).collect()} == {k: len(v) for k, v in got}
    trip = {r.id: r.same for r in T.round_trip(df, "id", "text", NAME).collect()}
    assert trip[90] is None and all(v for k, v in trip.items() if k != 90)
    assert T.encode(df.limit(0), "id", "text", NAME).count() == 0


def check_plan(hist, capacity):
    plan = P.plan_packing(hist, capacity)
    load, items = Counter(), Counter()
    spans = Counter()
    for s, f, m, b, o in zip(plan.size, plan.first, plan.mult, plan.base, plan.offset):
        nxt = [x for t, x in zip(plan.size, plan.first) if t == s and x > f]
        n = (min(nxt) if nxt else hist[s]) - f
        items[s] += n
        for k in range(n):
            c = b + k // m
            load[c] += s
            spans[(c, o + k % m * s)] += 1
    assert items == Counter({s: int(hist[s]) for s in np.flatnonzero(hist)})
    assert not load or (max(load.values()) <= capacity and sorted(load) == list(range(plan.containers)))
    assert all(v == 1 for v in spans.values())
    return plan


@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([40, 64]))
@settings(max_examples=60, deadline=None)
def test_plans_are_valid(sizes, capacity):
    check_plan(np.bincount(np.array(sizes, dtype=int), minlength=capacity + 1), capacity)


def test_plan_is_tight():
    rng = np.random.default_rng(0)
    hist = np.bincount(rng.integers(1, 257, 20000), minlength=257)
    plan = check_plan(hist[:257], 256)
    assert plan.containers <= 1.01 * -(-int((np.arange(257) * hist).sum()) // 256)


def test_patterns_fill_the_container():
    b = np.array([1, 3, 4, 5, 8])
    p = P.patterns(b, 8)
    used = [tuple(sorted([b[i]] * m + ([b[j]] * n if j >= 0 else []) + ([b[k]] if k >= 0 else []))) for i, m, j, n, k in p.tolist()]
    assert all(sum(u) == 8 for u in used) and {(8,), (3, 5), (4, 4), (1, 3, 4), (1,) * 8, (1, 1, 1, 5)} <= set(used)


@pytest.mark.parametrize("capacity", [64, 300, 2000])
def test_fitted_patterns_place_most_items(capacity):
    rng = np.random.default_rng(3)
    hist = np.bincount(np.minimum(rng.lognormal(3.6, 0.9, 20000).astype(int) + 1, capacity), minlength=capacity + 1)
    plan = check_plan(hist, capacity)
    by = np.zeros(2)
    for s in np.unique(plan.size):
        mine = plan.size == s
        np.add.at(by, plan.fitted[mine], np.diff(np.r_[plan.first[mine], hist[s]]))
    assert by[1] >= 0.8 * by.sum()
    # items above half the capacity may need a container each
    bound = max(-(-int((np.arange(capacity + 1) * hist).sum()) // capacity), int(hist[capacity // 2 + 1:].sum()))
    assert plan.containers <= 1.02 * bound + 1


def test_documents_are_packed_whole(spark):
    docs = [(k, "word " * n) for k, n in enumerate([1, 5, 5, 5, 30, 64, 65, 200, 3, 3])] + [(50, None), (51, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    size = {k: len(T.encode_texts([t or ""], NAME)[0]) for k, t in docs}
    rows = P.pack_documents(df, "doc_id", "text", [(1, 64), (2, 300)], NAME).collect()
    for limit, capacity in ((1, 64), (2, 300)):
        mine = [r for r in rows if r.limit_id == limit]
        got = Counter()
        load = Counter()
        for r in mine:
            got[r.doc_id] += r.n_tokens
            load[r.container_id] += r.n_tokens
            assert r.start_token == r.piece * capacity
        assert got == Counter({k: n for k, n in size.items() if n})
        assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
        assert all(sum(r.doc_id == k for r in mine) == max(1, -(-n // capacity)) for k, n in size.items() if n)
    assert P.pack_documents(df.limit(0), "doc_id", "text", [(1, 64)], NAME).count() == 0


def test_ranks_have_no_gaps_across_buckets(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "IF(id % 3 = 0, 7, 9) AS n_tokens")
    rows = P.ranked_sizes(df, "doc_id", per_bucket=60).collect()
    for n in (7, 9):
        assert sorted(r["rank"] for r in rows if r.n_tokens == n) == list(range(sum(r.n_tokens == n for r in rows)))
