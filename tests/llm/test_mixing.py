import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import mixing
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no vocabulary files")


@given(st.text(alphabet="ab \n\t'.,1ä中🙂", max_size=60))
@settings(max_examples=200, deadline=None)
def test_counts_equal_the_tokenizer(text):
    c = mixing._counter(mixing.TOKENIZER)
    assert c.count(text) == len(c._encode(text)) if text else True


@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 1000), st.integers(1, 9), st.integers(0, 4)), min_size=1))
@settings(max_examples=200, deadline=None)
def test_weights_respect_limits_and_use_the_budget(spec):
    tokens = {s: t for s, (t, _, _) in spec.items()}
    share = sum(x for _, x, _ in spec.values())
    plans = mixing.weights(tokens, {s: (x / share, r) for s, (_, x, r) in spec.items()})
    budget = sum(tokens.values())
    for p in plans:
        assert p.weight * budget <= p.tokens * p.max_repeat * (1 + 1e-6) + 1e-6
        if not p.reachable and budget:
            assert abs(p.weight * budget - p.tokens * p.max_repeat) < 1e-6
    assert sum(p.weight for p in plans) <= 1 + 1e-9
    if budget and all(r >= 1 for _, _, r in spec.values()):
        assert abs(sum(p.weight for p in plans) - 1) < 1e-6


def test_reachable_targets_are_met_exactly():
    plans = mixing.weights({"a": 900, "b": 100}, {"a": (0.7, 1), "b": (0.3, 4)})
    assert [round(p.weight, 9) for p in plans] == [0.7, 0.3] and all(p.reachable for p in plans)


def test_an_unreachable_source_gives_all_it_has():
    plans = {p.source: p for p in mixing.weights({"a": 900, "b": 100}, {"a": (0.5, 1), "b": (0.4, 2), "none": (0.1, 9)})}
    assert not plans["b"].reachable and plans["b"].weight == 0.2 and not plans["none"].reachable and plans["none"].weight == 0
    assert abs(plans["a"].weight - 0.8) < 1e-9


def test_mixture_fills_the_budget(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["big"] * 8 + ["small", "tiny"]), "word " * rng.randrange(1, 60), "x") for i in range(900)]
    docs += docs[:50] + [(5000, None, "word", "x"), (None, "big", "word", "x"), (5001, "big", None, "x"), (5002, "unlisted", "word", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, src string, text string, tokens string")
    sizes = mixing.sized(df, "doc_id", "src", "text")
    assert sizes.count() == 902
    targets = {"big": (0.5, 1), "small": (0.3, 5), "tiny": (0.2, 1)}
    plans = mixing.plan(sizes, targets)
    mix = mixing.realise(sizes, plans)
    out = {r.source: r for r in mixing.shares(mix, plans).collect()}
    limits = {s: r for s, (_, r) in targets.items()}
    longest = max(r.tokens for r in sizes.collect())
    total = sum(r.tokens for r in sizes.collect())
    for p in plans:
        r = out[p.source]
        assert r.most_copies <= limits[p.source]
        assert -1e-6 <= p.weight * total - r.mixed_tokens <= longest
    assert rows(mix) == rows(mixing.realise(sizes, plans))  # the same for the same seed
    assert not out["tiny"].reachable and abs(sum(r.actual_share for r in out.values()) - 1) < 1e-9


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, text string")
    sizes = mixing.sized(df, "doc_id", "source", "text")
    plans = mixing.plan(sizes, {"a": (1.0, 2)})
    assert mixing.realise(sizes, plans).count() == 0 and rows(mixing.shares(mixing.realise(sizes, plans), plans).select("source", "actual_share")) == [("a", 0.0)]
    t = spark.createDataFrame([("a", None, 1), (None, 0.5, 1), ("b", 0.5, None), ("b", 0.5, None)], "source string, target_share double, max_repeat int")
    assert mixing.read_targets(t) == {"a": (0.0, 1), "b": (0.5, 0)}


def test_null_text_has_no_tokens(spark):
    df = spark.createDataFrame([(None,), ("",), ("one two",)], "t string")
    assert [r[0] for r in df.coalesce(1).select(mixing.n_tokens(F.col("t"))).collect()] == [0, 0, 2]
