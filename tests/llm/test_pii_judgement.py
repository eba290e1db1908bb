"""The added spans of personal data: votes that say nothing give nothing, and the estimates are near the truth."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gatewarden.llm import pii


def spans_of(spark, texts, model=None):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = pii.with_spans(df, model or pii.train(df)).select("doc_id", pii.span_list(F.col("spans")).alias("s")).collect()
    return {r.doc_id: r.s for r in found}


@pytest.mark.parametrize("line", ["Licensed under the Apache License, as it is.", "They met near Eiffel Tower again.", "the article 12345678 of it", "see file a1b2c3d4e5f6g7h8i9/x"])
def test_one_pattern_of_votes_is_no_evidence(spark, line):
    assert set(spans_of(spark, [f"{k} texts. {line}" for k in range(40)]).values()) == {""}


def test_fixed_reliabilities_need_three_votes():
    for votes in itertools.product((-1, 0, 1), repeat=pii.LABELERS):
        p = pii.fixed_belief(votes)
        assert p < pii.LEAST or votes.count(1) >= 3
        if votes.count(1) >= 4 and -1 not in votes:
            assert p >= pii.LEAST
        w = pii.fixed_weights()
        odds = sum(a * b for a, b in zip(w, pii._features(list(votes), 1.0), strict=True))
        assert 1 / (1 + math.exp(-odds)) == pytest.approx(p)
    assert pii.beliefs([([0, 0, 0, 0, 1], 50.0)]) is None and pii.beliefs([]) is None


def test_estimates_are_near_the_truth():
    """Votes drawn from known reliabilities: the estimated P(yes) of a pattern against Bayes' rule with the true ones."""
    rng = random.Random(7)
    true = [(0.8, 0.05), (0.7, 0.1), (0.75, 0.1), (0.6, 0.05), (0.65, 0.15)]  # P(yes | true), P(yes | false); the rest is no or nothing
    chance = lambda k, side, v: (true[k][0 if side else 1] if v == 1 else (1 - true[k][0 if side else 1]) * (0.3 if side else 0.6) if v == -1 else (1 - true[k][0 if side else 1]) * (0.7 if side else 0.4))
    counts: dict = {}
    for _ in range(40000):
        side = rng.random() < 0.3
        pattern = tuple(rng.choices((-1, 0, 1), [chance(k, side, v) for v in (-1, 0, 1)])[0] for k in range(pii.LABELERS))
        counts[pattern] = counts.get(pattern, 0) + 1
    rows = [(list(p), float(n)) for p, n in sorted(counts.items())]
    got = pii.beliefs(rows)
    wrong = 0.0
    for (p, n), q in zip(rows, got, strict=True):
        odds = math.log(0.3 / 0.7) + sum(math.log(chance(k, True, v) / chance(k, False, v)) for k, v in enumerate(p))
        wrong += n * abs(q - 1 / (1 + math.exp(-odds)))
    assert wrong / 40000 < 0.03


def test_a_model_gives_the_same_spans_beside_other_rows(spark):
    texts = [f"password = 'a{k}B{k}c8d7e6f5g4h3i2j1' and call (212) 555-01{k:02d}. Dr. Anna Smith, 41, wrote." for k in range(30)] + ["Licensed under the Apache License"] * 9
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model = pii.train(df)
    whole = spans_of(spark, texts, model)
    assert spans_of(spark, texts[:1], model)[0] == whole[0] != ""
