import numpy as np
import pytest

from mercanta.llm import mixing


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_flight_keeps_the_totals(n):
    rng = np.random.default_rng(n)
    tokens = rng.integers(1, 3000, n)
    p = rng.random(n)
    out = mixing.flight(tokens, p, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert np.isclose(out.sum(), p.sum()) and np.isclose((out * tokens).sum(), (p * tokens).sum())
    landed = mixing.landing(tokens, out)
    assert set(np.unique(landed)) <= {0.0, 1.0}


def test_equal_sizes_and_probabilities():
    out = mixing.flight(np.full(1000, 7), np.full(1000, 0.25), np.random.default_rng(1))
    assert abs(out.sum() - 250) < 1e-6 and ((out > 0) & (out < 1)).sum() <= 2


def test_inclusion_probabilities_are_kept():
    tokens = np.array([1, 5, 9, 14, 30, 31, 47, 80])
    p = np.array([0.1, 0.3, 0.5, 0.5, 0.7, 0.9, 0.2, 0.4])
    runs = [mixing.flight(tokens, p, np.random.default_rng(i)) for i in range(2000)]  # the landing of the last two goes for the totals instead
    assert np.abs(np.mean(runs, axis=0) - p).max() < 0.06


def _texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string")


def test_shares_and_caps(spark):
    rng = np.random.default_rng(3)
    rows = [(i, s, "palavra " * int(rng.integers(1, 200)), "x") for i, s in enumerate(["big"] * 3000 + ["mid"] * 800 + ["small"] * 60)]
    rows += [(9001, "other", "fora", "x"), (9002, None, "fora", "x"), (9003, "big", "", "x"), (9004, "big", None, "x"), (0, "big", rows[0][2], "x")]
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid", 0.4, 2), ("m", "small", 0.1, 4), ("m", "absent", 0.0, 1), ("n", "small", 1.0, 3), ("n", "ghost", 0.5, 2)], "mixture_name string, source string, target_share double, max_repeats int")
    chosen, planned = mixing.mix(_texts(spark, rows).repartition(6), targets)
    shares = {(r.mixture_name, r.source): r for r in mixing.reached_shares(chosen, planned).collect()}
    for s, want in (("big", 0.5), ("mid", 0.4), ("small", 0.1)):
        assert abs(shares["m", s].reached_share - want) < 0.003
    assert all(r.most_copies <= r.max_repeats for r in shares.values())
    assert shares["n", "ghost"].reached_share == 0 and shares["n", "small"].reached_share == 1
    ids = {r.doc_id for r in chosen.collect()}
    assert not ids & {9001, 9002, 9003, 9004}


def test_empty(spark):
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mixture_name string, source string, target_share double, max_repeats int")
    chosen, planned = mixing.mix(_texts(spark, []), targets)
    assert chosen.count() == 0
    assert [(r.reached_share, r.used_tokens) for r in mixing.reached_shares(chosen, planned).collect()] == [(0.0, 0)]


def test_exchanges_bring_the_tokens_nearer():
    rng = np.random.default_rng(3)
    for _ in range(50):
        tokens = rng.integers(1, 3000, 40)
        p = (rng.random(40) < 0.5).astype(float)
        want = float((p * tokens).sum()) + float(rng.integers(-2500, 2500))
        out = mixing.exchanged(tokens, p, want)
        assert set(np.unique(out)) <= {0.0, 1.0}
        assert abs(want - (out * tokens).sum()) <= abs(want - (p * tokens).sum())
    assert mixing.exchanged(np.array([5, 7]), np.array([1.0, 1.0]), 6.0).tolist() == [0.0, 1.0]
    assert mixing.exchanged(np.array([], dtype=int), np.array([]), 3.0).tolist() == []
    near = mixing.exchanged(np.arange(1, 101), np.repeat([0.0, 1.0], 50), 3000.0)
    assert abs((near * np.arange(1, 101)).sum() - 3000) <= 1
