import random

import numpy as np
from pyspark.sql import functions as F

from mercanta.operators import spikes

SCHEMA = "table_name string, id string, field_name string, source string, series string, at long, value double, sticky boolean"


def _rows(series, values, sticky=True, source="s"):
    return [("t", f"{series}-{i}", "f", source, series, i, v, sticky) for i, v in enumerate(values)]


def _normal(rnd, n, level=100.0):
    return [round(level * float(np.exp(rnd.gauss(0, 0.01))), 2) for _ in range(n)]


def _flags(spark, rows):
    return {r.id: r.flag for r in spikes.implausible(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_kinds_of_flags(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(40):
        rows += _rows(f"n{k}", _normal(rnd, 30))
    one, two, three, stuck, bounds, short = (_normal(rnd, 30) for _ in range(6))
    one[10] = 150.0
    two[10:12] = [40.0, 41.0]
    three[10:13] = [150.0, 151.0, 149.0]
    stuck[8:17] = [100.0] * 9
    bounds[5], bounds[6] = 0.01, 1_000_000.0
    short = [100.0, 300.0, 100.5, 101.0]
    for name, values in (("one", one), ("two", two), ("three", three), ("stuck", stuck), ("bounds", bounds), ("short", short)):
        rows += _rows(name, values)
    found = _flags(spark, rows)
    assert found == {"one-10": "spike", "two-10": "spike", "two-11": "spike", **{f"stuck-{i}": "stuck" for i in range(8, 17)}, "bounds-5": "out_of_range", "bounds-6": "out_of_range"}


def test_long_series_spans_partitions(spark):
    """A series that holds most rows, cut into many partitions, gives the same flags as in one."""
    rnd = random.Random(4)
    values = _normal(rnd, 3000)
    planted = set(range(7, 2990, 41))
    for i in planted:
        values[i] = values[i] * 3
    for i in range(100, 2900, 500):
        values[i : i + 9] = [values[i - 1] + 0.5] * 9
    rows = _rows("hot", values) + [r for k in range(30) for r in _rows(f"n{k}", _normal(rnd, 10))]
    whole = _flags(spark, rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        cut = _flags(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert cut == whole
    assert sum(f == "spike" for f in whole.values()) >= 0.9 * len(planted)


def test_repeats_nulls_and_empty(spark):
    rnd = random.Random(6)
    rows = [r for k in range(10) for r in _rows(f"n{k}", _normal(rnd, 20))]
    bad = _normal(rnd, 20)
    bad[9] = 500.0
    rows += _rows("x", bad) + [("t", "again", "f", "s", "x", 9, 500.0, True), ("t", "null", "f", "s", None, 9, 500.0, True), ("t", "none", "f", "s", "x", 9, None, True), ("t", "zero", "f", "s", "x", 30, 0.0, True)]
    assert _flags(spark, rows) == {"x-9": "spike", "again": "spike", "zero": "out_of_range"}
    assert _flags(spark, []) == {}
    assert _flags(spark, [("t", "1", "f", "s", "one", 1, 5.0, False)]) == {}


def _parameters(n, mad=0.01, repeats=0.05):
    start = [mad, repeats, 1.05 * mad, spikes._WIDTH, spikes._EQUAL, *spikes._MOVE.ravel()]
    return np.tile(np.array(start, dtype=float), (n, 1))


def test_posteriors_sum_to_one():
    n = 700
    q = _parameters(n)
    group = np.repeat([0, 1, 2], [600, 1, 99])
    e = spikes._emissions(np.zeros(n), np.zeros(n, bool), np.ones(n, bool), q)
    p, moved = spikes.posteriors(group, e, q, counts=True)
    assert np.allclose(p.sum(1), 1) and p[:, 0].min() > 0.5
    # every reading but a series' last one moves on once
    assert np.allclose(np.delete(moved.sum((1, 2)), [599, 600, 699]), 1) and (moved[[599, 600, 699]] == 0).all()


def test_chunks_agree_with_one_pass():
    rng = np.random.default_rng(3)
    n = 900
    q, d = _parameters(n), np.where(rng.random(n) < 0.03, 0.5, 0.0)
    e = spikes._emissions(d, rng.random(n) < 0.2, rng.random(n) > 0.01, q)
    whole = np.empty((n, 4))
    move, f = spikes._MOVE, spikes._START * e[0]
    fwd = [f / f.sum()]
    for t in range(1, n):
        f = (fwd[-1] @ move) * e[t]
        fwd.append(f / f.sum())
    back = np.ones(4)
    for t in range(n - 1, -1, -1):
        whole[t] = fwd[t] * back / (fwd[t] * back).sum()
        back = move @ (back * e[t])
        back /= back.sum()
    assert np.abs(spikes.posteriors(np.zeros(n, int), e, q)[0] - whole).max() < 1e-6


def test_the_model_decides(spark, monkeypatch):
    """Without the model's decision nothing but what it says is left of the exact rule: no spikes, no stuck runs."""
    rnd = random.Random(5)
    rows = [r for k in range(30) for r in _rows(f"n{k}", _normal(rnd, 30))]
    one = _normal(rnd, 30)
    one[10] = 150.0
    rows += _rows("one", one)
    assert _flags(spark, rows) == {"one-10": "spike"}
    monkeypatch.setattr(spikes, "_emissions", lambda d, equal, inside, q: np.where(inside[:, None], [1.0, 1e-9, 1e-9, 0.0], [0.0, 0.0, 0.0, 1.0]))
    x = spikes._judge(np.zeros(30, int), np.array(one), _parameters(30), np.ones(30, bool), True)
    assert (x[1] == "").all()


def test_out_of_range_beside_a_reading_of_the_same_time(spark):
    rnd = random.Random(6)
    rows = [r for k in range(5) for r in _rows(f"n{k}", _normal(rnd, 20))]
    rows += [("t", "low", "f", "s", "n0", 3, 0.0, True), ("t", "alone", "f", "other", "x", 1, 2_000_000.0, True), ("t", "null", "f", "s", None, 1, 0.0, True)]
    assert _flags(spark, rows) == {"low": "out_of_range", "alone": "out_of_range"}


def test_partitions_are_bounded_by_rows(spark, monkeypatch):
    """What a Python worker takes at once is bounded by rows, though the stored table is small and the session merges parts."""
    from mercanta import runtime

    rnd = random.Random(9)
    monkeypatch.setattr(runtime, "RANGE_ROWS", 200)
    rows = _rows("hot", _normal(rnd, 3000)) + [r for k in range(100) for r in _rows(f"n{k}", _normal(rnd, 30))]
    rows[500] = (*rows[500][:6], 300.0, True)
    sizes, parts = [], runtime.ranged

    def seen(df, *columns, rows=0):
        out = parts(df, *columns, rows=rows)
        sizes.append(max(r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()))
        return out

    monkeypatch.setattr(spikes, "ranged", seen)
    assert _flags(spark, rows)["hot-500"] == "spike"
    assert len(sizes) == 3 and max(sizes) < 2 * 200
