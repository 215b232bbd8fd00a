import random

import pyspark.sql.functions as F
import pytest

from mercanta.operators.snapshots import latest_rows, leaf_digests, snapshot_changes


@pytest.mark.parametrize("leaf_rows", [1, 64])
def test_changes_against_brute_force(spark, leaf_rows):
    rnd = random.Random(8)
    state, rows, want = {}, [], set()
    for step in range(5):
        new = {f"k{i}": rnd.choice([None, 1.5, 2.5]) if rnd.random() < 0.2 or f"k{i}" not in state else state[f"k{i}"] for i in range(300) if rnd.random() < 0.9}
        if step == 3:
            new = dict(state)
        rows += [(f"r{step}", k, v) for k, v in new.items()]
        if step:
            want |= {(f"r{step}", k, "added") for k in new.keys() - state.keys()} | {(f"r{step}", k, "removed") for k in state.keys() - new.keys()} | {(f"r{step}", k, "changed") for k in new.keys() & state.keys() if new[k] != state[k]}
        state = new
    order = spark.createDataFrame([(f"r{i}", i) for i in (3, 1, 0, 4, 2)], "snapshot string, at int")
    df = spark.createDataFrame([*rows, ("broken", "k1", 9.0)], "snapshot string, key string, value double")
    assert {(r.snapshot, r.key, r.change_kind) for r in snapshot_changes(df, order, leaf_rows).collect()} == want


def test_empty_snapshots_nulls_and_latest_row(spark):
    order = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "snapshot string, at int")
    df = spark.createDataFrame([("a", None, 1.0), ("a", "k", None), ("c", "k", 0.0)], "snapshot string, key string, value double")
    assert {(r.snapshot, r.key, r.change_kind) for r in snapshot_changes(df, order).collect()} == {("b", None, "removed"), ("b", "k", "removed"), ("c", "k", "added")}
    assert snapshot_changes(df.limit(0), order).count() == 0
    twice = spark.createDataFrame([("a", "k", 1, 5.0, "x"), ("a", "k", 2, None, "y"), ("a", "k", 2, None, "y")], "snapshot string, key string, at int, profit double, value string")
    assert [r.value for r in latest_rows(twice, "snapshot", "key", F.col("at"), F.col("profit")).collect()] == [None]


def test_stored_digests_give_the_same_changes(spark):
    rows = [(s, f"k{i}", float(i + (s == "c" and i % 50 == 0))) for s in "abc" for i in range(400) if (s, i) != ("b", 7)]
    df = spark.createDataFrame(rows, "snapshot string, key string, value double")
    order = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "snapshot string, at int")
    found = lambda **more: {(r.snapshot, r.key, r.change_kind, r.old_value, r.new_value) for r in snapshot_changes(df, order, **more).collect()}
    want = {("b", "k7", "removed", 7.0, None), ("c", "k7", "added", None, 7.0), *(("c", f"k{i}", "changed", float(i), float(i + 1)) for i in range(0, 400, 50))}
    assert found() == found(stored=leaf_digests(df.where("snapshot != 'c'"), 2), depth=2) == want
