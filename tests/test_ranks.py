import random
from collections import defaultdict
from statistics import median

from mercanta.operators.ranks import group_medians, range_ranks


def _check(spark, rows, partitions):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, "g string, v double, n long")
        got = {(r.g, r.v): (r.cum_n, r.all_n) for r in range_ranks(df, ["g"], ["v"], ["n"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, groups = {}, defaultdict(list)
    for g, v, n in rows:
        groups[g].append((v is not None, v if v is not None else 0, n or 0, v))
    for g, values in groups.items():
        total, cum = sum(x[2] for x in values), 0
        for _, _, n, v in sorted(values, key=lambda x: x[:2]):
            cum += n
            want[g, v] = (cum, total)
    assert got == want


def test_hot_group_spans_partitions(spark):
    rows = [("hot", float(i), i % 3) for i in range(500)] + [(f"g{i % 40}", float(i), 1) for i in range(300)] + [(None, None, 5), (None, 1.0, None)]
    random.Random(1).shuffle(rows)
    _check(spark, rows, 16)
    _check(spark, rows, 1)


def test_ties_count_as_one_value(spark):
    rows = [("g", float(i // 50), f"l{i}", 1) for i in range(400)] + [("h", 1.0, "x", 2)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        out = range_ranks(spark.createDataFrame(rows, "g string, v double, l string, n long"), ["g"], ["v"], ["n"], ties=["l"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(out) == 401
    for r in out:
        assert (r.cum_n, r.all_n, r.at_n) == ((2, 2, 2) if r.g == "h" else (50 * (int(r.v) + 1), 400, 50))


def test_empty(spark):
    assert range_ranks(spark.createDataFrame([], "g string, v double, n long"), ["g"], ["v"], ["n"]).count() == 0


def test_group_medians(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), rnd.choice([None, *map(float, range(30))])) for _ in range(700)]
    got = {r.g: (r.median, r.n) for r in group_medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in "abc":
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g] == (median(values), len(values))
