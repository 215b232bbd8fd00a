import random

import pyspark.sql.functions as F

from mercanta.llm import percentiles


def test_merged_parts_stay_within_the_bound(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 5}", i % 7, rnd.lognormvariate(3, 2)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    whole = percentiles.answers(percentiles.combined(percentiles.sketches(df, ["g", "day"], "v", 200), ["g"], 200), size=200)
    bad = total = 0
    for r in whole.collect():
        values = sorted(v for g, _, v in rows if g == r.g)
        assert (r.n, r.least, r.most) == (len(values), values[0], values[-1])
        for share in percentiles.SHARES:
            answer = r[f"p{round(share * 100):02d}"]
            low, high = sum(v < answer for v in values) / len(values), sum(v <= answer for v in values) / len(values)
            total += 1
            bad += max(0, low - share, share - high) > percentiles.rank_error(200)
    assert bad <= max(1, 0.05 * total)


def test_small_groups_are_exact_and_nulls_dont_count(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", None), ("a", float("nan")), (None, 5.0), ("none", None), ("t", 7.0), ("t", 7.0)], "g string, v double")
    out = {r.g: (r.n, r.p50, r.rank_error) for r in percentiles.answers(percentiles.sketches(df, ["g"], "v")).collect()}
    assert out == {"a": (3, 2.0, 0.0), None: (1, 5.0, 0.0), "t": (2, 7.0, 0.0)}
    assert percentiles.answers(percentiles.sketches(df.limit(0), ["g"], "v")).count() == 0


def test_levels_agree(spark, data):
    out = percentiles.price_percentiles(spark, data)
    n = {r.level: r.n for r in out.where("metric = 'price'").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert n["load"] == n["day"] == n["all"] > 0
    assert percentiles.measured_error(spark, data).where("error > rank_error").count() == 0
