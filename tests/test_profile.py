import random

import pyspark.sql.functions as F

from mercanta.operators.profile import Check, all_checks, load_issues, listing_checks, profile


def _ks(a, b):
    points = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)


def test_profile_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [("s1" if i % 3 else "s2", f"l{i % 7}", rnd.choice([None, 1, 2, 3, 50, 900]), rnd.choice([None, "", "a", "bb", "ccc"])) for i in range(420)]
    df = spark.createDataFrame(rows, "source string, load string, x int, t string")
    checks = [Check("x", F.col("x"), numeric=True, plausible=F.col("x") < 100), Check("t", F.col("t"), well_formed=F.col("t") != "bb")]
    out = {(r.source, r.load, r.column_name): r for r in profile(df, F.col("source"), F.col("load"), checks).collect()}
    for s, l, c in out:
        at = 2 if c == "x" else 3
        mine = [r[at] for r in rows if r[0] == s and r[1] == l]
        rest = [r[at] for r in rows if r[0] == s and r[1] != l and r[at] is not None]
        values = [v for v in mine if v is not None]
        r = out[s, l, c]
        assert (r.rows, r.nulls, r["values"], r.distinct) == (len(mine), len(mine) - len(values), len(values), len(set(values)))
        assert abs(r.ks_distance - _ks(values, rest)) < 1e-12
        if c == "x":
            assert (r.min_number, r.max_number, r.outside) == (min(values), max(values), sum(v >= 100 for v in values))
        else:
            assert (r.min_text, r.max_text, r.malformed) == (min(values), max(values), values.count("bb"))


def test_one_load_holds_most_rows(spark):
    rows = [("s", "hot", float(i), None) for i in range(3000)] + [("s", f"l{i}", float(i), None) for i in range(20)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = profile(spark.createDataFrame(rows, "source string, load string, x double, t string"), F.col("source"), F.col("load"), [Check("x", F.col("x"), numeric=True), Check("t", F.col("t"))]).where("load = 'hot'").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    x = next(r for r in out if r.column_name == "x")
    assert (x.rows, x.distinct, x.median, x.q25) == (3000, 3000, 1499.5, 749.0)
    assert next(r for r in out if r.column_name == "t").null_share == 1.0


def test_empty_table_and_null_keys(spark):
    schema = "source string, load string, blocked boolean, reviews_count int, rating_text string, num int, extra string"
    checks = listing_checks(~F.col("blocked"))
    assert profile(spark.createDataFrame([], schema), F.col("source"), F.col("load"), checks).count() == 0
    df = spark.createDataFrame([(None, None, None, None, None, 1, "x")], schema)
    out = profile(df, F.col("source"), F.col("load"), checks)
    assert {(r.column_name, r.rows, r.nulls) for r in out.collect()} == {("blocked", 1, 1)}
    assert load_issues(out).count() == 0
    assert len(all_checks(df)) == 7


def test_rating_pattern(spark):
    good = ["4,5 de 5 estrelas", "Classificação 4,8/5", "4.9", "4,9 estrelas", "Nota 4,8 de 5", "0", "5,0", "5"]
    bad = ["9,4/10", "bom", "-1", "NaN", "45", "4;7", "4,7,1", "88%", "R$ 4,70", "47 de 50", "6,3 de 5 estrelas", "5,1", "4,55", ""]
    from mercanta.operators.profile import RATING

    out = spark.createDataFrame([(x,) for x in good + bad], "t string").select("t", F.col("t").rlike(RATING).alias("ok")).collect()
    assert {r.t for r in out if r.ok} == set(good)
