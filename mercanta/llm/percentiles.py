"""Percentiles with a bounded rank error that combine across loads and days (problem 2).

Values go into randomized compactor hierarchies (KLL sketches): each level sorts its values and passes
every other one up at double weight, starting at random; sketches merge level by level. Spark builds them
in the JVM, a partial sketch per task before the shuffle, so a hot group costs a few kilobytes per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercanta.runtime import table, written

#: Size of the top compactor. The rank of an answer is off by more than ``rank_error()`` in 1 % of answers at most.
SIZE = 512
SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


def rank_error(size: int = SIZE) -> float:
    """The published single-sided rank error of KLL sketches at 99 % confidence, as a share of the count."""
    return 2.296 / size**0.9723


def sketches(df: DataFrame, groups: Sequence[str], value: str, size: int = SIZE) -> DataFrame:
    """One sketch per group: groups, n, least, most, sketch. NULL and NaN values are left out; NULL groups are a group."""
    number = F.col(value).cast("double")
    kept = df.select(*groups, number.alias("v")).where(number.isNotNull() & ~F.isnan(number))
    return kept.groupBy(*groups).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.kll_sketch_agg_double("v", F.lit(size)).alias("sketch"))


def combined(parts: DataFrame, groups: Sequence[str], size: int = SIZE) -> DataFrame:
    """Sketches of finer groups merged into coarser ones."""
    return parts.groupBy(*groups).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def answers(parts: DataFrame, shares: Sequence[float] = SHARES, size: int = SIZE) -> DataFrame:
    """Sketches answered: pNN columns and rank_error (0 where the sketch still holds every value)."""
    q = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias(f"p{round(s * 100):02d}") for s in shares]
    return parts.select(*(c for c in parts.columns if c != "sketch"), *q, F.when(F.col("n") <= size, 0.0).otherwise(rank_error(size)).alias("rank_error"))


def price_values(spark: SparkSession, root: str) -> DataFrame:
    """(metric, source, query, day, load, value): prices of open listings by query, median prices by source and query."""
    listings = table(spark, root, "market_web_listings_raw").where(~F.col("blocked"))
    listings = listings.select(F.lit("price").alias("metric"), F.lit(None).cast("string").alias("source"), "query", F.col("fetched_date").alias("day"), F.col("source_run_id").alias("load"), F.col("price").cast("double").alias("value"))
    history = table(spark, root, "price_history_raw").where(~F.col("blocked"))
    history = history.select(F.lit("median_price").alias("metric"), F.col("source_name").alias("source"), "query", F.col("fetched_date").alias("day"), F.lit(None).cast("string").alias("load"), F.col("median_price").cast("double").alias("value"))
    return listings.unionByName(history).where("value IS NOT NULL")


def price_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of every load, of every day (merged loads) and of all days (merged days), one row each.

    Nothing but the sketches of the loads is computed from values. Equal values and repeated rows count
    each time; a group without values has no row; empty tables give no rows.
    """
    keys = ["metric", "source", "query"]
    loads = written(sketches(price_values(spark, root), [*keys, "day", "load"], "value"), "load-sketches")
    days = written(combined(loads, [*keys, "day"]), "day-sketches")
    whole = combined(days, keys)
    no_day, no_load = F.lit(None).cast("date").alias("day"), F.lit(None).cast("string").alias("load")
    levels = loads.where("load IS NOT NULL").select(F.lit("load").alias("level"), *keys, "day", "load", "n", "least", "most", "sketch")
    levels = levels.unionByName(days.select(F.lit("day").alias("level"), *keys, "day", no_load, "n", "least", "most", "sketch"))
    levels = levels.unionByName(whole.select(F.lit("all").alias("level"), *keys, no_day, no_load, "n", "least", "most", "sketch"))
    return answers(levels)


def _exact_ranks(values: DataFrame, answered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The exact range of ranks that each answered value of a group holds, and how far off it is."""
    asked = answered.select(*keys, "n", "rank_error", F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.col(f"p{round(s * 100):02d}").alias("answer")) for s in SHARES))).alias("a")).select(*keys, "n", "rank_error", "a.*")
    v, a = values.groupBy(*keys, "value").agg(F.count("*").alias("c")).alias("v"), asked.alias("a")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"v.{k}").eqNullSafe(F.col(f"a.{k}"))
    below, upto = F.when(F.col("v.value") < F.col("a.answer"), F.col("v.c")), F.when(F.col("v.value") <= F.col("a.answer"), F.col("v.c"))
    ranks = a.join(v, same).groupBy(*(f"a.{k}" for k in keys), "a.share", "a.answer", "a.n", "a.rank_error").agg(F.coalesce(F.sum(below), F.lit(0)).alias("below"), F.sum(upto).alias("upto"))
    off = F.greatest(F.lit(0.0), F.col("below") / F.col("n") - F.col("share"), F.col("share") - F.col("upto") / F.col("n"))
    return ranks.select(*keys, "share", "answer", "n", "below", "upto", off.alias("error"), "rank_error")


def measured_error(spark: SparkSession, root: str) -> DataFrame:
    """For the answers of every load, day and all days: the exact range of ranks that each answered value holds, and how far off it is."""
    keys, values = ["metric", "source", "query"], price_values(spark, root)
    levels = {"load": [*keys, "day", "load"], "day": [*keys, "day"], "all": keys}
    answered = written(price_percentiles(spark, root), "answers")
    out = None
    for level, names in levels.items():
        measured = _exact_ranks(values if level != "load" else values.where("load IS NOT NULL"), answered.where(F.col("level") == level), names)
        missing = [F.lit(None).cast(t).alias(c) for c, t in (("day", "date"), ("load", "string")) if c not in names]
        measured = measured.select(F.lit(level).alias("level"), "*", *missing)
        out = measured if out is None else out.unionByName(measured)
    return out
