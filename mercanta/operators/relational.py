"""Window, aggregate and set operators over listings, runs and snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercanta.operators.ranks import range_ranks


def best_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order (end it with a unique column). Spark stops each key's sort early."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], most: int, rank: str = "rank") -> DataFrame:
    """The first ``most`` rows per key, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= most)


def surrogate_keys(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 over a total order: ranges are sorted, counts of the ranges give the offsets.

    ``order`` must be unique; nothing passes through a single task.
    """
    ranked = range_ranks(df.withColumn("_one", F.lit(1).cast("long")), [], list(order), ["_one"])
    return ranked.withColumn(name, F.col("cum__one")).drop("cum__one", "all__one", "_one")


def bad_streak(runs: DataFrame, key: Sequence[str], order: Sequence[Column], bad: Column, terminal: Column, limit: int = 3) -> DataFrame:
    """Per key, how many ended runs from the newest on are bad before the first good one; ``disable`` from ``limit`` on."""
    ended = runs.where(terminal).withColumn("_bad", bad).withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    first_good = F.min(F.when(~F.col("_bad"), F.col("_rank")))
    per_key = ended.groupBy(*key).agg(first_good.alias("_good"), F.count("*").alias("runs"))
    streak = F.coalesce(F.col("_good") - 1, F.col("runs"))
    return per_key.select(*key, "runs", streak.alias("streak"), (streak >= limit).alias("disable"))


def drop_reasons(df: DataFrame, reasons: Sequence[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """Each row with the first reason to drop it, or ``kept``: one pass serves the filter and its counters."""
    rule = F
    for name, condition in reasons:
        rule = rule.when(condition, F.lit(name))
    return df.withColumn("reason", rule.otherwise(F.lit(kept)))


def status_counts(df: DataFrame, key: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Rows per key and for each value of a column, in one pass."""
    return df.groupBy(*key).agg(F.count("*").alias("rows"), *(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def joined_values(df: DataFrame, key: Sequence[str], value: str, separator: str = " | ") -> DataFrame:
    """Sorted distinct values of each key joined to a text, and their number; duplicates go before the lists form."""
    return df.where(F.col(value).isNotNull()).select(*key, value).distinct().groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(value)), separator).alias("joined"), F.count("*").alias("n_values"))


def with_unknown(fact: DataFrame, dimension: DataFrame, code: str, dim_code: str, sk: str, unknown: int = 99) -> DataFrame:
    """The surrogate key of a code, or the unknown member's. The dimension is small and fixed."""
    d = dimension.select(F.col(dim_code).alias("_code"), F.col(sk))
    return fact.join(F.broadcast(d), F.col(code) == F.col("_code"), "left").withColumn(sk, F.coalesce(F.col(sk), F.lit(unknown))).drop("_code")


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows per broken rule: what enum and check constraints would refuse."""
    broken = F.explode(F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()))))
    return df.select(broken.alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))


def date_dimension(dates: DataFrame, column: str) -> DataFrame:
    """Calendar attributes of distinct dates: key yyyymmdd, year, quarter, month and its name, day, ISO weekday, weekend."""
    d = F.col(column)
    weekday = F.weekday(d) + 1
    return dates.where(d.isNotNull()).select(d).distinct().select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), d.alias("date"), F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"),
        F.dayofmonth(d).alias("day"), weekday.alias("iso_weekday"), weekday.isin(6, 7).alias("is_weekend"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, rounded; not truncated as a timestamp difference would be."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000).cast("bigint")


def title_case(text: Column) -> Column:
    """Capital after every character that isn't a letter or digit, as the reference database's function does it."""
    parts = F.split(F.lower(text), r"(?<=[^\p{L}\p{N}])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def precision_recall_at(scored: DataFrame, score: str, label: str, tie: str, at: Sequence[int] = (10, 25, 50)) -> DataFrame:
    """One row: precision@k (over the k, or all if fewer) and recall@k of the best scored rows; only max(at) rows are ranked."""
    best = scored.select(F.col(label).cast("int").alias("y"), F.col(score).alias("s"), F.col(tie).alias("t")).orderBy(F.desc("s"), "t").limit(max(at))
    ranked = best.withColumn("r", F.row_number().over(Window.orderBy(F.desc("s"), "t")))
    hits = ranked.agg(*(F.coalesce(F.sum(F.when(F.col("r") <= k, F.col("y"))), F.lit(0)).alias(f"h{k}") for k in at))
    totals = scored.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(label).cast("int")), F.lit(0)).alias("positives"))
    both = hits.crossJoin(totals)  # one row each
    out = []
    for k in at:
        out += [F.round(F.try_divide(F.col(f"h{k}"), F.least(F.lit(k), F.col("n"))), 6).alias(f"precision_at_{k}"), F.round(F.try_divide(F.col(f"h{k}"), F.col("positives")), 6).alias(f"recall_at_{k}")]
    return both.select(*out)


def average_precision(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Step-sum average precision over distinct scores: counts per score are range-ranked, never one global window."""
    counts = scored.groupBy((-F.col(score)).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("pos"))
    ranked = range_ranks(counts, [], ["s"], ["n", "pos"])
    return ranked.agg(F.round(F.sum(F.try_divide(F.col("pos"), F.col("all_pos")) * F.col("cum_pos") / F.col("cum_n")), 6).alias("average_precision"), F.max("all_n").alias("rows"), F.max("all_pos").alias("positives"))
