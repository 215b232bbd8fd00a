"""Column-level quality profile of loads (problem 1).

Every column is unpivoted to (source, load, column, value) and counted before any shuffle of rows.
The counted values are range-sorted by column and value; prefix counts of the partitions give exact
quantiles and distinct counts for loads of any size. The cumulative curve of a load, merged with the
curve of all loads of its source, gives the exact Kolmogorov-Smirnov distance to the other loads.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercanta.operators.ranks import group_medians, median_of, quantile_of, range_ranks
from mercanta.runtime import bounded_broadcast, written

#: Cells name their column by its number and their source and load by 64-bit hashes, so little is moved beside the values.
KEYS = ["s", "l", "c"]
#: Texts longer than this are compared by so many first letters and, where these are equal, by a hash of the whole text.
LONG_TEXT, FIRST_LETTERS = 32, 16


@dataclass(frozen=True)
class Check:
    """What is measured of one column.

    ``rows`` keeps the rows that count (NULL: not kept), ``plausible`` tells values in range and
    ``well_formed`` values of the right pattern; both hold for NULL and where they aren't given.
    """

    name: str
    value: Column
    numeric: bool = False
    rows: Column | None = None
    plausible: Column | None = None
    well_formed: Column | None = None


def _truth(condition: Column | None) -> Column:
    return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))


def _hashes(source: Column, load: Column) -> tuple[Column, Column]:
    source, load = source.cast("string"), load.cast("string")
    return F.xxhash64(source.isNull(), source), F.xxhash64(source.isNull(), source, load.isNull(), load)


def _short(text: Column) -> Column:
    """A stand-in of bounded length that is equal where the whole texts are, and sorts alike up to the first letters."""
    return F.when(F.length(text) <= LONG_TEXT, text).otherwise(F.concat(F.substring(text, 1, FIRST_LETTERS), F.lit("\uffff"), F.hex(F.xxhash64(text))))


def counted_values(df: DataFrame, source: Column, load: Column, checks: Sequence[Check]) -> DataFrame:
    """(s, l, c, value) with counts; one pass over ``df``, reduced before the shuffle."""
    cells = []
    for i, c in enumerate(checks):
        value = c.value
        if c.numeric:
            value = value.cast("double")
            value = F.when(~F.isnan(value), value)
        cell = F.struct(
            F.lit(i).cast("smallint").alias("c"),
            (value if c.numeric else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if c.numeric else _short(value.cast("string"))).alias("txt"),
            (value.isNull() | _truth(c.plausible)).alias("plausible") if c.plausible is not None else F.lit(True).alias("plausible"),
            (value.isNull() | _truth(c.well_formed)).alias("well_formed") if c.well_formed is not None else F.lit(True).alias("well_formed"),
        )
        cells.append(cell if c.rows is None else F.when(c.rows, cell))
    s, l = _hashes(source, load)
    cell = F.explode(F.array_compact(F.array(*cells)))
    flat = df.select(s.alias("s"), l.alias("l"), cell.alias("cell")).select("s", "l", "cell.*")
    counted = flat.groupBy(*KEYS, "num", "txt", "plausible", "well_formed").agg(F.count("*").alias("n_rows"))
    return counted.withColumn("n", F.when(F.col("num").isNotNull() | F.col("txt").isNotNull(), F.col("n_rows")).otherwise(F.lit(0)))


def text_ranges(df: DataFrame, source: Column, load: Column, checks: Sequence[Check]) -> DataFrame:
    """(source, load, column_name, min_text, max_text) of the text columns: one partial aggregate over the rows themselves."""
    texts = [c for c in checks if not c.numeric]
    if not texts:
        return df.sparkSession.createDataFrame([], "source string, load string, column_name string, min_text string, max_text string")
    kept = [(c.value if c.rows is None else F.when(c.rows, c.value)).cast("string") for c in texts]
    ends = df.groupBy(source.cast("string").alias("source"), load.cast("string").alias("load")).agg(*(f(v).alias(f"{p}{i}") for i, v in enumerate(kept) for p, f in (("a", F.min), ("b", F.max))))
    each = F.explode(F.array(*(F.struct(F.lit(c.name).alias("column_name"), F.col(f"a{i}").alias("min_text"), F.col(f"b{i}").alias("max_text")) for i, c in enumerate(texts))))
    return ends.select("source", "load", each.alias("e")).select("source", "load", "e.*")


def profile(df: DataFrame, source: Column, load: Column, checks: Sequence[Check], distances: bool = True) -> DataFrame:
    """One row per source, load and column.

    Columns: rows, nulls, null_share, values, distinct, min/max (of numbers and texts), outside (values
    out of range), malformed, q25, median and q75 of the values in range, ks_distance to the other
    loads of the source (NULL for a source with one load, or with ``distances`` off), and the usual
    null share, median and malformed share: the exact medians over all loads of the source.

    Sources and loads are told apart by 64-bit hashes, which are checked to differ. NULL source or load is a group of its own; NaN counts as NULL; empty text is a value; repeated rows
    count each time; an empty table gives no rows. Hot loads and hot values are split: values are
    counted before the shuffle and ranges of them are sorted, never a whole load in one task.
    """
    names = df.groupBy(source.cast("string").alias("source"), load.cast("string").alias("load")).agg(F.lit(1).alias("one")).drop("one")
    names = written(names.select("source", "load", *(h.alias(n) for h, n in zip(_hashes(F.col("source"), F.col("load")), ("s", "l")))), "load-names")
    if names.groupBy("l").count().where("count > 1").unionByName(names.groupBy(F.col("s").alias("l"), "source").count().groupBy("l").count().where("count > 1")).limit(1).count():
        raise ValueError("two loads or sources have one hash")
    cells = counted_values(df, source, load, checks)
    per_load = (["c", "s", "l"], ["num", "txt"], ["n", "n_ok", "n_distinct"])
    ok, distinct = F.when(F.col("plausible"), F.col("n")).otherwise(F.lit(0)).alias("n_ok"), F.when(F.col("n") > 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_distinct")
    malformed = F.when(~F.col("well_formed"), F.col("n")).otherwise(F.lit(0)).alias("n_malformed")
    if distances:
        # one sort by source and value puts the pooled curve beside every load's own values
        pooled = range_ranks(cells, ["c", "s"], ["num", "txt"], ["n"], ties=["l", "plausible", "well_formed"])
        # a value's place in the pooled curve stands for it from here on: it sorts alike and is short
        pooled = pooled.select(*KEYS, "num", "n_rows", "n", ok, malformed, distinct, F.col("cum_n").alias("cum_w"), F.col("all_n").alias("all_w"), F.col("at_n").alias("w"))
        ranked = range_ranks(pooled, per_load[0], ["cum_w"], per_load[2])
        others = F.col("all_w") - F.col("all_n")

        def gap(mine: Column, pooled_count: Column) -> Column:
            return F.abs(mine / F.col("all_n") - (pooled_count - mine) / others)

        at, under = gap(F.col("cum_n"), F.col("cum_w")), gap(F.col("cum_n") - F.col("n"), F.col("cum_w") - F.col("w"))
        ranked = ranked.withColumn("gap", F.when((F.col("n") > 0) & (others > 0), F.greatest(at, under)))
    else:
        ranked = range_ranks(cells.select("*", ok, malformed, distinct), *per_load).withColumn("gap", F.lit(None).cast("double"))
    some = F.col("n") > 0
    loads = ranked.groupBy(*KEYS).agg(
        F.sum("n_rows").alias("rows"), F.sum(F.col("n_rows") - F.col("n")).alias("nulls"), F.sum("n").alias("values"), F.max("all_n_distinct").alias("distinct"),
        F.min("num").alias("min_number"), F.max("num").alias("max_number"),
        F.sum(F.col("n") - F.col("n_ok")).alias("outside"), F.sum("n_malformed").alias("malformed"), F.sum("n_ok").alias("in_range"),
        quantile_of("num", "n_ok", 0.25).alias("q25"), median_of("num", "n_ok").alias("median"), quantile_of("num", "n_ok", 0.75).alias("q75"),
        F.max(F.when(some, F.col("gap"))).alias("ks_distance"), F.sum(F.when(some, F.col("num") * F.col("n"))).alias("total"),
    )
    loads = loads.withColumn("null_share", F.col("nulls") / F.col("rows")).withColumn("mean", F.try_divide(F.col("total"), F.col("values"))).withColumn("malformed_share", F.try_divide(F.col("malformed"), F.col("values"))).withColumn("outside_share", F.try_divide(F.col("outside"), F.col("values"))).drop("total")
    numbered = F.create_map(*(x for i, c in enumerate(checks) for x in (F.lit(i).cast("smallint"), F.lit(c.name))))
    loads = loads.join(bounded_broadcast(names.drop("s")), "l").select("source", "load", numbered[F.col("c")].alias("column_name"), *(x for x in loads.columns if x not in KEYS))
    k, t = loads.alias("k"), text_ranges(df, source, load, checks).alias("t")
    loads = k.join(t, F.col("k.source").eqNullSafe(F.col("t.source")) & F.col("k.load").eqNullSafe(F.col("t.load")) & (F.col("k.column_name") == F.col("t.column_name")), "left").select("k.*", "t.min_text", "t.max_text")
    loads = written(loads, "loads")
    metrics = ["null_share", "median", "mean", "malformed_share"]
    long = loads.select("source", "column_name", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("m")).select("source", "column_name", "m.*")
    usual = group_medians(long, ["column_name", "source", "metric"], "value")
    usual = usual.groupBy("source", "column_name").agg(*(F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"usual_{m}") for m in metrics))
    a, u = loads.alias("a"), usual.alias("u")
    return a.join(u, F.col("a.source").eqNullSafe(F.col("u.source")) & (F.col("a.column_name") == F.col("u.column_name")), "left").select("a.*", *(f"u.usual_{m}" for m in metrics))


#: A rating from 0 to 5 with at most one decimal, alone or within the words the sources use around it.
RATING = r"(?i)^\s*(?:(?:classifica[cç][aã]o|nota|avalia[cç][aã]o|rating)\s*:?\s*)?(?:[0-4](?:[.,]\d)?|5(?:[.,]0)?)\s*(?:(?:/|de|of|out of)\s*5(?:[.,]0)?)?\s*(?:estrelas?|estrellas?|stars?)?\s*$"
REVIEWS_MOST = 1_000_000


def listing_checks(open_only: Column, names: Sequence[str] = ("blocked", "reviews_count", "rating_text")) -> list[Check]:
    """The three columns that matter most in market listings."""
    reviews = F.col("reviews_count")
    every = {
        "blocked": Check("blocked", F.col("blocked").cast("int"), numeric=True),
        "reviews_count": Check("reviews_count", reviews, numeric=True, rows=open_only, plausible=(reviews >= 0) & (reviews <= REVIEWS_MOST)),
        "rating_text": Check("rating_text", F.col("rating_text"), rows=open_only, well_formed=F.col("rating_text").rlike(RATING)),
    }
    return [every[n] for n in names]


def all_checks(df: DataFrame, skip: Sequence[str] = ()) -> list[Check]:
    """Every column of the table: numbers, booleans, dates and timestamps by value, all else as text."""
    open_only = ~F.col("blocked")
    special = {c.name: c for c in listing_checks(open_only)}
    checks = []
    for name, kind in df.dtypes:
        if name in skip:
            continue
        if name in special:
            checks.append(special[name])
        elif kind == "timestamp":
            checks.append(Check(name, F.unix_micros(F.col(f"`{name}`")), numeric=True))
        elif kind == "date":
            checks.append(Check(name, F.unix_date(F.col(f"`{name}`")), numeric=True))
        elif kind == "boolean":
            checks.append(Check(name, F.col(f"`{name}`").cast("int"), numeric=True))
        elif kind.startswith(("decimal", "int", "bigint", "double", "float", "smallint", "tinyint")):
            checks.append(Check(name, F.col(f"`{name}`"), numeric=True))
        else:
            checks.append(Check(name, F.col(f"`{name}`")))
    return checks


def load_issues(profiled: DataFrame) -> DataFrame:
    """The issues of each load, by the rules stated for market listings: (source_run_id, column_name, issue)."""
    open_column = F.col("column_name").isin("reviews_count", "rating_text")
    enough = F.col("rows") >= 8
    ratio = F.try_divide(F.col("median"), F.col("usual_median"))
    rules = [
        ("distribution", (F.col("column_name") == "blocked") & (F.col("mean") - F.col("usual_mean") > 0.4)),
        ("nulls", open_column & enough & (F.col("null_share") - F.col("usual_null_share") > 0.4)),
        ("distinct", open_column & enough & (F.col("values") >= 8) & (F.col("distinct") == 1)),
        ("range", (F.col("column_name") == "reviews_count") & enough & (F.col("outside_share") > 0.35)),
        ("pattern", (F.col("column_name") == "rating_text") & enough & (F.col("malformed_share") > 0.35)),
        ("distribution", (F.col("column_name") == "reviews_count") & enough & (F.col("in_range") >= 8) & ((ratio >= 8) | (ratio <= 0.125))),
    ]
    found = F.explode(F.array_distinct(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))))
    return profiled.select(F.col("load").alias("source_run_id"), "column_name", found.alias("issue"))
