"""Exact ranks of sorted groups without a window over a group.

Rows are range-partitioned by (group, value), so a group of any size is spread over as many tasks
as it needs. Each task takes prefix counts of its own rows. Only the first and the last group of a
partition can go on elsewhere; their offsets, at most two rows a partition, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mercanta.runtime import ranged, written


def group_starts(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """True at each row whose ``columns`` differ from the row before. NULL equals NULL."""
    n = table.num_rows
    starts = np.zeros(n, dtype=bool)
    if n:
        starts[0] = True
    for name in columns if n > 1 else ():
        column = table.column(name).combine_chunks()
        here, last = column.slice(1), column.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(here, last), False)
        if column.null_count:
            differs = pc.or_(differs, pc.xor(pc.is_null(here), pc.is_null(last)))
        starts[1:] |= differs.to_numpy(zero_copy_only=False)
    return starts


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches).combine_chunks() if batches else None


def range_ranks(df: DataFrame, groups: Sequence[str], order: Sequence[str], weights: Sequence[str], ties: Sequence[str] = (), rows: int = 0) -> DataFrame:
    """Add ``cum_<w>`` (weight up to and with this row) and ``all_<w>`` (of the group) for each weight.

    ``df`` must be unique by groups, order and ties (aggregate first: that also keeps equal values from
    piling up in one partition). With ``ties``, rows that differ only there are one value: ``cum_<w>`` then
    goes up to the end of the value, and ``at_<w>`` is the weight of the value. Weights are whole numbers,
    NULL counts 0. NULL group values are a group; NULL order values come first. An empty table gives an
    empty table. ``rows``, if known, bounds what a task holds (see ``ranged``).
    """
    groups, order, weights, ties = list(groups), list(order), list(weights), list(ties)
    added = ["cum", "all", *(["at"] if ties else [])]
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{p}_{w}", T.LongType()) for w in weights for p in added), T.StructField("_part", T.IntegerType()), T.StructField("_edge", T.BooleanType()), T.StructField("_open", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        starts = group_starts(table, groups)
        number = np.cumsum(starts) - 1
        first = np.flatnonzero(starts)
        last = np.append(first[1:], table.num_rows) - 1
        if ties:
            run_starts = starts | group_starts(table, order)
            run = np.cumsum(run_starts) - 1
            run_first = np.flatnonzero(run_starts)
            run_last = np.append(run_first[1:], table.num_rows) - 1
        for w in weights:
            x = table.column(w).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(x)
            before = (total - x)[first]
            upto = total[run_last][run] if ties else total
            table = table.append_column(f"cum_{w}", pa.array(upto - before[number]))
            table = table.append_column(f"all_{w}", pa.array((total[last] - before)[number]))
            if ties:
                table = table.append_column(f"at_{w}", pa.array((total[run_last] - (total - x)[run_first])[run]))
        table = table.append_column("_part", pa.array(np.full(table.num_rows, TaskContext.get().partitionId(), dtype=np.int32)))
        table = table.append_column("_edge", pa.array((number == 0) | (number == number[-1])))
        table = table.append_column("_open", pa.array((run == 0) | (run == run[-1]) if ties else np.zeros(table.num_rows, dtype=bool)))
        yield from table.to_batches(max_chunksize=20_000)

    columns = [*groups, *order, *ties]
    # groups may come in any order: their hash in front settles most comparisons of the sort
    columns = [F.xxhash64(*groups), *columns] if groups else columns
    local = written(ranged(df, *columns, rows=rows).mapInArrow(count, schema), "ranks")
    edges = local.where("_edge").groupBy(*groups, "_part").agg(*(F.max(f"all_{w}").alias(f"all_{w}") for w in weights))
    of_group = Window.partitionBy(*groups)
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*groups, "_part", F.count("*").over(of_group).alias("_n"), *(F.coalesce(F.sum(f"all_{w}").over(before), F.lit(0)).alias(f"off_{w}") for w in weights), *(F.sum(f"all_{w}").over(of_group).alias(f"tot_{w}") for w in weights)).where("_n > 1")

    def same(other: str, names: Sequence[str]) -> Column:
        condition = F.col("l._part") == F.col(f"{other}._part")
        for name in names:
            condition &= F.col(f"l.{name}").eqNullSafe(F.col(f"{other}.{name}"))
        return condition

    # two rows a partition at most
    joined = local.alias("l").join(F.broadcast(edges).alias("e"), same("e", groups), "left")
    later = {w: F.lit(0) for w in weights}
    if ties:
        of_run = Window.partitionBy(*groups, *order)
        after = of_run.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
        runs = local.where("_open").groupBy(*groups, *order, "_part").agg(*(F.max(f"at_{w}").alias(f"at_{w}") for w in weights))
        runs = runs.select(*groups, *order, "_part", F.count("*").over(of_run).alias("_n"), *(F.coalesce(F.sum(f"at_{w}").over(after), F.lit(0)).alias(f"later_{w}") for w in weights), *(F.sum(f"at_{w}").over(of_run).alias(f"run_{w}") for w in weights)).where("_n > 1")
        joined = joined.join(F.broadcast(runs).alias("r"), same("r", [*groups, *order]), "left")
        later = {w: F.coalesce(F.col(f"r.later_{w}"), F.lit(0)) for w in weights}
    sums = []
    for w in weights:
        sums.append((F.col(f"l.cum_{w}") + F.coalesce(F.col(f"e.off_{w}"), F.lit(0)) + later[w]).alias(f"cum_{w}"))
        sums.append(F.coalesce(F.col(f"e.tot_{w}"), F.col(f"l.all_{w}")).alias(f"all_{w}"))
        if ties:
            sums.append(F.coalesce(F.col(f"r.run_{w}"), F.col(f"l.at_{w}")).alias(f"at_{w}"))
    return joined.select(*(f"l.{c}" for c in df.columns), *sums)


def at_rank(value: Column, weight: Column, cum: Column, rank: Column) -> Column:
    """Aggregate: the value that holds the given rank (counted from 1) of its group."""
    return F.max(F.when((cum - weight < rank) & (rank <= cum), value))


def median_of(value: str, weight: str) -> Column:
    """Aggregate over ``range_ranks`` rows: the exact median, the mean of the middle two for an even count."""
    n, w, cum = F.col(f"all_{weight}"), F.coalesce(F.col(weight), F.lit(0)), F.col(f"cum_{weight}")
    low, high = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    return (at_rank(F.col(value), w, cum, low) + at_rank(F.col(value), w, cum, high)) / 2


def quantile_of(value: str, weight: str, share: float) -> Column:
    """Aggregate over ``range_ranks`` rows: the smallest value that at least ``share`` of the weight doesn't exceed."""
    n, w, cum = F.col(f"all_{weight}"), F.coalesce(F.col(weight), F.lit(0)), F.col(f"cum_{weight}")
    return at_rank(F.col(value), w, cum, F.greatest(F.lit(1), F.ceil(n * F.lit(share))))


def interpolated(value: str, weight: str, share: float) -> Column:
    """Aggregate over ``range_ranks`` rows: the percentile, linear between the two values it falls between."""
    n, w, cum = F.col(f"all_{weight}"), F.coalesce(F.col(weight), F.lit(0)), F.col(f"cum_{weight}")
    place = (n - 1) * F.lit(share)
    low = F.floor(place)
    a, b = at_rank(F.col(value), w, cum, low + 1), at_rank(F.col(value), w, cum, F.ceil(place) + 1)
    return a + (b - a) * F.max(place - low)


def moments(value: str, weight: str) -> list[Column]:
    """Aggregates for ``population_deviation`` of weighted values: n, mean and sum of squares."""
    v, w = F.col(value), F.col(weight)
    return [F.sum(w).alias("n"), (F.sum(v * w) / F.sum(w)).alias("mean"), F.sum(v * v * w).alias("squares")]


def population_deviation() -> Column:
    """The population standard deviation of ``moments``."""
    return F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - F.col("mean") * F.col("mean")))


def group_medians(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The exact median of ``value`` in each group, for groups of any size. NULL values don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    return range_ranks(counts, groups, [value], ["n"]).groupBy(*groups).agg(median_of(value, "n").alias("median"), F.max("all_n").alias("n"))
