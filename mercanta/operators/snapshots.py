"""Differences between consecutive full snapshots (problem 6).

Keys are hashed into leaf buckets. A leaf's digest combines the hashes of its rows in any order; a
node's digest combines its children's. Trees of consecutive snapshots are compared from the root: only
children of differing nodes are looked at, and rows are compared only in leaves that differ. A snapshot's
leaf digests may be kept (``leaf_digests``) and given again, then only its rows in differing leaves are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercanta.runtime import bounded_broadcast, written

#: Rows that a leaf holds on average, and bits that one level of the tree takes off a bucket number.
LEAF_ROWS, LEVEL_BITS = 256, 4


def latest_rows(df: DataFrame, snapshot: str, key: str, version: Column, value: Column) -> DataFrame:
    """One row per snapshot and key, the one with the greatest version; reduced before the shuffle."""
    kept = df.groupBy(F.col(snapshot).alias("snapshot"), F.col(key).alias("key")).agg(F.max(F.struct(version.alias("v"), value.alias("value"))).alias("last"))
    return kept.select("snapshot", "key", F.col("last.value").alias("value"))


def _digest(row: Column) -> list[Column]:
    """Two order-free combinations of the row hashes, and the row count: equal for equal sets."""
    return [F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("s"), F.count("*").alias("n")]


def _above(level: DataFrame) -> DataFrame:
    mixed = F.xxhash64("x", "s", "n", "bucket")
    return level.groupBy("step", F.shiftright("bucket", LEVEL_BITS).alias("bucket")).agg(*_digest(mixed))


def _differing(level: DataFrame, parents: DataFrame | None) -> DataFrame:
    """Buckets of (step, bucket) whose digests differ between a snapshot and the one before it."""
    if parents is not None:
        p = parents.select(F.col("step").alias("p_step"), F.col("bucket").alias("p_bucket"))
        near = F.explode(F.array(F.col("step"), F.col("step") + 1))  # a snapshot takes part as later and as earlier one
        level = level.withColumn("pair", near).join(p, (F.col("pair") == F.col("p_step")) & (F.shiftright("bucket", LEVEL_BITS) == F.col("p_bucket")), "left_semi")
    else:
        level = level.withColumn("pair", F.explode(F.array(F.col("step"), F.col("step") + 1)))
    sides = level.groupBy("pair", "bucket").agg(*(F.max(F.when(F.col("step") == F.col("pair") - back, F.struct("x", "s", "n"))).alias(name) for name, back in (("now", 0), ("was", 1))))
    return sides.where(~F.col("now").eqNullSafe(F.col("was"))).select(F.col("pair").alias("step"), "bucket")


def _leaf(depth: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("key"), 64 - depth * LEVEL_BITS)


def tree_depth(rows_of_a_snapshot: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Levels below the root so that a leaf holds about ``leaf_rows`` rows."""
    return max(1, min(12, -(-max(1, rows_of_a_snapshot // leaf_rows).bit_length() // LEVEL_BITS)))


def leaf_digests(rows: DataFrame, depth: int) -> DataFrame:
    """(snapshot, bucket, x, s, n): the digest of each leaf of (snapshot, key, value). Combined before the shuffle."""
    return rows.groupBy("snapshot", _leaf(depth).alias("bucket")).agg(*_digest(F.xxhash64("key", F.col("value").isNull(), "value")))


def snapshot_changes(rows: DataFrame, order: DataFrame, leaf_rows: int = LEAF_ROWS, stored: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(snapshot, key, change_kind, old_value, new_value) for every snapshot but the first.

    ``rows``: (snapshot, key, value), unique by snapshot and key (see ``latest_rows``). ``order``:
    (snapshot, at), the complete snapshots; rows of others are left out. A NULL value is a value; NULL
    keys are one key. A snapshot without rows counts: everything was removed, then added. Number of
    snapshots: one row each in one window, the table of runs; rows and digests are spread over hash ranges.
    ``stored``: digests kept from ``leaf_digests`` at this ``depth``; snapshots in it are not hashed again.
    """
    steps = order.select("snapshot", (F.row_number().over(Window.orderBy("at", "snapshot"))).alias("step"))
    steps = bounded_broadcast(written(steps, "steps"))
    rows = written(rows.join(steps.select("snapshot"), "snapshot", "left_semi"), "snapshots")
    if depth is None:
        depth = tree_depth(rows.count() // max(1, steps.count()), leaf_rows)
    fresh = rows if stored is None else rows.join(stored.select("snapshot").distinct(), "snapshot", "left_anti")
    digests = leaf_digests(fresh, depth)
    digests = digests if stored is None else digests.unionByName(stored.select(digests.columns))
    levels = [written(digests.join(steps, "snapshot").drop("snapshot"), "leaves")]
    while len(levels) <= depth:
        levels.append(_above(levels[-1]))
    differing = None
    for level in reversed(levels):
        differing = _differing(level, differing)
    # a pair beyond the last snapshot has no later side; a row may be the later side of one pair and the earlier of the next
    last = steps.agg(F.max("step").alias("last"))
    differing = written(differing.join(F.broadcast(last), (F.col("step") <= F.col("last")) & (F.col("step") > 1), "left_semi"), "differing")
    sides = differing.select("bucket", F.col("step"), F.lit(True).alias("later"), F.lit(False).alias("earlier")).unionByName(differing.select("bucket", (F.col("step") - 1).alias("step"), F.lit(False).alias("later"), F.lit(True).alias("earlier")))
    sides = sides.groupBy("step", "bucket").agg(F.max("later").alias("later"), F.max("earlier").alias("earlier"))
    near = rows.join(steps, "snapshot").select("step", "key", "value", _leaf(depth).alias("bucket")).join(sides, ["step", "bucket"])
    # each row is moved once: at most one row a snapshot and key meet
    of_key = Window.partitionBy("key").orderBy("step")
    seen = near.select("step", "key", "value", "later", "earlier", F.lag(F.struct("step", "value")).over(of_key).alias("was"), F.lead("step").over(of_key).alias("next"))
    there = F.coalesce(F.col("was.step") == F.col("step") - 1, F.lit(False))
    kind = F.when(~there, "added").when(~F.col("value").eqNullSafe(F.col("was.value")), "changed")
    come = F.when(F.col("later") & kind.isNotNull(), F.struct(F.col("step").alias("step"), kind.alias("change_kind"), F.when(there, F.col("was.value")).alias("old_value"), F.col("value").alias("new_value")))
    gone = F.when(F.col("earlier") & ~F.coalesce(F.col("next") == F.col("step") + 1, F.lit(False)), F.struct((F.col("step") + 1).alias("step"), F.lit("removed").alias("change_kind"), F.col("value").alias("old_value"), F.when(F.lit(False), F.col("value")).alias("new_value")))
    changes = seen.select("key", F.explode(F.array_compact(F.array(come, gone))).alias("c")).select("key", "c.*")
    return changes.join(steps, "step").select("snapshot", "key", "change_kind", "old_value", "new_value")
