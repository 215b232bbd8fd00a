"""Writers: append without duplicates, upsert, replace, and text extracts. Tables are Parquet folders."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercanta.runtime import bounded_broadcast, exists, read_text, write_text, written


def first_of_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order. Rows with a NULL in the key never equal another and all stay."""
    some_null = F.lit(False)
    for c in key:
        some_null |= F.col(c).isNull()
    ranked = df.where(~some_null).withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")
    return ranked.unionByName(df.where(some_null))


def new_rows(existing: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of a batch that a unique key lets in: first of each key, and not in the table. NULL keys always pass."""
    return first_of_key(batch, key, order).join(existing.select(*key), list(key), "left_anti")


def upserted(existing: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table after an upsert: rows of the batch replace rows of the same key. The batch's key must be unique."""
    return existing.join(batch.select(*key), list(key), "left_anti").unionByName(batch, allowMissingColumns=True)


def without_stale(current: DataFrame, run_column: str, run: str) -> DataFrame:
    """Only rows of the given run; rows whose run is NULL go too."""
    return current.where(F.col(run_column).eqNullSafe(F.lit(run)))


def append_ignore(spark: SparkSession, path: str, batch: DataFrame, key: Sequence[str], order: Sequence[Column], day: str | None = None) -> dict[str, int]:
    """Append what the key lets in; returns extracted, loaded and skipped counts. A second run of the same batch loads 0.

    With ``day``, a column of the key, the table is partitioned by it and only the days of the batch are read.
    """
    there = exists(spark, path)
    batch = written(batch, "batch")
    if there:
        stored = spark.read.parquet(path)
        if day:
            stored = stored.join(bounded_broadcast(batch.select(day).distinct()), day, "left_semi")
        fresh = new_rows(stored, batch, key, order)
    else:
        fresh = first_of_key(batch, key, order)
    fresh = written(fresh, "fresh")
    extracted, loaded = batch.count(), fresh.count()
    if loaded or not there:
        (fresh.write.partitionBy(day) if day else fresh.write).mode("append").parquet(path)
    return {"extracted": extracted, "loaded": loaded, "skipped": extracted - loaded}


class VersionedTable:
    """A table whose versions are folders; readers take the version that the pointer file names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        return int(read_text(self.spark, f"{self.root}/CURRENT") or 0)

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.root}/v{v}") if v else None

    def replace(self, df: DataFrame) -> int:
        """Write a new version, then move the pointer: readers see the old rows or the new ones, never a mixture."""
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.root}/v{v}")
        write_text(self.spark, f"{self.root}/CURRENT", str(v))
        return v

    def upsert(self, batch: DataFrame, key: Sequence[str]) -> int:
        now = self.read()
        return self.replace(batch if now is None else upserted(now, batch, key))


def extract_columns(df: DataFrame) -> list[Column]:
    """Columns as a spreadsheet in Brazilian format takes them: decimal comma, sim/nao, lists joined, ISO dates, NULL as empty text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "boolean":
            value = F.when(c, "sim").when(~c, "nao")
        elif kind.startswith(("decimal", "double", "float")):
            value = F.translate(c.cast("string"), ".", ",")
        elif kind == "array<string>":
            value = F.array_join(c, " | ")
        elif kind.startswith(("struct", "map", "array")):
            value = F.to_json(c)
        elif kind == "timestamp":
            value = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        else:
            value = c.cast("string")
        out.append(F.coalesce(value, F.lit("")).alias(name))
    return out


def write_extract(df: DataFrame, path: str, single: bool = False) -> int:
    """Write ``df`` as ``;``-separated UTF-8 text with a header; returns the row count. ``single``: one file, for small extracts."""
    out = written(df.select(*extract_columns(df)), "extract")
    (out.coalesce(1) if single else out).write.mode("overwrite").options(header=True, sep=";", escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return out.count()


def write_fields(df: DataFrame, fields: Sequence[str], path: str) -> None:
    """Write the given fields as ``,``-separated text; fields that ``df`` lacks are empty, others are left out."""
    df.select(*(F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields)).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_extracts(extracts: dict[str, DataFrame], folder: str) -> dict:
    """Write named extracts and a manifest with their row counts."""
    counts = {name: write_extract(df, f"{folder}/{name}") for name, df in sorted(extracts.items())}
    manifest = {"files": counts, "rows": sum(counts.values())}
    some = next(iter(extracts.values()), None)
    if some is not None:
        write_text(some.sparkSession, f"{folder}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2, sort_keys=True))
    return manifest


def run_events(existing: DataFrame | None, event: DataFrame) -> DataFrame:
    """Audit rows are only appended: starts and ends are events (id, at, status, …)."""
    return event if existing is None else existing.unionByName(event, allowMissingColumns=True)


def current_runs(events: DataFrame) -> DataFrame:
    """The state of each run: its latest event."""
    return events.withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at"), F.desc("status")))).where("_rank = 1").drop("_rank")
