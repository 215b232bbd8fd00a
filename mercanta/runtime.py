"""Session helpers: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One input table of the data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where that is unset (single-machine tests) a temporary folder is made.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if _local_dir is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_dir = tempfile.mkdtemp(prefix="mercanta-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return f"file://{_local_dir}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Later plans then depend on files only, so a lost executor costs no recomputation, and rows
    whose partition number was recorded stay in that partition. Parquet keeps column pruning.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mercanta/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession) -> None:
    """Remove every intermediate table; call it once the results that read them are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/mercanta")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of stored input for which a range sort makes a partition; what is read grows several times over in memory.
RANGE_BYTES = 32_000_000
#: Rows, where they are counted, for which a range sort makes a partition: what a Python worker takes as a whole.
RANGE_ROWS = 60_000
MOST_RANGES = 50_000


def ranged(df: DataFrame, *columns, rows: int = 0) -> DataFrame:
    """``df`` sorted by ranges of the columns, in as many parts as the session says or, for large inputs, as its bytes ask for.

    The bytes are those of the tables the plan reads, so a part is bounded however large the input and whatever the session says.
    Stored tables are packed, so bytes say little of what a part takes in Python: where ``rows`` are given, a part holds about
    RANGE_ROWS of them at most, and parts are not merged again.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    size = sum(n for n in sizes if n < 1 << 60)  # rows that came from nowhere have no known size
    parts = min(MOST_RANGES, max(size // RANGE_BYTES, -(-rows // RANGE_ROWS)))
    named = rows > RANGE_ROWS or parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, df.sparkSession.sparkContext.defaultParallelism) if rows > RANGE_ROWS else parts
    return (df.repartitionByRange(parts, *columns) if named else df.repartitionByRange(*columns)).sortWithinPartitions(*columns)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written beside its place and moved there, on whatever file system the path names."""
    fs, where = _file_system(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(where, False)
    fs.rename(beside, where)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small text file, None if there is none."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return None
    return "\n".join(r["value"] for r in small_rows(spark.read.text(path), 10_000))


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder, for files that a query writes and reads again."""
    return f"{shared_dir(spark)}/mercanta/{label}-{uuid.uuid4().hex}"


def bounded_broadcast(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """``df`` marked for broadcast if a count proves it small; else as it is, for a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def small_rows(df: DataFrame, most: int) -> list:
    """The rows of a table that is small by its nature; more rows than that are an error, never a silent cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of at most {most} rows was expected")
    return rows
