"""Filling containers of fixed capacity (problem 8).

Harmonic packing: an item of size in (C/(k+1), C/k] is of class k, and a bin of class k takes k of them,
whatever they measure. Each worker fills its own bins, without a shuffle. Space left in a bin takes items
of the first class that fits by its bound, again by class alone. Items in bins that a worker couldn't
complete, at most one a class and container, are pooled for several workers and packed best-fit.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercanta.llm.tokens import token_counts
from mercanta.runtime import small_rows, written

#: A class for every LEAST_PIECE tokens of capacity; items smaller than that bound are filled in one after another.
LEAST_PIECE = 32
ROUNDS = 8
POOLED_WORKERS = 32
_OUT = "container_name string, capacity bigint, worker bigint, bin bigint, doc_id bigint, piece int, tokens bigint, loose boolean"


def harmonic(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item (sizes from 1 to capacity) and whether its bin is left for pooling."""
    n = len(sizes)
    classes = max(8, capacity // LEAST_PIECE)
    bins = np.full(n, -1, dtype=np.int64)
    loose = np.zeros(n, dtype=bool)
    kind = np.minimum(capacity // np.maximum(sizes, 1), classes)
    queues = [np.flatnonzero(kind == k) for k in range(classes + 1)]
    at = np.zeros(classes + 1, dtype=np.int64)
    made = 0
    for k in range(1, classes + 1):
        items = queues[k][at[k] :]
        if k == classes:  # the smallest: their bound says little, so their bins fill up by size
            reach = np.cumsum(sizes[items])
            start, done = 0, 0
            while start < len(items):
                stop = int(np.searchsorted(reach, done + capacity, "right"))
                bins[items[start:stop]] = made
                loose[items[start:stop]] = stop == len(items)
                made += 1
                start, done = stop, int(reach[stop - 1])
            break
        whole = len(items) // k
        if whole:
            members = items[: whole * k].reshape(whole, k)
            ids = made + np.arange(whole)
            bins[members] = ids[:, None]
            left = capacity - sizes[members].sum(1)
            made += whole
            for _ in range(ROUNDS):
                # the first class whose bound fits the space left: any item of it fits
                need = np.where((left > 0) & (left * classes >= capacity), np.maximum(-(-capacity // np.maximum(left, 1)), k + 1), classes + 1)
                took = 0
                for j in range(k + 1, classes + 1):
                    hosts = np.flatnonzero(need == j)
                    free = queues[j][at[j] : at[j] + len(hosts)]
                    m = len(free)
                    bins[free] = ids[hosts[:m]]
                    left[hosts[:m]] -= sizes[free]
                    at[j] += m
                    took += m
                    need[hosts[m:]] += 1  # that class is used up; the next one fits as well
                if not took:
                    break
        rest = items[whole * k :]
        if len(rest):
            bins[rest] = made
            loose[rest] = True
            made += 1
        at[k] = len(queues[k])
    return bins, loose


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: the largest first, into the fullest bin that still takes it."""
    bins = np.empty(len(sizes), dtype=np.int64)
    free: list[tuple[int, int]] = []
    made = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        k = bisect_left(free, (size, -1))
        if k < len(free):
            left, b = free.pop(k)
        else:
            left, b = capacity, made
            made += 1
        bins[i] = b
        if left > size:
            insort(free, (left - size, b))
    return bins


def pieces(counts: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Documents as items: longer ones cut into full pieces and a rest, all others whole. Sizes 0 give none."""
    tokens = counts["tokens"].to_numpy()
    n = -(-tokens // capacity)
    row = np.repeat(np.arange(len(tokens)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(capacity, tokens[row] - piece * capacity)
    return pd.DataFrame({"doc_id": counts["doc_id"].to_numpy()[row], "piece": piece.astype(np.int32), "tokens": size})


def pack(documents: DataFrame, containers: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(container_name, capacity, bin_id, doc_id, piece, tokens) for each container size.

    ``containers`` (container_name, capacity_tokens) is a table of a few rows, collected; sizes that are
    NULL or under 1 are left out. Documents of no tokens (NULL or empty text) come out once per container
    with bin_id NULL. Repeated rows are items of their own. No document is cut unless it is longer than the
    container. Workers are the partitions of the written token table, so a retry makes the same bins.
    """
    sizes = [(r[0], int(r[1])) for r in small_rows(containers.select("container_name", "capacity_tokens").where("capacity_tokens >= 1"), 1000)]
    counts = written(token_counts(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "text", ["doc_id"]), "tokens")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        frame = pa.Table.from_batches(batches).to_pandas()
        worker = TaskContext.get().partitionId()
        for name, capacity in sizes:
            empty = frame[frame["tokens"] == 0]
            items = pieces(frame, capacity)
            bins, loose = harmonic(items["tokens"].to_numpy(), capacity)
            items = items.assign(container_name=name, capacity=capacity, worker=worker, bin=bins, loose=loose)
            rows = pd.concat([items, pd.DataFrame({"container_name": name, "capacity": capacity, "worker": worker, "bin": -1, "doc_id": empty["doc_id"], "piece": 0, "tokens": 0, "loose": False})])
            schema = pa.schema([("container_name", pa.string()), ("capacity", pa.int64()), ("worker", pa.int64()), ("bin", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int64()), ("loose", pa.bool_())])
            for start in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_pandas(rows.iloc[start : start + 20_000][schema.names], schema=schema, preserve_index=False)

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["worker", "bin", "doc_id", "piece"]).reset_index(drop=True)
        return pdf.assign(bin=best_fit(pdf["tokens"].to_numpy(), int(pdf["capacity"].iloc[0])), worker=-1 - pdf["worker"].iloc[0] // POOLED_WORKERS)

    filled = written(counts.mapInArrow(fill, _OUT), "filled")
    pooled = filled.where("loose").groupBy("container_name", F.expr(f"worker div {POOLED_WORKERS}")).applyInPandas(pool, _OUT)
    rows = filled.where("NOT loose").unionByName(pooled)
    bin_id = F.when(F.col("tokens") > 0, F.concat_ws("-", "container_name", "worker", "bin"))
    return rows.select("container_name", "capacity", bin_id.alias("bin_id"), "doc_id", "piece", "tokens")
