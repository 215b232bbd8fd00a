"""Mixing sources to target shares of tokens (problem 9).

Each source needs a mean number of copies per document; its whole part is taken of every document, its
fraction is an inclusion probability. The cube method settles the fractions: probabilities move along
directions that change neither the total of tokens nor the number of documents until they are 0 or 1.
Workers move their own documents; the two that each leaves open per source meet in a small last round,
and what is open then lands on the nearest totals. A few settled documents of every worker come along, so that
what landing leaves over or short in tokens can be made up by exchanging two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercanta.llm.tokens import token_counts
from mercanta.runtime import bounded_broadcast, small_rows, written

_OUT = "mixture_name string, source string, doc_id bigint, tokens bigint, base int, p double, swap boolean"
_EPS = 1e-9
#: Settled documents that a worker passes on per mixture and source, and exchanges made at most.
SWAPS, EXCHANGES = 32, 16


def _lanes(tokens: np.ndarray, p: np.ndarray, lanes: int, rng: np.random.Generator) -> np.ndarray:
    """One flight in parallel lanes: p with at most two open entries a lane. Totals of p and of p x tokens stay."""
    p = p.copy()
    n = len(p)
    # large documents first in every lane: what stays open at the end is small
    order = np.argsort(-tokens, kind="stable")
    queue = np.concatenate([order[i::lanes] for i in range(lanes)])
    bounds = np.cumsum([0, *(len(order[i::lanes]) for i in range(lanes))])
    at, end = bounds[:-1] + 3, bounds[1:]
    slot = bounds[:-1][:, None] + np.arange(3)[None, :]
    live = (end - bounds[:-1]) >= 3
    while live.any():
        lane = np.flatnonzero(live)
        s = queue[slot[lane]]
        t, x = tokens[s].astype(float), p[s]
        u = np.stack([t[:, 1] - t[:, 2], t[:, 2] - t[:, 0], t[:, 0] - t[:, 1]], 1)
        u = np.where(np.abs(u).max(1, keepdims=True) > 0, u, np.array([1.0, -1.0, 0.0]))
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)).min(1)
            down = np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)).min(1)
        forward = rng.random(len(lane)) * (up + down) < down
        x = x + np.where(forward, up, -down)[:, None] * u
        x = np.where(x < _EPS, 0.0, np.where(x > 1 - _EPS, 1.0, x))
        p[s] = x
        for k in range(3):  # settled entries leave their slot to the next of the lane
            done = (x[:, k] == 0) | (x[:, k] == 1)
            more = at[lane] < end[lane]
            take = lane[done & more]
            slot[take, k] = at[take]
            at[take] += 1
            live[lane[done & ~more]] = False
    return p


def flight(tokens: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved until at most two are open."""
    p = np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p))
    lanes = max(1, len(p) // 256)
    while True:
        is_open = np.flatnonzero((p > 0) & (p < 1))
        if len(is_open) <= 2:
            return p
        lanes = max(1, min(lanes, len(is_open) // 12))
        p[is_open] = _lanes(tokens[is_open], p[is_open], lanes, rng)
        if lanes == 1:
            break
        lanes //= 8
    return flight(tokens, p, rng) if ((p > 0) & (p < 1)).sum() > 2 else p


def landing(tokens: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The open entries, two at most, set to 0 or 1 nearest to the totals: tokens first, then documents."""
    is_open = np.flatnonzero((p > 0) & (p < 1))
    if not len(is_open):
        return p
    want, many = float((p[is_open] * tokens[is_open]).sum()), float(p[is_open].sum())
    best = min(product((0.0, 1.0), repeat=len(is_open)), key=lambda c: (abs(np.dot(c, tokens[is_open]) - want), abs(sum(c) - many)))
    p = p.copy()
    p[is_open] = best
    return p


def exchanged(tokens: np.ndarray, p: np.ndarray, want: float) -> np.ndarray:
    """Settled probabilities changed while that brings the tokens nearer to ``want``: a taken and a left document
    exchanged, or, where no exchange is as near, a single one taken or left."""
    p = p.copy()
    for _ in range(EXCHANGES):
        short = want - float((p * tokens).sum())
        taken, left = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        left = left[np.argsort(tokens[left], kind="stable")]
        tries = [(np.abs(short - tokens[left]), None, left), (np.abs(short + tokens[taken]), taken, None)]
        if len(taken) and len(left):
            near = np.searchsorted(tokens[left], tokens[taken] + short)
            for k in (-1, 0):
                other = left[np.clip(near + k, 0, len(left) - 1)]
                tries.insert(0, (np.abs(short - (tokens[other] - tokens[taken])), taken, other))
        rest, out, into = _nearest(tries)
        if rest >= abs(short):
            break
        if out is not None:
            p[out] = 0.0
        if into is not None:
            p[into] = 1.0
    return p


def _nearest(tries: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]) -> tuple[float, int | None, int | None]:
    """The least distance of all tries, with the document it leaves and the one it takes."""
    best: tuple[float, int | None, int | None] = (np.inf, None, None)
    for rest, out, into in tries:
        if len(rest) and rest.min() < best[0]:
            i = int(rest.argmin())
            best = (float(rest[i]), None if out is None else int(out[i]), None if into is None else int(into[i]))
    return best


def plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(mixture_name, source, target_share, max_repeats, have, copies): mean copies per document for the largest total that no cap forbids.

    Sources of a mixture that have no tokens can't contribute and don't limit the others.
    """
    have = counts.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("docs"))
    wanted = targets.where("target_share > 0 AND max_repeats > 0").join(have, "source", "left")
    room = F.when(F.col("have") > 0, F.col("max_repeats") * F.col("have") / F.col("target_share"))
    total = wanted.groupBy("mixture_name").agg(F.min(room).alias("total"))
    return wanted.join(total, "mixture_name").select("mixture_name", "source", "target_share", "max_repeats", "have", "docs", "total", F.least(F.col("max_repeats").cast("double"), F.col("total") * F.col("target_share") / F.col("have")).alias("copies"))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Chosen documents (mixture_name, source, doc_id, tokens, copies >= 1) and the plan they follow.

    Documents without tokens, without source or of a source that no mixture names are never chosen. Repeated
    rows are documents of their own. Draws depend on the seed and on the partition, so a retry draws alike.
    The plan has one row per target and goes to the workers with the task.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    counts = written(token_counts(docs, "text", ["doc_id", "source"]), "tokens")
    planned = written(plan(counts, targets), "plan")
    rows = [r.asDict() for r in small_rows(planned.where("copies > 0").select("mixture_name", "source", "copies"), 10_000)]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        frame = pa.Table.from_batches(batches).to_pandas()
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        by_source = dict(tuple(frame[frame["tokens"] > 0].groupby("source")))
        for r in rows:
            part = by_source.get(r["source"])
            if part is None:
                continue
            base = int(np.floor(r["copies"] + _EPS))
            p = flight(part["tokens"].to_numpy(), np.full(len(part), max(0.0, r["copies"] - base)), rng)
            is_open = (p > 0) & (p < 1)
            swap = np.zeros(len(part), dtype=bool)
            settled = np.flatnonzero(~is_open)
            swap[rng.choice(settled, min(SWAPS, len(settled)), replace=False)] = True
            out = pa.table({"mixture_name": pa.array([r["mixture_name"]] * len(part)), "source": pa.array([r["source"]] * len(part)), "doc_id": pa.array(part["doc_id"].to_numpy()), "tokens": pa.array(part["tokens"].to_numpy()), "base": pa.array(np.full(len(part), base, dtype=np.int32)), "p": pa.array(p), "swap": pa.array(swap)})
            yield from out.filter(pa.array((p > 0) | (base > 0) | swap)).combine_chunks().to_batches(max_chunksize=20_000)

    def land(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"]).reset_index(drop=True)
        t = pdf["tokens"].to_numpy()
        p = pdf["p"].to_numpy()
        landed = landing(t, flight(t, p, np.random.default_rng(seed)))
        return pdf.assign(p=exchanged(t, landed, float((p * t).sum())))

    moved = written(counts.mapInArrow(settle, _OUT), "moved")
    is_open = ((F.col("p") > 0) & (F.col("p") < 1)) | F.col("swap")
    landed = moved.where(is_open).groupBy("mixture_name", "source").applyInPandas(land, _OUT)
    chosen = moved.where(~is_open).unionByName(landed).select("mixture_name", "source", "doc_id", "tokens", (F.col("base") + F.round("p").cast("int")).alias("copies")).where("copies > 0")
    return chosen, planned


def reached_shares(chosen: DataFrame, planned: DataFrame) -> DataFrame:
    """Target and reached share of each source in each mixture, with its documents, copies and tokens."""
    got = chosen.groupBy("mixture_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("used_documents"), F.sum("copies").alias("used_copies"), F.max("copies").alias("most_copies"))
    whole = got.groupBy("mixture_name").agg(F.sum("used_tokens").alias("mixture_tokens"))
    joined = planned.join(got, ["mixture_name", "source"], "left").join(bounded_broadcast(whole), "mixture_name", "left")
    used = F.coalesce("used_tokens", F.lit(0))
    return joined.select("mixture_name", "source", "target_share", F.coalesce(F.try_divide(used, F.col("mixture_tokens")), F.lit(0.0)).alias("reached_share"), used.alias("used_tokens"), F.coalesce("used_documents", F.lit(0)).alias("used_documents"), F.coalesce("used_copies", F.lit(0)).alias("used_copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
