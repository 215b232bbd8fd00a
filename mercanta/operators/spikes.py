"""Implausible readings of numeric series (problem 5).

Per source a hidden Markov model with the states normal, spike, stuck and out-of-range: its scale comes from the
source's own behaviour (median absolute log step, share of repeated readings), its transitions and emissions are
fitted by a round of expectation and maximisation over all readings of the source. Forward-backward probabilities
decide the state of each reading, out-of-range by hard bounds; what the model flags is then held against the exact
definition of a spike or a stuck run.

A series may hold any share of the rows: readings are range-sorted by series and time, so a long series
spans partitions. A partition settles all readings but those within CONTEXT of where a series may go on
in the next partition; these, at most 4 x CONTEXT rows a partition, are settled together afterwards.
Partitions are cut by rows (RANGE_ROWS), so what a Python worker holds doesn't grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercanta.operators.ranks import group_starts, median_of, range_ranks
from mercanta.runtime import bounded_broadcast, ranged, written

LEAST, MOST = 0.01, 1_000_000.0
STEPS, LEAST_SHARE = 6.0, 0.02
STUCK_RUN, SELDOM = 8, 0.3
CONTEXT = 32
#: A reading is in a state if that is more likely than not.
DECIDED = 0.5
CHUNK = 256
KEYS = ["field_name", "source", "series"]

#: Where the fit of a source starts, and for how many readings that counts: transitions between normal, spike, stuck and out-of-range, the states of a series' first reading, the width of spikes (log), and how often stuck readings are equal.
_MOVE = np.array([[0.965, 0.015, 0.015, 0.005], [0.675, 0.30, 0.02, 0.005], [0.10, 0.01, 0.885, 0.005], [0.90, 0.04, 0.01, 0.05]])
_START = np.array([0.955, 0.02, 0.02, 0.005])
_WIDTH, _EQUAL, _PRIOR_READINGS = 7.0, 0.99, 200.0
#: Layout of a source's parameters: median absolute log step, share of repeats, scale of normal deviations, width of spikes, share of equal stuck readings, transitions.
MAD, REPEATS, SCALE, WIDTH, EQUAL, MOVES = range(6)
N_PARAMETERS = MOVES + _MOVE.size


def _level(v: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Median over the last axis of up to three values; NaN where fewer than two are there."""
    x = np.sort(np.where(ok, v, np.inf), axis=-1)
    n = ok.sum(axis=-1)
    return np.where(n == 3, x[..., 1], np.where(n == 2, (x[..., 0] + np.where(n >= 2, x[..., 1], 0)) / 2, np.nan))


class _Series:
    """Readings of whole series or parts of them, sorted; neighbours are looked up by offset."""

    def __init__(self, group: np.ndarray, v: np.ndarray):
        self.n, self.group, self.v = len(v), group, v
        self.pad_v = np.pad(v, 4)
        self.pad_g = np.pad(group, 4, constant_values=-1)

    def at(self, i: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        j = np.clip(i + offset + 4, 0, self.n + 7)
        g = self.group[np.clip(i, 0, self.n - 1)]
        return self.pad_v[j], self.pad_g[j] == g

    def around(self, i: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Levels of the three readings before i and of the three after i + length - 1."""
        before = [self.at(i, -k) for k in (1, 2, 3)]
        after = [self.at(i, length - 1 + k) for k in (1, 2, 3)]
        return tuple(_level(np.stack([a for a, _ in side], -1), np.stack([b for _, b in side], -1)) for side in (before, after))


def _off(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far x is off both levels in the same direction; 0 if it isn't."""
    a, b = x - before, x - after
    return np.where(a * b > 0, np.sign(a) * np.minimum(np.abs(a), np.abs(b)), 0.0)


def _deviation(s: _Series) -> np.ndarray:
    """The largest of the ways in which a reading, alone or with a neighbour, is off the levels around it."""
    i = np.arange(s.n)
    best = np.nan_to_num(_off(s.v, *s.around(i, 1)))
    for start in (0, -1):
        j = i + start
        other, there = s.at(i, 1 if start == 0 else -1)
        before, after = s.around(np.clip(j, 0, s.n - 1), 2)
        pair = np.nan_to_num(np.where(there, np.minimum(np.abs(_off(s.v, before, after)), np.abs(_off(other, before, after))), 0.0))
        best = np.where(pair > np.abs(best), pair * np.sign(s.v - np.nan_to_num(before)), best)
    return best


def _spikes(s: _Series, mad: np.ndarray) -> np.ndarray:
    """The exact rule: one or two readings off both levels, the readings next to them not off."""
    limit = STEPS * mad
    i = np.arange(s.n)
    hit = np.zeros(s.n, dtype=bool)

    def far(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        d = np.nan_to_num(_off(x, before, after))
        return np.where((np.abs(d) > limit) & (np.abs(np.expm1(d)) >= LEAST_SHARE), np.sign(d), 0)

    for length in (1, 2):
        before, after = s.around(i, length)
        sign = far(s.v, before, after)
        if length == 2:
            x, there = s.at(i, 1)
            sign = np.where(there & (far(x, before, after) == sign), sign, 0)
        for offset in (-1, length):
            x, there = s.at(i, offset)
            sign = np.where(there & (far(x, before, after) == sign), 0, sign)
        hit |= sign != 0
        if length == 2:
            hit[1:] |= (sign != 0)[:-1]
    return hit


def _run_lengths(s: _Series, raw: np.ndarray) -> np.ndarray:
    starts = np.ones(s.n, dtype=bool)
    starts[1:] = (s.group[1:] != s.group[:-1]) | (raw[1:] != raw[:-1])
    run = np.cumsum(starts) - 1
    return np.bincount(run)[run]


def _emissions(deviation: np.ndarray, equal: np.ndarray, inside: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How likely each state shows what was read; ``q`` holds a row of parameters per reading."""
    r = np.clip(q[:, REPEATS], 0.001, 0.999)
    k = np.clip(q[:, EQUAL], 0.5, 0.999)
    normal = -0.5 * (deviation / q[:, SCALE]) ** 2 - np.log(q[:, SCALE] * 2.5066)
    limit = np.maximum(STEPS * q[:, MAD], np.log1p(LEAST_SHARE))
    # spikes lie beyond what the source's own steps reach
    spike = np.where(np.abs(deviation) > 0.98 * limit, -np.log(2 * np.maximum(q[:, WIDTH], limit)), -np.inf)
    e = np.stack([normal + np.log(np.where(equal, r, 1 - r)), spike, normal + np.log(np.where(equal, k, 1 - k)), np.full(len(q), -np.inf)], 1)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    e[~inside] = [0.0, 0.0, 0.0, 1.0]
    return e


def posteriors(group: np.ndarray, e: np.ndarray, q: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over all series at once; long ones in chunks that overlap by CONTEXT.

    Gives the probability of each state and, with ``counts``, the expected transitions out of each reading (4 x 4).
    """
    n, states = e.shape
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    length = np.diff(np.r_[first, n])
    chunks = -(-length // CHUNK)
    owner = np.repeat(np.arange(len(first)), chunks)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    lo = first[owner] + k * CHUNK
    hi = np.minimum(lo + CHUNK, first[owner] + length[owner])
    a, b = np.maximum(lo - CONTEXT, first[owner]), np.minimum(hi + CONTEXT, first[owner] + length[owner])
    out = np.zeros((n, states))
    moved = np.zeros((n, states, states)) if counts else None
    width = 1 << np.ceil(np.log2(np.maximum(b - a, 1))).astype(int)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        for part in np.array_split(mine, max(1, len(mine) * w // 200_000)):
            index = a[part][:, None] + np.arange(w)[None, :]
            inside = index < b[part][:, None]
            x = np.where(inside[..., None], e[np.minimum(index, n - 1)], 1.0)
            move = q[a[part], MOVES:].reshape(-1, states, states)
            fwd = np.empty_like(x)
            f = _START * x[:, 0]
            fwd[:, 0] = f / f.sum(1, keepdims=True)
            for t in range(1, w):
                f = (fwd[:, t - 1, :, None] * move).sum(1) * x[:, t]
                fwd[:, t] = f / f.sum(1, keepdims=True)
            own = inside & (index >= lo[part][:, None]) & (index < hi[part][:, None])
            back = np.ones((len(part), states))
            for t in range(w - 1, -1, -1):
                p = fwd[:, t] * back
                p /= p.sum(1, keepdims=True)
                if counts and t:
                    pair = fwd[:, t - 1, :, None] * move * (x[:, t] * back)[:, None, :]
                    pair /= pair.sum((1, 2), keepdims=True)
                    moved[index[own[:, t], t] - 1] = pair[own[:, t]]
                y = back * x[:, t]
                back = (move * y[:, None, :]).sum(2)
                back = np.where(inside[:, t][:, None], back / back.sum(1, keepdims=True), 1.0)
                fwd[:, t] = p
            out[index[own]] = fwd[own]
    if counts:
        moved[np.r_[first[1:] - 1, n - 1]] = 0.0
    return out, moved


class _Readings:
    """Sorted readings with what the model sees of them; those out of range take no part in levels and runs."""

    def __init__(self, group: np.ndarray, raw: np.ndarray, q: np.ndarray):
        self.group, self.q = group, q
        self.inside = (raw > LEAST) & (raw < MOST)
        self.i = np.flatnonzero(self.inside)
        self.raw = raw[self.i]
        self.series = _Series(group[self.i], np.log(self.raw))
        self.deviation, self.equal = np.zeros(len(raw)), np.zeros(len(raw), dtype=bool)
        if len(self.i):
            self.deviation[self.i] = _deviation(self.series)
            same = (self.raw[1:] == self.raw[:-1]) & (self.series.group[1:] == self.series.group[:-1])
            self.equal[self.i[1:]] |= same
            self.equal[self.i[:-1]] |= same
        self.emissions = _emissions(self.deviation, self.equal, self.inside, q)


def _judge(group: np.ndarray, raw: np.ndarray, q: np.ndarray, sticky: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the states, and the flag ('' for none), for sorted readings; with ``exact`` the definition has a say."""
    x = _Readings(group, raw, q)
    p, _ = posteriors(group, x.emissions, q)
    spike, stuck = p[:, 1] > DECIDED, (p[:, 2] > DECIDED) & sticky & (q[:, REPEATS] < SELDOM)
    if exact and len(x.i):
        spike[x.i] &= _spikes(x.series, q[x.i, MAD])
        stuck[x.i] &= _run_lengths(x.series, x.raw) >= STUCK_RUN
    return p, np.where(p[:, 3] > DECIDED, "out_of_range", np.where(spike, "spike", np.where(stuck, "stuck", "")))


_OUT = "field_name string, source string, series string, at bigint, outside boolean, value double, p_spike double, p_stuck double, flag string, parameters array<double>, sticky boolean, open boolean, gap boolean, number bigint"


def _parameters(table: pa.Table) -> np.ndarray:
    return table.column("parameters").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_PARAMETERS)


def _settle(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[pa.RecordBatch]:
    """Flags of a partition's readings, and its open readings with their context (flag NULL)."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    raw = table.column("value").to_numpy()
    group = np.cumsum(group_starts(table, KEYS)) - 1
    sticky = table.column("sticky").combine_chunks().to_numpy(zero_copy_only=False)
    p, flag = _judge(group, raw, _parameters(table), sticky, exact)
    n = len(raw)
    is_open, kept, gap = (np.zeros(n, dtype=bool) for _ in range(3))
    head = np.searchsorted(group, 0, "right")  # the first series' readings are [0, head)
    tail = np.searchsorted(group, group[-1], "left")
    is_open[: min(head, CONTEXT)] = True
    kept[: min(head, 2 * CONTEXT)] = True
    is_open[max(tail, n - CONTEXT) :] = True
    kept[max(tail, n - 2 * CONTEXT) :] = True
    if n - 2 * CONTEXT > 2 * CONTEXT and tail == 0:
        gap[n - 2 * CONTEXT] = True
    flagged = (flag != "") & ~is_open
    for rows, is_context in ((flagged, False), (kept, True)):
        i = np.flatnonzero(rows)
        if not len(i):
            continue
        part = table.take(pa.array(i))
        columns = {c: part[c] for c in (*KEYS, "at", "outside", "value")} | {"p_spike": pa.array(p[i, 1]), "p_stuck": pa.array(p[i, 2]), "flag": pa.nulls(len(i), pa.string()) if is_context else pa.array(flag[i].tolist(), pa.string())}
        columns |= {"parameters": part["parameters"], "sticky": part["sticky"], "open": pa.array(is_open[i]), "gap": pa.array(gap[i]), "number": pa.array(i)}
        yield from pa.table(columns).combine_chunks().to_batches()


def _expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per field and source, what the states of a partition's readings add up to: the sums that the parameters are fitted to."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    group = np.cumsum(group_starts(table, KEYS)) - 1
    x = _Readings(group, table.column("value").to_numpy(), _parameters(table))
    p, moved = posteriors(group, x.emissions, x.q, counts=True)
    of_source = np.cumsum(group_starts(table, KEYS[:2])) - 1
    first = np.flatnonzero(np.r_[True, of_source[1:] != of_source[:-1]])
    normal, spike, stuck = p[:, 0] * x.inside, p[:, 1], p[:, 2]
    sums = np.column_stack([normal, normal * x.deviation**2, spike, spike * np.abs(x.deviation), stuck, stuck * x.equal, moved.reshape(len(p), -1)])
    sums = np.add.reduceat(sums, first, axis=0)
    rows = table.select(KEYS[:2]).take(pa.array(first))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
    yield from pa.table({"field_name": rows["field_name"], "source": rows["source"], "sums": flat}).combine_chunks().to_batches()


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Absolute log step to the reading before it in the same series; first and last reading of the partition marked."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    starts = group_starts(table, KEYS)
    v = np.log(table.column("value").to_numpy())
    step = np.full(len(v), np.nan)
    step[1:] = np.where(starts[1:], np.nan, np.abs(np.diff(v)))
    edge = np.zeros(len(v), dtype=bool)
    edge[[0, -1]] = True
    keep = np.flatnonzero(~np.isnan(step) | edge)
    part = table.take(pa.array(keep))
    step = pa.array(step[keep], from_pandas=True)
    yield from pa.table({"field_name": part["field_name"], "source": part["source"], "series": part["series"], "at": part["at"], "value": part["value"], "step": step, "edge": pa.array(edge[keep]), "number": pa.array(np.arange(len(keep)))}).combine_chunks().to_batches(max_chunksize=20_000)


def source_behaviour(readings: DataFrame) -> DataFrame:
    """Per field and source: the exact median absolute log step between neighbours (mad) and the share of repeats."""
    in_order = ranged(readings, *KEYS, "at", rows=readings.count())
    steps = written(in_order.mapInArrow(_steps, "field_name string, source string, series string, at bigint, value double, step double, edge boolean, number bigint"), "steps")
    series = Window.partitionBy(*KEYS).orderBy("at")
    # two readings a partition: the step between partitions of one series
    border = steps.where("edge").withColumn("step", F.when(F.col("step").isNull(), F.abs(F.ln("value") - F.ln(F.lag("value").over(series)))))
    all_steps = steps.where("step IS NOT NULL").select("field_name", "source", "step").unionByName(border.where("step IS NOT NULL").select("field_name", "source", "step"))
    all_steps = written(all_steps.groupBy("field_name", "source", "step").agg(F.count("*").alias("n")), "step-counts")
    mads = range_ranks(all_steps, ["field_name", "source"], ["step"], ["n"], rows=all_steps.count()).groupBy("field_name", "source").agg(median_of("step", "n").alias("mad"), F.sum(F.when(F.col("step") == 0, F.col("n")).otherwise(0)).alias("same"), F.sum("n").alias("steps"))
    return mads.select("field_name", "source", "mad", (F.col("same") / F.col("steps")).alias("repeats"))


def _started(behaviour: DataFrame) -> DataFrame:
    """(field_name, source, parameters) where the fit of each source starts."""
    mad, repeats = F.coalesce("mad", F.lit(0.0)), F.coalesce("repeats", F.lit(1.0))
    start = F.array(mad, repeats, F.greatest(1.05 * mad, F.lit(LEAST_SHARE / STEPS)), F.lit(_WIDTH), F.lit(_EQUAL), *(F.lit(float(m)) for m in _MOVE.ravel()))
    return behaviour.select("field_name", "source", start.alias("parameters"))


def _fitted(started: DataFrame, expected: DataFrame) -> DataFrame:
    """The parameters that fit the expected states best; the starting ones count as much as _PRIOR_READINGS readings."""
    size = 6 + _MOVE.size
    sums = expected.groupBy("field_name", "source").agg(F.array(*(F.sum(F.element_at("sums", i + 1)) for i in range(size))).alias("s"))
    old, s = (lambda i: F.element_at("parameters", i + 1)), (lambda i: F.coalesce(F.element_at("s", i + 1), F.lit(0.0)))
    share = lambda above, below, prior: (above + _PRIOR_READINGS * prior) / (below + _PRIOR_READINGS)
    scale = F.greatest(old(SCALE), F.sqrt(share(s(1), s(0), old(SCALE) * old(SCALE))))
    moves = []
    for i in range(len(_MOVE)):
        row = sum((s(6 + i * len(_MOVE) + j) for j in range(len(_MOVE))), F.lit(0.0))
        moves += [share(s(6 + i * len(_MOVE) + j), row, old(MOVES + i * len(_MOVE) + j)) for j in range(len(_MOVE))]
    # of a uniform width the mean is the middle
    fitted = F.array(old(MAD), old(REPEATS), scale, 2 * share(s(3), s(2), old(WIDTH) / 2), share(s(5), s(4), old(EQUAL)), *moves)
    return started.join(sums, ["field_name", "source"], "left").select("field_name", "source", fitted.alias("parameters"))


def implausible(rows: DataFrame, exact: bool = True) -> DataFrame:
    """Flagged rows of (table_name, id, field_name, source, series, at, value, sticky): flag and probabilities added.

    ``at`` orders a series (bigint), ``sticky`` tells whether stuck runs are cases in that field. Rows with
    NULL series, time or value are no readings. Repeated rows (same series and time) are one reading, the
    least value, and are all flagged. Zero and negative values are out of range. Sources without two
    neighbouring readings have nothing to measure against: only the hard bounds hold. Empty in, empty out.
    With ``exact``, spikes and stuck runs of the model must also meet the definition; without, the model alone decides.
    """
    rows = rows.where("series IS NOT NULL AND at IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    rows = written(rows.withColumn("outside", (F.col("value") <= LEAST) | (F.col("value") >= MOST)), "readings")
    readings = written(rows.groupBy(*KEYS, "at", "outside").agg(F.min("value").alias("value"), F.max("sticky").alias("sticky")), "series")
    behaviour = source_behaviour(readings.where("NOT outside"))
    started = written(_started(readings.select("field_name", "source").distinct().join(behaviour, ["field_name", "source"], "left")), "started")
    order, n = [*KEYS, "at", "outside"], readings.count()

    def sorted_with(parameters: DataFrame) -> DataFrame:
        ready = readings.join(bounded_broadcast(parameters), ["field_name", "source"])
        return ranged(ready.select(*order, "value", "parameters", "sticky"), *order, rows=n)

    expected = sorted_with(started).mapInArrow(_expected, "field_name string, source string, sums array<double>")
    fitted = written(_fitted(started, written(expected, "expected")), "parameters")
    settled = written(sorted_with(fitted).mapInArrow(lambda batches: _settle(batches, exact), _OUT), "settled")

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "outside"], kind="stable").drop_duplicates(["at", "outside"]).reset_index(drop=True)
        p, flag = _judge(pdf["gap"].cumsum().to_numpy(), pdf["value"].to_numpy(), np.stack(pdf["parameters"].to_numpy()), pdf["sticky"].to_numpy(dtype=bool), exact)
        pdf = pdf.assign(p_spike=p[:, 1], p_stuck=p[:, 2], flag=flag)
        return pdf[pdf["open"] & (pdf["flag"] != "")]

    borders = settled.where("flag IS NULL").groupBy(*KEYS).applyInPandas(together, _OUT)
    flags = settled.where("flag IS NOT NULL").unionByName(borders).select(*order, "flag", "p_spike", "p_stuck")
    return rows.join(flags, order).select("table_name", "id", "field_name", "flag", "p_spike", "p_stuck")
