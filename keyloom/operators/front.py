"""Rows that no other row of their group supersedes: the maxima of vector clocks per group, for groups of any size.

A clock supersedes another if it is nowhere lower and somewhere higher; a node that a clock doesn't name counts 0.

1. Every split prunes windows of its rows, so of a hot group only local maxima are sent.
2. Rows meet by group and are pruned as they stream past, sorted; a task holds one window of rows.
3. A group whose maxima don't fit a window stays open. Its rows are dealt to chunks, and pairs of chunks are compared in
   tasks of their own. Within a window or a pair of chunks, maxima are found by divide and conquer over the counters, not by
   comparing all pairs, so a large set of concurrent clocks isn't quadratic in its rows, only in its number of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.session import stage

#: Rows and bytes a task holds at once.
WINDOW, WINDOW_BYTES = 65_536, 64 << 20
#: Groups of so many rows are compared pair by pair, all groups of a window at once.
PAIRWISE = 32
_PAIRS = 1 << 21
_BRUTE = 1 << 17
_OPEN, _RID, _GROUP = "__open", "__rid", "__group"


def counters(clock: pa.Array) -> np.ndarray:
    """Rows by nodes, of the nodes that occur; null clocks and counters are 0."""
    at = clock.offsets.to_numpy()
    size = np.where(np.asarray(clock.is_valid()), np.diff(at), 0)
    row = np.repeat(np.arange(len(clock)), size)
    flat = np.repeat(at[:-1] - (np.cumsum(size) - size), size) + np.arange(len(row))
    nodes = clock.keys.take(pa.array(flat)).dictionary_encode()
    out = np.zeros((len(clock), len(nodes.dictionary)), np.int64)
    out[row, nodes.indices.to_numpy(zero_copy_only=False)] = clock.items.take(pa.array(flat)).fill_null(0).to_numpy(zero_copy_only=False)
    return out


def _covered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether some row of ``b`` is nowhere lower, for each row of ``a``."""
    out = np.zeros(len(a), bool)
    if not len(a) or not len(b):
        return out
    if not a.shape[1]:
        return ~out
    at = np.flatnonzero((a <= b.max(axis=0)).all(axis=1))
    if len(at):
        b = b[(b >= a[at].min(axis=0)).all(axis=1)]
    if not len(at) or not len(b):
        return out
    a = a[at]
    if a.shape[1] == 1:
        out[at] = a[:, 0] <= b[:, 0].max()
    elif a.shape[1] == 2:
        order = np.argsort(b[:, 0], kind="stable")
        best = np.append(np.maximum.accumulate(b[order[::-1], 1])[::-1], np.iinfo(np.int64).min)
        out[at] = best[np.searchsorted(b[order, 0], a[:, 0])] >= a[:, 1]
    elif len(a) * len(b) <= _BRUTE:
        out[at] = (a[:, None, :] <= b[None, :, :]).all(axis=2).any(axis=1)
    else:
        last = np.concatenate([a[:, -1], b[:, -1]])
        cut = np.partition(last, len(last) // 2)[len(last) // 2]
        if cut == last.min():
            higher = last[last > cut]
            if not len(higher):
                out[at] = _covered(a[:, :-1], b[:, :-1])
                return out
            cut = higher.min()
        low, high = a[:, -1] < cut, b[:, -1] >= cut
        hit = np.zeros(len(a), bool)
        # a high row of b is above any low row of a in this counter
        hit[low] = _covered(a[low, :-1], b[high, :-1])
        hit[~low] = _covered(a[~low], b[high])
        rest = low & ~hit
        hit[rest] = _covered(a[rest], b[~high])
        out[at] = hit
    return out


def dominated(x: np.ndarray) -> np.ndarray:
    """Rows below another row of ``x``, nowhere higher and somewhere lower."""
    if len(x) < 2 or not x.shape[1]:
        return np.zeros(len(x), bool)
    x = x[:, (x != x[0]).any(axis=0)]
    if not x.shape[1]:
        return np.zeros(len(x), bool)
    rows, back = np.unique(x, axis=0, return_inverse=True)
    below = np.zeros(len(rows), bool)

    # in lexicographic order a row can only be below a later one, and the first counter of a later one isn't lower
    def settle(lo: int, hi: int) -> None:
        if hi - lo < 2:
            return
        mid = (lo + hi) // 2
        settle(mid, hi)
        top = mid + np.flatnonzero(~below[mid:hi])
        below[lo:mid] |= _covered(rows[lo:mid, 1:], rows[top, 1:])
        if hi - lo > 2:
            left = lo + np.flatnonzero(~below[lo:mid])
            if len(left) == mid - lo:
                settle(lo, mid)
            else:
                below[left] |= dominated(rows[left])

    settle(0, len(rows))
    return below[back.ravel()]


def superseded(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` below another row of their group; rows of a group lie together."""
    n = len(group)
    out = np.zeros(n, bool)
    if not n or not x.shape[1]:
        return out
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, n))
    small = np.flatnonzero((sizes > 1) & (sizes <= PAIRWISE))
    ends = np.cumsum(sizes[small] ** 2)
    for part in np.split(small, np.flatnonzero(np.diff(ends // _PAIRS)) + 1):
        s, m = starts[part], sizes[part]
        g = np.repeat(np.arange(len(s)), m * m)
        k = np.arange(len(g)) - np.repeat(np.cumsum(m * m) - m * m, m * m)
        i, j = s[g] + k // m[g], s[g] + k % m[g]
        lower, strictly = np.ones(len(g), bool), np.zeros(len(g), bool)
        for c in x.T:
            ci, cj = c[i], c[j]
            lower &= ci <= cj
            strictly |= ci < cj
        out[i[lower & strictly]] = True
    for s, m in zip(starts[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist()):
        out[s : s + m] = dominated(x[s : s + m])
    return out


def _groups(batch: pa.RecordBatch, by: list[int]) -> np.ndarray:
    """A number per row, equal for rows of one group; null is a value like any other."""
    out = np.zeros(batch.num_rows, np.int64)
    for c in by:
        d = batch.column(c).dictionary_encode(null_encoding="encode")
        out = out * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False)
        if len(by) > 1:
            out = np.unique(out, return_inverse=True)[1].ravel()
    return out


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pruned(batch: pa.RecordBatch, by: list[int], clock: int) -> pa.RecordBatch:
    group = _groups(batch, by)
    order = np.argsort(group, kind="stable")
    if (np.diff(group[order]) > 0).all():
        return batch
    gone = superseded(group[order], counters(batch.column(clock).take(pa.array(order))))
    return batch.take(pa.array(np.sort(order[~gone]))) if gone.any() else batch


def _full(held: list[pa.RecordBatch]) -> bool:
    return sum(b.num_rows for b in held) >= WINDOW or sum(b.nbytes for b in held) >= WINDOW_BYTES


def _windows(by: list[int], clock: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if _full(held):
                yield _pruned(_joined(held), by, clock)
                held = []
        if held:
            yield _pruned(_joined(held), by, clock)

    return run


def _streamed(by: list[int], clock: int):
    """Prunes sorted groups; flags the rows of a group that a window can't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda b, i: tuple(b.column(c)[i].as_py() for c in by)
        held: list[pa.RecordBatch] = []
        open_group = None

        def out(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal open_group
            flag = np.zeros(b.num_rows, bool)
            if open_group is not None:
                group = _groups(b, by)
                if name(b, 0) == open_group:
                    flag[group == group[0]] = True
                else:
                    open_group = None
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(flag)], names=[*b.schema.names, _OPEN])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if not _full(held):
                continue
            t = _joined(held)
            group = _groups(t, by)
            start = int(np.flatnonzero(group != group[-1]).max(initial=-1)) + 1
            if start:
                yield from out(_pruned(t.slice(0, start), by, clock))
                held = [t.slice(start)]
                continue
            t = _pruned(t, by, clock)
            held = [t]
            if name(t, 0) == open_group or t.num_rows > WINDOW // 2 or t.nbytes > WINDOW_BYTES // 2:
                open_group = name(t, 0)
                yield from out(t)
                held = []
        if held:
            yield from out(_pruned(_joined(held), by, clock))

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of superseded rows among those asked, of sorted (group, a, b, asked, id, clock): a pair of chunks is held at once."""
    held: list[pa.RecordBatch] = []

    def settle(t: pa.RecordBatch) -> pa.RecordBatch:
        asked = t.column(3).to_numpy(zero_copy_only=False)
        order = np.argsort(pair := _groups(t, [0, 1, 2]), kind="stable")
        gone = np.zeros(len(order), bool)
        gone[order] = superseded(pair[order], counters(t.column(5).take(pa.array(order))))
        return pa.RecordBatch.from_arrays([t.column(4).filter(pa.array(gone & asked))], names=[_RID])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < WINDOW:
            continue
        t = _joined(held)
        pair = _groups(t, [0, 1, 2])
        start = int(np.flatnonzero(pair != pair[-1]).max(initial=-1)) + 1
        if start:
            yield settle(t.slice(0, start))
        held = [t.slice(start)]
    if held:
        yield settle(_joined(held))


def _across_chunks(rows: DataFrame, by: list[str], clock: str, chunk: int) -> DataFrame:
    """The front of groups too large for a window: each chunk is compared with each chunk of its group in a task of its own."""
    own = rows.select(F.to_json(F.struct(*by)).alias(_GROUP), F.col(clock).alias("__clock"), _RID)
    sizes = own.groupBy(_GROUP).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("__chunks"))
    dealt = own.join(sizes, _GROUP).withColumn("__own", F.pmod(F.xxhash64(_RID), F.col("__chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1))
    side = lambda asked: dealt.select(_GROUP, F.col("__own").alias("__a" if asked else "__b"), other.alias("__b" if asked else "__a"), F.lit(asked).alias("__asked"), _RID, "__clock")
    cols = [_GROUP, "__a", "__b", "__asked", _RID, "__clock"]
    pairs = side(True).select(cols).unionByName(side(False).select(cols)).repartition(_GROUP, "__a", "__b").sortWithinPartitions(_GROUP, "__a", "__b")
    return rows.join(pairs.mapInArrow(_pairs, f"{_RID} bigint").distinct(), _RID, "left_anti")


def causal_front(rows: DataFrame, by: list[str], clock: str, chunk: int = WINDOW) -> DataFrame:
    """Rows of ``rows`` whose ``clock`` (map of node to counter) no other row of their group ``by`` supersedes; all columns are kept.

    A null or empty clock, a node not named and a null counter count 0, so equal clocks and clocks that differ in zero entries
    don't supersede each other: repeated rows all stay. Null is a group of its own. An empty table stays empty. The result
    is staged in the shared folder.
    """
    at = [rows.columns.index(c) for c in by]
    of = rows.columns.index(clock)
    local = rows.mapInArrow(_windows(at, of), rows.schema)
    met = local.repartition(*by).sortWithinPartitions(*by).mapInArrow(_streamed(at, of), T.StructType([*rows.schema.fields, T.StructField(_OPEN, T.BooleanType())]))
    kept = stage(met.withColumn(_RID, F.monotonically_increasing_id()), "front")
    closed = kept.where(~F.col(_OPEN)).select(rows.columns)
    if kept.where(_OPEN).isEmpty():
        return closed
    return closed.unionByName(_across_chunks(kept.where(_OPEN), by, clock, chunk).select(rows.columns))
