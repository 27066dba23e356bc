"""Results per key without imbalance, when a handful of keys hold most rows.

Every input split encodes its keys as dense codes and adds into numpy arrays (``bincount`` for counts, scattered
maxima for the latest sequence and request), so a split sends one row per key it holds, however often. These array
blocks are summed by key as they stream past in order of the key, segment by segment, so a reducing task holds one batch
and one key's sums, and its work is linear. No task ever sees more rows of one key than there are flushes of splits.
For distinct clients per key, (key, client) pairs are spread by both columns before they are counted, so a hot
key's clients don't meet in one task either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.session import stage

#: A split sends its arrays on and starts anew beyond so many keys, pairs or bytes of keys and values; this bounds a worker's memory.
FLUSH_KEYS = 200_000
FLUSH_BYTES = 64 << 20
FLUSH_PAIRS = 1_000_000
OUT_ROWS = 20_000

_PARTIAL = pa.schema(
    [("k", pa.string()), ("c", pa.string()), ("n", pa.int64()), ("nc", pa.int64()), ("s", pa.int64()), ("o", pa.int64()), ("v", pa.binary())]
)
_DDL = "k string, c string, n bigint, nc bigint, s bigint, o bigint, v binary"
_NONE = np.iinfo(np.int64).min


def _codes(column: pa.Array, known: dict) -> np.ndarray:
    """Dense code of each entry; ``known`` grows by the entries not yet in it. Null is an entry of its own."""
    d = column.dictionary_encode(null_encoding="encode")
    to = np.fromiter((known.setdefault(x, len(known)) for x in d.dictionary.to_pylist()), np.int64, len(d.dictionary))
    return to[d.indices.to_numpy(zero_copy_only=False)] if len(column) else np.empty(0, np.int64)


def _ints(column: pa.Array) -> np.ndarray:
    """int64 with nulls as the smallest number."""
    return column.cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False)


class _Accumulators:
    """Dense arrays over the keys met so far."""

    def __init__(self) -> None:
        self.keys: dict = {}
        self.clients: dict = {}
        self.n = np.zeros(1024, np.int64)
        self.s = np.full(1024, _NONE, np.int64)
        self.o = np.full(1024, _NONE, np.int64)
        self.v: list = []
        self.pairs: list[np.ndarray] = []
        self.n_pairs = self.bytes = 0

    def fit(self) -> None:
        want = len(self.keys)
        if want > len(self.n):
            grow = max(want, 2 * len(self.n)) - len(self.n)
            self.n = np.append(self.n, np.zeros(grow, np.int64))
            self.s = np.append(self.s, np.full(grow, _NONE, np.int64))
            self.o = np.append(self.o, np.full(grow, _NONE, np.int64))
        self.v.extend([None] * (want - len(self.v)))

    def add(self, k: pa.Array, c: pa.Array, s: np.ndarray, o: np.ndarray, v: pa.Array) -> None:
        known = len(self.keys)
        g = _codes(k, self.keys)
        self.bytes += k.nbytes * (len(self.keys) - known) // max(1, len(k))
        self.fit()
        size = len(self.keys)
        self.n[:size] += np.bincount(g, minlength=size)
        np.maximum.at(self.s, g, s)
        if len(g):
            order = np.argsort(o, kind="stable")
            last = np.full(size, -1, np.int64)
            last[g[order]] = order  # of repeated indices the last assignment holds
            at = last[last >= 0]
            groups = g[at]
            newer = o[at] > self.o[groups]
            groups, at = groups[newer], at[newer]
            self.bytes += v.nbytes * len(at) // len(v)
            self.o[groups] = o[at]
            for group, value in zip(groups.tolist(), v.take(pa.array(at)).to_pylist()):
                self.v[group] = value
        if c.null_count < len(c):
            has = np.asarray(c.is_valid())
            pair = (g[has] << 32) | _codes(c.filter(pa.array(has)), self.clients)
            self.pairs.append(np.unique(pair))
            self.n_pairs += len(self.pairs[-1])

    def compact_pairs(self) -> np.ndarray:
        got = np.unique(np.concatenate(self.pairs)) if self.pairs else np.empty(0, np.int64)
        self.pairs, self.n_pairs = ([got] if len(got) else []), len(got)
        return got

    def rows(self) -> Iterator[pa.RecordBatch]:
        size = len(self.keys)
        names = list(self.keys)
        pairs = self.compact_pairs()
        for lo in range(0, size, OUT_ROWS):
            hi = min(size, lo + OUT_ROWS)
            yield _block(pa.array(names[lo:hi], pa.string()), pa.nulls(hi - lo, pa.string()), self.n[lo:hi], np.zeros(hi - lo, np.int64), self.s[lo:hi], self.o[lo:hi], pa.array(self.v[lo:hi], pa.binary()))
        if len(pairs):
            k, c = pa.array(names, pa.string()), pa.array(list(self.clients), pa.string())
            for lo in range(0, len(pairs), OUT_ROWS):
                part = pairs[lo : lo + OUT_ROWS]
                zero, none = np.zeros(len(part), np.int64), np.full(len(part), _NONE, np.int64)
                yield _block(k.take(pa.array(part >> 32)), c.take(pa.array(part & 0xFFFFFFFF)), zero, zero, none, none, pa.nulls(len(part), pa.binary()))


def _block(k: pa.Array, c: pa.Array, n: np.ndarray, nc: np.ndarray, s: np.ndarray, o: np.ndarray, v: pa.Array) -> pa.RecordBatch:
    """A block of the arrays as rows; the smallest number stands for null."""
    num = lambda a: pa.array(a, mask=a == _NONE)
    return pa.RecordBatch.from_arrays([k, c, pa.array(n), pa.array(nc), num(s), num(o), v], schema=_PARTIAL)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    acc = _Accumulators()
    for b in batches:
        acc.add(b.column(0), b.column(1), _ints(b.column(2)), _ints(b.column(3)), b.column(4))
        if acc.n_pairs > FLUSH_PAIRS:
            acc.compact_pairs()
        # pairs are sorted anew at most once per half a limit of new ones
        if len(acc.keys) > FLUSH_KEYS or acc.bytes > FLUSH_BYTES or acc.n_pairs > FLUSH_PAIRS // 2:
            yield from acc.rows()
            acc = _Accumulators()
    yield from acc.rows()


def _changes(column: pa.Array) -> np.ndarray:
    """Where an entry differs from the one before; the first always does. Null is a value."""
    code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.append(True, code[1:] != code[:-1])


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums blocks sorted by key and client: a batch at a time, with the sums of the last key carried on."""
    last: pa.RecordBatch | None = None  # the unfinished key's row; its client is the one counted last
    for b in batches:
        if not b.num_rows:
            continue
        if last is not None:
            b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        k, c = b.column(0), b.column(1)
        n, nc, s, o = (_ints(b.column(i)) for i in (2, 3, 4, 5))
        new_key = _changes(k)
        counts = (new_key | _changes(c)) & np.asarray(c.is_valid())
        if last is not None:
            counts[0] = False  # the carried row's client is among its count already
        start = np.flatnonzero(new_key)
        group = np.cumsum(new_key) - 1
        newest = np.maximum.reduceat(o, start)
        at = np.full(len(start), -1, np.int64)
        hit = np.flatnonzero((o == newest[group]) & (o != _NONE))[::-1]
        at[group[hit]] = hit  # the first row of each key's newest
        end = np.append(start[1:], len(group)) - 1
        out = _block(
            k.take(pa.array(start)), c.take(pa.array(end)), np.add.reduceat(n, start), np.add.reduceat(nc + counts, start), np.maximum.reduceat(s, start), newest,
            b.column(6).take(pa.array(at, mask=at < 0)),
        )
        last = out.slice(len(start) - 1)
        if len(start) > 1:
            yield _without_client(out.slice(0, len(start) - 1))
    if last is not None:
        yield _without_client(last)


def _without_client(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.string()), *b.columns[2:]], schema=_PARTIAL)


def dense_key_stats(
    df: DataFrame, key: str, *, client: str | None = None, sequence: str | None = None, order: str | None = None, value: str | None = None, splits: int | None = None
) -> DataFrame:
    """One row per key: ``key, n, n_clients, last_sequence, latest_order, latest_value``.

    n counts rows; n_clients the distinct non-null clients (0 if no column is given); last_sequence is the greatest
    non-null sequence; latest_value the value of the row with the greatest ``order``. A null key is a key of its
    own, so the counts add up to all rows. Keys are exact text. Rows of equal order keep one value of them.
    ``splits`` deals the rows evenly beforehand, for input that can't be split. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = df.select(
        F.col(key).cast("string").alias("k"),
        (F.col(client).cast("string") if client else none("string")).alias("c"),
        (F.col(sequence).cast("bigint") if sequence else none("bigint")).alias("s"),
        (F.col(order).cast("bigint") if order else none("bigint")).alias("o"),
        (F.col(value).cast("binary") if value else none("binary")).alias("v"),
    )
    if splits:
        rows = rows.repartition(splits)
    part = rows.mapInArrow(_split, _DDL)
    if client:
        # pairs of a hot key are spread by client; what counts per key has no client and meets at once
        part = part.repartition("k", "c").sortWithinPartitions("k", "c").mapInArrow(_reduce, _DDL)
    return part.repartition("k").sortWithinPartitions("k").mapInArrow(_reduce, _DDL).select(
        F.col("k").alias("key"), "n", F.col("nc").alias("n_clients"), F.col("s").alias("last_sequence"), F.col("o").alias("latest_order"), F.col("v").alias("latest_value")
    )


def hot_keys(df: DataFrame, key: str = "key", share: float = 0.01, **stats: str) -> DataFrame:
    """Keys that hold at least ``share`` of all rows, those with a null key counted among all; with ``dense_key_stats``' columns.

    The total comes from the counts per key, which are staged, so the table is read once.
    """
    counted = stage(dense_key_stats(df, key, **stats), "key-stats")
    total = counted.select(F.sum("n").alias("__total")).scalar()
    return counted.where(F.col("key").isNotNull() & (F.col("n") >= F.lit(share) * total))
