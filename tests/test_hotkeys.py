import random

import numpy as np

from keyloom.operators import hotkeys
from keyloom.operators.hotkeys import dense_key_stats, hot_keys

DDL = "key string, client string, seq bigint, id bigint, value binary, n string"


def rows(n, seed=1):
    rng = random.Random(seed)
    keys = ["hot"] * 33 + ["Hot", "hot ", "", None] + [f"k{i}" for i in range(60)]
    return [(rng.choice(keys), rng.choice([None, *[f"c{i}" for i in range(50)]]), rng.choice([None, *range(-5, 500)]), i, rng.choice([None, b"", b"%d" % i]), "x") for i in range(n)]


def brute(data):
    out = {}
    for k, c, s, i, v, _ in data:
        o = out.setdefault(k, [0, set(), None, -1, None])
        o[0] += 1
        if c is not None:
            o[1].add(c)
        if s is not None and (o[2] is None or s > o[2]):
            o[2] = s
        if i > o[3]:
            o[3], o[4] = i, v
    return {k: (n, len(c), s, i, v) for k, (n, c, s, i, v) in out.items()}


def collect(df):
    return {r.key: (r.n, r.n_clients, r.last_sequence, r.latest_order, None if r.latest_value is None else bytes(r.latest_value)) for r in df.collect()}


def test_against_brute_force(spark):
    data = rows(20_000)
    df = spark.createDataFrame(data, DDL)
    got = dense_key_stats(df, "key", client="client", sequence="seq", order="id", value="value", splits=7)
    assert got.count() == len(brute(data)) and collect(got) == brute(data)


def test_flush_of_full_arrays_changes_nothing(spark, monkeypatch):
    import pyarrow as pa

    data = rows(5000, 2)
    cols = list(zip(*data))
    batch = lambda lo: pa.RecordBatch.from_arrays([pa.array(cols[0][lo : lo + 500], pa.string()), pa.array(cols[1][lo : lo + 500], pa.string()), pa.array(cols[2][lo : lo + 500], pa.int64()), pa.array(cols[3][lo : lo + 500], pa.int64()), pa.array(cols[4][lo : lo + 500], pa.binary())], names=list("kcsov"))
    monkeypatch.setattr(hotkeys, "FLUSH_KEYS", 20)
    monkeypatch.setattr(hotkeys, "FLUSH_BYTES", 300)
    monkeypatch.setattr(hotkeys, "FLUSH_PAIRS", 200)
    parts = list(hotkeys._split(batch(lo) for lo in range(0, 5000, 500)))
    whole = pa.Table.from_batches(parts).sort_by([("k", "ascending"), ("c", "ascending")])
    out = pa.Table.from_batches(list(hotkeys._reduce(iter(whole.combine_chunks().to_batches(max_chunksize=13))))).to_pylist()
    assert {r["k"]: (r["n"], r["nc"], r["s"], r["o"], r["v"]) for r in out} == brute(data)


def test_hot_keys_and_edges(spark):
    df = spark.createDataFrame([(k,) for k in ["a"] * 50 + [None] * 40 + ["b"] * 9 + ["a "]], "key string")
    assert {r.key for r in hot_keys(df, share=0.09).collect()} == {"a", "b"}
    empty = spark.createDataFrame([], DDL)
    assert dense_key_stats(empty, "key", client="client").count() == 0 and hot_keys(empty).count() == 0
    one = spark.createDataFrame([("x" * 100_000, 1), ("x" * 100_000, 1)], "key string, id bigint")
    r = dense_key_stats(one, "key", order="id").collect()
    assert len(r) == 1 and r[0].n == 2 and r[0].n_clients == 0 and r[0].latest_value is None


def test_reduce_is_linear_in_the_pairs():
    """Three times the pairs take less than four times the time, with the clients of one hot key among them."""
    import time

    import pyarrow as pa

    def took(n):
        none, zero = pa.nulls(10_000, pa.int64()), pa.array([0] * 10_000, pa.int64())
        key = pa.array(["hot"] * 10_000)
        blocks = (pa.RecordBatch.from_arrays([key, pa.array(np.arange(lo, lo + 10_000)).cast(pa.string()), zero, zero, none, none, pa.nulls(10_000, pa.binary())], schema=hotkeys._PARTIAL) for lo in range(0, n, 10_000))
        t = time.time()
        got = [r for b in hotkeys._reduce(blocks) for r in b.to_pylist()]
        assert got == [{"k": "hot", "c": None, "n": 0, "nc": n, "s": None, "o": None, "v": None}]
        return time.time() - t

    took(100_000)
    assert took(3_000_000) < 4 * took(1_000_000)


def test_clients_across_batches_and_nulls():
    import pyarrow as pa

    rows = [(None, None), (None, "a"), ("k", None), ("k", "a"), ("k", "a"), ("k", "b"), ("l", "b"), ("l", "b")]
    for size in (1, 2, 3, 8):
        b = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([c for _, c in rows]), pa.array([1] * 8), pa.array([0] * 8), pa.nulls(8, pa.int64()), pa.nulls(8, pa.int64()), pa.nulls(8, pa.binary())], schema=hotkeys._PARTIAL)
        got = [r for x in hotkeys._reduce(b.slice(i, size) for i in range(0, 8, size)) for r in x.to_pylist()]
        assert [(r["k"], r["n"], r["nc"]) for r in got] == [(None, 2, 1), ("k", 4, 2), ("l", 2, 1)]
