import random
import time

import numpy as np
import pytest

from keyloom.operators import front

DDL = "key string, node string, clock map<string,bigint>, id bigint, __clk string"


def brute(rows):
    out = set()
    at = lambda r, n: (r[2] or {}).get(n) or 0
    for r in rows:
        g = [o for o in rows if o[:2] == r[:2]]
        nodes = {n for o in g for n in (o[2] or {})}
        if not any(all(at(r, n) <= at(o, n) for n in nodes) and any(at(r, n) < at(o, n) for n in nodes) for o in g):
            out.add(r[3])
    return out


def data(n, seed, high=4):
    rng = random.Random(seed)
    clock = lambda: rng.choice([None, {}, *[{rng.choice("abcde"): rng.choice([None, *range(high)]) for _ in range(rng.randint(1, 5))} for _ in range(6)]])
    keys = ["hot"] * 20 + [None, "", *[f"k{i}" for i in range(n // 10)]]
    return [(rng.choice(keys), rng.choice(["n1", None]), clock(), i, "x") for i in range(n)]


@pytest.mark.parametrize("shape", [(1, 3), (40, 1), (300, 2), (500, 3), (700, 4), (900, 6)])
def test_dominated(shape):
    rng = np.random.default_rng(shape[0])
    for high in (2, 5, 1000):
        x = rng.integers(0, high, shape)
        want = ((x[:, None] <= x[None]).all(2) & (x[:, None] < x[None]).any(2)).any(1)
        assert (front.dominated(x) == want).all()
        group = np.sort(rng.integers(0, 1 + shape[0] // 9, shape[0]))
        same = group[:, None] == group[None]
        want = (same & (x[:, None] <= x[None]).all(2) & (x[:, None] < x[None]).any(2)).any(1)
        assert (front.superseded(group, x) == want).all()


def test_against_brute_force(spark):
    rows = data(700, 3)
    got = front.causal_front(spark.createDataFrame(rows, DDL).repartition(5), ["key", "node"], "clock")
    assert got.columns == ["key", "node", "clock", "id", "__clk"]
    ids = [r.id for r in got.collect()]
    assert sorted(ids) == sorted(brute(rows))


def test_groups_larger_than_a_window(spark):
    # the front of "big" never fits a window of 64 rows, so it is settled across chunks
    conf, spark_rows = 64, [("big", "n", {"a": i, "b": 300 - i}, i, "") for i in range(300)] + [("big", "n", {"a": i, "b": 299 - i}, 1000 + i, "") for i in range(299)] + [("k", "n", {"a": i}, 5000 + i, "") for i in range(200)]
    was = front.WINDOW
    try:
        front.WINDOW = conf
        windows, streamed = front._windows([0], 2), front._streamed([0], 2)
        df = spark.createDataFrame(spark_rows, DDL)
        import pyarrow as pa

        t = df.toArrow().to_batches(max_chunksize=50)
        out = pa.Table.from_batches(list(streamed(windows(iter(t))))).to_pylist()
        assert {r["id"] for r in out if r["key"] == "k"} == {5199} and any(r["__open"] for r in out) and not any(r["__open"] for r in out if r["key"] == "k")
    finally:
        front.WINDOW = was
    rid = df.selectExpr("*", "id as __rid")
    got = front._across_chunks(rid, ["key"], "clock", 37)
    assert {r.id for r in got.collect()} == set(range(300)) | {5199}


def test_a_hundred_thousand_concurrent_clocks(spark):
    df = spark.range(100_000).selectExpr("'k' as key", "map('a', id, 'b', 100000 - id, 'c', id % 7, 'd', pmod(xxhash64(id), 1000)) as clock", "id")
    low = df.selectExpr("key", "map('a', id - 1, 'b', 100000 - id) as clock", "id + 1000000 as id").where("id < 1050000")
    began = time.time()
    got = front.causal_front(df.union(low), ["key"], "clock")
    n, last = got.selectExpr("count(*)", "max(id)").first()
    assert n == 100_000 and last < 1_000_000
    assert time.time() - began < 120


def test_empty(spark):
    assert front.causal_front(spark.createDataFrame([], DDL), ["key"], "clock").count() == 0
