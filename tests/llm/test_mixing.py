import random

from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm.mixing import apportion, mix

DOCS, TARGETS = "doc_id bigint, source string, n_tokens bigint, c string, share double", "source string, target_share double, max_repeats int, n string"


def brute(weights, blocks, caps):
    seats = [0] * len(weights)
    for _ in range(blocks):
        can = [i for i, w in enumerate(weights) if w > 0 and seats[i] < caps[i]]
        if not can:
            break
        seats[min(can, key=lambda i: (-weights[i] / (2 * seats[i] + 1), i))] += 1
    return seats


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 80)), min_size=1, max_size=8), st.integers(0, 300))
def test_apportionment_one_by_one(parties, blocks):
    weights, caps = [float(w) for w, _ in parties], [c for _, c in parties]
    assert apportion(weights, blocks, caps) == brute(weights, blocks, caps)


def run(spark, docs, targets, **kw):
    return mix(spark.createDataFrame([(*d, "x", 1.0) for d in docs], DOCS), spark.createDataFrame([(*t, "x") for t in targets], TARGETS), **kw)


def docs(n, seed=2):
    rng = random.Random(seed)
    return [(i, rng.choice(["big"] * 30 + ["Big ", "BIG", "mid-dle", "mid_dle", "small", "other", None]), rng.choice([None, 0, *[rng.randint(1, 300) for _ in range(20)]])) for i in range(n)]


def test_shares_and_repeats(spark):
    m = run(spark, docs(6000), [("big", 0.5, 1), ("MIDDLE", 0.3, 3), ("small", 0.15, 5), ("none", 0.05, 2)], block_tokens=256, shard_tokens=50_000)
    got = {r.source: r for r in m.shares.collect()}
    assert set(got) == {"big", "MIDDLE", "small", "none"} and got["none"].tokens == 0
    for s, share in (("big", 0.5), ("MIDDLE", 0.3), ("small", 0.15)):
        assert abs(got[s].actual_share - share / 0.95) < 0.01
    rows = m.rows.collect()
    limit = {"big": 1, "MIDDLE": 3, "small": 5}
    assert all(1 <= r.copies <= limit[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    assert sum(r.copies * r.n_tokens for r in rows) == sum(r.tokens for r in got.values())
    again = run(spark, docs(6000)[::-1], [("big", 0.5, 1), ("MIDDLE", 0.3, 3), ("small", 0.15, 5), ("none", 0.05, 2)], block_tokens=256, shard_tokens=50_000)
    assert sorted(again.rows.collect()) == sorted(rows)  # by the seed alone


def test_asked_for_more_than_there_is(spark):
    m = run(spark, [(1, "a", 100), (2, "b", 1000)], [("a", 0.9, 2), ("b", 0.1, 1)], total_tokens=10_000, block_tokens=50)
    assert {(r.source, r.tokens, r.most_copies) for r in m.shares.collect()} == {("a", 200, 2), ("b", 1000, 1)}


def test_edges(spark):
    for d, t in (([], [("a", 1.0, 1)]), ([(1, "a", 5)], []), ([], []), ([(1, None, 5), (2, "z", 5), (3, "a", None)], [("a", 1.0, 1), (None, 0.5, 1)]), ([(1, "a", 5)], [("a", None, 1)]), ([(1, "a", 5)], [("a", 1.0, None)])):
        m = run(spark, d, t)
        assert m.rows.count() == 0 and m.shares.count() == len([x for x in t if x[0]])
    m = run(spark, [(1, "a", 10**6)], [("A", 1.0, 2), (" a", 0.5, 3)])
    assert [(r.doc_id, r.copies) for r in m.rows.collect()] == [(1, 2)]


def test_many_shards(spark):
    """Hundreds of shards in groups: quotas add up, and shares hold however small the shards are."""
    d = [(i, "ab"[i % 3 == 0], 50 + i % 40) for i in range(9000)]
    m = run(spark, d, [("a", 0.7, 1), ("b", 0.3, 2)], block_tokens=32, shard_tokens=1500)
    got = {r.source: r for r in m.shares.collect()}
    assert abs(got["a"].actual_share - 0.7) < 0.02
    assert sum(r.n_tokens * r.copies for r in m.rows.collect()) == sum(r.tokens for r in got.values())
    assert all(abs(r.tokens - 32 * r.quota_blocks) < 0.03 * r.tokens for r in got.values())
