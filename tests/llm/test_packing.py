import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import packing
from keyloom.llm.packing import fill_report, lay_out, pack

KINDS = {"small": 8, "medium": 32, "large": 128}


def check(rows, docs, kinds, tiered):
    """No overlap, nothing beyond a container, all documents whole, split only where larger."""
    for kind in [None] if tiered else kinds:
        own = [r for r in rows if tiered or r.container_kind == kind]
        limit = max(kinds.values()) if tiered else kinds[kind]
        pieces = defaultdict(list)
        for r in own:
            pieces[r.doc_id].append(r)
        assert sorted(pieces) == sorted(docs)
        for d, ps in pieces.items():
            ps.sort(key=lambda r: r.piece)
            n = docs[d] or 0
            assert [r.piece for r in ps] == list(range(ps[0].n_pieces)) and len(ps) == max(1, -(-n // limit))
            assert ps[0].token_from == 0 and ps[-1].token_to == n and all(a.token_to == b.token_from for a, b in zip(ps, ps[1:]))
            assert (ps[0].container_id is None) == (n == 0)
    boxes = defaultdict(list)
    for r in rows:
        if r.container_id is not None:
            boxes[r.container_kind, r.container_id].append((r.at, r.token_to - r.token_from))
    for (kind, _), items in boxes.items():
        at = 0
        for start, n in sorted(items):
            assert start == at
            at += n
        assert at <= kinds[kind]
    return boxes


@pytest.mark.parametrize("tiered", [False, True])
def test_pack(spark, tiered, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)  # many documents of one size are ranked in several buckets
    rng = random.Random(1)
    docs = {i: rng.choice([None, 0, 5, 5, 5, rng.randint(1, 40), rng.randint(1, 400)]) for i in range(1500)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, n_tokens bigint").repartition(5)
    out = pack(df, KINDS, tiered=tiered, per_step=4)
    boxes = check(out.collect(), docs, KINDS, tiered)
    if not tiered:
        for kind, c in KINDS.items():
            n = len([1 for k, _ in boxes if k == kind])
            assert n <= 1.05 * -(-sum(x or 0 for x in docs.values()) // c) + 1
        for r in fill_report(out, KINDS).collect():
            assert r.filled > 0.94 and r.most_step_tokens - r.least_step_tokens <= 4 * KINDS[r.container_kind]


def brute_bfd(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= s]
        i = min(fits, key=lambda i: room[i]) if fits else len(room)
        if not fits:
            room.append(capacity)
        room[i] -= s
    return sorted(room)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(50, 70))
def test_equals_best_fit_decreasing_one_by_one(sizes, capacity):
    lay = lay_out(dict(Counter(sizes)), {0: capacity}, False)
    assert sorted(capacity - fill for _, n, fill in lay.runs[0] for _ in range(n)) == brute_bfd(sizes, capacity)


def test_edges(spark):
    f = lambda rows, **k: pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), KINDS, **k).collect()
    assert f([], tiered=True) == [] and f([], tiered=False) == []
    assert len(f([(1, None), (2, 0)], tiered=False)) == 6
    assert len(f([(1, 5), (1, 5)], tiered=True)) == 2
    assert sum(r.token_to - r.token_from for r in f([(1, 100_000)], tiered=True)) == 100_000
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 1)], "doc_id bigint, n_tokens bigint"), {}, tiered=True)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.integers(1, 6))
def test_tiers_are_packed_one_after_another(sizes, levels):
    """Every item once and no container over its capacity; no window holds only items shorter than the tier before it needs."""
    lay = lay_out(dict(Counter(sizes)), {0: 64}, False, levels)
    runs = lay.runs[0]
    assert sum(n * fill for _, n, fill in runs) == sum(sizes) and all(0 < fill <= 64 for _, _, fill in runs)
    # two items of the longest tier never share a window, so there are at least as many windows
    assert sum(n for _, n, _ in runs) >= sum(s > 32 for s in sizes)


def test_longest_tier_is_filled_first():
    # 40 + 24 fills a window; best fit decreasing would put 30 + 30 together and open a third window for 24
    tiers = lay_out({40: 1, 30: 2, 24: 1, 4: 1}, {0: 64}, False, 2)
    assert sorted(fill for _, n, fill in tiers.runs[0] for _ in range(n)) == [64, 64]


def test_audit_finds_faults(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 20), (3, None)], "doc_id bigint, n_tokens bigint")
    good = pack(sizes, {"k": 8}, tiered=False)
    row = lambda df: tuple(packing.audit(df, sizes, {"k": 8}).collect()[0])
    assert row(good) == ("k", 3, 0, 0, 0, 0)
    assert row(good.where("doc_id <> 1"))[2] == 1 and row(good.union(good.where("doc_id = 1")))[2] == 1
    assert row(good.withColumn("at", F.lit(4).cast("bigint")))[4:] != (0, 0)
    assert row(good.withColumn("n_pieces", F.lit(2).cast("bigint")))[3] >= 1
