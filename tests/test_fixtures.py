"""Small cases of each operator family, against expected results or brute force."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import hashing
from keyloom.operators import bloom, compaction, faults, history, lsm, metrics, occ, quorum, replog, ring, running, siblings, workload

ENTRY = "run int, key string, value string, seq bigint"
RUN = "run_id int, level int, size bigint, first string, last string"
SIB = "key string, node string, value string, version bigint, clock map<string,bigint>, tombstone boolean"
OP = "idx bigint, key string, type string, value string, start_ms bigint, end_ms bigint, result string"
LOG = "idx bigint, client string, seq bigint, op string, key string, value string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# entries


def test_newest_wins_whatever_the_runs(spark):
    e = [(0, "k", "old", 2), (1, "k", "new", 5), (0, "d", "v", 1), (1, "d", None, 3), (0, "l", None, 2), (1, "l", "v", 4), (0, "e", "", 9)]
    df = spark.createDataFrame(e, ENTRY)
    assert rows(lsm.newest_wins(df), "key", "value", "seq") == sorted([("k", "new", 5), ("d", None, 3), ("l", "v", 4), ("e", "", 9)], key=repr)
    assert rows(lsm.newest_wins(df, drop_tombstones=True), "key") == [("e",), ("k",), ("l",)]
    assert rows(lsm.point_get(df, "d"), "key") == [] and rows(lsm.point_get(df, "k"), "value") == [("new",)]
    assert lsm.newest_wins(spark.createDataFrame([], ENTRY)).count() == 0


def test_bounded_scan(spark):
    e = [(0, f"key{i:04d}", "old", i + 1) for i in range(30)] + [(1, "key0010", "new", 50), (1, "key0011", None, 51)] + [(2, f"key{i:04d}", "mem", 60 + i) for i in range(30, 40)]
    df = spark.createDataFrame(e, ENTRY)
    assert [(r.key[-2:], r.value) for r in lsm.range_scan(df, "key0008", "key0014").collect()] == [("08", "old"), ("09", "old"), ("10", "new"), ("12", "old"), ("13", "old")]
    assert lsm.range_scan(df, None, "").count() == 0 and lsm.range_scan(df, "key0038").count() == 2 and lsm.range_scan(df, limit=3).count() == 3


def test_recovery_and_sequences(spark):
    tables = spark.createDataFrame([(0, "a", "flushed", 7), (0, "b", "x", 3)], ENTRY)
    wal = spark.createDataFrame([(100, "a", "1"), (200, "a", "2"), (300, "b", None)], "offset bigint, key string, value string")
    assert rows(lsm.newest_wins(lsm.recover(tables, wal)), "key", "value", "seq") == [("a", "2", 9), ("b", None, 10)]
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("o")).repartition(7)
    assert all(r.seq == r.o + 1 for r in lsm.assign_sequence(df, "o").collect())


def test_running_total(spark):
    df = spark.range(500).select((F.col("id") * 377 % 500).alias("o"), (F.col("id") % 7).alias("v"))
    data = sorted((r.o, r.v) for r in df.collect())
    want = dict(zip([o for o, _ in data], itertools.accumulate(v for _, v in data)))
    assert {r.o: r.t for r in running.running_total(df, ["o"], F.col("v"), "t").collect()} == want
    assert running.running_total(df.where("o < 0"), ["o"], F.col("v"), "t").count() == 0


# compaction


def plan(df):
    return sorted((r.run_id, r.output_level, r.drop_tombstones) for r in df.collect())


def test_size_tiered(spark):
    f = lambda *r: spark.createDataFrame(r, RUN)
    four = [(i, 0, 100, "a", "z") for i in range(4)]
    assert plan(compaction.plan_size_tiered(f(*four))) == [(i, 0, True) for i in range(4)]
    assert plan(compaction.plan_size_tiered(f(*four[:2]))) == []
    mixed = [(0, 0, 10, "a", "b"), (1, 0, 5000, "a", "b"), (2, 0, 11, "a", "b"), (3, 0, 6000, "a", "b"), (4, 0, 12, "a", "b")]
    assert plan(compaction.plan_size_tiered(f(*mixed), 3)) == [(0, 0, False), (2, 0, False), (4, 0, False)]


def test_leveled(spark):
    f = lambda *r: spark.createDataFrame(r, RUN)
    l0 = [(i, 0, 100, "00", "10") for i in range(4)]
    got = compaction.plan_leveled(f(*l0, (4, 1, 100, "05", "15"), (5, 1, 100, "50", "60")), 4, 1 << 20, 10)
    assert plan(got) == [(i, 1, True) for i in range(5)]
    assert plan(compaction.plan_leveled(f(*l0, (4, 2, 100, "05", "15")), 4, 1 << 20, 10)) == [(i, 1, False) for i in range(4)]
    budget = [(0, 1, 900, "00", "19"), (1, 1, 900, "20", "39"), (2, 2, 900, "00", "09")]
    assert plan(compaction.plan_leveled(f(*budget), 4, 1024, 10)) == [(0, 2, True), (2, 2, True)]
    assert plan(compaction.plan_leveled(f((0, 0, 9, "a", "b"), (1, 1, 9, "a", "b")), 4, 1024, 10)) == []
    assert plan(compaction.plan_leveled(f(), 4, 1024, 10)) == []


def test_overlap_is_inclusive_and_empty_meets_none(spark):
    df = spark.createDataFrame([("a", "c", "c", "d"), ("a", "b", "c", "d"), (None, None, "a", "z")], "a string, b string, c string, d string")
    assert [r[0] for r in df.select(compaction.overlaps(*map(F.col, "abcd"))).collect()] == [True, False, False]


# siblings


def sib(spark, *r):
    return spark.createDataFrame([("k", f"n{i}", *x) for i, x in enumerate(r)], SIB)


@pytest.mark.parametrize(
    "given,want",
    [
        ([("v1", 1, {"a": 1}, False), ("v2", 2, {"a": 2}, False)], ["v2"]),
        ([("v2", 2, {"a": 2}, False), ("v1", 1, {"a": 1}, False)], ["v2"]),
        ([("a", 1, {"x": 1}, False), ("b", 1, {"y": 1}, False)], ["a", "b"]),
        ([("a", 1, {"x": 1}, False)] * 2, ["a"]),
        ([("l", 1, {"a": 1}, False), ("r", 1, {"a": 1}, False)], ["l", "r"]),
        ([("p", 2, {"a": 2}, False), ("q", 2, {"a": 2, "b": 0}, False)], ["p", "q"]),
    ],
)
def test_sibling_sets(spark, given, want):
    assert [v for v, in rows(siblings.merge_siblings(sib(spark, *given)), "value")] == want


def test_tombstones_and_policies(spark):
    both = sib(spark, ("x", 1, {"a": 1}, False), ("x", 1, {"a": 1}, True))
    assert siblings.merge_siblings(both).count() == 2 and siblings.causal_front(both).count() == 1
    conflict = sib(spark, ("0.81", 1, {"n0": 1}, False), ("0.81", 1, {"n0": 1}, False), ("0.86", 1, {"n1": 1}, False))
    r = siblings.resolve(conflict).collect()[0]
    assert (r.conflict, r.value) == (True, None) and siblings.conflicting(conflict).count() == 2
    assert siblings.resolve(conflict, "WINNER").collect()[0].value == "0.86"
    later = sib(spark, ("0.81", 1, {"n0": 1}, False), ("0.86", 2, {"n0": 1, "n1": 1}, False))
    r = siblings.resolve(later).collect()[0]
    assert (r.conflict, r.value) == (False, "0.86") and siblings.conflicting(later).count() == 0
    ten = sib(spark, ("ten", 10, {"a": 10}, False), ("nine", 9, {"a": 9}, False))
    assert siblings.deterministic_winner(ten).collect()[0].value == "nine"  # compared as text
    with pytest.raises(Exception, match="expected one value"):
        siblings.scalar(siblings.as_sets(siblings.merge_siblings(conflict))).collect()
    assert siblings.next_clock(later, "n1").collect()[0].clock == {"n0": 1, "n1": 2}


def test_merge_in_any_order(spark):
    rng = random.Random(2)
    data = [(rng.choice("pq"), rng.randint(1, 3), {n: rng.randint(1, 3) for n in rng.sample("abc", rng.randint(0, 3))}, rng.random() < 0.3) for _ in range(40)]
    cols = ("value", "tombstone")
    key = lambda df: sorted((*[r[c] for c in cols], sorted(r.clock.items())) for r in df.collect())
    once = siblings.merge_siblings(sib(spark, *data))
    assert key(once) == key(siblings.merge_siblings(sib(spark, *data[::-1])))
    c = ["key", "value", "version", "clock", "tombstone"]
    assert key(siblings.merge_siblings(once.select(c).unionByName(once.select(c)))) == key(once)


# quorums


def test_repair_plan(spark):
    r = [("k", "n0", "new", 2, {"a": 2}, False), ("k", "n1", "old", 1, {"a": 1}, False), ("c", "n0", "x", 1, {"a": 1}, False), ("c", "n1", "y", 1, {"b": 1}, False)]
    pref = spark.createDataFrame([(k, n) for k in "kc" for n in ("n0", "n1", "n2")], "key string, node string")
    assert rows(quorum.repair_plan(spark.createDataFrame(r, SIB), pref), "key", "node", "value") == [("k", "n1", "new"), ("k", "n2", "new")]


def test_config_and_causes(spark):
    c = spark.createDataFrame([(3, 2, 2, 2, 2), (3, 1, 1, 0, 0), (3, 4, 1, 0, 0), (3, 2, 2, 3, 0)], "n int, w int, r int, pw int, pr int")
    got = [(r.valid, r.overlap, r.read_your_writes, r.available_during_partition) for r in quorum.config_predicates(c).collect()]
    assert got[0] == (True, True, True, False) and got[1] == (True, False, False, True) and not got[2][0] and not got[3][0]
    k = spark.createDataFrame([(None,), ("DEADLINE_EXCEEDED",), ("unavailable",), ("INTERNAL",)], "k string")
    assert [r[0] for r in k.select(quorum.failure_cause(F.col("k"))).collect()] == ["UNAVAILABLE_NODE", "DROPPED_MESSAGE", "UNAVAILABLE_NODE", "UNKNOWN"]


# histories


def hist(spark, *ops):
    """(type, value, start, end, result='SUCCESS', key='x')"""
    return spark.createDataFrame([(i, (o + ("SUCCESS", "x")[len(o) - 4 :])[5] if len(o) < 6 else o[5], "READ" if o[0] == "R" else "WRITE", o[1], o[2], o[3], o[4] if len(o) > 4 else "SUCCESS") for i, o in enumerate(ops)], OP)


def second(*ops):
    return [(t, v, 1000 * i, 1000 * i + 10, *r) for i, (t, v, *r) in enumerate(ops)]


def test_session_checks(spark):
    v = lambda df, k: [(r.expected, r.observed) for r in df.collect() if r.type == k]
    assert v(history.violations(hist(spark, *second(("W", "v1"), ("W", "v2"), ("R", "v1")))), "STALE_READ") == [("v2", "v1")]
    assert v(history.violations(hist(spark, *second(("W", "t"), ("R", None)))), "READ_YOUR_WRITES") == [("t", None)]
    assert v(history.violations(hist(spark, *second(("W", "v1"), ("W", "v2"), ("R", "v2"), ("R", "v1")))), "MONOTONIC_READ") == [("v2", "v1")]
    fine = hist(spark, ("W", "v1", 0, 10), ("W", "v2", 1000, 1010, "FAILURE"), ("R", "v1", 2000, 2010), ("W", "v3", 3000, 4000), ("R", "v1", 3500, 3510))
    assert history.violations(fine).count() == 0


def test_read_your_writes_against_pairs(spark):
    rng = random.Random(9)
    ops = []
    for i in range(400):
        s = rng.randint(0, 300)
        ops.append((i, rng.choice("ab"), rng.choice(["READ", "WRITE"]), rng.choice(["p", "q", "r", None]), s, s + rng.randint(0, 40), rng.choice(["SUCCESS"] * 4 + ["UNKNOWN"])))
    want = set()
    for r in ops:
        if r[2] == "READ" and r[6] == "SUCCESS":
            seen = [w for w in ops if w[2] == "WRITE" and w[6] == "SUCCESS" and w[1] == r[1] and w[5] <= r[4] and w[0] < r[0]]
            if seen:
                last = max(seen, key=lambda w: (w[5], -w[0]))
                if last[3] != r[3]:
                    want.add((r[0], last[3], r[3]))
    got = {(r.idx, r.expected, r.observed) for r in history.read_your_writes(spark.createDataFrame(ops, OP)).collect()}
    assert got == want


W, R = "W", "R"
LINEAR = [
    ([(W, "v0", 0, 10), (R, "v0", 20, 30)], True),
    ([(R, None, 0, 10), (W, "v0", 20, 30)], True),
    ([(W, "v0", 0, 30), (R, "v0", 10, 20)], True),
    ([(W, "v0", 0, 100), (W, "v1", 0, 100), (R, "v1", 110, 120)], True),
    ([(W, "v0", 0, 10), (W, "v1", 20, 30), (R, "v0", 40, 50)], False),
    ([(W, "v0", 0, 10), (W, "v1", 0, 10), (R, "v0", 20, 30), (R, "v1", 40, 50), (R, "v0", 60, 70)], False),
    ([(W, "v0", 0, 10), (R, "x", 20, 30, "FAILURE"), (R, "v0", 40, 50)], True),
    ([(W, "v1", 10, 20, "UNKNOWN"), (R, "v1", 30, 40)], True),
    ([(W, "v1", 10, 20, "FAILURE"), (R, "v1", 30, 40)], False),
    ([(W, "v0", 0, 5), (W, "v1", 10, 20, "UNKNOWN"), (R, "v0", 30, 40)], True),
    ([(W, "v1", 10, 20, "UNKNOWN"), (W, "v2", 40, 50), (R, "v1", 70, 80)], True),
    ([(R, "v1", 0, 5), (W, "v1", 10, 20, "UNKNOWN")], False),
    ([(W, "v0", 0, 5), (W, "v1", 10, 20, "UNKNOWN"), (R, "ghost", 30, 40)], False),
    ([(W, "v0", 0, 5), (R, "z", 10, 20, "UNKNOWN"), (R, "v0", 30, 40)], True),
    ([(W, "A", 0, 2), (W, "B", 10, 12), (R, "A", 20, 22)], False),
]


def test_linearizability_cases(spark):
    ops = [(100 * c + i, f"c{c}", "READ" if o[0] == R else "WRITE", o[1], o[2], o[3], o[4] if len(o) > 4 else "SUCCESS") for c, (case, _) in enumerate(LINEAR) for i, o in enumerate(case)]
    got = {r.key: r for r in history.linearizability(spark.createDataFrame(ops, OP)).collect()}
    for c, (_, ok) in enumerate(LINEAR):
        if f"c{c}" in got:
            assert got[f"c{c}"].verdict == ("LINEARIZABLE" if ok else "VIOLATION"), c
    assert history.first_violation(history.linearizability(spark.createDataFrame(ops, OP))).collect()[0].key == "c4" and got["c4"].stuck == [402]
    five = hist(spark, *[("W", str(i), i, i + 1) for i in range(5)])
    assert [r.verdict for r in history.linearizability(five, 3).collect()] == ["INCONCLUSIVE"]
    assert history.linearizability(spark.createDataFrame([], OP)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["READ", "WRITE"]), st.sampled_from([None, "a", "b"]), st.integers(0, 20), st.integers(0, 8), st.booleans()), max_size=5))
def test_linearize_against_permutations(raw):
    ops = [(t, v if t == "READ" else v or "a", s, float("inf") if t == "WRITE" and u else s + d, t == "WRITE" and u) for t, v, s, d, u in raw]

    def legal(order):
        if any(ops[b][3] < ops[a][2] for i, a in enumerate(order) for b in order[i + 1 :]):
            return False
        value = None
        for i in order:
            if ops[i][0] == "READ" and ops[i][1] != value:
                return False
            value = ops[i][1] if ops[i][0] == "WRITE" else value
        return True

    optional = [i for i in range(len(ops)) if ops[i][4]]
    must = [i for i in range(len(ops)) if not ops[i][4]]
    want = any(legal(p) for n in range(len(optional) + 1) for some in itertools.combinations(optional, n) for p in itertools.permutations([*must, *some]))
    assert history.linearize(ops)[0] == want


def test_prefix_and_audit(spark):
    h = hist(spark, *second(("W", "a"), ("W", "b"), ("R", "a"), ("R", "b")))
    assert history.failing_prefix(h, history.stale_reads(h)).collect()[0].prefix == "WRITE a -> WRITE b -> READ a"
    writes = spark.createDataFrame([("a", "1", "SUCCESS"), ("b", "1", "SUCCESS"), ("c", "1", "SUCCESS"), ("d", "1", "UNKNOWN")], "key string, value string, result string")
    state = spark.createDataFrame([("a", "1")], "key string, value string")
    r = history.audit_acknowledged(writes, state, spark.createDataFrame([("a",), ("b",), ("d",)], "key string")).collect()[0]
    assert tuple(r) == (3, 1, 1, 1)


# logs


def test_at_most_once(spark):
    log = [(1, "c", 1, "PUT", "k", "v1"), (2, "o", 1, "PUT", "k", "v2"), (3, "c", 1, "PUT", "k", "v1"), (4, "c", 5, "PUT", "k", "v5"), (5, "c", 4, "PUT", "k", "v4"), (6, "c", 5, "PUT", "k", "other"), (7, "ghost", 7, "PUT", "g", "v"), (8, "c", 6, "DELETE", "k", None)]
    df = spark.createDataFrame(log, LOG)
    assert [o for _, o in rows(replog.apply_at_most_once(df), "idx", "outcome")] == ["APPLIED", "APPLIED", "DUPLICATE", "APPLIED", "STALE", "CONFLICT", "APPLIED", "APPLIED"]
    assert rows(replog.state_after(df), "key", "value", "version") == [("g", "v", 7)]
    last = replog.command_results(df).where("idx = 8").collect()[0]
    assert (last.result, last.existed) == ("v5", True)
    abc = spark.createDataFrame([(i, c, 1, "PUT", "k", c) for i, c in enumerate("abc", 1)], LOG)
    assert rows(replog.sessions(abc, 2), "client") == [("b",), ("c",)] and replog.evicts(abc, 2).collect()[0].evicts


def fold(records):
    base, entries = 0, []
    for _, kind, term, idx in records:
        if kind == "ENTRY" and idx > base:
            entries = [e for e in entries if e[0] < idx] + [(idx, term)]
        elif kind == "TRUNCATE":
            entries = [e for e in entries if e[0] < idx]
        elif kind == "SNAPSHOT":
            base = max(base, idx)
            entries = [e for e in entries if e[0] > idx]
    return entries


def test_replay_against_fold(spark):
    for seed in range(6):
        rng = random.Random(seed)
        records, base, last = [], 0, 0
        for o in range(120):
            kind = rng.choice(["ENTRY"] * 6 + ["TRUNCATE", "SNAPSHOT"])
            if kind == "ENTRY":
                idx = rng.randint(max(1, base - 2), last + 1)
                last = idx if idx > base else last
            elif kind == "TRUNCATE":
                idx = rng.randint(base + 1, last + 1)
                last = idx - 1
            else:
                idx = base = rng.randint(base, last)
            records.append((o, kind, o, idx))
        df = spark.createDataFrame([(o, k, t, None, i, b"") for o, k, t, i in records], "offset bigint, kind string, term bigint, voted_for string, idx bigint, command binary")
        assert rows(replog.replay(df), "idx", "term") == sorted(fold(records), key=repr)
        assert replog.replay_gaps(df).count() == 0


def test_votes_commit_and_merge(spark):
    log = spark.createDataFrame([(1, 1, b""), (2, 1, b""), (3, 2, b"")], "idx bigint, term bigint, command binary")
    m = lambda *x: spark.createDataFrame([(f"n{i}", v) for i, v in enumerate(x)], "node string, match_idx bigint")
    assert replog.commit_index(m(3, 3, 1), log, 2).collect()[0][0] == 3
    assert replog.commit_index(m(3, 2, 1), log, 2).collect()[0][0] == 0  # an older term's entry isn't committed by count
    sent = spark.createDataFrame([(2, 1, b"x"), (3, 3, b"x")], "idx bigint, term bigint, command binary")
    assert rows(replog.merge_entries(log, sent), "idx", "term") == [(1, 1), (2, 1), (3, 3)]
    assert rows(replog.merge_entries(log, sent.where("idx = 2")), "idx", "term") == [(1, 1), (2, 1), (3, 2)]


def test_conditional_requests(spark):
    ops = [("SET", "a", None), ("SET", "b", None), ("CAS", "c", 2), ("CAS", "d", 2), ("DELETE", None, 3), ("CAS", "e", 3), ("CAS", "f", 0), ("DELETE", None, 1), ("SET", "g", None)]
    df = spark.createDataFrame([(i, "k", o, v, e) for i, (o, v, e) in enumerate(ops)] + [(50 + i, "s", "SET", str(i), None) for i in range(3)], "idx bigint, key string, op string, value string, expected bigint")
    got = occ.apply_requests(df)
    assert [x for x, in rows(got.where("key = 'k'").select("idx", "success").orderBy("idx"), "success")].count(False) == 2
    assert rows(got.where("key = 'k'"), "idx", "success", "version") == [(0, True, 1), (1, True, 2), (2, True, 3), (3, False, 3), (4, True, 0), (5, False, 0), (6, True, 1), (7, True, 0), (8, True, 2)]
    assert rows(occ.current(got), "key", "version", "value") == [("k", 2, "g"), ("s", 3, "2")]


# hashing, placement, filters


def test_hash_against_plain_integers():
    def plain(t):
        h = hashing.FNV_BASIS
        for b in t.encode():
            h = (h ^ b) * hashing.FNV_PRIME % 2**64
        for m in (hashing.MIX_A, hashing.MIX_B):
            h = (h ^ h >> 33) * m % 2**64
        h ^= h >> 33
        return h - 2**64 if h >> 63 else h

    texts = ["", "a", "node-0#0", "日本語", "x" * 500]
    assert hashing.hash64(texts).tolist() == [plain(t) for t in texts]
    assert hashing.text_hash32("hello") == 99162322 and hashing.text_hash32("\U0001f600") == 1772899


def test_ring(spark):
    nodes = [f"node-{i}" for i in range(5)]
    keys = spark.range(20_000).select(F.concat(F.lit("key-"), "id").alias("key"))
    shares = [r["keys"] for r in ring.balance(ring.preference_lists(keys, nodes, 1)).collect()]
    assert len(shares) == 5 and all(0.65 * 4000 < s < 1.35 * 4000 for s in shares)
    ten = [f"node-{i}" for i in range(10)]
    moved = [r for r in ring.movement(spark.range(50_000).select(F.concat(F.lit("rebalance-key-"), "id").alias("key")), ten, [*ten, "node-10"]).collect() if r.old_owner != r.new_owner]
    assert {r.new_owner for r in moved} == {"node-10"} and 0.5 / 11 < sum(r["keys"] for r in moved) / 50_000 < 1.5 / 11
    three = ring.preference_lists(keys.limit(50), nodes, 3).collect()
    assert all(len(set(r.nodes)) == 3 for r in three)
    for n in (0, 6):
        with pytest.raises(ValueError):
            ring.preference_lists(keys, nodes, n)
    with pytest.raises(Exception, match="blank key"):
        ring.preference_lists(spark.createDataFrame([(" ",)], "key string"), nodes, 1).collect()
    with pytest.raises(ValueError):
        ring.membership(spark, "c", 3, 4)


def test_bloom(spark):
    assert bloom.sizing(1000, 0.01) == (9586, 7)
    m, k = bloom.sizing(10_000, 0.01)
    made = bloom.build(spark.range(10_000).select(F.concat(F.lit("present-"), "id").alias("key")), "key", m, k)
    probe = lambda p, n: bloom.probe(spark.range(n).select(F.concat(F.lit(p), "id").alias("key")), "key", made, m, k).where("might_contain").count()
    assert probe("present-", 10_000) == 10_000 and probe("absent-", 100_000) < 3000
    words = np.array([1, 2**63, 5], np.uint64)
    back = bloom.deserialize(bloom.serialize(words, 150, 4))
    assert back[0].tolist() == words.tolist() and back[1:] == (150, 4)


# metrics, workloads, faults


def test_percentiles(spark):
    f = lambda xs: tuple(metrics.latency_summary(spark.createDataFrame([(x,) for x in xs], "v bigint"), "v").collect()[0])
    assert f(random.Random(1).sample(range(1, 101), 100)) == (50, 95, 99)
    assert f([30, 10, 20, 40]) == (20, 40, 40) and f([]) == (0, 0, 0)


def test_exposition_round_trip(spark):
    m = spark.createDataFrame([('n"\\\n', 3)], "node string, reads bigint")
    lines = [r.line for r in metrics.exposition(m, "node", {"reads": "Reads."}, {}).orderBy("line_no").collect()]
    assert lines == ["# HELP keyloom_reads_total Reads.", "# TYPE keyloom_reads_total counter", 'keyloom_reads_total{node="n\\"\\\\\\n"} 3']
    got = metrics.parse_exposition(spark.createDataFrame([(x,) for x in [*lines, "bad line", 'up{a="1",b="x,y"} 1.5e3', "plain 7"]], "line string")).collect()
    assert [(r.metric, r["value"]) for r in got] == [("keyloom_reads_total", 3.0), ("up", 1500.0), ("plain", 7.0)] and got[1].labels == {"a": "1", "b": "x,y"}


def test_workload_mixes(spark):
    n = {r.kind: r["n"] for r in workload.run_phase(spark, "A", 1000, 5000, 64).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert 0.45 < n["READ"] / 5000 < 0.55 and set(n) == {"READ", "UPDATE"}
    assert {r.kind for r in workload.run_phase(spark, "C", 1000, 500, 64).collect()} == {"READ"}
    e = workload.run_phase(spark, "E", 1000, 5000, 64).where("kind = 'SCAN'").agg(F.min("scan_length"), F.max("scan_length")).first()
    assert e[0] >= 1 and e[1] <= 100
    a, b = (workload.run_phase(spark, "D", 100, 300, 8, seed=s).collect() for s in (1, 1))
    assert a == b and all(len(r.value) == 8 for r in a if r.value)
    hot = workload.run_phase(spark, "C", 1000, 5000, 8).groupBy("key").count().orderBy(F.desc("count")).first()
    assert hot.key == "user0000000000" and hot["count"] > 400


def test_workload_replay_against_loop(spark):
    ops = workload.run_phase(spark, "E", 50, 400, 8, 20, "uniform").collect()
    present, want = {f"user{i:010d}" for i in range(50)}, {}
    for o in sorted(ops, key=lambda o: o.idx):
        if o.kind == "SCAN":
            want[o.idx] = min(o.scan_length, sum(k >= o.key for k in present))
        else:
            present.add(o.key)
            want[o.idx] = 1
    got = workload.run_workload(spark.createDataFrame(ops, "idx bigint, kind string, key string, value string, scan_length int"), workload.load_phase(spark, 50, 8).select("key"))
    assert {r.idx: r.rows for r in got.collect()} == want


def test_faults(spark):
    m = spark.range(4000).select(F.concat(F.lit("m"), "id").alias("message"), F.lit("a").alias("source"), F.lit("b").alias("target"))
    dropped = faults.drop_messages(m, 0.25, 7).where("dropped").count()
    assert 850 < dropped < 1150 and dropped == faults.drop_messages(m.repartition(9), 0.25, 7).where("dropped").count()
    assert faults.drop_messages(m, 0.0, 7).where("dropped").count() == 0 and faults.drop_messages(m, 1.0, 7).where("dropped").count() == 4000
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a"), ("a", "z")], "source string, target string")
    groups = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "node string, `group` string")
    assert rows(faults.reachable(pairs, groups), "target", "reachable") == [("a", True), ("b", True), ("c", False), ("z", True)]
    assert faults.reachable(pairs, groups, False).where("NOT reachable").count() == 0
