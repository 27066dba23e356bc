"""Queries do the whole job: against brute force, or their SQL on tables beyond the former cuts."""

import os
import random
from collections import Counter, defaultdict

import pytest

import oracle
from keyloom.operators import bloom, history, quorum, replog
from keyloom.plans import derive, registry
from keyloom.plans.derive import with_views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def run(spark, name):
    return registry.QUERIES[name](spark, SF)


def test_linearizability_of_whole_keys(spark, con):
    ops = defaultdict(list)
    for idx, key, *o, result in con.execute(with_views("op_history", body="SELECT idx, key, type, value, start_ms, end_ms, result FROM op_history WHERE result = 'SUCCESS' OR (result = 'UNKNOWN' AND type = 'WRITE') ORDER BY idx")).fetchall():
        ops[key].append((idx, (*o[:3], float("inf") if result == "UNKNOWN" else o[3], result == "UNKNOWN")))
    verdict = {k: "INCONCLUSIVE" if len(o) > 64 else "LINEARIZABLE" if history.linearize([x for _, x in o])[0] else "VIOLATION" for k, o in ops.items()}
    want = sorted((k, o[0][0], len(o), verdict[k]) for k, o in ops.items())
    assert sorted(map(tuple, run(spark, "ck6_linearizability").select("key", "first_idx", "n_ops", "verdict").collect())) == want
    assert dict(map(tuple, run(spark, "ck13_tally").collect())) == Counter(verdict.values())
    first = min((o[0][0], k) for k, o in ops.items() if verdict[k] == "VIOLATION")[1]
    assert [r.key for r in run(spark, "ck8_witness").collect()] == [first]


def test_failing_prefix_of_whole_keys(spark, con):
    assert oracle.compare("ck11_failing_prefix", run(spark, "ck11_failing_prefix"), con, registry.ORACLES["ck11_failing_prefix"]) == ""


def lru(log, cap):
    """Outcomes by idx and the sessions (client, seq, applied idx, last use, command) left, oldest first."""
    held, out = [], {}
    for idx, client, seq, *cmd in sorted(log):
        mine = next((s for s in held if s[0] == client), None)
        if mine is None or seq > mine[1]:
            out[idx], new = "APPLIED", (client, seq, idx, idx, cmd)
        elif seq == mine[1] and cmd == mine[4]:
            out[idx], new = "DUPLICATE", (*mine[:3], idx, cmd)
        else:
            out[idx], new = "STALE" if seq < mine[1] else "CONFLICT", None
        if new:
            held = [*(s for s in held if s[0] != client), new][-cap:]
    return out, held


def test_sessions_are_evicted(spark, con):
    log = con.execute(with_views("raft_log", body="SELECT idx, client, seq, op, key, value FROM raft_log")).fetchall()
    want = sorted(s[:4] for s in lru(log, 20)[1])
    assert sorted(map(tuple, run(spark, "rl4_sessions").select("client", "last_seq", "applied_idx", "last_used").collect())) == want


@pytest.mark.parametrize("cap", [1, 3, 5, 8])
def test_at_most_once_against_lru(spark, cap):
    r = random.Random(cap)
    log = [(i, f"c{r.randrange(8)}", r.randint(1, 4), "PUT", "k" + str(r.randrange(2)), "v" + str(r.randrange(2))) for i in range(1, 301)]
    df = spark.createDataFrame(log, "idx bigint, client string, seq bigint, op string, key string, value string").repartition(4)
    out, held = lru(log, cap)
    assert {x.idx: x.outcome for x in replog.apply_at_most_once(df, cap).collect()} == out
    assert sorted(map(tuple, replog.sessions(df, cap).collect())) == sorted(s[:4] for s in held)
    last = {s[0]: s for s in held}

    def status(client, seq, *cmd):
        s = last.get(client)
        return "NOT_APPLIED" if s is None or seq > s[1] else "STALE" if seq < s[1] else "APPLIED" if list(cmd) == s[4] else "CONFLICT"

    got = replog.request_outcomes(df.drop("idx").distinct(), df, cap).collect()
    assert len(got) == len({x[1:] for x in log}) and all(x.status == status(*tuple(x)[:5]) for x in got)
    state = {}
    for idx, _, _, _, key, value in log:
        if out[idx] == "APPLIED":
            state[key] = (key, value, idx)
    assert sorted(map(tuple, replog.state_after(df, cap).select("key", "value", "version").collect())) == sorted(state.values())


def test_every_key_is_deleted(spark, con):
    keys = con.execute("SELECT count(DISTINCT o_custkey) FROM orders").fetchone()[0]
    assert run(spark, "qr8_delete").count() == keys
    assert oracle.compare("qr8_delete", run(spark, "qr8_delete"), con, registry.ORACLES["qr8_delete"]) == ""


def test_delete_of_a_key_without_clocks(spark):
    r = spark.createDataFrame([("k", "n0", "v", 0, {}, False), ("t", "n0", "", 2, {"b": 2}, True)], "key string, node string, value string, version bigint, clock map<string,bigint>, tombstone boolean")
    got = quorum.delete_as_write(r, r.select("key"), "a").where("existed is not null").collect()
    assert sorted((x.key, x.clock, x.version, x.existed) for x in got) == [("k", {"a": 1}, 1, True), ("t", {"a": 1, "b": 2}, 3, False)]


def test_only_keys_past_the_bound_are_inconclusive(spark, con):
    assert history.MAX_OPERATIONS == 64
    assert oracle.compare("ck7_inconclusive", run(spark, "ck7_inconclusive"), con, registry.ORACLES["ck7_inconclusive"]) == ""


def test_snapshot_and_read_scale_with_the_log(spark):
    sf = "/root/testdata/sf0.01"  # at sf0.001 half of the log is the former constant
    larger = oracle.connect(sf)
    last = larger.execute("SELECT max(event_id) + 1 FROM events").fetchone()[0]
    assert {r.last_included_index for r in registry.QUERIES["sk7_snapshot"](spark, sf).collect()} == {last}
    for name in ("sk7_snapshot", "sc13_read_as_of"):
        assert oracle.compare(name, registry.QUERIES[name](spark, sf), larger, registry.ORACLES[name]) == ""


def test_probe_counts_members_and_others(spark, con):
    members, others = ([x for (x,) in con.execute(f"SELECT {c} FROM {t}").fetchall()] for c, t in (("c_name", "customer"), ("s_name", "supplier")))
    m, k = bloom.sizing(len(members), 0.01)
    held = set(bloom.positions(members, m, k).ravel().tolist())
    wrong = sum(held.issuperset(x) for x in bloom.positions(others, m, k).T.tolist())
    got = run(spark, "bf3_probe").collect()[0].asDict()
    assert got == {"found": len(members), "lost": 0, "false_positives": wrong, "non_members": len(others)}
