import oracle
import pytest

from keyloom.operators import lsm, replog, running
from keyloom.plans import registry
from keyloom.session import staging_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "pushed", "picked"), [
    ("sc1_point_get", "EqualTo(key,user0000000007)", None),
    ("sc2_range_scan", "GreaterThanOrEqual(key,user0000000020), LessThan(key,user0000000090)", None),
    ("sc3_run_lookup", "EqualTo(key,user0000000007)", "(run_id"),
    ("sc4_run_scan", "GreaterThanOrEqual(key,user0000000020), LessThan(key,user0000000040)", "(run_id"),
])
def test_predicates_reach_the_files(spark, name, pushed, picked):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert f"PushedFilters: [IsNotNull(key), {pushed}]" in plan
    assert picked is None or picked in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("name", ["ck1_stale_reads", "ck2_read_your_writes", "ck3_monotonic", "rl1_at_most_once", "rl3_results", "rl5_replay", "rl5_gaps", "rl5_nodes", "oc1_set"])
def test_groups_in_ranges_give_the_same(spark, monkeypatch, name):
    """With no group whole in a task, whatever its size."""
    monkeypatch.setattr(running, "GROUP", 0)
    assert oracle.compare(name, registry.QUERIES[name](spark, SF), oracle.connect(SF), registry.ORACLES[name]) == ""


def test_staged_tables_are_released(spark):
    from keyloom import session

    held = session.stage(spark.range(5).toDF("id"), "x")
    path = held.inputFiles()[0]
    assert session.release_staged(spark) >= 1 and session.release_staged(spark) == 0
    assert not session.release(spark, path)


def test_runs_keep_their_tombstones(spark):
    e = spark.createDataFrame([("a", "x", 1, 0), ("a", None, 2, 1), ("b", None, 3, 0), ("b", "y", 4, 0)], "key string, value string, seq bigint, run_id int")
    runs = lsm.flush_runs(e, staging_path(spark, "runs"))
    look = lambda r, k: [tuple(x) for x in lsm.run_lookup(runs, r, k).collect()]
    assert look(0, "a") == [("a", "x", 1)] and look(1, "a") == [("a", None, 2)] and look(1, "b") == [] and look(0, "b") == [("b", "y", 4)]
    assert lsm.point_get(runs, "a").count() == 0 and [r.value for r in lsm.point_get(runs, "b").collect()] == ["y"]


def test_a_gap_is_an_error(spark):
    log = spark.createDataFrame([(0, "SNAPSHOT", 1, 4, None), (1, "ENTRY", 1, 5, "a"), (2, "ENTRY", 1, 6, "b"), (3, "ENTRY", 1, 8, "c")], "offset bigint, kind string, term bigint, idx bigint, command string")
    assert [(r.idx, r.prev) for r in replog.replay_gaps(log).collect()] == [(8, 6)]
    assert sorted(r.idx for r in replog.replay_checked(log.where("offset < 3")).collect()) == [5, 6]
    with pytest.raises(Exception, match="gap in the log between 6 and 8"):
        replog.replay_checked(log).collect()
    first = log.where("offset <> 1")  # nothing follows the snapshot
    assert sorted((r.idx, r.prev) for r in replog.replay_gaps(first).collect()) == [(6, 4), (8, 6)]
