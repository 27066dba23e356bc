"""Queries over replicated logs, optimistic concurrency, metrics, workloads and fault models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import faults, lsm, metrics, occ, replog, workload
from keyloom.plans import derive
from keyloom.plans.derive import with_views
from keyloom.session import table


def wal_records(spark: SparkSession, sf: str) -> DataFrame:
    """A node's log records: (offset, kind, term, voted_for, idx, command), free of gaps."""
    e = F.col("event_id")
    idx = F.expr("event_id - 2 * (event_id div 10) + 1")
    kind = F.when(e % 50 == 49, F.when(e % 100 == 99, "TERM").otherwise("TRUNCATE")).when(e % 100 == 59, "SNAPSHOT").when(e % 100 == 19, "VOTE").otherwise("ENTRY")
    t = table(spark, sf, "events").select(e.alias("offset"), kind.alias("kind"), F.expr("event_id div 100").alias("t"), idx.alias("i"))
    k = F.col("kind")
    return t.select(
        "offset", "kind", F.when(k.isin("ENTRY", "TERM", "SNAPSHOT"), F.col("t")).alias("term"), F.when(k.isin("TERM", "VOTE"), F.concat(F.lit("n"), F.col("t") % 5)).alias("voted_for"),
        F.when(k == "ENTRY", F.col("i")).when(k == "TRUNCATE", F.col("i") - 1).when(k == "SNAPSHOT", F.col("i") - 20).alias("idx"), F.when(k == "ENTRY", F.concat(F.lit("c"), "offset")).alias("command"),
    )


def rl1_at_most_once(spark: SparkSession, sf: str) -> DataFrame:
    return replog.apply_at_most_once(derive.raft_log(spark, sf)).select("idx", "client", "seq", "outcome")


def rl2_state(spark: SparkSession, sf: str) -> DataFrame:
    return replog.state_after(derive.raft_log(spark, sf))


def rl3_results(spark: SparkSession, sf: str) -> DataFrame:
    return replog.command_results(derive.raft_log(spark, sf))


def rl4_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return replog.sessions(derive.raft_log(spark, sf), 20)


def rl5_replay(spark: SparkSession, sf: str) -> DataFrame:
    return replog.replay(wal_records(spark, sf))


def rl5_state(spark: SparkSession, sf: str) -> DataFrame:
    return replog.replay_state(wal_records(spark, sf))


def rl5_checked(spark: SparkSession, sf: str) -> DataFrame:
    """The same, as an error if there were a gap."""
    return replog.replay_checked(wal_records(spark, sf))


def rl5_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Where entries don't follow each other if the log lost some records."""
    return replog.replay_gaps(wal_records(spark, sf).where("NOT (kind = 'ENTRY' AND offset % 50 = 7)"))


def rl5_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of three nodes, each without some of the records, replayed by themselves."""
    nodes = wal_records(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("offset % 7 <> i")
    return replog.replay(nodes.withColumn("node", F.concat(F.lit("n"), "i")), "node")


def _two_logs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events").select((F.col("event_id") + 1).alias("idx"))
    n = e.select(F.max("idx").alias("m")).scalar()
    local = e.where(F.col("idx") * 4 <= n * 3).select("idx", F.expr("idx div 100").alias("term"), F.concat(F.lit("a"), "idx").alias("command"))
    # the sender's terms part from the local ones at the half
    sent = e.where(F.col("idx") * 4 > n).select("idx", (F.expr("idx div 100") + (F.col("idx") * 2 > n).cast("int")).alias("term"), F.concat(F.lit("b"), "idx").alias("command"))
    return local, sent


def rl6_merge(spark: SparkSession, sf: str) -> DataFrame:
    return replog.merge_entries(*_two_logs(spark, sf))


def rl7_check(spark: SparkSession, sf: str) -> DataFrame:
    local, sent = _two_logs(spark, sf)
    reqs = sent.select(F.col("idx").alias("req"), (F.col("idx") - 1).alias("prev_idx"), F.col("term").alias("prev_term"))
    return replog.append_check(local, reqs)


def rl8_commit(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    matches = e.groupBy((F.col("event_id") % 5).alias("node")).agg((F.max("event_id") - (F.col("node") * 37)).alias("match_idx"))
    log = e.select((F.col("event_id") + 1).alias("idx"), F.expr("event_id div 1000").alias("term"))
    top = e.select(F.expr("max(event_id) div 1000").alias("t")).scalar()
    return replog.commit_index(matches, log, top)


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.concat(F.lit("v"), e % 5).alias("voter"), F.concat(F.lit("c"), e % 3).alias("candidate"), F.expr("event_id div 50").alias("term"), F.expr("event_id div 70").alias("last_term"), (e % 40).alias("last_idx"),
        (F.expr("event_id div 50") - e % 2 + (e % 7 == 0).cast("int")).alias("my_term"), F.when(e % 4 == 0, F.concat(F.lit("c"), e % 2)).alias("voted_for"), F.expr("event_id div 71").alias("my_last_term"), (e % 37).alias("my_last_idx"),
    )


def rl9_votes(spark: SparkSession, sf: str) -> DataFrame:
    return replog.elections(replog.grant_votes(_votes(spark, sf)), 5)


def rl10_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes' snapshot points and the tail each keeps."""
    n = table(spark, sf, "events").groupBy((F.col("event_id") % 6).alias("node")).agg(F.max("event_id").alias("applied"))
    return n.select("node", replog.compaction_point(F.col("applied"), F.col("applied") - F.col("node") * 100, 250).alias("snapshot_at"))


def rl11_replication(spark: SparkSession, sf: str) -> DataFrame:
    followers = table(spark, sf, "events").groupBy((F.col("event_id") % 9).alias("f")).agg(F.count(F.lit(1)).alias("c")).select(F.concat(F.lit("f"), "f").alias("follower"), (F.col("f") * 100 + 1).alias("next_idx"))
    log = derive.raft_log(spark, sf)
    return replog.replication_plan(followers, log, 350)


def rl12_install(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return replog.install_snapshot(table(spark, sf, "events").select(e.alias("node"), (e % 50).alias("snapshot_idx"), (e % 30).alias("base_idx"), (e % 41).alias("commit_idx")))


def rl13_readiness(spark: SparkSession, sf: str) -> DataFrame:
    members = spark.range(5).select(F.concat(F.lit("n"), "id").alias("node"), F.when(F.col("id") == 0, "leader").otherwise("follower").alias("role"), F.lit("n0").alias("leader"))
    hb = table(spark, sf, "events").select(F.concat(F.lit("n"), F.col("event_id") % 5).alias("node"), F.concat(F.lit("n"), F.expr("event_id div 5 % 4")).alias("peer"), F.expr("event_id div 10").alias("tick"))
    return replog.readiness(members, hb.where("NOT (node = 'n3' AND peer = 'n0')"), hb.select(F.max("tick")).scalar(), 3)


def rl14_barriers(spark: SparkSession, sf: str) -> DataFrame:
    """Commands applied if every 13th entry is a barrier."""
    log = derive.raft_log(spark, sf).withColumn("op", F.when(F.col("idx") % 13 != 0, F.col("op")))
    return replog.apply_at_most_once(log).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def rl15_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    log = derive.raft_log(spark, sf)
    return replog.request_outcomes(log.select("client", "seq", "op", "key", "value").distinct(), log)


def _last_index(log: DataFrame) -> int:
    return log.select(F.coalesce(F.max("idx"), F.lit(0)).alias("m")).first().m


def sc13_read_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The map halfway through the log."""
    log = derive.raft_log(spark, sf).withColumn("value", F.when(F.col("op") == "PUT", F.col("value")))
    return lsm.read_as_of(log, _last_index(log) // 2)


def sk7_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The whole applied state."""
    log = derive.raft_log(spark, sf).withColumn("value", F.when(F.col("op") == "PUT", F.col("value")))
    return lsm.snapshot(log, _last_index(log))


def occ_requests(spark: SparkSession, sf: str) -> DataFrame:
    """(idx, key, op, value, expected): a third of the keys see only sets."""
    e = F.col("event_id")
    op = F.when((F.col("user_id") % 3 == 0) | (e % 4 == 0), "SET").when(e % 4 == 3, "DELETE").otherwise("CAS")
    return table(spark, sf, "events").select(e.alias("idx"), F.concat(F.lit("u"), "user_id").alias("key"), op.alias("op"), F.concat(F.lit("v"), "event_id").alias("value"), (e % 3).alias("expected"))


def oc1_set(spark: SparkSession, sf: str) -> DataFrame:
    return occ.set_versions(occ_requests(spark, sf).where("op = 'SET'"))


def oc2_oc3_requests(spark: SparkSession, sf: str) -> DataFrame:
    return occ.apply_requests(occ_requests(spark, sf)).select("key", "idx", "op", "success", "version")


def oc4_current(spark: SparkSession, sf: str) -> DataFrame:
    return occ.current(occ.apply_requests(occ_requests(spark, sf)))


def oc4_cleared(spark: SparkSession, sf: str) -> DataFrame:
    """Keys present, in order, if the store is cleared halfway."""
    r = occ_requests(spark, sf)
    half = r.select(F.expr("max(idx) div 2")).scalar()
    return occ.current(occ.apply_requests(occ.after_clear(r, half))).select("key", "version")


def oc4_size(spark: SparkSession, sf: str) -> DataFrame:
    return occ.size(occ.apply_requests(occ_requests(spark, sf)))


def _ops(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.concat(F.lit("n"), e % 3).alias("node"), F.when(e % 3 != 0, "READ").otherwise("WRITE").alias("type"), (e % 9 != 0).alias("ok"), (e % 18 != 0).alias("quorum_met"), (e % 5 == 0).alias("stale"), (e % 8 == 0).alias("conflict"),
        ((e * 31) % 97 - 5).alias("latency_ms"), (e % 4).alias("replicas"),
    )


def mx1_operations(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.operation_metrics(_ops(spark, sf), "node")


def mx2_latency(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latency_summary(_ops(spark, sf), "latency_ms", "node")


def mx3_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.experiment_report(_ops(spark, sf), "latency_ms", "type")


def mx4_repairs(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.repair_metrics(_ops(spark, sf), "node")


def mx5_hedges(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.hedge_total(_ops(spark, sf), "latency_ms", "node")


COUNTERS = {"operations": "Operations.", "reads": "Reads.", "writes": "Writes."}


def sk8_exposition(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.operation_metrics(_ops(spark, sf), "node").withColumn("node", F.concat("node", F.lit('"\\\n')))
    return metrics.exposition(m, "node", COUNTERS, {"latency_total_ms": "Latency."})


def sk8_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.quantile_lines(metrics.latency_summary(_ops(spark, sf), "latency_ms", "node"), "node")


def sk8_members(spark: SparkSession, sf: str) -> DataFrame:
    """Role and leader of every event's node as exposition lines, counted."""
    e = F.col("event_id")
    status = table(spark, sf, "events").select(F.concat(F.lit("n"), e % 5).alias("node"), F.element_at(F.array(F.lit("LEADER"), F.lit("CANDIDATE"), F.lit("FOLLOWER")), (e % 3 + 1).cast("int")).alias("role"), F.when(e % 4 > 0, F.concat(F.lit('n"'), e % 4)).otherwise("").alias("leader"))
    return metrics.member_lines(status, "node").groupBy("node", "line_no", "line").agg(F.count(F.lit(1)).alias("n"))


def sc15_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The exposition read back."""
    lines = metrics.exposition(metrics.operation_metrics(_ops(spark, sf), "node"), "node", COUNTERS, {"latency_total_ms": "Latency."})
    return metrics.parse_exposition(lines.drop("node")).select("metric", F.col("labels")["node"].alias("node"), "value")


def sk9_report(spark: SparkSession, sf: str) -> DataFrame:
    m = _ops(spark, sf).groupBy("node").agg(F.sum("replicas").alias("sstable_bytes"), F.count(F.lit(1)).alias("user_bytes"))
    m = m.select(F.col("node").alias("label"), F.expr("cast(substr(node, 2) as bigint)").alias("position"), (F.col("sstable_bytes") * 4096).alias("sstable_bytes"), (F.col("user_bytes") * 4096).alias("user_bytes"),
                 (F.col("sstable_bytes") * 2048).alias("live_bytes"), F.lit(0).alias("logical_bytes"), F.lit(1.5).alias("read_amp"), F.lit(3).alias("tables"))
    return metrics.amplification_report(m)


def wg1_mixes(spark: SparkSession, sf: str) -> DataFrame:
    return workload.mixes(spark)


def wg1_pick(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(((F.col("event_id") % 1000) / 1000.0).alias("u"))
    return e.groupBy(workload.pick(F.col("u"), "B").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def wg2_wg5_load(spark: SparkSession, sf: str) -> DataFrame:
    return workload.load_phase(spark, 1000, 64)


def wg3_run(spark: SparkSession, sf: str) -> DataFrame:
    return workload.run_phase(spark, "A", 1000, 5000, 64).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))


def wg4_zeta(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(1000, workload.zeta(spark, 1000))], "n bigint, zeta double").select("n", F.round("zeta", 6).alias("zeta"))


def wg6_replay(spark: SparkSession, sf: str) -> DataFrame:
    ops = workload.run_phase(spark, "E", 1000, 5000, 64, 100, "uniform")
    return workload.run_workload(ops, workload.load_phase(spark, 1000, 64).select("key")).groupBy("kind").agg(F.count(F.lit(1)).alias("ops"), F.sum("rows").alias("rows"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(F.concat(F.lit("m"), e).alias("message"), F.concat(F.lit("n"), e % 5).alias("source"), F.concat(F.lit("n"), F.expr("event_id div 5 % 5")).alias("target"))


def fp1_drops(spark: SparkSession, sf: str) -> DataFrame:
    return faults.drop_messages(_messages(spark, sf), 0.25, 7)


def fp2_delivery(spark: SparkSession, sf: str) -> DataFrame:
    down = spark.createDataFrame([("n1",)], "node string")
    slow = spark.createDataFrame([("n2", 40), ("n3", 7)], "node string, latency_ms int")
    return faults.delivery(_messages(spark, sf), down, slow).groupBy("target", "available", "latency_ms").agg(F.count(F.lit(1)).alias("n"))


def fp3_reachable(spark: SparkSession, sf: str) -> DataFrame:
    groups = spark.createDataFrame([("n0", "a"), ("n1", "a"), ("n2", "b"), ("n3", "b")], "node string, `group` string")
    return faults.reachable(_messages(spark, sf), groups).groupBy("source", "target", "reachable").agg(F.count(F.lit(1)).alias("n"))


def ex1_outages(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    probes = table(spark, sf, "events").select(F.expr("event_id div 500").alias("cycle"), (e * 10).alias("at_ms"), ((e % 500 < 100) | (e % 500 > 180 + F.expr("event_id div 500"))).alias("ok"), (e % 500 > 250).alias("all_applied"))
    kills = probes.groupBy("cycle").agg((F.min("at_ms") + 1000).alias("kill_ms"))
    return faults.outages(kills, probes)


QUERIES = {
    f.__name__: f
    for f in (rl1_at_most_once, rl2_state, rl3_results, rl4_sessions, rl5_replay, rl5_state, rl5_checked, rl5_gaps, rl5_nodes, rl6_merge, rl7_check, rl8_commit, rl9_votes, rl10_compaction, rl11_replication, rl12_install, rl13_readiness, rl14_barriers,
              rl15_outcomes, sc13_read_as_of, sk7_snapshot, oc1_set, oc2_oc3_requests, oc4_current, oc4_cleared, oc4_size, mx1_operations, mx2_latency, mx3_report, mx4_repairs, mx5_hedges, sk8_exposition, sk8_quantiles, sk8_members, sc15_parse, sk9_report, wg1_mixes, wg1_pick,
              wg2_wg5_load, wg3_run, wg4_zeta, wg6_replay, fp1_drops, fp2_delivery, fp3_reachable, ex1_outages)
}

_APPLY = """, b AS (SELECT *, max(seq) OVER (PARTITION BY client ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx,
    first_value(struct_pack(o := op, k := key, v := value)) OVER (PARTITION BY client, seq ORDER BY idx) AS f FROM raft_log),
  ap AS (SELECT *, CASE WHEN mx IS NULL OR seq > mx THEN 'APPLIED' WHEN seq < mx THEN 'STALE' WHEN f.o = op AND f.k = key AND f.v IS NOT DISTINCT FROM value THEN 'DUPLICATE' ELSE 'CONFLICT' END AS outcome FROM b)"""
_LWW = "SELECT key, m.v AS value, m.i AS version FROM (SELECT key, max(struct_pack(i := idx, v := CASE WHEN op = 'PUT' THEN value END)) AS m FROM {t} GROUP BY key) WHERE m.v IS NOT NULL"
_WAL = """WITH t AS (SELECT event_id AS "offset", CASE WHEN event_id % 100 = 99 THEN 'TERM' WHEN event_id % 50 = 49 THEN 'TRUNCATE' WHEN event_id % 100 = 59 THEN 'SNAPSHOT' WHEN event_id % 100 = 19 THEN 'VOTE' ELSE 'ENTRY' END AS kind,
    event_id // 100 AS t, event_id - 2 * (event_id // 10) + 1 AS i FROM events),
  wal AS (SELECT "offset" AS o, kind, t AS term, CASE kind WHEN 'ENTRY' THEN i WHEN 'TRUNCATE' THEN i - 1 WHEN 'SNAPSHOT' THEN i - 20 END AS idx FROM t)"""
_REPLAYED = """, base AS (SELECT *, coalesce(max(CASE WHEN kind = 'SNAPSHOT' THEN idx END) OVER ({by} ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM {wal}),
      live AS (SELECT *, min(CASE WHEN kind IN ('ENTRY', 'TRUNCATE') THEN idx END) OVER w AS cut, max(CASE WHEN kind = 'SNAPSHOT' THEN idx END) OVER w AS covered FROM base WHERE kind <> 'ENTRY' OR idx > base
        WINDOW w AS ({by} ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
      r AS (SELECT *, 'c' || o AS command FROM live WHERE kind = 'ENTRY' AND (cut IS NULL OR cut > idx) AND (covered IS NULL OR covered < idx))"""
_SPLIT = """WITH n AS (SELECT max(event_id) + 1 AS n FROM events),
  l AS (SELECT event_id + 1 AS idx, (event_id + 1) // 100 AS term, 'a' || (event_id + 1) AS command FROM events, n WHERE (event_id + 1) * 4 <= n * 3),
  s AS (SELECT event_id + 1 AS idx, (event_id + 1) // 100 + CASE WHEN (event_id + 1) * 2 > n THEN 1 ELSE 0 END AS term, 'b' || (event_id + 1) AS command FROM events, n WHERE (event_id + 1) * 4 > n)"""
_OPS = """WITH ops AS (SELECT 'n' || (event_id % 3) AS node, CASE WHEN event_id % 3 <> 0 THEN 'READ' ELSE 'WRITE' END AS type, event_id % 9 <> 0 AS ok, event_id % 18 <> 0 AS quorum_met, event_id % 5 = 0 AS stale, event_id % 8 = 0 AS conflict,
    (event_id * 31) % 97 - 5 AS latency_ms, event_id % 4 AS replicas FROM events)"""
_METRICS = """, m AS (SELECT node, count(*) AS operations, count(*) FILTER (type = 'READ') AS reads, count(*) FILTER (type = 'WRITE') AS writes, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failure,
    count(*) FILTER (NOT quorum_met) AS quorum_failure, count(*) FILTER (ok AND type = 'READ' AND stale) AS stale_reads, count(*) FILTER (ok AND type = 'READ' AND conflict) AS conflicts,
    CAST(sum(greatest(latency_ms, 0)) AS BIGINT) AS latency_total_ms FROM ops GROUP BY node)"""
_RANK = "list_sort(list({v}))[CAST(ceil({p} * count(*)) AS BIGINT)]"
_MSG = "WITH msg AS (SELECT 'm' || event_id AS message, 'n' || (event_id % 5) AS source, 'n' || (event_id // 5 % 5) AS target FROM events)"

# each key's requests one after another
_OCC = """WITH RECURSIVE q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS rn FROM (SELECT event_id AS idx, 'u' || user_id AS key, 'v' || event_id AS v, event_id % 3 AS expected,
      CASE WHEN user_id % 3 = 0 OR event_id % 4 = 0 THEN 'SET' WHEN event_id % 4 = 3 THEN 'DELETE' ELSE 'CAS' END AS op FROM events {where})),
  f AS (SELECT DISTINCT key, 0::BIGINT AS rn, NULL::BIGINT AS idx, NULL::VARCHAR AS op, NULL::BOOLEAN AS ok, 0::BIGINT AS counter, false AS present, 0::BIGINT AS version, NULL::VARCHAR AS value FROM q
    UNION ALL SELECT key, rn, idx, op, ok, c, CASE WHEN ok THEN op <> 'DELETE' ELSE present END, CASE WHEN ok AND op <> 'DELETE' THEN c ELSE version END, CASE WHEN NOT ok THEN value WHEN op <> 'DELETE' THEN v END FROM (
      SELECT *, CASE WHEN NOT ok OR op = 'DELETE' THEN counter WHEN op = 'CAS' AND NOT present THEN 1 ELSE counter + 1 END AS c FROM (
        SELECT q.key, q.rn, q.idx, q.op, q.v, counter, present, version, value,
          CASE WHEN q.op = 'SET' THEN true WHEN q.op = 'CAS' AND NOT present THEN expected = 0 ELSE present AND version = expected END AS ok FROM f JOIN q ON q.key = f.key AND q.rn = f.rn + 1))),
  o AS (SELECT key, idx, op, ok AS success, CASE WHEN present THEN version ELSE 0 END AS version, value FROM f WHERE rn > 0),
  l AS (SELECT key, max(struct_pack(i := idx, version := version, value := value)) AS m FROM o GROUP BY key)"""


def _drops_sql(rate: float, seed: int) -> str:
    """A draw of 64 bits out of seed, message and both nodes, a step a view, in 128-bit numbers cut to 64 after each product."""
    hash32 = "list_reduce(list_prepend(0::UBIGINT, list_transform(range(1, strlen({t}) + 1), lambda i: ord(substr({t}, i, 1))::UBIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"
    wide = lambda t: f"(SELECT CASE WHEN x >= 2147483648 THEN (x::UHUGEINT + 18446744069414584320)::UBIGINT ELSE x END FROM (SELECT {hash32.format(t=t)} AS x))"
    parts = [f"{seed}::UBIGINT", "m", "a", "b"]
    views = [f"s0 AS (SELECT message, source, target, 0::UBIGINT AS h, {wide('message')} AS m, {wide('source')} AS a, {wide('target')} AS b FROM msg)"]
    for part in parts:
        for step in (f"xor(h, {part})", "xor(h, h >> 33)", "((h::UHUGEINT * 18397679294719823053) % 18446744073709551616)::UBIGINT", "xor(h, h >> 33)", "((h::UHUGEINT * 14181476777654086739) % 18446744073709551616)::UBIGINT", "xor(h, h >> 33)"):
            views.append(f"s{len(views)} AS (SELECT * REPLACE ({step} AS h) FROM s{len(views) - 1})")
    return _MSG + ", " + ",\n".join(views) + f" SELECT message, source, target, (h >> 11)::DOUBLE * power(2.0, -53) < {rate} AS dropped FROM s{len(views) - 1}"


ORACLES = {
    "rl1_at_most_once": with_views("raft_log", body=_APPLY + " SELECT idx, client, seq, outcome FROM ap"),
    "rl2_state": with_views("raft_log", body=_APPLY + " " + _LWW.format(t="(SELECT * FROM ap WHERE outcome = 'APPLIED')")),
    "rl3_results": with_views("raft_log", body=_APPLY + """, p AS (SELECT *, lag(CASE WHEN op = 'PUT' THEN value END) OVER (PARTITION BY key ORDER BY idx) AS prev FROM ap WHERE outcome = 'APPLIED')
      SELECT idx, op, CASE WHEN op = 'PUT' THEN value ELSE coalesce(prev, '') END AS result, CASE WHEN op = 'DELETE' THEN coalesce(length(prev) > 0, false) END AS existed FROM p"""),
    # a fold over the log with the 20 sessions used last, the one used longest ago in front
    "rl4_sessions": with_views("raft_log", body=""", f AS (SELECT list_reduce(list_prepend({'s': CAST([] AS STRUCT(client VARCHAR, seq BIGINT, idx BIGINT, used BIGINT, cmd VARCHAR)[]), 'l': CAST(NULL AS STRUCT(client VARCHAR, seq BIGINT, idx BIGINT, used BIGINT, cmd VARCHAR))},
        list({'s': CAST([] AS STRUCT(client VARCHAR, seq BIGINT, idx BIGINT, used BIGINT, cmd VARCHAR)[]), 'l': {'client': client, 'seq': seq, 'idx': idx, 'used': idx, 'cmd': op || ' ' || key || ' ' || coalesce(value, '')}} ORDER BY idx)),
        lambda a, x: {'s': CASE
          WHEN len(list_filter(a.s, lambda h: h.client = x.l.client AND (h.seq > x.l.seq OR (h.seq = x.l.seq AND h.cmd <> x.l.cmd)))) > 0 THEN a.s
          WHEN len(list_filter(a.s, lambda h: h.client = x.l.client AND h.seq = x.l.seq)) > 0 THEN list_append(list_filter(a.s, lambda h: h.client <> x.l.client),
            {'client': x.l.client, 'seq': x.l.seq, 'idx': list_filter(a.s, lambda h: h.client = x.l.client)[1].idx, 'used': x.l.idx, 'cmd': x.l.cmd})
          ELSE list_append(list_filter(a.s, lambda h: h.client <> x.l.client), x.l)[-20:] END, 'l': x.l}).s AS s FROM raft_log)
      SELECT h.client AS client, h.seq AS last_seq, h.idx AS applied_idx, h.used AS last_used FROM (SELECT unnest(s) AS h FROM f)"""),
    "rl5_replay": _WAL + """, base AS (SELECT *, coalesce(max(CASE WHEN kind = 'SNAPSHOT' THEN idx END) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM wal),
      live AS (SELECT *, min(CASE WHEN kind IN ('ENTRY', 'TRUNCATE') THEN idx END) OVER w AS cut, max(CASE WHEN kind = 'SNAPSHOT' THEN idx END) OVER w AS covered FROM base WHERE kind <> 'ENTRY' OR idx > base
        WINDOW w AS (ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
      SELECT idx, term, 'c' || o AS command FROM live WHERE kind = 'ENTRY' AND (cut IS NULL OR cut > idx) AND (covered IS NULL OR covered < idx)""",
    "rl5_state": _WAL + """ SELECT (SELECT coalesce(max(term), 0) FROM wal WHERE kind = 'TERM') AS term, (SELECT 'n' || (max(term) % 5) FROM wal WHERE kind IN ('TERM', 'VOTE')) AS voted_for,
      coalesce(max(idx), 0) AS base_idx, coalesce(max(term), 0) AS base_term FROM wal WHERE kind = 'SNAPSHOT'""",
    "rl5_checked": _WAL + _REPLAYED.format(wal="wal", by="") + " SELECT idx, term, command FROM r",
    "rl5_gaps": _WAL + _REPLAYED.format(wal="(SELECT * FROM wal WHERE NOT (kind = 'ENTRY' AND o % 50 = 7))", by="") + """,
      g AS (SELECT idx, coalesce(lag(idx) OVER (ORDER BY idx), (SELECT idx FROM wal WHERE kind = 'SNAPSHOT' ORDER BY o DESC LIMIT 1), 0) AS prev FROM r) SELECT * FROM g WHERE idx <> prev + 1""",
    "rl5_nodes": _WAL + _REPLAYED.format(wal="(SELECT *, 'n' || i AS node FROM wal, range(3) x(i) WHERE o % 7 <> i)", by="PARTITION BY node") + " SELECT node, idx, term, command FROM r",
    "rl6_merge": _SPLIT + """, c AS (SELECT min(s.idx) AS m FROM s LEFT JOIN l ON s.idx = l.idx WHERE s.term IS DISTINCT FROM l.term)
      SELECT l.* FROM l, c WHERE m IS NULL OR idx < m UNION ALL SELECT s.* FROM s, c WHERE idx >= m""",
    "rl7_check": _SPLIT + """, r AS (SELECT idx AS req, idx - 1 AS prev_idx, term AS prev_term FROM s), j AS (SELECT r.*, prev_idx = 0 OR coalesce(l.term = prev_term, false) AS matches FROM r LEFT JOIN l ON l.idx = prev_idx)
      SELECT *, CASE WHEN NOT matches THEN least(prev_idx, (SELECT max(idx) FROM l) + 1) END AS conflict_idx FROM j""",
    "rl8_commit": """WITH m AS (SELECT event_id % 5 AS node, max(event_id) - (event_id % 5) * 37 AS match_idx FROM events GROUP BY event_id % 5), h AS (SELECT list_reverse_sort(list(match_idx))[3] AS x FROM m)
      SELECT coalesce(max(event_id + 1), 0) AS commit_idx FROM events, h WHERE event_id // 1000 = (SELECT max(event_id) // 1000 FROM events) AND event_id + 1 <= x""",
    "rl9_votes": """WITH v AS (SELECT 'v' || (event_id % 5) AS voter, 'c' || (event_id % 3) AS candidate, event_id // 50 AS term, event_id // 70 AS lt, event_id % 40 AS li, event_id // 50 - event_id % 2 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS mt,
        CASE WHEN event_id % 4 = 0 THEN 'c' || (event_id % 2) END AS vf, event_id // 71 AS mlt, event_id % 37 AS mli FROM events),
      g AS (SELECT *, term >= mt AND (term > mt OR vf IS NULL OR vf = candidate) AND (lt > mlt OR (lt = mlt AND li >= mli)) AS granted FROM v)
      SELECT candidate, term, count(DISTINCT voter) FILTER (granted) AS votes, count(DISTINCT voter) FILTER (granted) > 2 AS elected FROM g GROUP BY candidate, term""",
    "rl10_compaction": "SELECT event_id % 6 AS node, CASE WHEN (event_id % 6) * 100 >= 250 THEN max(event_id) END AS snapshot_at FROM events GROUP BY event_id % 6",
    "rl11_replication": """SELECT 'f' || f AS follower, CASE WHEN f * 100 + 1 <= 350 THEN 'SNAPSHOT' ELSE 'ENTRIES' END AS action, CASE WHEN f * 100 + 1 <= 350 THEN 350 ELSE f * 100 + 1 END AS from_idx,
      CASE WHEN f * 100 + 1 <= 350 THEN 0 ELSE greatest(0, (SELECT max(event_id) + 1 FROM events) - (f * 100 + 1) + 1) END AS entries FROM range(9) t(f)""",
    "rl12_install": "SELECT event_id AS node, event_id % 50 AS snapshot_idx, event_id % 30 AS base_idx, event_id % 41 AS commit_idx, event_id % 50 > event_id % 30 AND event_id % 50 > event_id % 41 AS installed FROM events",
    "rl13_readiness": """WITH hb AS (SELECT 'n' || (event_id % 5) AS node, 'n' || (event_id // 5 % 4) AS peer, event_id // 10 AS tick FROM events), now AS (SELECT max(tick) AS t FROM hb),
      fresh AS (SELECT DISTINCT node, peer FROM hb, now WHERE tick >= t - 3 AND NOT (node = 'n3' AND peer = 'n0'))
      SELECT 'n' || i AS node, CASE WHEN i = 0 THEN (1 + (SELECT count(*) FROM fresh WHERE node = 'n0' AND peer <> 'n0')) * 2 > 5 ELSE EXISTS (SELECT 1 FROM fresh f WHERE f.node = 'n' || i AND peer = 'n0') END AS ready FROM range(5) t(i)""",
    "rl14_barriers": with_views("raft_log", body=_APPLY.replace("FROM raft_log)", "FROM raft_log WHERE idx % 13 <> 0)") + " SELECT outcome, count(*) AS n FROM ap GROUP BY outcome"),
    "rl15_outcomes": with_views("raft_log", body=_APPLY + """, l AS (SELECT client, max(struct_pack(s := seq, o := op, k := key, v := value)) AS m FROM ap WHERE outcome = 'APPLIED' GROUP BY client)
      SELECT DISTINCT client, seq, op, key, value, CASE WHEN m IS NULL OR seq > m.s THEN 'NOT_APPLIED' WHEN seq < m.s THEN 'STALE' WHEN m.o = op AND m.k = key AND m.v IS NOT DISTINCT FROM value THEN 'APPLIED' ELSE 'CONFLICT' END AS status
      FROM raft_log LEFT JOIN l USING (client)"""),
    "sc13_read_as_of": with_views("raft_log", body=_LWW.format(t="(SELECT * FROM raft_log WHERE idx <= (SELECT max(idx) // 2 FROM raft_log))")),
    "sk7_snapshot": with_views("raft_log", body="SELECT *, (SELECT max(idx) FROM raft_log) AS last_included_index FROM (" + _LWW.format(t="raft_log") + ")"),
    "oc1_set": "SELECT 'u' || user_id AS key, event_id AS idx, 'v' || event_id AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events WHERE user_id % 3 = 0 OR event_id % 4 = 0",
    "oc2_oc3_requests": _OCC.format(where="") + " SELECT key, idx, op, success, version FROM o",
    "oc4_current": _OCC.format(where="") + " SELECT key, m.version AS version, m.value AS value FROM l WHERE m.version > 0",
    "oc4_cleared": _OCC.format(where="WHERE event_id > (SELECT max(event_id) // 2 FROM events)") + " SELECT key, m.version AS version FROM l WHERE m.version > 0",
    "oc4_size": _OCC.format(where="") + " SELECT count(*) AS size FROM l WHERE m.version > 0",
    "fp1_drops": _drops_sql(0.25, 7),
    "wg1_mixes": """WITH m AS (SELECT * FROM (VALUES ('A', [0.5, 0.5, 0.0, 0.0, 0.0]), ('B', [0.95, 0.05, 0.0, 0.0, 0.0]), ('C', [1.0, 0.0, 0.0, 0.0, 0.0]), ('D', [0.95, 0.0, 0.05, 0.0, 0.0]), ('E', [0.0, 0.0, 0.05, 0.95, 0.0]), ('F', [0.5, 0.0, 0.0, 0.0, 0.5])) t(workload, s))
      SELECT workload, ['READ', 'UPDATE', 'INSERT', 'SCAN', 'READ_MODIFY_WRITE'][i] AS kind, s[i]::DOUBLE AS share, list_sum(s[1:i])::DOUBLE AS upper FROM m, range(1, 6) r(i)""",
    "sk8_quantiles": _OPS + ", q AS (SELECT node, " + ", ".join(f"{_RANK.format(v='latency_ms', p=p)} AS p{n}" for p, n in ((0.5, 50), (0.95, 95), (0.99, 99))) + """ FROM ops GROUP BY node)
      SELECT node, unnest([0, 1, 2]) AS line_no, 'keyloom_operation_latency_ms{node="' || node || '",quantile="' || unnest(['0.5', '0.95', '0.99']) || '"} ' || unnest([p50, p95, p99]) AS line FROM q""",
    "sk8_members": """WITH s AS (SELECT 'n' || (event_id % 5) AS node, event_id % 3 AS r, CASE WHEN event_id % 4 > 0 THEN 'n' || chr(92) || chr(34) || (event_id % 4) ELSE '' END AS leader FROM events),
      x AS (SELECT node, unnest([0, 1, 2, 3]) AS line_no, unnest(['role="leader"} ' || CAST(r = 0 AS INTEGER), 'role="candidate"} ' || CAST(r = 1 AS INTEGER), 'role="follower"} ' || CAST(r = 2 AS INTEGER), 'leader="' || leader || '"} ' || CAST(leader <> '' AS INTEGER)]) AS t FROM s)
      SELECT node, line_no, 'keyloom_raft_' || CASE WHEN line_no < 3 THEN 'role' ELSE 'leader' END || '{node="' || node || '",' || t AS line, count(*) AS n FROM x GROUP BY ALL""",
    "sk9_report": _OPS + """, m AS (SELECT node, sum(replicas) * 4096 AS b, count(*) * 4096 AS u, sum(replicas) * 2048 AS live FROM ops GROUP BY node)
      SELECT CAST(substr(node, 2) AS BIGINT) AS line_no, '| ' || node || ' | ' || printf('%.2f', b / u) || '× | 1.50 | 0.00× | 3 | ' || printf('%.2f', live / 1048576.0) || ' |' AS line FROM m
      UNION ALL SELECT -2, '| Strategy | Write Amp | Read Amp | Space Amp | Live Tables | On-disk MB |' UNION ALL SELECT -1, '|---|---|---|---|---|---|'""",
    "mx1_operations": _OPS + _METRICS + " SELECT * FROM m",
    "mx2_latency": _OPS + " SELECT node, " + ", ".join(f"{_RANK.format(v='latency_ms', p=p)} AS p{n}" for p, n in ((0.5, 50), (0.95, 95), (0.99, 99))) + " FROM ops GROUP BY node",
    "mx3_report": _OPS + f" SELECT type, count(*) AS n, min(latency_ms) AS min, {_RANK.format(v='latency_ms', p=0.5)} AS median, {_RANK.format(v='latency_ms', p=0.95)} AS p95, max(latency_ms) AS max FROM ops GROUP BY type",
    "mx4_repairs": _OPS + " SELECT node, count(*) AS repairs, sum(replicas) AS replicas_repaired, sum(greatest(latency_ms, 0)) AS latency_total_ms, sum(greatest(latency_ms, 0)) // count(*) AS average_ms FROM ops GROUP BY node",
    "mx5_hedges": _OPS + " SELECT node, sum(greatest(latency_ms, 0)) AS hedged_requests FROM ops GROUP BY node",
    "sk8_exposition": _OPS + _METRICS + """, l AS (SELECT node || chr(34) || chr(92) || chr(10) AS node, replace(replace(replace(node || chr(34) || chr(92) || chr(10), chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n') AS esc, * EXCLUDE (node) FROM m),
      x AS (SELECT node, esc, unnest([0, 1, 2, 3]) AS i, unnest(['operations_total', 'reads_total', 'writes_total', 'latency_total_ms']) AS name, unnest(['Operations.', 'Reads.', 'Writes.', 'Latency.']) AS help,
             unnest([operations, reads, writes, latency_total_ms]) AS v FROM l)
      SELECT node, i * 3 AS line_no, '# HELP keyloom_' || name || ' ' || help AS line FROM x
      UNION ALL SELECT node, i * 3 + 1, '# TYPE keyloom_' || name || CASE WHEN i < 3 THEN ' counter' ELSE ' gauge' END FROM x
      UNION ALL SELECT node, i * 3 + 2, 'keyloom_' || name || '{node="' || esc || '"} ' || v FROM x""",
    "sc15_parse": _OPS + _METRICS + " SELECT 'keyloom_' || unnest(['operations_total', 'reads_total', 'writes_total', 'latency_total_ms']) AS metric, node, CAST(unnest([operations, reads, writes, latency_total_ms]) AS DOUBLE) AS value FROM m",
    "wg1_pick": "SELECT CASE WHEN (event_id % 1000) / 1000.0 < 0.95 THEN 'READ' ELSE 'UPDATE' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "wg2_wg5_load": "SELECT i AS idx, 'INSERT' AS kind, 'user' || lpad(i::VARCHAR, 10, '0') AS key, substr(repeat('abcdefghijklmnopqrstuvwxyz', 4), CAST(i % 26 AS INTEGER) + 1, 64) AS value, 0 AS scan_length FROM range(1000) t(i)",
    "wg4_zeta": "SELECT 1000 AS n, round(sum(power(i, -0.99)), 6) AS zeta FROM range(1, 1001) t(i)",
    "fp2_delivery": _MSG + " SELECT target, target <> 'n1' AS available, CASE target WHEN 'n2' THEN 40 WHEN 'n3' THEN 7 ELSE 0 END AS latency_ms, count(*) AS n FROM msg GROUP BY target",
    "fp3_reachable": _MSG + """ SELECT source, target, source = target OR source = 'n4' OR target = 'n4' OR (source IN ('n0', 'n1')) = (target IN ('n0', 'n1')) AS reachable, count(*) AS n FROM msg GROUP BY source, target""",
    "ex1_outages": """WITH p AS (SELECT event_id // 500 AS cycle, event_id * 10 AS at_ms, event_id % 500 < 100 OR event_id % 500 > 180 + event_id // 500 AS ok, event_id % 500 > 250 AS all_applied FROM events),
      k AS (SELECT cycle, min(at_ms) + 1000 AS kill_ms FROM p GROUP BY cycle)
      SELECT cycle, min(at_ms) FILTER (ok) - min(kill_ms) AS outage_ms, min(at_ms) FILTER (all_applied) - min(kill_ms) AS catchup_ms FROM p JOIN k USING (cycle) WHERE at_ms > kill_ms GROUP BY cycle""",
}
