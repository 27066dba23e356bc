"""Queries over replicas: vector clocks, siblings, quorums, repair, consistency of histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import clocks
from keyloom.operators import history, quorum, siblings
from keyloom.plans import derive
from keyloom.plans.derive import with_views
from keyloom.session import table


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return derive.replica_values(spark, sf)


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("key", "value", clocks.canonical(F.col("clock")).alias("clock"), *more)


def vc1_increment(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select("row_id", clocks.canonical(clocks.increment(F.col("clock"), "b")).alias("clock"))


def vc1_initial(spark: SparkSession, sf: str) -> DataFrame:
    """A first write's clock at each row's node, and the clock of a version from before clocks (null below 0)."""
    return _rows(spark, sf).select("row_id", clocks.canonical(clocks.initial(F.col("node"))).alias("initial"), clocks.canonical(clocks.legacy(F.col("version") - 2)).alias("legacy"))


def vc2_merge(spark: SparkSession, sf: str) -> DataFrame:
    m = siblings.merged_clock(_rows(spark, sf))
    return m.select("key", clocks.canonical(F.col("clock")).alias("clock"))


def vc3_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each version against the fixed clock a=1,b=1."""
    r = _rows(spark, sf).withColumn("other", F.expr("map('a', 1L, 'b', 1L)"))
    return r.select("row_id", clocks.happens_before("clock", "other").alias("before"), clocks.happens_before("other", "clock").alias("after"), clocks.concurrent("clock", "other").alias("concurrent"))


def vc4_siblings(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(siblings.merge_siblings(_rows(spark, sf).select("key", "value", "version", "clock", "tombstone")), "tombstone")


def vc5_front(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(siblings.causal_front(_rows(spark, sf).select("key", "value", "version", "clock", "tombstone")))


def vc6_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(siblings.conflicting(_rows(spark, sf).select("key", "value", "version", "clock", "tombstone")))


def vc7_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return siblings.resolve(_rows(spark, sf).select("key", "value", "version", "clock", "tombstone"), "PRESERVE").drop("dead")


def vc8_winner(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(siblings.deterministic_winner(_rows(spark, sf)), "version")


def vc9_version(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select("row_id", clocks.version_of(F.col("clock")).alias("version"))


def vc10_next_clock(spark: SparkSession, sf: str) -> DataFrame:
    return siblings.next_clock(_rows(spark, sf), "b").select("key", clocks.canonical(F.col("clock")).alias("clock"))


def vc10_issued(spark: SparkSession, sf: str) -> DataFrame:
    """The same where the coordinator issued a clock for some keys that no replica has yet."""
    r = _rows(spark, sf)
    issued = r.where("length(key) % 2 = 0").select("key", F.expr("map('b', 7L)").alias("clock"))
    return siblings.next_clock(r, "b", issued).select("key", clocks.canonical(F.col("clock")).alias("clock"))


def vc11_live(spark: SparkSession, sf: str) -> DataFrame:
    return siblings.live(_rows(spark, sf)).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def vc13_scalar(spark: SparkSession, sf: str) -> DataFrame:
    """Keys with a single sibling, read as plain values."""
    sets = siblings.as_sets(siblings.merge_siblings(_rows(spark, sf).select("key", "value", "version", "clock", "tombstone")))
    return siblings.scalar(sets.where("size(siblings) = 1")).select("key", "value", F.col("c").alias("clock"))


def sc10_client_scan(spark: SparkSession, sf: str) -> DataFrame:
    front = siblings.merge_siblings(_rows(spark, sf).select("key", "value", "version", "clock", "tombstone"))
    return siblings.client_scan(front, "cust2", None, 40)


def sc11_client_get(spark: SparkSession, sf: str) -> DataFrame:
    return siblings.client_get(siblings.merge_siblings(_rows(spark, sf).select("key", "value", "version", "clock", "tombstone")))


def sc12_replica_get(spark: SparkSession, sf: str) -> DataFrame:
    """A key's full sibling set, tombstones included."""
    return _shown(siblings.merge_siblings(_rows(spark, sf).where("key = 'cust7'").select("key", "value", "version", "clock", "tombstone")), "tombstone")


def sk5_merge_put(spark: SparkSession, sf: str) -> DataFrame:
    """Sibling sets after a second batch of values is merged into those of the first."""
    r = _rows(spark, sf)
    cols = ["key", "value", "version", "clock", "tombstone"]
    state = siblings.merge_siblings(r.where("row_id % 2 = 0").select(cols))
    return _shown(siblings.merge_siblings(state.select(cols).unionByName(r.where("row_id % 2 = 1").select(cols))), "tombstone")


def qr1_configs(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.range(1, 6).select(F.col("id").cast("int").alias("n")).withColumn("w", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("r", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return quorum.config_predicates(c.select("n", "w", "r", (F.col("w") - 1).alias("pw"), F.col("r").alias("pr")))


def qr1_presets(spark: SparkSession, sf: str) -> DataFrame:
    return quorum.config_predicates(quorum.presets(spark))


def qr2_write_quorum(spark: SparkSession, sf: str) -> DataFrame:
    return quorum.write_quorum(derive.replica_acks(spark, sf), 4, 3)


def qr3_read_quorum(spark: SparkSession, sf: str) -> DataFrame:
    return quorum.read_quorum(derive.replica_acks(spark, sf), 4, 2)


def qr4_proposed(spark: SparkSession, sf: str) -> DataFrame:
    return quorum.proposed_latest(derive.replica_acks(spark, sf))


def qr5_qr6_inconsistency(spark: SparkSession, sf: str) -> DataFrame:
    return quorum.inconsistency(derive.replica_acks(spark, sf))


def qr7_client_result(spark: SparkSession, sf: str) -> DataFrame:
    return quorum.client_result(_rows(spark, sf).select("key", "value", "version", "clock", "tombstone"), "PRESERVE").select("key", "status", "value", "n_siblings")


def qr8_delete(spark: SparkSession, sf: str) -> DataFrame:
    r = _rows(spark, sf)
    return quorum.delete_as_write(r, r.select("key").distinct(), "a").where("existed is not null").select("key", clocks.canonical(F.col("clock")).alias("clock"), "version", "existed")


def qr9_hints(spark: SparkSession, sf: str) -> DataFrame:
    return quorum.missing_hints(derive.replica_acks(spark, sf))


def qr10_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Hints from half of the rows, delivered to the nodes in reach: siblings per node afterwards."""
    r = _rows(spark, sf)
    cols = ["key", "value", "version", "clock", "tombstone"]
    hints = r.where("row_id % 3 = 0").select(F.concat(F.lit("n"), (F.col("row_id") + 1) % 5).alias("target"), *cols)
    up = spark.createDataFrame([("n0",), ("n1",), ("n2",)], "node string")
    merged, _ = quorum.replay_hints(r.where("row_id % 3 <> 0").select("node", *cols), hints, up)
    return merged.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("key").alias("keys"))


def qr10_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = _rows(spark, sf)
    cols = ["key", "value", "version", "clock", "tombstone"]
    up = spark.createDataFrame([("n0",), ("n1",), ("n2",)], "node string")
    return quorum.replay_hints(r.select("node", *cols), r.select(F.concat(F.lit("n"), (F.col("row_id") + 1) % 5).alias("target"), *cols), up)[1]


def qr11_repair(spark: SparkSession, sf: str) -> DataFrame:
    r = _rows(spark, sf)
    preferred = r.select("key").distinct().withColumn("node", F.explode(F.array(*[F.lit(f"n{i}") for i in range(3)])))
    return quorum.repair_plan(r.select("key", "node", "value", "version", "clock", "tombstone"), preferred).select("key", "node", "value")


def qr12_causes(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["UNAVAILABLE", "DEADLINE_EXCEEDED", "CANCELLED", "ILLEGAL_STATE", "INTERNAL"]
    e = table(spark, sf, "events").select("event_id", F.element_at(F.array(*[F.lit(k) for k in kinds], F.lit(None)), (F.col("event_id") % 6 + 1).cast("int")).alias("kind"))
    return e.groupBy(quorum.failure_cause(F.col("kind")).alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def qr13_hedge(spark: SparkSession, sf: str) -> DataFrame:
    return quorum.hedge_decision(derive.replica_acks(spark, sf), 2, 40)


def qr14_completion(spark: SparkSession, sf: str) -> DataFrame:
    return quorum.completion(derive.replica_acks(spark, sf), 3, 60)


def qr14_primaries(spark: SparkSession, sf: str) -> DataFrame:
    """The same with two of the acks from primaries."""
    return quorum.completion(derive.replica_acks(spark, sf), 3, 60, pw=2)


def qr14_after_read(spark: SparkSession, sf: str) -> DataFrame:
    """The same after a read of two replicas."""
    acks = derive.replica_acks(spark, sf)
    reads = acks.select("req", ((F.col("req") + F.col("node")) % 7 != 0).alias("ok"), ((F.col("req") * 13 + F.col("node") * 7) % 53).alias("latency_ms"))
    return quorum.completion(acks, 3, 90, reads=reads, r=2)


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return derive.op_history(spark, sf)


def ck1_stale_reads(spark: SparkSession, sf: str) -> DataFrame:
    return history.stale_reads(_history(spark, sf))


def ck2_read_your_writes(spark: SparkSession, sf: str) -> DataFrame:
    return history.read_your_writes(_history(spark, sf))


def ck3_monotonic(spark: SparkSession, sf: str) -> DataFrame:
    return history.monotonic_reads(_history(spark, sf))


def ck4_relevant(spark: SparkSession, sf: str) -> DataFrame:
    """What the session checks look at: successful operations by type."""
    return _history(spark, sf).where("result = 'SUCCESS'").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def ck5_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return history.violations_by_type(_history(spark, sf))


def ck6_linearizability(spark: SparkSession, sf: str) -> DataFrame:
    return history.linearizability(_history(spark, sf)).select("key", "first_idx", "n_ops", "verdict")


def ck7_inconclusive(spark: SparkSession, sf: str) -> DataFrame:
    """Keys with more operations than are searched."""
    return history.linearizability(_history(spark, sf)).where("verdict = 'INCONCLUSIVE'").select("key", "n_ops")


def ck8_witness(spark: SparkSession, sf: str) -> DataFrame:
    v = history.first_violation(history.linearizability(_history(spark, sf)))
    return v.select("key", F.concat_ws(",", F.transform("prefix", lambda x: x.cast("string"))).alias("prefix"), F.concat_ws(",", F.transform("stuck", lambda x: x.cast("string"))).alias("stuck"))


def ck9_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["NOT_LEADER", "INVALID_ARGUMENT", "UNAVAILABLE", "UNKNOWN_OUTCOME"]
    e = table(spark, sf, "events").select(F.element_at(F.array(*[F.lit(k) for k in kinds], F.lit(None)), (F.col("event_id") % 5 + 1).cast("int")).alias("kind"))
    return e.groupBy(history.outcome(F.col("kind")).alias("result")).agg(F.count(F.lit(1)).alias("n"))


def ck10_summary(spark: SparkSession, sf: str) -> DataFrame:
    return history.history_summary(_history(spark, sf))


def ck11_failing_prefix(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf)
    return history.failing_prefix(h, history.stale_reads(h))


def ck12_audit(spark: SparkSession, sf: str) -> DataFrame:
    w = _history(spark, sf).where("type = 'WRITE'")
    state = w.where("idx % 7 <> 0").groupBy("key").agg(F.max_by("value", "idx").alias("value"))
    last = w.groupBy("key").agg(F.max_by(F.struct("value", "result"), "idx").alias("l")).select("key", "l.value", "l.result")
    return history.audit_acknowledged(last, state, _history(spark, sf).where("type = 'READ'").select("key"))


def ck13_tally(spark: SparkSession, sf: str) -> DataFrame:
    return history.verdict_tally(history.linearizability(_history(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (vc1_increment, vc1_initial, vc2_merge, vc3_order, vc4_siblings, vc5_front, vc6_conflicts, vc7_resolve, vc8_winner, vc9_version, vc10_next_clock, vc10_issued, vc11_live, vc13_scalar, sc10_client_scan, sc11_client_get, sc12_replica_get, sk5_merge_put,
              qr1_configs, qr1_presets, qr2_write_quorum, qr3_read_quorum, qr4_proposed, qr5_qr6_inconsistency, qr7_client_result, qr8_delete, qr9_hints, qr10_replay, qr10_counts, qr11_repair, qr12_causes, qr13_hedge, qr14_completion, qr14_primaries, qr14_after_read,
              ck1_stale_reads, ck2_read_your_writes, ck3_monotonic, ck4_relevant, ck5_by_type, ck6_linearizability, ck7_inconclusive, ck8_witness, ck9_outcomes, ck10_summary, ck11_failing_prefix, ck12_audit, ck13_tally)
}

_BEFORE = "(a.ca <= b.ca AND a.cb <= b.cb AND a.cc <= b.cc AND (a.ca < b.ca OR a.cb < b.cb OR a.cc < b.cc))"


def _front(by: str, source: str = "replica_values", key: str = "key") -> str:
    return f"""(SELECT DISTINCT {key}, value, clock, ca, cb, cc, {by} FROM {source} a
      WHERE NOT EXISTS (SELECT 1 FROM {source} b WHERE {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in key.split(','))} AND {_BEFORE}))"""


_KEPT = _front("tombstone")
_FREE = _front("version")
_MERGED = """m AS (SELECT key, max(ca) AS ca, max(cb) AS cb, max(cc) AS cc FROM replica_values GROUP BY key)"""
_TEXT = "concat_ws(',', CASE WHEN {a} > 0 THEN 'a=' || {a} END, CASE WHEN {b} > 0 THEN 'b=' || {b} END, CASE WHEN {c} > 0 THEN 'c=' || {c} END)"
_RESOLVED = f"""front AS (SELECT key, value, clock, max(version) AS version, count(*) AS n FROM {_FREE} GROUP BY key, value, clock),
  g AS (SELECT key, count(*) AS survivors, count(DISTINCT clock) AS clocks, max(struct_pack(c := clock, v := value, n := version)) AS w, max(struct_pack(n := version, v := value)) AS l FROM front GROUP BY key)"""
_ASOF = """, r AS (SELECT * FROM op_history WHERE type = 'READ' AND result = 'SUCCESS'), w AS (SELECT * FROM op_history WHERE type = 'WRITE' AND result = 'SUCCESS'),
  j AS (SELECT r.key, r.idx, r.value AS observed, w.value AS expected, row_number() OVER (PARTITION BY r.idx ORDER BY w.end_ms DESC, w.idx) AS rn FROM r JOIN w ON r.key = w.key AND w.end_ms <= r.start_ms {extra})
  SELECT '{kind}' AS type, key, idx, expected, observed FROM j WHERE rn = 1 AND expected IS DISTINCT FROM observed"""
_STALE = _ASOF.format(extra="", kind="STALE_READ")
_RYW = _ASOF.format(extra="AND w.idx < r.idx", kind="READ_YOUR_WRITES")
_MONO = """, f AS (SELECT key, value, min(idx) AS rank FROM op_history WHERE type = 'WRITE' AND result = 'SUCCESS' GROUP BY key, value),
  q AS (SELECT h.key, h.idx, h.value, f.rank FROM op_history h JOIN f ON h.key = f.key AND h.value = f.value WHERE h.type = 'READ' AND h.result = 'SUCCESS'),
  x AS (SELECT *, max(struct_pack(r := rank, v := value)) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM q)
  SELECT 'MONOTONIC_READ' AS type, key, idx, best.v AS expected, value AS observed FROM x WHERE rank < best.r"""
_DEAD = f"""SELECT key, max(struct_pack(c := clock, v := value, n := m.n, t := m.t)).t AS dead
  FROM (SELECT key, clock, value, min(struct_pack(n := version, t := tombstone)) AS m FROM {_front('version, tombstone')} GROUP BY key, clock, value) GROUP BY key"""

ORACLES = {
    "vc1_increment": with_views("replica_values", body="SELECT row_id, " + _TEXT.format(a="ca", b="(cb + 1)", c="cc") + " AS clock FROM replica_values"),
    "vc1_initial": with_views("replica_values", body="SELECT row_id, node || '=1' AS initial, CASE WHEN version >= 2 THEN 'legacy=' || (version - 2) END AS legacy FROM replica_values"),
    "vc10_issued": with_views("replica_values", body="," + _MERGED + " SELECT key, " + _TEXT.format(a="ca", b="(CASE WHEN length(key) % 2 = 0 THEN greatest(cb, 7) ELSE cb END + 1)", c="cc") + " AS clock FROM m"),
    "sc11_client_get": with_views("replica_values", body=f"SELECT key, n > 0 AS found, n AS n_siblings, CASE WHEN n = 1 THEN v END AS value FROM (SELECT key, count(*) FILTER (NOT tombstone) AS n, max(value) FILTER (NOT tombstone) AS v FROM {_KEPT} GROUP BY key)"),
    "qr1_presets": """SELECT name, n, w, r, 0 AS pw, 0 AS pr, true AS valid, w + r > n AS overlap, false AS read_your_writes, n - w AS write_tolerance, n - r AS read_tolerance, w <= n // 2 OR r <= n // 2 AS available_during_partition
      FROM (VALUES ('STRONG_CONSISTENCY', 5, 3, 3), ('EVENTUAL_CONSISTENCY', 5, 1, 1), ('WRITE_HEAVY', 5, 1, 5), ('READ_HEAVY', 5, 5, 1)) t(name, n, w, r)""",
    "qr14_primaries": with_views("replica_acks", body="""SELECT req, CASE WHEN d <= 60 THEN d END AS completed_ms, coalesce(d <= 60, false) AS met FROM (
      SELECT req, CASE WHEN a IS NOT NULL AND p IS NOT NULL THEN greatest(a, p) END AS d FROM (SELECT req, list_sort(list(latency_ms) FILTER (ok))[3] AS a, list_sort(list(latency_ms) FILTER (ok AND is_primary))[2] AS p FROM replica_acks GROUP BY req))"""),
    "qr14_after_read": with_views("replica_acks", body="""SELECT req, CASE WHEN d <= 90 THEN d END AS completed_ms, coalesce(d <= 90, false) AS met FROM (
      SELECT req, list_sort(list(latency_ms) FILTER (ok))[3] + list_sort(list((req * 13 + node * 7) % 53) FILTER ((req + node) % 7 <> 0))[2] AS d FROM replica_acks GROUP BY req)"""),
    "vc2_merge": with_views("replica_values", body="," + _MERGED + " SELECT key, " + _TEXT.format(a="ca", b="cb", c="cc") + " AS clock FROM m"),
    "vc3_order": with_views("replica_values", body="""SELECT row_id, before, after, NOT before AND NOT after AND NOT (ca = 1 AND cb = 1 AND cc = 0) AS concurrent FROM (
      SELECT row_id, ca, cb, cc, ca <= 1 AND cb <= 1 AND cc <= 0 AND (ca < 1 OR cb < 1) AS before, 1 <= ca AND 1 <= cb AND (1 < ca OR 1 < cb OR 0 < cc) AS after FROM replica_values)"""),
    "vc4_siblings": with_views("replica_values", body=f"SELECT key, value, clock, tombstone FROM {_KEPT}"),
    "vc5_front": with_views("replica_values", body=f"SELECT DISTINCT key, value, clock FROM {_KEPT}"),
    "vc6_conflicts": with_views("replica_values", body=f", f AS (SELECT DISTINCT key, value, clock FROM {_KEPT}) SELECT * FROM f WHERE key IN (SELECT key FROM f GROUP BY key HAVING count(DISTINCT clock) > 1)"),
    "vc7_resolve": with_views("replica_values", body=f", {_RESOLVED} SELECT key, survivors, survivors > 1 AND clocks > 1 AS conflict, CASE WHEN survivors = 1 THEN w.v WHEN clocks = 1 THEN l.v END AS value, CASE WHEN survivors = 1 THEN w.n WHEN clocks = 1 THEN l.n END AS version FROM g"),
    "vc8_winner": with_views("replica_values", body="SELECT key, m.v AS value, m.c AS clock, m.n AS version FROM (SELECT key, max(struct_pack(c := clock, v := value, n := version)) AS m FROM replica_values GROUP BY key)"),
    "vc9_version": with_views("replica_values", body="SELECT row_id, ca + cb + cc AS version FROM replica_values"),
    "vc10_next_clock": with_views("replica_values", body="," + _MERGED + " SELECT key, " + _TEXT.format(a="ca", b="(cb + 1)", c="cc") + " AS clock FROM m"),
    "vc11_live": with_views("replica_values", body="SELECT node, count(*) AS n FROM replica_values WHERE NOT tombstone GROUP BY node"),
    "vc13_scalar": with_views("replica_values", body=f", f AS {_KEPT} SELECT key, value, clock FROM f WHERE key IN (SELECT key FROM f GROUP BY key HAVING count(*) = 1)"),
    "sc10_client_scan": with_views("replica_values", body=f"SELECT key, m.v AS value, m.n AS version FROM (SELECT key, max(struct_pack(n := version, v := value)) AS m FROM {_front('version, tombstone')} WHERE NOT tombstone AND key >= 'cust2' GROUP BY key) ORDER BY key LIMIT 40"),
    "sc12_replica_get": with_views("replica_values", body=f"SELECT key, value, clock, tombstone FROM {_KEPT} WHERE key = 'cust7'"),
    "sk5_merge_put": with_views("replica_values", body=f"SELECT key, value, clock, tombstone FROM {_KEPT}"),
    "qr1_configs": """SELECT n, w, r, w - 1 AS pw, r AS pr, true AS valid, w + r > n AS overlap, w - 1 + r > n AS read_your_writes, n - w AS write_tolerance, n - r AS read_tolerance,
      w <= n // 2 OR r <= n // 2 AS available_during_partition FROM range(1, 6) a(n), range(1, 6) b(w), range(1, 6) c(r) WHERE w <= n AND r <= n""",
    "qr2_write_quorum": with_views("replica_acks", body="SELECT req, acks, primary_acks, acks >= 4 AND primary_acks >= 3 AS met FROM (SELECT req, count(*) FILTER (ok) AS acks, count(*) FILTER (ok AND is_primary) AS primary_acks FROM replica_acks GROUP BY req)"),
    "qr3_read_quorum": with_views("replica_acks", body="SELECT *, responders >= 4 AND primary_responders >= 2 AS met FROM (SELECT req, count(*) FILTER (ok) AS responders, count(*) FILTER (ok AND is_primary) AS primary_responders, count(*) FILTER (ok AND has_value) AS with_value FROM replica_acks GROUP BY req)"),
    "qr4_proposed": with_views("replica_acks", body="SELECT req, max(version) FILTER (ok AND has_value) AS version FROM replica_acks GROUP BY req"),
    "qr5_qr6_inconsistency": with_views("replica_acks", body="""SELECT req, kinds > 1 OR (nulls > 0 AND filled > 0) AS inconsistent, CASE WHEN latest IS NULL THEN 0 ELSE nulls + behind END AS stale_nodes FROM (
      SELECT req, count(DISTINCT version) FILTER (has_value) AS kinds, count(*) FILTER (NOT has_value) AS nulls, count(*) FILTER (has_value) AS filled, any_value(latest) AS latest, count(*) FILTER (has_value AND version < latest) AS behind
      FROM (SELECT *, max(version) FILTER (has_value) OVER (PARTITION BY req) AS latest FROM replica_acks WHERE ok) GROUP BY req)"""),
    "qr7_client_result": with_views("replica_values", body=f""", {_RESOLVED}, dd AS ({_DEAD}),
      r AS (SELECT *, survivors > 1 AND clocks > 1 AS conflict, CASE WHEN survivors = 1 THEN w.v ELSE l.v END AS v FROM g)
      SELECT key, CASE WHEN conflict THEN 'CONFLICT' WHEN dead THEN 'ABSENT' ELSE 'VALUE' END AS status, CASE WHEN NOT conflict AND NOT dead THEN v END AS value, CASE WHEN conflict THEN survivors ELSE 1 END AS n_siblings FROM r JOIN dd USING (key)"""),
    "qr8_delete": with_views("replica_values", body="""SELECT key, """ + _TEXT.format(a="(ca + 1)", b="cb", c="cc") + """ AS clock, ca + cb + cc + 1 AS version, existed FROM (
      SELECT key, max(ca) AS ca, max(cb) AS cb, max(cc) AS cc, bool_or(NOT tombstone) AS existed FROM replica_values GROUP BY key)"""),
    "qr9_hints": with_views("replica_acks", body="SELECT req, node FROM replica_acks WHERE is_primary AND NOT ok"),
    "qr10_replay": with_views("replica_values", body=f""", rows_ AS (SELECT node, key, value, version, clock, ca, cb, cc, tombstone FROM replica_values WHERE row_id % 3 <> 0
      UNION ALL SELECT 'n' || ((row_id + 1) % 5), key, value, version, clock, ca, cb, cc, tombstone FROM replica_values WHERE row_id % 3 = 0 AND (row_id + 1) % 5 IN (0, 1, 2))
      SELECT node, count(*) AS rows, count(DISTINCT key) AS keys FROM {_front('tombstone', 'rows_', 'node, key')} GROUP BY node"""),
    "qr10_counts": "SELECT count(*) AS hints, count(*) FILTER ((o_orderkey + 1) % 5 < 3) AS delivered, count(*) FILTER ((o_orderkey + 1) % 5 >= 3) AS kept FROM orders",
    "qr11_repair": with_views("replica_values", body=f""", f AS (SELECT DISTINCT key, value, clock FROM {_KEPT}), s AS (SELECT key, min(value) AS value, min(clock) AS clock FROM f GROUP BY key HAVING count(*) = 1),
      t AS (SELECT s.*, n.node FROM s, (SELECT 'n' || i AS node FROM range(3) x(i)) n),
      h AS (SELECT key, node, count(DISTINCT (value, clock)) AS c, min(value) AS v, min(clock) AS k FROM replica_values GROUP BY key, node)
      SELECT t.key, t.node, t.value FROM t LEFT JOIN h ON t.key = h.key AND t.node = h.node WHERE NOT coalesce(h.c = 1 AND h.v = t.value AND h.k = t.clock, false)"""),
    "qr12_causes": "SELECT CASE event_id % 6 WHEN 0 THEN 'UNAVAILABLE_NODE' WHEN 1 THEN 'DROPPED_MESSAGE' WHEN 2 THEN 'DROPPED_MESSAGE' WHEN 3 THEN 'UNAVAILABLE_NODE' WHEN 4 THEN 'UNKNOWN' ELSE 'UNAVAILABLE_NODE' END AS cause, count(*) AS n FROM events GROUP BY 1",
    "qr13_hedge": with_views("replica_acks", body="SELECT req, n < 2 AS hedged, CASE WHEN n < 2 THEN 3 END AS backup FROM (SELECT req, count(*) FILTER (ok AND is_primary AND latency_ms <= 40) AS n FROM replica_acks GROUP BY req)"),
    "qr14_completion": with_views("replica_acks", body="SELECT req, CASE WHEN d <= 60 THEN d END AS completed_ms, coalesce(d <= 60, false) AS met FROM (SELECT req, list_sort(list(latency_ms) FILTER (ok))[3] AS d FROM replica_acks GROUP BY req)"),
    "ck1_stale_reads": with_views("op_history", body=_STALE),
    "ck2_read_your_writes": with_views("op_history", body=_RYW),
    "ck3_monotonic": with_views("op_history", body=_MONO),
    "ck4_relevant": with_views("op_history", body="SELECT type, count(*) AS n FROM op_history WHERE result = 'SUCCESS' GROUP BY type"),
    "ck5_by_type": f"SELECT type, count(*) AS n FROM (SELECT type FROM ({with_views('op_history', body=_STALE)}) UNION ALL SELECT type FROM ({with_views('op_history', body=_RYW)}) UNION ALL SELECT type FROM ({with_views('op_history', body=_MONO)})) GROUP BY type",
    "ck7_inconclusive": with_views("op_history", body="SELECT key, count(*) AS n_ops FROM op_history WHERE result = 'SUCCESS' OR (result = 'UNKNOWN' AND type = 'WRITE') GROUP BY key HAVING count(*) > 64"),
    "ck9_outcomes": "SELECT CASE event_id % 5 WHEN 0 THEN 'FAILURE' WHEN 1 THEN 'FAILURE' WHEN 4 THEN 'SUCCESS' ELSE 'UNKNOWN' END AS result, count(*) AS n FROM events GROUP BY 1",
    "ck10_summary": with_views("op_history", body="""SELECT key, count(*) AS ops, count(*) FILTER (type = 'READ') AS reads, count(*) FILTER (type = 'WRITE') AS writes, count(*) FILTER (result = 'FAILURE') AS failures,
      count(*) FILTER (result = 'UNKNOWN') AS unknown, max(end_ms - start_ms) AS slowest_ms FROM op_history GROUP BY key"""),
    "ck11_failing_prefix": with_views("op_history", body=_STALE.replace("SELECT 'STALE_READ'", ", v AS (SELECT 'STALE_READ'") + """),
      u AS (SELECT key, min(idx) AS upto FROM v GROUP BY key)
      SELECT h.key, string_agg(type || ' ' || coalesce(value, 'null'), ' -> ' ORDER BY idx) AS prefix FROM op_history h JOIN u ON h.key = u.key AND h.idx <= u.upto GROUP BY h.key"""),
    "ck12_audit": with_views("op_history", body=""", l AS (SELECT key, max(struct_pack(i := idx, v := value, r := result)) AS m FROM op_history WHERE type = 'WRITE' GROUP BY key),
      s AS (SELECT key, max(struct_pack(i := idx, v := value)).v AS found FROM op_history WHERE type = 'WRITE' AND idx % 7 <> 0 GROUP BY key), c AS (SELECT DISTINCT key AS k FROM op_history WHERE type = 'READ'),
      j AS (SELECT m.v AS v, found, k FROM l LEFT JOIN s USING (key) LEFT JOIN c ON l.key = c.k WHERE m.r = 'SUCCESS')
      SELECT count(*) AS acknowledged, count(*) FILTER (k IS NOT NULL AND coalesce(found = v, false)) AS present, count(*) FILTER (k IS NOT NULL AND NOT coalesce(found = v, false)) AS missing, count(*) FILTER (k IS NULL) AS unchecked FROM j"""),
}
