"""Quorum reads, writes and repair as rules over replica answers.

Answers are rows (req, node, is_primary, latency_ms, ok, ...): one per replica asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import clocks
from keyloom.operators.siblings import causal_front, merge_siblings, next_clock, resolve


#: Named configurations as (n, w, r).
PRESETS = {
    "STRONG_CONSISTENCY": (5, 3, 3),
    "EVENTUAL_CONSISTENCY": (5, 1, 1),
    "WRITE_HEAVY": (5, 1, 5),
    "READ_HEAVY": (5, 5, 1),
}


def presets(spark: SparkSession) -> DataFrame:
    """The named configurations (name, n, w, r, pw, pr); none asks for primaries."""
    return spark.createDataFrame([(name, *nwr, 0, 0) for name, nwr in PRESETS.items()], "name string, n int, w int, r int, pw int, pr int")


def config_predicates(configs: DataFrame) -> DataFrame:
    """configs (n, w, r, pw, pr) with valid, overlap, read_your_writes, write_tolerance, read_tolerance and available_during_partition."""
    n, w, r, pw, pr = (F.col(c) for c in ("n", "w", "r", "pw", "pr"))
    inside = lambda x, lo: (x >= lo) & (x <= n)
    return configs.select(
        "*", ((n >= 1) & inside(w, 1) & inside(r, 1) & (pw >= 0) & (pw <= w) & (pr >= 0) & (pr <= r)).alias("valid"), (w + r > n).alias("overlap"),
        (pw + pr > n).alias("read_your_writes"), (n - w).alias("write_tolerance"), (n - r).alias("read_tolerance"),
        ((w <= F.expr("n div 2")) | (r <= F.expr("n div 2"))).alias("available_during_partition"),
    )


def _nodes(cond: Column) -> Column:
    return F.count_distinct(F.when(cond, F.col("node")))


def write_quorum(acks: DataFrame, w: int, pw: int = 0) -> DataFrame:
    """(req, acks, primary_acks, met): distinct nodes; a backup's ack counts to w, never to pw."""
    g = acks.groupBy("req").agg(_nodes(F.col("ok")).alias("acks"), _nodes(F.col("ok") & F.col("is_primary")).alias("primary_acks"))
    return g.withColumn("met", (F.col("acks") >= w) & (F.col("primary_acks") >= pw))


def read_quorum(answers: DataFrame, r: int, pr: int = 0) -> DataFrame:
    """(req, responders, primary_responders, with_value, met): a replica without a value has answered all the same."""
    g = answers.groupBy("req").agg(
        _nodes(F.col("ok")).alias("responders"), _nodes(F.col("ok") & F.col("is_primary")).alias("primary_responders"), _nodes(F.col("ok") & F.col("has_value")).alias("with_value")
    )
    return g.withColumn("met", (F.col("responders") >= r) & (F.col("primary_responders") >= pr))


def proposed_latest(answers: DataFrame) -> DataFrame:
    """(req, version): the greatest version among the values; null if there are none."""
    return answers.groupBy("req").agg(F.max(F.when(F.col("ok") & F.col("has_value"), F.col("version"))).alias("version"))


def inconsistency(answers: DataFrame, value: str = "version") -> DataFrame:
    """(req, inconsistent, stale_nodes): differing values, or values beside none; nodes without one or below the greatest version."""
    has = F.col("ok") & F.col("has_value")
    g = answers.where("ok").groupBy("req").agg(
        F.count_distinct(F.when(has, F.struct("version", value))).alias("kinds"), F.count_if(has).alias("filled"), F.count_if(~F.col("has_value")).alias("nulls"),
        F.max(F.when(has, F.col("version"))).alias("latest"), F.collect_list(F.when(has, F.col("version"))).alias("versions"),
    )
    behind = F.size(F.filter("versions", lambda v: v < F.col("latest")))
    return g.select(
        "req", ((F.col("kinds") > 1) | ((F.col("nulls") > 0) & (F.col("filled") > 0))).alias("inconsistent"),
        F.when(F.col("latest").isNull(), 0).otherwise(F.col("nulls") + behind).cast("bigint").alias("stale_nodes"),
    )


def client_result(rows: DataFrame, policy: str = "WINNER") -> DataFrame:
    """What a client gets per key: (key, status, value, n_siblings). Conflicts show all siblings, a deleted winner is absent."""
    both = resolve(rows, policy)
    conflict = F.col("conflict") & F.lit(policy == "PRESERVE")
    return both.select(
        "key", F.when(conflict, "CONFLICT").when(F.col("dead"), "ABSENT").otherwise("VALUE").alias("status"),
        F.when(~conflict & ~F.col("dead"), F.col("value")).alias("value"), F.when(conflict, F.col("survivors")).otherwise(1).cast("bigint").alias("n_siblings"),
    )


def delete_as_write(rows: DataFrame, keys: DataFrame, coordinator: str) -> DataFrame:
    """``rows`` and, for each key, a tombstone whose clock is past all of the key's: (…, existed on the tombstones).

    A key of which only empty clocks are known gets the delete as its first event.
    """
    asked = rows.join(keys.select("key"), "key", "left_semi")
    state = asked.groupBy("key").agg(F.max((~F.col("tombstone")).cast("int")).alias("was"))
    marks = state.join(next_clock(asked, coordinator), "key").select(
        "key", F.lit(coordinator).alias("node"), F.lit("").alias("value"), clocks.version_of(F.col("clock")).alias("version"), "clock", F.lit(True).alias("tombstone"), (F.col("was") == 1).alias("existed")
    )
    return rows.select("key", "node", "value", "version", "clock", "tombstone").withColumn("existed", F.lit(None).cast("boolean")).unionByName(marks)


def missing_hints(acks: DataFrame, hedged: DataFrame | None = None) -> DataFrame:
    """(req, node): primaries that haven't acked, targets of backup requests left out."""
    missing = acks.where(F.col("is_primary")).select("req", "node").distinct().join(acks.where("ok").select("req", "node"), ["req", "node"], "left_anti")
    return missing.join(hedged.select("req", "node"), ["req", "node"], "left_anti") if hedged is not None else missing


def replay_hints(replicas: DataFrame, hints: DataFrame, reachable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(replica rows after delivery, counts): each hint (target, key, value, version, clock, tombstone) whose target is
    reachable is merged in, an older clock changing nothing; the others are kept."""
    delivered = hints.join(reachable.select(F.col("node").alias("target")), "target", "left_semi")
    cols = ["key", "value", "version", "clock", "tombstone"]
    rows = replicas.select("node", *cols).unionByName(delivered.select(F.col("target").alias("node"), *cols))
    merged = merge_siblings(rows, ("node", "key"))
    counts = hints.join(reachable.select(F.col("node").alias("target"), F.lit(True).alias("up")), "target", "left").agg(
        F.count(F.lit(1)).alias("hints"), F.count_if(F.col("up")).alias("delivered"), F.count_if(F.col("up").isNull()).alias("kept")
    )
    return merged, counts


def repair_plan(rows: DataFrame, preferred: DataFrame) -> DataFrame:
    """(key, node, value, version): for keys with exactly one survivor over all replicas, the preferred nodes that don't hold just it."""
    front = causal_front(rows)
    single = front.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"), F.first("version").alias("version"), F.first(F.sort_array(F.map_entries("clock"))).alias("ck")).where("n = 1").drop("n")
    held = rows.select("key", "node", "value", F.sort_array(F.map_entries("clock")).alias("ck")).groupBy("key", "node").agg(F.collect_set(F.struct("value", "ck")).alias("held"))
    targets = preferred.select("key", "node").distinct().join(single, "key").join(held, ["key", "node"], "left")
    exactly = (F.size("held") == 1) & F.array_contains("held", F.struct("value", "ck"))
    return targets.where(~F.coalesce(exactly, F.lit(False))).select("key", "node", "value", "version")


def failure_cause(kind: Column) -> Column:
    """Why a replica call failed, by the kind of error; null means it could not be asked."""
    k = F.upper(kind)
    return F.when(kind.isNull() | k.isin("UNAVAILABLE", "ILLEGAL_STATE"), "UNAVAILABLE_NODE").when(k.isin("DEADLINE_EXCEEDED", "CANCELLED"), "DROPPED_MESSAGE").otherwise("UNKNOWN")


def completion(acks: DataFrame, w: int, deadline_ms: int, pw: int = 0, reads: DataFrame | None = None, r: int = 1) -> DataFrame:
    """(req, completed_ms, met): the w-th smallest ack latency (and the pw-th primary's), if within the deadline.

    With ``reads`` (req, ok, latency_ms), a write first reads the clocks of ``r`` replicas: it begins at the r-th smallest answer,
    and both count to the deadline.
    """
    lat = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("latency_ms"))))
    g = acks.groupBy("req").agg(lat(F.col("ok")).alias("l"), lat(F.col("ok") & F.col("is_primary")).alias("p"))
    nth = lambda a, i: F.expr(f"try_element_at({a}, {i})")
    done = nth("l", w) if not pw else F.when(nth("l", w).isNotNull() & nth("p", pw).isNotNull(), F.greatest(nth("l", w), nth("p", pw)))
    if reads is None:
        timed = g.select("req", done.alias("d"))
    else:
        first = reads.groupBy("req").agg(lat(F.col("ok")).alias("a")).select("req", nth("a", r).alias("begin"))
        timed = g.join(first, "req", "left").select("req", (F.col("begin") + done).alias("d"))
    return timed.select("req", F.when(F.col("d") <= deadline_ms, F.col("d")).alias("completed_ms"), F.coalesce(F.col("d") <= deadline_ms, F.lit(False)).alias("met"))


def hedge_decision(acks: DataFrame, w: int, delay_ms: int) -> DataFrame:
    """(req, hedged, backup): one backup request, to the lowest node not primary, if w primaries haven't acked by the delay."""
    g = acks.groupBy("req").agg(
        F.count_distinct(F.when(F.col("ok") & F.col("is_primary") & (F.col("latency_ms") <= delay_ms), F.col("node"))).alias("in_time"), F.min(F.when(~F.col("is_primary"), F.col("node"))).alias("b")
    )
    hedged = (F.col("in_time") < w) & F.col("b").isNotNull()
    return g.select("req", hedged.alias("hedged"), F.when(hedged, F.col("b")).alias("backup"))
