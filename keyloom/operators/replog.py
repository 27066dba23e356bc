"""A replicated log and its state machine: at-most-once apply, replay, merge, commit and votes as set operations."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from keyloom.operators.lsm import newest_wins
from keyloom.operators.running import laid

MAX_SESSIONS = 4096


def _command() -> Column:
    return F.struct("op", "key", "value")


def _folded(log: DataFrame, max_sessions: int) -> DataFrame:
    """The outcomes by an ordered fold in one task, which holds at most ``max_sessions`` sessions and sorts on disk if need be."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[str, tuple] = OrderedDict()  # client: (seq, command), least recently used first
        for b in batches:
            out = []
            for client, seq, *command in zip(*(b.column(c).to_pylist() for c in ("client", "seq", "op", "key", "value"))):
                last = kept.get(client)
                if last is not None and seq <= last[0]:
                    out.append("STALE" if seq < last[0] else "DUPLICATE" if command == last[1] else "CONFLICT")
                else:
                    out.append("APPLIED")
                    kept[client] = (seq, command)
                if out[-1] in ("APPLIED", "DUPLICATE"):
                    kept.move_to_end(client)
                    if len(kept) > max_sessions:
                        kept.popitem(last=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "outcome"])

    schema = StructType([*log.schema.fields, StructField("outcome", StringType())])
    return log.repartition(1).sortWithinPartitions("idx").mapInArrow(fold, schema)


def apply_at_most_once(log: DataFrame, max_sessions: int = MAX_SESSIONS) -> DataFrame:
    """``log`` (idx, client, seq, op, key, value) with ``outcome``: APPLIED, DUPLICATE, CONFLICT or STALE.

    A client's sequence number counts once: a smaller one is stale, an equal one a duplicate if it is the same command
    and a conflict if not. Commands are compared themselves, not by a digest. Empty barrier commands (null op) are
    skipped. Sessions of more than ``max_sessions`` clients are dropped, the one that applied or retried longest ago first,
    and a client without one is new. Extremes carried along each client's commands do it without a fold while no session
    is evicted, which is counted first; else the log is folded in order.
    """
    commands = log.where(F.col("op").isNotNull())
    if evicts(commands, max_sessions).first().evicts:
        return _folded(commands, max_sessions)
    seen = laid(commands, ["client"], ["idx"]).carried(most={"__mx": F.col("seq")}).rows()
    first = commands.groupBy("client", "seq").agg(F.min_by(_command(), "idx").alias("__first"))
    marked = seen.join(first.withColumnsRenamed({"client": "__c", "seq": "__s"}), F.col("client").eqNullSafe(F.col("__c")) & F.col("seq").eqNullSafe(F.col("__s"))).drop("__c", "__s")
    same = F.col("__first").eqNullSafe(_command())
    outcome = F.when(F.col("__mx").isNull() | (F.col("seq") > F.col("__mx")), "APPLIED").when(F.col("seq") < F.col("__mx"), "STALE").when(same, "DUPLICATE").otherwise("CONFLICT")
    return marked.withColumn("outcome", outcome).drop("__mx", "__first")


def applied(log: DataFrame, max_sessions: int = MAX_SESSIONS) -> DataFrame:
    return apply_at_most_once(log, max_sessions).where("outcome = 'APPLIED'").drop("outcome")


def state_after(log: DataFrame, max_sessions: int = MAX_SESSIONS) -> DataFrame:
    """(key, value, version): the map after the log; the version is the writer's index."""
    rows = applied(log, max_sessions).withColumn("value", F.when(F.col("op") == "PUT", F.col("value")))
    return newest_wins(rows, seq="idx", drop_tombstones=True).withColumnRenamed("seq", "version")


def command_results(log: DataFrame, max_sessions: int = MAX_SESSIONS) -> DataFrame:
    """(idx, op, result, existed) of applied commands: a put gives its value, a delete what was there; an empty value counts as not existing."""
    rows = applied(log, max_sessions).withColumn("value", F.when(F.col("op") == "PUT", F.col("value")))
    out = laid(rows, ["key"], ["idx"]).carried(most={"last": F.struct("idx", "value")}).rows().withColumn("prev", F.col("last.value"))
    return out.select("idx", "op", F.when(F.col("op") == "PUT", F.col("value")).otherwise(F.coalesce("prev", F.lit(""))).alias("result"), F.when(F.col("op") == "DELETE", F.coalesce(F.length("prev") > 0, F.lit(False))).alias("existed"))


def _sessions(log: DataFrame, max_sessions: int) -> DataFrame:
    """The sessions left: of the ``max_sessions`` clients that applied or retried last, as each of those is held until so many others did."""
    was = F.when(F.col("outcome") == "APPLIED", F.col("idx"))
    per = apply_at_most_once(log, max_sessions).groupBy("client").agg(
        F.max_by("seq", was).alias("last_seq"), F.max_by(_command(), was).alias("cmd"), F.max(was).alias("applied_idx"),
        F.max(F.when(F.col("outcome").isin("APPLIED", "DUPLICATE"), F.col("idx"))).alias("last_used"),
    )
    return per.orderBy(F.col("last_used").desc()).limit(max_sessions)


def sessions(log: DataFrame, max_sessions: int = MAX_SESSIONS) -> DataFrame:
    """(client, last_seq, applied_idx, last_used) after the log: the ``max_sessions`` clients that applied or retried last."""
    return _sessions(log, max_sessions).drop("cmd")


def evicts(log: DataFrame, max_sessions: int = MAX_SESSIONS) -> DataFrame:
    """(clients, evicts): whether the log has more clients than sessions are kept for."""
    return log.select(F.count_distinct("client").alias("clients")).withColumn("evicts", F.col("clients") > max_sessions)


def request_outcomes(requests: DataFrame, log: DataFrame, max_sessions: int = MAX_SESSIONS) -> DataFrame:
    """(client, seq, status) of requests (client, seq, op, key, value) against the final sessions."""
    last = _sessions(log, max_sessions).select("client", F.col("last_seq").alias("last"), "cmd")
    status = F.when(F.col("last").isNull() | (F.col("seq") > F.col("last")), "NOT_APPLIED").when(F.col("seq") < F.col("last"), "STALE").when(F.col("cmd").eqNullSafe(_command()), "APPLIED").otherwise("CONFLICT")
    return requests.join(last, "client", "left").select("client", "seq", "op", "key", "value", status.alias("status"))


def replay(records: DataFrame, node: str | None = None) -> DataFrame:
    """Entries (idx, term, command) that survive a replay of ``records`` (offset, kind, term, idx, command), of each ``node`` by itself.

    ENTRY writes a slot and cuts all after it, TRUNCATE cuts from idx on, SNAPSHOT covers all up to idx; entries at or
    below the snapshot in effect are nothing. So an entry stands iff no later ENTRY or TRUNCATE in effect has an idx up to
    its own, and no later SNAPSHOT covers it: suffix minima and maxima over the log, carried over ranges of a long one.
    """
    by = [node] if node else []
    covers = F.when(F.col("kind") == "SNAPSHOT", F.col("idx"))
    live = (F.col("kind") != "ENTRY") | (F.col("idx") > F.coalesce("base", F.lit(0)))
    cuts = F.when(F.col("kind").isin("ENTRY", "TRUNCATE"), F.col("idx"))
    later = laid(records, by, ["offset"]).carried(most={"base": covers}).carried(least={"cut": cuts}, most={"covered": covers}, reverse=True, of=lambda df: df.where(live))
    kept = later.rows().where("kind = 'ENTRY' AND (cut IS NULL OR cut > idx) AND (covered IS NULL OR covered < idx)")
    return kept.select(*by, "idx", "term", "command")


def _followed(records: DataFrame, node: str | None) -> DataFrame:
    """Surviving entries with ``prev``: the entry before, or the snapshot's index."""
    by = [node] if node else []
    before = laid(replay(records, node), by, ["idx"]).carried(most={"prev": F.col("idx")}).rows()
    base = records.groupBy(*by).agg(F.coalesce(F.max_by("idx", F.when(F.col("kind") == "SNAPSHOT", F.col("offset"))), F.lit(0)).alias("__base"))
    joined = before.join(base, node) if node else before.withColumn("__base", base.scalar())
    return joined.withColumn("prev", F.coalesce("prev", "__base")).drop("__base")


def replay_checked(records: DataFrame, node: str | None = None) -> DataFrame:
    """:func:`replay` that fails the job where an entry doesn't follow on the one before or on the snapshot."""
    gap = F.raise_error(F.concat(F.lit("gap in the log between "), F.col("prev"), F.lit(" and "), F.col("idx"))).cast("bigint")
    rows = _followed(records, node)
    return rows.withColumn("idx", F.when(F.col("idx") == F.col("prev") + 1, F.col("idx")).otherwise(gap)).drop("prev")


def replay_state(records: DataFrame) -> DataFrame:
    """(term, voted_for, base_idx, base_term): a TERM record sets both term and vote, a VOTE the vote; an empty vote is none."""
    return records.agg(
        F.coalesce(F.max_by("term", F.when(F.col("kind") == "TERM", F.col("offset"))), F.lit(0)).alias("term"),
        F.max_by(F.struct(F.nullif("voted_for", F.lit("")).alias("v")), F.when(F.col("kind").isin("TERM", "VOTE"), F.col("offset")))["v"].alias("voted_for"),
        F.coalesce(F.max_by("idx", F.when(F.col("kind") == "SNAPSHOT", F.col("offset"))), F.lit(0)).alias("base_idx"),
        F.coalesce(F.max_by("term", F.when(F.col("kind") == "SNAPSHOT", F.col("offset"))), F.lit(0)).alias("base_term"),
    )


def replay_gaps(records: DataFrame, node: str | None = None) -> DataFrame:
    """Surviving entries that don't follow on the one before or on the snapshot: a replay of them is an error."""
    return _followed(records, node).where(F.col("idx") != F.col("prev") + 1).select(*([node] if node else []), "idx", "prev")


def merge_entries(local: DataFrame, sent: DataFrame, base: int = 0) -> DataFrame:
    """The log (idx, term, command) after entries arrive: equal terms are kept, the first that differs or is new replaces the rest."""
    new = sent.where(F.col("idx") > base)
    j = new.alias("s").join(local.alias("l"), "idx", "left")
    at = j.where(~F.col("s.term").eqNullSafe(F.col("l.term"))).select(F.min("idx").alias("m"))
    cut = at.scalar()
    kept = local.where(cut.isNull() | (F.col("idx") < cut))
    return kept.unionByName(new.where(F.col("idx") >= cut).select(*local.columns))


def append_check(local: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (req, prev_idx, prev_term) with matches and, if not, conflict_idx = min(prev_idx, last + 1)."""
    last = local.select(F.coalesce(F.max("idx"), F.lit(0)).alias("m")).scalar()
    j = requests.join(local.select(F.col("idx").alias("prev_idx"), F.col("term").alias("have")), "prev_idx", "left")
    ok = (F.col("prev_idx") == 0) | F.coalesce(F.col("have") == F.col("prev_term"), F.lit(False))
    return j.select("req", "prev_idx", "prev_term", ok.alias("matches"), F.when(~ok, F.least(F.col("prev_idx"), last + 1)).alias("conflict_idx"))


def commit_index(matches: DataFrame, log: DataFrame, term: int | Column, current: int = 0) -> DataFrame:
    """(commit_idx): the highest index of the current term that a majority of ``matches`` (node, match_idx; the leader among them) hold."""
    held = matches.agg(F.sort_array(F.collect_list("match_idx"), asc=False).alias("m"))
    majority = held.select(F.expr("m[size(m) div 2]").alias("x")).scalar()
    reached = log.where((F.col("term") == term) & (F.col("idx") <= majority) & (F.col("idx") > current))
    return reached.agg(F.coalesce(F.max("idx"), F.lit(current)).cast("bigint").alias("commit_idx"))


def grant_votes(requests: DataFrame) -> DataFrame:
    """requests (voter, candidate, term, last_term, last_idx, my_term, voted_for, my_last_term, my_last_idx) with ``granted``."""
    fresh = F.struct("last_term", "last_idx") >= F.struct(F.col("my_last_term").alias("last_term"), F.col("my_last_idx").alias("last_idx"))
    free = (F.col("term") > F.col("my_term")) | F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate"))
    return requests.withColumn("granted", (F.col("term") >= F.col("my_term")) & free & fresh)


def elections(granted: DataFrame, members: int) -> DataFrame:
    """(candidate, term, votes, elected): a strict majority of the members elects."""
    g = granted.groupBy("candidate", "term").agg(F.count_distinct(F.when(F.col("granted"), F.col("voter"))).alias("votes"))
    return g.withColumn("elected", F.col("votes") > F.expr(f"{members} div 2"))


def compaction_point(applied_idx: Column, base_idx: Column, threshold: int) -> Column:
    """Where a node snapshots: at its applied index once that is ``threshold`` past its base, else nowhere."""
    return F.when(applied_idx - base_idx >= threshold, applied_idx)


def tail_after(log: DataFrame, base: int) -> DataFrame:
    return log.where(F.col("idx") > base)


def replication_plan(followers: DataFrame, log: DataFrame, base: int) -> DataFrame:
    """(follower, action, from_idx, entries): a follower that needs what the snapshot covers gets the snapshot, else entries."""
    last = log.select(F.coalesce(F.max("idx"), F.lit(base)).alias("m")).scalar()
    snap = F.col("next_idx") <= base
    return followers.select("follower", F.when(snap, "SNAPSHOT").otherwise("ENTRIES").alias("action"), F.when(snap, base).otherwise(F.col("next_idx")).cast("bigint").alias("from_idx"), F.when(snap, 0).otherwise(F.greatest(F.lit(0), last - F.col("next_idx") + 1)).cast("bigint").alias("entries"))


def install_snapshot(offers: DataFrame) -> DataFrame:
    """offers (node, snapshot_idx, base_idx, commit_idx) with ``installed``: only what lies past both base and commit."""
    return offers.withColumn("installed", (F.col("snapshot_idx") > F.col("base_idx")) & (F.col("snapshot_idx") > F.col("commit_idx")))


def readiness(members: DataFrame, heartbeats: DataFrame, now: int | Column, stale_ticks: int) -> DataFrame:
    """(node, ready) of members (node, role, leader) by the newest of their heartbeats (node, peer, tick): a leader needs
    a majority of members heard within ``stale_ticks``, itself among them; a follower its leader."""
    size = members.select(F.count(F.lit(1)).alias("n")).scalar()
    fresh = heartbeats.groupBy("node", "peer").agg(F.max("tick").alias("tick")).where(F.col("tick") >= now - stale_ticks)
    g = members.join(fresh, "node", "left").groupBy("node", "role", "leader").agg(F.count_distinct(F.when(F.col("peer") != F.col("node"), F.col("peer"))).alias("n"), F.max((F.col("peer") == F.col("leader")).cast("int")).alias("l"))
    return g.select("node", F.when(F.col("role") == "leader", (F.col("n") + 1) * 2 > size).otherwise(F.coalesce(F.col("l") == 1, F.lit(False))).alias("ready"))
