"""Consistency and linearizability checks of operation histories.

Histories are rows (idx, key, type READ/WRITE, value, start_ms, end_ms, result SUCCESS/FAILURE/UNKNOWN); idx is
the order of recording and is part of the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.running import laid

MAX_OPERATIONS = 64


def _successful(history: DataFrame, kind: str) -> DataFrame:
    return history.where((F.col("type") == kind) & (F.col("result") == "SUCCESS"))


def _last_before(ops: DataFrame, *within: str) -> DataFrame:
    """Each read of ``ops`` with the write that ended last by its start: (idx, key, value, w).

    In place of an as-of join, writes are placed at their end, reads at their start, and the latest write
    before (or at) a read is carried forward, range by range for a long history. Of writes that end together the first recorded counts.
    """
    group = ["key", *within]
    read = F.col("type") == "READ"
    own = F.when(~read, F.struct(F.col("end_ms").alias("e"), (-F.col("idx")).alias("i"), F.col("value").alias("v")))
    points = ops.select(*group, F.when(read, F.col("start_ms")).otherwise(F.col("end_ms")).alias("at"), read.alias("kind"), F.when(read, F.col("idx")).otherwise(-F.col("idx")).alias("tie"), "idx", "value", own.alias("own"))
    # the latest by this order is also the greatest
    return laid(points, group, ["at", "kind", "tie"]).carried(most={"w": F.col("own")}).rows().where("kind").select("idx", "key", "value", "w")


def _as_of(history: DataFrame, own_session: bool) -> DataFrame:
    """Each successful read with what it should have seen: of the key's writes that ended by its start, the last to end.

    For the session check only writes recorded before the read count. That is a second order besides time; no pairs
    are made for it: operations are halved by recording order again and again, and at each of the log2(n) levels the
    reads of a right half look back at the writes of its left half, as above.
    """
    done = history.where("result = 'SUCCESS'").select("idx", "key", "type", "value", "start_ms", "end_ms")
    if not own_session:
        return _last_before(done)
    ranked = laid(done, ["key"], ["idx"]).carried(total={"r": F.lit(1)}).rows()
    sizes = ranked.groupBy("key").agg((F.max("r") + 1).alias("n")).withColumnRenamed("key", "__k")
    ranked = ranked.join(sizes, F.col("key").eqNullSafe(F.col("__k"))).drop("__k")
    levels = F.sequence(F.lit(0), F.length(F.bin(F.col("n") - 1)) - 1)
    at = ranked.withColumn("level", F.explode(levels)).withColumn("block", F.expr("shiftright(r, level + 1)")).withColumn("right", F.expr("shiftright(r, level) & 1"))
    found = _last_before(at.where("(type = 'READ') = (right = 1)"), "level", "block")
    return found.groupBy("idx", "key", "value").agg(F.max("w").alias("w"))


def _violations(seen: DataFrame, kind: str) -> DataFrame:
    bad = seen.where(F.col("w").isNotNull() & ~F.col("value").eqNullSafe(F.col("w.v")))
    return bad.select(F.lit(kind).alias("type"), "key", "idx", F.col("w.v").alias("expected"), F.col("value").alias("observed"))


def stale_reads(history: DataFrame) -> DataFrame:
    """Successful reads that differ from the last write that had ended when they began: (type, key, idx, expected, observed)."""
    return _violations(_as_of(history, False), "STALE_READ")


def read_your_writes(history: DataFrame) -> DataFrame:
    """The same among writes recorded before the read: the history is one session."""
    return _violations(_as_of(history, True), "READ_YOUR_WRITES")


def monotonic_reads(history: DataFrame) -> DataFrame:
    """Reads of a value first written before one that an earlier read has seen; values never written are skipped."""
    first = _successful(history, "WRITE").groupBy("key", "value").agg(F.min("idx").alias("rank"))
    ranked = _successful(history, "READ").join(first.withColumnRenamed("value", "wv").withColumnRenamed("key", "wk"), (F.col("key") == F.col("wk")) & F.col("value").eqNullSafe(F.col("wv")))
    return laid(ranked, ["key"], ["idx"]).carried(most={"best": F.struct("rank", "value")}).rows().where(F.col("rank") < F.col("best.rank")).select(
        F.lit("MONOTONIC_READ").alias("type"), "key", "idx", F.col("best.value").alias("expected"), F.col("value").alias("observed")
    )


def violations(history: DataFrame) -> DataFrame:
    return stale_reads(history).unionByName(read_your_writes(history)).unionByName(monotonic_reads(history))


def violations_by_type(history: DataFrame) -> DataFrame:
    return violations(history).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def linearize(ops: list[tuple[str, str | None, float, float, bool]]) -> tuple[bool, list[int], list[int]]:
    """Whether a register could have answered so: (verdict, longest valid order found, operations that then could not follow).

    ops: (type, value, start, end, optional); one operation comes before another if it ended strictly before the
    other began. Optional ones (writes of unknown outcome) never end and may be left out. A state is the set of operations
    done and the register's value; each is tried once.
    """
    n = len(ops)
    before = [sum(1 << j for j in range(n) if ops[j][3] < ops[i][2]) for i in range(n)]
    need = sum(1 << i for i in range(n) if not ops[i][4])
    seen: set[tuple[int, str | None]] = set()
    best: list[int] = []
    stuck: list[int] = []
    stack: list[tuple[int, str | None, tuple[int, ...]]] = [(0, None, ())]
    while stack:
        done, value, order = stack.pop()
        if done & need == need:
            return True, list(order), []
        if (done, value) in seen:
            continue
        seen.add((done, value))
        open_ = [i for i in range(n) if not done >> i & 1 and before[i] & ~done == 0]
        fit = [i for i in open_ if ops[i][0] == "WRITE" or ops[i][1] == value]
        unfit = [i for i in open_ if i not in fit]
        if unfit and len(order) >= len(best):
            best, stuck = list(order), unfit
        for i in reversed(fit):
            stack.append((done | 1 << i, ops[i][1] if ops[i][0] == "WRITE" else value, (*order, i)))
    return False, best, stuck


_VERDICT_ARROW = pa.schema([("key", pa.string()), ("first_idx", pa.int64()), ("n_ops", pa.int32()), ("verdict", pa.string()), ("prefix", pa.list_(pa.int64())), ("stuck", pa.list_(pa.int64()))])
_VERDICT = "key string, first_idx bigint, n_ops int, verdict string, prefix array<bigint>, stuck array<bigint>"


def linearizability(history: DataFrame, max_operations: int = MAX_OPERATIONS) -> DataFrame:
    """(key, first_idx, n_ops, verdict, prefix, stuck) per key.

    Failures and reads of unknown outcome don't count; writes of unknown outcome may or may not have happened. A key
    with more than ``max_operations`` such operations is INCONCLUSIVE and never leaves the JVM as a group, which also
    bounds the groups that do.
    """
    ops = history.where((F.col("result") == "SUCCESS") | ((F.col("result") == "UNKNOWN") & (F.col("type") == "WRITE")))
    sizes = ops.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n_ops"), F.min("idx").alias("first_idx"))
    empty = F.expr("cast(array() as array<bigint>)")
    large = sizes.where(F.col("n_ops") > max_operations).select("key", "first_idx", "n_ops", F.lit("INCONCLUSIVE").alias("verdict"), empty.alias("prefix"), empty.alias("stuck"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                rows = [(o["type"], o["value"], o["start_ms"], np.inf if o["u"] else o["end_ms"], o["u"]) for o in r["ops"]]
                ok, order, stuck = linearize(rows)
                idx = [o["idx"] for o in r["ops"]]
                out.append({"key": r["key"], "first_idx": idx[0], "n_ops": len(idx), "verdict": "LINEARIZABLE" if ok else "VIOLATION", "prefix": [] if ok else [idx[i] for i in order], "stuck": [idx[i] for i in stuck]})
            yield pa.RecordBatch.from_pylist(out, schema=_VERDICT_ARROW)

    # a key's operations, bounded above, are one row: groups of their own would each cost a call
    op = F.struct("idx", "type", "value", "start_ms", "end_ms", (F.col("result") == "UNKNOWN").alias("u"))
    small = ops.join(sizes.where(F.col("n_ops") <= max_operations).select("key"), "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list(op)).alias("ops")).mapInArrow(check, _VERDICT)
    return small.unionByName(large)


def first_violation(verdicts: DataFrame) -> DataFrame:
    """The violating key that occurs first in the history."""
    return verdicts.where("verdict = 'VIOLATION'").orderBy("first_idx").limit(1)


def verdict_tally(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def outcome(error: Column) -> Column:
    """Result of a client operation by its error: definite refusals failed, all else may have happened; none is success."""
    e = F.upper(error)
    return F.when(error.isNull(), "SUCCESS").when(e.isin("NOT_LEADER", "INVALID_ARGUMENT", "UNIMPLEMENTED", "PROPOSAL_REJECTED"), "FAILURE").otherwise("UNKNOWN")


def history_summary(history: DataFrame) -> DataFrame:
    """(key, ops, reads, writes, failures, unknown, slowest_ms) per key."""
    return history.groupBy("key").agg(
        F.count(F.lit(1)).alias("ops"), F.count_if(F.col("type") == "READ").alias("reads"), F.count_if(F.col("type") == "WRITE").alias("writes"),
        F.count_if(F.col("result") == "FAILURE").alias("failures"), F.count_if(F.col("result") == "UNKNOWN").alias("unknown"), F.max(F.col("end_ms") - F.col("start_ms")).alias("slowest_ms"),
    )


def failing_prefix(history: DataFrame, found: DataFrame) -> DataFrame:
    """(key, prefix): per key the operations up to its first violation, as ``op -> op``."""
    first = found.groupBy("key").agg(F.min("idx").alias("upto"))
    label = F.concat(F.col("type"), F.lit(" "), F.coalesce(F.col("value"), F.lit("null")))
    cut = history.join(first, "key").where(F.col("idx") <= F.col("upto"))
    return cut.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("idx", label.alias("l")))).alias("o")).select("key", F.concat_ws(" -> ", F.transform("o", lambda x: x["l"])).alias("prefix"))


def audit_acknowledged(writes: DataFrame, state: DataFrame, checked: DataFrame) -> DataFrame:
    """(acknowledged, present, missing, unchecked): acknowledged writes (key, value, result) against the state (key, value);
    keys never read back (not in ``checked``) are apart from those found missing, and unknown outcomes don't count."""
    a = writes.where(F.col("result") == "SUCCESS").select("key", "value")
    j = a.join(state.select("key", F.col("value").alias("found")), "key", "left").join(checked.select("key", F.lit(True).alias("was")).distinct(), "key", "left")
    hit = F.col("found").eqNullSafe(F.col("value")) & F.col("found").isNotNull()
    return j.agg(
        F.count(F.lit(1)).alias("acknowledged"), F.count_if(F.col("was").isNotNull() & hit).alias("present"),
        F.count_if(F.col("was").isNotNull() & ~hit).alias("missing"), F.count_if(F.col("was").isNull()).alias("unchecked"),
    )
