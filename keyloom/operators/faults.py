"""Fault models as column rules: message loss, unavailable and slow nodes, partitions, and outages in probe logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.hashing import mix64, text_hash32


def drop_messages(messages: DataFrame, rate: float, seed: int, message: str = "message", source: str = "source", target: str = "target") -> DataFrame:
    """``messages`` with ``dropped``: a draw fixed by seed, message and both nodes is below ``rate``; 0 drops none, 1 all."""
    if rate <= 0 or rate >= 1:
        return messages.withColumn("dropped", F.lit(rate >= 1))

    def signed(s: pd.Series) -> np.ndarray:
        known: dict[str, int] = {}
        return np.fromiter((known[x] if x in known else known.setdefault(x, text_hash32(x)) for x in s), np.int64, len(s)).view(np.uint64)

    @F.pandas_udf(T.BooleanType())
    def draw(m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        h = mix64(np.full(len(m), seed & 0xFFFFFFFFFFFFFFFF, np.uint64))
        for part in (m, a, b):
            h = mix64(h ^ signed(part))
        return pd.Series((h >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate)

    return messages.withColumn("dropped", draw(F.col(message), F.col(source), F.col(target)))


def delivery(messages: DataFrame, unavailable: DataFrame, latencies: DataFrame, target: str = "target") -> DataFrame:
    """``messages`` with ``available`` and ``latency_ms`` of their target node; 0 where none is fixed."""
    down = unavailable.select(F.col("node").alias(target), F.lit(True).alias("__down")).distinct()
    slow = latencies.select(F.col("node").alias(target), F.col("latency_ms").alias("__ms"))
    return messages.join(down, target, "left").join(slow, target, "left").withColumn("available", F.col("__down").isNull()).withColumn("latency_ms", F.coalesce(F.col("__ms"), F.lit(0))).drop("__down", "__ms")


def reachable(messages: DataFrame, groups: DataFrame, active: bool | Column = True, source: str = "source", target: str = "target") -> DataFrame:
    """``messages`` with ``reachable``: no partition, the same node, the same group, or a node in none."""
    g = lambda c, n: groups.select(F.col("node").alias(c), F.col("group").alias(n))
    j = messages.join(g(source, "__sg"), source, "left").join(g(target, "__tg"), target, "left")
    on = F.lit(active) if isinstance(active, bool) else active
    ok = ~on | (F.col(source) == F.col(target)) | F.col("__sg").isNull() | F.col("__tg").isNull() | (F.col("__sg") == F.col("__tg"))
    return j.withColumn("reachable", ok).drop("__sg", "__tg")


def outages(kills: DataFrame, probes: DataFrame) -> DataFrame:
    """(cycle, outage_ms, catchup_ms): from each kill (cycle, kill_ms) to its cycle's first later success (cycle, at_ms, ok), and
    to the first probe at which all members have applied something (all_applied)."""
    after = kills.join(probes, "cycle").where(F.col("at_ms") > F.col("kill_ms"))
    return after.groupBy("cycle").agg((F.min(F.when(F.col("ok"), F.col("at_ms"))) - F.min("kill_ms")).alias("outage_ms"), (F.min(F.when(F.col("all_applied"), F.col("at_ms"))) - F.min("kill_ms")).alias("catchup_ms"))
