"""Compaction planning over run metadata (run_id, level, size, first, last).

Results name the inputs: (run_id, output_level, drop_tombstones), no rows if nothing is to be done. Run metadata is
one row per file, so joins of it are small; overlap joins are by comparison of bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """Whether two inclusive key ranges meet; an empty run (null bounds) meets none."""
    return F.coalesce((a_first <= b_last) & (b_first <= a_last), F.lit(False))


def size_tier(size: Column) -> Column:
    """Bits of max(1, size): runs of one tier differ by less than a factor of two."""
    return F.length(F.bin(F.greatest(F.lit(1), size).cast("bigint")))


def plan_size_tiered(runs: DataFrame, min_runs: int = 4) -> DataFrame:
    """All runs of the first tier, in table order (run_id), that has ``min_runs``; tombstones go only if that is every run."""
    tiered = runs.withColumn("tier", size_tier(F.col("size")))
    tiers = tiered.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("at"))
    ranked = tiers.withColumn("total", F.sum("n").over(Window.partitionBy())).where(F.col("n") >= min_runs)
    chosen = ranked.orderBy("at").limit(1).select("tier", (F.col("n") == F.col("total")).alias("drop_tombstones"))
    return tiered.join(chosen, "tier").select("run_id", F.lit(0).alias("output_level"), "drop_tombstones")


def _meeting(runs: DataFrame, level: Column, seeds: DataFrame) -> DataFrame:
    """Runs of ``level`` whose keys meet those of a run in ``seeds``."""
    s = seeds.select(F.col("first").alias("s_first"), F.col("last").alias("s_last"))
    return runs.where(F.col("level") == level).join(s, overlaps(F.col("first"), F.col("last"), F.col("s_first"), F.col("s_last")), "left_semi")


def plan_leveled_l0(runs: DataFrame, trigger: int = 4) -> DataFrame:
    """With ``trigger`` runs in level 0: all of them and every level 1 run that meets one; tombstones go if nothing lies deeper than 1."""
    flags = runs.agg(F.count_if(F.col("level") == 0).alias("n0"), F.coalesce(F.max("level"), F.lit(0)).alias("deepest"))
    zero = runs.where("level = 0")
    inputs = zero.unionByName(_meeting(runs, F.lit(1), zero)).select("run_id")
    gate = flags.where(F.col("n0") >= trigger).select((F.col("deepest") <= 1).alias("drop_tombstones"), F.lit(1).alias("output_level"))
    return inputs.withColumn("output_level", F.lit(1)).join(gate, "output_level").select("run_id", "output_level", "drop_tombstones")


def plan_leveled_budget(runs: DataFrame, base_bytes: int, ratio: int = 10) -> DataFrame:
    """The lowest level n >= 1 beyond base * ratio^(n-1): its run of smallest first key and what it meets in level n+1."""
    over = (
        runs.where("level >= 1").groupBy("level").agg(F.sum("size").alias("size"), F.min_by("run_id", F.struct("first", "run_id")).alias("pick"))
        .where(F.col("size") > F.lit(base_bytes) * F.pow(F.lit(ratio), F.col("level") - 1)).orderBy("level").limit(1)
    )
    chosen = runs.join(over.select(F.col("pick").alias("run_id"), F.col("level").alias("n")), "run_id")
    deepest = runs.select(F.max("level").alias("m")).scalar()
    below = chosen.select(F.col("first").alias("s_first"), F.col("last").alias("s_last"), (F.col("n") + 1).alias("level"), F.col("n"))
    met = runs.join(below, "level").where(overlaps(F.col("first"), F.col("last"), F.col("s_first"), F.col("s_last"))).select("run_id", "n")
    return chosen.select("run_id", "n").unionByName(met).select("run_id", (F.col("n") + 1).cast("int").alias("output_level"), (deepest <= F.col("n") + 1).alias("drop_tombstones"))


def plan_leveled(runs: DataFrame, trigger: int = 4, base_bytes: int = 4 << 20, ratio: int = 10) -> DataFrame:
    """Level 0 first; the budget rule only if level 0 asks for nothing."""
    l0 = plan_leveled_l0(runs, trigger)
    rest = plan_leveled_budget(runs, base_bytes, ratio)
    busy = runs.select(F.count_if(F.col("level") == 0).alias("n0")).scalar()
    return l0.unionByName(rest.where(busy < trigger))
