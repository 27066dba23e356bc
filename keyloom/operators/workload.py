"""Workload generation and replay, and amplification accounting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.hashing import Lcg48, zipf_index
from keyloom.operators.lsm import newest_wins
from keyloom.operators.running import running_total
from keyloom.session import stage

#: Shares of read, update, insert, scan and read-modify-write of the standard mixes.
MIXES = {
    "A": (0.50, 0.50, 0.00, 0.00, 0.00),
    "B": (0.95, 0.05, 0.00, 0.00, 0.00),
    "C": (1.00, 0.00, 0.00, 0.00, 0.00),
    "D": (0.95, 0.00, 0.05, 0.00, 0.00),
    "E": (0.00, 0.00, 0.05, 0.95, 0.00),
    "F": (0.50, 0.00, 0.00, 0.00, 0.50),
}
KINDS = ("READ", "UPDATE", "INSERT", "SCAN", "READ_MODIFY_WRITE")
THETA = 0.99
KEY_SEED = 0x9E3779B9


def mixes(spark: SparkSession) -> DataFrame:
    """(workload, kind, share, upper): the mixes as rows with cumulative shares."""
    rows = [(w, k, float(s), float(sum(shares[: i + 1]))) for w, shares in MIXES.items() for i, (k, s) in enumerate(zip(KINDS, shares))]
    return spark.createDataFrame(rows, "workload string, kind string, share double, upper double")


def pick(draw: Column, workload: str) -> Column:
    """Operation kind of a uniform draw in [0, 1)."""
    out, upper = F.lit(KINDS[-1]), 0.0
    bounds = []
    for kind, share in zip(KINDS[:-1], MIXES[workload][:-1]):
        upper += share
        bounds.append((upper, kind))
    for upper, kind in reversed(bounds):
        out = F.when(draw < upper, kind).otherwise(out)
    return out


def record_key(index: Column) -> Column:
    return F.concat(F.lit("user"), F.lpad(index.cast("string"), 10, "0"))


def filler(salt: Column, size: int) -> Column:
    """Text of ``size`` letters that start at a letter by ``salt``."""
    start = F.pmod(salt, F.lit(26)).cast("int")
    alphabet = "abcdefghijklmnopqrstuvwxyz" * (size // 26 + 2)
    return F.substr(F.lit(alphabet), start + 1, F.lit(size))


def load_phase(spark: SparkSession, records: int, value_size: int) -> DataFrame:
    return spark.range(records).select(F.col("id").alias("idx"), F.lit("INSERT").alias("kind"), record_key(F.col("id")).alias("key"), filler(F.col("id"), value_size).alias("value"), F.lit(0).alias("scan_length"))


def zeta(spark: SparkSession, n: int, theta: float = THETA) -> float:
    """Sum of 1 / i^theta for i up to n, over partitions."""
    return spark.range(1, n + 1).select(F.sum(F.pow(F.col("id"), F.lit(-theta))).alias("z")).first().z or 0.0


def run_phase(spark: SparkSession, workload: str, records: int, operations: int, value_size: int, max_scan: int = 100, distribution: str = "zipfian", seed: int = 42) -> DataFrame:
    """(idx, kind, key, value, scan_length): a reproducible stream of operations.

    One generator draws kinds and scan lengths, a second the keys, so a stream is sequential by definition: it is drawn by one
    task as 40 bytes an operation, and values are made in the JVM. Streams of different seeds run side by side.
    """
    zeta_n = sum(i**-THETA for i in range(1, records + 1)) if records <= 100_000 else zeta(spark, records)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["seed"].tolist():
                kinds, keys = Lcg48(s), Lcg48(s ^ KEY_SEED)
                index = (lambda: zipf_index(keys.unit(), records, THETA, zeta_n)) if distribution == "zipfian" else (lambda: keys.below(records))
                upper = [sum(MIXES[workload][: i + 1]) for i in range(4)]
                inserted, out = records, []
                for i in range(operations):
                    r = kinds.unit()
                    kind = next((k for k, u in zip(KINDS, upper) if r < u), KINDS[-1])
                    length = 0
                    if kind == "INSERT":
                        at, inserted = inserted, inserted + 1
                    else:
                        if kind == "SCAN":
                            length = 1 + kinds.below(max(1, max_scan))
                        at = index()
                    out.append((i, kind, at, length))
                    if len(out) == 100_000:
                        yield pd.DataFrame(out, columns=["idx", "kind", "at", "scan_length"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["idx", "kind", "at", "scan_length"])

    drawn = spark.createDataFrame([(seed,)], "seed bigint").mapInPandas(draw, "idx bigint, kind string, at bigint, scan_length int")
    value = F.when(F.col("kind").isin("UPDATE", "INSERT", "READ_MODIFY_WRITE"), filler(F.col("idx"), value_size))
    return drawn.select("idx", "kind", record_key(F.col("at")).alias("key"), value.alias("value"), "scan_length")


def run_workload(ops: DataFrame, loaded: DataFrame) -> DataFrame:
    """(idx, kind, rows): rows each operation touches. Reads find 0 or 1, writes 1, read-modify-writes one more than they find,
    scans the first scan_length keys present at that time from theirs on.

    A key once written stays, so it is present from its first write on: presence is a window per key. For scans, keys are
    ordered by the time they appear; keys of the load, present throughout, are counted by rank, and the few inserted later are
    compared with the scans.
    """
    # drawn or read once: operations are used for presence, for points and for scans
    ops = stage(ops, "operations")
    writes = ops.where(F.col("kind").isin("UPDATE", "INSERT", "READ_MODIFY_WRITE")).select("key", "idx")
    born = loaded.select("key", F.lit(-1).cast("bigint").alias("idx")).unionByName(writes).groupBy("key").agg(F.min("idx").alias("born"))
    j = ops.join(born, "key", "left")
    found = F.coalesce((F.col("born") < F.col("idx")).cast("bigint"), F.lit(0))
    points = j.where("kind <> 'SCAN'").select("idx", "kind", F.when(F.col("kind") == "READ", found).when(F.col("kind") == "READ_MODIFY_WRITE", found + 1).otherwise(F.lit(1)).cast("bigint").alias("rows"))
    scans = ops.where("kind = 'SCAN'").select("idx", "key", "scan_length")
    # keys of the load from the scan's key on: by rank among keys and scans together
    stay = born.where("born < 0").select("key", F.lit(0).alias("k"), F.lit(None).cast("bigint").alias("idx"), F.lit(None).cast("int").alias("scan_length"))
    both = stay.unionByName(scans.select("key", F.lit(1).alias("k"), "idx", "scan_length"))
    ordered = running_total(both.withColumn("k2", -F.col("k")), ["key", "k2", "idx"], (F.col("k") == 0).cast("bigint"), "upto")
    total = stay.select(F.count(F.lit(1)).alias("n")).scalar()
    # a scan comes before the key it starts from, so all but those before it are at or above
    base = ordered.where("k = 1").select("idx", "key", "scan_length", (total - F.col("upto")).alias("base"))
    later = born.where("born >= 0").select(F.col("key").alias("bk"), "born")
    short = base.where(F.col("base") < F.col("scan_length"))
    extra = short.join(later, (F.col("bk") >= F.col("key")) & (F.col("born") < F.col("idx"))).groupBy("idx").agg(F.count(F.lit(1)).alias("extra"))
    counted = base.join(extra, "idx", "left").select("idx", F.lit("SCAN").alias("kind"), F.least(F.col("scan_length").cast("bigint"), F.col("base") + F.coalesce("extra", F.lit(0))).alias("rows"))
    return points.unionByName(counted)


def bytes_written(writes: DataFrame) -> DataFrame:
    """(user_bytes, logical_bytes): key and value bytes of all writes, and of the live entries they leave."""
    size = lambda k, v: F.octet_length(k) + F.coalesce(F.octet_length(v), F.lit(0))
    user = writes.agg(F.coalesce(F.sum(size(F.col("key"), F.col("value"))), F.lit(0)).alias("user_bytes"))
    live = newest_wins(writes, drop_tombstones=True).agg(F.coalesce(F.sum(size(F.col("key"), F.col("value"))), F.lit(0)).alias("logical_bytes")).scalar()
    return user.withColumn("logical_bytes", live)


def read_amplification(keys: DataFrame, runs: DataFrame, samples: int = 1000) -> DataFrame:
    """(read_amp): mean number of runs whose range holds a key, over the live keys sampled at an even stride.

    Runs are metadata, one row a file. A key's runs are those begun by it less those ended before it, so both are counted
    along one ordering of keys and bounds instead of by comparing each key with each run.
    """
    n = keys.select(F.count(F.lit(1)).alias("n")).scalar()
    ranked = running_total(keys.select("key"), ["key"], F.lit(1), "n").select("key", (F.col("n") - 1).alias("r"))
    sampled = ranked.where(F.col("r") % F.greatest(F.lit(1), F.floor(n / samples)) == 0).select("key", F.lit(1).alias("k"), F.lit(0).alias("d"))
    bounds = runs.where("first is not null").select(F.explode(F.array(F.struct(F.col("first").alias("key"), F.lit(0).alias("k"), F.lit(1).alias("d")), F.struct(F.col("last").alias("key"), F.lit(2).alias("k"), F.lit(-1).alias("d")))).alias("e")).select("e.*")
    points = sampled.unionByName(bounds).groupBy("key", "k").agg(F.sum("d").cast("bigint").alias("d"), F.count(F.lit(1)).alias("times"))
    return running_total(points, ["key", "k"], F.col("d"), "runs").where("k = 1").agg(F.coalesce(F.avg("runs"), F.lit(0.0)).alias("read_amp"))
