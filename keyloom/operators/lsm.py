"""Log-structured storage as relations: entries (key, value null = tombstone, seq) in runs, newest sequence wins.

Keys are ordered by UTF-8 bytes. A point or range predicate is applied to the entries, before the merge, so it
reaches the files' statistics; sorted runs written by :func:`flush` make those statistics narrow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.running import running_total


def union_runs(*runs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def newest_wins(entries: DataFrame, key: str = "key", value: str = "value", seq: str = "seq", drop_tombstones: bool = False) -> DataFrame:
    """(key, value, seq): per key the entry of greatest sequence, in whatever run it lies. The value is wrapped, as a null must win too."""
    out = entries.groupBy(F.col(key).alias("key")).agg(F.max_by(F.struct(F.col(value).alias("value")), seq).alias("__v"), F.max(seq).alias("seq")).select("key", F.col("__v.value").alias("value"), "seq")
    return out.where(F.col("value").isNotNull()) if drop_tombstones else out


def key_range(key: Column, start: str | None, end: str | None) -> Column:
    """start <= key < end; None is open, and an empty text is a bound like any other."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (key >= start)
    if end is not None:
        cond = cond & (key < end)
    return cond


def point_get(entries: DataFrame, key: str) -> DataFrame:
    """The live newest value of one key; no row if deleted or absent."""
    return newest_wins(entries.where(F.col("key") == key), drop_tombstones=True)


def range_scan(entries: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Live newest entries with start <= key < end, ascending by key, at most ``limit`` of them (none or <= 0: all)."""
    out = newest_wins(entries.where(key_range(F.col("key"), start, end)), drop_tombstones=True).orderBy("key")
    return out.limit(limit) if limit is not None and limit > 0 else out


def run_scan(run: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A single run's entries in range, tombstones included."""
    return run.where(key_range(F.col("key"), start, end)).orderBy("key")


def assign_sequence(writes: DataFrame, order: str, start: int | Column = 0) -> DataFrame:
    """``writes`` with ``seq`` start+1, start+2, ... by ``order``, numbered in parallel."""
    out = running_total(writes, [order], F.lit(1), "seq")
    return out.withColumn("seq", F.col("seq") + start)


def recover(tables: DataFrame, wal: DataFrame) -> DataFrame:
    """Entries after a restart: the log's records (offset, key, value) get sequences above every table's, in log order."""
    top = tables.select(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).scalar()
    return tables.select("key", "value", "seq").unionByName(assign_sequence(wal, "offset", top).select("key", "value", "seq"))


def flush(entries: DataFrame, path: str, max_records: int = 5_000_000) -> DataFrame:
    """Write the merged entries as sorted runs and read them back: files hold disjoint key ranges, unique keys in each."""
    merged = newest_wins(entries)
    merged.repartitionByRange("key").sortWithinPartitions("key").write.option("maxRecordsPerFile", max_records).parquet(path)
    return entries.sparkSession.read.parquet(path)


def flush_runs(entries: DataFrame, path: str, run: str = "run_id") -> DataFrame:
    """Write each run's merged entries sorted by key into a folder of its own and read all runs back.

    A predicate on the run then picks folders, and one on the key is pushed to the files, where ranges and a membership filter of
    their row groups rule most of them out.
    """
    merged = entries.groupBy(run, "key").agg(F.max_by(F.struct("value"), "seq").alias("__v"), F.max("seq").alias("seq")).select(run, "key", F.col("__v.value").alias("value"), "seq")
    ordered = merged.repartitionByRange(run, "key").sortWithinPartitions(run, "key")
    ordered.write.option("parquet.bloom.filter.enabled#key", "true").partitionBy(run).parquet(path)
    return entries.sparkSession.read.parquet(path)


def run_lookup(runs: DataFrame, run_id: int, key: str, run: str = "run_id") -> DataFrame:
    """A single run's entry for a key, tombstones included; no row if it holds none."""
    return runs.where((F.col(run) == run_id) & (F.col("key") == key)).select("key", "value", "seq")


def compact(inputs: DataFrame, max_bytes: int, drop_tombstones: bool) -> DataFrame:
    """Merged entries cut into output runs: (out_run, key, value, seq).

    In key order, an entry goes to run floor(bytes before it / max_bytes), so a run exceeds max_bytes by one
    entry at most.
    """
    merged = newest_wins(inputs, drop_tombstones=drop_tombstones).withColumn("bytes", 16 + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)))
    placed = running_total(merged, ["key"], F.col("bytes"), "upto")
    return placed.select(F.floor((F.col("upto") - F.col("bytes")) / max_bytes).cast("bigint").alias("out_run"), "key", "value", "seq")


def swap_runs(live: DataFrame, obsolete: DataFrame, added: DataFrame, on: str = "run_id") -> DataFrame:
    """The run list after a compaction: those not obsolete, and the added."""
    return live.join(obsolete.select(on), on, "left_anti").unionByName(added)


def replace_put(entries: DataFrame, order: str = "seq") -> DataFrame:
    """Administrative puts: each replaces what its key held, with the next version; the last write and its version per key."""
    return entries.groupBy("key").agg(F.max_by(F.struct("value"), order).alias("v"), F.count(F.lit(1)).alias("version")).select("key", F.col("v.value").alias("value"), "version")


def read_as_of(log: DataFrame, index: int) -> DataFrame:
    """The map as of log index ``index``: (key, value, version = index of the writer), deleted keys left out."""
    return newest_wins(log.where(F.col("idx") <= index), seq="idx", drop_tombstones=True).withColumnRenamed("seq", "version")


def snapshot(log: DataFrame, index: int) -> DataFrame:
    """State table sorted by key with the index it includes."""
    return read_as_of(log, index).withColumn("last_included_index", F.lit(index).cast("bigint")).orderBy("key")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
