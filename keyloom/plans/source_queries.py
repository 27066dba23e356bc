"""Queries through the binary sources and the streaming forms."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions import clocks
from keyloom.functions.hashing import fingerprint_column
from keyloom.operators import lsm, replog, siblings
from keyloom.operators.changefeed import EqualityDeleteTable
from keyloom.plans import derive, log_queries, replica_queries, store_queries
from keyloom.plans.data_queries import ORACLES as DATA
from keyloom.plans.derive import with_views
from keyloom.session import staging_path, table
from keyloom.sources import binary, codecs
from keyloom.sources.files import Whole, listed
from keyloom.streaming import forms


def _text(c: str) -> F.Column:
    return F.decode(F.col(c), "UTF-8").alias(c)


def sc6_footer(spark: SparkSession, sf: str) -> DataFrame:
    """Entries and greatest sequence of written tables, from their last bytes alone."""
    binary.register(spark)
    folder = staging_path(spark, "tables")
    binary.write_tables(lsm.newest_wins(derive.mutations(spark, sf)).withColumn("value", F.col("value").cast("binary")), folder)
    return spark.read.format("kv_table_footer").load(folder).agg(F.sum("entries").alias("entries"), F.max("max_seq").alias("max_seq"))


def sk3_writer(spark: SparkSession, sf: str) -> DataFrame:
    """Tables written from entries in order, and whether the writer refuses the same in falling order of keys."""
    binary.register(spark)
    folder = staging_path(spark, "tables")
    rows = lsm.newest_wins(derive.mutations(spark, sf)).withColumn("value", F.col("value").cast("binary"))
    binary.write_tables(rows, folder)
    try:
        binary.write_tables(rows.repartition(1).sortWithinPartitions(F.desc("key")), f"{folder}-refused", presorted=True)
        refused = False
    except PySparkException as e:
        refused = "keys must increase" in str(e)
    footers = spark.read.format("kv_table_footer").load(folder)
    return footers.agg(F.sum("entries").alias("entries"), F.max("max_seq").alias("max_seq")).withColumn("refused", F.lit(refused and not listed(f"{folder}-refused", "*.sst")))


def sc8_wal(spark: SparkSession, sf: str) -> DataFrame:
    """The unflushed run as a log, written and replayed."""
    binary.register(spark)
    folder = staging_path(spark, "wal")
    binary.write_wal(derive.mutations(spark, sf).where("run_id = 4").withColumn("value", F.col("value").cast("binary")), folder, "seq")
    return spark.read.format("kv_wal").load(folder).select("op", "key", _text("value"))


def sc8_wal_status(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of all mutations beside one whose last frame was cut off after 11 bytes: logs torn, and bytes lost."""
    binary.register(spark)
    folder = staging_path(spark, "wal")
    binary.write_wal(derive.mutations(spark, sf).withColumn("value", F.col("value").cast("binary")), folder, "seq")
    whole = [codecs.frame(codecs.encode_change(k, b"v")) for k in ("a", "b")]
    torn = Whole(f"{folder}/torn.wal", "aside")
    torn.write(whole[0] + whole[1][:11])
    torn.commit()
    return spark.read.format("kv_wal_status").load(folder).agg(F.count_if(F.col("truncated_at").isNotNull()).alias("torn"), F.sum(F.col("bytes") - F.col("valid_bytes")).alias("lost_bytes"))


def sc9_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A range of keys out of binary tables."""
    folder = staging_path(spark, "tables")
    binary.write_tables(lsm.newest_wins(derive.mutations(spark, sf)).withColumn("value", F.col("value").cast("binary")), folder)
    return binary.read_tables(spark, folder, "user0000000020", "user0000000090").select("key", _text("value"), "seq")


def sc14_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A node's log file, written, read back and replayed."""
    binary.register(spark)
    folder = staging_path(spark, "raft")
    binary.write_records(log_queries.wal_records(spark, sf).withColumn("command", F.col("command").cast("binary")), folder)
    return replog.replay(spark.read.format("kv_raft_log").load(folder)).select("idx", "term", _text("command"))


def vc12_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Sibling sets encoded to bytes and decoded again."""
    sets = siblings.as_sets(siblings.merge_siblings(derive.replica_values(spark, sf).select("key", "value", "version", "clock", "tombstone")))

    @F.pandas_udf(T.BinaryType())
    def encode(s: pd.Series) -> pd.Series:
        return pd.Series([codecs.encode_siblings([{"value": x["value"].encode(), "version": x["version"], "tombstone": x["tombstone"], "clock": {e["key"]: e["value"] for e in x["clock"]}} for x in row]) for row in s])

    @F.pandas_udf("array<struct<value:string,clock:string,tombstone:boolean>>")
    def decode(s: pd.Series) -> pd.Series:
        return pd.Series([[{"value": x["value"].decode(), "clock": ",".join(f"{n}={c}" for n, c in sorted(x["clock"].items())), "tombstone": x["tombstone"]} for x in codecs.decode_siblings(bytes(b))] for b in s])

    return sets.select("key", F.explode(decode(encode("siblings"))).alias("s")).select("key", "s.value", "s.clock", "s.tombstone")


def hr7_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of commands; as many as there are different commands."""
    log = derive.raft_log(spark, sf)

    @F.pandas_udf(T.BinaryType())
    def encode(op: pd.Series, client: pd.Series, seq: pd.Series, key: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([codecs.encode_command(o, c, int(s), k, None if v is None or v != v else v.encode()) for o, c, s, k, v in zip(op, client, seq, key, value)])

    f = log.select(fingerprint_column(encode("op", "client", "seq", "key", "value")).alias("f"))
    return f.agg(F.count_distinct("f").alias("fingerprints"))


def _stream(df: DataFrame, name: str, files: int = 1) -> DataFrame:
    """``df`` as a stream of the files it is written to, one a micro-batch."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _collected(stream: DataFrame, name: str) -> DataFrame:
    """The stream run to the end of its input into files, read back."""
    spark = stream.sparkSession
    out = staging_path(spark, name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", staging_path(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def st1_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Operation metrics of a stream, after its last update."""
    out = forms.streaming_metrics(_stream(log_queries._ops(spark, sf), "ops", 4), "node")
    path = staging_path(spark, "metrics")
    q = out.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", staging_path(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def st2_change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The change feed appended batch by batch, then read."""
    log = EqualityDeleteTable(spark, staging_path(spark, "feed"), "key", "version", "tombstone")
    feed = table(spark, sf, "change_feed").select("key", "version", "tombstone", "arrived_at").repartitionByRange(4, "arrived_at")
    forms.append_changes(_stream(feed, "arrivals", 2), log, staging_path(spark, "progress")).awaitTermination()
    return log.read().select("key", "version")


def st3_at_most_once(spark: SparkSession, sf: str) -> DataFrame:
    """At-most-once apply as a stream, in log order."""
    log = derive.raft_log(spark, sf).repartitionByRange(1, "idx")
    return _collected(forms.apply_at_most_once(_stream(log, "log")), "outcomes").select("idx", "client", "seq", "outcome")


def st4_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional requests as a stream: the final state."""
    from keyloom.operators import occ

    return occ.current(_collected(forms.apply_requests(_stream(log_queries.occ_requests(spark, sf).coalesce(1), "requests")), "results"))


def st5_siblings(spark: SparkSession, sf: str) -> DataFrame:
    """Replica values merged batch by batch."""
    store = forms.SiblingStore(spark, staging_path(spark, "siblings"))
    rows = derive.replica_values(spark, sf).select("key", "value", "version", "clock", "tombstone").repartition(4)
    store.start(_stream(rows, "arrivals", 2), staging_path(spark, "progress")).awaitTermination()
    return store.read().select("key", "value", clocks.canonical(F.col("clock")).alias("clock"), "tombstone")


QUERIES = {f.__name__: f for f in (sc6_footer, sk3_writer, sc8_wal, sc8_wal_status, sc9_tables, sc14_replay, vc12_codec, hr7_fingerprint, st1_metrics, st2_change_feed, st3_at_most_once, st4_requests, st5_siblings)}

ORACLES = {
    "sc6_footer": with_views("mutations", body="SELECT count(DISTINCT key) AS entries, max(seq) AS max_seq FROM mutations"),
    "sc8_wal": with_views("mutations", body="SELECT CASE WHEN value IS NULL THEN 'DELETE' ELSE 'PUT' END AS op, key, value FROM mutations WHERE run_id = 4"),
    "sc8_wal_status": "SELECT 1 AS torn, 11 AS lost_bytes",
    "sk3_writer": with_views("mutations", body="SELECT count(DISTINCT key) AS entries, max(seq) AS max_seq, true AS refused FROM mutations"),
    "sc9_tables": with_views("mutations", body=f"SELECT * FROM ({store_queries._NEWEST.format(t='mutations')}) WHERE key >= 'user0000000020' AND key < 'user0000000090'"),
    "sc14_replay": log_queries.ORACLES["rl5_replay"],
    "vc12_codec": replica_queries.ORACLES["vc4_siblings"],
    "hr7_fingerprint": with_views("raft_log", body="SELECT count(DISTINCT (client, seq, op, key, value)) AS fingerprints FROM raft_log"),
    "st1_metrics": log_queries.ORACLES["mx1_operations"],
    "st2_change_feed": DATA["p1_found"],
    "st3_at_most_once": log_queries.ORACLES["rl1_at_most_once"],
    "st4_requests": log_queries.ORACLES["oc4_current"],
    "st5_siblings": replica_queries.ORACLES["vc4_siblings"],
}
