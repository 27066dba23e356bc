"""Model views derived from the star-schema tables: Spark builders, and the same views as SQL for the oracles.

Integer arithmetic only, so both engines give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.session import table

MEMTABLE_RUN = 4
REPLICAS = 5


def user_key(user: Column) -> Column:
    return F.concat(F.lit("user"), F.lpad(user.cast("string"), 10, "0"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-structured entries: (key, value null = tombstone, seq, run_id)."""
    return table(spark, sf_dir, "events").select(
        user_key(F.col("user_id")).alias("key"),
        F.when(F.col("event_type") != "error", F.concat_ws(":", "event_type", "event_id")).alias("value"),
        (F.col("event_id") + 1).alias("seq"),
        (F.col("event_id") % 5).cast("int").alias("run_id"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metadata: (run_id, level, size, first, last), 40 sorted runs."""
    m = mutations(spark, sf_dir).withColumn("run_id", ((F.col("seq") - 1) % 40).cast("int"))
    return m.groupBy("run_id").agg(
        F.sum(16 + F.length("key") + F.coalesce(F.length("value"), F.lit(0))).alias("size"), F.min("key").alias("first"), F.max("key").alias("last")
    ).withColumn("level", F.col("run_id") % 3)


def replica_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions held by replicas: (row_id, key, node, value, version, clock, tombstone)."""
    o = F.col("o_orderkey")
    counters = [("a", o % 3), ("b", F.expr("o_orderkey div 3 % 3")), ("c", F.expr("o_orderkey div 9 % 3"))]
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), c.cast("bigint").alias("value")) for n, c in counters]), lambda e: e["value"] > 0)
    return table(spark, sf_dir, "orders").select(
        o.alias("row_id"), F.concat(F.lit("cust"), "o_custkey").alias("key"), F.concat(F.lit("n"), o % REPLICAS).alias("node"),
        F.concat_ws(":", "o_orderstatus", (o % 4).cast("string")).alias("value"), (o % 3 + F.expr("o_orderkey div 3 % 3") + F.expr("o_orderkey div 9 % 3")).alias("version"),
        F.map_from_entries(entries).alias("clock"), F.col("o_orderpriority").startswith("5").alias("tombstone"),
    )


def op_history(spark: SparkSession, sf_dir: str, key: Column | None = None) -> DataFrame:
    """Client operations: (idx, key, type, value, start_ms, end_ms, result, coordinator)."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"), (F.concat(F.lit("u"), "user_id") if key is None else key).alias("key"),
        F.when(F.col("event_type").isin("view", "click"), "READ").otherwise("WRITE").alias("type"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))").alias("start_ms"),
    )
    w = Window.partitionBy("key").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    written = F.when(F.col("type") == "WRITE", F.concat(F.lit("v"), "idx"))
    past = F.filter(F.collect_list(written).over(w.rowsBetween(-12, -1)), lambda x: x.isNotNull())
    nth = F.expr("try_element_at(past, -1 - cast(idx % 3 as int))")
    result = F.when(F.col("idx") % 10 == 0, "FAILURE").when(F.col("idx") % 10 == 1, "UNKNOWN").otherwise("SUCCESS")
    return e.withColumn("past", past).select(
        "idx", "key", "type", F.when(F.col("type") == "WRITE", F.concat(F.lit("v"), "idx")).otherwise(nth).alias("value"),
        "start_ms", (F.col("start_ms") + F.col("idx") % 7 * 3 * 3_600_000).alias("end_ms"), result.alias("result"), (F.col("idx") % 3).cast("int").alias("coordinator"),
    )


def raft_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed commands in log order: (idx, client, seq, op, key, value)."""
    e = table(spark, sf_dir, "events")
    client = F.col("user_id") % 50
    rn = F.row_number().over(Window.partitionBy(client).orderBy("event_id"))
    return e.select(
        (F.col("event_id") + 1).alias("idx"), F.concat(F.lit("c"), client).alias("client"),
        F.greatest(F.lit(1), rn - F.when(F.col("event_id") % 4 == 0, 1).otherwise(0)).cast("bigint").alias("seq"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"), F.concat(F.lit("k"), F.col("event_id") % 97).alias("key"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("v"), F.expr("event_id div 8"))).alias("value"),
    )


def replica_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of replicas to requests: (req, node, is_primary, latency_ms, ok, has_value, version)."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("req"))
    n = F.col("node")
    return e.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(REPLICAS - 1)))).select(
        "req", "node", (n < 3).alias("is_primary"), ((F.col("req") * 31 + n * 17) % 97).alias("latency_ms"), ((F.col("req") + n) % 11 != 0).alias("ok"),
        ((F.col("req") + n) % 5 != 0).alias("has_value"), (F.expr("req div 7") - F.when((F.col("req") + n) % 6 == 0, 1).otherwise(0)).alias("version"),
    )


SQL = {
    "mutations": """mutations AS (
  SELECT 'user' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS key, CASE WHEN event_type <> 'error' THEN event_type || ':' || event_id END AS value,
         event_id + 1 AS seq, event_id % 5 AS run_id FROM events)""",
    "runs": """runs AS (
  SELECT (seq - 1) % 40 AS run_id, sum(16 + length(key) + coalesce(length(value), 0)) AS size, min(key) AS first, max(key) AS last, ((seq - 1) % 40) % 3 AS level
  FROM mutations GROUP BY (seq - 1) % 40)""",
    "replica_values": """replica_values AS (
  SELECT o_orderkey AS row_id, 'cust' || o_custkey AS key, 'n' || (o_orderkey % 5) AS node, o_orderstatus || ':' || (o_orderkey % 4) AS value,
         o_orderkey % 3 AS ca, o_orderkey // 3 % 3 AS cb, o_orderkey // 9 % 3 AS cc, o_orderkey % 3 + o_orderkey // 3 % 3 + o_orderkey // 9 % 3 AS version,
         concat_ws(',', CASE WHEN o_orderkey % 3 > 0 THEN 'a=' || (o_orderkey % 3) END, CASE WHEN o_orderkey // 3 % 3 > 0 THEN 'b=' || (o_orderkey // 3 % 3) END,
                   CASE WHEN o_orderkey // 9 % 3 > 0 THEN 'c=' || (o_orderkey // 9 % 3) END) AS clock,
         starts_with(o_orderpriority, '5') AS tombstone FROM orders)""",
    "op_history": """op_history AS (
  SELECT idx, key, type, CASE WHEN type = 'WRITE' THEN 'v' || idx WHEN len(past) > idx % 3 THEN past[len(past) - idx % 3] END AS value, start_ms,
         start_ms + idx % 7 * 3 * 3600000 AS end_ms, CASE WHEN idx % 10 = 0 THEN 'FAILURE' WHEN idx % 10 = 1 THEN 'UNKNOWN' ELSE 'SUCCESS' END AS result, idx % 3 AS coordinator
  FROM (SELECT *, list_filter(list(CASE WHEN type = 'WRITE' THEN 'v' || idx END) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS past
        FROM (SELECT event_id AS idx, {key} AS key, CASE WHEN event_type IN ('view', 'click') THEN 'READ' ELSE 'WRITE' END AS type, epoch_ms(ts) AS start_ms FROM events)))""",
    "raft_log": """raft_log AS (
  SELECT event_id + 1 AS idx, 'c' || (user_id % 50) AS client,
         greatest(1, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) AS seq,
         CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, 'k' || (event_id % 97) AS key, CASE WHEN event_type <> 'error' THEN 'v' || (event_id // 8) END AS value FROM events)""",
    "replica_acks": """replica_acks AS (
  SELECT event_id AS req, node, node < 3 AS is_primary, (event_id * 31 + node * 17) % 97 AS latency_ms, (event_id + node) % 11 <> 0 AS ok,
         (event_id + node) % 5 <> 0 AS has_value, event_id // 7 - CASE WHEN (event_id + node) % 6 = 0 THEN 1 ELSE 0 END AS version
  FROM events, (SELECT unnest(range(5)) AS node))""",
}
SQL["op_history"] = SQL["op_history"].format(key="'u' || user_id")


def with_views(*names: str, body: str) -> str:
    """A statement over the views; a body that starts with a comma goes on with views of its own."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + body
