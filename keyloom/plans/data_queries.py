"""Queries of the general data problems: change feeds, hot keys, differences between copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import changefeed, copydiff, hotkeys
from keyloom.session import staging_path, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed appended as inserts and equality deletes, then the live keys and versions read."""
    log = changefeed.EqualityDeleteTable(spark, staging_path(spark, "change-feed"), "key", "version", "tombstone")
    log.append(table(spark, sf_dir, "change_feed").select("key", "version", "value", "tombstone"))
    return log.read(["key", "version"])


def p1_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state with values, read straight from the feed."""
    state = changefeed.current_state(table(spark, sf_dir, "change_feed").select("key", "version", "value", "tombstone"))
    return state.select("key", "version", F.hex("value").alias("value_hex"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.hot_keys(table(spark, sf_dir, "put_requests")).select("key")


def p2_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = hotkeys.dense_key_stats(
        table(spark, sf_dir, "put_requests"), "key", client="client_id", sequence="sequence", order="request_id", value="value"
    )
    return stats.select(
        "key", F.col("n").alias("n_puts"), "n_clients", "last_sequence", F.col("latest_order").alias("latest_request_id"), F.hex("latest_value").alias("latest_value_hex")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_cells(spark, sf_dir).select("key", "field")


def p4_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["key", "value", "version", "vector_clock", "tombstone"]
    return copydiff.diff_copies(
        table(spark, sf_dir, "copy_a").select(cols), table(spark, sf_dir, "copy_b").select(cols), copydiff.store_fields()
    )


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_cells(spark, sf_dir).groupBy("field").agg(F.count(F.lit(1)).alias("n_differences"))


QUERIES = {f.__name__: f for f in (p1_found, p1_state, p2_found, p2_key_stats, p4_found, p4_cells, p4_summary)}

_STATE = """
WITH newest AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS rn
  FROM change_feed WHERE key IS NOT NULL AND version IS NOT NULL)
SELECT {cols} FROM newest WHERE rn = 1 AND tombstone IS DISTINCT FROM true
"""

# as the engine writes a sorted list of a clock's entries; keys in the tables need no escapes but quotes and backslashes
_ENTRIES = "'[' || array_to_string(list_transform(list_sort(map_entries({t}.vector_clock)), lambda e: '{{\"key\":' || to_json(e.key) || CASE WHEN e.value IS NULL THEN '' ELSE ',\"value\":' || e.value END || '}}'), ',') || ']'"
_CLOCK = "CAST(to_json(list_sort(list_transform(map_entries({t}.vector_clock), lambda e: e.key || '=' || e.value))) AS VARCHAR)"

_DIFF = """
WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC NULLS LAST) AS rn FROM copy_a) WHERE rn = 1),
     b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC NULLS LAST) AS rn FROM copy_b) WHERE rn = 1),
     j AS (SELECT coalesce(a.key, b.key) AS key, a.rn AS in_a, b.rn AS in_b,
             a.value AS av, b.value AS bv, a.version AS an, b.version AS bn, a.tombstone AS ta, b.tombstone AS tb,
             {ca} AS ac, {cb} AS bc, {ea} AS ae, {eb} AS be
           FROM a FULL JOIN b ON a.key = b.key),
     d AS (
SELECT key, 'only_a' AS field FROM j WHERE in_b IS NULL
UNION ALL SELECT key, 'only_b' FROM j WHERE in_a IS NULL
UNION ALL SELECT key, 'value' FROM j WHERE in_a IS NOT NULL AND in_b IS NOT NULL AND av IS DISTINCT FROM bv
UNION ALL SELECT key, 'version' FROM j WHERE in_a IS NOT NULL AND in_b IS NOT NULL AND an IS DISTINCT FROM bn
UNION ALL SELECT key, 'vector_clock' FROM j WHERE in_a IS NOT NULL AND in_b IS NOT NULL AND ac IS DISTINCT FROM bc
UNION ALL SELECT key, 'tombstone' FROM j WHERE in_a IS NOT NULL AND in_b IS NOT NULL AND ta IS DISTINCT FROM tb)
""".format(ca=_CLOCK.format(t="a"), cb=_CLOCK.format(t="b"), ea=_ENTRIES.format(t="a"), eb=_ENTRIES.format(t="b"))

ORACLES = {
    "p1_found": _STATE.format(cols="key, version"),
    "p1_state": _STATE.format(cols="key, version, hex(value) AS value_hex"),
    "p2_found": "SELECT key FROM put_requests WHERE key IS NOT NULL GROUP BY key HAVING count(*) >= 0.01 * (SELECT count(*) FROM put_requests)",
    "p2_key_stats": """
SELECT key, count(*) AS n_puts, count(DISTINCT client_id) AS n_clients, max(sequence) AS last_sequence,
       max(request_id) AS latest_request_id, hex(max(struct_pack(o := request_id, v := value)).v) AS latest_value_hex
FROM put_requests GROUP BY key
""",
    "p4_found": _DIFF + "SELECT key, field FROM d",
    "p4_cells": _DIFF + """SELECT d.key, d.field,
  CASE d.field WHEN 'value' THEN hex(av) WHEN 'version' THEN CAST(an AS VARCHAR) WHEN 'vector_clock' THEN ae WHEN 'tombstone' THEN CAST(ta AS VARCHAR) END AS a_cell,
  CASE d.field WHEN 'value' THEN hex(bv) WHEN 'version' THEN CAST(bn AS VARCHAR) WHEN 'vector_clock' THEN be WHEN 'tombstone' THEN CAST(tb AS VARCHAR) END AS b_cell FROM d JOIN j ON d.key = j.key""",
    "p4_summary": _DIFF + "SELECT field, count(*) AS n_differences FROM d GROUP BY field",
}
