"""Queries over the log-structured store: scans, merges, compaction plans, placement, Bloom filters, amplification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.hashing import hash64_column
from keyloom.operators import bloom, compaction, lsm, metrics, ring, workload
from keyloom.plans import derive
from keyloom.plans.derive import with_views
from keyloom.session import staging_path, table

NODES = [f"node-{i}" for i in range(10)]


def mg1_newest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.newest_wins(derive.mutations(spark, sf))


def mg1_live(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.newest_wins(derive.mutations(spark, sf), drop_tombstones=True)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of the store, flushed and read from their files."""
    return lsm.flush_runs(derive.mutations(spark, sf), staging_path(spark, "runs"))


def sc1_point_get(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.point_get(_runs(spark, sf), "user0000000007")


def sc2_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.range_scan(_runs(spark, sf), "user0000000020", "user0000000090")


def sc3_run_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.run_lookup(_runs(spark, sf), 2, "user0000000007")


def sc4_run_scan(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.run_scan(_runs(spark, sf).where("run_id = 1"), "user0000000020", "user0000000040").select("key", "value", "seq")


def sc5_run_iterator(spark: SparkSession, sf: str) -> DataFrame:
    """A flushed run read back whole, tombstones included."""
    path = staging_path(spark, "run")
    return lsm.flush(derive.mutations(spark, sf).where("run_id = 3"), path).select("key", "value", "seq")


def sc10_limited_scan(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.range_scan(derive.mutations(spark, sf), "user0000000010", None, 25)


def sk1_assign_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.assign_sequence(table(spark, sf, "events").select("event_id", "user_id"), "event_id", 100).select("event_id", "seq")


def sk2_flush(spark: SparkSession, sf: str) -> DataFrame:
    """A flush of everything but the unflushed run, merged and written as sorted files."""
    out = lsm.flush(derive.mutations(spark, sf).where("run_id <> 4"), staging_path(spark, "flush"))
    return out.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("value").isNull()).alias("tombstones"), F.max("seq").alias("max_seq"))


def sk6_replace_put(spark: SparkSession, sf: str) -> DataFrame:
    return lsm.replace_put(derive.mutations(spark, sf))


def mg2_recover(spark: SparkSession, sf: str) -> DataFrame:
    m = derive.mutations(spark, sf)
    wal = m.where("run_id = 4").select((F.col("seq") - 1).alias("offset"), "key", "value")
    return lsm.newest_wins(lsm.recover(m.where("run_id <> 4"), wal))


def mg3_compact(spark: SparkSession, sf: str) -> DataFrame:
    out = lsm.compact(derive.mutations(spark, sf), 2048, True)
    return out.groupBy("out_run").agg(F.count(F.lit(1)).alias("entries"), F.min("key").alias("first"), F.max("key").alias("last"))


def mg4_swap_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = derive.runs(spark, sf)
    old = compaction.plan_size_tiered(r, 4)
    added = r.join(old, "run_id", "left_semi").agg(F.lit(1000).alias("run_id"), F.lit(0).alias("level"), F.sum("size").alias("size"), F.min("first").alias("first"), F.max("last").alias("last"))
    return lsm.swap_runs(r.select("run_id", "level", "size", "first", "last"), old, added)


def mg5_size_tiered(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.plan_size_tiered(derive.runs(spark, sf), 4)


def mg6_leveled_l0(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.plan_leveled_l0(derive.runs(spark, sf), 4)


def mg7_leveled_budget(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.plan_leveled_budget(derive.runs(spark, sf), 4096, 10)


def mg8_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Which runs meet a given key range."""
    r = derive.runs(spark, sf)
    return r.select("run_id", compaction.overlaps(F.col("first"), F.col("last"), F.lit("user0000000000"), F.lit("user0000000000")).alias("meets"))


def hr1_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_name", hash64_column(F.col("c_name")).alias("hash"))


def hr2_ring(spark: SparkSession, sf: str) -> DataFrame:
    return ring.build_ring(spark.createDataFrame([(n,) for n in NODES], "node string"))


def hr3_remove_node(spark: SparkSession, sf: str) -> DataFrame:
    return ring.remove_node(hr2_ring(spark, sf), "node-3")


def hr4_preference(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "customer").select(F.col("c_name").alias("key"))
    return ring.preference_lists(keys, NODES, 3).select("key", F.concat_ws(",", "nodes").alias("nodes"))


def hr5_balance(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "customer").select(F.col("c_name").alias("key"))
    return ring.balance(ring.preference_lists(keys, NODES, 1)).select("node", "keys")


def hr5_movement(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "customer").select(F.col("c_name").alias("key"))
    return ring.movement(keys, NODES, [*NODES, "node-10"])


def hr6_membership(spark: SparkSession, sf: str) -> DataFrame:
    return ring.membership(spark, "kv", 5, 3)


def bf1_sizing(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.range(1, 6).select(F.expr("cast(power(10, id) as bigint)").alias("n"), F.explode(F.array(F.lit(0.1), F.lit(0.01), F.lit(0.001))).alias("p"))
    m, k = bloom.sizing_columns(F.col("n"), F.col("p"))
    return t.select("n", "p", m.cast("bigint").alias("bits"), k.cast("bigint").alias("hashes"))


def _supplier_filter(spark: SparkSession, sf: str) -> tuple[DataFrame, int, int]:
    names = table(spark, sf, "supplier").select("s_name").where("s_name IS NOT NULL")
    m, k = bloom.sizing(max(1, names.count()), 0.01)
    return bloom.build(names, "s_name", m, k), m, k


def bf2_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Bits and words set by a filter of all suppliers' names, sized by their number."""
    return _supplier_filter(spark, sf)[0].agg(F.sum(F.expr("bit_count(bits)")).cast("bigint").alias("bits_set"), F.count(F.lit(1)).alias("words"))


def bf4_serialized(spark: SparkSession, sf: str) -> DataFrame:
    """The same filter as bytes and read back: its header, its size, and the bits that came through."""
    words, m, k = _supplier_filter(spark, sf)
    return bloom.serialized(words, m, k).select(bloom.parsed("data").alias("f"), F.octet_length("data").alias("bytes")).select("f.bits", "f.hashes", "f.words", "f.bits_set", "bytes")


def bf3_probe(spark: SparkSession, sf: str) -> DataFrame:
    """A filter of all customers' names, sized by their number: members found and lost, and false positives among the suppliers."""
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name")).where("name IS NOT NULL")
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name")).where("name IS NOT NULL").join(c, "name", "left_anti")
    m, k = bloom.sizing(max(1, c.count()), 0.01)
    hit = bloom.probe(c.withColumn("member", F.lit(True)).unionByName(s.withColumn("member", F.lit(False))), "name", bloom.build(c, "name", m, k), m, k)
    member, said = F.col("member"), F.col("might_contain")
    return hit.agg(F.count_if(member & said).alias("found"), F.count_if(member & ~said).alias("lost"), F.count_if(~member & said).alias("false_positives"), F.count_if(~member).alias("non_members"))


def am1_amplification(spark: SparkSession, sf: str) -> DataFrame:
    m = derive.mutations(spark, sf)
    b = workload.bytes_written(m)
    disk = derive.runs(spark, sf).select(F.sum("size").alias("s")).scalar()
    return b.select(disk.alias("sstable_bytes"), "user_bytes", "logical_bytes").select("*", metrics.ratio("sstable_bytes", "user_bytes").alias("write_amp"), metrics.ratio("sstable_bytes", "logical_bytes").alias("space_amp"))


def am2_read_amplification(spark: SparkSession, sf: str) -> DataFrame:
    return workload.read_amplification(lsm.newest_wins(derive.mutations(spark, sf), drop_tombstones=True), derive.runs(spark, sf), 1000)


def am3_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return workload.bytes_written(derive.mutations(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (mg1_newest_wins, mg1_live, sc1_point_get, sc2_range_scan, sc3_run_lookup, sc4_run_scan, sc5_run_iterator, sc10_limited_scan, sk1_assign_sequence, sk2_flush, sk6_replace_put, mg2_recover, mg3_compact,
              mg4_swap_runs, mg5_size_tiered, mg6_leveled_l0, mg7_leveled_budget, mg8_overlap, hr1_hash, hr2_ring, hr3_remove_node, hr4_preference, hr5_balance, hr5_movement, hr6_membership, bf1_sizing, bf2_bits, bf3_probe, bf4_serialized,
              am1_amplification, am2_read_amplification, am3_bytes)
}

_NEWEST = "SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {t}) WHERE rn = 1"
_TIER = """tiered AS (SELECT *, length(bin(greatest(1, size))) AS tier FROM runs),
tiers AS (SELECT tier, count(*) AS n, min(run_id) AS at_ FROM tiered GROUP BY tier),
chosen AS (SELECT tier, n = (SELECT count(*) FROM runs) AS drop_tombstones FROM tiers WHERE n >= 4 ORDER BY at_ LIMIT 1),
plan AS (SELECT run_id, 0 AS output_level, drop_tombstones FROM tiered JOIN chosen USING (tier))"""

# hashes in 128-bit integers, cut to 64 bits after each step
_M64 = "18446744073709551616::UHUGEINT"


def _hash_sql(text: str) -> str:
    """64-bit hash of a text in SQL: FNV-1a over bytes, then the finalizer, as a signed number."""
    codes = f"list_transform(range(1, strlen({text}) + 1), lambda i: ord(substr({text}, i, 1))::UBIGINT)"
    fnv = f"list_reduce(list_prepend(14695981039346656037::UBIGINT, {codes}), lambda h, c: ((xor(h, c)::UHUGEINT * 1099511628211::UHUGEINT) % {_M64})::UBIGINT)"
    shift = lambda h: f"xor({h}, {h} >> 33)"
    mul = lambda h, m: f"((({h})::UHUGEINT * {m}::UHUGEINT) % {_M64})::UBIGINT"
    return fnv, shift, mul


_FNV, _SHIFT, _MUL = _hash_sql("t")
_HASHED = f"""f0 AS (SELECT t, {_FNV} AS h FROM texts),
f1 AS (SELECT t, {_MUL(_SHIFT('h'), '18397679294719823053')} AS h FROM f0),
f2 AS (SELECT t, {_MUL(_SHIFT('h'), '14181476777654086739')} AS h FROM f1),
f3 AS (SELECT t, {_SHIFT('h')} AS h FROM f2),
hashed AS (SELECT t, CASE WHEN h >= 9223372036854775808::UBIGINT THEN (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS hash FROM f3)"""
# positions of the double hashing for a filter sized by a table's rows
_BITS = _HASHED + """,
sized AS (SELECT *, greatest(1, floor(m / n * ln(2) + 0.5))::BIGINT AS k FROM (SELECT n, ceil(-n * ln(0.01) / power(ln(2), 2))::BIGINT AS m FROM (SELECT greatest(1, count(*)) AS n FROM {table}))),
halves AS (SELECT t, (hash - (hash & 4294967295)) // 4294967296 AS h1, CASE WHEN hash & 4294967295 >= 2147483648 THEN (hash & 4294967295) - 4294967296 WHEN hash & 4294967295 = 0 THEN 1 ELSE hash & 4294967295 END AS h2 FROM hashed),
p AS (SELECT t, m, k, ((h1 + i * h2) & 9223372036854775807) % m AS pos FROM halves, sized, range(64) r(i) WHERE i < k)"""
_RING = "texts AS (SELECT 'node-' || n || '#' || v AS t FROM range({n}) a(n), range(150) b(v)),\n" + _HASHED + ",\nring AS (SELECT hash AS pos, split_part(t, '#', 1) AS node FROM hashed)"


def _placed(nodes: int, name: str) -> str:
    """Keys' nodes in clockwise order, by the least (wrapped, position) per node."""
    return f"""r{name} AS (SELECT pos, node FROM ring WHERE CAST(substr(node, 6) AS INTEGER) < {nodes}),
d{name} AS (SELECT k.t AS key, node, min(CASE WHEN pos >= k.hash THEN pos::HUGEINT ELSE pos::HUGEINT + 18446744073709551616::HUGEINT END) AS d FROM keys k, r{name} GROUP BY k.t, node),
p{name} AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY d) AS rk FROM d{name})"""


_KEYS = "texts AS (SELECT c_name AS t FROM customer UNION ALL SELECT 'node-' || n || '#' || v FROM range(11) a(n), range(150) b(v)),\n" + _HASHED + """,
keys AS (SELECT * FROM hashed WHERE t NOT LIKE 'node-%'), ring AS (SELECT hash AS pos, split_part(t, '#', 1) AS node FROM hashed WHERE t LIKE 'node-%')"""

ORACLES = {
    "mg1_newest_wins": with_views("mutations", body=_NEWEST.format(t="mutations")),
    "mg1_live": with_views("mutations", body=f"SELECT * FROM ({_NEWEST.format(t='mutations')}) WHERE value IS NOT NULL"),
    "sc1_point_get": with_views("mutations", body=f"SELECT * FROM ({_NEWEST.format(t='mutations')}) WHERE value IS NOT NULL AND key = 'user0000000007'"),
    "sc2_range_scan": with_views("mutations", body=f"SELECT * FROM ({_NEWEST.format(t='mutations')}) WHERE value IS NOT NULL AND key >= 'user0000000020' AND key < 'user0000000090'"),
    "sc3_run_lookup": with_views("mutations", body=_NEWEST.format(t="(SELECT * FROM mutations WHERE run_id = 2 AND key = 'user0000000007')")),
    "sc4_run_scan": with_views("mutations", body=_NEWEST.format(t="(SELECT * FROM mutations WHERE run_id = 1 AND key >= 'user0000000020' AND key < 'user0000000040')")),
    "sc5_run_iterator": with_views("mutations", body=_NEWEST.format(t="(SELECT * FROM mutations WHERE run_id = 3)")),
    "sc10_limited_scan": with_views("mutations", body=f"SELECT * FROM ({_NEWEST.format(t='mutations')}) WHERE value IS NOT NULL AND key >= 'user0000000010' ORDER BY key LIMIT 25"),
    "sk1_assign_sequence": "SELECT event_id, 100 + row_number() OVER (ORDER BY event_id) AS seq FROM events",
    "sk2_flush": with_views("mutations", body=f"SELECT count(*) AS entries, count(*) FILTER (value IS NULL) AS tombstones, max(seq) AS max_seq FROM ({_NEWEST.format(t='(SELECT * FROM mutations WHERE run_id <> 4)')})"),
    "sk6_replace_put": with_views("mutations", body="SELECT key, max(struct_pack(s := seq, v := value)).v AS value, count(*) AS version FROM mutations GROUP BY key"),
    "mg2_recover": with_views("mutations", body=f"""SELECT * FROM ({_NEWEST.format(t='''(SELECT key, value, seq FROM mutations WHERE run_id <> 4
      UNION ALL SELECT key, value, (SELECT max(seq) FROM mutations WHERE run_id <> 4) + row_number() OVER (ORDER BY seq) FROM mutations WHERE run_id = 4)''')})"""),
    "mg3_compact": with_views("mutations", body=f"""SELECT out_run, count(*) AS entries, min(key) AS first, max(key) AS last FROM (
      SELECT key, coalesce(sum(b) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2048 AS out_run
      FROM (SELECT key, 16 + strlen(key) + strlen(value) AS b FROM ({_NEWEST.format(t='mutations')}) WHERE value IS NOT NULL)) GROUP BY out_run"""),
    "mg4_swap_runs": with_views("mutations", "runs", body=f""", {_TIER}
      SELECT run_id, level, size, first, last FROM runs WHERE run_id NOT IN (SELECT run_id FROM plan)
      UNION ALL SELECT 1000, 0, sum(size), min(first), max(last) FROM runs WHERE run_id IN (SELECT run_id FROM plan)"""),
    "mg5_size_tiered": with_views("mutations", "runs", body=f",{_TIER} SELECT * FROM plan"),
    "mg6_leveled_l0": with_views("mutations", "runs", body="""SELECT run_id, 1 AS output_level, (SELECT max(level) FROM runs) <= 1 AS drop_tombstones FROM runs a
      WHERE (SELECT count(*) FROM runs WHERE level = 0) >= 4 AND (level = 0 OR (level = 1 AND EXISTS (SELECT 1 FROM runs b WHERE b.level = 0 AND a.first <= b.last AND b.first <= a.last)))"""),
    "mg7_leveled_budget": with_views("mutations", "runs", body=""", o AS (SELECT level AS n FROM runs WHERE level >= 1 GROUP BY level HAVING sum(size) > 4096 * power(10, level - 1) ORDER BY level LIMIT 1),
      c AS (SELECT * FROM runs WHERE level = (SELECT n FROM o) ORDER BY first, run_id LIMIT 1),
      i AS (SELECT run_id FROM c UNION ALL SELECT a.run_id FROM runs a, c WHERE a.level = c.level + 1 AND a.first <= c.last AND c.first <= a.last)
      SELECT run_id, (SELECT n FROM o) + 1 AS output_level, (SELECT max(level) FROM runs) <= (SELECT n FROM o) + 1 AS drop_tombstones FROM i"""),
    "mg8_overlap": with_views("mutations", "runs", body="SELECT run_id, first <= 'user0000000000' AND 'user0000000000' <= last AS meets FROM runs"),
    "hr1_hash": "WITH texts AS (SELECT c_name AS t FROM customer),\n" + _HASHED + " SELECT t AS c_name, hash FROM hashed",
    "hr2_ring": "WITH " + _RING.format(n=10) + " SELECT pos, node FROM ring",
    "hr3_remove_node": "WITH " + _RING.format(n=10) + " SELECT pos, node FROM ring WHERE node <> 'node-3'",
    "hr4_preference": f"WITH {_KEYS}, {_placed(10, 'a')} SELECT key, string_agg(node, ',' ORDER BY rk) AS nodes FROM pa WHERE rk <= 3 GROUP BY key",
    "hr5_balance": f"WITH {_KEYS}, {_placed(10, 'a')} SELECT node, count(*) AS keys FROM pa WHERE rk = 1 GROUP BY node",
    "hr5_movement": f"WITH {_KEYS}, {_placed(10, 'a')}, {_placed(11, 'b')} SELECT pa.node AS old_owner, pb.node AS new_owner, count(*) AS keys FROM pa JOIN pb ON pa.key = pb.key AND pa.rk = 1 AND pb.rk = 1 GROUP BY 1, 2",
    "hr6_membership": "SELECT 'kv-node-' || i AS node, i AS node_index, 3 AS replication_factor FROM range(5) t(i)",
    "bf1_sizing": """SELECT n, p, m AS bits, greatest(1, floor(m / n * ln(2) + 0.5))::BIGINT AS hashes FROM (
      SELECT n, p, ceil(-n * ln(p) / power(ln(2), 2))::BIGINT AS m FROM (SELECT CAST(power(10, i) AS BIGINT) AS n FROM range(1, 6) t(i)), (SELECT unnest([0.1::DOUBLE, 0.01::DOUBLE, 0.001::DOUBLE]) AS p))""",
    "bf2_bits": f"WITH texts AS (SELECT DISTINCT s_name AS t FROM supplier WHERE s_name IS NOT NULL),\n{_BITS.format(table='supplier')} SELECT count(DISTINCT pos) AS bits_set, count(DISTINCT pos // 64) AS words FROM p",
    "bf3_probe": f"""WITH texts AS (SELECT c_name AS t FROM customer WHERE c_name IS NOT NULL UNION SELECT s_name FROM supplier WHERE s_name IS NOT NULL),\n{_BITS.format(table='customer')},
      held AS (SELECT DISTINCT pos FROM p WHERE t IN (SELECT c_name FROM customer)), said AS (SELECT t, count(held.pos) = count(*) AS hit FROM p LEFT JOIN held USING (pos) GROUP BY t)
      SELECT (SELECT count(*) FROM customer JOIN said ON c_name = t WHERE hit) AS found, (SELECT count(*) FROM customer JOIN said ON c_name = t WHERE NOT hit) AS lost,
        (SELECT count(*) FROM supplier JOIN said ON s_name = t WHERE hit AND s_name NOT IN (SELECT c_name FROM customer)) AS false_positives,
        (SELECT count(*) FROM supplier WHERE s_name NOT IN (SELECT c_name FROM customer)) AS non_members""",
    "bf4_serialized": f"WITH texts AS (SELECT DISTINCT s_name AS t FROM supplier WHERE s_name IS NOT NULL),\n{_BITS.format(table='supplier')} SELECT any_value(m) AS bits, any_value(k) AS hashes, any_value((m + 63) // 64) AS words, count(DISTINCT pos) AS bits_set, any_value(12 + 8 * ((m + 63) // 64)) AS bytes FROM p",
    "am1_amplification": with_views("mutations", "runs", body=f"""SELECT sstable_bytes, user_bytes, logical_bytes, sstable_bytes / user_bytes AS write_amp, sstable_bytes / logical_bytes AS space_amp FROM (
      SELECT (SELECT sum(size) FROM runs) AS sstable_bytes, (SELECT sum(strlen(key) + coalesce(strlen(value), 0)) FROM mutations) AS user_bytes,
             (SELECT sum(strlen(key) + strlen(value)) FROM ({_NEWEST.format(t='mutations')}) WHERE value IS NOT NULL) AS logical_bytes)"""),
    "am2_read_amplification": with_views("mutations", "runs", body=f""", k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS r FROM ({_NEWEST.format(t='mutations')}) WHERE value IS NOT NULL),
      s AS (SELECT key FROM k WHERE r % greatest(1, (SELECT count(*) FROM k) // 1000) = 0)
      SELECT avg(c) AS read_amp FROM (SELECT (SELECT count(*) FROM runs WHERE first <= s.key AND s.key <= last) AS c FROM s)"""),
    "am3_bytes": with_views("mutations", body=f"""SELECT (SELECT sum(strlen(key) + coalesce(strlen(value), 0)) FROM mutations) AS user_bytes,
      (SELECT sum(strlen(key) + strlen(value)) FROM ({_NEWEST.format(t='mutations')}) WHERE value IS NOT NULL) AS logical_bytes"""),
}
