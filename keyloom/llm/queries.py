"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm import fusion, langid, mixing, packing, seen
from keyloom.llm.tokens import n_tokens
from keyloom.session import table


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse_groups(table(spark, sf_dir, "sibling_values"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_records(spark, sf_dir).select("key", "sibling_id")


def p3_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fusion learnt: each source's accuracy, and the source it most likely copies from or is copied by."""
    return fusion.source_report(spark, fusion.fuse(table(spark, sf_dir, "sibling_values")).sources)


def _seen(spark: SparkSession, sf_dir: str) -> seen.Seen:
    return seen.seen_before(table(spark, sf_dir, "put_requests"), table(spark, sf_dir, "archived_keys"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).rows


def p5_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).errors()


def p5_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the report doesn't depend on hashes: requests and new keys per block, and whether the filter erred on fewer than 2 % of these."""
    return _seen(spark, sf_dir).errors().select("block", "requests", "new_keys", (F.col("filter_error_rate") < 0.02).alias("below_2_percent"))


def _containers(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r.container_kind: r.capacity_tokens for r in table(spark, sf_dir, "containers").collect()}


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.staged_sizes(table(spark, sf_dir, "documents"), n_tokens("text"))


def _packed(spark: SparkSession, sf_dir: str, tiered: bool) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), _containers(spark, sf_dir), tiered=tiered)


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notebooks in containers of each capacity, each packed in tiers of context sizes."""
    return _packed(spark, sf_dir, tiered=False)


def p6_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether that packing keeps its promises: whole documents, none split that fits, nothing overfull or overlapping."""
    sizes, kinds = _sizes(spark, sf_dir), _containers(spark, sf_dir)
    return packing.audit(packing.pack(sizes, kinds, tiered=False), sizes, kinds)


def p6_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notebook once, in a container of its own tier or in a gap of a longer one."""
    return _packed(spark, sf_dir, tiered=True)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, sf_dir), _containers(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_tokens("text").alias("n_tokens"))
    return mixing.mix(docs, table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).rows


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares


def p7_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The apportionment with code points for sizes, which SQL can count: what each source has, and its blocks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("n_tokens"))
    return mixing.mix(docs, table(spark, sf_dir, "mix_targets")).shares.select("source", "available_tokens", "quota_blocks")


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mix keeps its promises, per target: notebooks taken of another source, listed twice or too often used, and whether
    its tokens are those of its blocks. As notebooks are taken whole, each shard may be off by half the longest and by a block."""
    docs, m = table(spark, sf_dir, "documents"), _mix(spark, sf_dir)
    taken = m.rows.join(docs.select("doc_id", mixing.canonical_source(F.col("source")).alias("c")), "doc_id").join(m.shares.select("source", "max_repeats"), "source")
    per = taken.groupBy("source", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("copies") > F.col("max_repeats")).alias("over"), F.max(F.col("c") != mixing.canonical_source(F.col("source"))).alias("foreign"), F.max("n_tokens").alias("longest")
    )
    bad = per.groupBy("source").agg(F.count_if(F.col("n") > 1).alias("twice"), F.count_if("over").alias("over_repeated"), F.count_if("foreign").alias("foreign"), F.max("longest").alias("longest"))
    shards = F.ceil(F.sum("available_tokens").over(Window.partitionBy()) / mixing.SHARD_TOKENS)  # a row per target
    off = F.abs(F.col("tokens") - F.col("quota_blocks") * mixing.BLOCK_TOKENS)
    kept = off <= F.col("shards") * (F.coalesce(F.col("longest") / 2, F.lit(0)) + mixing.BLOCK_TOKENS)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return m.shares.withColumn("shards", shards).join(bad, "source", "left").select("source", *map(zero, ("twice", "over_repeated", "foreign")), kept.alias("quota_kept"))


def _labelled(spark: SparkSession, sf_dir: str, stretches: bool) -> DataFrame:
    return langid.label_languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "languages"), stretches=stretches)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.wrong_or_missing(_labelled(spark, sf_dir, stretches=False)).select("doc_id", "lang")


def p8_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch of prose in one language, with its language and confidence."""
    rows = _labelled(spark, sf_dir, stretches=True).select("doc_id", F.posexplode("stretches").alias("stretch", "s"))
    return rows.select("doc_id", "stretch", "s.char_from", "s.char_to", "s.lang", "s.confidence")


def p8_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each notebook's language, how sure it is, and what its label said."""
    top = F.get("langs", F.lit(0))  # null for a notebook without prose
    return _labelled(spark, sf_dir, stretches=False).select("doc_id", "label", "label_code", top["lang"].alias("lang"), top["share"].alias("share"), top["confidence"].alias("confidence"))


QUERIES = {f.__name__: f for f in (p3_found, p3_records, p3_sources, p5_found, p5_errors, p5_accuracy, p6_pack, p6_audit, p6_tiers, p6_fill, p7_mix, p7_shares, p7_quotas, p7_audit, p8_found, p8_stretches, p8_labels)}

_PLACEHOLDERS = ", ".join(f"'{p}'" for p in sorted(fusion.PLACEHOLDERS))

ORACLES = {
    "p3_found": f"""
WITH t AS (SELECT *, try(decode(value)) AS txt,
             coalesce(map_from_entries(list_filter(map_entries(vector_clock), lambda e: e.value <> 0)), MAP {{}}) AS clk
           FROM sibling_values),
     s AS (SELECT *, CASE WHEN json_valid(txt) AND json_type(txt) = 'OBJECT' THEN
             len(list_filter(json_keys(txt), lambda f: json_type(txt, '$.' || f) <> 'NULL'
               AND lower(trim(json_extract_string(txt, '$.' || f))) NOT IN ({_PLACEHOLDERS}))) ELSE 0 END AS filled
           FROM t),
     alive AS (SELECT key, sibling_id, filled FROM s a
       WHERE tombstone IS DISTINCT FROM true
         AND (SELECT count(*) FROM sibling_values c WHERE c.key = a.key) >= 2
         AND NOT EXISTS (SELECT 1 FROM s b WHERE b.key = a.key
           AND list_bool_and(list_transform(map_keys(a.clk), lambda k: a.clk[k] <= coalesce(b.clk[k], 0))) IS DISTINCT FROM false
           AND list_bool_and(list_transform(map_keys(b.clk), lambda k: coalesce(a.clk[k], 0) <= b.clk[k])) IS DISTINCT FROM false
           AND list_bool_or(list_transform(map_keys(b.clk), lambda k: coalesce(a.clk[k], 0) < b.clk[k])))),
     r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY filled DESC, sibling_id) AS rn FROM alive)
SELECT key, sibling_id FROM r WHERE rn = 1
""",
    "p5_accuracy": """
WITH ids AS (SELECT min(request_id) AS lo, max(request_id) AS hi FROM put_requests WHERE key IS NOT NULL),
     firsts AS (SELECT key, min(request_id) AS first_id FROM put_requests WHERE key IS NOT NULL GROUP BY key),
     old AS (SELECT DISTINCT key FROM archived_keys WHERE key IS NOT NULL)
SELECT CAST(floor((p.request_id - lo) * 20.0 / (hi - lo + 1)) AS INTEGER) AS block, count(*) AS requests,
       count(*) FILTER (o.key IS NULL AND p.request_id = f.first_id) AS new_keys, true AS below_2_percent
FROM ids, put_requests p JOIN firsts f ON p.key = f.key LEFT JOIN old o ON p.key = o.key GROUP BY 1
""",
    "p5_found": """
WITH firsts AS (SELECT key, min(request_id) AS first_id FROM put_requests WHERE key IS NOT NULL GROUP BY key),
     old AS (SELECT DISTINCT key FROM archived_keys WHERE key IS NOT NULL)
SELECT p.request_id FROM put_requests p JOIN firsts f ON p.key = f.key LEFT JOIN old o ON p.key = o.key
WHERE o.key IS NOT NULL OR p.request_id > f.first_id
""",
    "p6_audit": """
SELECT container_kind, (SELECT count(*) FROM documents) AS documents, 0 AS incomplete, 0 AS split, 0 AS overfull, 0 AS overlapping FROM containers
""",
    "p7_audit": "SELECT source, 0 AS twice, 0 AS over_repeated, 0 AS foreign, true AS quota_kept FROM mix_targets",
    "p7_quotas": r"""
WITH t AS (SELECT source, regexp_replace(lower(source), '[\s_\-]+', '', 'g') AS c, target_share AS share, max_repeats AS most FROM mix_targets),
     d AS (SELECT regexp_replace(lower(source), '[\s_\-]+', '', 'g') AS c, sum(n_chars) AS n FROM documents WHERE n_chars > 0 GROUP BY 1),
     s AS (SELECT t.*, coalesce(n, 0)::BIGINT AS n FROM t LEFT JOIN d USING (c)),
     u AS (SELECT * FROM s WHERE n * most > 0 AND share > 0),
     b AS (SELECT greatest(1, floor(floor(min(n * most * (SELECT sum(share) FROM u) / share)) / 1024))::BIGINT AS blocks FROM u),
     q AS (SELECT c, row_number() OVER (ORDER BY share / (2 * i + 1) DESC, c) AS seat FROM u, LATERAL (SELECT unnest(range(CAST(ceil(n * most / 1024.0) AS BIGINT))) AS i))
SELECT source, n AS available_tokens, (SELECT count(*) FROM q, b WHERE q.c = s.c AND seat <= blocks) AS quota_blocks FROM s
""",
}
