"""Operation and repair metrics, nearest-rank percentiles, text exposition and its reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.5, 0.95, 0.99)


def operation_metrics(ops: DataFrame, *by: str) -> DataFrame:
    """ops (type, ok, quorum_met, stale, conflict, latency_ms) as counters; latencies below 0 count as 0."""
    read = F.col("type") == "READ"
    return ops.groupBy(*by).agg(
        F.count(F.lit(1)).alias("operations"), F.count_if(read).alias("reads"), F.count_if(~read).alias("writes"), F.count_if(F.col("ok")).alias("success"),
        F.count_if(~F.col("ok")).alias("failure"), F.count_if(~F.col("quorum_met")).alias("quorum_failure"), F.count_if(F.col("ok") & read & F.col("stale")).alias("stale_reads"),
        F.count_if(F.col("ok") & read & F.col("conflict")).alias("conflicts"), F.sum(F.greatest(F.col("latency_ms"), F.lit(0))).cast("bigint").alias("latency_total_ms"),
    )


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value that at least a share p doesn't exceed; 0 of nothing. Exact, and an aggregate like any other."""
    return F.coalesce(F.expr(f"cast(percentile_disc({p}) WITHIN GROUP (ORDER BY {value}) AS bigint)"), F.lit(0).cast("bigint"))


def latency_summary(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """(p50, p95, p99) by nearest rank."""
    return samples.groupBy(*by).agg(*[nearest_rank(value, p).alias(f"p{round(p * 100)}") for p in QUANTILES])


def experiment_report(samples: DataFrame, value: str, *by: str) -> DataFrame:
    return samples.groupBy(*by).agg(F.count(value).alias("n"), F.coalesce(F.min(value), F.lit(0)).alias("min"), nearest_rank(value, 0.5).alias("median"), nearest_rank(value, 0.95).alias("p95"), F.coalesce(F.max(value), F.lit(0)).alias("max"))


def repair_metrics(repairs: DataFrame, *by: str) -> DataFrame:
    """repairs (replicas, latency_ms): counts and the whole-number average, 0 if there were none."""
    g = repairs.groupBy(*by).agg(F.count(F.lit(1)).alias("repairs"), F.coalesce(F.sum("replicas"), F.lit(0)).alias("replicas_repaired"), F.coalesce(F.sum(F.greatest(F.col("latency_ms"), F.lit(0))), F.lit(0)).alias("latency_total_ms"))
    return g.withColumn("average_ms", F.when(F.col("repairs") > 0, F.expr("latency_total_ms div repairs")).otherwise(0).cast("bigint"))


def hedge_total(deltas: DataFrame, value: str, *by: str) -> DataFrame:
    return deltas.groupBy(*by).agg(F.coalesce(F.sum(F.greatest(F.col(value), F.lit(0))), F.lit(0)).cast("bigint").alias("hedged_requests"))


def escape_label(c: Column) -> Column:
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def exposition(metrics: DataFrame, node: str, counters: dict[str, str], gauges: dict[str, str], prefix: str = "keyloom") -> DataFrame:
    """(node, line_no, line): HELP, TYPE and sample lines of each node's metrics row, in the order given; names map to help texts."""
    lines = []
    for kind, named in (("counter", counters), ("gauge", gauges)):
        for name, text in named.items():
            full = f"{prefix}_{name}" + ("_total" if kind == "counter" else "")
            lines += [F.lit(f"# HELP {full} {text}"), F.lit(f"# TYPE {full} {kind}"), F.concat(F.lit(f'{full}{{node="'), escape_label(F.col(node)), F.lit('"} '), F.col(name).cast("string"))]
    return metrics.select(F.col(node).alias("node"), F.posexplode(F.array(*lines)).alias("line_no", "line"))


def quantile_lines(summary: DataFrame, node: str, name: str = "operation_latency_ms", prefix: str = "keyloom") -> DataFrame:
    lines = [F.concat(F.lit(f'{prefix}_{name}{{node="'), escape_label(F.col(node)), F.lit(f'",quantile="{q:g}"}} '), F.col(f"p{round(q * 100)}").cast("string")) for q in QUANTILES]
    return summary.select(F.col(node).alias("node"), F.posexplode(F.array(*lines)).alias("line_no", "line"))


#: The roles a member of a replicated log can hold, in the order they are shown.
ROLES = ("leader", "candidate", "follower")


def member_lines(status: DataFrame, node: str, prefix: str = "keyloom") -> DataFrame:
    """(node, line_no, line) for members (node, role, leader): a gauge of 1 for the role held and 0 for the others, and one that
    names the leader known, 0 for an empty name."""
    n = escape_label(F.col(node))
    line = lambda name, label, of, value: F.concat(F.lit(f'{prefix}_{name}{{node="'), n, F.lit(f'",{label}="'), of, F.lit('"} '), value.cast("int").cast("string"))
    roles = [line("raft_role", "role", F.lit(r), F.lower("role") == r) for r in ROLES]
    return status.select(F.col(node).alias("node"), F.posexplode(F.array(*roles, line("raft_leader", "leader", escape_label(F.col("leader")), F.col("leader") != ""))).alias("line_no", "line"))


def parse_exposition(lines: DataFrame, line: str = "line") -> DataFrame:
    """(metric, labels, value) of each sample line; comments and what is no sample are left out."""
    pattern = r"^([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+([-+]?(?:[0-9.]+(?:[eE][-+]?[0-9]+)?|Inf|NaN))\s*$"
    t = F.col(line)
    pairs = F.regexp_extract_all(F.regexp_extract(t, pattern, 2), F.lit(r'(\w+="(?:[^"\\]|\\.)*")'), F.lit(1))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_extract(p, r'(?s)^\w+="(.*)"$', 1).alias("value"))))
    return lines.where(t.rlike(pattern) & ~t.startswith("#")).select(F.regexp_extract(t, pattern, 1).alias("metric"), labels.alias("labels"), F.expr("try_cast(" + f"regexp_extract({line}, '{pattern}', 3)".replace("\\", "\\\\") + " AS double)").alias("value"))


def amplification_report(measurements: DataFrame) -> DataFrame:
    """(line_no, line): a table row per measurement (label, sstable_bytes, user_bytes, live_bytes, logical_bytes, read_amp, tables)."""
    m = measurements.withColumn("w", ratio("sstable_bytes", "user_bytes")).withColumn("s", ratio("live_bytes", "logical_bytes"))
    body = F.format_string("| %s | %.2f× | %.2f | %.2f× | %d | %.2f |", "label", "w", "read_amp", "s", "tables", F.col("live_bytes") / (1024.0 * 1024.0))
    # fixed value: the report's header
    head = measurements.sparkSession.createDataFrame([(-2, "| Strategy | Write Amp | Read Amp | Space Amp | Live Tables | On-disk MB |"), (-1, "|---|---|---|---|---|---|")], "line_no bigint, line string")
    return head.unionByName(m.select(F.col("position").cast("bigint").alias("line_no"), body.alias("line")))


def ratio(a: str, b: str) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
