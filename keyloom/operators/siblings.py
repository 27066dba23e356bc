"""Sibling sets: rows (key, value, version, clock, tombstone) of one key that no other row of it supersedes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import clocks
from keyloom.operators.front import causal_front as causal_maxima


def _distinct(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per clock and ``by``; of equal rows the one with the smallest version is kept."""
    rest = [c for c in rows.columns if c != "clock" and c not in by]
    # a plain minimum is kept in a hash table, one over a struct needs a sort
    r = F.min(F.struct(*[c for c in ("version",) if c in rest], *[c for c in rest if c != "version"])) if rest != ["version"] else F.struct(F.min("version").alias("version"))
    g = rows.groupBy(F.sort_array(F.map_entries("clock")).alias("ck"), *by).agg((r if rest else F.lit(1)).alias("r"))
    return g.select(by[0], F.map_from_entries("ck").alias("clock"), *by[1:], *[F.col(f"r.{c}").alias(c) for c in rest])


def merge_siblings(rows: DataFrame, per: tuple[str, ...] = ("key",)) -> DataFrame:
    """The store's sibling set per key (or per ``per``): superseded rows dropped, repeated (clock, tombstone, value) collapsed; equal clocks with other bytes stay."""
    return causal_maxima(_distinct(rows, [*per, "tombstone", "value"]), list(per), "clock")


def causal_front(rows: DataFrame) -> DataFrame:
    """Surviving versions for conflict resolution: like :func:`merge_siblings`, but (value, clock) alone tells rows apart."""
    if "tombstone" not in rows.columns:
        return causal_maxima(_distinct(rows, ["key", "value"]), ["key"], "clock")
    return _distinct(merge_siblings(rows), ["key", "value"])


def live(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce(F.col("tombstone"), F.lit(False)))


def conflicting(rows: DataFrame) -> DataFrame:
    """The survivors of keys with more than one of them, some pair concurrent. Survivors of unequal clocks are concurrent."""
    front = causal_front(rows)
    several = front.groupBy("key").agg(F.count_distinct(F.sort_array(F.map_entries("clock"))).alias("n")).where("n > 1").select("key")
    return front.join(several, "key", "left_semi")


def winner_order() -> Column:
    return F.struct(clocks.canonical(F.col("clock")).alias("c"), F.col("value").alias("v"), F.col("version").alias("n"))


def deterministic_winner(rows: DataFrame) -> DataFrame:
    """Per key the greatest (clock as text, value, version), whatever the arrival order."""
    return rows.groupBy("key").agg(F.max_by(F.struct("value", "version", "clock"), winner_order()).alias("w")).select("key", "w.*")


def resolve(rows: DataFrame, policy: str = "PRESERVE") -> DataFrame:
    """(key, survivors, conflict, value, version): one survivor is the value; concurrent ones give none (PRESERVE) or
    the deterministic winner (WINNER); otherwise the greatest version. Rows with a tombstone give ``dead`` too, the deterministic winner's."""
    front = causal_front(rows)
    marks = [F.max_by("tombstone", winner_order()).alias("dead")] if "tombstone" in rows.columns else []
    g = front.groupBy("key").agg(
        F.count(F.lit(1)).alias("survivors"), F.count_distinct(F.sort_array(F.map_entries("clock"))).alias("clocks"),
        F.max_by(F.struct("value", "version"), winner_order()).alias("w"), F.max_by(F.struct("value", "version"), F.struct("version", "value")).alias("latest"), *marks,
    )
    conflict = (F.col("survivors") > 1) & (F.col("clocks") > 1)
    chosen = F.when(F.col("survivors") == 1, F.col("w")).when(conflict, F.col("w") if policy == "WINNER" else F.lit(None)).otherwise(F.col("latest"))
    return g.select("key", "survivors", conflict.alias("conflict"), chosen["value"].alias("value"), chosen["version"].alias("version"), *(["dead"] if marks else []))


def merged_clock(rows: DataFrame) -> DataFrame:
    """(key, clock): the greatest counter per node over all of a key's rows; empty for a key of which only empty clocks are known."""
    per = rows.select("key", F.explode_outer("clock").alias("node", "n")).groupBy("key", "node").agg(F.max("n").alias("n"))
    entries = F.filter(F.collect_list(F.struct("node", "n")), lambda e: e["node"].isNotNull())
    return per.groupBy("key").agg(F.map_from_entries(F.sort_array(entries)).alias("clock"))


def next_clock(rows: DataFrame, coordinator: str, issued: DataFrame | None = None) -> DataFrame:
    """The clock of the coordinator's next write: all it observed and the clock it ``issued`` last (key, clock), one further at its own node."""
    known = rows.select("key", "clock")
    return merged_clock(known if issued is None else known.unionByName(issued.select("key", "clock"))).select("key", clocks.increment(F.col("clock"), coordinator).alias("clock"))


def client_scan(siblings: DataFrame, start: str | None = None, end: str | None = None, limit: int = 0) -> DataFrame:
    """Live keys in range, ascending: deleted siblings go first, then the greatest version is taken. limit <= 0: all."""
    rows = siblings if start is None else siblings.where(F.col("key") >= start)
    rows = rows if end is None else rows.where(F.col("key") < end)
    out = live(rows).groupBy("key").agg(F.max_by(F.struct("value", "version"), F.struct("version", "value")).alias("w")).select("key", "w.*").orderBy("key")
    return out.limit(limit) if limit > 0 else out


def client_get(siblings: DataFrame) -> DataFrame:
    """(key, found, n_siblings, value): what a single node answers per key. Deleted siblings are absent; the value is given only if there is just one."""
    alive = ~F.coalesce(F.col("tombstone"), F.lit(False))
    g = siblings.groupBy("key").agg(F.count_if(alive).alias("n_siblings"), F.max(F.when(alive, F.struct("value"))).alias("v"))
    return g.select("key", (F.col("n_siblings") > 0).alias("found"), "n_siblings", F.when(F.col("n_siblings") == 1, F.col("v.value")).alias("value"))


def as_sets(rows: DataFrame) -> DataFrame:
    """(key, siblings): a key's rows as one array, in canonical order."""
    s = F.struct(clocks.canonical(F.col("clock")).alias("c"), "value", "version", "tombstone", F.sort_array(F.map_entries("clock")).alias("clock"))
    return rows.groupBy("key").agg(F.sort_array(F.collect_list(s)).alias("siblings"))


def scalar(sets: DataFrame) -> DataFrame:
    """The only sibling of each set; a set of another size fails the job, so no conflict is read as a value."""
    one = F.when(F.size("siblings") == 1, F.col("siblings")[0]).otherwise(F.raise_error(F.concat(F.lit("expected one value for "), F.col("key"))))
    return sets.select("key", one.alias("s")).select("key", "s.*")
