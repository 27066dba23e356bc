"""Differences between two copies of a keyed table, field by field.

Each side's row per key is unpivoted to (key, field, cell) rows with sign +1 or -1; a cell whose signs cancel is the
same on both sides. Grouping by cell and then by field leaves the fields that differ, and the presence field tells
the keys only one side has. All of it needs a single exchange, by key, which carries the columns as they are; cells
are made after it, from one row per key and side.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRESENT = "__present"


def canonical_map(clock: Column) -> Column:
    """A map as a text that is equal for equal sets of entries; null stays null, zero entries count."""
    return F.to_json(F.sort_array(F.map_entries(clock)))


Fields = Mapping[str, tuple[str, Callable[[Column], Column]]]


def latest_rows(df: DataFrame, key: str, version: str, fields: Fields) -> DataFrame:
    """``key`` and a struct ``cells`` of the row with the highest version per key; a null version is the lowest.

    Combined before the shuffle, so a key dumped any number of times leaves a task once.
    """
    raw = F.struct(*[F.col(c).alias(f) for f, (c, _) in fields.items()])
    newest = df.select(F.col(key).alias("key"), F.struct(F.col(version)).alias("v"), raw.alias("raw")).groupBy("key").agg(F.max_by("raw", "v").alias("raw"))
    return newest.select("key", F.struct(*[cell(F.col(f"raw.`{f}`")).alias(f) for f, (_, cell) in fields.items()]).alias("cells"))


def unpivot_cells(rows: DataFrame, fields: list[str], sign: int) -> DataFrame:
    """(key, field, cell, sign) rows, with one more per key for its presence. A cell is a nullable text."""
    entries = [F.struct(F.lit(PRESENT).alias("field"), F.lit(None).cast("string").alias("cell"))] + [
        F.struct(F.lit(f).alias("field"), F.col(f"cells.`{f}`").alias("cell")) for f in fields
    ]
    return rows.select("key", F.explode(F.array(*entries)).alias("e")).select("key", "e.field", "e.cell", F.lit(sign).alias("sign"))


def diff_copies(a: DataFrame, b: DataFrame, fields: Fields, key: str = "key", version: str = "version") -> DataFrame:
    """(key, field, a_cell, b_cell) for every difference.

    field is ``only_a`` or ``only_b`` for a key of one copy, else the name of a field whose cells differ; null
    equals only null. A null key is compared like any other. Rows dumped twice and older states count for nothing.
    Empty copies give every key of the other, two empty ones nothing. Columns not named in ``fields`` are ignored.
    ``fields`` maps a name to a column and a function from it to a text that is equal exactly if the values are.
    """
    names = list(fields)
    both = unpivot_cells(latest_rows(a, key, version, fields), names, 1).unionByName(unpivot_cells(latest_rows(b, key, version, fields), names, -1))
    # partitioned by key, both groupings below are local to a partition
    cells = both.repartition("key").groupBy("key", "field", "cell").agg(F.sum("sign").alias("net"))
    left = cells.where(F.col("net") != 0).groupBy("key", "field").agg(
        F.max(F.when(F.col("net") > 0, F.struct("cell"))).alias("a"), F.max(F.when(F.col("net") < 0, F.struct("cell"))).alias("b")
    )
    # a key only one copy has shows as its presence; its other cells don't cancel either and are folded into it
    per_key = left.groupBy("key").agg(F.collect_list(F.struct("field", "a", "b")).alias("d"))
    alone = F.filter("d", lambda x: x["field"] == PRESENT)
    return (
        per_key.withColumn("d", F.when(F.size(alone) > 0, alone).otherwise(F.col("d")))
        .select("key", F.explode("d").alias("d"))
        .select(
            "key",
            F.when(F.col("d.field") != PRESENT, F.col("d.field")).when(F.col("d.a").isNotNull(), F.lit("only_a")).otherwise(F.lit("only_b")).alias("field"),
            F.col("d.a.cell").alias("a_cell"),
            F.col("d.b.cell").alias("b_cell"),
        )
    )


def store_fields() -> Fields:
    """The compared fields of a node's dump: bytes as hex, clocks as sorted entries, the rest as text."""
    text = lambda c: c.cast("string")
    return {"value": ("value", F.hex), "version": ("version", text), "vector_clock": ("vector_clock", canonical_map), "tombstone": ("tombstone", text)}
