"""Running totals over a whole table's order, without a single task that sees all of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.session import stage


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to and including this one by ``order``, which must be unique.

    Rows are cut into ranges of the order, summed within each in parallel, and the ranges' totals - one row a range -
    put before each other. The cut is staged, since drawing it again could give other bounds.
    """
    ranged = stage(df.withColumn("__v", value).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__p").agg(F.sum("__v").alias("__t"))
    before = totals.select("__p", (F.sum("__t").over(Window.orderBy("__p")) - F.col("__t")).alias("__b"))
    within = F.sum("__v").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(name, within).join(before, "__p").withColumn(name, F.col(name) + F.col("__b")).drop("__p", "__v", "__b")


#: Rows of a group that one task may go through; a larger group is cut into ranges.
GROUP = 2_000_000


@dataclass
class Laid:
    """Rows in order within their groups, for extremes and sums carried along; from :func:`laid`."""

    df: DataFrame
    by: list[str]
    order: list[str]
    ranged: bool  #: some group is too large for a task, so ranges have a number ``__p``

    def carried(self, least: dict[str, Column] | None = None, most: dict[str, Column] | None = None, total: dict[str, Column] | None = None, reverse: bool = False, of: Callable[[DataFrame], DataFrame] = lambda df: df) -> Laid:
        """With the least or greatest of an expression, or its sum, over the rows before each row of its group, that row left out;
        null of no rows, a sum 0. ``reverse`` looks at the rows after it instead, ``of`` picks rows first.

        Where a group is too large, each range is one window, and the ranges' own figures - a row a group and range - are carried
        on to the ranges that follow.
        """
        df = of(self.df)
        towards = (lambda c: F.col(c).desc()) if reverse else F.col
        plus = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        named = [(n, c, f, join) for m, f, join in ((least, F.min, F.least), (most, F.max, F.greatest), (total, F.sum, plus)) for n, c in (m or {}).items()]
        within = Window.partitionBy(*self.by, *(["__p"] if self.ranged else [])).orderBy(*map(towards, self.order)).rowsBetween(Window.unboundedPreceding, -1)
        out = df.select("*", *[(F.coalesce(f(c).over(within), F.lit(0)) if join is plus else f(c).over(within)).alias(n) for n, c, f, join in named])
        if self.ranged:
            totals = df.groupBy(*self.by, "__p").agg(*[f(c).alias(n) for n, c, f, _ in named])
            past = Window.partitionBy(*self.by).orderBy(towards("__p")).rowsBetween(Window.unboundedPreceding, -1)
            before = totals.select(*[F.col(b).alias(f"__{b}") for b in self.by], F.col("__p").alias("__q"), *[f(n).over(past).alias(f"__{n}") for n, _, f, _ in named])
            same = F.col("__p") == F.col("__q")
            for b in self.by:
                same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
            # both are null before anything came; least and greatest skip nulls
            out = out.join(before, same).select(*df.columns, *[join(F.col(n), F.col(f"__{n}")).alias(n) for n, _, _, join in named])
        return Laid(out, self.by, self.order, self.ranged)

    def rows(self) -> DataFrame:
        return self.df.drop("__p")


def laid(df: DataFrame, by: list[str], order: list[str]) -> Laid:
    """``df`` staged, by groups of ``by`` in the order of ``order``, which must be unique in a group. Null is a group.

    The largest group is counted if there are more rows than ``GROUP``. Up to ``GROUP`` rows groups are whole in a task; with a larger one, rows are cut into
    ranges of group and order, so a group with a third of all rows is spread like the rest.
    """
    held = stage(df, "laid")
    # the files' own row counts settle it for most tables
    if held.count() <= GROUP or held.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n <= GROUP:
        return Laid(held, by, order, False)
    return Laid(stage(held.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()), "ranged"), by, order, True)
