"""Vector clocks as map<string,bigint> columns. An absent node counts 0; equality is of the maps, zero entries included."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = F.lit


def initial(node: Column | str) -> Column:
    node = F.lit(node) if isinstance(node, str) else node
    return F.create_map(node, F.lit(1).cast("bigint"))


def legacy(version: Column) -> Column:
    """The clock of a version from before clocks; null for a negative one."""
    return F.when(version >= 0, F.create_map(F.lit("legacy"), version.cast("bigint")))


def merge(a: Column, b: Column) -> Column:
    """Greatest counter per node; a null clock is empty."""
    empty = F.expr("cast(map() as map<string,bigint>)")
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, zero)))


def increment(clock: Column, node: str) -> Column:
    one = F.create_map(F.lit(node), (F.coalesce(F.try_element_at(clock, F.lit(node)), F.lit(0).cast("bigint")) + 1))
    return F.map_concat(F.map_filter(clock, lambda k, _: k != node), one)


def happens_before_sql(a: str, b: str) -> str:
    """a is nowhere above b and somewhere below, as SQL over two map columns."""
    return (
        f"(forall(map_keys({a}), k -> {a}[k] <= coalesce({b}[k], 0L)) AND forall(map_keys({b}), k -> coalesce({a}[k], 0L) <= {b}[k])"
        f" AND (exists(map_keys({b}), k -> coalesce({a}[k], 0L) < {b}[k]) OR exists(map_keys({a}), k -> {a}[k] < coalesce({b}[k], 0L))))"
    )


def happens_before(a: str, b: str) -> Column:
    return F.expr(happens_before_sql(a, b))


def same(a: Column, b: Column) -> Column:
    return F.sort_array(F.map_entries(a)).eqNullSafe(F.sort_array(F.map_entries(b)))


def concurrent(a: str, b: str) -> Column:
    """Different, and neither before the other; so {a:2} and {a:2,b:0} are concurrent."""
    return ~same(F.col(a), F.col(b)) & ~happens_before(a, b) & ~happens_before(b, a)


def version_of(clock: Column) -> Column:
    return F.aggregate(F.map_values(clock), F.lit(0).cast("bigint"), lambda s, x: s + x)


def canonical(clock: Column) -> Column:
    """``n1=c1,n2=c2`` by node: compared as text, so a counter of 10 comes before one of 9."""
    return F.when(clock.isNotNull(), F.concat_ws(",", F.transform(F.sort_array(F.map_entries(clock)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))))
