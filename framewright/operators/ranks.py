"""Ranks, running sums and exact quantiles in which no group has to fit one task.

Rows are range-partitioned by (group, order) and written; sums inside each partition are shifted by
those of the group's rows in earlier partitions, of which there is one row per partition and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .storage import checkpoint


def _cut(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows by range of (group, order), with __pid. Range partitioning reads its input twice, once for
    its bounds; write a costly one first."""
    return checkpoint(rows.repartitionByRange(*group, *order).withColumn("__pid", F.spark_partition_id()))


def _shift(cut: DataFrame, per: DataFrame, group: Sequence[str]) -> DataFrame:
    """cut joined with per (__pid, group, ...) by partition and group, nulls being equal."""
    renamed = per.withColumnsRenamed({"__pid": "__p"} | {c: f"__g{i}" for i, c in enumerate(group)})
    on = cut["__pid"] == renamed["__p"]
    for i, c in enumerate(group):
        on = on & cut[c].eqNullSafe(renamed[f"__g{i}"])
    return cut.join(renamed, on)


def running(rows: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, str], following: dict[str, str] | None = None) -> DataFrame:
    """rows with, for each (name, column) of `sums`, the column's sum over the group's rows before as
    before_<name> and over the whole group as total_<name>; for each of `following`, the column's
    value in the group's next row. Rows that are equal in the order are taken in any one."""
    following = following or {}
    cut = _cut(rows, group, order)
    inside = Window.partitionBy("__pid", *group).orderBy(*order)
    per = cut.groupBy("__pid", *group).agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()], *[F.min_by(c, F.struct(*order)).alias(f"__f_{n}") for n, c in following.items()])
    over = Window.partitionBy(*group)
    past = over.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    ahead = over.orderBy("__pid")
    new = {f"__b_{n}": F.coalesce(F.sum(f"__s_{n}").over(past), F.lit(0)) for n in sums} | {f"total_{n}": F.sum(f"__s_{n}").over(over) for n in sums} | {f"__n_{n}": F.lead(f"__f_{n}").over(ahead) for n in following}
    per = per.withColumns(new).select("__pid", *group, *new)
    here = cut.withColumns({f"__i_{n}": F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c) for n, c in sums.items()} | {f"__l_{n}": F.lead(c).over(inside) for n, c in following.items()} | {"__last": F.lead(F.lit(True)).over(inside).isNull()})
    out = _shift(here, per, group)
    made = [(F.col(f"__b_{n}") + F.col(f"__i_{n}")).alias(f"before_{n}") for n in sums] + [F.col(f"total_{n}") for n in sums]
    made += [F.when(F.col("__last"), F.col(f"__n_{n}")).otherwise(F.col(f"__l_{n}")).alias(n) for n in following]
    return out.select(*rows.columns, *made)


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "rank", size: str | None = None) -> DataFrame:
    """rows with their 0-based rank in the group, and the group's rows as `size` if that is named."""
    keys = {f"__o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    cut = _cut(rows.withColumns(keys), group, list(keys))
    per = cut.groupBy("__pid", *group).agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(over.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("__pid", *group, before.alias("__base"), F.sum("__n").over(over).alias("__size"))
    at = F.row_number().over(Window.partitionBy("__pid", *group).orderBy(*keys)) - 1
    out = _shift(cut.withColumn("__at", at), per, group)
    return out.select(*rows.columns, (F.col("__base") + F.col("__at")).cast("long").alias(name), *([F.col("__size").alias(size)] if size else []))


def carried(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """rows with the last non-null `value` of the group's rows up to each as __prev, and the first
    from it on as __next.

    __next is carried backwards along the row numbers: Spark goes through a frame that ends with the
    group anew for each row, which takes the square of a group's rows."""
    cut = _cut(rows.withColumn("__v", value), group, order)
    part = Window.partitionBy("__pid", *group)
    up_to = lambda o: part.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    here = cut.withColumns({"__at_row": F.row_number().over(part.orderBy(*order)), "__a": F.last("__v", ignorenulls=True).over(up_to(order))})
    here = here.withColumn("__z", F.last("__v", ignorenulls=True).over(up_to([F.desc("__at_row")])))
    at = F.struct(*order)
    some = F.col("__v").isNotNull()
    per = cut.groupBy("__pid", *group).agg(F.max_by("__v", F.when(some, at)).alias("__l"), F.min_by("__v", F.when(some, at)).alias("__f"))
    beyond = lambda o: Window.partitionBy(*group).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"__p0": F.last("__l", ignorenulls=True).over(beyond("__pid")), "__n0": F.last("__f", ignorenulls=True).over(beyond(F.desc("__pid")))})
    out = _shift(here, per.select("__pid", *group, "__p0", "__n0"), group)
    return out.select(*rows.columns, F.coalesce("__a", "__p0").alias("__prev"), F.coalesce("__z", "__n0").alias("__next"))


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row a key with the linearly interpolated quantiles by name; values are counted first, so that
    repeated ones cost a row each, and found by their ranks. Null values are left out."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    at = running(counted, keys, ["__x"], {"n": "__c"})
    found, last = [], F.col("total_n") - 1
    for n, p in shares.items():
        place = F.lit(float(p)) * last
        for side, r in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            found.append(F.max(F.when((F.col("before_n") <= r) & (r < F.col("before_n") + F.col("__c")), F.col("__x"))).alias(f"__{side}_{n}"))
        found.append(F.max(place - F.floor(place)).alias(f"__w_{n}"))
    got = at.groupBy(*keys).agg(*found)
    lo, hi, w = (lambda n: F.col(f"__lo_{n}")), (lambda n: F.col(f"__hi_{n}")), (lambda n: F.col(f"__w_{n}"))
    return got.select(*keys, *[(lo(n) + (hi(n) - lo(n)) * w(n)).alias(n) for n in shares])
