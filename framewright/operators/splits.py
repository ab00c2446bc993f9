"""Sampling and leakage-safe splits. Random order is the order of a hash with a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .ranks import quantiles, ranked, running


def shuffled(id_column: str, seed: int) -> Column:
    """A pseudo-random order that other engines can repeat."""
    return F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed))))


def capped(rows: DataFrame, label: str, id_column: str, cap: int, seed: int = 42) -> DataFrame:
    """At most `cap` rows of each label, in random order (a sampling operator)."""
    return ranked(rows, [label], [shuffled(id_column, seed), F.col(id_column)], "__r").where(F.col("__r") < cap).drop("__r")


def stratified(rows: DataFrame, label: str, id_column: str, ratio: float, seed: int = 42) -> DataFrame:
    """rows with split: `ratio` of each label to train, one row at least on both sides if it has two."""
    out = ranked(rows, [label], [shuffled(id_column, seed), F.col(id_column)], "__r", "__n")
    n = F.col("__n")
    train = F.when(n >= 2, F.greatest(F.lit(1), F.least(n - 1, F.bround(n * ratio).cast("long")))).otherwise(1)
    return out.select(*rows.columns, F.when(F.col("__r") < train, "train").otherwise("test").alias("split"))


def grouped(rows: DataFrame, group: str, label: str, position: str, ratio: float, seed: int = 42) -> DataFrame:
    """rows with split, whole groups on one side: each label's groups (by majority label, ties to the
    first seen) go to train until the rows before a group reach the target."""
    per = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("c"), F.min(position).alias("p"))
    top = per.groupBy(group).agg(F.max_by(label, F.struct("c", (-F.col("p")).alias("o"))).alias("__label"), F.sum("c").alias("__n"))
    at = running(top.withColumn("__o", shuffled(group, seed)), ["__label"], ["__o", group], {"n": "__n"})
    total = F.col("total_n")
    target = F.bround(total * ratio).cast("long")
    target = F.when(total >= 2, F.greatest(F.lit(1), F.least(total - 1, target))).otherwise(target)
    sides = at.select(group, F.when(F.col("before_n") < target, "train").otherwise("test").alias("split"))
    return rows.join(sides, group)


def super_groups(rows: DataFrame, id_column: str, keys: Sequence[str]) -> DataFrame:
    """rows with super_group: rows that share a value of any key are in one group (transitively)."""
    links = None
    for i, k in enumerate(keys):
        first = rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(id_column).alias("b"))
        e = rows.where(F.col(k).isNotNull()).select(F.col(id_column).alias("a"), k).join(first, k).select("a", "b")
        links = e if links is None else links.unionAll(e)
    found = components(links.where("a <> b")).select(F.col("node").alias("__node"), F.col("label").alias("__label"))
    return rows.join(found, rows[id_column] == found["__node"], "left").withColumn("super_group", F.coalesce("__label", id_column)).select(*rows.columns, "super_group")


def leakage(rows: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Number of values of each key on both sides; all 0 for a safe split."""
    one = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], split).unpivot([split], list(keys), "key", "value").where("value is not null")
    both = one.groupBy("key", "value").agg(F.countDistinct(split).alias("sides"))
    return both.groupBy("key").agg(F.count_if(F.col("sides") > 1).alias("overlap"))


def round_robin(rows: DataFrame, source: str, order: Sequence[str], n: int) -> DataFrame:
    """n rows, taking the sources in turn (a sampling operator); the place is kept."""
    at = ranked(rows, [source], order, "__r").where(F.col("__r") < n)
    return at.withColumn("turn", (F.col("__r") + 1).cast("int")).drop("__r").orderBy("turn", source).limit(n)


def excluding(rows: DataFrame, seen: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in random order whose key was not seen before (a sampling operator)."""
    return rows.join(seen.select(key).distinct(), key, "left_anti").orderBy(shuffled(key, seed), key).limit(n)


def time_folds(rows: DataFrame, order: Sequence[str], folds: int = 5) -> DataFrame:
    """rows with fold 0..folds in order of time: fold k is tested after training on those below.

    Bounds come from exact quantiles of a dense order in one column, so no global window is
    needed; order must be one numeric or time column."""
    at = F.col(order[0]).cast("timestamp").cast("double") if "timestamp" in dict(rows.dtypes)[order[0]] else F.col(order[0]).cast("double")
    names = {f"c{i}": i / (folds + 1) for i in range(1, folds + 1)}
    cuts = quantiles(rows.select(at.alias("__t")), [], "__t", names).select(F.array(*names).alias("c"))
    return rows.crossJoin(F.broadcast(cuts)).withColumn("fold", F.size(F.filter("c", lambda x: x < at))).drop("c")


def ranked_queue(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows (a top-k report)."""
    return rows.orderBy(*order).limit(n)


def uncertainty(confidence: Column, entropy: Column, label: Column, around: float = 0.62) -> Column:
    """Priority for labelling: near the threshold, high entropy, and three rare classes."""
    return -F.abs(confidence - around) + entropy + F.when(label.isin("glare", "backlight", "transition"), 2.0).otherwise(0.0)


def set_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of the intersection, both differences and the union of distinct non-null keys, in one
    aggregation instead of four set operations."""
    u = left.select(F.col(key).alias("k"), F.lit(1).alias("s")).unionAll(right.select(F.col(key).alias("k"), F.lit(2).alias("s"))).where("k is not null")
    m = u.groupBy("k").agg(F.bit_or("s").alias("m"))
    return m.agg(F.count_if(F.col("m") == 3).alias("both"), F.count_if(F.col("m") == 1).alias("only_left"), F.count_if(F.col("m") == 2).alias("only_right"), F.count(F.lit(1)).alias("either"))
