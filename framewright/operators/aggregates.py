"""Grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ranks import quantiles, ranked


def summary(value: str, baseline: str | None = None) -> list[Column]:
    """Aggregates of a metric that need no order: n, mean, sample deviation (0 for one value), and, with a
    baseline, mean difference and win rate."""
    v = F.col(value)
    out = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.count(v) > 1, F.stddev_samp(v)).when(F.count(v) == 1, 0.0).alias("std")]
    if baseline:
        b = F.col(baseline)
        both = v.isNotNull() & b.isNotNull()
        out += [F.avg(F.when(both, v - b)).alias("delta"), F.avg(F.when(both, (v > b).cast("double"))).alias("win_rate")]
    return out


def metric_summary(rows: DataFrame, keys: Sequence[str], value: str, baseline: str | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Per key n, mean, median, deviation, quartiles and p95 of a metric, with a baseline mean
    difference and win rate, and what `extra` aggregates. Quantiles are exact and found by distributed
    ranks, so that a key's distinct values need not fit one task."""
    keys = list(keys)
    base = rows.groupBy(*keys).agg(*summary(value, baseline), *extra)
    q = quantiles(rows, keys, value, {"median": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95}).withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, [base[k].eqNullSafe(q[f"__k{i}"]) for i, k in enumerate(keys)], F.lit(True))
    first = [*keys, "n", "mean", "median", "std", "p25", "p75", "p95"]
    return base.join(q, on, "left").select(*first, *[c for c in base.columns if c not in first])


def counts(rows: DataFrame, key: str, missing: str = "unknown") -> DataFrame:
    """Rows by key, where null and empty count as `missing`."""
    return rows.groupBy(F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(missing)).alias(key)).agg(F.count(F.lit(1)).alias("n"))


def share(rows: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """Sum of weights by key and its share of the total."""
    total = F.sum(F.col("total")).over(Window.partitionBy())
    return rows.groupBy(*keys).agg(F.sum(weight).alias("total")).withColumn("share", F.col("total") / total)


def zero_filled(dimension: DataFrame, rows: DataFrame, key: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates for each key of the dimension; counts of absent keys are 0."""
    got = rows.groupBy(key).agg(*aggregates)
    new = [c for c in got.columns if c != key]
    kinds = dict(got.dtypes)
    return dimension.join(got, key, "left").select(*dimension.columns, *[F.coalesce(c, F.lit(0)).alias(c) if kinds[c] == "bigint" else F.col(c) for c in new])


def wide(rows: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], value: Column) -> DataFrame:
    """Long metric rows to one row a key; the names are given, so that no extra job looks for them."""
    return rows.groupBy(*keys).pivot(name, list(names)).agg(value)


def best_per_group(rows: DataFrame, group: str, option: str, value: str) -> DataFrame:
    """The option with the largest mean in each group, ties to the smaller option."""
    means = rows.groupBy(group, option).agg(F.avg(value).alias("__m"))
    best = F.max_by(F.col(option), F.struct("__m", (-F.col(option)).alias("o"))) if dict(rows.dtypes)[option] != "string" else F.min_by(F.col(option), F.struct((-F.col("__m")).alias("m"), F.col(option).alias("o")))
    return means.groupBy(group).agg(best.alias(f"best_{option}"), F.max("__m").alias("best_mean"))


def variation(rows: DataFrame, keys: Sequence[str], value: str, limit: float) -> DataFrame:
    """Mean, population deviation, its share of the mean in per cent, and PASS or FAIL."""
    cv = 100 * F.stddev_pop(value) / F.avg(value)
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), cv.alias("cv_pct"), F.when(cv <= limit, "PASS").otherwise("FAIL").alias("verdict"))


def examples(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows of each key, with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def first_rows(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key, by partial aggregation, without a sort."""
    rest = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return got.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def sets(rows: DataFrame, groupings: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """GROUPING SETS in one pass over the rows."""
    names = list(dict.fromkeys(c for g in groupings for c in g))
    return rows.groupingSets([[F.col(c) for c in g] for g in groupings], *names).agg(*aggregates)


def p90_by_rank(rows: DataFrame, keys: Sequence[str], value: str, share: float = 0.9) -> DataFrame:
    """sorted[int(share * n)] per key by rank, without arrays."""
    at = ranked(rows.where(F.col(value).isNotNull()).select(*keys, value), list(keys), [value], "__r", "__n")
    return at.where(F.col("__r") == F.floor(F.lit(share) * F.col("__n"))).select(*keys, F.col(value).alias("p90"), F.col("__n").alias("n"))


def longest_run(rows: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Length of the longest run of successive indices (gaps and islands); doubles count once."""
    one = rows.select(*keys, index).distinct()
    island = F.col(index) - F.row_number().over(Window.partitionBy(*keys).orderBy(index))
    runs = one.withColumn("__i", island).groupBy(*keys, "__i").agg(F.count(F.lit(1)).alias("__n"))
    return runs.groupBy(*keys).agg(F.max("__n").alias("longest"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts with their share of the true class, and whether that class is fragile (under 80 %)."""
    got = rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(truth)
    got = got.withColumn("share", F.col("n") / F.sum("n").over(w))
    right = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w)
    return got.withColumn("fragile", right < 0.8)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval; (0, 0) without observations."""
    p, d = k / n, 1 + z * z / n
    centre, margin = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - margin)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), centre + margin))


def detection_summary(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Image-level and centroid precision, recall, F1, Wilson interval and latency of rows
    (gt_positive, predicted_positive, centroid_hit, inference_ms); p95 is null under 20 rows."""
    g, p, h = F.col("gt_positive"), F.col("predicted_positive"), F.col("centroid_hit")
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_images"), F.count_if(g).alias("n_positive"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"),
        F.count_if(g & ~p).alias("fn"), F.count_if(g & h).alias("tp_hit"), F.percentile("inference_ms", 0.5).alias("p50_ms"),
        F.when(F.count(F.lit(1)) >= 20, F.percentile("inference_ms", 0.95)).alias("p95_ms"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, hit = (F.col(c) for c in ("tp", "fp", "fn", "tp_hit"))
    base = base.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "hit_precision": ratio(hit, hit + fp), "hit_recall": ratio(hit, F.col("n_positive"))})
    f1 = lambda a, b: ratio(2 * F.col(a) * F.col(b), F.col(a) + F.col(b))
    low, high = wilson(tp, tp + fn)
    return base.withColumns({"f1": f1("precision", "recall"), "hit_f1": f1("hit_precision", "hit_recall"), "wilson_low": low, "wilson_high": high})


def feature_inventory(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: mean, deviation, range, coverage and whether it never varies; one pass."""
    long = rows.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "feature", "v")
    return long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), (F.count("v") / F.count(F.lit(1))).alias("coverage"), F.coalesce(F.max("v") == F.min("v"), F.lit(True)).alias("constant"))


def imbalance(rows: DataFrame, label: str, support: int) -> DataFrame:
    """Class counts with the ratio of the largest to the smallest and a flag for low support."""
    got = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return got.withColumns({"imbalance": F.max("n").over(w) / F.min("n").over(w), "low_support": F.col("n") < support})


def value_string(column: str) -> Column:
    """Distinct values, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), ",")
