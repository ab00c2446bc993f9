"""Evaluation and drift statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from framewright.functions import labels

from .ranks import quantiles, running
from .storage import checkpoint

#: What counts as no difference; probabilities of at most 0, 1, ... draws of a Poisson(1) variable.
EPS = 1e-9
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(7)])

#: Edges of ten equal bins, as the floating-point numbers that equal steps give.
TENTHS = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def bin_of(x: Column, edges: Sequence[float] = TENTHS) -> Column:
    """Number of the half-open bin, the last one closed; null outside."""
    out = None
    last = len(edges) - 2
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (x >= a) & ((x <= b) if i == last else (x < b))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def calibration(rows: DataFrame, confidence: str, correct: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Per bin of confidence: rows, mean confidence and accuracy (reliability curve)."""
    return rows.withColumn("bin", bin_of(F.col(confidence))).where("bin is not null").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def ece(rows: DataFrame, confidence: str, correct: Column) -> DataFrame:
    """Expected calibration error over ten bins, and the Brier score of the top class."""
    bins = calibration(rows, confidence, correct).agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))
    score = rows.agg(F.avg(F.pow(F.col(confidence) - correct.cast("double"), 2)).alias("brier"))
    return bins.crossJoin(F.broadcast(score))  # one row each


def class_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: tp, fp, fn, precision, recall, F1 (0 where undefined) and support."""
    both = rows.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(True).alias("is_truth")), F.struct(F.col(predicted).alias("label"), F.lit(False).alias("is_truth")))).alias("s"), (F.col(truth) == F.col(predicted)).alias("hit"))
    got = both.groupBy(F.col("s.label").alias("label")).agg(F.count_if(F.col("s.is_truth") & F.col("hit")).alias("tp"), F.count_if(~F.col("s.is_truth") & ~F.col("hit")).alias("fp"), F.count_if(F.col("s.is_truth") & ~F.col("hit")).alias("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    got = got.withColumns({"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "support": tp + fn})
    return got.withColumn("f1", safe(2 * tp, 2 * tp + fp + fn))


def overall_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy over present classes, macro and weighted F1."""
    c = class_scores(rows, truth, predicted)
    present = F.col("support") > 0
    return c.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.when(present, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def threshold_sweep(rows: DataFrame, confidence: str, truth: str, predicted: str, positives: Sequence, taus: Sequence[float]) -> DataFrame:
    """Per threshold: accepted rows, abstention and one-vs-rest F1 of the given classes.

    Each row is counted once, under the highest threshold that it reaches; running sums over
    the thresholds do the rest, so rows are not copied for each threshold."""
    taus = sorted(taus)
    level = F.lit(-1)
    for i, t in enumerate(taus):
        level = F.when(F.col(confidence) >= t, i).otherwise(level)
    t, p = F.col(truth), F.col(predicted)
    marks = []
    for k, c in enumerate(positives):
        marks += [F.count_if((t == c) & (p == c)).alias(f"tp{k}"), F.count_if((t != c) & (p == c)).alias(f"fp{k}"), F.count_if((t == c) & (p != c)).alias(f"fn{k}")]
    got = rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), *marks)
    grid = rows.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(taus)], "at int, threshold double")
    names = [f"{x}{k}" for k in range(len(positives)) for x in ("tp", "fp", "fn")]
    total = got.agg(F.sum("n").alias("total"))
    summed = grid.join(F.broadcast(got), F.col("level") >= F.col("at"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_accepted"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    f1 = lambda k: F.when(F.col(f"tp{k}") > 0, 2 * F.col(f"tp{k}") / (2 * F.col(f"tp{k}") + F.col(f"fp{k}") + F.col(f"fn{k}"))).otherwise(0.0)
    f1s = [f1(k).alias(f"f1_{k}") for k in range(len(positives))]
    out = summed.crossJoin(F.broadcast(total)).select("threshold", "n_accepted", (1 - F.col("n_accepted") / F.col("total")).alias("abstention"), *f1s)
    return out.withColumn("macro_f1", sum((F.col(f"f1_{k}") for k in range(len(positives))), F.lit(0.0)) / len(positives))


def psi(expected: DataFrame, actual: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Population stability index over the expected deciles; values outside are dropped, and less
    than three different edges give 0. The edges are one row, broadcast to both sides."""
    cuts = {f"q{i}": i / bins for i in range(bins + 1)}
    at = quantiles(expected, [], value, cuts).select(F.array_sort(F.array_distinct(F.array(*cuts))).alias("edges"))

    def share(d: DataFrame, name: str) -> DataFrame:
        e, x = F.col("edges"), F.col(value)
        place = F.least(F.size(F.filter(e, lambda y: y <= x)), F.size(e) - 1)
        b = d.select(value).crossJoin(F.broadcast(at)).where(x.between(F.element_at(e, 1), F.element_at(e, -1))).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        return b.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")  # `bins` rows

    every = at.select(F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("edges") - 1))).alias("bin"), F.size("edges").alias("n_edges"))
    both = every.join(share(expected, "e"), "bin", "left").join(share(actual, "a"), "bin", "left")
    floor = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(1e-6))
    return both.agg(F.when(F.max("n_edges") < 3, 0.0).otherwise(F.sum((floor("a") - floor("e")) * F.ln(floor("a") / floor("e")))).alias("psi"))


def ks_w1(left: DataFrame, right: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Kolmogorov-Smirnov statistic and first Wasserstein distance, per key.

    Values are counted first; the distribution functions are running sums over distinct values."""
    v = F.col(value)
    u = left.select(*keys, v.alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(*keys, v.alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r"))).where("v is not null")
    c = u.groupBy(*keys, "v").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    at = running(c, list(keys), ["v"], {"l": "l", "r": "r"}, {"after": "v"})
    gap = F.abs((F.col("before_l") + F.col("l")) / F.col("total_l") - (F.col("before_r") + F.col("r")) / F.col("total_r"))
    at = at.withColumn("gap", gap)
    return at.groupBy(*keys).agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * F.coalesce(F.col("after") - F.col("v"), F.lit(0.0))).alias("w1"))


def drift_summary(train: DataFrame, sensor: DataFrame, value: str) -> DataFrame:
    """Moments, quantiles and the share of sensor values outside the training p5 to p95."""
    shares = {"median": 0.5, "p5": 0.05, "p95": 0.95}

    def moments(d: DataFrame, p: str) -> DataFrame:
        q = quantiles(d, [], value, {f"{p}_{k}": x for k, x in shares.items()})
        return d.agg(F.avg(value).alias(f"{p}_mean"), F.stddev_pop(value).alias(f"{p}_std")).crossJoin(F.broadcast(q))  # one row each

    t = checkpoint(moments(train, "train"))
    outside = F.avg(((F.col(value) < F.col("train_p5")) | (F.col(value) > F.col("train_p95"))).cast("double"))
    rate = sensor.crossJoin(F.broadcast(t)).agg(outside.alias("out_of_range_rate"))
    return t.crossJoin(F.broadcast(moments(sensor, "sensor"))).crossJoin(F.broadcast(rate))


def mutual_information(rows: DataFrame, a: Column, b: Column, keys: Sequence[str] = (), bins: int = 32) -> DataFrame:
    """Per key, for two columns of 8-bit levels: mutual information in bits over `bins` equal bins of
    0 to 255, and nmi_rho: its share of the root of both entropies over all 256 levels, times
    (correlation + 1) / 2, at least 0. Levels are cut to 0..255 and their fractions dropped; rows
    with a null or NaN are left out. A correlation that is undefined counts as 0.

    Pairs of levels are counted first: all that follows works on 65,536 rows a key at most.
    """
    keys = list(keys)
    level = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.when(~F.isnan(c.cast("double")), c.cast("double"))))).cast("int")
    pair = rows.select(*keys, a.cast("double").alias("__x"), b.cast("double").alias("__y")).where("__x is not null and __y is not null and not isnan(__x) and not isnan(__y)")
    cells = checkpoint(pair.groupBy(*keys, level(F.col("__x")).alias("a"), level(F.col("__y")).alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("__all", F.lit(0)))
    by = ["__all", *keys]
    place = lambda c: F.least(F.lit(bins - 1), F.floor(F.col(c) * bins / 255))

    def weighted(name: str, *columns: Column) -> DataFrame:
        """Per key the sum of n * log2(n) over the groups of the columns."""
        groups = cells.groupBy(*by, *[c.alias(f"c{i}") for i, c in enumerate(columns)]).agg(F.sum("n").alias("n"))
        return groups.groupBy(*by).agg(F.sum(F.col("n") * F.log2("n")).alias(name))

    n, x, y = F.col("n"), F.col("a"), F.col("b")
    got = cells.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"), F.sum(n * x * y).alias("sxy"))
    for name, columns in (("h", (place("a"), place("b"))), ("ha", (place("a"),)), ("hb", (place("b"),)), ("ea", (x,)), ("eb", (y,))):
        got = got.join(weighted(name, *columns), by)
    mi = F.log2("n") + (F.col("h") - F.col("ha") - F.col("hb")) / n
    entropy = lambda c: F.log2("n") - F.col(c) / n
    spread = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")) * F.sqrt((n * F.col("syy") - F.col("sy") * F.col("sy")).cast("double"))
    rho = F.when(spread > 0, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).otherwise(0.0)
    nmi = mi / F.greatest(F.sqrt(F.greatest(F.lit(0.0), entropy("ea") * entropy("eb"))), F.lit(1e-9))
    return got.select(*keys, mi.alias("mi"), F.greatest(F.lit(0.0), nmi * (rho + 1) / 2).alias("nmi_rho"))


def mad_flags(rows: DataFrame, keys: Sequence[str], value: str, limit: float = 3.5) -> DataFrame:
    """rows with the modified z-score from median and median deviation per key, and outlier."""
    med = quantiles(rows, keys, value, {"med": 0.5})
    far = checkpoint(rows.join(med, list(keys)).withColumn("dev", F.abs(F.col(value) - F.col("med"))))
    z = 0.6745 * (F.col(value) - F.col("med")) / (F.col("mad") + 1e-6)
    return far.join(quantiles(far, keys, "dev", {"mad": 0.5}), list(keys)).withColumn("z", z).withColumn("outlier", F.col("z") > limit)


def psnr(rows: DataFrame, a: str, b: str, peak: float = 255.0, keys: Sequence[str] = ()) -> DataFrame:
    mse = F.avg(F.pow(F.col(a) - F.col(b), 2))
    return rows.groupBy(*keys).agg(F.when(mse < 1e-10, 100.0).otherwise(10 * F.log10(peak * peak / mse)).alias("psnr"))


def poisson_weights(ids: np.ndarray, rounds: int) -> np.ndarray:
    """Poisson(1) weights, a row for each id and a column for each round, by a hash of both."""
    h = ((ids.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B1) + (np.arange(rounds, dtype=np.uint64)[None, :] + np.uint64(1)) * np.uint64(0x85EBCA77)) & np.uint64(0xFFFFFFFF)
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
    return np.searchsorted(POISSON, (h ^ (h >> np.uint64(15))) / 2**32, side="right")


def bootstrap_mean(rows: DataFrame, keys: Sequence[str], value: str, id_column: str, rounds: int = 200) -> DataFrame:
    """Percentile interval of the mean from Poisson(1) weights by hash, in one scan.

    Each row gets a weight for each round from its id, so results don't depend on partitions. A
    batch sums up weights and weighted values by key; what is shuffled is an array of `rounds` sums for each
    key and batch. Null and NaN values, and rows without an id, are left out."""
    keys = list(keys)
    body = rows.select(*keys, F.col(value).cast("double").alias("__v"), F.col(id_column).cast("long").alias("__id")).where("__v is not null and not isnan(__v) and __id is not null")
    kinds = ", ".join(f"`{k}` {t}" for k, t in body.dtypes if k in keys)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):  # weights of a slice are a matrix
                part = b.slice(at, 2048)
                w = poisson_weights(part.column("__id").to_numpy(), rounds).astype(np.float64)
                v = part.column("__v").to_numpy()
                _, first, of = np.unique(list(zip(*[[repr(x) for x in part.column(k).to_pylist()] for k in keys], strict=True)) if keys else np.zeros((len(v), 1)), axis=0, return_index=True, return_inverse=True)
                pick = np.eye(len(first))[:, of.ravel()]
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(pa.array(first)) for k in keys], *[pa.array((pick @ x).tolist(), pa.list_(pa.float64())) for x in (w, w * v[:, None])]], names=[*keys, "w", "wv"])

    got = body.mapInArrow(sums, ", ".join(x for x in (kinds, "w array<double>, wv array<double>") if x))
    each = got.select(*keys, F.posexplode(F.arrays_zip("w", "wv")).alias("round", "s")).groupBy(*keys, "round").agg((F.sum("s.wv") / F.sum("s.w")).alias("m"))
    return each.groupBy(*keys).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))  # `rounds` values a key


def median_ranks(n: int, share: float = 0.025) -> int:
    """The 0-based rank of the sorted values at the lower end of the interval of the median: the least
    k for which the middle of n draws with replacement is at most value k with this probability."""
    need = n // 2 + 1
    if n > 2000:  # a normal tail
        return max(0, min(n - 1, math.floor(n * (0.5 - 1.959963984540054 * 0.5 / math.sqrt(n)))))
    for k in range(n):
        p = (k + 1) / n
        tail = 1.0 if p >= 1 else sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(need, n + 1))
        if tail >= share:
            return k
    return n - 1


def bootstrap_median(rows: DataFrame, keys: Sequence[str], value: str, least: int = 1) -> DataFrame:
    """(keys, n, low, high): 95 % interval of the median, as endlessly many bootstrap rounds give it: the
    distribution of the middle of n draws is binomial, so its ends are two values by rank, and no
    rounds are drawn. One value is its own interval; under `least` values it is null. Null and
    NaN values are left out."""
    keys = list(keys)
    v = F.col(value).cast("double")
    counted = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    at = running(counted, keys, ["__x"], {"n": "__c"})

    @F.pandas_udf("long")
    def lower(n: pd.Series) -> pd.Series:
        known = {int(k): median_ranks(int(k)) for k in n.unique()}
        return n.map(known)

    low = lower(F.col("total_n"))
    sides = at.withColumn("__k", low)
    inside = lambda r: (F.col("before_n") <= r) & (r < F.col("before_n") + F.col("__c"))
    got = sides.groupBy(*keys).agg(F.max("total_n").alias("n"), F.max(F.when(inside(F.col("__k")), F.col("__x"))).alias("low"), F.max(F.when(inside(F.col("total_n") - 1 - F.col("__k")), F.col("__x"))).alias("high"))
    return got.select(*keys, "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("low", "high")])


def log_factorial(n: Column) -> Column:
    """ln(n!), by a table up to 19 and Stirling's series beyond (relative error under 1e-15)."""
    small = F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(20)])
    x = F.greatest(n, F.lit(20)).cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(n < 20, F.element_at(small, F.least(n, F.lit(19)).cast("int") + 1)).otherwise(series)


def sign_test(rows: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """Exact two-sided sign test; differences up to 1e-9 count as none, and without others p is NaN.

    Binomial terms fall by known factors from the middle one on, so a key takes about ten square
    roots of its rows, until no term counts any more."""
    d = labels.finite(F.col(delta).cast("double"))
    got = rows.groupBy(*keys).agg(F.count_if(d > EPS).alias("up"), F.count_if(d < -EPS).alias("down"))
    n, k = F.col("up") + F.col("down"), F.least("up", "down")
    steps = F.least(k, (10 * F.sqrt(n.cast("double")) + 100).cast("long"))
    first = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(a: Column, i: Column) -> Column:
        t = a["t"] * (k - i + 1) / (n - k + i)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>")), first, add)["s"]
    middle = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2)
    return got.withColumn("p", F.when(n == 0, float("nan")).otherwise(F.least(F.lit(1.0), 2 * F.exp(middle) * total)))


def wilcoxon(rows: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """(keys, w, n, tie, z, p): two-sided signed-rank test; differences up to 1e-9 are left out.

    z has the tie correction. p is exact for up to 50 differences without ties, by counting the sums
    of ranks, and else that of z; it is NaN under two differences."""
    d = labels.finite(F.col(delta).cast("double"))
    some = rows.where(F.abs(d) > EPS).select(*keys, F.abs(d).alias("m"), (d > 0).alias("up"))
    tied = some.groupBy(*keys, "m").agg(F.count(F.lit(1)).alias("t"), F.count_if("up").alias("u"))
    at = running(tied, list(keys), ["m"], {"t": "t"})
    got = at.withColumn("r", F.col("before_t") + (F.col("t") + 1) / 2).groupBy(*keys).agg(F.sum(F.col("r") * F.col("u")).alias("w"), F.sum("t").alias("n"), F.sum(F.pow("t", 3) - F.col("t")).alias("tie"))
    n = F.col("n").cast("double")  # the cube of a long ends at 1.6 million differences
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48
    got = got.withColumn("z", F.when(var > 0, (F.col("w") - n * (n + 1) / 4) / F.sqrt(var)))

    @F.pandas_udf("double")
    def probability(w: pd.Series, n: pd.Series, tie: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(a, int(b), c == 0, y) for a, b, c, y in zip(w, n, tie, z, strict=True)])

    return got.withColumn("p", F.coalesce(probability("w", "n", "tie", "z"), F.lit(float("nan"))))


def signed_rank_p(w: float, n: int, untied: bool, z: float | None) -> float:
    if n < 2:
        return float("nan")
    if n > 50 or not untied:
        return float("nan") if z is None or z != z else math.erfc(abs(z) / math.sqrt(2))
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] += ways[: len(ways) - r].copy()
    low = int(round(min(w, n * (n + 1) / 2 - w)))
    return float(min(1.0, 2 * ways[: low + 1].sum() / 2.0**n))


def paired_summary(rows: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """(keys, n, mean, median, std, iqr, low, high, sign_p, wilcoxon_p) of a difference; rows with a null
    or infinite one are left out, and one value has a deviation of 0."""
    keys, d = list(keys), labels.finite(F.col(delta).cast("double"))
    some = checkpoint(rows.select(*keys, d.alias("__d")).where("__d is not null"))
    base = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("__d").alias("mean"), F.coalesce(F.stddev_samp("__d"), F.lit(0.0)).alias("std"))
    q = quantiles(some, keys, "__d", {"median": 0.5, "__q1": 0.25, "__q3": 0.75})
    out = base.join(q, keys).join(bootstrap_median(some, keys, "__d").drop("n"), keys)
    out = out.join(sign_test(some, keys, "__d").select(*keys, F.col("p").alias("sign_p")), keys).join(wilcoxon(some, keys, "__d").select(*keys, F.col("p").alias("wilcoxon_p")), keys, "left")
    return out.select(*keys, "n", "mean", "median", "std", (F.col("__q3") - F.col("__q1")).alias("iqr"), "low", "high", "sign_p", F.coalesce("wilcoxon_p", F.lit(float("nan"))).alias("wilcoxon_p"))
