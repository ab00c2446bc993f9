"""Column expressions over arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy_bits(p: Column) -> Column:
    """Shannon entropy of an array of probabilities; zeros add nothing."""
    return F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x * F.log2(x))


def brier(p: Column, truth: Column) -> Column:
    """Squared distance of an array of probabilities from the one-hot truth (0-based index)."""
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == truth, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x)


def top2(classes: Column, p: Column) -> Column:
    """The two likeliest (p, class) of parallel arrays, ties by the higher class."""
    return F.slice(F.sort_array(F.transform(F.arrays_zip(p.alias("p"), classes.alias("c")), lambda s: F.struct(s["p"].alias("p"), s["c"].alias("c"))), asc=False), 1, 2)


def top2_first(classes: Column, p: Column) -> Column:
    """The two likeliest (p, class) of parallel arrays, ties by the earlier place."""
    order = F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("o"), i.alias("i"))))
    return F.transform(F.slice(order, 1, 2), lambda s: F.struct(F.element_at(p, s["i"] + 1).alias("p"), F.element_at(classes, s["i"] + 1).alias("c")))


def dominant(counts: Column, share: float | None = 0.7, other: str = "mixed") -> Column:
    """Key of the largest count of a map, ties by the smaller key; `other` if its share is below."""
    best = F.element_at(F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))), 1)
    total = F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x)
    if share is None:
        return best["k"]
    return F.when(F.size(counts) == 0, other).when(-best["n"] / total >= share, best["k"]).otherwise(other)


def keys_of(*maps: Column) -> Column:
    """Sorted distinct keys of several maps."""
    return F.array_sort(F.array_distinct(F.concat(*[F.map_keys(m) for m in maps])))


def used(counts: Column) -> Column:
    """Number of keys with a positive count."""
    return F.size(F.map_filter(counts, lambda k, v: v > 0))


def overlay(base: Column, delta: Column, allowed: tuple[str, ...]) -> Column:
    """base with the allowed keys of delta on top."""
    use = F.map_filter(delta, lambda k, v: k.isin(*allowed))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(use), k)), use)


def histogram_percentile(hist: Column, percent: float) -> Column:
    """Place in a histogram of the rank ceil(p * n) - 1, looked for in the running counts: the first
    place whose running count is not below that rank (one rank low, as the original has it)."""
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x)
    rank = F.greatest(F.lit(0), F.least(F.ceil(F.lit(percent / 100.0) * total) - 1, total - 1))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("at"))
    found = F.aggregate(hist, zero, lambda s, x: F.struct((s["n"] + x).alias("n"), F.when(s["n"] + x < rank, s["at"] + 1).otherwise(s["at"]).alias("at")))
    return F.when(total <= 0, 0.0).otherwise(found["at"].cast("double"))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two 64-bit hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def hash64(hex16: Column) -> Column:
    """16 hexadecimal digits as a signed 64-bit number."""
    return F.conv(hex16, 16, -10).cast("long")


def in_box(x: Column, y: Column, boxes: Column) -> Column:
    """Whether a point is in one of an array of boxes (x0, y0, x1, y1), edges included."""
    return F.exists(boxes, lambda b: x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"]))


def sampled(n: int, fps: float, sample_fps: float, most: int) -> list[int]:
    """Indices of the frames to sample from a video of n frames."""
    step = max(1, int(fps / sample_fps)) if sample_fps > 0 else 1
    return list(range(0, n, step))[:most]


def sampled_frames(n: Column, fps: Column, sample_fps: float, most: int) -> Column:
    """sampled() as an array column."""
    step = F.greatest(F.lit(1), F.floor(fps / sample_fps).cast("int"))
    return F.when(n > 0, F.slice(F.sequence(F.lit(0), n - 1, step), 1, most)).otherwise(F.array().cast("array<int>"))


def known_rates(rates: Column, classes: Column, present: Column) -> Column:
    """Map of class number to its rates, of a map by class name: names that `classes` (in order of their
    numbers) doesn't have, or whose numbers aren't present, are dropped."""
    by_name = F.map_from_entries(F.transform(classes, lambda c, i: F.struct(c, i)))
    kept = F.map_filter(rates, lambda k, v: F.coalesce(F.array_contains(present, F.element_at(by_name, k)), F.lit(False)))
    return F.transform_keys(kept, lambda k, v: F.element_at(by_name, k))


def fingerprint(config: Column, allowed: tuple[str, ...]) -> Column:
    """SHA-256 of the allowed keys of a map of texts, as JSON in order of keys."""
    own = F.array_sort(F.map_entries(F.map_filter(config, lambda k, v: k.isin(*allowed))))
    return F.sha2(F.concat(F.lit("{"), F.array_join(F.transform(own, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2))), ","), F.lit("}")), 256)
