"""Windows over ordered rows, and folds: one state machine a key, the same in batch and stream.

A fold reads each key's rows in order and keeps only its machine's state, so keys may be of any
length; different keys run in parallel."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# ---- windows ----


def _order(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def changes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, seconds: str) -> DataFrame:
    """Per key: rows, label changes, and changes per minute of the observed time."""
    changed = F.col(label) != F.lag(label).over(_order(keys, order))
    got = rows.withColumn("__c", changed).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("__c").alias("n_changes"), (F.max(seconds) - F.min(seconds)).alias("__s"))
    return got.withColumn("per_minute", F.when(F.col("__s") > 0, F.col("n_changes") / (F.col("__s") / 60))).drop("__s")


def delta_to_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = 10) -> DataFrame:
    """value less the mean of the n - 1 rows before; null until n rows were seen."""
    w = _order(keys, order)
    mean = F.avg(value).over(w.rowsBetween(-(n - 1), -1))
    return rows.withColumn("delta", F.when(F.row_number().over(w) >= n, F.col(value) - mean))


def deviation_of_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = 10, least: int = 3) -> DataFrame:
    """Population deviation of up to n rows before; null if there are fewer than `least`."""
    w = _order(keys, order).rowsBetween(-n, -1)
    return rows.withColumn("previous_std", F.when(F.count(value).over(w) >= least, F.stddev_pop(value).over(w)))


def jerk(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    return rows.withColumn("jerk", F.abs(F.col(value) - F.lag(value).over(_order(keys, order))))


def frame_rate(rows: DataFrame, keys: Sequence[str], order: Sequence[str], micros: Column, n: int = 30) -> DataFrame:
    """Rows per second over the last n timestamps; 0 where no time passed."""
    w = _order(keys, order).rowsBetween(-(n - 1), 0)
    span = (F.max(micros).over(w) - F.min(micros).over(w)) / 1e6
    k = F.count(F.lit(1)).over(w)
    return rows.withColumn("fps", F.when((k >= 2) & (span > 0), (k - 1) / span).otherwise(0.0))


def every(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Each n-th row of a key."""
    return rows.withColumn("__n", F.row_number().over(_order(keys, order))).where(F.col("__n") % n == 0).drop("__n")


def on_change(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before (the first row counts as a change)."""
    return rows.withColumn("__p", F.lag(value).over(_order(keys, order))).where(~F.col(value).eqNullSafe(F.col("__p"))).drop("__p")


def interframe(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Mean and deviation of the absolute difference between successive rows."""
    return jerk(rows, keys, order, value).groupBy(*keys).agg(F.avg("jerk").alias("mean_diff"), F.stddev_pop("jerk").alias("std_diff"))


def rolling_median(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = 3) -> DataFrame:
    return rows.withColumn("rolling_median", F.percentile(value, 0.5).over(_order(keys, order).rowsBetween(-(n - 1), 0)))


def latch(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, enter: float, leave: float) -> DataFrame:
    """on from the first value >= enter until one < leave; off at the start."""
    event = F.when(F.col(value) >= enter, True).when(F.col(value) < leave, False)
    run = _order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("on", F.coalesce(F.last(event, ignorenulls=True).over(run), F.lit(False)))


def consecutive(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, n: int = 3) -> DataFrame:
    """active where the flag holds for the n-th row in succession or later."""
    w = _order(keys, order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("active", (F.sum(F.col(flag).cast("int")).over(w) == n) & (F.count(F.lit(1)).over(w) == n))


def best_window(rows: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, length: int) -> DataFrame:
    """Per key the start of the `length` successive rows with the largest mean score, ties first.

    Means that are equal to 9 digits are ties: sums of the same values differ in their last bits by
    the order of the rows. best_score is the mean of the window that is taken."""
    w = _order(keys, order)
    ahead = w.rowsBetween(0, length - 1)
    at = rows.withColumns({"__i": F.row_number().over(w) - 1, "__m": F.avg(score).over(ahead), "__k": F.count(F.lit(1)).over(ahead)}).where(F.col("__k") == length)
    best = at.groupBy(*keys).agg(F.max(F.struct(F.round("__m", 9).alias("r"), (-F.col("__i")).alias("o"), "__m")).alias("__b"))
    return best.select(*keys, (-F.col("__b.o")).alias("start"), F.col("__b.__m").alias("best_score"))


# ---- folds ----


class Ema:
    """Exponential mean, seeded with the first value."""

    def __init__(self, alpha: float = 0.55) -> None:
        self.alpha, self.state = alpha, None

    def __call__(self, x: float):
        self.state = x if self.state is None else self.alpha * x + (1 - self.alpha) * self.state
        return self.state


class Kalman:
    """Scalar Kalman filter; the first value seeds it. predict_first adds the process noise before the
    update, as the parameter sweep does, instead of after it; innovation returns the distance of each
    value from what was expected (0 for the first) instead of the estimate."""

    def __init__(self, q: float = 0.5, r: float = 4.0, p0: float = 100.0, predict_first: bool = False, innovation: bool = False) -> None:
        self.q, self.r, self.p0, self.first, self.innovation, self.state = q, r, p0, predict_first, innovation, None

    def __call__(self, z: float):
        if self.state is None:
            self.state = (z, self.p0)
            return abs(z - z) if self.innovation else z
        x, p = self.state
        if self.first:
            p = p + self.q
        k, d = p / (p + self.r), z - x
        x, p = x + k * d, (1 - k) * p
        self.state = (x, p if self.first else p + self.q)
        return abs(d) if self.innovation else x


class Bank:
    """Several machines over the same values; returns the list of their outputs."""

    def __init__(self, machines: Sequence) -> None:
        self.machines = list(machines)

    @property
    def state(self):
        return [m.state for m in self.machines]

    @state.setter
    def state(self, value) -> None:
        for m, s in zip(self.machines, value, strict=True):
            m.state = s

    def __call__(self, *args):
        return [m(*args) for m in self.machines]


class RainMedian:
    """Median of the last n values; once three successive changes were small, values pass as they are."""

    def __init__(self, n: int = 3, still: float = 0.5) -> None:
        self.n, self.still, self.state = max(2, n), still, ((), 0)

    def __call__(self, x):
        held, quiet = self.state
        if held:
            quiet = quiet + 1 if abs(float(np.mean(x)) - float(np.mean(held[-1]))) < self.still else 0
        held = (*held, x)[-self.n :]
        self.state = (held, quiet)
        return x if quiet >= 3 or len(held) < self.n else np.median(np.stack(held), axis=0).tolist()


class Hysteresis:
    """A label is taken over when it came n times in succession; the first one holds at once."""

    def __init__(self, n: int = 3) -> None:
        self.n, self.state = n, None

    def __call__(self, label: str):
        if self.state is None:
            self.state = (label, label, 1)
        else:
            stable, pending, count = self.state
            count = count + 1 if label == pending else 1
            self.state = (label if count >= self.n else stable, label, count)
        return self.state[0]


class Debounce:
    """Preset changes take as many rows in succession as the transition asks for."""

    # Rows until a preset sets in, and until it is left.
    SPECIAL = {"glare": (2, 20), "glare_heavy": (2, 20), "rain": (10, 25), "transition": (12, 30), "fog": (6, 18)}

    def __init__(self, fallback: str = "default", usual: int = 18, known: Sequence[str] | None = None, special: dict | None = None) -> None:
        self.fallback, self.usual, self.known, self.special, self.state = fallback, usual, known, special or self.SPECIAL, (fallback, None, 0)

    def __call__(self, desired: str):
        d = desired if self.known is None or desired in self.known else self.fallback
        stable, candidate, streak = self.state
        if d == stable:
            self.state = (stable, None, 0)
            return stable
        streak = streak + 1 if candidate == d else 1
        need = self.special[d][0] if d in self.special else self.special[stable][1] if stable in self.special else self.usual
        self.state = (d, None, 0) if streak >= need else (stable, d, streak)
        return self.state[0]


class SkewGate:
    """GOOD, DEGRADED or BAD by a mean of the skew, with hold times; a missing skew changes nothing."""

    def __init__(self, alpha: float = 0.25, on: tuple[float, float] = (20.0, 50.0), back: tuple[float, float] = (14.0, 32.0), hold: int = 6) -> None:
        self.alpha, self.on, self.back, self.hold, self.state = alpha, on, back, hold, ("GOOD", None, 0)

    def __call__(self, skew: float | None):
        name, mean, strike = self.state
        if skew is not None and not math.isnan(skew):
            mean = skew if mean is None else (1 - self.alpha) * mean + self.alpha * skew
            to = None
            if name == "GOOD":
                to = "DEGRADED" if mean >= self.on[0] else None
            elif name == "DEGRADED":
                to = "BAD" if mean >= self.on[1] else "GOOD" if mean <= self.back[0] else None
            elif mean <= self.back[1]:
                to = "DEGRADED"
            strike = strike + 1 if to else 0
            if to and strike >= self.hold:
                name, strike = to, 0
            self.state = (name, mean, strike)
        return self.state[0]


class OneEuro:
    """Low-pass filter whose cutoff rises with speed; takes (x, t)."""

    def __init__(self, least: float = 1.15, beta: float = 0.018, d_cutoff: float = 1.0) -> None:
        self.least, self.beta, self.d_cutoff, self.state = least, beta, d_cutoff, None

    def __call__(self, x: float, t: float):
        if self.state is None:
            self.state = (x, 0.0, t)
            return x
        x0, dx0, t0 = self.state
        dt = t - t0 if t > t0 else 1e-6
        share = lambda cutoff: (r := 2.0 * math.pi * cutoff * dt) / (r + 1.0)
        dx0 += share(self.d_cutoff) * ((x - x0) / dt - dx0)
        out = x0 + share(self.least + self.beta * abs(dx0)) * (x - x0)
        self.state = (out, dx0, t)
        return out


class Posterior:
    """Exponential mean of class probabilities, with rates of its own for some classes rising and
    falling, scaled to a sum of 1. Takes and returns JSON maps of class to probability."""

    def __init__(self, classes: Sequence[str], alpha: float = 0.55, rates: dict[str, tuple[float, float]] | None = None) -> None:
        self.classes, self.alpha, self.rates, self.state = list(classes), alpha, rates or {}, None

    def __call__(self, proba: str):
        p = json.loads(proba)
        if self.state is None:
            self.state = dict(p)
        else:
            new = {}
            for c in self.classes:
                x, y = p.get(c, 0.0), self.state.get(c, 0.0)
                up, down = self.rates.get(c, (self.alpha, self.alpha))
                a = up if x > y else down
                new[c] = a * x + (1 - a) * y
            total = sum(new.values())
            self.state = {c: v / total for c, v in new.items()} if total > 0 else new
        return json.dumps(self.state, sort_keys=True)


class Hold:
    """A text stays for n rows after its cause is gone."""

    def __init__(self, n: int = 8) -> None:
        self.n, self.state = n, ("", 0)

    def __call__(self, text: str | None):
        old, left = self.state
        self.state = (text, self.n) if text else (old, left - 1) if left > 0 else ("", 0)
        return self.state[0]


class MotionGate:
    """Active for `hold` rows from the second score in succession over the limit; a missing score
    only lets that time run out."""

    def __init__(self, limit: float = 8.5, strikes: int = 2, hold: int = 12) -> None:
        self.limit, self.strikes, self.hold, self.state = limit, strikes, hold, (0, 0)

    def __call__(self, score: float | None):
        strike, left = self.state
        if score is None or score != score:
            self.state = (strike, max(0, left - 1))
            return left > 1
        strike = strike + 1 if score > self.limit else 0
        if strike >= self.strikes:
            strike, left = 0, self.hold
        self.state = (strike, max(0, left - 1))
        return left > 0


class JerkScore:
    """Score of the change from frame to frame, and whether a MotionGate over it is active: returns
    [score, 1 or 0]. The score weighs mean and 94th percentile of the absolute difference."""

    def __init__(self, gate: MotionGate | None = None, percent: float = 94.0) -> None:
        self.gate, self.percent, self.state = gate or MotionGate(), percent, None

    def __call__(self, frame):
        f = np.asarray(frame, np.float64)
        before, gate = self.state or (None, (0, 0))
        self.gate.state = gate
        d = None if before is None else np.abs(f - before)
        score = None if d is None else float(0.48 * d.mean() + 0.52 * np.percentile(d, self.percent))
        active = self.gate(score)
        self.state = (f, self.gate.state)
        return [score, float(active)]


class GlareBlend:
    """Blends a value or frame with the output before where asked to; takes (x, apply, reset)."""

    def __init__(self, past: float = 0.42) -> None:
        self.past, self.state = past, None

    def __call__(self, x, apply: bool, reset: bool):
        if reset:
            self.state = None
        self.state = x if not apply or self.state is None else (1 - self.past) * x + self.past * self.state
        return self.state


class Background:
    """Mean of the first frames, then a slow drift; returns the heat over it, 0 to 255, or None
    while it warms up. Frames are arrays."""

    def __init__(self, warm_up: int = 40, rate: float = 0.005, floor: float = 3.0) -> None:
        self.warm_up, self.rate, self.floor, self.state = warm_up, rate, floor, (0, None)

    def __call__(self, frame):
        f = np.asarray(frame, np.float64)
        n, cold = self.state
        if n < self.warm_up:
            cold = f if cold is None else cold + (f - cold) / (n + 1)
        else:
            cold = (1 - self.rate) * cold + self.rate * f
        self.state = (n + 1, cold)
        if n + 1 < self.warm_up:
            return None
        heat = np.maximum(f - cold - self.floor, 0)
        top = heat.max()
        return (np.clip(heat * (255 / top), 0, 255) if top >= 1 else heat * 0).tolist()


class FrameFilter:
    """A per-pixel machine (Ema or Kalman) over array frames; the output is clipped to whole grey levels,
    its state is not."""

    def __init__(self, machine: Ema | Kalman, low: float = 0.0, high: float = 255.0) -> None:
        self.machine, self.low, self.high = machine, low, high

    @property
    def state(self):
        return self.machine.state

    @state.setter
    def state(self, value) -> None:
        self.machine.state = value

    def __call__(self, frame):
        return np.floor(np.clip(self.machine(np.asarray(frame, np.float64)), self.low, self.high)).tolist()


class ThermalNormaliser:
    """Stretches frames to 0..255 between smoothed percentiles of the valid pixels; the median tells the
    unit, and with it the valid range. Frames are arrays."""

    # Ranges in raw counts, kelvin and degrees Celsius.
    RAW, KELVIN, CELSIUS = (20000.0, 45000.0), (200.0, 450.0), (-80.0, 180.0)

    def __init__(self, low: float = 2.0, high: float = 98.0, least: int = 200, alpha: float = 0.25) -> None:
        self.low, self.high, self.least, self.alpha, self.state = low, high, least, alpha, None

    def __call__(self, frame):
        x = np.asarray(frame, np.float64)
        fine = x[np.isfinite(x)]
        if len(fine):
            median = np.median(fine)
            a, b = self.RAW if median > 1000 else self.KELVIN if median >= self.KELVIN[0] else self.CELSIUS
            valid = fine[(fine != 0) & (fine != 65535) & (fine >= a) & (fine <= b)]
            if len(valid) >= self.least:
                lo, hi = np.percentile(valid, [self.low, self.high])
                if hi > lo:
                    k = self.alpha
                    self.state = (lo, hi) if self.state is None else ((1 - k) * self.state[0] + k * lo, (1 - k) * self.state[1] + k * hi)
        if self.state is None or self.state[1] <= self.state[0]:
            return (x * 0).tolist()
        lo, hi = self.state
        return np.floor(np.clip((np.nan_to_num(x) - lo) * 255 / (hi - lo), 0, 255)).tolist()


class HashChain:
    """HMAC-SHA256 of each record with the signature of the record before."""

    def __init__(self, key: bytes) -> None:
        self.key, self.state = key, None

    def __call__(self, text: str):
        body = json.dumps({"prev": self.state, "text": text}, sort_keys=True)
        self.state = hmac.new(self.key, body.encode(), hashlib.sha256).hexdigest()
        return self.state


Machine = Callable[..., object]


def fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], make: Callable[[], Machine], name: str, kind: str, last: bool = False) -> DataFrame:
    """rows with the machine's output after each row, as column `name`; with `last`, one row a key.

    Rows are dealt out by key and sorted by key and order, then streamed through one machine a key;
    no key's rows are ever together in memory. Null keys are one key."""
    keys, values = list(keys), list(values)
    keep = keys if last else rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep) + f", `{name}` {kind}"
    names = [f.name for f in rows.schema.fields if f.name in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, machine, out, held = None, None, None, None
        for b in batches:
            got, done = [], []
            # a null number is a NaN here, which no NaN equals
            ids = list(zip(*[[None if x != x else x for x in b[k].tolist()] for k in keys], strict=True))
            for i, (key, args) in enumerate(zip(ids, zip(*[b[v].tolist() for v in values], strict=True), strict=True)):
                if key != now:
                    if last and held is not None:
                        done.append((*held, out))
                    now, machine = key, make()
                held = tuple(b.iloc[i][names]) if last and (i == 0 or ids[i - 1] != key) else held
                out = machine(*args)
                got.append(out)
            if last:
                yield pd.DataFrame(done, columns=[*names, name])
            else:
                yield b[names].assign(**{name: got})
        if last and held is not None:
            yield pd.DataFrame([(*held, out)], columns=[*names, name])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema)


def swept(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, options: Sequence[str], make: Callable[[], list]) -> DataFrame:
    """(keys, order, option, out): the outputs of one machine for each option, in one pass over the rows."""
    out = fold(rows.select(*keys, *order, value), keys, order, [value], lambda: Bank(make()), "__out", "array<double>")
    names = F.array(*[F.lit(o) for o in options])
    return out.select(*keys, *order, value, F.posexplode("__out").alias("__i", "out")).withColumn("option", F.element_at(names, F.col("__i") + 1)).drop("__i")


def kalman_sweep(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, grid: Sequence[tuple[float, float]], warm_up: int = 5, p0: float = 100.0) -> DataFrame:
    """Per key and (q, r): root mean square, median and deviation of the innovations after warm-up."""
    options = [f"q={q:g} r={r:g}" for q, r in grid]
    out = swept(rows, keys, order, value, options, lambda: [Kalman(q, r, p0, predict_first=True, innovation=True) for q, r in grid])
    place = F.row_number().over(Window.partitionBy(*keys, "option").orderBy(*order))
    late = out.withColumn("__n", place).where(F.col("__n") > warm_up)
    return late.groupBy(*keys, "option").agg(F.sqrt(F.avg(F.col("out") * F.col("out"))).alias("rms"), F.percentile("out", 0.5).alias("median"), F.stddev_pop("out").alias("std"))


def noise_sweep(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alphas: Sequence[float]) -> DataFrame:
    """Per key and weight of the past: mean absolute difference of successive values before and after
    smoothing, and its reduction in per cent."""
    out = swept(rows, keys, order, value, [f"{a:g}" for a in alphas], lambda: [Ema(1 - a) for a in alphas])
    w = Window.partitionBy(*keys, "option").orderBy(*order)
    d = out.withColumns({"__a": F.abs(F.col(value) - F.lag(value).over(w)), "__b": F.abs(F.col("out") - F.lag("out").over(w))})
    got = d.groupBy(*keys, "option").agg(F.avg("__a").alias("raw_noise"), F.avg("__b").alias("smooth_noise"))
    return got.withColumn("reduction_pct", 100 * (1 - F.col("smooth_noise") / (F.col("raw_noise") + 1e-9)))


def verify_chain(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, signature: str, key: bytes) -> DataFrame:
    """rows with valid: whether the signature follows from the text and the signature before."""
    prev = F.lag(signature).over(_order(keys, order))

    @F.pandas_udf("boolean")
    def check(t: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
        sign = lambda a, q: hmac.new(key, json.dumps({"prev": q, "text": a}, sort_keys=True).encode(), hashlib.sha256).hexdigest()
        return pd.Series([sign(a, None if q is None or q != q else q) == b for a, b, q in zip(t, s, p, strict=True)])

    return rows.withColumn("__p", prev).withColumn("valid", check(text, signature, "__p")).drop("__p")
