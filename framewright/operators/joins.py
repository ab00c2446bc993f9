"""Joins: overlaps, Hamming distance, nearest time, fallback keys and dimensions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from framewright.functions.arrays import hamming

from .ranks import carried
from .storage import checkpoint, partitions, remove, written


def overlap_classes(left: DataFrame, right: DataFrame, key: Column | str, left_id: str, right_id: str) -> DataFrame:
    """(key, left_id, right_id, n_left, n_right): a row for each key that both sides have, with its first
    ids and sizes, however many pairs that makes; null and empty keys match nothing."""
    k = F.col(key) if isinstance(key, str) else key
    side = lambda d, i, n: d.select(F.nullif(k.cast("string"), F.lit("")).alias("key"), F.col(i).alias("__i")).where("key is not null").groupBy("key").agg(F.min("__i").alias(f"{n}_id"), F.count(F.lit(1)).alias(f"n_{n}"))
    return side(left, left_id, "left").join(side(right, right_id, "right"), "key").select("key", "left_id", "right_id", "n_left", "n_right")


def overlap_pairs(left: DataFrame, right: DataFrame, key: Column | str, left_id: str, right_id: str) -> DataFrame:
    """All pairs of rows with an equal key; null and empty keys match nothing."""
    k = F.col(key) if isinstance(key, str) else key
    side = lambda d, i, n: d.select(F.nullif(k.cast("string"), F.lit("")).alias("__k"), F.col(i).alias(n)).where("__k is not null")
    return side(left, left_id, "left_id").join(side(right, right_id, "right_id"), "__k").select(F.col("__k").alias("key"), "left_id", "right_id")


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left that have an equal key in right."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def without(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left without an equal key in right."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def bands(bits: int, n: int) -> list[tuple[int, int]]:
    """(shift, width) of n parts of the bits."""
    edges = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def hamming_classes(left: DataFrame, right: DataFrame | None, hash_column: str, distance: int, off: int = 1) -> DataFrame:
    """(h_a, h_b, distance) of all different pairs of distinct 64-bit hashes at most `distance` apart.

    Pigeonhole blocking: the bits are cut into bands, of which one has at most `off` bits that differ;
    each hash of one side is looked up by its bands, the other also by what differs from them in
    up to `off` bits. A pair counts in the first band in which it meets, so none is lost or
    comes twice. Without `right` it is a self-join with h_a < h_b."""
    parts = bands(64, max(1, -(-(distance + 1) // (off + 1))))
    h = F.col(hash_column)
    each = lambda d, n: d.where(h.isNotNull()).select(h.alias(n)).distinct()
    band = lambda c, s, w: F.shiftrightunsigned(c, s).bitwiseAND(F.lit((1 << w) - 1))

    def masks(w: int) -> list[int]:
        out = [0]
        for n in range(1, off + 1):
            out += [sum(1 << i for i in c) for c in combinations(range(w), n)]
        return out

    near = F.array(*[F.struct(F.lit(i).alias("band"), band(F.col("h_a"), s, w).bitwiseXOR(F.lit(m).cast("long")).alias("part")) for i, (s, w) in enumerate(parts) for m in masks(w)])
    x = each(left, "h_a").select("h_a", F.inline(near))
    y = each(left if right is None else right, "h_b").select("h_b", F.posexplode(F.array(*[band(F.col("h_b"), s, w) for s, w in parts])).alias("band", "part"))
    diff = F.col("h_a").bitwiseXOR(F.col("h_b"))
    first = reduce(lambda acc, i: acc.when(F.bit_count(band(diff, *parts[i])) <= off, i), range(1, len(parts)), F.when(F.bit_count(band(diff, *parts[0])) <= off, 0))
    met = x.join(y, ["band", "part"]).where((hamming(F.col("h_a"), F.col("h_b")) <= distance) & (first == F.col("band")))
    met = met.select("h_a", "h_b", hamming(F.col("h_a"), F.col("h_b")).alias("distance"))
    return met.where("h_a < h_b") if right is None else met


def hamming_pairs(left: DataFrame, right: DataFrame | None, hash_column: str, id_column: str, distance: int) -> DataFrame:
    """(a, b, distance) of all pairs of rows whose 64-bit hashes are at most `distance` bits apart;
    without `right` a self-join with a < b. Hashes are compared once for all rows that have them."""
    h, i = F.col(hash_column), F.col(id_column)
    a = left.where(h.isNotNull()).select(h.alias("h_a"), i.alias("a"))
    b = (left if right is None else right).where(h.isNotNull()).select(h.alias("h_b"), i.alias("b"))
    if right is not None:
        return hamming_classes(left, right, hash_column, distance).join(a, "h_a").join(b, "h_b").select("a", "b", "distance")
    far = hamming_classes(left, None, hash_column, distance).join(a, "h_a").join(b, "h_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    return far.unionAll(a.join(b, F.col("h_a") == F.col("h_b")).where("a < b").select("a", "b", F.lit(0).alias("distance")))


def _near_in_cell(distance: int):
    """The pairs of a cell: rows come sorted by key, which is twice the cell's number, and one more for its
    second block. A cell of one block has its pairs once.

    Rows are put in order of their distance from that of some of its hashes which keeps most pairs
    apart: by the triangle inequality only neighbours in this order can be near. These are
    compared a tile at a time, and found pairs leave a batch at a time."""

    def pairs(left: pa.RecordBatch, right: pa.RecordBatch, same: bool) -> Iterator[pa.RecordBatch]:
        a, b = (x.column("h").to_numpy().view(np.uint64) for x in (left, right))
        share = lambda x, p: np.bincount(np.bitwise_count(x ^ p), minlength=65) / len(x)
        close = np.abs(np.subtract.outer(np.arange(65), np.arange(65))) <= distance
        pivot = min(a[:: max(1, len(a) // 16)][:16], key=lambda p: share(a, p) @ close @ share(b, p))
        far_a, far_b = np.bitwise_count(a ^ pivot), np.bitwise_count(b ^ pivot)
        at, to = np.argsort(far_a, kind="stable"), np.argsort(far_b, kind="stable")
        a, b, far_a, far_b = a[at], b[to], far_a[at].astype(int), far_b[to].astype(int)
        found, waiting = [], 0

        def out() -> pa.RecordBatch:
            i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
            x, y = left.take(pa.array(at[i])), right.take(pa.array(to[j]))
            return pa.RecordBatch.from_arrays([x.column("id"), x.column("n"), y.column("id"), y.column("n"), pa.array(d.astype(np.int32))], names=["id_a", "n_a", "id_b", "n_b", "distance"])

        for r in range(0, len(a), 32):
            some = a[r : r + 32, None]
            low, high = np.searchsorted(far_b, [far_a[r] - distance, far_a[min(r + 32, len(a)) - 1] + distance + 1])
            for c in range(max(low, r) if same else low, high, 4096):
                d = np.bitwise_count(some ^ b[c : min(c + 4096, high)])
                i, j = np.divmod(np.flatnonzero(d <= distance), d.shape[1])
                if same:
                    i, j = (x[j + c > i + r] for x in (i, j))
                if len(i):
                    found.append((i + r, j + c, d[i, j]))
                    waiting += len(i)
                if waiting >= 50_000:
                    yield out()
                    found, waiting = [], 0
        if found:
            yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, ([], [])

        def cell() -> Iterator[pa.RecordBatch]:
            own = [pa.Table.from_batches(x).combine_chunks().to_batches()[0] for x in blocks if x]
            if now is not None and (len(own) == 2 or now[1]):
                yield from pairs(own[0], own[-1], now[1])

        for b in batches:
            keys = b.column("key").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for x, y in zip(edges, edges[1:], strict=False):
                if x == y:
                    continue
                own = (int(keys[x]) // 2, b.column("same")[x].as_py())
                if own != now:
                    yield from cell()
                    now, blocks = own, ([], [])
                blocks[int(keys[x]) % 2].append(b.slice(x, y - x))
        yield from cell()

    return run


def hamming_links(rows: DataFrame, hash_column: str, id_column: str, distance: int, block: int = 1 << 18) -> DataFrame:
    """(a, b, distance, n_a, n_b): pairs of classes of equal hashes, each named by its smallest id, with the
    sizes of both; copies add no pairs, and classes without an id have none.

    Texts of one language share most bits, so their pairs grow nearly by the square and no blocking by bits
    keeps them few. Classes are dealt into g blocks, and each two blocks meet in one cell, which
    holds `block` rows of each at about most. So a class is copied g times and a pair leaves the
    task that finds it: nothing but the result grows with the pairs, and only the cells' work."""
    spark = rows.sparkSession
    of = rows.where(F.col(hash_column).isNotNull()).groupBy(F.col(hash_column).alias("h")).agg(F.min(id_column).alias("id"), F.count(F.lit(1)).alias("n"))
    of = checkpoint(of.where("id is not null"))
    n = of.count()
    cells = lambda g: g * (g + 1) // 2
    g = next(g for g in count(1) if g * block >= n and (cells(g) >= partitions(spark) or g * 4096 >= n))
    mine, other = F.pmod(F.xxhash64("h"), F.lit(g)).cast("int"), F.col("other")
    low, high = F.least("mine", other), F.greatest("mine", other)
    dealt = of.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    dealt = dealt.select("h", "id", "n", (low * g - F.shiftright(low * (low - 1), 1) + high - low).alias("cell"), (F.col("mine") > other).cast("int").alias("second"), (F.col("mine") == other).alias("same"))
    dealt = dealt.repartitionById(cells(g), F.col("cell")).select((2 * F.col("cell") + F.col("second")).alias("key"), "same", "h", "id", "n").sortWithinPartitions("key")
    kind = of.schema["id"].dataType.simpleString()
    met = dealt.mapInArrow(_near_in_cell(distance), f"id_a {kind}, n_a long, id_b {kind}, n_b long, distance int")
    first = F.col("id_a") <= F.col("id_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return met.select(pick("id_a", "id_b").alias("a"), pick("id_b", "id_a").alias("b"), "distance", pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"))


def nearest(left: DataFrame, right: DataFrame, time: str, order: str, session: str | None = None, prefix: str = "near_", others: bool = True) -> DataFrame:
    """Each row of left with the row of right nearest in time, of its own session if that has any.
    Without `others`, rows whose session has none are left out instead of matched with any session's.

    Ties go to the smaller `order`; all columns of the match get the prefix, and `gap` is in
    seconds. No pairs are made: left and right are put in one order of session and time, in ranges, and
    the last match before and the first after each row are carried along, also from one range to the
    next. So neither a large session nor the rows whose session has no match fill one task.
    """
    names = right.columns
    body = F.struct(*[F.col(n) for n in names])
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    l0 = checkpoint(left.withColumn("__t", micros(time)).withColumn("__row", F.monotonically_increasing_id()))
    r0 = right.select(micros(time).alias("__t"), *([F.col(session).alias("__s")] if session else []), F.col(order).alias("__o"), body.alias("__m"))

    def within(lhs: DataFrame, rhs: DataFrame, part: Sequence[str]) -> DataFrame:
        """Adds __best: the match of each row of lhs among the rows of rhs with equal `part`."""
        a = lhs.select(*part, "__t", F.lit(None).cast(rhs.schema["__o"].dataType).alias("__o"), F.lit(None).cast(rhs.schema["__m"].dataType).alias("__m"), "__row")
        # of rows with equal time only the first by order can be a match
        one = rhs.groupBy(*part, "__t").agg(F.min_by("__m", "__o").alias("__m"), F.min("__o").alias("__o"))
        b = one.select(*part, "__t", "__o", "__m", F.lit(None).cast("long").alias("__row"))
        u = a.unionAll(b).withColumn("__at", F.coalesce("__row", F.lit(-1)))  # a match comes before rows of its time
        u = carried(u, part, ["__t", "__at"], F.when(F.col("__row").isNull(), F.struct("__t", "__o", "__m"))).where("__row is not null")
        cand = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.__t") - F.col("__t")).alias("gap"), F.col(f"{c}.__o").alias("o"), F.col(f"{c}.__m").alias("m")))
        p, n = cand("__prev"), cand("__next")
        key = lambda c: F.struct(c["gap"], c["o"])
        best = F.when(p.isNull(), n).when(n.isNull(), p).when(key(n) < key(p), n).otherwise(p)
        return u.select("__row", best.alias("__best"))

    if session is None:
        found = within(l0, r0, [])
    else:
        ls = l0.withColumn("__s", F.nullif(F.col(session), F.lit("")) if dict(left.dtypes)[session] == "string" else F.col(session))
        has = r0.where("__s is not null").select("__s").distinct()
        found = within(ls.join(has, "__s", "left_semi"), r0.where("__s is not null"), ["__s"])
        if others:
            found = found.unionAll(within(ls.join(has, "__s", "left_anti"), r0.drop("__s"), []))
    out = l0.join(found, "__row")
    return out.select(*left.columns, *[F.col(f"__best.m.{n}").alias(f"{prefix}{n}") for n in names], (F.col("__best.gap") / 1e6).alias("gap"))


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, value: str, tie: str) -> DataFrame:
    """Each row of left with the latest `value` of right at its time or before (null if none)."""
    a = left.withColumns({"__v": F.lit(None).cast(right.schema[value].dataType), "__side": F.lit(1)})
    b = right.select(*by, time, tie, F.col(value).alias("__v"), F.lit(0).alias("__side"))
    u = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, "__side", tie).rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("latest", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__v", "__side")


def fallback_join(rows: DataFrame, lookup: DataFrame, row_keys: Sequence[str], lookup_keys: Sequence[str], row_id: str, order: str) -> DataFrame:
    """Each row with the lookup row under the first of its keys that is known.

    A key leads to the lookup row that has it last by `order`; unmatched rows are dropped."""
    name = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    body = F.struct(*[F.col(c) for c in lookup.columns])
    index = lookup.select(F.explode(F.array(*[name(c) for c in lookup_keys])).alias("__k"), F.col(order).alias("__o"), body.alias("__m")).where("__k is not null").groupBy("__k").agg(F.max_by("__m", "__o").alias("__m"))
    tries = rows.select(F.col(row_id).alias("__id"), F.posexplode(F.array(*[name(c) for c in row_keys])).alias("__prio", "__k")).where("__k is not null")
    best = tries.join(index, "__k").groupBy("__id").agg(F.min_by("__m", "__prio").alias("__m"), F.min("__prio").alias("matched_key"))
    return rows.join(best, rows[row_id] == best["__id"]).select(*rows.columns, "matched_key", *[F.col(f"__m.{c}").alias(f"pred_{c}") for c in lookup.columns])


def overridden_lookup(rows: DataFrame, first: str, second: str, base: Sequence[tuple[str, str, float]], overrides: Sequence[tuple[str | None, str | None, str | None, float]]) -> DataFrame:
    """rows with (env, confidence): the first override (first, second, env, confidence) that fits,
    where None fits anything, else the base table by `first`. An override to None stops there.
    The tables are constants of a mapping file."""
    fits = lambda a, b: (F.lit(True) if a is None else F.col(first) == a) & (F.lit(True) if b is None else F.col(second) == b)
    pick = F.when(F.lit(False), F.struct(F.lit(None).cast("string").alias("env"), F.lit(0.0).alias("confidence")))
    for a, b, env, conf in overrides:
        pick = pick.when(fits(a, b), F.struct(F.lit(env).cast("string").alias("env"), F.lit(float(conf)).alias("confidence")))
    for a, env, conf in base:
        pick = pick.when(F.col(first) == a, F.struct(F.lit(env).alias("env"), F.lit(float(conf)).alias("confidence")))
    got = pick.otherwise(F.struct(F.lit(None).cast("string").alias("env"), F.lit(0.5).alias("confidence")))
    return rows.withColumn("__got", got).select(*rows.columns, "__got.env", "__got.confidence")


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer comparison of two runs: both means, their difference, and which side lacks a key."""
    x = a.groupBy(*keys).agg(F.avg(value).alias("mean_a"))
    y = b.groupBy(*keys).agg(F.avg(value).alias("mean_b"))
    missing = F.when(F.col("mean_a").isNull(), "a").when(F.col("mean_b").isNull(), "b")
    return x.join(y, list(keys), "full_outer").select(*keys, "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("delta"), missing.alias("missing"))


def one_to_one(candidates: DataFrame, left: str, right: str, gap: str) -> DataFrame:
    """Greedy matching by rising gap, then ids: each id is used once at most.

    A pair that is the best of both its ids is final; rounds of such pairs give the same result
    as going through the pairs in order, with joins instead of one sequential task."""
    spark = candidates.sparkSession
    rest, path = written(candidates.select(left, right, gap))
    out = spark.createDataFrame([], rest.schema)
    while True:
        order = F.struct(gap, left, right)
        by_left = rest.groupBy(left).agg(F.min(order).alias("__l"))
        by_right = rest.groupBy(right).agg(F.min(order).alias("__r"))
        best = rest.join(by_left, left).join(by_right, right).where((F.col("__l") == order) & (F.col("__r") == order)).select(left, right, gap)
        good = checkpoint(best)
        n = good.count()
        out = out.unionAll(good)
        if n:
            left_over, after = written(rest.join(good.select(left), left, "left_anti").join(good.select(right), right, "left_anti").select(left, right, gap))
        remove(spark, path)
        if not n:
            return out
        rest, path = left_over, after
        if rest.isEmpty():
            remove(spark, path)
            return out
