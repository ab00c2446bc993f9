"""URL filters: rules, and the likelihood ratio of two character language models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import bytes_of, checkpoint, mix64, text_slices

#: (verdict, host, path): fixed values of the query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Longest context; strength of the shorter context's estimate.
ORDER, STRENGTH = 5, 2.0
#: Range and number of bins of the length-normalised difference, for calibration.
SPAN, BINS = 4.0, 800
_SYMBOLS = 256
#: Bytes of the urls that are counted or scored at once.
_BLOCK = 250_000


class Rules:
    """The longest rule whose host is the url's or above it, and whose path starts the url's."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, host + path, verdict))

    def __call__(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, parts = ("", None), host.split(".")
        for k in range(len(parts)):
            for start, name, verdict in self.by_host.get(".".join(parts[k:]), ()):
                if path.startswith(start) and len(name) > len(best[0]):
                    best = (name, verdict)
        return (best[0], best[1]) if best[1] else (None, None)


def contexts(urls: list[bytes], order: int = ORDER, buckets: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character of each url, with an end mark: its url; per order from 0 up the key of its
    context; and that of context and character.

    A key holds the order, the kind and the characters themselves, so no two share one. With
    buckets, keys are hashed into so many per order and kind.
    """
    if order > 6:
        raise ValueError("a key holds 7 characters")
    pad = b"\x02" * order
    flat = np.frombuffer(b"".join(pad + u + b"\x03" for u in urls), np.uint8).astype(np.int64)
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    of = np.repeat(np.arange(len(urls)), sizes)
    at = np.arange(len(of)) + (of + 1) * order
    ctx, both = np.empty((order + 1, len(at)), np.int64), np.empty((order + 1, len(at)), np.int64)
    last = np.zeros(len(at), np.int64)
    for k in range(order + 1):
        if k:
            last += flat[at - k] << 8 * (k - 1)
        ctx[k] = last + (2 * k << 56)
        both[k] = (last << 8) + flat[at] + (2 * k + 1 << 56)
    if buckets:
        ctx, both = ((mix64(x.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64) for x in (ctx, both))
    return of, ctx, both


def _cells(side: np.ndarray, ctx: np.ndarray, both: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Places of both kinds of counts in one flat table of (class, order, kind, bucket)."""
    k = np.arange(order + 1)[:, None]
    base = (side[None, :] * (order + 1) + k) * 2
    return np.concatenate([(base * buckets + ctx).ravel(), ((base + 1) * buckets + both).ravel()])


def _difference(urls: list[bytes], of: np.ndarray, ctx: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Mean log-likelihood difference per character, accepted less rejected, from the counts (class,
    order, character) of contexts and of contexts with characters; empty urls: 0."""
    logs = []
    for side in (0, 1):
        p = np.full(len(of), 1 / _SYMBOLS)
        for n, m in zip(ctx[side], both[side], strict=True):
            p = (m + STRENGTH * p) / (n + STRENGTH)
        logs.append(np.bincount(of, np.log(np.minimum(p, 1.0)), len(urls)))
    sizes = np.array([len(u) for u in urls])
    return np.where(sizes > 0, (logs[1] - logs[0]) / (sizes + 1), 0.0)


class LanguageModels:
    """Interpolated Markov models of order 0 to ORDER for rejected (0) and accepted (1) urls, whose
    counts stand in one table of hashed keys; for few urls, in memory."""

    def __init__(self, table: np.ndarray, order: int, buckets: int) -> None:
        self.table, self.order, self.buckets = table.reshape(2, order + 1, 2, buckets), order, buckets

    def difference(self, urls: list[bytes]) -> np.ndarray:
        if not urls:
            return np.empty(0)
        of, ctx, both = contexts(urls, self.order, self.buckets)
        k = np.arange(self.order + 1)[:, None]
        return _difference(urls, of, self.table[:, k, 0, ctx], self.table[:, k, 1, both])


class CountedModels:
    """The same models over a distributed table (key, rejected, accepted) of exact keys."""

    def __init__(self, counts: DataFrame, order: int = ORDER) -> None:
        self.counts, self.order, self.threshold = counts, order, 0.0

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds the column difference to rows with a string column url.

        Rows are dealt into blocks of bounded size. A block asks once for each key in its urls, so a
        key that all urls have is asked for as often as there are blocks; what the table has of the
        keys comes back to the block.
        """
        order, names = self.order, rows.columns
        place = names.index("url")

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = TaskContext.get().partitionId() << 32
            for block, b in enumerate(text_slices(batches, "url", _BLOCK), first):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, block))], names=[*names, "__block"])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                urls, blocks = bytes_of(b.column(0)), b.column(1).to_numpy()
                for block in np.unique(blocks):
                    _, ctx, both = contexts([urls[i] for i in np.flatnonzero(blocks == block)], order)
                    keys = np.unique(np.concatenate([ctx.ravel(), both.ravel()]))
                    for at in range(0, len(keys), 100_000):
                        k = keys[at : at + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(k)], names=["__block", "key"])

        def answer(block: pa.Table, found: pa.Table) -> pa.Table:
            urls = bytes_of(block.column(place))
            of, ctx, both = contexts(urls, order)
            keys = found["key"].to_numpy()
            sort = np.argsort(keys)
            keys = np.append(keys[sort], np.iinfo(np.int64).max)
            n = np.stack([np.append(found[c].to_numpy()[sort], 0) for c in ("rejected", "accepted")])

            def look(x: np.ndarray) -> np.ndarray:
                i = np.searchsorted(keys, x)
                return np.where(keys[i] == x, n[:, i], 0)

            return block.select(names).append_column("difference", pa.array(_difference(urls, of, look(ctx), look(both)), pa.float64()))

        dealt = checkpoint(rows.mapInArrow(deal, StructType([*rows.schema, StructField("__block", LongType())])))
        asked = dealt.select("url", "__block").mapInArrow(ask, "__block long, key long")
        found = asked.join(self.counts, "key").select("__block", "key", "rejected", "accepted")
        return dealt.groupBy("__block").cogroup(found.groupBy("__block")).applyInArrow(answer, StructType([*rows.schema, StructField("difference", DoubleType())]))

    def difference(self, urls: list[bytes]) -> np.ndarray:
        """The differences of a few urls, through score()."""
        rows = [(i, u.decode()) for i, u in enumerate(urls)]
        got = self.score(self.counts.sparkSession.createDataFrame(rows, "i long, url string")).orderBy("i").toArrow()
        return got["difference"].to_numpy()


def train(labelled: DataFrame, order: int = ORDER) -> CountedModels:
    """Models from rows (url, accepted). Four fifths of the urls, by CRC-32, are counted, the
    others set the threshold of the difference with the best balanced accuracy.

    Counts are kept by the characters of each context in a distributed table, which grows with the
    number of different contexts. They are summed where rows are read before they are dealt, so
    a very common host does not make a task larger.
    """
    held = F.crc32(F.col("url").cast("binary")) % 5 == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "url", _BLOCK):
            of, ctx, both = contexts(bytes_of(b.column(0)), order)
            side = b.column(1).to_numpy(zero_copy_only=False)[of]
            keys, at = np.unique(np.concatenate([ctx.ravel(), both.ravel()]), return_inverse=True)
            accepted = np.bincount(at, np.tile(side, 2 * (order + 1)), len(keys)).astype(np.int64)
            rejected = np.bincount(at, minlength=len(keys)) - accepted
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (keys, rejected, accepted)], names=["key", "rejected", "accepted"])

    rows = labelled.select("url", "accepted")
    counts = rows.where(~held).mapInArrow(count, "key long, rejected long, accepted long").groupBy("key").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted"))
    models = CountedModels(checkpoint(counts), order)

    at_bin = F.floor((F.col("difference") + SPAN) / (2 * SPAN) * BINS)
    at_bin = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), at_bin)).cast("int")
    counts = np.zeros((2, BINS))
    for r in models.score(rows.where(held)).groupBy(at_bin.alias("bin"), "accepted").count().collect():
        counts[int(r["accepted"]), r["bin"]] = r["count"]
    if counts.sum(1).all():
        below = np.concatenate([np.zeros((2, 1)), np.cumsum(counts, 1)], axis=1) / counts.sum(1, keepdims=True)
        gain = below[0] - below[1]  # rejected urls under the threshold less accepted ones under it
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        edge = best[np.abs(best - BINS / 2).argmin()]
        models.threshold = float(edge / BINS * 2 * SPAN - SPAN)
    return models


def split_url(pages: DataFrame, name: str = "url") -> DataFrame:
    """pages with __host and __path."""
    url = F.coalesce(F.col(name), F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"__host": lower, "__path": path})


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, name: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, difference) for each row of pages.

    The rules decide where one fits. All urls that they accept and reject, over the whole table,
    teach two smoothed Markov models of characters over host and path; the other urls are
    accepted if the accepting model explains them better, by the calibrated threshold per character.

    A null url or one without :// has an empty host and path, difference 0 and is allowed, as there is
    nothing against it. If the rules fit no url, or only one side, the threshold is 0. Repeated
    rows have equal verdicts; other columns are ignored; an empty table gives an empty result.
    """
    judge = Rules(rules)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in got], pa.string()), pa.array([v for _, v in got], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    named = split_url(pages.select("page_id", name), name).select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"))
    ruled = named.mapInArrow(apply, f"page_id {kind}, host string, path string, rule string, verdict string")
    ruled = ruled.withColumn("url", F.concat("host", "path"))
    models = train(ruled.where("verdict is not null").select("url", (F.col("verdict") == "allow").alias("accepted")))
    told = F.when((F.col("difference") >= models.threshold) | (F.col("url") == ""), "allow").otherwise("block")
    return models.score(ruled).select("page_id", "host", "path", "rule", F.coalesce("verdict", told).alias("verdict"), "difference")


def op7_urls(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


QUERIES = {"op7_urls": op7_urls}
