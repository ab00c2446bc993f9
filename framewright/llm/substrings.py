"""Substring dedup with a log-structured fingerprint index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, bounded_batches, bytes_of, checkpoint, gram_hashes, ids_of, mix64, partitions, remove, shared, shuffle_partitions, text_slices, written, WordHash

#: Words of a window and of an anchor; batches of a whole corpus; runs that are kept apart.
WINDOW, ANCHOR, BATCHES, FANOUT = 50, 13, 4, 2
#: Bits of a filter that is sent to every worker: 8 MB whatever the input.
FILTER_BITS = 2**26
#: Rows of a bucket of an index that is begun with few.
ROWS_A_BUCKET = 400_000


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least value of each run of n."""
    out, size = x, 1
    while 2 * size <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = n - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Windows:
    """Windows of a slice of texts: window i starts at word `at[i]` of text `of[i]`. `anchors` has the
    least hash of `anchor` successive words in each; equal windows have equal anchors. Successive windows
    of a text with one anchor are a block."""

    def __init__(self, texts: list[bytes | None], known: WordHash, window: int, anchor: int) -> None:
        words = [t.split() if t else [] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        h = np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        if len(h) < window:
            self.of = self.at = np.empty(0, np.int64)
            self.hashes = self.anchors = np.empty(0, np.uint64)
            return
        hashes = gram_hashes(h, window)
        anchors = sliding_min(gram_hashes(h, anchor), window - anchor + 1)
        of = np.repeat(np.arange(len(texts)), sizes)[: len(hashes)]
        ok = np.flatnonzero(np.arange(len(hashes)) + window <= ends[of])
        self.of, self.hashes, self.anchors = of[ok], hashes[ok], anchors[ok]
        self.at = ok - (ends - sizes)[self.of]

    def keep(self, hit: np.ndarray) -> None:
        self.of, self.at, self.hashes, self.anchors = self.of[hit], self.at[hit], self.hashes[hit], self.anchors[hit]

    def runs(self, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First windows, and numbers, of successive windows of a text that agree in the columns."""
        new = np.ones(len(self.of), bool)
        new[1:] = (self.of[1:] != self.of[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        return starts, np.diff(starts, append=len(new))

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows, and hash of each block; the hash is of all its windows."""
        starts, n = self.runs(self.anchors)
        sums = np.add.reduceat(self.hashes, starts) if len(starts) else np.empty(0, np.uint64)
        return starts, n, mix64(sums + n.astype(np.uint64))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


class Filter:
    """A set of hashes as bits, two for each: holds() has no false negatives. It has 16 bits a hash, but
    FILTER_BITS at most, which is 8 MB whatever the input; with over about 3e7 hashes it lets most
    others through."""

    def __init__(self, hashes: DataFrame, column: str) -> None:
        n = hashes.count()
        self.empty, self.bits = not n, min(FILTER_BITS, 2 ** max(12, (16 * n).bit_length()))
        h = F.col(column)
        low, high = (x.bitwiseAND(F.lit(self.bits - 1)) for x in (h, F.shiftrightunsigned(h, 32)))
        places = hashes.select(F.explode(F.array(low, high)).alias("place"))
        words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")).toArrow()
        self.table = np.zeros(self.bits // 64, np.uint64)
        self.table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        h, out, mask = h.view(np.uint64), np.ones(len(h), bool), np.uint64(self.bits - 1)
        for p in (h & mask, h >> np.uint64(32) & mask):
            out &= (self.table[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


class SortedRuns:
    """Rows with a key each, in immutable runs that are bucketed and sorted by key, so that they are
    merge-joined bucket by bucket without a shuffle. Beyond `fanout` runs, all are merged into one.
    `merge` says how the values of equal keys become one. All runs have as many buckets: one for
    ROWS_A_BUCKET of the rows that are expected, but no more than there are shuffle partitions."""

    def __init__(self, spark: SparkSession, keys: list[str], merge: dict, fanout: int) -> None:
        self.spark, self.keys, self.merge, self.fanout = spark, keys, merge, fanout
        self.root, self.names, self.made, self.buckets = shared(spark, "fingerprints"), [], 0, partitions(spark)

    def expect(self, rows: int) -> None:
        if not self.made:
            self.buckets = max(1, min(self.buckets, -(-rows // ROWS_A_BUCKET)))

    def write(self, rows: DataFrame) -> str:
        """A run of rows with unique keys, which does not belong to the index yet. Rows that are grouped by
        the keys are shuffled into as many partitions as there are buckets, so that each bucket
        is one file: otherwise each task would write a file for nearly every bucket."""
        self.made += 1
        name = f"run_{self.root.rsplit('-', 1)[-1]}_{self.made}"
        with shuffle_partitions(self.spark, self.buckets):
            rows.coalesce(self.buckets).write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.root}/{self.made}").saveAsTable(name)
        return name

    def look(self, name: str) -> DataFrame:
        """The rows of a new run, merge-joined with all others: old_<value> is null for new keys."""
        out = self.spark.table(name)
        for i, old in enumerate(self.names):
            past = self.spark.table(old).select(*self.keys, *[F.col(v).alias(f"{v}_{i}") for v in self.merge])
            out = out.join(past.hint("merge"), self.keys, "left")
        of = {F.min: F.least, F.max: F.greatest}
        null = F.lit(None).cast("long")
        old = {f"old_{v}": of[f](null, null, *[F.col(f"{v}_{i}") for i in range(len(self.names))]) for v, f in self.merge.items()}
        return out.select(*self.spark.table(name).columns, *[c.alias(k) for k, c in old.items()])

    def add(self, name: str) -> None:
        self.names.append(name)
        if len(self.names) > self.fanout:
            every = self.spark.table(self.names[0]).select(*self.keys, *self.merge)
            for r in self.names[1:]:
                every = every.unionAll(self.spark.table(r).select(*self.keys, *self.merge))
            new = self.write(every.groupBy(*self.keys).agg(*[f(v).alias(v) for v, f in self.merge.items()]))
            self.close()
            self.names = [new]

    def close(self) -> None:
        for r in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")
            remove(self.spark, f"{self.root}/{r.rsplit('_', 1)[-1]}")
        self.names = []


class FingerprintIndex:
    """What the documents so far hold, for finding their windows in later batches.

    Its first runs have a row for each anchor: the least and largest hash of the blocks that it was
    seen in, and its smallest document. While both are equal, all windows with this anchor, in whatever
    document, are those of one block, and one row stands for all. An anchor in different blocks
    is open: the second runs have all its windows, each with its smallest document.

    append() merge-joins a batch with both and returns the places to drop. Of earlier texts it
    reads again those documents whose anchors become open with this batch, one for each such anchor.
    Equality is that of an anchor's 64 bits together with 64 bits of the block or window.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, anchor: int = ANCHOR, fanout: int = FANOUT) -> None:
        self.window, self.anchor, self.corpus = window, anchor, []
        self.anchors = SortedRuns(spark, ["hash"], {"lo": F.min, "hi": F.max, "first": F.min}, fanout)
        self.windows = SortedRuns(spark, ["hash", "window"], {"first": F.min}, fanout)

    def _blocks(self, docs: DataFrame) -> DataFrame:
        window, anchor = self.window, self.anchor

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHash()
            for b in text_slices(batches, "text"):
                w = Windows(bytes_of(b.column(2)), known, window, anchor)
                starts, n, block = w.blocks()
                of = w.of[starts]
                cols = [w.anchors[starts], block, ids_of(b.column(0))[of], b.column(1).to_numpy()[of], w.at[starts], n]
                yield pa.RecordBatch.from_arrays([_long(x) for x in cols], names=["hash", "block", "doc_id", "version", "at", "n"])

        return docs.select("doc_id", "version", "text").mapInArrow(find, "hash long, block long, doc_id long, version long, at long, n long")

    def _open_windows(self, docs: DataFrame, key: str, wanted: Filter, anchors: Filter) -> DataFrame:
        """The windows with one of the anchors, and few others, in documents whose `key` is wanted."""
        window, anchor = self.window, self.anchor

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHash()
            for b in batches:
                b = b.filter(pa.array(wanted.holds(b.column(3).to_numpy())))
                for part in text_slices(iter([b]), "text"):
                    w = Windows(bytes_of(part.column(2)), known, window, anchor)
                    w.keep(anchors.holds(w.anchors))
                    starts, n = w.runs(w.anchors, w.hashes)
                    of = w.of[starts]
                    cols = [w.anchors[starts], w.hashes[starts], ids_of(part.column(0))[of], part.column(1).to_numpy()[of], w.at[starts], n]
                    yield pa.RecordBatch.from_arrays([_long(x) for x in cols], names=["hash", "window", "doc_id", "version", "at", "n"])

        own = docs.select("doc_id", "version", "text", F.xxhash64("doc_id").alias("__id") if key == "doc_id" else F.col(key).alias("__id"))
        return own.mapInArrow(find, "hash long, window long, doc_id long, version long, at long, n long")

    def append(self, docs: DataFrame, expected: int = 8) -> DataFrame:
        """Adds a batch (doc_id, version, text), without null ids; `expected` is how many such batches will come; (doc_id, version, at, n): the n windows
        from word `at` on of a text that a smaller document of this or an earlier batch has as well."""
        raw, raw_path = written(self._blocks(docs))
        n = raw.count()
        self.anchors.expect(expected * n)
        self.windows.expect(expected * n)
        run = self.anchors.write(raw.groupBy("hash").agg(F.min("block").alias("lo"), F.max("block").alias("hi"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
        lo, hi = F.least("lo", "old_lo"), F.greatest("hi", "old_hi")
        met = self.anchors.look(run).where("first < last or lo < hi or old_first is not null")
        met = checkpoint(met.select("hash", F.least("first", "old_first").alias("first"), (lo < hi).alias("open"), ((lo < hi) & (F.col("old_lo") == F.col("old_hi"))).alias("opened"), "old_first"), n)
        self.anchors.add(run)
        hits = raw.join(met.select("hash", "first", "open"), "hash").where("open or first < doc_id")
        hits = checkpoint(hits.select("doc_id", "version", "at", "n", "open"), n)
        whole = hits.where("not open").drop("open")
        history, self.corpus = self.corpus, [*self.corpus, docs]
        anchors = Filter(met.where("open"), "hash")
        remove(docs.sparkSession, raw_path)
        if anchors.empty:
            return whole
        rows, rows_path = written(self._open_windows(docs, "version", Filter(hits.where("open").select("version").distinct(), "version"), anchors))
        seen = rows.select("hash", "window", "doc_id")
        opened = met.where("opened")
        wanted = Filter(opened.select(F.xxhash64("old_first").alias("id")).distinct(), "id")
        if not wanted.empty:
            anchors = Filter(opened, "hash")
            past = reduce(DataFrame.unionAll, history)
            seen = seen.unionAll(self._open_windows(past, "doc_id", wanted, anchors).select("hash", "window", "doc_id"))
        run = self.windows.write(seen.groupBy("hash", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
        # written, so that both sides of the join are dealt anew and a very common window can be split
        firsts = checkpoint(self.windows.look(run).where("first < last or old_first is not null").select("hash", "window", F.least("first", "old_first").alias("first")), n)
        single = checkpoint(rows.join(firsts, ["hash", "window"]).where("first < doc_id").select("doc_id", "version", "at", "n"), n)
        self.windows.add(run)
        remove(docs.sparkSession, rows_path)
        return whole.unionAll(single)

    def close(self) -> None:
        """Drops all runs with their files."""
        self.anchors.close()
        self.windows.close()


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs in n parts of about equal counts, by rising doc_id."""
    cuts = sorted({min(int(x), int(NULL_ID) - 1) for x in docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [k / n for k in range(1, n)], 0.01)} if n > 1 else set())
    if not cuts:
        return [docs]
    i = F.col("doc_id")
    out = [docs.where(i <= cuts[0])]
    out += [docs.where((i > a) & (i <= b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [*out, docs.where(i > cuts[-1])]


def drop_repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, fanout: int = FANOUT, name: str = "text", index: FingerprintIndex | None = None) -> DataFrame:
    """docs with the words gone that a window covers whose words also start in a document with a
    smaller doc_id; adds __n_words, __n_removed, __sha (of the kept words), and sets `name` to
    the kept words joined by one space.

    A window is `window` successive words, unchanged; its anchor is the least hash of `anchor` words in
    it. Documents go to a log-structured index (FingerprintIndex) in batches by rising doc_id;
    each batch is merge-joined with the sorted runs of those before, which yields its places to drop.
    With an `index` that holds earlier documents already, docs are what is new: they are held against
    the earlier ones without hashing these again, and join the index, which stays open.

    Null and empty texts have no words. A null doc_id counts as the largest. Rows that share a
    doc_id are one document; places are gathered by id and text, so many rows of one id, or
    without one, don't meet in one place. Texts shorter than a window stay. Other columns stay as
    they are; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    base = docs.withColumns({"__id": F.coalesce(docs["doc_id"].cast("long"), F.lit(int(NULL_ID))), "__v": F.xxhash64(F.col(name))})
    own = base.select(F.col("__id").alias("doc_id"), F.col("__v").alias("version"), F.col(name).alias("text"))
    found, into = None, index or FingerprintIndex(docs.sparkSession, window, anchor, fanout)
    window = into.window
    for part in batches_of(own, batches):
        got = into.append(part, batches)
        found = got if found is None else found.unionAll(got)
    if index is None:
        into.close()
    drops = found.groupBy(F.col("doc_id").alias("__d"), F.col("version").alias("__w")).agg(F.collect_set(F.struct("at", "n")).alias("__drop"))
    both = base.join(drops, (base["__id"] == drops["__d"]) & (base["__v"] == drops["__w"]), "left").drop("__id", "__v", "__d", "__w")
    names = [c for c in both.columns if c != "__drop"]
    at = names.index(name)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, name):
            texts, n_words, n_removed, sha = [], [], [], []
            drops = b.column(len(names))
            for i, text in enumerate(bytes_of(b.column(at))):
                words = text.split() if text else []
                kept = words
                if drops[i].is_valid:
                    first, n = (x.to_numpy() for x in drops[i].values.flatten())
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + n - 1 + window, -1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                out = b" ".join(kept)
                texts.append(out)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(out).hexdigest())
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=[*names, "__n_words", "__n_removed", "__sha"])

    schema = T.StructType([*[f for f in both.schema.fields if f.name != "__drop"], T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType()), T.StructField("__sha", T.StringType())])
    return both.mapInArrow(rewrite, schema)


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_windows(docs).select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__sha").alias("kept_sha256"))


QUERIES = {"op6_substrings": op6_substrings}
