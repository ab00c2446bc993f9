"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.graph import components

from .common import NULL_ID, bounded_batches, bytes_of, checkpoint, gram_hashes, mix64, text_slices, WordHash

#: Words of a shingle; Jaccard similarity of a link in per cent; bands and their coordinates.
WORDS, PERCENT, BANDS, ROWS = 5, 80, 24, 5
#: Rows of one block in the comparison of what the hubs leave.
BLOCK, CHUNK = 256, 4096
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: bytes | None, known: WordHash, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles; of a shorter text, of all its words."""
    words = text.translate(_LETTERS).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < n:
        return mix64(gram_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(gram_hashes(h, n))


def signatures(values: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: one row of 32-bit coordinates for each set; sets are runs of `values`.

    The first permutation is the mixing that made the values, of which the upper 32 bits are
    taken. The second is a bijection of the 32-bit numbers; coordinate k is the least value of it
    with its argument shifted by k around the circle of 2**32 numbers.
    """
    first = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), coordinates), np.uint32)
    x, y = np.empty_like(first), np.empty_like(first)
    for k in range(coordinates):
        np.add(first, np.uint32(k), out=x)
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            if factor:
                np.multiply(x, np.uint32(factor), out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key for each set and band."""
    out = np.empty((len(signature), bands), np.int64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for c in range(rows):
            h = mix64(h + signature[:, b * rows + c].astype(np.uint64))
        out[:, b] = h.view(np.int64)
    return out


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))


def _sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, version, n_shingles, c1, c2, keys): c1, c2 hash the whole set; keys has its bands."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in text_slices(batches, "text"):
            sets = [shingles(t, known, words) for t in bytes_of(b.column(2))]
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            both = np.frombuffer(b"".join(ids), ">i8").reshape(-1, 2).astype(np.int64)
            flat = np.empty(0, np.int64)
            if len(some):
                values = np.concatenate([sets[i] for i in some])
                starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                flat = band_keys(signatures(values, starts, bands * rows), bands, rows).ravel()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes), pa.array(both[:, 0]), pa.array(both[:, 1]), _lists(flat, np.where(sizes > 0, bands, 0))], names=["doc_id", "version", "n_shingles", "c1", "c2", "keys"])

    return docs.mapInArrow(sketch, "doc_id long, version long, n_shingles long, c1 long, c2 long, keys array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(rep, keys, grams) of (rep, keys, text); grams are the sorted hashes as bytes."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in text_slices(batches, "text"):
            grams = [shingles(t, known, words).tobytes() for t in bytes_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(grams, pa.binary())], names=["rep", "keys", "grams"])

    return texts.mapInArrow(to_sets, "rep long, keys array<long>, grams binary")


def alike(common: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray, percent: int):
    return 100 * common >= percent * (a + b - common)


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of (a, b, x, y) whose sets x and y are alike."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                m, n = len(x) // 8, len(y) // 8
                if 100 * min(m, n) < percent * max(m, n):
                    continue
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if alike(len(np.intersect1d(x, y, assume_unique=True)), m, n, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), b.column(1).take(pa.array(keep, pa.int32()))], names=["a", "b"])

    return pairs.mapInArrow(verify, "a long, b long")


class _Block:
    """Up to BLOCK sets, against which others are compared all at once."""

    def __init__(self, reps: list[int], labels: list[int], keys: list[list[int]], grams: list[bytes]) -> None:
        self.reps, self.labels, self.keys = np.array(reps), np.array(labels), np.array(keys)
        sets = [np.frombuffer(g, np.uint64) for g in grams]
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.values, first = np.unique(values[order], return_index=True)
        self.owner, self.first = owner[order], np.append(first, len(values))

    def common(self, grams: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of each own set with the set of `grams`."""
        at = np.searchsorted(self.values, grams)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == grams)]
        if not len(at):
            return np.zeros(len(self.reps), np.int64)
        lengths = self.first[at + 1] - self.first[at]
        places = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        return np.bincount(self.owner[places], minlength=len(self.reps))


def _rest(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the outsiders of a bucket and all its members; rows come sorted by
    (bucket, block, chunk), outsiders (kind 0) before members (kind 1)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, block = None, [], None
        for b in batches:
            a, z = [], []
            bucket, blk, chunk, kind, rep, label, band = (b.column(i).to_pylist() for i in range(7))
            keys, grams = b.column(7).to_pylist(), b.column(8).to_pylist()
            for i in range(b.num_rows):
                now = (bucket[i], blk[i], chunk[i])
                if now != part:
                    part, waiting, block = now, [], None
                if kind[i] == 0:
                    waiting.append((rep[i], label[i], keys[i], grams[i]))
                    continue
                if block is None:
                    if not waiting:
                        continue
                    block = _Block(*map(list, zip(*waiting, strict=True)))
                mine = np.frombuffer(grams[i], np.uint64)
                # a pair is compared in the first band that it shares, and if no path links it yet
                want = (block.labels != label[i]) & ~(block.keys[:, : band[i]] == np.array(keys[i][: band[i]])).any(axis=1)
                want &= 100 * np.minimum(block.sizes, len(mine)) >= percent * np.maximum(block.sizes, len(mine))
                if not want.any():
                    continue
                got = want & alike(block.common(mine), block.sizes, len(mine), percent)
                for other in block.reps[got]:
                    a.append(rep[i])
                    z.append(int(other))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, version, component_version) for each row of docs.

    Documents with equal shingle sets become one class at once (partial aggregation on a 128-bit
    hash), so exact copies cost a row each and no pair. Classes get a circulant MinHash
    signature and `bands` keys of `rows` coordinates; those with a key in common share a bucket.
    In each bucket, all members are compared with the bucket's first class and with two members
    chosen by hash: linear work, which joins what is alike. Where members of a bucket then still
    belong to different components, the outsiders of the main one are compared, in blocks, with
    all members of the bucket. So every candidate pair is either compared on full sets or linked by
    a path already; no bucket is capped, and no pairs of a group are written out. A pair at the
    threshold of 80 % shares no bucket with probability 0.67**24 (7e-5), at 85 % 8e-7.

    A text with fewer words than a shingle has one shingle, the whole sequence. Null and empty
    texts have an empty set, link with nothing and are kept. A row is known by its id and its version,
    a hash of its text: different texts under one id, or without an id, are linked each by its own
    words. component_id and component_version name the component's smallest row; a null id is
    larger than all others, and component_id is null if the component has no other. Columns other
    than doc_id and text are ignored. Hashes of 64 bits stand for shingles.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    sketch = checkpoint(_sketches(own, words, bands, rows))
    each = sketch.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "version")).alias("who"), F.min("keys").alias("keys"))
    n = sketch.count()
    classes = checkpoint(each.withColumn("rep", F.monotonically_increasing_id()), n)  # written at once, so that numbers stay
    spread = classes.select("rep", F.posexplode("keys").alias("band", "bucket"))
    order = [F.xxhash64(F.lit(s), F.col("rep")) for s in (1, 2)]
    hubs = spread.groupBy("band", "bucket").agg(F.min("rep").alias("hub"), *[F.min_by("rep", o).alias(f"hub{k}") for k, o in enumerate(order)], F.max("rep").alias("last")).where("hub < last")
    members = checkpoint(spread.join(hubs.drop("last"), ["band", "bucket"]), n)
    wanted = members.select("rep").distinct()
    keyed = classes.select("rep", "keys", F.col("who.doc_id").alias("__id"), F.col("who.version").alias("__v")).join(wanted, "rep")
    texts = keyed.join(own, (F.col("doc_id") == F.col("__id")) & (F.col("version") == F.col("__v"))).select("rep", "keys", "text")
    sets = checkpoint(_sets(texts, words).groupBy("rep").agg(F.min_by("keys", "grams").alias("keys"), F.min("grams").alias("grams")), n)
    pairs = members.select(F.explode(F.array("hub", "hub0", "hub1")).alias("h"), "rep").where("h <> rep")
    pairs = pairs.select(F.least("h", "rep").alias("a"), F.greatest("h", "rep").alias("b")).distinct()
    grams = sets.select("rep", "grams")
    sided = pairs.join(grams.withColumnsRenamed({"rep": "a", "grams": "x"}), "a").join(grams.withColumnsRenamed({"rep": "b", "grams": "y"}), "b")
    links = checkpoint(_linked(sided.select("a", "b", "x", "y"), percent), n)
    labels = components(links)
    found = links.unionAll(_open_links(members, labels, sets, percent, n))
    reached = checkpoint(components(found).withColumnRenamed("node", "rep").join(classes.select("rep", "c1", "c2", "who"), "rep"), n)
    top = reached.groupBy("label").agg(F.min("who").alias("top"))
    of_class = reached.join(top, "label").select(F.col("c1").alias("__1"), F.col("c2").alias("__2"), "top")
    of_class = of_class.unionAll(classes.join(reached.select("rep"), "rep", "left_anti").select("c1", "c2", "who"))
    out = sketch.join(of_class, (F.col("c1") == F.col("__1")) & (F.col("c2") == F.col("__2")) & (F.col("n_shingles") > 0), "left")
    component, version = F.coalesce("top.doc_id", "doc_id"), F.coalesce("top.version", "version")
    null = F.lit(int(NULL_ID))
    return out.select(F.nullif("doc_id", null).alias("doc_id"), "n_shingles", F.nullif(component, null).alias("component_id"), (component == F.col("doc_id")).alias("kept"), "version", version.alias("component_version"))


def _open_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Links in buckets whose members are not yet of one component."""
    labelled = members.select("band", "bucket", "hub", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = checkpoint(labelled, n)
    count = labelled.groupBy("band", "bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    main = count.groupBy("band", "bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
    open_ = labelled.join(main, ["band", "bucket"]).withColumn("outside", F.col("label") != F.col("main"))
    blocks = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")
    chunks = F.ceil(F.col("all") / CHUNK).cast("int")
    open_ = open_.select("band", "bucket", "rep", "label", "outside", blocks.alias("blocks"), chunks.alias("chunks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    chunk = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("chunks")).cast("int")
    outsiders = open_.where("outside").select("band", "bucket", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), "rep", "label")
    # any two outsiders meet too, as each is also a member
    others = open_.select("band", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"), F.lit(1).alias("kind"), "rep", "label")
    rows = outsiders.unionAll(others).join(sets, "rep").select("bucket", "block", "chunk", "kind", "rep", "label", "band", "keys", "grams")
    dealt = rows.repartition("bucket", "block", "chunk").sortWithinPartitions("bucket", "block", "chunk", "kind")
    return _rest(dealt, percent)


def op2_near(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


QUERIES = {"op2_near": op2_near}
