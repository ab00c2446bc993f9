"""Line dedup with a sharded minimal perfect hash."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bounded_batches, bytes_of, checkpoint, ids_of, mix64, partitions, text_slices

#: Code points that a key has at least; keys of one index shard; bits per key and level.
LEAST, SHARD_KEYS, GAMMA = 10, 200_000, 2.0
#: Rows that a key has at least to be looked up where it is read.
COMMON = 1_000


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """The line's key, or None if it is too short to count."""
    key = line.strip().lower()
    if len(key) < least:
        return None
    return key if key.isascii() or len(key.decode("utf-8", "replace")) >= least else None


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, each key at the first level
    where no other remaining key shares its place; its number is the count of bits before it. A place
    costs its bit and, for each 64 of them, the count so far: 2 bits in all."""

    def __init__(self, keys: np.ndarray, gamma: float = GAMMA) -> None:
        self.n, self.levels, rest = len(keys), [], keys.astype(np.uint64)
        while len(rest):
            size = 64 * max(1, int(gamma * len(rest)) // 64)
            at = self._place(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = rest[~alone[at]]
        self._count()

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def _count(self) -> None:
        self._before, total = [], 0
        for words in self.levels:
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self._before.append(np.concatenate([[0], ones[:-1]]) + total)
            total += int(ones[-1])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, for keys of the set all different; -1 or any number for others."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            if not len(open_):
                break
            at = self._place(keys[open_].astype(np.uint64), level, 64 * len(words))
            word, bit = words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            out[open_[hit]] = self._before[level][at[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([self.n, len(self.levels), *map(len, self.levels)], np.int64)
        return head.tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        self = cls.__new__(cls)
        self.n, k = (int(x) for x in np.frombuffer(data, np.int64, 2))
        sizes, at, self.levels = np.frombuffer(data, np.int64, k, 16), 16 + 8 * k, []
        for s in sizes:
            self.levels.append(np.frombuffer(data, np.uint64, s, at))
            at += 8 * int(s)
        self._count()
        return self


def _digests(texts: list[bytes | None], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, texts' numbers): the 128-bit hashes of the distinct keys of each text."""
    digests, counts = [], []
    for text in texts:
        keys = {k for line in text.split(b"\n") if (k := line_key(line, least))} if text else ()
        digests += [xxhash.xxh3_128_digest(k) for k in keys]
        counts.append(len(keys))
    h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
    return np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), np.repeat(np.arange(len(texts)), counts)


def _hash_lines(docs: DataFrame, least: int) -> DataFrame:
    """(h1, h2, doc_id) of each distinct key of each row of docs (doc_id, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            h1, h2, of = _digests(bytes_of(b.column(1)), least)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(ids_of(b.column(0))[of])], names=["h1", "h2", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(hashed, "h1 long, h2 long, doc_id long")


def packed(h1: np.ndarray, h2: np.ndarray, n: np.ndarray, first: np.ndarray) -> bytes:
    """Keys as a perfect hash with arrays of fingerprints, counts and first documents."""
    _, one = np.unique(h1, return_index=True)
    side = np.setdiff1d(np.arange(len(h1)), one)  # keys with the first half of another: a side list
    order = PerfectHash(h1[one].view(np.uint64))
    table = np.empty((3, len(one)), np.int64)
    table[:, order(h1[one].view(np.uint64))] = [h2[one], n[one], first[one]]
    extra = np.stack([x[side] for x in (h1, h2, n, first)])
    mph = order.dump()
    return np.array([len(mph), len(one), len(side)], np.int64).tobytes() + mph + table.tobytes() + extra.tobytes()


class Shard:
    """What packed() wrote. Arrays stay in its bytes."""

    def __init__(self, body: bytes) -> None:
        size, n, side = (int(x) for x in np.frombuffer(body, np.int64, 3))
        self.order = PerfectHash.load(body[24 : 24 + size])
        self.h2, self.count, self.first = np.frombuffer(body, np.int64, 3 * n, 24 + size).reshape(3, n)
        e = np.frombuffer(body, np.int64, 4 * side, 24 + size + 24 * n).reshape(4, side)
        self.side = {(int(a), int(b)): (int(c), int(f)) for a, b, c, f in e.T}

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and smallest document of each key; 0 and NULL_ID of keys that are not held."""
        at = self.order(h1.view(np.uint64))
        held = at >= 0
        held[held] = self.h2[at[held]] == h2[held]
        count, first = np.zeros(len(h1), np.int64), np.full(len(h1), NULL_ID)
        count[held], first[held] = self.count[at[held]], self.first[at[held]]
        if self.side:
            for i, k in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                count[i], first[i] = self.side.get(k, (count[i], first[i]))
        return count, first


def _index(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, payload) of keys (h1, h2, n, first): each shard as packed() writes it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard: int, parts: list) -> pa.RecordBatch:
            body = packed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([body], pa.binary())], names=["shard", "payload"])

        now, parts = None, []
        for b in batches:
            shard = b.column(0).to_numpy()
            cols = [b.column(i).to_numpy() for i in range(1, 5)]
            edges = np.flatnonzero(np.diff(shard, prepend=-1))
            for a, z in zip(edges, [*edges[1:], len(shard)], strict=True):
                if shard[a] != now and parts:
                    yield out(now, parts)
                    parts = []
                now = int(shard[a])
                parts.append([c[a:z] for c in cols])
        if parts:
            yield out(now, parts)

    rows = keys.select(F.pmod("h1", F.lit(shards)).alias("shard"), "h1", "h2", "n", "first").repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(build, "shard long, payload binary")


def _probe(documents: int):
    """Looks up each shard's probes (kind 1) in its arrays (kind 0), which come first; rows of kind 2
    are known to go and pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, arrays = None, None
        for b in batches:
            shard, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(shard, prepend=shard[:1]) != 0) | (np.diff(kind, prepend=kind[:1]) != 0)) if len(shard) else []
            edges = [0, *edges] if len(shard) else []
            for a, z in zip(edges, [*edges[1:], len(shard)], strict=True):
                if kind[a] == 0:
                    now, arrays = shard[a], Shard(b.column(2)[int(a)].as_py())
                elif kind[a] == 2 or now == shard[a]:  # a shard without repeated keys has no arrays
                    cols = [b.column(i).slice(int(a), int(z - a)) for i in (5, 6, 3, 4)]
                    if kind[a] == 1:
                        ids, h1, h2 = (cols[i].to_numpy() for i in (0, 2, 3))
                        count, first = arrays.find(h1, h2)
                        late = pa.array(np.flatnonzero((first < ids) & (count >= documents)))
                        cols = [c.take(late) for c in cols]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "version", "h1", "h2"])

    return run


def repeated_lines(docs: DataFrame, least: int = LEAST, shard_keys: int = SHARD_KEYS, documents: int = 2) -> DataFrame:
    """(doc_id, version, drop): per row of docs (doc_id, version, text), the hashes of the keys that
    a smaller document has.

    Keys are hashed to 128 bits (taken as equal if these are) and pre-aggregated where they are
    read, so a very common line costs a row per task. Keys of two documents or more go to an index
    in shards of `shard_keys` at most: a minimal perfect hash of the first 64 bits leads to arrays of
    the other 64 bits as fingerprint, of counts, and of first documents. Each document's hashes
    then probe the shard that they belong to; lines are never joined.

    A key that makes up more than a task's share of all rows would send them all to one shard. There are
    fewer such keys than tasks, as their shares add up to all rows at most; they form one more
    shard, which is sent to every worker, and their rows are decided where they are read.
    """
    spark, tasks = docs.sparkSession, partitions(docs.sparkSession)
    found = _hash_lines(docs, least).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    keys = checkpoint(found.where("first < last").select("h1", "h2", "n", "first"))
    held, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(8 * tasks, -(-held // shard_keys))
    common = F.col("n") > max(COMMON, total // tasks)
    hot = keys.where(common).toArrow().combine_chunks()
    body = packed(*(hot[c].to_numpy() for c in ("h1", "h2", "n", "first")))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shard(body)
        for b in text_slices(batches, "text"):
            h1, h2, of = _digests(bytes_of(b.column(2)), least)
            ids, versions = ids_of(b.column(0))[of], b.column(1).to_numpy()[of]
            count, first = known.find(h1, h2)
            stay = (count == 0) | ((first < ids) & (count >= documents))
            shard, kind = np.where(count == 0, h1 % shards, -1 - versions % tasks), np.where(count == 0, 1, 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in (shard, kind, h1, h2, ids, versions)], names=["shard", "kind", "h1", "h2", "doc_id", "version"])

    probes = docs.select("doc_id", "version", "text").mapInArrow(ask, "shard long, kind int, h1 long, h2 long, doc_id long, version long")
    null = F.lit(None).cast("long")
    both = _index(keys.where(~common), shards).select("shard", F.lit(0).alias("kind"), "payload", null.alias("h1"), null.alias("h2"), null.alias("doc_id"), null.alias("version"))
    both = both.unionAll(probes.select("shard", "kind", F.lit(None).cast("binary").alias("payload"), "h1", "h2", "doc_id", "version"))
    late = both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_probe(documents), "doc_id long, version long, h1 long, h2 long")
    return late.groupBy("doc_id", "version").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))


def drop_repeated_lines(docs: DataFrame, least: int = LEAST, shard_keys: int = SHARD_KEYS, name: str = "text", documents: int = 2) -> DataFrame:
    """docs with the lines gone that a document with a smaller doc_id has too, if `documents` rows or
    more have them.

    Texts are split at \\n. A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased; keys under `least` code points stay, and so do all lines of a key in the smallest
    document that holds it. Adds n_lines, n_dropped (long) and kept_sha256; `name` is the text
    column, which gets the kept lines joined by \\n.

    A null or empty text is one empty line, and becomes or stays empty. A null doc_id counts as
    the largest. Rows that share a doc_id are one document: they keep each other's lines. Drops
    are gathered by id and text, so many rows of one id, or without one, don't meet in one place. Other
    columns stay as they are; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    base = docs.withColumns({"__id": F.coalesce(docs["doc_id"].cast("long"), F.lit(int(NULL_ID))), "__v": F.xxhash64(F.col(name))})
    own = base.select(F.col("__id").alias("doc_id"), F.col("__v").alias("version"), F.col(name).alias("text"))
    drops = repeated_lines(own, least, shard_keys, documents).select(F.col("doc_id").alias("__d"), F.col("version").alias("__w"), F.col("drop").alias("__drop"))
    both = base.join(drops, (base["__id"] == drops["__d"]) & (base["__v"] == drops["__w"]), "left").drop("__id", "__v", "__d", "__w")
    names = [c for c in both.columns if c != "__drop"]
    at = names.index(name)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, name):
            texts, n_lines, n_dropped, sha = [], [], [], []
            drops = b.column(len(names))
            for i, text in enumerate(bytes_of(b.column(at))):
                lines = (text or b"").split(b"\n")
                kept = lines
                if drops[i].is_valid:
                    gone = set(zip(*(x.to_pylist() for x in drops[i].values.flatten()), strict=True))
                    kept = [x for x in lines if (k := line_key(x, least)) is None or struct.unpack(">qq", xxhash.xxh3_128_digest(k)) not in gone]
                out = b"\n".join(kept)
                texts.append(out)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                sha.append(hashlib.sha256(out).hexdigest())
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())], names=[*names, "__n_lines", "__n_dropped", "__sha"])

    fields = [f for f in both.schema.fields if f.name != "__drop"]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType()), T.StructField("__sha", T.StringType())])
    return both.mapInArrow(rewrite, schema)


def op10_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__sha").alias("kept_sha256"))


QUERIES = {"op10_lines": op10_lines}
ORACLE = {
    "op10_lines": r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_ascii AS key FROM (
    SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  ), LATERAL (SELECT translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii)
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT lines.*, first_doc IS NOT NULL AND first_doc < doc_id AS gone FROM lines LEFT JOIN firsts USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
