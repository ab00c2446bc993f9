"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, rows_of

SHARDS, NODES = 40, 64


def ring(n_shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of the virtual nodes (signed 64-bit) and the shard of each."""
    place = [(xxhash.xxh3_64_intdigest(f"shard {s} node {k}".encode()) - 2**63, s) for s in range(n_shards) for k in range(nodes)]
    place.sort()
    return np.array([p for p, _ in place], np.int64), np.array([s for _, s in place], np.int64)


def capacities(rows: int, n_shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard. Without slack they add up to all rows and differ by one at most."""
    if slack > 0:
        return [int(np.ceil(rows / n_shards * (1 + slack)))] * n_shards
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def spans(counts: Sequence[int], owner: Sequence[int], caps: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, shard, first slot): which shard takes which ranks of each arc.

    Every arc first fills its own node's shard as far as there is room; keys that overflow go on
    clockwise, node by node, to shards with room. Work and result depend on the number of
    virtual nodes alone.
    """
    room, slot, out, over = list(caps), [0] * len(caps), [], []

    def put(arc: int, first: int, want: int, shard: int) -> int:
        n = min(want, room[shard])
        if n:
            out.append((arc, first, shard, slot[shard]))
            room[shard] -= n
            slot[shard] += n
        return n

    for arc, n in enumerate(counts):
        took = put(arc, 0, n, owner[arc])
        if took < n:
            over.append((arc, took, n))
    for arc, first, n in over:
        node = arc
        while first < n:
            node = (node + 1) % len(owner)
            first += put(arc, first, n - first, owner[node])
    return sorted(out)


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs.

    A document's key is its doc_id, hashed onto the ring; the arc before a virtual node belongs to
    the node's shard. Shards have bounded loads: with slack 0 row counts differ by one at most,
    with slack e none holds over (1 + e) times the mean. Keys are placed in order of arc and hash;
    those that find their shard full go on clockwise, so only keys next to full shards move. The
    driver sees one count per arc. Ranks in an arc come from range partitions, so copies of one id
    may be many.

    size is UTF-8 bytes of the text plus 16; a null text counts as empty. Null ids are hashed like
    a value of their own. Repeated rows are separate keys at one place. An empty table gives an
    empty result. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    place, owner = ring(n_shards, nodes)
    text = F.coalesce(docs["text"], F.lit(""))
    keys = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("doc_id").alias("key"))

    def to_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(place, b.column("key").to_numpy(zero_copy_only=False)) % len(place)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "arc"])

    arcs = keys.mapInArrow(to_arcs, "doc_id long, size long, text_crc32 long, key long, arc int")
    at = ranked(arcs, ["arc"], ["key", "doc_id", "text_crc32"])
    held = at.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = [0] * len(place)
    for arc, n in held:
        counts[arc] = n
    took = spans(counts, owner.tolist(), capacities(sum(counts), n_shards, slack))
    start_arc, start_rank, shard, slot = (np.array([t[i] for t in took], np.int64) for i in range(4))
    arc_first = np.searchsorted(start_arc, np.arange(len(place) + 1))

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = start_arc * 2**40 + start_rank
        for b in batches:
            arc = b.column("arc").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(code, arc * 2**40 + rank, side="right") - 1
            assert not len(k) or (k >= arc_first[arc]).all()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(shard[k].astype(np.int32)), pa.array(slot[k] + rank - start_rank[k])], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    if not took:
        return rows_of(spark, "doc_id long, size long, text_crc32 long, shard int, slot long", [])
    return at.select("doc_id", "size", "text_crc32", "arc", "rank").mapInArrow(to_shards, "doc_id long, size long, text_crc32 long, shard int, slot long")


def op8_shard(spark, sf_dir: str) -> DataFrame:
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_shard": op8_shard}
