"""Exact top-k search by a uniform threshold in three phases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpoint, partitions

K, SCALE, EVERY = 20, 64, 20
#: Vectors of a candidate block and of a query block.
NODE, QUERIES_AT_ONCE = 4096, 1024
#: Bytes of the queries that a node of the search holds; below all scores.
HELD, LOW = 32_000_000, np.iinfo(np.int64).min


def blocks(vectors: DataFrame, most: int) -> DataFrame:
    """(dim, part, ids, values): vectors (vec_id, embedding) as whole numbers floor(SCALE * x), in
    blocks of `most` at most of one dimension each; part names the block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        waiting: dict[int, list] = {}
        made = 0

        def out(dim: int, rows: list) -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids, values = np.array([r[0] for r in rows], np.int64), np.stack([r[1] for r in rows])
            part = TaskContext.get().partitionId() * 2**24 + made
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["dim", "part", "ids", "values"])

        for b in batches:
            vectors = b.column(1)
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            edges = vectors.offsets.to_numpy()
            for i, vec_id in enumerate(b.column(0).to_pylist()):
                if vec_id is None or not vectors[i].is_valid:
                    continue
                x = flat[edges[i] : edges[i + 1]]
                if not len(x) or not np.isfinite(x).all():
                    continue
                rows = waiting.setdefault(len(x), [])
                rows.append((vec_id, np.floor(x * SCALE)))
                if len(rows) >= most:
                    yield out(len(x), waiting.pop(len(x)))
        for dim, rows in waiting.items():
            yield out(dim, rows)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(pack, "dim int, part long, ids binary, values binary")


def _scores(q: np.ndarray, c: np.ndarray, own: list[tuple[int, slice]]) -> np.ndarray:
    """Inner products as 64-bit integers, LOW at the places in `own`. Exact: in doubles while all sums
    stay under 2**53, then in 64-bit integers, then in Python's; scores that no long can hold
    raise an OverflowError."""
    out = _products(q, c, own)
    for i, to in own:
        out[i, to] = LOW
    return out


def _products(q: np.ndarray, c: np.ndarray, own: list[tuple[int, slice]]) -> np.ndarray:
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    if not np.isfinite(q).all() or not np.isfinite(c).all():
        raise OverflowError(f"a component times {SCALE} is beyond the doubles")
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object)
    out = whole(q) @ whole(c).T
    for i, to in own:
        out[i, to] = 0
    if any(not LOW < x < 2**63 for x in out.ravel()):
        raise OverflowError("a score is beyond 64 bits")
    return out.astype(np.int64)


class _Queries:
    """A block of queries with the k best entries of each so far."""

    def __init__(self, part: int, ids: bytes, values: bytes, k: int) -> None:
        self.part, self.ids, self.k = part, np.frombuffer(ids, np.int64), k
        self.values = np.frombuffer(values, np.float64).reshape(len(self.ids), -1)
        self.scores, self.found = np.full((len(self.ids), k), LOW), np.zeros((len(self.ids), k), np.int64)

    def meet(self, c: np.ndarray, values: np.ndarray) -> None:
        """Takes in the candidates `c`, which come by rising id."""
        k, low = self.k, np.searchsorted(c, self.ids)
        own = [(i, slice(low[i], np.searchsorted(c, self.ids[i], side="right"))) for i in np.flatnonzero(c[np.minimum(low, len(c) - 1)] == self.ids)]
        s = _scores(self.values, values, own)
        take = (s >= self.scores[:, -1:]) & (s > LOW)
        if np.count_nonzero(take) > 8 * k * len(s) and len(c) > k:  # the first block, or many equal scores
            last = np.partition(s, -k, axis=1)[:, -k, None]
            take &= s >= last
            for i in np.flatnonzero(take.sum(1) > k):  # of equal scores the first ids
                equal = np.flatnonzero(s[i] == last[i])
                take[i, equal[k - np.count_nonzero(s[i] > last[i]) :]] = False
        at, to = np.nonzero(take)
        mine, place = np.nonzero(self.scores > LOW)
        at, score, ids = np.concatenate([mine, at]), np.concatenate([self.scores[mine, place], s[at, to]]), np.concatenate([self.found[mine, place], c[to]])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        at, score, ids, rank = (x[rank < k] for x in (at, score, ids, rank))
        self.scores[:], self.found[:] = LOW, 0
        self.scores[at, rank], self.found[at, rank] = score, ids

    def lists(self) -> pa.RecordBatch:
        real = self.scores > LOW
        offsets = pa.array(np.concatenate([[0], np.cumsum(real.sum(1))]).astype(np.int32))
        cols = [pa.ListArray.from_arrays(offsets, pa.array(x[real])) for x in (self.scores, self.found)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(self.ids), self.part)), pa.array(self.ids), *cols], names=["part", "query_id", "scores", "ids"])


def _local_lists(k: int):
    """Each node's lists: rows come sorted by node, its query blocks (kind 0) before the candidates,
    which stream past them one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(n)[i] for n in b.schema.names}
                cell = tuple(r[n].as_py() for n in ("dim", "gq", "gn"))
                if cell != now:
                    yield from (q.lists() for q in held)
                    now, held = cell, []
                if r["kind"].as_py() == 0:
                    held.append(_Queries(r["part"].as_py(), r["ids"].as_py(), r["values"].as_py(), k))
                    continue
                c = np.frombuffer(r["ids"].as_py(), np.int64)
                order = np.argsort(c, kind="stable")
                v = np.frombuffer(r["values"].as_py(), np.float64).reshape(len(c), -1)[order]
                for q in held:
                    q.meet(c[order], v)
        yield from (q.lists() for q in held)

    return run


def _nodes(asked: DataFrame, blocks_: DataFrame) -> DataFrame:
    """Query and candidate blocks dealt out on a grid, whose cells are the nodes of the search.

    Every query block meets every candidate block of its dimension in just one cell. A cell holds
    HELD bytes of queries, and its candidates stream; so a vector is copied once for each HELD
    bytes of queries, and a query once for each group of candidates, of which there are as many
    as give every task cells to work on."""
    tasks = partitions(asked.sparkSession)
    n_asked, bytes_asked = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("values")), F.lit(1))).first()
    gq = max(1, -(-n_asked // max(1, HELD // bytes_asked)))
    gn = max(1, min(blocks_.count(), -(-4 * tasks // gq)))
    own = lambda g: F.pmod(F.xxhash64("part"), F.lit(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    left = asked.select("dim", own(gq).alias("gq"), every(gn).alias("gn"), F.lit(0).alias("kind"), "part", "ids", "values")
    right = blocks_.select("dim", every(gq).alias("gq"), own(gn).alias("gn"), F.lit(1).alias("kind"), "part", "ids", "values")
    return left.unionAll(right).repartition(max(1, min(gq * gn, 4 * tasks)), "dim", "gq", "gn").sortWithinPartitions("dim", "gq", "gn", "kind")


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    Candidates are cut into blocks and dealt out to nodes; each score is computed once. (1) Each node
    keeps the k best entries of its queries where they are, in lists by falling score. Of these,
    the scores alone are gathered; their k-th best over all nodes is a cutoff that no member of
    the result is below. (2) Against the cutoffs, lists give up the entries that reach them. (3) What
    arrived is ordered by score and id and cut at k. Scores are gathered in two steps, so that what
    is in one place grows with the square root of the number of nodes.

    Components become floor(64 * x) of x as double. Vectors that are null, empty or hold null or
    non-finite components take no part, nor do null ids. Only vectors of equal dimension meet. Rows
    with a query's own id are not its candidates; ids that occur repeatedly are each a
    candidate, ordered as equals. Other columns are ignored; an empty table, or one without
    queries, gives an empty result. A score beyond 64 bits is an error.
    """
    own = vectors.select("vec_id", "embedding", is_query.alias("q"))
    ask = own.where("q")
    n = ask.count()
    asked = checkpoint(blocks(ask.repartition(max(1, -(-n // QUERIES_AT_ONCE))), QUERIES_AT_ONCE))
    dealt = _nodes(asked, checkpoint(blocks(own, NODE)))
    lists = checkpoint(dealt.mapInArrow(_local_lists(k), "part long, query_id long, scores array<long>, ids array<long>"))

    def best(column: str) -> Column:
        return F.slice(F.sort_array(F.flatten(F.collect_list(column)), asc=False), 1, k)

    groups = max(1, int(np.sqrt(4 * partitions(vectors.sparkSession))))
    some = lists.select("part", "query_id", "scores", F.pmod(F.xxhash64(F.col("scores"), F.col("ids")), F.lit(groups)).alias("g"))
    merged = some.groupBy("part", "query_id", "g").agg(best("scores").alias("scores")).groupBy("part", "query_id").agg(best("scores").alias("scores"))
    cutoffs = merged.select("part", "query_id", F.when(F.size("scores") >= k, F.element_at("scores", k)).otherwise(F.lit(LOW)).alias("cutoff"))
    entries = lists.join(cutoffs, ["part", "query_id"]).select("query_id", "cutoff", F.inline(F.arrays_zip("scores", "ids"))).where("scores >= cutoff")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("scores"), "ids"))
    return entries.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("ids").alias("vec_id"), F.col("scores").alias("score"))


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op9_topk": op9_topk}
ORACLE = {
    "op9_topk": """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS e FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
