"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, checkpoint, ranked

#: Weights of the sources in code-point order, repeating; the share of all words; copies at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: The random offset is a multiple of 1/1024, which sums of copies hold exactly.
STEPS = 1024


def words(text: str | Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target): what each source is to give.

    Sources weigh `weights` in code-point order (null last) and share `share` times all words;
    none gives more than `most` times its own, the excess goes to the rest by weight. That is
    water-filling: with sources by size per weight, the first k are full, and the level of the
    others follows from running sums. One row per source is gathered, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    per = per.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(later)
    per = per.withColumn("level", level)
    per = per.withColumn("water", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything))
    free = F.col("water").isNotNull() & (F.col("ratio") >= F.col("water.ratio"))
    target = F.when(free, F.least(F.col("cap").cast("double"), F.col("water.level") * F.col("weight"))).otherwise(F.col("cap").cast("double"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def copies_of(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0, more: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of docs, and its columns `more`.

    Each document of a source expects target / source_size copies. Documents stand in order of
    size, then id, so that neighbours are alike; their expected copies are summed up, one random
    offset (from the seed and the source's name) is added, and a document is emitted once for
    each integer that its sum crosses. So no document comes more than `most` times, and a
    source's words miss its target by about one document. Ranks come from range partitions, so
    one source may hold most rows.

    Null texts and empty texts have size 0 and are copied like others. A null source is a source
    of its own, last in order. A source without words has target 0 and no copies. Repeated rows
    are separate documents. An empty table gives an empty result. Other columns are ignored.
    """
    sizes = docs.select("doc_id", "source", words(docs["text"]).alias("size"), *more)
    at = ranked(sizes, ["source"], ["size", "doc_id", *more])
    per = source_targets(at, weights, share, most)
    per = per.select(F.col("source").alias("__s"), "source_size", "target")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    offset = F.conv(F.substring(F.md5(named), 1, 4), 16, 10).cast("int") % STEPS / F.lit(float(STEPS))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor((F.col("rank") + 1) * F.col("rate") + F.col("offset")) - F.floor(F.col("rank") * F.col("rate") + F.col("offset"))
    joined = at.join(per, at["source"].eqNullSafe(per["__s"])).withColumns({"rate": rate, "offset": offset})
    return joined.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.least(crossed, F.lit(most)).cast("int").alias("copies"), *more)


def _row_hash(docs: DataFrame) -> Column:
    """64-bit hash of all columns; nulls count."""
    each = [F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*each, *[c.isNull() for c in each])


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns unchanged.

    A row is known by a hash of all its columns, so rows without an id or with one id and
    different texts get their own copies. Equal rows can't be told apart: one of them gives the
    copies of all. Nulls and empty tables: see copies_of().
    """
    known = docs.withColumns({"__words": words(docs["text"]), "__row": _row_hash(docs)})
    took = copies_of(known, weights, share, most, seed, ["__row"]).groupBy("doc_id", "source", "size", "__row").agg(F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__held"))
    took = checkpoint(took.where("__all > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("size").alias("__size"), F.col("__row").alias("__hash"), "__all", "__held"))
    on = known["doc_id"].eqNullSafe(took["__id"]) & known["source"].eqNullSafe(took["__s"]) & (known["__words"] == took["__size"]) & (known["__row"] == took["__hash"])
    out = known.join(took.where("__held = 1"), on)
    repeated = took.where("__held > 1")
    if not repeated.isEmpty():
        out = out.unionAll(known.join(repeated, on).dropDuplicates(["__id", "__s", "__size", "__hash"]))
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__all").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = copies_of(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


QUERIES = {"op1_mix": op1_mix}
ORACLE = {
    "op1_mix": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS place FROM sized
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, source_size * 2 AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM per
), levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), free AS (
  SELECT ratio AS first_free, level AS water FROM levels WHERE ratio > level ORDER BY ratio, level LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN ratio >= first_free THEN least(cap::DOUBLE, water * weight) ELSE cap::DOUBLE END AS target
  FROM levels LEFT JOIN free ON true
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    (('0x' || substr(md5('0:' || coalesce('s' || source, 'null')), 1, 4))::INT % 1024) / 1024.0::DOUBLE AS shift
  FROM targets
), taken AS (
  SELECT doc_id, size, source_size, target,
    least(floor((place + 1) * rate + shift) - floor(place * rate + shift), 2)::INT AS copies
  FROM placed JOIN rates ON placed.source IS NOT DISTINCT FROM rates.source
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM taken
"""
}
