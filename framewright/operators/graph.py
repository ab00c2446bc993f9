"""Duplicate graphs: connected components and cluster names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import checkpoint, remove, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node that has a link (a, b); label is its component's smallest node.

    Labels pass along links, then jump to their label's label, until none falls."""
    both = checkpoint(links.select("a", "b").unionAll(links.select("b", "a")).where("a <> b").distinct())
    rows = both.count()
    labels, path = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), rows)
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(seen, "node").select("node", F.least("label", "m").alias("new"), "label")
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("top"))
        moved, after = written(step.join(up, "new").select("node", F.least("new", "top").alias("new"), "label"), rows)
        done = moved.where("new <> label").isEmpty()
        out = checkpoint(labels, rows) if done else None
        remove(links.sparkSession, path)
        if done:
            remove(links.sparkSession, after)
            return out
        labels, path = moved.select("node", F.col("new").alias("label")), after


def clusters(rows: DataFrame, id_column: str, links: DataFrame) -> DataFrame:
    """rows with cluster (smallest member) and cluster_size; rows without links are alone."""
    found = components(links).select(F.col("node").alias("__node"), F.col("label").alias("__label"))
    out = rows.join(found, rows[id_column] == found["__node"], "left").withColumn("cluster", F.coalesce("__label", id_column)).select(*rows.columns, "cluster")
    sizes = out.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    return out.join(sizes, "cluster").select(*rows.columns, "cluster", "cluster_size")


def named(members: DataFrame, cluster: str, id_column: str) -> DataFrame:
    """(cluster, name): 24 digits of the SHA-256 of the sorted member ids; one digest a member is
    gathered. For clusters that fit one row, as names by definition cover all members."""
    ids = F.array_sort(F.collect_list(F.col(id_column).cast("string")))
    return members.groupBy(cluster).agg(F.substring(F.sha2(F.to_json(ids), 256), 1, 24).alias("name"))


def equal_links(rows: DataFrame, id_column: str, key: str) -> DataFrame:
    """Links (a, b) of rows with an equal key to the smallest of them: a star, not all pairs."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_column).alias("b"))
    return rows.select(F.col(id_column).alias("a"), key).join(first, key).where("a <> b").select("a", "b")


def pair_class(same_sha: Column, verified_both: Column, same_label: Column) -> Column:
    """Class of a duplicate pair; hash matches of different labels are linked nonetheless."""
    return F.when(same_sha, "exact_file_duplicate").when(~verified_both, "unresolved").when(~same_label, "dhash_false_positive_candidate").otherwise("likely_near_duplicate")
