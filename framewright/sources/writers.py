"""Writers of records, tables, manifests and reports."""

from __future__ import annotations

import json
import platform
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOME = r"(/home/|/Users/)[^/\"\s]+"


def jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are written."""
    rows.write.option("ignoreNullFields", False).mode("error").json(path)


def by_label(rows: DataFrame, path: str, label: str) -> None:
    """A folder a label, written by label so that each has few files."""
    rows.repartition(label, F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.option("ignoreNullFields", False).partitionBy(label).mode("error").json(path)


def table(rows: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    rows.select(*(columns or sorted(rows.columns))).write.option("header", True).mode("error").csv(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a report's rows; a report longer than `limit` rows is an error."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in got])


def session_summary(frames: DataFrame, session: str, seconds: str) -> DataFrame:
    """(session, summary): one JSON document a session with counts by mode and rates."""
    per = frames.groupBy(session, "mode").agg(F.count(F.lit(1)).alias("n"), F.min(seconds).alias("a"), F.max(seconds).alias("b"))
    got = per.groupBy(session).agg(F.sum("n").alias("frames_total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "n")))).alias("frames_by_mode"), (F.max("b") - F.min("a")).alias("duration_wall_s"))
    body = F.struct(F.col(session).alias("session_id"), F.bround("duration_wall_s", 3).alias("duration_wall_s"), "frames_total", "frames_by_mode", F.bround(F.col("frames_total") / F.greatest(F.lit(1.0), F.col("duration_wall_s")), 3).alias("fps_mean"))
    return got.select(session, F.to_json(body).alias("summary"))


def redacted(text: Column) -> Column:
    """Home folders in a JSON document, or any text, become <HOME>."""
    return F.regexp_replace(text, HOME, "<HOME>")


def file_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """(path, sha256, bytes) of all files below."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return df.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def run_manifest(spark: SparkSession, flags: dict) -> str:
    return json.dumps({"platform": platform.system(), "python": platform.python_version(), "spark": spark.version, "flags": flags}, sort_keys=True)


def box_lines(rows: DataFrame) -> DataFrame:
    """(stem, value): a text a stem with one line a box, as evaluation tools read them."""
    one = lambda b: F.concat_ws(" ", b["label"], *[F.format_number(b[c], "0.0") for c in ("x0", "y0", "x1", "y1")])
    return rows.select("stem", F.array_join(F.transform("boxes", one), "\n").alias("value"))


def texts(rows: DataFrame, path: str) -> None:
    """(stem, value) as text files, a folder a stem."""
    rows.write.partitionBy("stem").mode("error").text(path)
