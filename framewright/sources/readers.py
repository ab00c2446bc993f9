"""Readers of records, manifests, sessions, annotations and images."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators.ranks import ranked

# Extensions of files.
IMAGES, VIDEOS, DATA = ("jpg", "jpeg", "png", "bmp"), ("mp4", "avi", "mov", "mkv"), ("npy", "npz")
CONDITIONS = ("night_clear", "nir_night", "normal_night", "fog", "glare", "backlight", "rain", "normal_day")


def jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType, strict: bool = True, missing_ok: bool = False) -> DataFrame:
    """Records, one JSON object a line. strict raises on a bad line, else bad lines are dropped; with
    missing_ok, paths that don't exist are left out. Unknown keys are dropped, missing ones null."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if missing_ok:
        paths = [p for p in paths if exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json(paths)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob is there, asked of its own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def labelled_by_file(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    """Records of one file a class; label is the file's stem."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(directory).withColumn("label", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def csv_strings(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV file with all values as text; an empty frame if there is none."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path) if exists(spark, path) else spark.createDataFrame([], schema)


SESSION = "session_id string, duration_wall_s double, frames_total long, frames_by_mode map<string,long>, frames_by_env map<string,long>, frames_by_bucket map<string,long>, fps_mean double, fps_std_sample double, fps_p95 double, stage_timing_ms map<string,struct<mean_ms:double,std_ms:double,n:long>>"


def sessions(spark: SparkSession, directory: str, timed: bool = False) -> DataFrame:
    """Session documents session_*.json; unreadable ones are left out; timed keeps those with stages."""
    out = spark.read.schema(SESSION).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "session_*.json").json(directory)
    return out.where("stage_timing_ms is not null") if timed else out


def session_rows(docs: DataFrame) -> DataFrame:
    """One flat row a session: dominant mode, stage means, and p95 with where it comes from."""
    from framewright.functions.arrays import dominant

    measured, estimated = F.col("fps_p95"), F.col("fps_mean") + 1.645 * F.col("fps_std_sample")
    source = F.when(measured.isNotNull(), "measured").when(estimated.isNotNull(), "estimated_mean_plus_1.645std").otherwise("missing")
    stage = lambda s: F.col("stage_timing_ms")[s]["mean_ms"]
    return docs.select("session_id", dominant(F.col("frames_by_mode"), None).alias("mode"), "duration_wall_s", "frames_total", "fps_mean", F.coalesce(measured, estimated).alias("fps_p95"), source.alias("p95_source"), stage("nir_bucket").alias("nir_ms"), stage("thermal_proc").alias("thermal_ms"), stage("fusion_composite").alias("fusion_ms"))


def stage_summary(docs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per stage over sessions: number, mean, deviation, p50, p95 and p99 of the session means."""
    long = docs.select(*keys, F.explode("stage_timing_ms").alias("stage", "t"))
    v = F.col("t.mean_ms")
    return long.groupBy(*keys, "stage").agg(F.count(v).alias("n_sessions"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), *[F.percentile(v, p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])


def listing(spark: SparkSession, directory: str, extensions: Sequence[str] = ()) -> DataFrame:
    """(path, modified, length) of all files below; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path", F.col("modificationTime").alias("modified"), "length")
    return df.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions)) if extensions else df


def artifact_class(path: Column) -> Column:
    """struct(kind, modality, evidence) from a path: the first rule that fits."""
    text, name = F.lower(path), F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = F.regexp_extract(name, r"\.([^.]+)$", 1)
    synthetic = text.contains("surrogate") | text.contains("synthetic")
    out = lambda k, m, e: F.struct(F.lit(k).alias("kind"), (m if isinstance(m, Column) else F.lit(m)).alias("modality"), (e if isinstance(e, Column) else F.lit(e)).alias("evidence"))
    table = suffix.isin("json", "jsonl", "csv")
    return (
        F.when(suffix.isin(*VIDEOS), out("video", "unknown", "unknown"))
        .when(suffix.isin(*DATA), out("numeric_sequence", F.when(text.contains("thermal"), "thermal").otherwise("unknown"), F.when(synthetic, "synthetic").otherwise("proxy")))
        .when(table & name.startswith("session_"), out("session_metrics", "metrics", "real_paired"))
        .when(table & name.startswith("manifest_"), out("run_manifest", "metrics", "real_paired"))
        .when(table & text.contains("metrics"), out("session_metrics", "metrics", "real_paired"))
        .when(table, out("sidecar_or_table", "metadata", "unknown"))
        .when(~suffix.isin(*IMAGES), out("unknown", "unknown", "unknown"))
        .when(name.rlike(r"^(auto_)?fusion_\d{8}-\d{6}\.") | name.rlike(r"^fus[_-]?\d"), out("fusion_output", "fusion", "real_paired"))
        .when(name.rlike(r"^(auto_)?thermal_\d{8}-\d{6}\.") | name.rlike(r"^thm[_-]?\d"), out("thermal_output", "thermal", F.when(synthetic, "synthetic").otherwise("real_paired")))
        .when(name.rlike(r"^(auto_)?imx_\d{8}-\d{6}\.") | name.rlike(r"^(auto_)?nir_\d") | name.rlike(r"^(auto_)?opt"), out("nir_raw", "nir", "real_paired"))
        .when(text.contains("weather") | text.contains("darkface") | text.contains("exdark"), out("nir_proxy_still", "nir", "proxy"))
        .otherwise(out("unknown_image", "unknown", "unknown"))
    )


def name_time(path: Column, modified: Column) -> Column:
    """struct(at, source): the time in a file name (three formats), else when it was modified."""
    name = F.element_at(F.split(path, "/"), -1)
    tries = [(r"(\d{8}-\d{6})", "yyyyMMdd-HHmmss"), (r"(\d{8}T\d{6})", "yyyyMMdd'T'HHmmss"), (r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})", "yyyy-MM-dd_HH-mm-ss")]
    found = F.coalesce(*[F.try_to_timestamp(F.nullif(F.regexp_extract(name, r, 1), F.lit("")), F.lit(f)) for r, f in tries])
    return F.struct(F.coalesce(found, modified).alias("at"), F.when(found.isNotNull(), "filename").otherwise("mtime").alias("source"))


def capture_mode(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    optical = name.contains("imx") | name.contains("opt") | name.contains("nir")
    return F.when(name.contains("thermal") | name.contains("thm"), "THERMAL").when(name.contains("fus"), "FUS").when(optical, "OPT").otherwise("OTHER")


def condition(path: Column, *sidecar: Column) -> Column:
    """Condition from sidecar values, else the first known word in the path."""
    text = F.lower(path)
    return F.coalesce(*[F.nullif(s, F.lit("")) for s in sidecar], *[F.when(text.contains(c), F.lit(c)) for c in CONDITIONS], F.lit(""))


def class_folders(spark: SparkSession, directory: str) -> DataFrame:
    """Images in a folder a class: (path, label)."""
    return listing(spark, directory, IMAGES).withColumn("label", F.element_at(F.split("path", "/"), -2))


def annotated(spark: SparkSession, annotations: str, images: DataFrame) -> DataFrame:
    """Images (path) with label weather|period from an annotation file, by file name; annotations
    without an image, and images without one, are left out."""
    one = "array<struct<filename:string,weather:string,period:string>>"
    text = spark.read.option("wholetext", True).text(annotations)
    found = F.coalesce(F.from_json("value", f"annotations {one}")["annotations"], F.from_json("value", one))
    rows = text.select(F.explode(found).alias("a")).select(F.element_at(F.split(F.replace("a.filename", F.lit("\\"), F.lit("/")), "/"), -1).alias("name"), F.concat_ws("|", F.coalesce("a.weather", F.lit("")), F.coalesce("a.period", F.lit(""))).alias("label"))
    return images.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(rows, "name").select("path", "label")


def prefix_labels(files: DataFrame) -> DataFrame:
    """label is the letters that the file name starts with; files without are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("label", F.lower(F.regexp_extract(name, r"^([A-Za-z]+)", 1))).where("label <> ''")


def without_segment(files: DataFrame, segment: str = "mask") -> DataFrame:
    return files.where(~F.array_contains(F.split(F.lower("path"), "/"), segment))


def shuffled_cap(files: DataFrame, cap: int, seed: int = 42, classes: Sequence[str] | None = None) -> DataFrame:
    """At most `cap` files in random order of a hash (a sampling source), of the classes if given."""
    files = files.where(F.col("label").isin(*classes)) if classes else files
    return files.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(cap)


def indexed(files: DataFrame, source: str) -> DataFrame:
    """files with their place by path in their source, to recover which file row k was."""
    return ranked(files.withColumn("source", F.lit(source)), ["source"], ["path"], "frame_idx")


VOC = "object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def boxes(spark: SparkSession, directory: str) -> DataFrame:
    """(stem, boxes) of Pascal VOC files; boxes without area are dropped."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(directory)
    stem = F.regexp_extract("path", r"([^/]+)\.xml$", 1)
    parsed = df.select(stem.alias("stem"), F.from_xml(F.col("content").cast("string"), VOC, {"mode": "PERMISSIVE"}).alias("x"))
    flat = F.transform(F.coalesce("x.object", F.array().cast("array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>")), lambda o: F.struct(F.lower(F.trim(o["name"])).alias("label"), o["bndbox"]["xmin"].alias("x0"), o["bndbox"]["ymin"].alias("y0"), o["bndbox"]["xmax"].alias("x1"), o["bndbox"]["ymax"].alias("y1")))
    return parsed.select("stem", F.filter(flat, lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])).alias("boxes"))


def paired_with_boxes(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images with their boxes by stem, and the orphans of both sides."""
    files = images.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1))
    return files.join(annotations, "stem"), files.join(annotations, "stem", "left_anti"), annotations.join(files, "stem", "left_anti")


def thermal_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame_idx, height, width, frame) of .npy files with one frame or a stack of them."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                a = np.load(io.BytesIO(c), allow_pickle=False)
                a = a[None] if a.ndim == 2 else a
                for i, f in enumerate(a):
                    yield pd.DataFrame({"path": [p], "frame_idx": [i], "height": [f.shape[0]], "width": [f.shape[1]], "frame": [f.astype(np.float32).ravel().tolist()]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(load, "path string, frame_idx int, height int, width int, frame array<float>")


PROBE = "streams array<struct<codec_type:string,codec_name:string,avg_frame_rate:string,r_frame_rate:string,nb_frames:string,width:int,height:int>>, format struct<duration:string,bit_rate:string>"


def probe(payload: Column) -> Column:
    """struct(codec, fps, duration, frames, resolution) of a video probe's JSON."""
    from framewright.functions.labels import rate

    j = F.from_json(payload, PROBE)
    v = F.element_at(F.filter(j["streams"], lambda s: s["codec_type"] == "video"), 1)
    fps = F.coalesce(F.nullif(rate(v["avg_frame_rate"]), F.lit(0.0)), F.nullif(rate(v["r_frame_rate"]), F.lit(0.0)), F.lit(0.0))
    duration = F.coalesce(j["format"]["duration"].try_cast("double"), F.lit(0.0))
    frames = F.coalesce(v["nb_frames"].try_cast("long"), F.bround(duration * fps).cast("long"))
    size = F.when((v["width"] > 0) & (v["height"] > 0), F.concat_ws("x", v["width"], v["height"])).otherwise("unknown")
    return F.struct(F.coalesce(v["codec_name"], F.lit("unknown")).alias("codec"), fps.alias("fps"), duration.alias("duration"), frames.alias("frames"), size.alias("resolution"))


def label_table(spark: SparkSession, mapping: dict) -> DataFrame:
    """A label mapping {dataset: {raw: {env, confidence}}} as rows (dataset, raw, env, confidence)."""
    rows = [(d, r, e.get("env"), float(e.get("confidence", 0.5))) for d, m in mapping.items() for r, e in m.items()]
    return spark.createDataFrame(rows, "dataset string, raw string, env string, confidence double")


def homography(text: str) -> list[list[float]]:
    """A 3 x 3 matrix from its JSON document, under `H` or by itself."""
    got = json.loads(text)
    return [[float(x) for x in r] for r in (got["H"] if isinstance(got, dict) else got)]
