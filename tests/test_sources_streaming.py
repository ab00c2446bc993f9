import json

import numpy as np
from pyspark.sql import functions as F

from framewright.operators import ordered
from framewright.sources import readers, writers
from framewright.streaming import machines


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "extra": 2}\n\n{"y": "q"}\nbroken\n')
    got = readers.jsonl(spark, f"{tmp_path}/a.jsonl", "x int, y string", strict=False).collect()
    assert {(r["x"], r["y"]) for r in got} == {(1, None), (None, "q")}
    try:
        readers.jsonl(spark, f"{tmp_path}/a.jsonl", "x int, y string").collect()
        raise AssertionError
    except Exception as e:
        assert not isinstance(e, AssertionError)
    assert readers.jsonl(spark, [f"{tmp_path}/none.jsonl"], "x int", missing_ok=True).count() == 0


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "fog", None), (2, "rain", 3.5)], "id int, label string, v double")
    writers.jsonl(df, f"{tmp_path}/j")
    assert readers.jsonl(spark, f"{tmp_path}/j", "id int, label string, v double").orderBy("id").collect() == df.collect()
    writers.by_label(df, f"{tmp_path}/l", "label")
    assert spark.read.json(f"{tmp_path}/l").select("id", "label").orderBy("id").collect() == df.select("id", "label").collect()
    writers.table(df, f"{tmp_path}/c", ["id", "label"])
    assert [r["label"] for r in readers.csv_strings(spark, f"{tmp_path}/c", ["id", "label"]).orderBy("id").collect()] == ["fog", "rain"]
    assert readers.csv_strings(spark, f"{tmp_path}/nothing", ["id"]).count() == 0
    assert writers.markdown(df.orderBy("id")).splitlines()[2] == "| 1 | fog |  |"
    assert json.loads(writers.run_manifest(spark, {"a": 1}))["flags"] == {"a": 1}
    assert {r["bytes"] > 0 for r in writers.file_manifest(spark, f"{tmp_path}/j").where("path like '%part%'").collect()} == {True}


def test_sessions(spark, tmp_path):
    doc = {"session_id": "s", "duration_wall_s": 60, "frames_total": 100, "frames_by_mode": {"imx": 80, "fusion": 20}, "fps_mean": 10.0, "fps_std_sample": 2.0, "stage_timing_ms": {"nir_bucket": {"mean_ms": 5.0, "std_ms": 1.0, "n": 3}}}
    (tmp_path / "session_1.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "other.json").write_text("{}")
    docs = readers.sessions(spark, str(tmp_path), timed=True)
    r = readers.session_rows(docs).first()
    assert (r["mode"], r["nir_ms"], r["fps_p95"], r["p95_source"]) == ("imx", 5.0, 10 + 1.645 * 2, "estimated_mean_plus_1.645std")
    assert readers.stage_summary(docs).first()["n_sessions"] == 1
    assert docs.count() == 1


def test_boxes(spark, tmp_path):
    box = lambda a, b, c, d: f"<object><name> Person </name><bndbox><xmin>{a}</xmin><ymin>{b}</ymin><xmax>{c}</xmax><ymax>{d}</ymax></bndbox></object>"
    (tmp_path / "p.xml").write_text(f"<annotation>{box(1, 2, 3, 4)}{box(5, 5, 5, 9)}</annotation>")
    (tmp_path / "q.xml").write_text("<annotation></annotation>")
    (tmp_path / "p.png").write_bytes(b"x")
    (tmp_path / "o.png").write_bytes(b"x")
    found = readers.boxes(spark, str(tmp_path))
    got = {r["stem"]: [(b["label"], b["x0"], b["y1"]) for b in r["boxes"]] for r in found.collect()}
    assert got == {"p": [("person", 1.0, 4.0)], "q": []}
    both, lone, bare = readers.paired_with_boxes(readers.listing(spark, str(tmp_path), readers.IMAGES), found)
    assert (both.count(), lone.count(), bare.count()) == (1, 1, 1)


def test_artifacts(spark):
    names = ["/a/fusion_20240101-101112.png", "/a/auto_imx_20240101-101112.jpg", "/x/surrogate/thermal.npy", "/m/session_1.json", "/weather/1.png", "/b/1.png", "/b/c.mp4", "/t/thm_1.png"]
    df = spark.createDataFrame([(n,) for n in names], "path string").select("path", readers.artifact_class(F.col("path")).alias("c"), readers.name_time(F.col("path"), F.lit(None).cast("timestamp")).alias("t"))
    got = {r["path"]: (r["c"]["kind"], r["c"]["evidence"]) for r in df.collect()}
    assert [got[n][0] for n in names] == ["fusion_output", "nir_raw", "numeric_sequence", "session_metrics", "nir_proxy_still", "unknown_image", "video", "thermal_output"]
    assert got[names[2]][1] == "synthetic"
    assert df.where("t.source = 'filename'").count() == 2


def test_thermal_frames_and_probe(spark, tmp_path):
    np.save(tmp_path / "s.npy", np.arange(24.0).reshape(2, 3, 4))
    got = readers.thermal_frames(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [(r["height"], r["width"], r["frame"][0]) for r in got] == [(3, 4, 0.0), (3, 4, 12.0)]
    payload = json.dumps({"streams": [{"codec_type": "video", "codec_name": "h264", "avg_frame_rate": "30000/1001", "width": 1280, "height": 720}], "format": {"duration": "10.0"}})
    p = spark.createDataFrame([(payload,)], "j string").select(readers.probe(F.col("j")).alias("p")).first()["p"]
    assert (p["codec"], p["resolution"], p["frames"]) == ("h264", "1280x720", 300) and abs(p["fps"] - 30000 / 1001) < 1e-9


def test_small_readers(spark, tmp_path):
    for d in ("fog", "rain"):
        (tmp_path / d).mkdir()
        (tmp_path / d / f"{d}12.png").write_bytes(b"x")
    files = readers.class_folders(spark, str(tmp_path))
    assert sorted(r["label"] for r in files.collect()) == ["fog", "rain"]
    assert sorted(r["label"] for r in readers.prefix_labels(files.drop("label")).collect()) == ["fog", "rain"]
    assert readers.shuffled_cap(files, 1, classes=["fog"]).count() == 1 and readers.without_segment(files, "fog").count() == 1
    assert [r["frame_idx"] for r in readers.indexed(files, "s").orderBy("path").collect()] == [0, 1]
    assert readers.label_table(spark, {"d": {"r": {"env": "fog"}}}).first()["confidence"] == 0.5
    assert readers.homography('{"H": [[1, 0, 0]]}') == [[1.0, 0.0, 0.0]]
    assert spark.range(1).select(writers.redacted(F.lit('{"p": "/home/x/y"}'))).first()[0] == '{"p": "<HOME>/y"}'


def test_annotations(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    (tmp_path / "b.png").write_bytes(b"x")
    items = [{"filename": "train\\a.png", "weather": "Rainy", "period": "Night"}, {"filename": "c.png", "weather": "x"}]
    for body in ({"annotations": items}, items):
        (tmp_path / "train.json").write_text(json.dumps(body))
        got = readers.annotated(spark, f"{tmp_path}/train.json", readers.listing(spark, str(tmp_path), readers.IMAGES)).collect()
        assert [(r["path"].rsplit("/", 1)[1], r["label"]) for r in got] == [("a.png", "Rainy|Night")]


def test_stream_equals_batch_over_micro_batches(spark, tmp_path):
    rows = [(k, i, float((i * 5 + k) % 9)) for i in range(60) for k in range(3)]
    for n in range(3):
        part = [r for r in rows if r[1] // 20 == n]
        spark.createDataFrame(part, "k int, i int, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, i int, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = machines.fold_stream(stream, "k", ["i"], ["v"], ordered.Ema, "e", "double", ["i"])
    got = machines.once(out, f"{tmp_path}/out").orderBy("k", "i").collect()
    batch = ordered.fold(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], ["i"], ["v"], ordered.Ema, "e", "double").orderBy("k", "i").collect()
    assert [(r["k"], r["i"], r["e"]) for r in got] == [(r["k"], r["i"], r["e"]) for r in batch]
