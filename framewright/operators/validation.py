"""Validation of feature records: rules that emit errors, and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.labels import ENV_CLASSES, LABEL_SOURCES, finite

# The core features and the channels.
CORE = ("nir_mean_brightness", "nir_std", "nir_entropy", "nir_p95", "nir_glare_score", "nir_sharpness", "nir_dark_fraction", "nir_saturation_mean", "hour_of_day_sin", "hour_of_day_cos", "prev_env_class", "nir_blue_mean_ema")
NIR_CHANNELS, THERMAL_CHANNELS = ("nir", "rgb"), ("lwir", "none")


def rules(columns: Sequence[str]) -> list[tuple[str, Column]]:
    """(message, test) of all rules whose columns are there."""
    c, have = F.col, set(columns)
    out: list[tuple[str, Column]] = []
    for f in CORE:
        if f in have:
            out.append((f"{f} is null", c(f).isNull()))
            out.append((f"{f} is not finite", F.isnan(c(f).cast("double")) | (F.abs(c(f).cast("double")) == float("inf"))))
    unless = lambda col, values: ~F.coalesce(c(col).isin(*values), F.lit(False))
    more = [
        (("nir_channel",), "invalid nir_channel", lambda: unless("nir_channel", NIR_CHANNELS)),
        (("thermal_channel",), "invalid thermal_channel", lambda: unless("thermal_channel", THERMAL_CHANNELS)),
        *[(("thermal_available", t), f"thermal_available but {t} is null", lambda t=t: c("thermal_available") & c(t).isNull()) for t in ("thm_mean", "thm_std", "thm_max")],
        (("temporal_available", "nir_brightness_delta_10f"), "temporal_available but delta is null", lambda: c("temporal_available") & c("nir_brightness_delta_10f").isNull()),
        (("source", "skew_ms"), "offline record has skew_ms", lambda: (F.coalesce(c("source"), F.lit("rpi")) != "rpi") & c("skew_ms").isNotNull()),
        (("source", "fusion_alpha"), "offline record has fusion_alpha", lambda: (F.coalesce(c("source"), F.lit("rpi")) != "rpi") & c("fusion_alpha").isNotNull()),
        (("label_source",), "invalid label_source", lambda: c("label_source").isNotNull() & unless("label_source", LABEL_SOURCES)),
        (("label_source", "label"), "dataset_original without label", lambda: (c("label_source") == "dataset_original") & (F.coalesce(c("label"), F.lit("")) == "")),
        (("label",), "invalid label", lambda: c("label").isNotNull() & unless("label", ENV_CLASSES)),
        (("weak_label",), "invalid weak_label", lambda: c("weak_label").isNotNull() & unless("weak_label", ENV_CLASSES)),
    ]
    return out + [(message, test()) for need, message, test in more if have >= set(need)]


def errors(rows: DataFrame, id_column: str, checks: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    """(id, error) for each rule that a row breaks."""
    checks = checks if checks is not None else rules(rows.columns)
    found = F.array_compact(F.array(*[F.when(test, F.lit(message)) for message, test in checks]))
    return rows.select(id_column, F.explode(found).alias("error"))


def verdict(rows: DataFrame, id_column: str, checks: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    """One row: records, bad records, errors, PASS or FAIL."""
    checks = checks if checks is not None else rules(rows.columns)
    n = sum((F.coalesce(test.cast("int"), F.lit(0)) for _, test in checks), F.lit(0))
    got = rows.select(n.alias("n")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n") > 0).alias("n_bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_errors"))
    return got.withColumn("verdict", F.when(F.col("n_errors") == 0, "PASS").otherwise("FAIL"))


def filter_records(rows: DataFrame, sources: Sequence[str] | None = None, thermal: bool = False, motion: bool = False, least_confidence: float | None = None, channel: str | None = None, labelled: bool = True, features: Sequence[str] = CORE) -> DataFrame:
    """Records fit for a data set: labelled, of the sources, sure enough if the label is a weak
    one, with the sensors and channel asked for, and complete."""
    out = rows.dropna(subset=[f for f in features if f in rows.columns])
    if labelled:
        out = out.where(F.coalesce(F.nullif("label", F.lit("")), F.nullif("weak_label", F.lit(""))).isNotNull())
    if sources:
        out = out.where(F.col("label_source").isin(*sources))
    if least_confidence is not None:
        out = out.where(~F.col("label_source").eqNullSafe(F.lit("weak_heuristic")) | (F.coalesce("label_confidence", F.lit(0.0)) >= least_confidence))
    if thermal:
        out = out.where("thermal_available")
    if motion:
        out = out.where("motion_available")
    return out.where(F.col("nir_channel") == channel) if channel else out


def failure_cases(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, failure_type, severity), none to many for each row of metrics and baselines. A metric
    that is null, NaN or infinite is missing, and a rule that needs it doesn't fit."""
    kinds = dict(rows.dtypes)
    c = lambda k: F.col(k) if kinds.get(k) in ("string", "boolean") else finite(F.col(k).cast("double"))
    more = lambda k: c(k) - c(f"baseline_{k}")
    sat, dark, noise, sharp, contrast = "pct_highlight_saturated", "pct_dark_clipped", "noise_proxy", "laplacian_variance", "rms_contrast"
    have = set(rows.columns)
    cases = [
        ((sat,), "clipping_increase", "medium", lambda: more(sat) >= 0.02),
        ((dark,), "clipping_increase", "medium", lambda: more(dark) >= 0.02),
        ((dark,), "crushed_shadows", "medium", lambda: c(dark) > F.greatest(c(f"baseline_{dark}") * 1.5, c(f"baseline_{dark}") + 0.05)),
        ((noise,), "noise_increase", "medium", lambda: c(noise) > F.greatest(c(f"baseline_{noise}") * 1.2, c(f"baseline_{noise}") + 0.5)),
        ((sharp, contrast), "sharpness_up_contrast_down", "low", lambda: (c(sharp) > c(f"baseline_{sharp}") * 1.1) & (c(contrast) < c(f"baseline_{contrast}") * 0.95)),
        ((contrast,), "contrast_drop", "medium", lambda: c(contrast) < c(f"baseline_{contrast}") * 0.85),
        (("foreground_contrast_gain",), "fusion_target_faded", "high", lambda: c("foreground_contrast_gain") < 0),
        (("ssim_fusion_nir_proxy",), "nir_detail_occlusion", "medium", lambda: more("ssim_fusion_nir_proxy") < -0.2),
        (("mask_area_ratio",), "mask_wrong_region", "high", lambda: (c("mask_area_ratio") > 0.7) | ((c("mask_area_ratio") > 0) & (c("mask_area_ratio") < 0.001))),
        (("alignment_status",), "alignment_drift", "high", lambda: F.lower("alignment_status").contains("fail") | F.lower("alignment_status").contains("unusable") | (F.coalesce(c("alignment_inlier_ratio"), F.lit(1.0)) < 0.2 if "alignment_inlier_ratio" in have else F.lit(False))),
    ]
    marks = [F.when(test(), F.struct(F.lit(t).alias("failure_type"), F.lit(s).alias("severity"))) for need, t, s, test in cases if have >= set(need)]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*marks))).alias("__f")).select(*keys, "__f.failure_type", "__f.severity")
