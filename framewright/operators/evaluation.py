"""Suggestions, review, relabelling, sweeps of hints, and verdicts on evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import labels, rules

# Metrics by what they can show, and words of cues.
DIRECT = ("foreground_contrast_gain", "thermal_saliency_retention", "nir_detail_retention")
PROXY = ("mutual_information_nir_fusion", "mutual_information_thermal_fusion", "normalized_mutual_information_nir_fusion", "normalized_mutual_information_thermal_fusion", "ssim_fusion_nir_proxy", "ssim_fusion_thermal_proxy", "qabf_edge_proxy")
INDOOR = ("indoor", "store", "aisle", "counter", "shelf", "refrigerator", "ceiling lamp", "convenience-store", "stairwell", "room", "workshop", "corridor", "hallway", "entrance")
SHADOW = ("shadow", "shade", "silhouette", "contrast", "clouds", "sky")


def metric_tier(metric: Column, tier: Column, source: Column, evidence: Column, no_reference: Sequence[str]) -> Column:
    """Tier of a metric, given how the pair was made."""
    real = (evidence == "real_paired") & tier.isin(*labels.STRICT_TIERS)
    direct = F.when(source == "paired_captured_fusion", "Tier 1").otherwise("Tier 3")
    return F.when(~real, "Tier 3").when(metric.isin(*DIRECT), direct).when(metric.isin(*PROXY), "Tier 3").when(metric.isin(*no_reference), "Tier 2").otherwise("Tier 3")


def suggestion(rf: Column, rf_conf: Column, heuristic: Column, h_conf: Column, high: float = 0.75, low: float = 0.45) -> Column:
    """struct(label, confidence, agreement): the model's label, unless the rules are surer or both are not sure."""
    unknown = (rf_conf < low) & (h_conf < 0.55)
    rule = ~unknown & (h_conf >= high) & (h_conf > rf_conf + 0.05)
    label = F.when(unknown, "unknown_or_out_of_scope").when(rule, heuristic).otherwise(rf)
    conf = F.when(unknown, F.greatest(rf_conf, h_conf)).when(rule, h_conf).otherwise(rf_conf)
    return F.struct(label.alias("label"), conf.alias("confidence"), (heuristic == rf).alias("agreement"))


def hint_sweep(rows: DataFrame, c1: str, p1: str, c2: str, p2: str, tau1: float, taus: Sequence[float]) -> DataFrame:
    """Per second threshold: rows, rows with a class, rows with a hint, and the rate. One pass: each
    threshold is a pair of counts of the same scan."""
    e = lambda t: rules.compose_env(F.col(c1), F.col(p1), F.col(c2), F.col(p2), tau1, t)
    aggs = [F.count_if(e(t)["hint"].isNotNull()).alias(f"h{i}") for i, t in enumerate(taus)]
    one = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(e(taus[0])["env"].isNotNull()).alias("n_active"), *aggs)
    long = one.select("n_rows", "n_active", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("tau2"), F.col(f"h{i}").alias("n_hint")) for i, t in enumerate(taus)])).alias("s"))
    return long.select("s.tau2", "n_rows", "n_active", "s.n_hint", F.when(F.col("n_active") > 0, F.col("s.n_hint") / F.col("n_active")).otherwise(0.0).alias("hint_rate"))


def evidence_verdict(rows: DataFrame) -> DataFrame:
    """One row: the verdict on rows (pair_status, target_roi_status, delta_luma, delta_chroma); an
    empty table has one as well."""
    luma, chroma = F.percentile(labels.finite(F.col("delta_luma")), 0.5), F.percentile(labels.finite(F.col("delta_chroma")), 0.5)
    got = rows.agg(F.count_if(F.col("pair_status") == "strict_quantitative").alias("s"), F.count_if(F.col("pair_status") == "qualitative_pair").alias("q"), F.count_if(F.col("target_roi_status") == "sufficient").alias("t"), luma.alias("l"), chroma.alias("c"))
    up = lambda x: F.coalesce(F.col(x) > 0, F.lit(False))
    target = F.col("t") > 0
    return got.select(F.when((F.col("s") > 0) & target & up("l"), "strict quantitative support").when((F.col("q") > 0) & target & (up("l") | up("c")), "weak/qualitative support").otherwise("not enough evidence").alias("verdict"))


def says(text: Column, words: Sequence[str]) -> Column:
    """Whether a lower-cased text has one of the words in it."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def relabelled(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """rows (frame_id, cues, notes, top1, top2, excluded) with exclusions of indoor scenes and close-ups,
    and with the two labels swapped where the prediction and the cues speak for it; adds action."""
    p = predictions.groupBy("frame_id").agg(F.max("model_top1").alias("__m"))
    t = rows.join(p, "frame_id", "left")
    cues, notes = F.lower(F.coalesce("cues", F.lit(""))), F.lower(F.coalesce("notes", F.lit("")))
    out = says(cues, INDOOR) | says(notes, INDOOR) | says(cues, ("close-up", "close up")) | says(notes, ("close-up", "close up"))
    open_, m = ~F.col("excluded") & ~out, F.col("__m")
    swap = open_ & (F.col("top1") == "normal_day") & (F.col("top2") == "backlight") & (m == "backlight") & says(cues, SHADOW)
    dim = open_ & (F.col("top1") == "glare") & (m == "backlight") & says(cues, SHADOW)
    bright = open_ & (F.col("top1") == "backlight") & (m == "glare") & cues.contains("canopy")
    action = F.when(~F.col("excluded") & out, "exclude").when(swap, "swap").when(dim, "to_backlight").when(bright, "to_glare").otherwise("none")
    t = t.withColumn("action", action)
    a = F.col("action")
    top1 = F.when(a.isin("swap", "to_backlight"), "backlight").when(a == "to_glare", "glare").otherwise(F.col("top1"))
    top2 = F.when(a == "swap", "normal_day").when(a == "to_backlight", "glare").when(a == "to_glare", "backlight").otherwise(F.col("top2"))
    return t.withColumns({"new1": top1, "new2": top2}).select("frame_id", F.col("new1").alias("top1"), F.col("new2").alias("top2"), (F.col("excluded") | (a == "exclude")).alias("excluded"), "action")


def label_file_status(rows: DataFrame, allowed: Sequence[str] = labels.ENV_CLASSES) -> DataFrame:
    """One row on a table (manual_label, suggested_label, accepted, label_confidence): confirmed
    labels by origin, invalid and unsure ones, and a status."""
    c = labels.confirmed_label(F.col("manual_label"), F.col("suggested_label"), F.col("accepted"))
    t = rows.select(c.alias("c"), labels.number(F.col("label_confidence")).alias("conf"))
    label, origin = F.col("c.label"), F.col("c.origin")
    got = t.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(label).alias("n_confirmed"), F.count_if(origin == "manual_label").alias("n_manual"), F.count_if(origin == "user_confirmed_suggested_label").alias("n_accepted"),
        F.count_if(label.isNotNull() & ~label.isin(*allowed)).alias("n_invalid"), F.count_if(label.isNotNull() & (F.col("conf") < 0.5)).alias("n_unsure"),
    )
    return got.withColumn("status", F.when(F.col("n_invalid") > 0, "invalid").when(F.col("n_confirmed") > 0, "completed_labels_available").otherwise("template_no_completed_labels"))


def latest_valid(files: DataFrame) -> DataFrame:
    """The newest file (path, modified, status) with completed labels; ties to the larger path."""
    return files.where("status = 'completed_labels_available'").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def recoverability(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: rows and whether the identity of its frames can be recovered, by the dimension
    (source, present, deterministic)."""
    n = rows.groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    status = F.when(~F.coalesce("present", F.lit(False)), "unresolved").when(F.col("deterministic"), "verified").otherwise("inferred_low_confidence")
    return n.join(sources, "source", "left").select("source", "n", status.alias("status"))
