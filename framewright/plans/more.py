"""Queries of rules, validation, scalars, images, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import arrays, images, labels, rules
from framewright.operators import evaluation, learning, ordered, validation
from framewright.operators.storage import new_path
from framewright.sources import readers, writers
from framewright.streaming import machines

from .catalog import rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CLASSES = "['night_clear', 'normal_night', 'normal_day', 'fog', 'rain', 'glare', 'backlight', 'transition', 'nir_night']"


def env_class(n):
    return F.element_at(F.array(*[F.lit(c) for c in labels.ENV_CLASSES]), (n % 9 + 1).cast("int"))


# ---- rules ----


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, {CLASSES}[l_partkey % 9 + 1] AS c1, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE {CLASSES}[l_suppkey % 9 + 1] END AS c2, l_quantity / 50 AS p1, l_discount * 5 AS p2 FROM lineitem),
k AS (SELECT *, c1 IN ('night_clear', 'normal_night', 'nir_night') AS n1, c2 IN ('night_clear', 'normal_night', 'nir_night') AS n2, c2 IS NULL OR c1 = c2 OR p2 < 0.2 AS alone FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN p1 < 0.62 THEN NULL WHEN alone THEN c1 WHEN c1 = 'normal_day' AND n2 THEN c2 ELSE c1 END AS env,
  CASE WHEN p1 < 0.62 OR alone OR (n1 AND n2) OR (n1 AND c2 = 'normal_day') OR (c1 = 'normal_day' AND n2) THEN NULL WHEN c1 IN ('fog', 'rain') AND n2 THEN c2 WHEN c2 IN ('fog', 'rain', 'glare') THEN c2 END AS hint FROM k""")
def env_compose(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", env_class(F.col("l_partkey")).alias("c1"), F.when(F.col("l_suppkey") % 11 != 0, env_class(F.col("l_suppkey"))).alias("c2"), (F.col("l_quantity") / 50).alias("p1"), (F.col("l_discount") * 5).alias("p2"))
    return t.select("l_orderkey", "l_linenumber", rules.compose_env(F.col("c1"), F.col("p1"), F.col("c2"), F.col("p2"), 0.62, 0.2).alias("e")).select("l_orderkey", "l_linenumber", "e.env", "e.hint")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 2.4 END AS b, l_extendedprice / 1500 AS s, l_discount > 0.08 AS g, l_tax > 0.07 AS h FROM lineitem),
k AS (SELECT *, list_filter([CASE WHEN h THEN 'fog' END, CASE WHEN b < 25 THEN 'night' END, CASE WHEN b >= 25 AND b < 38 THEN 'low_light' END, CASE WHEN b >= 95 THEN 'clear_day' END, CASE WHEN g THEN 'glare_heavy' END,
  CASE WHEN s < 18 AND (b IS NULL OR b >= 25) THEN 'haze' END, CASE WHEN s >= 18 AND s > 55 THEN 'cluttered_bg' END, CASE WHEN s >= 35 AND s <= 55 AND b BETWEEN 40 AND 90 THEN 'high_contrast' END, CASE WHEN g AND b >= 45 AND b < 85 THEN 'backlight' END], lambda x: x IS NOT NULL) AS t FROM t),
p AS (SELECT *, CASE WHEN len(t) = 0 THEN 'default' WHEN list_has_all(t, ['night', 'fog']) THEN 'night_fog' WHEN list_has_all(t, ['clear_day', 'glare_heavy']) THEN 'day_glare' WHEN list_has_all(t, ['low_light', 'cluttered_bg']) THEN 'low_light_cluttered' WHEN list_has_all(t, ['backlight', 'high_contrast']) THEN 'backlight_high_contrast'
  ELSE coalesce(list_filter(['glare_heavy', 'backlight_high_contrast', 'backlight', 'fog', 'haze', 'night', 'low_light', 'cluttered_bg', 'high_contrast', 'clear_day'], lambda x: list_contains(t, x))[1], 'default') END AS preset FROM k),
e AS (SELECT *, CASE preset WHEN 'night' THEN 'normal_night' WHEN 'low_light' THEN 'nir_night' WHEN 'glare_heavy' THEN 'glare' WHEN 'backlight' THEN 'backlight' WHEN 'backlight_high_contrast' THEN 'backlight' WHEN 'fog' THEN 'fog' WHEN 'haze' THEN 'fog' WHEN 'night_fog' THEN 'fog' WHEN 'clear_day' THEN 'normal_day' WHEN 'day_glare' THEN 'glare' WHEN 'high_contrast' THEN 'normal_day' WHEN 'low_light_cluttered' THEN 'nir_night' ELSE 'normal_night' END AS env FROM p)
SELECT l_orderkey, l_linenumber, array_to_string(t, ',') AS tags, preset, env, CASE env WHEN 'normal_night' THEN 'A' WHEN 'nir_night' THEN 'B' WHEN 'fog' THEN 'D' ELSE 'C' END AS bucket, CASE env WHEN 'normal_night' THEN 'A' ELSE 'B' END AS bucket_lite FROM e""")
def env_rules(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 2.4).alias("b"), (F.col("l_extendedprice") / 1500).alias("s"), (F.col("l_discount") > 0.08).alias("g"), (F.col("l_tax") > 0.07).alias("h"))
    t = t.withColumn("tags", rules.auto_tags(F.col("b"), F.col("s"), F.col("g"), F.col("h")))
    t = t.withColumn("preset", rules.preset_of(F.col("tags"))).withColumn("env", rules.env_class_of(F.col("preset")))
    return t.select("l_orderkey", "l_linenumber", F.array_join("tags", ",").alias("tags"), "preset", "env", rules.bucket_of(F.col("env")).alias("bucket"), rules.bucket_of(F.col("env"), lite=True).alias("bucket_lite"))


FEATURES = "SELECT l_orderkey, l_linenumber, l_quantity * 3 AS mean, l_extendedprice / 1000 AS std, l_quantity * 5 AS p95, l_discount AS glare, l_tax * 10 AS dark, l_extendedprice / 200 AS sharpness, l_quantity AS saturation, CASE WHEN l_suppkey % 2 = 0 THEN 'nir' ELSE 'unknown optical' END AS modality, l_quantity / 50 AS conf, l_returnflag AS flag FROM lineitem"
HEURISTIC = f"""
SELECT *, CASE WHEN glare >= 0.08 OR p95 >= 245 THEN 'glare' WHEN glare >= 0.035 AND dark >= 0.15 THEN 'backlight' WHEN dark >= 0.65 AND mean < 60 THEN CASE WHEN modality = 'nir' THEN 'nir_night' ELSE 'normal_night' END
  WHEN sharpness < 180 AND std < 42 AND mean > 40 THEN 'fog' WHEN mean >= 70 AND dark < 0.2 THEN 'normal_day' WHEN saturation < 8 AND mean < 85 THEN 'normal_night' ELSE 'unknown_or_out_of_scope' END AS label,
  CASE WHEN glare >= 0.08 OR p95 >= 245 THEN least(0.78, 0.45::DOUBLE + glare * 3) WHEN glare >= 0.035 AND dark >= 0.15 THEN 0.58 WHEN dark >= 0.65 AND mean < 60 THEN CASE WHEN modality = 'nir' THEN 0.62 ELSE 0.55 END
  WHEN sharpness < 180 AND std < 42 AND mean > 40 THEN 0.58 WHEN mean >= 70 AND dark < 0.2 THEN 0.52 WHEN saturation < 8 AND mean < 85 THEN 0.45 ELSE 0.25 END::DOUBLE AS hc FROM ({FEATURES})"""


def frames(spark, sf) -> DataFrame:
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (q * 3).alias("mean"), (e / 1000).alias("std"), (q * 5).alias("p95"), F.col("l_discount").alias("glare"), (F.col("l_tax") * 10).alias("dark"), (e / 200).alias("sharpness"), q.alias("saturation"), F.when(F.col("l_suppkey") % 2 == 0, "nir").otherwise("unknown optical").alias("modality"), (q / 50).alias("conf"), F.col("l_returnflag").alias("flag"))
    return t.withColumn("h", rules.heuristic_label(*[F.col(c) for c in ("mean", "std", "p95", "glare", "dark", "sharpness", "saturation", "modality")]))


@query(f"SELECT l_orderkey, l_linenumber, label, round(hc, 9) AS confidence FROM ({HEURISTIC})")
def heuristic_label(spark, sf):
    return rounded(frames(spark, sf).select("l_orderkey", "l_linenumber", "h.label", "h.confidence"), "confidence", digits=9)


@query(f"""
WITH t AS (SELECT *, CASE flag WHEN 'A' THEN 'glare' WHEN 'N' THEN 'fog' ELSE 'nir_night' END AS rf, 2 * (1 - conf) AS entropy FROM ({HEURISTIC})), s AS (SELECT *, CASE WHEN conf < 0.45 THEN label ELSE rf END AS sug FROM t),
p AS (SELECT *, [CASE WHEN conf < 0.45 THEN 3.0 WHEN conf < 0.62 THEN 1.5 ELSE 0 END, CASE WHEN entropy >= 1 THEN least(2.0, entropy) ELSE 0 END, CASE WHEN label <> 'unknown_or_out_of_scope' AND label <> rf THEN 2 ELSE 0 END, CASE WHEN sug IN ('glare', 'backlight', 'transition', 'nir_night') THEN 2 ELSE 0 END, CASE WHEN sug = 'transition' THEN 1 ELSE 0 END,
  CASE WHEN sug = 'nir_night' AND modality LIKE '%unknown%' THEN 2 ELSE 0 END, CASE WHEN sug = 'unknown_or_out_of_scope' THEN 2 ELSE 0 END, CASE WHEN hc < 0.5 THEN 0.5 ELSE 0 END]::DOUBLE[] AS pts FROM s)
SELECT l_orderkey, l_linenumber, round(list_sum(pts), 6) AS score, CASE WHEN list_sum(pts) >= 4 THEN 'high' WHEN list_sum(pts) >= 2 THEN 'medium' ELSE 'low' END AS priority, list_sum(pts) >= 2 AS review FROM p""")
def review_priority(spark, sf):
    rf = F.when(F.col("flag") == "A", "glare").when(F.col("flag") == "N", "fog").otherwise("nir_night")
    t = frames(spark, sf).withColumns({"rf": rf, "entropy": 2 * (1 - F.col("conf")), "sug": F.when(F.col("conf") < 0.45, F.col("h.label")).otherwise(rf)})
    p = rules.review_priority(F.col("sug"), F.col("rf"), F.col("conf"), F.col("h.label"), F.col("h.confidence"), F.col("entropy"), F.col("modality"))
    return rounded(t.withColumn("p", p).select("l_orderkey", "l_linenumber", "p.score", "p.priority", "p.review"), "score")


@query(f"""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN 'cloud' ELSE {CLASSES}[o_orderkey % 9 + 1] END AS label, CASE o_orderstatus WHEN 'F' THEN 'manual' WHEN 'O' THEN 'weak_heuristic' ELSE 'none' END AS source, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE (o_totalprice / 550000)::VARCHAR END AS conf, o_totalprice / 550000 AS c FROM orders),
r AS (SELECT *, CASE WHEN label IN ('', 'unknown') THEN 'missing_or_unknown_label' WHEN label = 'cloud' THEN 'invalid_taxonomy_label' WHEN source <> 'manual' THEN 'untrusted_label_source' WHEN conf = 'x' OR c < 0.8 THEN 'low_or_invalid_label_confidence' ELSE 'trusted_label' END AS reason FROM t)
SELECT o_orderkey, reason, CASE WHEN reason = 'trusted_label' THEN label END AS trusted, CASE WHEN reason = 'trusted_label' THEN 'labeled' WHEN source LIKE '%weak%' THEN 'weak_label' WHEN source <> 'none' THEN 'proxy' ELSE 'unlabeled' END AS evidence,
  CASE WHEN label <> '' THEN 'manual_label' WHEN o_orderkey % 2 = 0 THEN 'user_confirmed_suggested_label' END AS origin, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 'verified' WHEN o_orderkey % 11 = 0 THEN 'inferred_low_confidence' ELSE 'unresolved' END AS status, coalesce(nullif(label, ''), 'unlabeled') AS effective FROM r""")
def label_gates(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_totalprice") / 550000
    label = F.when(k % 13 == 0, "").when(k % 17 == 0, "cloud").otherwise(env_class(k))
    source = F.when(F.col("o_orderstatus") == "F", "manual").when(F.col("o_orderstatus") == "O", "weak_heuristic").otherwise("none")
    t = table(spark, sf, "orders").select(k, label.alias("label"), source.alias("source"), F.when(k % 5 == 0, "x").otherwise(c.cast("string")).alias("conf"))
    t = t.withColumn("t", labels.trusted_label(F.col("label"), F.col("source"), F.col("conf")))
    confirmed = labels.confirmed_label(F.col("label"), F.lit("fog"), F.when(k % 2 == 0, " Yes ").otherwise("no"))
    status = labels.metadata_status(k % 3 == 0, k % 7 == 0, k % 11 == 0)
    return t.select(k, F.col("t.reason"), F.col("t.label").alias("trusted"), labels.evidence_type(F.col("t.label"), F.col("source")).alias("evidence"), confirmed["origin"].alias("origin"), status["status"].alias("status"), labels.effective_label(F.col("label"), F.lit(None).cast("string")).alias("effective"))


@query("""
WITH t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value * 40 * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END END AS skew, user_id % 6 = 0 AS same, user_id % 7 <> 0 AS complete FROM events),
r AS (SELECT *, CASE WHEN NOT complete THEN 'unpaired' WHEN skew IS NULL THEN 'weak_paired' WHEN same THEN 'frame_strict' WHEN abs(skew) <= 100 THEN 'time_strict_100ms' WHEN abs(skew) <= 1000 THEN 'protocol_strict_1s' WHEN abs(skew) <= 5000 THEN 'near_paired' ELSE 'weak_paired' END AS tier FROM t),
e AS (SELECT *, CASE WHEN tier IN ('frame_strict', 'time_strict_100ms', 'protocol_strict_1s') THEN 'real_paired' WHEN tier IN ('near_paired', 'weak_paired') THEN 'proxy' ELSE 'unpaired' END AS evidence FROM r)
SELECT event_id, tier, evidence, CASE WHEN abs(skew) / 1000 <= 1 THEN 'strict_quantitative' WHEN abs(skew) / 1000 <= 20 THEN 'qualitative_pair' ELSE 'reject' END AS status, CASE WHEN evidence <> 'real_paired' THEN 'Tier 3' WHEN same THEN 'Tier 1' ELSE 'Tier 3' END AS failure_tier FROM e""")
def pairing_tiers(spark, sf):
    i = F.col("event_id")
    t = table(spark, sf, "events").select(i, F.when(i % 10 != 0, F.col("value") * 40 * F.when(i % 2 == 0, 1).otherwise(-1)).alias("skew"), (F.col("user_id") % 6 == 0).alias("same"), (F.col("user_id") % 7 != 0).alias("complete"))
    t = t.withColumn("tier", rules.skew_tier(F.col("skew"), F.col("same"), F.col("complete"))).withColumn("evidence", rules.evidence_label(F.col("tier")))
    source = F.when(F.col("same"), "paired_captured_fusion").otherwise("rendered")
    return t.select(i, "tier", "evidence", rules.gap_status(F.abs("skew") / 1000).alias("status"), rules.failure_tier(F.lit("alignment_drift"), source, F.col("tier"), F.col("evidence")).alias("failure_tier"))


@query("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS m, CASE WHEN o_orderkey % 8 = 0 THEN 'uv' ELSE 'nir' END AS ch, o_orderkey % 4 = 0 AS ta, CASE WHEN o_orderkey % 12 <> 0 THEN 1.0 END AS tm, CASE WHEN o_orderkey % 2 = 0 THEN 'rpi' ELSE 'offline' END AS src, CASE WHEN o_orderkey % 5 = 0 THEN 3.0 END AS skew, CASE WHEN o_orderkey % 7 = 0 THEN 'cloud' ELSE 'fog' END AS lab FROM orders)
SELECT o_orderkey, unnest(list_filter([CASE WHEN m IS NULL THEN 'nir_mean_brightness is null' END, CASE WHEN ch = 'uv' THEN 'invalid nir_channel' END, CASE WHEN ta AND tm IS NULL THEN 'thermal_available but thm_mean is null' END, CASE WHEN src <> 'rpi' AND skew IS NOT NULL THEN 'offline record has skew_ms' END, CASE WHEN lab = 'cloud' THEN 'invalid label' END], lambda x: x IS NOT NULL)) AS error FROM t""")
def validation_errors(spark, sf):
    return validation.errors(records(spark, sf), "o_orderkey")


def records(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k, F.when(k % 9 != 0, F.col("o_totalprice")).alias("nir_mean_brightness"), F.when(k % 8 == 0, "uv").otherwise("nir").alias("nir_channel"), (k % 4 == 0).alias("thermal_available"), F.when(k % 12 != 0, 1.0).alias("thm_mean"), F.when(k % 2 == 0, "rpi").otherwise("offline").alias("source"), F.when(k % 5 == 0, 3.0).alias("skew_ms"), F.when(k % 7 == 0, "cloud").otherwise("fog").alias("label"))


@query("""
WITH t AS (SELECT (o_orderkey % 9 = 0)::INT + (o_orderkey % 8 = 0)::INT + (o_orderkey % 12 = 0)::INT + (o_orderkey % 2 = 1 AND o_orderkey % 5 = 0)::INT + (o_orderkey % 7 = 0)::INT AS n FROM orders)
SELECT count(*) AS n_rows, count_if(n > 0)::BIGINT AS n_bad, sum(n)::BIGINT AS n_errors, CASE WHEN sum(n) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM t""")
def validation_verdict(spark, sf):
    return validation.verdict(records(spark, sf), "o_orderkey")


@query("""SELECT o_orderkey, label FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'fog' END AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'weak_heuristic' ELSE 'manual' END AS ls, o_totalprice / 550000 AS conf, o_orderkey % 5 <> 0 AS ta, CASE WHEN o_orderkey % 7 <> 0 THEN 1.0 END AS f FROM orders) WHERE label IS NOT NULL AND f IS NOT NULL AND ta AND (ls <> 'weak_heuristic' OR conf >= 0.5)""")
def record_filter(spark, sf):
    k = F.col("o_orderkey")
    t = table(spark, sf, "orders").select(k, F.when(k % 3 == 0, "fog").alias("label"), F.lit("").alias("weak_label"), F.when(k % 2 == 0, "weak_heuristic").otherwise("manual").alias("label_source"), (F.col("o_totalprice") / 550000).alias("label_confidence"), (k % 5 != 0).alias("thermal_available"), F.when(k % 7 != 0, 1.0).alias("nir_std"))
    return validation.filter_records(t, sources=["manual", "weak_heuristic"], thermal=True, least_confidence=0.5).select("o_orderkey", "label")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_discount AS sat, l_tax AS bsat, l_quantity AS noise, 25.0 AS bnoise, l_extendedprice / 1000 AS c, 40.0 AS bc, l_extendedprice / 900 AS sh, 30.0 AS bsh, l_tax * 12 AS mask FROM lineitem)
SELECT l_orderkey, l_linenumber, f.t AS failure_type, f.s AS severity FROM (SELECT *, unnest(list_filter([CASE WHEN sat - bsat >= 0.02 THEN {'t': 'clipping_increase', 's': 'medium'} END, CASE WHEN noise > greatest(bnoise * 1.2, bnoise + 0.5) THEN {'t': 'noise_increase', 's': 'medium'} END,
  CASE WHEN sh > bsh * 1.1 AND c < bc * 0.95 THEN {'t': 'sharpness_up_contrast_down', 's': 'low'} END, CASE WHEN c < bc * 0.85 THEN {'t': 'contrast_drop', 's': 'medium'} END, CASE WHEN mask > 0.7 OR (mask > 0 AND mask < 0.001) THEN {'t': 'mask_wrong_region', 's': 'high'} END], lambda x: x IS NOT NULL)) AS f FROM t)""")
def failure_cases(spark, sf):
    e = F.col("l_extendedprice")
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("pct_highlight_saturated"), F.col("l_tax").alias("baseline_pct_highlight_saturated"), F.col("l_quantity").alias("noise_proxy"), F.lit(25.0).alias("baseline_noise_proxy"), (e / 1000).alias("rms_contrast"), F.lit(40.0).alias("baseline_rms_contrast"), (e / 900).alias("laplacian_variance"), F.lit(30.0).alias("baseline_laplacian_variance"), (F.col("l_tax") * 12).alias("mask_area_ratio"))
    return validation.failure_cases(t, ["l_orderkey", "l_linenumber"])


@query(f"""
WITH t AS (SELECT *, CASE flag WHEN 'A' THEN 'glare' WHEN 'N' THEN 'fog' ELSE 'nir_night' END AS rf FROM ({HEURISTIC})), u AS (SELECT *, conf < 0.45 AND hc < 0.55 AS unknown FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN unknown THEN 'unknown_or_out_of_scope' WHEN hc >= 0.75 AND hc > conf + 0.05 THEN label ELSE rf END AS suggested, round(CASE WHEN unknown THEN greatest(conf, hc) WHEN hc >= 0.75 AND hc > conf + 0.05 THEN hc ELSE conf END, 9) AS confidence, label = rf AS agreement FROM u""")
def label_suggestions(spark, sf):
    rf = F.when(F.col("flag") == "A", "glare").when(F.col("flag") == "N", "fog").otherwise("nir_night")
    s = evaluation.suggestion(rf, F.col("conf"), F.col("h.label"), F.col("h.confidence"))
    out = frames(spark, sf).withColumn("s", s)
    return rounded(out.select("l_orderkey", "l_linenumber", F.col("s.label").alias("suggested"), "s.confidence", "s.agreement"), "confidence", digits=9)


@query(f"""
WITH t AS (SELECT {CLASSES}[l_partkey % 9 + 1] AS c1, {CLASSES}[l_suppkey % 9 + 1] AS c2, l_quantity / 50 AS p1, l_discount * 5 AS p2 FROM lineitem), x AS (SELECT unnest([0.1, 0.2, 0.4])::DOUBLE AS tau2),
k AS (SELECT *, c1 IN ('night_clear', 'normal_night', 'nir_night') AS n1, c2 IN ('night_clear', 'normal_night', 'nir_night') AS n2 FROM t, x),
h AS (SELECT *, p1 >= 0.62 AND c1 <> c2 AND p2 >= tau2 AND NOT (n1 AND (n2 OR c2 = 'normal_day')) AND NOT (c1 = 'normal_day' AND n2) AND ((c1 IN ('fog', 'rain') AND n2) OR c2 IN ('fog', 'rain', 'glare')) AS hint FROM k)
SELECT tau2, count(*) AS n_rows, count_if(p1 >= 0.62)::BIGINT AS n_active, count_if(hint)::BIGINT AS n_hint, round(count_if(hint) / count_if(p1 >= 0.62), 9) AS hint_rate FROM h GROUP BY 1""")
def secondary_threshold_sweep(spark, sf):
    t = table(spark, sf, "lineitem").select(env_class(F.col("l_partkey")).alias("c1"), env_class(F.col("l_suppkey")).alias("c2"), (F.col("l_quantity") / 50).alias("p1"), (F.col("l_discount") * 5).alias("p2"))
    return rounded(evaluation.hint_sweep(t, "c1", "p1", "c2", "p2", 0.62, [0.1, 0.2, 0.4]), "hint_rate", digits=9)


@query("""
SELECT CASE WHEN s > 0 AND t > 0 AND l > 0 THEN 'strict quantitative support' WHEN q > 0 AND t > 0 AND (l > 0 OR c > 0) THEN 'weak/qualitative support' ELSE 'not enough evidence' END AS verdict FROM (
  SELECT count_if(l_linenumber = 1) AS s, count_if(l_linenumber = 2) AS q, count_if(l_tax > 0.05) AS t, median(l_quantity - 26.5) AS l, median(l_discount - 0.01) AS c FROM lineitem)""")
def evidence_verdict(spark, sf):
    n = F.col("l_linenumber")
    t = table(spark, sf, "lineitem").select(F.when(n == 1, "strict_quantitative").when(n == 2, "qualitative_pair").otherwise("reject").alias("pair_status"), F.when(F.col("l_tax") > 0.05, "sufficient").otherwise("none").alias("target_roi_status"), (F.col("l_quantity") - 26.5).alias("delta_luma"), (F.col("l_discount") - 0.01).alias("delta_chroma"))
    return evaluation.evidence_verdict(t)


@query("""
WITH t AS (SELECT o_orderkey AS id, ['open sky with clouds', 'store aisle', 'canopy ahead', 'plain road'][o_orderkey % 4 + 1] AS cues, CASE WHEN o_orderkey % 11 = 0 THEN 'Close-up' ELSE '' END AS notes, ['normal_day', 'glare', 'backlight'][o_orderkey % 3 + 1] AS t1, 'backlight' AS t2, o_orderkey % 13 = 0 AS ex, CASE WHEN o_orderkey % 5 < 4 THEN ['backlight', 'glare'][o_orderkey % 2 + 1] END AS m FROM orders),
a AS (SELECT *, CASE WHEN ex THEN 'none' WHEN cues = 'store aisle' OR notes <> '' THEN 'exclude' WHEN t1 = 'normal_day' AND m = 'backlight' AND cues LIKE '%sky%' THEN 'swap' WHEN t1 = 'glare' AND m = 'backlight' AND cues LIKE '%sky%' THEN 'to_backlight' WHEN t1 = 'backlight' AND m = 'glare' AND cues LIKE '%canopy%' THEN 'to_glare' ELSE 'none' END AS action FROM t)
SELECT id AS frame_id, CASE action WHEN 'swap' THEN 'backlight' WHEN 'to_backlight' THEN 'backlight' WHEN 'to_glare' THEN 'glare' ELSE t1 END AS top1, CASE action WHEN 'swap' THEN 'normal_day' WHEN 'to_backlight' THEN 'glare' WHEN 'to_glare' THEN 'backlight' ELSE t2 END AS top2, ex OR action = 'exclude' AS excluded, action FROM a""")
def relabelled_frames(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda names, m: F.element_at(F.array(*[F.lit(x) for x in names]), (k % m + 1).cast("int"))
    o = table(spark, sf, "orders")
    t = o.select(k.alias("frame_id"), pick(("open sky with clouds", "store aisle", "canopy ahead", "plain road"), 4).alias("cues"), F.when(k % 11 == 0, "Close-up").otherwise("").alias("notes"), pick(("normal_day", "glare", "backlight"), 3).alias("top1"), F.lit("backlight").alias("top2"), (k % 13 == 0).alias("excluded"))
    return evaluation.relabelled(t, o.where(k % 5 < 4).select(k.alias("frame_id"), pick(("backlight", "glare"), 2).alias("model_top1")))


@query("""
WITH t AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'fog' WHEN o_orderkey % 9 = 0 THEN 'cloud' ELSE '' END AS m, CASE WHEN o_orderkey % 3 = 0 THEN 'rain' END AS s, o_orderkey % 2 = 0 AS a, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice / 550000 END AS c FROM orders),
k AS (SELECT *, coalesce(nullif(m, ''), CASE WHEN a THEN s END) AS label FROM t)
SELECT count(*) AS n_rows, count(label) AS n_confirmed, count_if(m <> '')::BIGINT AS n_manual, count_if(m = '' AND label IS NOT NULL)::BIGINT AS n_accepted, count_if(label = 'cloud')::BIGINT AS n_invalid, count_if(label IS NOT NULL AND c < 0.5)::BIGINT AS n_unsure, 'invalid' AS status FROM k""")
def label_file_report(spark, sf):
    k = F.col("o_orderkey")
    t = table(spark, sf, "orders").select(F.when(k % 4 == 0, "fog").when(k % 9 == 0, "cloud").otherwise("").alias("manual_label"), F.when(k % 3 == 0, "rain").alias("suggested_label"), F.when(k % 2 == 0, "yes").otherwise("no").alias("accepted"), F.when(k % 6 == 0, "n/a").otherwise((F.col("o_totalprice") / 550000).cast("string")).alias("label_confidence"))
    return evaluation.label_file_status(t)


@query("""SELECT source, count(*) AS n, CASE WHEN source = 'src1' THEN 'verified' WHEN source IN ('src2', 'src3') THEN 'inferred_low_confidence' ELSE 'unresolved' END AS status FROM documents GROUP BY 1""")
def source_recoverability(spark, sf):
    dim = spark.createDataFrame([("src1", True, True), ("src2", True, False), ("src3", True, False), ("src4", False, True)], "source string, present boolean, deterministic boolean")
    return evaluation.recoverability(table(spark, sf, "documents"), dim)


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 OR event_id % 6 = 0 THEN 'Tier 3' WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'Tier 1' ELSE 'Tier 3' END WHEN event_type = 'view' THEN 'Tier 3' WHEN event_type = 'error' THEN 'Tier 2' ELSE 'Tier 3' END AS tier FROM events""")
def metric_tiers(spark, sf):
    kind = F.col("event_type")
    metric = F.when(kind == "click", "nir_detail_retention").when(kind == "view", "qabf_edge_proxy").when(kind == "error", "entropy").otherwise("other")
    source = F.when(F.col("event_id") % 2 == 0, "paired_captured_fusion").otherwise("rendered")
    tier = evaluation.metric_tier(metric, F.when(F.col("user_id") % 4 == 0, "near_paired").otherwise("frame_strict"), source, F.when(F.col("event_id") % 6 == 0, "proxy").otherwise("real_paired"), ["entropy"])
    return table(spark, sf, "events").select("event_id", tier.alias("tier"))


@query()
def thermal_sequence(spark, sf):
    """Per-pixel filters over frames in order: noise filter, background heat and normalised frames."""
    t = table(spark, sf, "embeddings").select((F.col("vec_id") % 10).alias("seq"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double") * 50 + 25).alias("px"))
    out = ordered.fold(t, ["seq"], ["frame"], ["px"], lambda: ordered.FrameFilter(ordered.Ema(0.65)), "denoised", "array<double>")
    out = ordered.fold(out, ["seq"], ["frame"], ["px"], lambda: ordered.FrameFilter(ordered.Kalman()), "kalman", "array<double>")
    out = ordered.fold(out, ["seq"], ["frame"], ["px"], lambda: ordered.Background(warm_up=5), "heat", "array<double>")
    out = ordered.fold(out, ["seq"], ["frame"], ["px"], lambda: ordered.ThermalNormaliser(least=10), "grey", "array<double>")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    return out.select("seq", "frame", *[mean(c).alias(c) for c in ("denoised", "kalman", "heat", "grey")])


# ---- scalars and arrays ----


@query("""
SELECT event_id, CASE WHEN b < -6 THEN 'LEFT' WHEN b > 6 THEN 'RIGHT' ELSE 'CENTER' END AS sector, round(b, 9) AS bearing, round(sin(a), 9) + 0 AS hour_sin, round(cos(a), 9) + 0 AS hour_cos, k FROM (
  SELECT event_id, degrees(atan((value * 2 - 159.5) / (159.5 / tan(radians(60.0) * 0.5)))) AS b, 2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24 AS a, (props->>'$.k')::BIGINT AS k FROM events)""")
def scalar_geometry(spark, sf):
    t = table(spark, sf, "events")
    b, _ = rules.bearing(F.col("value") * 2, F.lit(0.0), 320, 240, 60.0, 45.0)
    s, c = rules.hour_angle(F.unix_micros("ts") / 1e6)
    return rounded(t.select("event_id", rules.sector(b).alias("sector"), b.alias("bearing"), s.alias("hour_sin"), c.alias("hour_cos"), F.get_json_object("props", "$.k").cast("long").alias("k")), "bearing", "hour_sin", "hour_cos", digits=9)


@query("""
SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS file, CASE WHEN url LIKE '%/en/%' THEN 'en' WHEN url LIKE '%/de/%' THEN 'de' ELSE '' END AS lang, regexp_replace(trim(url), '[^\\p{L}\\p{N}._-]', '_', 'g') AS safe, sha256(url) AS digest FROM pages""")
def text_scalars(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", labels.file_name(u).alias("file"), F.when(u.contains("/en/"), "en").when(u.contains("/de/"), "de").otherwise("").alias("lang"), labels.safe_name(u).alias("safe"), F.sha2(u, 256).alias("digest"))


@query("""
WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), q AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p, event_type FROM p)
SELECT user_id, round(-sum(p * log2(p)), 9) AS entropy, round(sum((p - (event_type = 'click')::INT) ** 2) + CASE WHEN count_if(event_type = 'click') = 0 THEN 1 ELSE 0 END, 9) AS brier FROM q GROUP BY 1""")
def posterior_scores(spark, sf):
    kinds = ["click", "error", "purchase", "signup", "view"]
    got = table(spark, sf, "events").groupBy("user_id").agg(F.array(*[F.avg((F.col("event_type") == k).cast("double")) for k in kinds]).alias("p"))
    return rounded(got.select("user_id", arrays.entropy_bits(F.col("p")).alias("entropy"), arrays.brier(F.col("p"), F.lit(0)).alias("brier")), "entropy", "brier", digits=9)


@query("""
WITH c AS (SELECT l_linenumber, l_quantity::INT AS v, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT l_linenumber, sum(n) AS total FROM c GROUP BY 1), g AS (SELECT l_linenumber, v FROM t, generate_series(0, 255) s(v)),
r AS (SELECT g.l_linenumber, g.v, sum(coalesce(n, 0)) OVER (PARTITION BY g.l_linenumber ORDER BY g.v) AS cdf FROM g LEFT JOIN c USING (l_linenumber, v))
SELECT r.l_linenumber, min(v)::DOUBLE AS p95 FROM r JOIN t USING (l_linenumber) WHERE cdf >= greatest(0, least(ceil(95.0::DOUBLE / 100 * total) - 1, total - 1)) GROUP BY 1""")
def histogram_percentile(spark, sf):
    one = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.array(*[F.count_if(F.col("l_quantity").cast("int") == v) for v in range(256)]).alias("h"))
    return one.select("l_linenumber", arrays.histogram_percentile(F.col("h"), 95.0).alias("p95"))


@query("""SELECT p_partkey, unnest(list_slice(range(0, p_size, greatest(1, floor((p_size % 7 + 1) / 2.0)::INT)), 1, 6))::INT AS frame FROM part""")
def frame_sampling(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.explode(arrays.sampled_frames(F.col("p_size").cast("int"), F.col("p_size") % 7 + 1, 2.0, 6)).alias("frame"))
    return t


@query("""
WITH m AS (SELECT event_type, avg(value) AS m, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS s FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT event_id, round(coalesce((value - m) / s, value), 6) AS value FROM events LEFT JOIN m USING (event_type)""")
def scale_by_group(spark, sf):
    t = table(spark, sf, "events").select("event_id", "event_type", "value")
    out = learning.scale(t, learning.fit_scalers(t.where("event_type <> 'view'"), "event_type", ["value"]), "event_type", ["value"])
    return rounded(out.select("event_id", "value"), "value")


@query("""
WITH s AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) DESC, t.vec_id) AS r FROM embeddings q JOIN embeddings t ON q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
v AS (SELECT vec_id, label, count(*) AS n FROM s WHERE r <= 5 GROUP BY ALL)
SELECT vec_id, arg_min(label, {'o': -n, 'l': label}) AS predicted, max(n) AS votes FROM v GROUP BY 1""")
def embedding_knn(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return learning.nearest_classes(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), "vec_id", "embedding", "label", 5)


@query()
def classifier_predictions(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_tax", (F.col("l_shipdate").cast("timestamp").cast("double") / 86400).alias("day"))
    features = ["l_quantity", "l_discount", "l_tax", "day"]
    model = learning.train(t.where("l_orderkey % 5 <> 0"), features, "l_returnflag", learning.classifiers()["tree"])
    return learning.predict_top2(model, t.where("l_orderkey % 5 = 0"), ["l_orderkey", "l_linenumber", "l_returnflag"])


WIDE = 16


def pictures(spark, sf) -> DataFrame:
    """(doc_id, height, a, b): each whole text as two images of WIDE columns, its first and second half;
    what is missing in the last row is 0. Texts without a byte are left out."""
    raw = F.encode("text", "UTF-8")
    docs = table(spark, sf, "documents").select("doc_id", raw.alias("raw"), F.ceil(F.octet_length(raw) / (2 * WIDE)).cast("int").alias("height")).where("height > 0")
    whole = docs.select("doc_id", "height", F.rpad("raw", 2 * WIDE * F.col("height"), F.lit(b"\x00")).alias("raw"))
    half = WIDE * F.col("height")
    return whole.select("doc_id", "height", F.substring("raw", F.lit(1), half).alias("a"), F.substring("raw", half + 1, half).alias("b"))


PIXELS = f"""
WITH t AS (SELECT doc_id, hex(encode(text)) AS h, ceil(octet_length(encode(text)) / {2 * WIDE}.0)::INT AS height FROM documents WHERE text <> ''),
x AS (SELECT doc_id, height, unnest(range(2 * {WIDE} * height)) AS i, h FROM t), v AS (SELECT doc_id, height, i, CASE WHEN 2 * i < length(h) THEN ('0x' || substr(h, 2 * i + 1, 2))::INT ELSE 0 END AS v FROM x)"""


@query(f"""{PIXELS}, a AS (SELECT doc_id, height, i // {WIDE} AS r, i % {WIDE} AS c, v FROM v WHERE i < {WIDE} * height),
g AS (SELECT *, lead(v) OVER (PARTITION BY doc_id, r ORDER BY c) - v AS dx, lead(v) OVER (PARTITION BY doc_id, c ORDER BY r) - v AS dy FROM a),
e AS (SELECT doc_id, -sum(p * log2(p)) AS entropy FROM (SELECT doc_id, v, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM a GROUP BY doc_id, v) GROUP BY 1),
q AS (SELECT doc_id, any_value(height) AS height, avg(v) AS mean, stddev_pop(v) AS rms_contrast, avg((v <= 5)::INT) AS pct_dark_clipped, avg((v >= 250)::INT) AS pct_highlight_saturated, avg((v > 240)::INT) AS glare, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.05) AS p5, avg(dx * dx) AS xx, avg(dy * dy) AS yy, avg(sqrt((dx * dx + dy * dy) / 2)) AS gradient FROM g GROUP BY 1)
SELECT doc_id, height, round(mean, 6) AS mean, round(entropy, 6) AS entropy, round(p95, 6) AS p95, round(glare, 6) AS glare, round(pct_dark_clipped, 6) AS pct_dark_clipped, round(pct_highlight_saturated, 6) AS pct_highlight_saturated, round(rms_contrast, 6) AS rms_contrast,
  round((p95 - p5) / greatest(p95 + p5, 1e-6), 6) AS michelson, round(CASE WHEN height < 2 THEN 0 ELSE sqrt(xx + yy) END, 6) AS spatial_frequency, round(CASE WHEN height < 2 THEN 0 ELSE gradient END, 6) AS average_gradient FROM q JOIN e USING (doc_id)""")
def image_levels(spark, sf):
    """Levels, clipping and gradients of the first half of each text as an image."""
    t = pictures(spark, sf).select("doc_id", "height", images.quality_metrics("a", "height", F.lit(WIDE)).alias("q"), images.optical_stats("a", "height", F.lit(WIDE)).alias("o"))
    names = ["mean", "entropy", "p95", "glare", "pct_dark_clipped", "pct_highlight_saturated", "rms_contrast", "michelson", "spatial_frequency", "average_gradient"]
    return rounded(t.select("doc_id", "height", *[F.col(f"{'o' if n in images.OPTICAL else 'q'}.{n}").alias(n) for n in names]), *names)


@query()
def image_quality(spark, sf):
    t = pictures(spark, sf)
    return t.select("doc_id", images.quality_metrics("a", "height", F.lit(WIDE)).alias("q"), images.optical_stats("a", "height", F.lit(WIDE)).alias("o"), images.dhash("a", "height", F.lit(WIDE)).alias("dhash")).select("doc_id", "q.*", "o.mean", "o.entropy", "o.glare", "dhash")


@query(f"""{PIXELS}, p AS (SELECT x.doc_id, x.v AS a, y.v AS b FROM v x JOIN v y ON x.doc_id = y.doc_id AND y.i = x.i + {WIDE} * x.height),
n AS (SELECT doc_id AS k, least(31, floor(a * 32 / 255)) AS x, least(31, floor(b * 32 / 255)) AS y, count(*) AS n FROM p GROUP BY ALL),
j AS (SELECT k, n / sum(n) OVER (PARTITION BY k) AS p, sum(n) OVER (PARTITION BY k, x) / sum(n) OVER (PARTITION BY k) AS px, sum(n) OVER (PARTITION BY k, y) / sum(n) OVER (PARTITION BY k) AS py FROM n)
SELECT k AS doc_id, round(sum(p * log2(p / (px * py))), 6) AS mi FROM j GROUP BY 1""")
def image_pairs(spark, sf):
    """Mutual information of the two halves of each text as images."""
    t = pictures(spark, sf).select("doc_id", images.fusion_metrics("a", "b", "height", F.lit(WIDE)).alias("m"))
    return rounded(t.select("doc_id", "m.mi"), "mi")


@query()
def image_fusion(spark, sf):
    t = pictures(spark, sf).withColumn("fused", images.alpha_blend("a", "b", F.lit(0.6)))
    return t.select("doc_id", images.fusion_metrics("fused", "b", "height", F.lit(WIDE)).alias("m"), F.sha2("fused", 256).alias("sha")).select("doc_id", "m.*", "sha")


@query()
def thermal_features(spark, sf):
    t = table(spark, sf, "embeddings").select("vec_id", images.thermal_stats(F.col("embedding")).alias("t"))
    return t.select("vec_id", "t.*")


@query("""
SELECT 'mode' AS kind, path, CASE WHEN path LIKE '%thermal%' OR path LIKE '%thm%' THEN 'THERMAL' WHEN path LIKE '%fus%' THEN 'FUS' WHEN path LIKE '%imx%' OR path LIKE '%opt%' OR path LIKE '%nir%' THEN 'OPT' ELSE 'OTHER' END AS mode FROM (
  SELECT DISTINCT ['fusion_', 'thm', 'imx_', 'other'][event_id % 4 + 1] || user_id || '.png' AS path FROM events)""")
def capture_modes(spark, sf):
    p = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("fusion_", "thm", "imx_", "other")]), (F.col("event_id") % 4 + 1).cast("int")), F.col("user_id"), F.lit(".png"))
    t = table(spark, sf, "events").select(p.alias("path")).distinct()
    return t.select(F.lit("mode").alias("kind"), "path", readers.capture_mode(F.col("path")).alias("mode"))


@query("""SELECT user_id, count(*) AS n, event_type FROM events GROUP BY user_id, event_type""")
def session_counts(spark, sf):
    """Session documents per user, read back from their JSON."""
    t = table(spark, sf, "events").select("user_id", F.col("event_type").alias("mode"), (F.unix_micros("ts") / 1e6).alias("s"))
    docs = writers.session_summary(t, "user_id", "s")
    back = docs.select("user_id", F.explode(F.from_json("summary", "frames_by_mode map<string,long>")["frames_by_mode"]).alias("event_type", "n"))
    return back.select("user_id", "n", "event_type")


# ---- streams ----


def streamed(spark, sf, f, mode: str = "append") -> DataFrame:
    """Runs f over events as a stream and returns what came out, as a batch."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*events.parquet").parquet(sf)
    return machines.once(f(rows.withColumn("ts", F.col("ts").cast("timestamp"))), new_path(spark, "stream"), mode)


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r AS (SELECT user_id, rn, event_id, value AS ema FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, e.event_id, 0.55::DOUBLE * e.value + (1 - 0.55::DOUBLE) * r.ema FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, round(ema, 6) AS ema FROM r""")
def stream_ema(spark, sf):
    f = lambda s: machines.fold_stream(s, "user_id", ["ts", "event_id"], ["value"], lambda: ordered.Ema(0.55), "ema", "double", ["event_id"])
    return rounded(streamed(spark, sf, f), "ema")


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def stream_windows(spark, sf):
    f = lambda s: machines.windowed(s, "ts", ["event_type"], "1 day", "value", "1 hour")
    out = streamed(spark, sf, f, "complete")
    return rounded(out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "mean"), "mean")


@query("""SELECT user_id, arg_max(value, ts) AS value FROM events GROUP BY 1""")
def stream_latest(spark, sf):
    return streamed(spark, sf, lambda s: machines.latest_per_key(s, "user_id", "ts", "value"), "complete").select("user_id", "value")
