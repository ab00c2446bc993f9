"""Column expressions over labels, sources, identities and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The taxonomy and the sources of labels.
ENV_CLASSES = ("night_clear", "normal_night", "normal_day", "fog", "rain", "glare", "backlight", "transition", "nir_night")
TRUSTED_SOURCES = ("manual", "verified_sidecar", "user_provided", "human_verified")
LABEL_SOURCES = ("dataset_original", "manual", "weak_heuristic")
TRUE_WORDS = ("1", "true", "yes", "y")
REVIEW_CLASSES = ("glare", "backlight", "transition", "nir_night")
STRICT_TIERS = ("frame_strict", "time_strict_100ms", "protocol_strict_1s")


def filled(c: Column) -> Column:
    """The value, or null if it is an empty text."""
    return F.nullif(c, F.lit(""))


def first_present(*columns: Column) -> Column:
    """First of the columns that is neither null nor empty."""
    return F.coalesce(*[filled(c) for c in columns])


def effective_label(label: Column, weak: Column, missing: str | None = "unlabeled") -> Column:
    """label, else weak label, else `missing`; an empty text counts as missing."""
    return first_present(label, weak) if missing is None else F.coalesce(first_present(label, weak), F.lit(missing))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))


def number(c: Column, default: float | None = None) -> Column:
    """The text as a double; `default` where it is none."""
    got = c.try_cast("double")
    return got if default is None else F.coalesce(got, F.lit(float(default)))


def finite(c: Column) -> Column:
    """The value, or null if it isn't a finite number."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def trusted_label(label: Column, source: Column, confidence: Column, least: float = 0.8) -> Column:
    """struct(label, reason): the label if all gates let it pass."""
    label, source, conf = F.trim(F.coalesce(label, F.lit(""))), F.trim(F.coalesce(source, F.lit(""))), number(confidence)
    reason = (
        F.when(label.isin("", "unknown"), "missing_or_unknown_label")
        .when(~label.isin(*ENV_CLASSES), "invalid_taxonomy_label")
        .when(~source.isin(*TRUSTED_SOURCES), "untrusted_label_source")
        .when(conf.isNull() | (conf < least), "low_or_invalid_label_confidence")
        .otherwise("trusted_label")
    )
    return F.struct(F.when(reason == "trusted_label", label).alias("label"), reason.alias("reason"))


def confirmed_label(manual: Column, suggested: Column, accepted: Column) -> Column:
    """struct(label, origin): manual label, else a suggestion that was accepted."""
    m, s = filled(F.trim(manual)), filled(F.trim(suggested))
    use = s.isNotNull() & truthy(accepted)
    origin = F.when(m.isNotNull(), "manual_label").when(use, "user_confirmed_suggested_label")
    return F.struct(F.coalesce(m, F.when(use, s)).alias("label"), origin.alias("origin"))


def metadata_status(has_identity: Column, has_sha: Column, weak_hint: Column) -> Column:
    """struct(status, method)."""
    status = F.when(has_identity | has_sha, "verified").when(weak_hint, "inferred_low_confidence").otherwise("unresolved")
    method = F.when(has_identity, "path_or_frame_identity").when(has_sha, "file_sha256").when(weak_hint, "weak_feature_hint").otherwise("unresolved")
    return F.struct(status.alias("status"), method.alias("method"))


def evidence_type(trusted: Column, source: Column) -> Column:
    s = F.coalesce(source, F.lit(""))
    return F.when(trusted.isNotNull(), "labeled").when(s.contains("weak"), "weak_label").when(~s.isin("none", "unknown", ""), "proxy").otherwise("unlabeled")


def recommendation(label: Column, count: Column, mean_conf: Column, least: int) -> Column:
    """What to do with a class, given its support and mean confidence."""
    return (
        F.when(label == "unlabeled", "exclude from classifier until labeled")
        .when(count < least, "provisional: below support threshold; need more data or merge/drop review")
        .when(label == "transition", "provisional: verify as ENV class vs dawn_dusk_blend runtime state")
        .when(label.isin("glare", "backlight"), "provisional: require CI, source-diversity review, and live validation")
        .when(mean_conf < 0.7, "review: low mean label confidence")
        .otherwise("keep for current audit; still requires leakage and domain-shift checks")
    )


def group_id(group: Column, source: Column, digest: Column) -> Column:
    return F.coalesce(filled(group), F.concat_ws("::", F.lit("unresolved"), source, digest))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_name(label: Column) -> Column:
    """A file name for the label: other characters become underscores."""
    out = F.regexp_replace(F.trim(label), r"[^\p{L}\p{N}._-]", "_")
    return F.when(F.length(out) > 0, out).otherwise("unlabeled")


def rate(text: Column) -> Column:
    """A rational like 30000/1001 as a double; 0/0, a zero divisor and other texts are null."""
    top, bottom = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(text.contains("/"), F.when(bottom != 0, top / bottom)).otherwise(text.try_cast("double"))


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON; nulls are kept, so that they take part."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


# ---- identities and pairs ----


def verified_identity(status: Column, *ids: Column) -> Column:
    """Whether a row's metadata are verified and name its image in any way."""
    return (F.coalesce(status, F.lit("")) == "verified") & first_present(*ids).isNotNull()


def session_frame(session: Column, frame: Column) -> Column:
    """session::frame, or null if either is missing."""
    s, f = filled(session), filled(frame)
    return F.when(s.isNotNull() & f.isNotNull(), F.concat_ws("::", s, f))


def frame_id(given: Column, video: Column, index: Column) -> Column:
    """The frame's id, else video:index; an unknown video is "unknown"."""
    return F.coalesce(filled(given), F.concat(F.coalesce(video, F.lit("unknown")), F.lit(":"), F.coalesce(index.cast("string"), F.lit(""))))


def missing_metadata(paths: Column, sessions: Column) -> Column:
    """Codes of what either row of a pair lacks, joined by "; ", or none. Both are arrays of texts."""
    lacks = lambda a: F.exists(a, lambda x: filled(x).isNull())
    found = F.array_compact(F.array(F.when(lacks(paths), "path_or_hash"), F.when(lacks(sessions), "session")))
    return F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise("none")


def pair_confidence(a: Column, b: Column) -> Column:
    """Confidence in the time of a pair: that of the first alone, or high if both are."""
    return F.when(b.isNull(), a).when((a == "high") & (b == "high"), "high").otherwise("low")


def thermal_channel(modality: Column) -> Column:
    m = F.trim(F.coalesce(modality, F.lit("")))
    return F.when(m == "raw_numeric_thermal", "lwir").when(m == "display_heatmap_like", "thermal_display").otherwise("unknown_thermal")


def alignment_status(has_nir: Column, has_fusion: Column, evidence: Column) -> Column:
    return F.when(~(has_nir & has_fusion), "missing").when(~evidence.eqNullSafe(F.lit("real_paired")), "weak_pair_or_proxy").otherwise("not_measured")


def input_kind(evidence: Column, runtime: Column) -> Column:
    """Code of the kind of data that a table's rows rest on."""
    e = F.trim(F.coalesce(filled(evidence), F.lit("unknown")))
    known = F.when(e.isin("real_paired", "proxy", "synthetic", "unpaired"), e).otherwise("unknown")
    return F.when(runtime, "session").otherwise(known)


def caveats(tier: Column, modality: Column, source: Column, input_type: Column) -> Column:
    """Codes of what limits a metric, each once, in order, joined by "; "."""
    display = F.lit("thermal_display")
    codes = F.array_compact(F.array(
        F.when(modality == "display_heatmap_like", display), F.when(source == "paired_generated_fusion", "generated_fusion"),
        F.when(tier == "Tier 2", "no_reference").when(tier == "Tier 3", "diagnostic").otherwise("strict_pairs_only"),
        F.when(input_type.contains("display/heatmap-like"), display),
    ))
    return F.array_join(F.array_distinct(codes), "; ")


def percent_change(new: Column, old: Column) -> Column:
    """Change in per cent of the old value's size; null where either isn't finite or old is about 0."""
    a, b = finite(new), finite(old)
    return F.when(F.abs(b) >= 1e-6, (a - b) / F.abs(b) * 100)


def utc_time(text: Column) -> Column:
    """An ISO time as a time of UTC without a zone; one without a zone is taken as it is."""
    zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    plain = F.to_timestamp_ntz(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", ""))
    return F.when(zone, F.to_utc_timestamp(F.to_timestamp(text), F.current_timezone()).cast("timestamp_ntz")).otherwise(plain)


def compatible(label: Column, *features: Column) -> Column:
    """Whether a row has a known label and all features."""
    out = F.coalesce(label.isin(*ENV_CLASSES), F.lit(False))
    for f in features:
        out = out & f.isNotNull()
    return out


def natural_key(name: Column) -> Column:
    """struct(number, name) that orders numbered files by number; names without one come first."""
    n = F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).try_cast("long")
    return F.struct(F.coalesce(n, F.lit(-1)).alias("number"), name.alias("name"))


def skip_second_glare(bucket: Column, raw: Column, lite: Column) -> Column:
    """Whether the display must not compress glare again, as bucket C has done so already."""
    return ~raw & ~lite & (bucket == "C")
