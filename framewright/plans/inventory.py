"""Queries of the smaller rules and summaries: identities, evidence, overlays, lookups, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import arrays, labels, rules
from framewright.operators import aggregates, evaluation, graph, joins, ordered, ranks, splits, statistics
from framewright.sources import readers

from .catalog import CONF, E, ORDER, by_user, rounded, scored, table
from .more import CLASSES, env_class

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""
WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE md5(o_orderkey::VARCHAR) END AS sha, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'img' || o_custkey END AS img, CASE o_orderstatus WHEN 'F' THEN 'verified' ELSE 'unresolved' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 's' || (o_custkey % 9) END AS session, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 100)::VARCHAR END AS frame, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'g' || (o_custkey % 20) END AS grp FROM orders)
SELECT k, coalesce(nullif(sha, ''), img, nullif(grp, ''), 'row' || k) AS identity, status = 'verified' AND coalesce(nullif(sha, ''), img) IS NOT NULL AS verified, CASE WHEN session <> '' AND frame IS NOT NULL THEN session || '::' || frame END AS session_frame,
  coalesce(frame, nullif(session, ''), 'unknown') || '' AS first_known, CASE WHEN frame IS NOT NULL THEN frame ELSE 'v' || (k % 3) || ':' || k END AS frame_id, coalesce(nullif(grp, ''), 'unresolved::' || status || '::' || md5(k::VARCHAR)) AS group_id,
  CASE WHEN (img IS NULL OR sha = '') AND session = '' THEN 'path_or_hash; session' WHEN img IS NULL OR sha = '' THEN 'path_or_hash' WHEN session = '' THEN 'session' ELSE 'none' END AS missing, sha256('{"k":' || k || ',"status":"' || status || '"}') AS digest FROM t""")
def row_identities(spark, sf):
    k, c = F.col("k"), F.col("c")
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("unresolved").alias("status"))
    md5 = F.md5(k.cast("string"))
    t = t.withColumns({"sha": F.when(k % 3 == 0, "").otherwise(md5), "img": F.when(k % 4 != 0, F.concat(F.lit("img"), c)), "session": F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("s"), c % 9)), "frame": F.when(k % 5 != 0, (k % 100).cast("string")), "grp": F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("g"), c % 20))})
    x = F.col
    return t.select(
        "k", labels.first_present(x("sha"), x("img"), x("grp"), F.concat(F.lit("row"), k)).alias("identity"), labels.verified_identity(x("status"), x("sha"), x("img")).alias("verified"), labels.session_frame(x("session"), x("frame")).alias("session_frame"),
        labels.first_present(x("frame"), x("session"), F.lit("unknown")).alias("first_known"), labels.frame_id(x("frame"), F.concat(F.lit("v"), k % 3), k).alias("frame_id"), labels.group_id(x("grp"), x("status"), md5).alias("group_id"),
        labels.missing_metadata(F.array("img", "sha"), F.array("session")).alias("missing"), labels.digest(x("k"), x("status")).alias("digest"),
    )


@query("""
SELECT event_id, [' Yes', 'no', '1', 'TRUE ', NULL, 'y'][event_id % 6 + 1] IN (' Yes', '1', 'TRUE ', 'y') AND event_id % 6 <> 4 AS truthy, coalesce(try_cast(CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE user_id::VARCHAR END AS DOUBLE), 7) AS number, CASE WHEN event_id % 5 > 1 THEN value END AS finite,
  CASE event_id % 4 WHEN 0 THEN 30000.0::DOUBLE / 1001 WHEN 1 THEN NULL WHEN 2 THEN 25 ELSE NULL END AS rate, round(CASE WHEN user_id % 10 <> 0 AND event_id % 5 > 1 THEN (value - user_id % 10) / (user_id % 10) * 100 END, 9) AS change,
  TIMESTAMP '2024-03-01 08:00:00' + INTERVAL (event_id % 50) MINUTE AS at, abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 00:00:00')) / 1e6 AS gap FROM events""")
def value_parsers(spark, sf):
    i, v = F.col("event_id"), F.col("value")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    odd = F.when(i % 5 == 0, F.lit(float("nan"))).when(i % 5 == 1, F.lit(float("inf"))).otherwise(v)
    minute = F.lpad((i % 50).cast("string"), 2, "0")
    iso = F.when(i % 2 == 0, F.concat(F.lit("2024-03-01T08:"), minute, F.lit(":00Z"))).otherwise(F.concat(F.lit("2024-03-01T10:"), minute, F.lit(":00+02:00")))
    return table(spark, sf, "events").select(
        i, labels.truthy(pick(" Yes", "no", "1", "TRUE ", None, "y")).alias("truthy"), labels.number(F.when(i % 4 == 0, "n/a").otherwise(F.col("user_id").cast("string")), 7).alias("number"), labels.finite(odd).alias("finite"),
        labels.rate(pick("30000/1001", "0/0", "25", "x/2")).alias("rate"), F.round(labels.percent_change(odd, (F.col("user_id") % 10).cast("double")), 9).alias("change"), labels.utc_time(iso).alias("at"),
        (F.abs(F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-10 00:00:00").cast("timestamp"))) / 1e6).alias("gap"),
    )


@query("""
WITH t AS (SELECT o_orderkey AS k, ['strict_quantitative', 'qualitative_pair', 'reject'][o_orderkey % 3 + 1] AS status, ['high', 'low'][o_orderkey % 2 + 1] AS c1, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ['high', 'low'][o_custkey % 2 + 1] END AS c2, o_orderkey % 5 <> 0 AS readable, CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE 'sufficient' END AS roi, CASE WHEN o_custkey % 4 = 0 THEN 'failed' ELSE 'usable' END AS al,
  o_totalprice / 2000 AS l, o_totalprice / 550000 AS sat, ['real_paired', 'proxy', 'synthetic', 'unpaired', ''][o_orderkey % 5 + 1] AS ev, ['Tier 1', 'Tier 2', 'Tier 3'][o_custkey % 3 + 1] AS tier, ['raw_numeric_thermal', 'display_heatmap_like', 'x'][o_orderkey % 3 + 1] AS md, ['A', 'B', 'C'][o_custkey % 3 + 1] AS b FROM orders),
p AS (SELECT *, CASE WHEN c2 IS NULL THEN c1 WHEN c1 = 'high' AND c2 = 'high' THEN 'high' ELSE 'low' END AS conf FROM t)
SELECT k, conf, CASE WHEN status = 'reject' OR NOT readable THEN 'not_comparable' WHEN roi <> 'sufficient' THEN 'visual_only' WHEN status = 'strict_quantitative' THEN CASE WHEN conf = 'high' AND al = 'usable' THEN 'strong_quantitative' ELSE 'moderate_quantitative' END ELSE 'weak_qualitative' END AS strength,
  CASE WHEN l < 15 THEN 'extreme_dark' WHEN sat > 0.2 THEN 'extreme_bright' WHEN sat BETWEEN 0.03 AND 0.08 THEN 'borderline_glare' ELSE '' END AS edge, CASE WHEN k % 13 = 0 THEN 'session' WHEN ev = '' THEN 'unknown' ELSE ev END AS input, CASE md WHEN 'raw_numeric_thermal' THEN 'lwir' WHEN 'display_heatmap_like' THEN 'thermal_display' ELSE 'unknown_thermal' END AS channel,
  CASE WHEN md = 'display_heatmap_like' THEN 'thermal_display; ' ELSE '' END || CASE WHEN k % 2 = 0 THEN 'generated_fusion; ' ELSE '' END || CASE tier WHEN 'Tier 2' THEN 'no_reference' WHEN 'Tier 3' THEN 'diagnostic' ELSE 'strict_pairs_only' END || CASE WHEN k % 3 = 2 THEN '; thermal_display' ELSE '' END AS caveats,
  CASE WHEN k % 9 = 0 THEN 'missing' WHEN ev <> 'real_paired' THEN 'weak_pair_or_proxy' ELSE 'not_measured' END AS alignment, b = 'C' AND k % 4 <> 0 AND k % 6 <> 0 AS skip, k % 2 = 0 AS idle FROM p""")
def evidence_codes(spark, sf):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    p = F.col("o_totalprice")
    conf = labels.pair_confidence(pick(k, "high", "low"), F.when(k % 7 != 0, pick(u, "high", "low")))
    ev, md = pick(k, "real_paired", "proxy", "synthetic", "unpaired", ""), pick(k, "raw_numeric_thermal", "display_heatmap_like", "x")
    idle = rules.idle_flags(F.lit("imx"), F.when(k % 2 != 0, "fusion"))["thermal"]
    return table(spark, sf, "orders").select(
        k.alias("k"), conf.alias("conf"), rules.evidence_strength(pick(k, "strict_quantitative", "qualitative_pair", "reject"), conf, k % 5 != 0, F.when(k % 11 == 0, "none").otherwise("sufficient"), F.when(u % 4 == 0, "failed").otherwise("usable")).alias("strength"),
        rules.edge_case(p / 2000, p / 550000).alias("edge"), labels.input_kind(ev, k % 13 == 0).alias("input"), labels.thermal_channel(md).alias("channel"),
        labels.caveats(pick(u, "Tier 1", "Tier 2", "Tier 3"), md, F.when(k % 2 == 0, "paired_generated_fusion").otherwise("none"), F.when(k % 3 == 2, "display/heatmap-like").otherwise("")).alias("caveats"),
        labels.alignment_status(k % 9 != 0, F.lit(True), ev).alias("alignment"), labels.skip_second_glare(pick(u, "A", "B", "C"), k % 4 == 0, k % 6 == 0).alias("skip"), idle.alias("idle"),
    )


@query("""
WITH t AS (SELECT p_partkey, p_size::VARCHAR AS s, p_brand AS b FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'clip=9,gamma=' || s || ',mode=' || b ELSE 'clip=' || s || ',gamma=1,mode=' || b END AS merged, sha256(CASE WHEN p_partkey % 2 = 0 THEN '{"clip":"9","gamma":"' || s || '"}' ELSE '{"clip":"' || s || '","gamma":"1"}' END) AS config_sha, 'clip,gamma,mode,secret' AS keys, CASE WHEN p_partkey % 2 = 0 THEN '1=0.85' ELSE '1=0.85,2=0.5' END AS rates FROM t""")
def config_overlays(spark, sf):
    """Maps of settings under overrides, of which only known keys count."""
    s, even = F.col("p_size").cast("string"), F.col("p_partkey") % 2 == 0
    base = F.create_map(F.lit("clip"), s, F.lit("gamma"), F.lit("1"), F.lit("mode"), F.col("p_brand"))
    delta = F.when(even, F.create_map(F.lit("clip"), F.lit("9"), F.lit("gamma"), s, F.lit("secret"), F.lit("x"))).otherwise(F.create_map(F.lit("secret"), F.lit("y")))
    merged = arrays.overlay(base, delta, ("clip", "gamma"))
    show = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")
    rates = arrays.known_rates(F.create_map(F.lit("fog"), F.lit(0.85), F.lit("rain"), F.lit(0.5), F.lit("snow"), F.lit(0.1)), F.array(F.lit("clear"), F.lit("fog"), F.lit("rain")), F.when(even, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))))
    return table(spark, sf, "part").select("p_partkey", show(merged).alias("merged"), arrays.fingerprint(merged, ("clip", "gamma")).alias("config_sha"), F.array_join(arrays.keys_of(base, delta, F.create_map(F.lit("secret"), F.lit("z"))), ",").alias("keys"), show(rates).alias("rates"))


@query(f"""
WITH t AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'unlabeled' ELSE {CLASSES}[o_custkey % 7 + 1] END AS label, o_totalprice / 300000 AS conf FROM orders), c AS (SELECT label, count(*) AS n, avg(conf) AS m FROM t GROUP BY 1),
r AS (SELECT *, CASE WHEN label = 'unlabeled' THEN 0 WHEN n < 100 THEN 1 WHEN label = 'transition' THEN 2 WHEN label IN ('glare', 'backlight') THEN 3 WHEN m < 0.7 THEN 4 ELSE 5 END AS code FROM c)
SELECT label, n, round(m, 6) AS mean_conf, code, (SELECT count(*) FROM c WHERE label <> 'unlabeled') || '/9' AS coverage FROM r""")
def class_recommendations(spark, sf):
    """Support and advice by class, with the share of all classes that the rows have."""
    k = F.col("o_orderkey")
    t = table(spark, sf, "orders").select(F.when(k % 10 == 0, "").otherwise(F.element_at(F.array(*[F.lit(c) for c in labels.ENV_CLASSES]), (F.col("o_custkey") % 7 + 1).cast("int"))).alias("label"), (F.col("o_totalprice") / 300000).alias("conf"))
    c = t.groupBy(labels.effective_label(F.col("label"), F.lit(None).cast("string")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf"))
    known = c.agg(F.concat(F.count_if(F.col("label").isin(*labels.ENV_CLASSES)).cast("string"), F.lit("/9")).alias("coverage"))
    advice = labels.recommendation(F.col("label"), F.col("n"), F.col("mean_conf"), 100)
    code = F.when(advice.startswith("exclude"), 0).when(advice.contains("support threshold"), 1).when(advice.contains("runtime state"), 2).when(advice.contains("source-diversity"), 3).when(advice.startswith("review"), 4).otherwise(5)
    return rounded(c.crossJoin(F.broadcast(known)).select("label", "n", "mean_conf", code.alias("code"), "coverage"), "mean_conf")


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, sha256('{"l_partkey":' || l_partkey || ',"l_suppkey":' || l_suppkey || '}') AS fp, l_returnflag, l_linestatus FROM lineitem), a AS (SELECT * FROM f WHERE l_linenumber = 1), b AS (SELECT * FROM f WHERE l_linenumber = 2)
SELECT a.fp, a.l_orderkey AS train_key, b.l_orderkey AS test_key, CASE WHEN a.l_returnflag <> b.l_returnflag AND a.l_linestatus <> b.l_linestatus THEN '{"l_returnflag":"' || b.l_returnflag || '","l_linestatus":"' || b.l_linestatus || '"}' WHEN a.l_returnflag <> b.l_returnflag THEN '{"l_returnflag":"' || b.l_returnflag || '"}' WHEN a.l_linestatus <> b.l_linestatus THEN '{"l_linestatus":"' || b.l_linestatus || '"}' ELSE '{}' END AS diff FROM a JOIN b USING (fp)""")
def fingerprint_overlap(spark, sf):
    """Rows of two sides with equal features, and what else differs, as JSON."""
    f = table(spark, sf, "lineitem").withColumn("fp", labels.digest(F.col("l_partkey"), F.col("l_suppkey")))
    met = joins.overlap_pairs(f.where("l_linenumber = 1").select("fp", F.struct("l_orderkey", "l_returnflag", "l_linestatus").alias("r")), f.where("l_linenumber = 2").select("fp", F.struct("l_orderkey", "l_returnflag", "l_linestatus").alias("r")), "fp", "r", "r")
    a, b = F.col("left_id"), F.col("right_id")
    diff = F.to_json(F.struct(*[F.when(a[c] != b[c], b[c]).alias(c) for c in ("l_returnflag", "l_linestatus")]))
    return met.select(F.col("key").alias("fp"), a["l_orderkey"].alias("train_key"), b["l_orderkey"].alias("test_key"), diff.alias("diff"))


@query("""
SELECT o_orderkey, c_name, n_name, CASE WHEN o_orderpriority = '1-URGENT' THEN 'glare' WHEN o_orderpriority = '5-LOW' THEN 'fog' END AS env, CASE WHEN o_orderpriority = '1-URGENT' THEN 0.9 WHEN o_orderpriority = '5-LOW' THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence, r_name AS region
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def dimension_lookups(spark, sf):
    """Facts with predictions and features looked up one after the other; unmatched rows stay."""
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region"))
    out = joins.overridden_lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus", [("1-URGENT", "glare", 0.9), ("5-LOW", "fog", 0.8)], [])
    return out.join(c, "o_custkey", "left").join(n, "n_nationkey", "left").join(r, "r_regionkey", "left").select("o_orderkey", "c_name", "n_name", "env", "confidence", "region")


@query("""
WITH l AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity AS v, l_suppkey % 5 AS c FROM lineitem)
SELECT l_returnflag, l_linestatus, l_linenumber, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr,
  array_to_string(list_slice(list_sort(list(DISTINCT 'c' || c)), 1, 3), ',') AS caveats FROM l GROUP BY ALL""")
def multi_key_summary(spark, sf):
    """A metric by several keys, with its spread and the first three of its sorted caveats."""
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    three = F.array_join(F.slice(F.array_sort(F.collect_set(F.concat(F.lit("c"), F.col("l_suppkey") % 5))), 1, 3), ",")
    out = aggregates.metric_summary(table(spark, sf, "lineitem").withColumn("v", F.col("l_quantity")), keys, "v", extra=[three.alias("caveats")])
    out = out.withColumn("iqr", F.col("p75") - F.col("p25"))
    return rounded(out, "mean", "median", "std", "p25", "p75", "p95", "iqr")


@query("""
WITH d AS (SELECT l_returnflag AS cls, l_linenumber AS bucket, CASE WHEN l_suppkey % 6 <> 0 THEN l_quantity - 25 END AS d FROM lineitem)
SELECT cls, bucket, count(d) AS n, round(avg(d), 6) AS mean, min(d) AS low, max(d) AS high, round(stddev_pop(d), 6) AS std, any_value(s.m) AS class_mean FROM d JOIN (SELECT cls, round(avg(d), 6) AS m FROM d GROUP BY 1) s USING (cls) GROUP BY ALL""")
def delta_by_class(spark, sf):
    """Differences by class and bucket, with NaN left out, beside the mean of the class."""
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cls"), F.col("l_linenumber").alias("bucket"), labels.finite(F.when(F.col("l_suppkey") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity") - 25)).alias("d"))
    per = d.groupBy("cls", "bucket").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.min("d").alias("low"), F.max("d").alias("high"), F.stddev_pop("d").alias("std"))
    return rounded(per.join(d.groupBy("cls").agg(F.avg("d").alias("class_mean")), "cls"), "mean", "std", "class_mean")


@query("""
WITH s AS (SELECT user_id, event_type AS stage, avg(value) AS m FROM events GROUP BY ALL)
SELECT stage, count(m) AS n_sessions, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0), 6) AS std, round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.95), 6) AS p95, round(quantile_cont(m, 0.99), 6) AS p99 FROM s GROUP BY 1""")
def stage_timings(spark, sf):
    """Stage means of session documents, summed up over sessions."""
    per = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean_ms"))
    docs = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("mean_ms")))).alias("stage_timing_ms"))
    return rounded(readers.stage_summary(docs), "mean", "std", "p50", "p95", "p99")


@query("""
WITH t AS (SELECT user_id, count(*) AS n, count_if(event_type = 'error') AS bad, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS s FROM events GROUP BY 1)
SELECT user_id, n, round_even(100.0 * bad / greatest(1, n), 3) AS error_pct, round_even(n / greatest(1.0, s), 9) AS rate, round_even(s / greatest(1, n - 1), 3) AS step FROM t""")
def session_rates(spark, sf):
    got = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"), ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6).alias("s"))
    n, s = F.col("n"), F.col("s")
    return got.select("user_id", "n", F.bround(100.0 * F.col("bad") / F.greatest(F.lit(1), n), 3).alias("error_pct"), F.bround(n / F.greatest(F.lit(1.0), s), 9).alias("rate"), F.bround(s / F.greatest(F.lit(1), n - 1), 3).alias("step"))


@query("""
WITH q AS (SELECT unnest(quantile_cont(event_id::DOUBLE, [1/6, 2/6, 3/6, 4/6, 5/6])) AS c FROM events)
SELECT event_id, (SELECT count(*) FROM q WHERE c < event_id)::INT AS fold FROM events""")
def time_folds(spark, sf):
    return splits.time_folds(table(spark, sf, "events").select("event_id"), ["event_id"]).select("event_id", "fold")


@query("""
WITH n AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 9 = 0 THEN 'cover' || chr(97 + (p_partkey % 26)::INT) ELSE 'frame_' || (p_partkey * 7 % 1000) END || '.png' AS name FROM part), o AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(name, '([0-9]+)', 1), '') AS BIGINT), -1) AS number FROM n)
SELECT p_partkey, name, number, row_number() OVER (PARTITION BY p_brand ORDER BY number, name, p_partkey) - 1 AS place FROM o""")
def natural_order(spark, sf):
    """Numbered files in order of their numbers."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 9 == 0, F.concat(F.lit("cover"), F.char((97 + k % 26).cast("long")))).otherwise(F.concat(F.lit("frame_"), k * 7 % 1000)), F.lit(".png"))
    t = table(spark, sf, "part").select(k, "p_brand", name.alias("name")).withColumn("key", labels.natural_key(F.col("name")))
    return ranks.ranked(t.select("p_partkey", "p_brand", "name", F.col("key.number").alias("number")), ["p_brand"], ["number", "name", "p_partkey"], "place").drop("p_brand")


@query("""
WITH p AS (SELECT DISTINCT l_discount AS a, l_tax AS b, l_quantity / 1000 AS c FROM lineitem), o AS (SELECT a, b, c, unnest([a, b, c, a]) AS p, unnest(['a', 'b', 'c', 'd']) AS k FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY p DESC, k) AS r FROM o)
SELECT a, b, c, max(k) FILTER (r = 1) AS first, max(k) FILTER (r = 2) AS second, max(p) FILTER (r = 2) AS p2 FROM r GROUP BY ALL""")
def top2_by_place(spark, sf):
    """The two largest of several values, ties by place."""
    t = table(spark, sf, "lineitem").select(F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), (F.col("l_quantity") / 1000).alias("c")).distinct()
    t = t.withColumn("t", arrays.top2_first(F.array(*[F.lit(x) for x in "abcd"]), F.array("a", "b", "c", "a")))
    return t.select("a", "b", "c", F.col("t")[0]["c"].alias("first"), F.col("t")[1]["c"].alias("second"), F.col("t")[1]["p"].alias("p2"))


@query("""
WITH RECURSIVE p AS (SELECT vec_id, vec_id % 10 AS seq, row_number() OVER (PARTITION BY vec_id % 10 ORDER BY vec_id) AS rn, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id, abs(unnest(a.e) - unnest(b.e)) * 40 AS d FROM p a JOIN p b ON a.seq = b.seq AND a.rn = b.rn + 1),
s AS MATERIALIZED (SELECT seq, rn, p.vec_id, x.score FROM p LEFT JOIN (SELECT vec_id, 0.48 * avg(d) + 0.52 * quantile_cont(d, 0.94) AS score FROM d GROUP BY 1) x USING (vec_id)),
r AS (SELECT seq, rn, vec_id, score, 0 AS strike, 0 AS hold, false AS active FROM s WHERE rn = 1 UNION ALL
  SELECT seq, rn, vec_id, score, CASE WHEN k >= 2 THEN 0 ELSE k END, greatest(0, CASE WHEN k >= 2 THEN 12 ELSE hold END - 1), CASE WHEN k >= 2 THEN 12 ELSE hold END > 0 FROM (SELECT s.seq, s.rn, s.vec_id, s.score, r.hold, CASE WHEN s.score > 13 THEN r.strike + 1 ELSE 0 END AS k FROM r JOIN s ON s.seq = r.seq AND s.rn = r.rn + 1))
SELECT seq, vec_id, round(score, 6) AS score, active FROM r""")
def motion_gate(spark, sf):
    """Change from frame to frame of vectors as frames, and the gate over it."""
    t = table(spark, sf, "embeddings").select((F.col("vec_id") % 10).alias("seq"), "vec_id", F.transform("embedding", lambda x: x.cast("double") * 40).alias("px"))
    out = ordered.fold(t, ["seq"], ["vec_id"], ["px"], lambda: ordered.JerkScore(ordered.MotionGate(limit=13.0)), "s", "array<double>")
    return rounded(out.select("seq", "vec_id", F.col("s")[0].alias("score"), (F.col("s")[1] > 0).alias("active")), "score")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED ({E}), r AS (SELECT user_id, rn, event_id, value AS y FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, e.event_id, CASE WHEN e.event_type IN ('click', 'error') THEN e.value ELSE 0.58::DOUBLE * e.value + 0.42::DOUBLE * r.y END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, round(y, 6) AS blend FROM r""")
def glare_blend(spark, sf):
    rows = by_user(spark, sf, "value", "event_type").withColumns({"apply": F.col("event_type") != "click", "reset": F.col("event_type") == "error"})
    return rounded(ordered.fold(rows, ["user_id"], ORDER, ["value", "apply", "reset"], ordered.GlareBlend, "blend", "double").select("user_id", "event_id", "blend"), "blend")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY rn) AS p1, lag(value, 2) OVER (PARTITION BY user_id ORDER BY rn) AS p2 FROM ({E})), r AS (SELECT user_id, rn, event_id, value, p1, p2, 0 AS quiet FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, e.event_id, e.value, e.p1, e.p2, CASE WHEN abs(e.value - e.p1) < 12 THEN r.quiet + 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, CASE WHEN quiet >= 3 OR rn < 3 THEN value ELSE list_median([value, p1, p2]) END AS clean FROM r""")
def rain_median(spark, sf):
    return ordered.fold(by_user(spark, sf, "value"), ["user_id"], ORDER, ["value"], lambda: ordered.RainMedian(3, 12.0), "clean", "double").select("user_id", "event_id", "clean")


@query("""
WITH p AS (SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, a.l_suppkey % 4 = b.l_suppkey % 4 AS sha, a.l_returnflag = 'N' AND b.l_returnflag = 'N' AS ok, a.l_linestatus = b.l_linestatus AS lab, bit_count(xor(a.l_partkey, b.l_partkey))::INT AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
SELECT l_orderkey, i, CASE WHEN sha THEN 'exact_file_duplicate' WHEN NOT ok THEN 'unresolved' WHEN NOT lab THEN 'dhash_false_positive_candidate' ELSE 'likely_near_duplicate' END AS edge, d, row_number() OVER (ORDER BY ok DESC, d, lab, l_orderkey, i, CASE WHEN sha THEN 0 WHEN NOT ok THEN 1 ELSE 2 END) - 1 AS place FROM p""")
def pair_edges(spark, sf):
    """Classes of the edges between neighbouring rows, in order of review."""
    l0 = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_partkey")
    b = l0.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), *[F.col(c).alias(f"b_{c}") for c in ("l_suppkey", "l_returnflag", "l_linestatus", "l_partkey")])
    p = l0.join(b, ["l_orderkey", "l_linenumber"])
    ok, same = (F.col("l_returnflag") == "N") & (F.col("b_l_returnflag") == "N"), F.col("l_linestatus") == F.col("b_l_linestatus")
    p = p.select("l_orderkey", F.col("l_linenumber").alias("i"), graph.pair_class(F.col("l_suppkey") % 4 == F.col("b_l_suppkey") % 4, ok, same).alias("edge"), arrays.hamming(F.col("l_partkey"), F.col("b_l_partkey")).alias("d"), ok.alias("ok"), same.alias("same"))
    return ranks.ranked(p, [], [(~F.col("ok")).cast("int"), F.col("d"), F.col("same").cast("int"), F.col("l_orderkey"), F.col("i"), F.when(F.col("edge") == "exact_file_duplicate", 0).when(F.col("edge") == "unresolved", 1).otherwise(2)], "place").drop("ok", "same")


@query(f"""
WITH c AS ({CONF}), a AS (SELECT 'all' AS kind, * FROM c UNION ALL SELECT 'accepted', * FROM c WHERE conf >= 0.3)
SELECT kind, count(*) AS n, round(avg((truth = predicted)::INT), 9) AS accuracy, count_if(truth <> predicted AND conf >= 0.4)::BIGINT AS sure_errors, round(count(*) / (SELECT count(*) FROM c), 9) AS coverage FROM a GROUP BY 1""")
def accepted_report(spark, sf):
    """All rows beside those that are accepted, with the errors that were sure."""
    s = scored(spark, sf).withColumn("ok", F.col("truth") == F.col("predicted"))
    yes = F.col("conf") >= 0.3
    kinds = s.select("*", F.explode(F.when(yes, F.array(F.lit("all"), F.lit("accepted"))).otherwise(F.array(F.lit("all")))).alias("kind"))
    got = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"), F.count_if(~F.col("ok") & (F.col("conf") >= 0.4)).alias("sure_errors"))
    out = got.crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("total")))).withColumn("coverage", F.col("n") / F.col("total")).drop("total")
    return rounded(out, "accuracy", "coverage", digits=9)


@query(f"""
WITH b AS (SELECT (truth = 'F')::INT AS ok, least(0.999, greatest(0, 1 - conf)) AS p FROM ({CONF})), g AS (SELECT least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS c, avg(ok) AS a FROM b GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 4) AS ece FROM g""")
def binary_calibration(spark, sf):
    """Expected calibration error of one class against all others."""
    t = scored(spark, sf).withColumn("p", F.least(F.lit(0.999), F.greatest(F.lit(0.0), 1 - F.col("conf"))))
    return rounded(statistics.ece(t, "p", F.col("truth") == "F").select("ece"), "ece", digits=4)


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, m.name AS metric, m.v AS value FROM (SELECT l_orderkey, l_linenumber, unnest([{'name': 'quantity', 'v': l_quantity}, {'name': 'discount', 'v': l_discount}, {'name': 'tax', 'v': l_tax}]) AS m FROM lineitem))
SELECT a.l_orderkey, a.l_linenumber, a.metric, a.value, b.value AS baseline, round(a.value - b.value, 9) AS delta FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.metric = b.metric AND b.l_linenumber = 1 WHERE a.l_linenumber > 1""")
def metric_rows(spark, sf):
    """Metrics as long rows, each beside that of its baseline."""
    wide = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = wide.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "metric", "value")
    base = long.where("l_linenumber = 1").select("l_orderkey", "metric", F.col("value").alias("baseline"))
    return rounded(long.where("l_linenumber > 1").join(base, ["l_orderkey", "metric"]).withColumn("delta", F.col("value") - F.col("baseline")), "delta", digits=9)


@query("""
WITH t AS (SELECT user_id, CASE WHEN event_id % 10 <> 0 THEN value * 20 END AS skew, CASE event_type WHEN 'click' THEN 'strict_paired' WHEN 'view' THEN 'qualitative_weak' ELSE 'missing_pair' END AS status FROM events)
SELECT user_id, count(skew) AS n, round(avg(skew), 6) AS mean, round(quantile_cont(skew, 0.95), 6) AS p95, count_if(status = 'strict_paired')::BIGINT AS strict, bool_or(status = 'missing_pair') AS any_missing, quantile_cont(skew, 0.95) > 900 AS flagged FROM t GROUP BY 1""")
def alignment_summary(spark, sf):
    """Skew and pairing by session, with a flag for sessions out of step."""
    kind = F.col("event_type")
    status = F.when(kind == "click", "strict_paired").when(kind == "view", "qualitative_weak").otherwise("missing_pair")
    t = table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 10 != 0, F.col("value") * 20).alias("skew"), status.alias("status"))
    got = t.groupBy("user_id").agg(F.count("skew").alias("n"), F.avg("skew").alias("mean"), F.count_if(F.col("status") == "strict_paired").alias("strict"), F.bool_or(F.col("status") == "missing_pair").alias("any_missing"))
    out = got.join(ranks.quantiles(t, ["user_id"], "skew", {"p95": 0.95}), "user_id").withColumn("flagged", F.col("p95") > 900)
    return rounded(out, "mean", "p95")


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, {CLASSES}[l_partkey % 9 + 1] AS label, CASE WHEN l_suppkey % 7 <> 0 THEN l_quantity END AS q, l_tax AS x FROM lineitem)
SELECT label, count(*) AS n, round(avg(q), 6) AS mean FROM t WHERE label IN ('fog', 'rain', 'glare') AND q IS NOT NULL GROUP BY 1""")
def compatible_classes(spark, sf):
    """Rows that have all features of a set, by class, for the classes of a list."""
    t = table(spark, sf, "lineitem").select(env_class(F.col("l_partkey")).alias("label"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_quantity")).alias("q"), F.col("l_tax").alias("x"))
    some = joins.overlapping(t.where(labels.compatible(F.col("label"), F.col("q"), F.col("x"))), spark.createDataFrame([("fog",), ("rain",), ("glare",)], "label string"), ["label"])
    return rounded(some.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean")), "mean")


@query("""
WITH t AS (SELECT o_orderkey AS path, o_totalprice AS modified, CASE WHEN o_orderkey % 3 = 0 THEN 'completed_labels_available' ELSE 'invalid' END AS status FROM orders)
SELECT path FROM t WHERE status = 'completed_labels_available' ORDER BY modified DESC, path DESC LIMIT 1""")
def newest_label_file(spark, sf):
    k = F.col("o_orderkey")
    return evaluation.latest_valid(table(spark, sf, "orders").select(k.alias("path"), F.col("o_totalprice").alias("modified"), F.when(k % 3 == 0, "completed_labels_available").otherwise("invalid").alias("status")))
