"""Queries of the catalogue over the driver's tables, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import arrays, labels, rules
from framewright.operators import aggregates, graph, joins, ordered, ranks, splits, statistics
from framewright.operators.storage import checkpoint

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from framewright.plans import inventory, more

    return QUERIES | more.QUERIES | inventory.QUERIES


def oracle_sql() -> dict[str, str]:
    from framewright.plans import inventory, more

    return SQL | more.SQL | inventory.SQL


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def micros(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c))


# ---- aggregates ----


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std,
  round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY event_type""")
def metric_summary_by_type(spark, sf):
    return rounded(aggregates.metric_summary(table(spark, sf, "events"), ["event_type"], "value"), "mean", "median", "std", "p25", "p75", "p95")


@query("""
WITH l AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, l_quantity * 1500 AS b FROM lineitem)
SELECT l_returnflag, l_linestatus, count(v) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(stddev_samp(v), 4) AS std,
  round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.95), 4) AS p95,
  round(avg(v - b), 4) AS delta, round(avg((v > b)::INT), 6) AS win_rate
FROM l GROUP BY ALL""")
def metric_vs_baseline(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("v"), (F.col("l_quantity") * 1500).alias("b"))
    out = aggregates.metric_summary(rows, ["l_returnflag", "l_linestatus"], "v", "b")
    return rounded(rounded(out, "mean", "median", "std", "p25", "p75", "p95", "delta", digits=4), "win_rate")


@query("SELECT coalesce(nullif(CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 11 = 0 THEN NULL ELSE event_type END, ''), 'unknown') AS kind, count(*) AS n FROM events GROUP BY 1")
def counts_with_missing(spark, sf):
    kind = F.when(F.col("user_id") % 7 == 0, "").when(F.col("user_id") % 11 == 0, F.lit(None)).otherwise(F.col("event_type"))
    return aggregates.counts(table(spark, sf, "events").select(kind.alias("kind")), "kind")


@query("""SELECT event_type, user_id, count(*) AS n, round(sum(value), 4) AS total FROM events
GROUP BY GROUPING SETS ((), (event_type), (user_id), (event_type, user_id))""")
def grouping_sets_event(spark, sf):
    out = aggregates.sets(table(spark, sf, "events"), [[], ["event_type"], ["user_id"], ["event_type", "user_id"]], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")])
    return rounded(out, "total", digits=4)


@query("""SELECT o_orderpriority, count(*) AS total, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM orders GROUP BY 1""")
def share_of_total(spark, sf):
    return rounded(aggregates.share(table(spark, sf, "orders"), ["o_orderpriority"], F.lit(1)), "share", digits=9)


@query("""
WITH m AS (SELECT l_suppkey, l_linenumber, avg(l_quantity) AS m FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY m DESC, l_linenumber) AS r FROM m)
SELECT l_suppkey, l_linenumber AS best_l_linenumber, round(m, 9) AS best_mean FROM r WHERE r = 1""")
def argmax_per_group(spark, sf):
    return rounded(aggregates.best_per_group(table(spark, sf, "lineitem"), "l_suppkey", "l_linenumber", "l_quantity"), "best_mean", digits=9)


@query("""SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'view'), 4) AS view, round(sum(value) FILTER (event_type = 'error'), 4) AS error
FROM events GROUP BY user_id""")
def pivot_wide(spark, sf):
    out = aggregates.wide(table(spark, sf, "events"), ["user_id"], "event_type", ["click", "view", "error"], F.sum("value"))
    return rounded(out, "click", "view", "error", digits=4)


@query("""SELECT n_nationkey, n_name, count(c_custkey) AS n_rich, round(avg(c_acctbal), 4) AS mean_bal FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9900) ON c_nationkey = n_nationkey GROUP BY ALL""")
def dimension_zero_fill(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 9900").withColumnRenamed("c_nationkey", "n_nationkey")
    out = aggregates.zero_filled(table(spark, sf, "nation").select("n_nationkey", "n_name"), rich, "n_nationkey", [F.count(F.lit(1)).alias("n_rich"), F.avg("c_acctbal").alias("mean_bal")])
    return rounded(out, "mean_bal", digits=4)


@query("""SELECT l_shipmode, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(100 * stddev_pop(v) / avg(v), 6) AS cv_pct, CASE WHEN 100 * stddev_pop(v) / avg(v) <= 57 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM (SELECT l_linenumber AS l_shipmode, l_quantity AS v FROM lineitem) GROUP BY 1""")
def variation_verdict(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("l_shipmode"), F.col("l_quantity").alias("v"))
    return rounded(aggregates.variation(rows, ["l_shipmode"], "v", 57.0), "mean", "std", "cv_pct")


@query("""SELECT user_id, event_id, value, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS place FROM events WHERE event_type = 'error') WHERE place <= 3""")
def first_examples(spark, sf):
    out = aggregates.examples(table(spark, sf, "events").where("event_type = 'error'"), ["user_id"], [F.desc("value"), "event_id"], 3)
    return out.select("user_id", "event_id", "value", "place")


@query("""SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""")
def distinct_first(spark, sf):
    return aggregates.first_rows(table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("""SELECT user_id, value AS p90, n FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = floor(0.9 * n)""")
def p90_sorted_rank(spark, sf):
    return aggregates.p90_by_rank(table(spark, sf, "events"), ["user_id"], "value")


@query("""
WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day FROM events),
i AS (SELECT user_id, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d),
r AS (SELECT user_id, g, count(*) AS n FROM i GROUP BY ALL)
SELECT user_id, max(n) AS longest FROM r GROUP BY 1""")
def islands_longest_run(spark, sf):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return aggregates.longest_run(table(spark, sf, "events").select("user_id", day.alias("day")), ["user_id"], "day")


CONF = "SELECT o_orderkey AS id, o_orderstatus AS truth, CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 350000 THEN 'O' ELSE 'P' END AS predicted, least(0.999, o_totalprice / 550000) AS conf FROM orders"


def scored(spark, sf) -> DataFrame:
    p = F.col("o_totalprice")
    predicted = F.when(p < 150000, "F").when(p < 350000, "O").otherwise("P")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("truth"), predicted.alias("predicted"), F.least(F.lit(0.999), p / 550000).alias("conf"))


@query(f"""
WITH c AS (SELECT truth, predicted, count(*) AS n FROM ({CONF}) GROUP BY ALL)
SELECT truth, predicted, n, round(n / sum(n) OVER (PARTITION BY truth), 9) AS share,
  sum(CASE WHEN truth = predicted THEN n ELSE 0 END) OVER (PARTITION BY truth) / sum(n) OVER (PARTITION BY truth) < 0.8 AS fragile FROM c""")
def confusion_matrix(spark, sf):
    return rounded(aggregates.confusion(scored(spark, sf), "truth", "predicted"), "share", digits=9)


@query("""
WITH d AS (SELECT l_linenumber AS grp, l_quantity > 25 AS g, l_discount > 0.04 AS p, l_tax > 0.03 AS h, l_extendedprice / 1000 AS ms FROM lineitem),
c AS (SELECT grp, count(*) AS n_images, count_if(g)::BIGINT AS n_positive, count_if(g AND p)::BIGINT AS tp, count_if(NOT g AND p)::BIGINT AS fp, count_if(g AND NOT p)::BIGINT AS fn, count_if(g AND h)::BIGINT AS tp_hit,
  round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(CASE WHEN count(*) >= 20 THEN quantile_cont(ms, 0.95) END, 6) AS p95_ms FROM d GROUP BY 1),
r AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tp_hit / (tp_hit + fp) AS hit_precision, tp_hit / n_positive AS hit_recall FROM c)
SELECT grp, n_images, n_positive, tp, fp, fn, tp_hit, p50_ms, p95_ms, round(precision, 9) AS precision, round(recall, 9) AS recall, round(hit_precision, 9) AS hit_precision, round(hit_recall, 9) AS hit_recall,
  round(2 * precision * recall / (precision + recall), 9) AS f1, round(2 * hit_precision * hit_recall / (hit_precision + hit_recall), 9) AS hit_f1,
  round(greatest(0, (recall + 1.96 * 1.96 / (2 * (tp + fn))) / (1 + 1.96 * 1.96 / (tp + fn)) - 1.96 * sqrt(recall * (1 - recall) / (tp + fn) + 1.96 * 1.96 / (4 * (tp + fn) * (tp + fn))) / (1 + 1.96 * 1.96 / (tp + fn))), 9) AS wilson_low,
  round(least(1, (recall + 1.96 * 1.96 / (2 * (tp + fn))) / (1 + 1.96 * 1.96 / (tp + fn)) + 1.96 * sqrt(recall * (1 - recall) / (tp + fn) + 1.96 * 1.96 / (4 * (tp + fn) * (tp + fn))) / (1 + 1.96 * 1.96 / (tp + fn))), 9) AS wilson_high
FROM r""")
def detection_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("grp"), (F.col("l_quantity") > 25).alias("gt_positive"), (F.col("l_discount") > 0.04).alias("predicted_positive"), (F.col("l_tax") > 0.03).alias("centroid_hit"), (F.col("l_extendedprice") / 1000).alias("inference_ms"))
    out = rounded(aggregates.detection_summary(rows, ["grp"]), "p50_ms", "p95_ms")
    return rounded(out, "precision", "recall", "hit_precision", "hit_recall", "f1", "hit_f1", "wilson_low", "wilson_high", digits=9)


@query("""
SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, round(count(v) / count(*), 9) AS coverage, coalesce(min(v) = max(v), true) AS constant FROM (
  SELECT 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem
  UNION ALL SELECT 'zero', 0 FROM lineitem UNION ALL SELECT 'gappy', CASE WHEN l_linenumber = 1 THEN l_tax END FROM lineitem) GROUP BY 1""")
def inventory_of_features(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", F.lit(0.0).alias("zero"), F.when(F.col("l_linenumber") == 1, F.col("l_tax")).alias("gappy"))
    return rounded(rounded(aggregates.feature_inventory(rows, rows.columns), "mean", "std"), "coverage", digits=9)


@query("""SELECT lang, count(*) AS n, round(max(count(*)) OVER () / min(count(*)) OVER (), 9) AS imbalance, count(*) < 150 AS low_support FROM documents GROUP BY lang""")
def class_imbalance(spark, sf):
    return rounded(aggregates.imbalance(table(spark, sf, "documents"), "lang", 150), "imbalance", digits=9)


@query("""
WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source)::INT AS place FROM c)
SELECT lang, source, n, place FROM r WHERE place <= 5""")
def top_sources(spark, sf):
    got = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return aggregates.examples(got, ["lang"], [F.desc("n"), "source"], 5)


@query("""SELECT l_linenumber, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1""")
def value_strings(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(aggregates.value_string("l_returnflag").alias("flags"), F.countDistinct("l_suppkey").alias("n_suppliers"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
t AS (SELECT user_id, sum(n) AS total, count(*) AS used, max(n) AS m FROM c GROUP BY 1)
SELECT t.user_id, CASE WHEN m / total >= 0.25 THEN (SELECT min(event_type) FROM c WHERE c.user_id = t.user_id AND c.n = t.m) ELSE 'mixed' END AS dominant, used::INT AS n_used, greatest(0, used - 1)::INT AS transitions FROM t""")
def dominant_mode(spark, sf):
    got = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = got.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", arrays.dominant(F.col("m"), 0.25).alias("dominant"), arrays.used(F.col("m")).alias("n_used"), F.greatest(F.lit(0), arrays.used(F.col("m")) - 1).alias("transitions"))


@query("""
SELECT event_type, count(*) AS n, count_if(value >= 20)::BIGINT AS accepted, round(1 - count_if(value >= 20)::BIGINT / count(*), 9) AS abstention, round(avg((user_id % 2 = 0)::INT), 9) AS agreement, count_if(value >= 100 AND user_id % 2 = 1)::BIGINT AS sure_disagreements FROM events GROUP BY 1""")
def abstention_by_type(spark, sf):
    out = table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 20).alias("accepted"), (1 - F.count_if(F.col("value") >= 20) / F.count(F.lit(1))).alias("abstention"),
        F.avg((F.col("user_id") % 2 == 0).cast("double")).alias("agreement"), F.count_if((F.col("value") >= 100) & (F.col("user_id") % 2 == 1)).alias("sure_disagreements"),
    )
    return rounded(out, "abstention", "agreement", digits=9)


@query("""SELECT user_id, count(*) AS n, round(sum(value), 4) AS s, round(sum(value * value), 4) AS s2, round(sqrt(greatest(0, sum(value * value) / count(*) - (sum(value) / count(*)) ** 2)), 4) AS std FROM events GROUP BY 1""")
def online_moments(spark, sf):
    n, s, s2 = F.count(F.lit(1)), F.sum("value"), F.sum(F.col("value") * F.col("value"))
    out = table(spark, sf, "events").groupBy("user_id").agg(n.alias("n"), s.alias("s"), s2.alias("s2"), F.sqrt(F.greatest(F.lit(0.0), s2 / n - F.pow(s / n, 2))).alias("std"))
    return rounded(out, "s", "s2", "std", digits=4)


@query("""SELECT user_id, round(avg(value), 6) AS mean_last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20 GROUP BY 1""")
def last_n_reservoir(spark, sf):
    last = aggregates.examples(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20)
    return rounded(last.groupBy("user_id").agg(F.avg("value").alias("mean_last"), F.count(F.lit(1)).alias("n")), "mean_last")


# ---- joins ----


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS k FROM documents WHERE doc_id % 5 = 0), b AS (SELECT doc_id, sha256(text) AS k FROM documents WHERE doc_id % 5 <> 0)
SELECT k AS key, a.doc_id AS left_id, b.doc_id AS right_id FROM a JOIN b USING (k)""")
def equi_join_leakage(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    return joins.overlap_pairs(docs.where("doc_id % 5 = 0"), docs.where("doc_id % 5 <> 0"), "k", "doc_id", "doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_overlap(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    return joins.overlapping(table(spark, sf, "customer"), big, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_overlap(spark, sf):
    return joins.without(table(spark, sf, "customer"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey", "c_name")


@query("""
WITH a AS (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'click' AND value > 40 GROUP BY 1), b AS (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'error' AND value > 40 GROUP BY 1)
SELECT user_id, round(a.m, 6) AS mean_a, round(b.m, 6) AS mean_b, round(b.m - a.m, 6) AS delta, CASE WHEN a.m IS NULL THEN 'a' WHEN b.m IS NULL THEN 'b' END AS missing FROM a FULL JOIN b USING (user_id)""")
def full_outer_diff(spark, sf):
    e = table(spark, sf, "events").where("value > 40")
    out = joins.compare_runs(e.where("event_type = 'click'"), e.where("event_type = 'error'"), ["user_id"], "value")
    return rounded(out, "mean_a", "mean_b", "delta")


SIMHASH = """
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM w),
b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, (SELECT unnest(range(64))::UBIGINT AS i) GROUP BY ALL)
SELECT doc_id, sum(CASE WHEN v > 0 THEN 1::UBIGINT << i ELSE 0 END)::UBIGINT AS h FROM b GROUP BY 1"""


def hashed(spark, sf) -> DataFrame:
    """(doc_id, h): 64-bit SimHash of each whole text: of each bit, what most words have."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    h = words.select("doc_id", arrays.hash64(F.substring(F.md5("w"), 1, 16)).alias("h"))
    bits = h.groupBy("doc_id").agg(*[F.sum(2 * F.getbit("h", F.lit(i)) - 1).alias(f"b{i}") for i in range(64)])
    value = F.lit(0).cast("long")
    for i in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits.select("doc_id", value.alias("h"))


@query(f"""WITH h AS ({SIMHASH}), c AS (SELECT h, min(doc_id) AS id, count(*) AS n FROM h GROUP BY 1)
SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS distance, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 7""")
def hamming_pairs(spark, sf):
    """Near texts by SimHash: pairs of classes of equal hashes, with their sizes."""
    return joins.hamming_links(checkpoint(hashed(spark, sf)), "h", "doc_id", 7)


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS k FROM documents), c AS (SELECT k, min(doc_id) AS left_id, count(*) AS n_left FROM a JOIN labels USING (doc_id) GROUP BY 1), d AS (SELECT k, min(doc_id) AS right_id, count(*) AS n_right FROM a WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1)
SELECT k AS key, left_id, right_id, n_left, n_right FROM c JOIN d USING (k)""")
def overlap_classes(spark, sf):
    """Texts that labelled and other documents share, with the sizes of both groups."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    known = table(spark, sf, "labels").select("doc_id")
    return joins.overlap_classes(docs.join(known, "doc_id"), docs.join(known, "doc_id", "left_anti"), "k", "doc_id", "doc_id")


@query("""
WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup' AND value > 40),
p AS (SELECT a.event_id, a.user_id, b.event_id AS near_id, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 AS gap FROM a JOIN b ON a.user_id = b.user_id OR a.user_id NOT IN (SELECT user_id FROM b)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, near_id) AS r FROM p)
SELECT event_id, user_id, near_id, gap, CASE WHEN gap <= 3600 THEN 'strict_paired' WHEN gap <= 20000 THEN 'qualitative_weak' ELSE 'reject_unpaired' END AS status FROM r WHERE r = 1""")
def nearest_event_pair(spark, sf):
    """Each error with the large signup nearest in time, of its own user if that has any."""
    e = table(spark, sf, "events")
    a, b = (d.select("event_id", "user_id", "ts") for d in (e.where("event_type = 'error'"), e.where("event_type = 'signup' AND value > 40")))
    out = joins.nearest(a, b, "ts", "event_id", "user_id")
    return out.select("event_id", "user_id", F.col("near_event_id").alias("near_id"), "gap", rules.gap_tier(F.col("gap"), 3600, 20000).alias("status"))


@query("""
WITH a AS (SELECT * FROM events WHERE event_type = 'purchase'), b AS (SELECT * FROM events WHERE event_type = 'view')
SELECT a.event_id, a.user_id, b.value AS latest FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_backward(spark, sf):
    e = table(spark, sf, "events")
    out = joins.asof_backward(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'"), ["user_id"], "ts", "value", "event_id")
    return out.select("event_id", "user_id", "latest")


@query("""
WITH l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'n' || c_custkey END AS k1, 'p' || (c_custkey % 500) AS k2 FROM customer),
p AS (SELECT s_suppkey AS sid, 'n' || (s_suppkey * 7) AS f1, 'p' || (s_suppkey % 60) AS f2 FROM supplier),
i AS (SELECT k, arg_max(sid, sid) AS sid FROM (SELECT f1 AS k, sid FROM p UNION ALL SELECT f2, sid FROM p) GROUP BY k)
SELECT l.id, coalesce(a.sid, b.sid) AS pred_sid, CASE WHEN a.sid IS NOT NULL THEN 0 ELSE 1 END AS matched_key FROM l LEFT JOIN i a ON a.k = nullif(l.k1, '') LEFT JOIN i b ON b.k = l.k2 WHERE coalesce(a.sid, b.sid) IS NOT NULL""")
def multi_key_fallback_join(spark, sf):
    k = F.col("c_custkey")
    left = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("n"), k)).alias("k1"), F.concat(F.lit("p"), k % 500).alias("k2"))
    s = F.col("s_suppkey")
    look = table(spark, sf, "supplier").select(s.alias("sid"), F.concat(F.lit("n"), s * 7).alias("f1"), F.concat(F.lit("p"), s % 60).alias("f2"))
    return joins.fallback_join(left, look, ["k1", "k2"], ["f1", "f2"], "id", "sid").select("id", "pred_sid", "matched_key")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'P' THEN 'transition' WHEN o_orderpriority = '1-URGENT' THEN 'glare' WHEN o_orderpriority = '5-LOW' THEN 'fog' END AS env,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 0.7 WHEN o_orderstatus = 'P' THEN 0.75 WHEN o_orderpriority = '1-URGENT' THEN 0.9 WHEN o_orderpriority = '5-LOW' THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM orders""")
def label_lookup_with_overrides(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    out = joins.overridden_lookup(rows, "o_orderpriority", "o_orderstatus", [("1-URGENT", "glare", 0.9), ("5-LOW", "fog", 0.8)], [("1-URGENT", "F", None, 0.7), (None, "P", "transition", 0.75)])
    return out.select("o_orderkey", "env", "confidence")


@query("""
WITH f AS (SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, source, doc_id FROM documents), r AS (SELECT o_orderkey, 'src' || (o_orderkey % 20) AS source, o_orderkey // 20 AS i FROM orders)
SELECT r.o_orderkey, f.doc_id FROM r LEFT JOIN f USING (source, i)""")
def index_offset_join(spark, sf):
    docs = ranks.ranked(table(spark, sf, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "i")
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k, F.concat(F.lit("src"), k % 20).alias("source"), F.floor(k / 20).cast("int").alias("i"))
    return rows.join(docs, ["source", "i"], "left").select("o_orderkey", "doc_id")


@query("""
WITH c AS (SELECT a.event_id AS l, b.event_id AS r, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS gap, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), b.event_id) AS k
  FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'view')
SELECT l, r, gap FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY gap, l) AS m FROM c WHERE k = 1) WHERE m = 1""")
def nearest_one_to_one(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    near = joins.nearest(e.where("event_type = 'signup'"), e.where("event_type = 'view'"), "ts", "event_id", "user_id", others=False)
    pairs = near.select(F.col("event_id").alias("l"), F.col("near_event_id").alias("r"), F.round(F.col("gap") * 1e6).cast("long").alias("gap"))
    return joins.one_to_one(pairs, "l", "r", "gap")


@query("""SELECT l_orderkey, l_linenumber, (l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0 AND 0.05) OR (l_quantity BETWEEN 30 AND 50 AND l_discount BETWEEN 0.05 AND 0.1) AS hit FROM lineitem""")
def point_in_box(spark, sf):
    boxes = F.array(*[F.struct(F.lit(a).alias("x0"), F.lit(b).alias("x1"), F.lit(c).alias("y0"), F.lit(d).alias("y1")) for a, b, c, d in ((10.0, 20.0, 0.0, 0.05), (30.0, 50.0, 0.05, 0.1))])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", arrays.in_box(F.col("l_quantity"), F.col("l_discount"), boxes).alias("hit"))


@query("""
WITH k AS (SELECT 'sha' AS key, doc_id % 2 AS side, sha256(text) AS v FROM documents UNION ALL SELECT 'source', doc_id % 2, source FROM documents UNION ALL SELECT 'n_chars', doc_id % 2, n_chars::VARCHAR FROM documents),
s AS (SELECT key, v, count(DISTINCT side) AS n FROM k GROUP BY ALL) SELECT key, count_if(n > 1)::BIGINT AS overlap FROM s GROUP BY 1""")
def overlap_report(spark, sf):
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha"), "source", "n_chars", (F.col("doc_id") % 2).alias("split"))
    return splits.leakage(docs, ["sha", "source", "n_chars"])


@query("""
WITH c AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), s AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT (SELECT count(*) FROM (SELECT k FROM c INTERSECT SELECT k FROM s)) AS both, (SELECT count(*) FROM (SELECT k FROM c EXCEPT SELECT k FROM s)) AS only_left, (SELECT count(*) FROM (SELECT k FROM s EXCEPT SELECT k FROM c)) AS only_right, (SELECT count(*) FROM (SELECT k FROM c UNION SELECT k FROM s)) AS either""")
def set_operations(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    return splits.set_counts(c, table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k")


@query("""SELECT key, side, amount, status FROM (SELECT c_custkey AS key, 'customer' AS side, c_acctbal AS amount, NULL::VARCHAR AS status FROM customer UNION ALL SELECT o_orderkey, 'order', o_totalprice, o_orderstatus FROM orders)""")
def union_by_name(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("side"), F.col("c_acctbal").alias("amount"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.lit("order").alias("side"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    return a.unionByName(b, allowMissingColumns=True)


# ---- graph and splits ----


@query("""
WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS cluster FROM documents)
SELECT doc_id, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM g""")
def dup_components(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return graph.clusters(docs.select("doc_id"), "doc_id", graph.equal_links(docs, "doc_id", "sha"))


@query("""
WITH RECURSIVE n AS MATERIALIZED (SELECT o_orderkey AS id, 'c' || o_custkey AS k1, CASE WHEN o_orderkey % 40 = 0 THEN 'm' || substr(md5(o_orderkey::VARCHAR), 1, 2) END AS k2 FROM orders),
l AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY k1) AS g, k2 FROM n), e AS MATERIALIZED (SELECT DISTINCT g AS a, min(g) OVER (PARTITION BY k2) AS b FROM l WHERE k2 IS NOT NULL),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), s AS (SELECT DISTINCT g AS node, g AS label FROM l UNION SELECT u.b, s.label FROM s JOIN u ON u.a = s.node WHERE s.label < u.b),
r AS (SELECT node, min(label) AS label FROM s GROUP BY 1)
SELECT id AS o_orderkey, label AS super_group FROM l JOIN r ON l.g = r.node""")
def super_groups(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 40 == 0, F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 2)).alias("mark"))
    return splits.super_groups(o, "o_orderkey", ["o_custkey", "mark"]).select("o_orderkey", "super_group")


@query("""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN p <= CASE WHEN n >= 2 THEN greatest(1, least(n - 1, round_even(n * 0.85, 0)::BIGINT)) ELSE 1 END THEN 'train' ELSE 'test' END AS split FROM r""")
def stratified_split(spark, sf):
    return splits.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.85)


@query("""
WITH per AS (SELECT o_custkey, o_orderpriority AS label, count(*) AS c, min(o_orderkey) AS p FROM orders GROUP BY ALL),
top AS (SELECT o_custkey, arg_max(label, {'c': c, 'o': -p}) AS label, sum(c)::BIGINT AS n FROM per GROUP BY 1),
w AS (SELECT *, sum(n) OVER (PARTITION BY label) AS total, coalesce(sum(n) OVER (PARTITION BY label ORDER BY md5(o_custkey || ':42'), o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM top),
s AS (SELECT o_custkey, CASE WHEN before < CASE WHEN total >= 2 THEN greatest(1, least(total - 1, round_even(total * 0.8, 0)::BIGINT)) ELSE round_even(total * 0.8, 0)::BIGINT END THEN 'train' ELSE 'test' END AS split FROM w)
SELECT o_orderkey, o_custkey, split FROM orders JOIN s USING (o_custkey)""")
def group_split(spark, sf):
    out = splits.grouped(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", 0.8)
    return out.select("o_orderkey", "o_custkey", "split")


@query("""
WITH g AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY sha256(text)) AS super_group FROM documents), per AS (SELECT super_group, lang AS label, count(*) AS c, min(doc_id) AS p FROM g GROUP BY ALL),
top AS (SELECT super_group, arg_max(label, {'c': c, 'o': -p}) AS label, sum(c)::BIGINT AS n FROM per GROUP BY 1),
w AS (SELECT *, sum(n) OVER (PARTITION BY label) AS total, coalesce(sum(n) OVER (PARTITION BY label ORDER BY md5(super_group || ':42'), super_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM top),
s AS (SELECT super_group, CASE WHEN before < CASE WHEN total >= 2 THEN greatest(1, least(total - 1, round_even(total * 0.8, 0)::BIGINT)) ELSE round_even(total * 0.8, 0)::BIGINT END THEN 'train' ELSE 'test' END AS split FROM w)
SELECT doc_id, super_group, split FROM g JOIN s USING (super_group)""")
def cluster_aware_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("sha"))
    groups = splits.super_groups(docs, "doc_id", ["sha"])
    return splits.grouped(groups, "super_group", "lang", "doc_id", 0.8).select("doc_id", "super_group", "split")


@query("""SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) AS r FROM documents) WHERE r <= 50""")
def capped_per_class(spark, sf):
    return splits.capped(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 50)


@query("""SELECT p_partkey, p_brand, turn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS turn FROM part) ORDER BY turn, p_brand LIMIT 60""")
def round_robin(spark, sf):
    return splits.round_robin(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"], 60)


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100""")
def sample_excluding(spark, sf):
    return splits.excluding(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", 100).select("doc_id")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS r FROM c)
SELECT user_id, max(event_type) FILTER (r = 1) AS top1, max(event_type) FILTER (r = 2) AS top2, max(n) FILTER (r = 1) AS n1, max(n) FILTER (r = 2) AS n2 FROM r GROUP BY 1""")
def top2_per_key(spark, sf):
    got = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.collect_list(F.struct("event_type", "n")).alias("c"))
    t = arrays.top2(F.col("c.event_type"), F.col("c.n"))
    return got.select("user_id", t[0]["c"].alias("top1"), t[1]["c"].alias("top2"), t[0]["p"].alias("n1"), t[1]["p"].alias("n2"))


@query("""
SELECT o_orderkey, round(priority, 9) AS priority FROM (SELECT o_orderkey, -abs(o_totalprice / 600000 - 0.62) + o_orderkey % 7 / 7.0::DOUBLE + CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END AS priority FROM orders) ORDER BY priority DESC, o_orderkey LIMIT 50""")
def review_queue(spark, sf):
    status = F.when(F.col("o_orderstatus") == "P", "glare").otherwise("fog")
    rows = table(spark, sf, "orders").select("o_orderkey", splits.uncertainty(F.col("o_totalprice") / 600000, F.col("o_orderkey") % 7 / 7.0, status).alias("priority"))
    return rounded(splits.ranked_queue(rows, [F.desc("priority"), F.col("o_orderkey")], 50), "priority", digits=9)


# ---- windows and folds ----

E = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"


def by_user(spark, sf, *columns: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", "ts", *columns)


ORDER = ["ts", "event_id"]


@query("""
WITH c AS (SELECT user_id, ts, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM events)
SELECT user_id, count(*) AS n, count_if(c)::BIGINT AS n_changes, round(count_if(c)::BIGINT / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / 60), 9) AS per_minute FROM c GROUP BY 1""")
def transition_rate(spark, sf):
    rows = by_user(spark, sf, "event_type").withColumn("s", micros() / 1e6)
    return rounded(ordered.changes(rows, ["user_id"], ORDER, "event_type", "s"), "per_minute", digits=9)


@query(f"""
SELECT user_id, event_id, round(CASE WHEN rn >= 10 THEN value - avg(value) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) END, 6) AS delta,
  round(CASE WHEN rn > 3 THEN stddev_pop(value) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END, 6) AS previous_std,
  round(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY rn)), 6) AS jerk,
  round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling_median FROM ({E})""")
def rolling_features(spark, sf):
    rows = by_user(spark, sf, "value")
    for f in (lambda d: ordered.delta_to_previous(d, ["user_id"], ORDER, "value"), lambda d: ordered.deviation_of_previous(d, ["user_id"], ORDER, "value"), lambda d: ordered.jerk(d, ["user_id"], ORDER, "value"), lambda d: ordered.rolling_median(d, ["user_id"], ORDER, "value")):
        rows = f(rows)
    return rounded(rows.select("user_id", "event_id", "delta", "previous_std", "jerk", "rolling_median"), "delta", "previous_std", "jerk", "rolling_median")


@query(f"""
WITH w AS (SELECT user_id, event_id, count(*) OVER x AS k, (max(epoch_us(ts)) OVER x - min(epoch_us(ts)) OVER x) / 1e6 AS span FROM ({E}) WINDOW x AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, round(CASE WHEN k >= 2 AND span > 0 THEN (k - 1) / span ELSE 0 END, 12) AS fps FROM w""")
def fps_window(spark, sf):
    return rounded(ordered.frame_rate(by_user(spark, sf), ["user_id"], ORDER, micros()).select("user_id", "event_id", "fps"), "fps", digits=12)


@query(f"SELECT user_id, event_id FROM ({E}) WHERE rn % 15 = 0")
def every_nth(spark, sf):
    return ordered.every(by_user(spark, sf), ["user_id"], ORDER, 15).select("user_id", "event_id")


@query(f"SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY rn) AS p FROM ({E})) WHERE p IS DISTINCT FROM event_type")
def change_only(spark, sf):
    return ordered.on_change(by_user(spark, sf, "event_type"), ["user_id"], ORDER, "event_type").select("user_id", "event_id", "event_type")


@query(f"SELECT user_id, round(avg(d), 6) AS mean_diff, round(stddev_pop(d), 6) AS std_diff FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY rn)) AS d FROM ({E})) GROUP BY 1")
def interframe_difference(spark, sf):
    return rounded(ordered.interframe(by_user(spark, sf, "value"), ["user_id"], ORDER, "value"), "mean_diff", "std_diff")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED ({E}), r AS (
  SELECT user_id, rn, event_id, value >= 28 AS latched FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, e.event_id, CASE WHEN r.latched THEN NOT e.value < 22 ELSE e.value >= 28 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, latched AS "on" FROM r""")
def raw_latch(spark, sf):
    return ordered.latch(by_user(spark, sf, "value"), ["user_id"], ORDER, "value", 28.0, 22.0).select("user_id", "event_id", "on")


@query(f"""SELECT user_id, event_id, coalesce(bool_and(value > 15) OVER x AND count(*) OVER x = 3, false) AS active FROM ({E}) WINDOW x AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def consecutive_anomaly(spark, sf):
    rows = by_user(spark, sf, "value").withColumn("flag", F.col("value") > 15)
    return ordered.consecutive(rows, ["user_id"], ORDER, "flag", 3).select("user_id", "event_id", "active")


@query(f"""
WITH m AS (SELECT user_id, rn - 1 AS i, avg(value) OVER x AS m, count(*) OVER x AS k FROM ({E}) WINDOW x AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(m, 9) DESC, i) AS r FROM m WHERE k = 10) SELECT user_id, i::INT AS start, round(m, 6) AS best_score FROM r WHERE r = 1""")
def best_sequence(spark, sf):
    return rounded(ordered.best_window(by_user(spark, sf, "value"), ["user_id"], ORDER, "value", 10), "best_score")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED ({E}), r AS (SELECT user_id, rn, event_id, value AS ema FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, e.event_id, 0.55::DOUBLE * e.value + (1 - 0.55::DOUBLE) * r.ema FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, round(ema, 6) AS ema FROM r""")
def ema_by_user(spark, sf):
    out = ordered.fold(by_user(spark, sf, "value"), ["user_id"], ORDER, ["value"], lambda: ordered.Ema(0.55), "ema", "double")
    return rounded(out.select("user_id", "event_id", "ema"), "ema")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED ({E}), r AS (SELECT user_id, rn, value AS x, 100.0::DOUBLE AS p FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, r.x + r.p / (r.p + 4) * (e.value - r.x), (1 - r.p / (r.p + 4)) * r.p + 0.5::DOUBLE FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, round(arg_max(x, rn), 6) AS kalman FROM r GROUP BY 1""")
def kalman_by_user(spark, sf):
    return rounded(ordered.fold(by_user(spark, sf, "value"), ["user_id"], ORDER, ["value"], ordered.Kalman, "kalman", "double", last=True), "kalman")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED ({E}), g AS (SELECT unnest([0.1, 0.5, 2.0])::DOUBLE AS q, unnest([4.0, 4.0, 1.0])::DOUBLE AS o),
r AS (SELECT user_id, rn, q, o, value AS x, 100.0::DOUBLE AS p, 0.0::DOUBLE AS d FROM e, g WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, q, o, x + (p + q) / (p + q + o) * (value - x), (1 - (p + q) / (p + q + o)) * (p + q), abs(value - x) FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, format('q={{:g}} r={{:g}}', q, o) AS option, round(sqrt(avg(d * d)), 6) AS rms, round(median(d), 6) AS median, round(stddev_pop(d), 6) AS std FROM r WHERE rn > 5 GROUP BY ALL""")
def kalman_sweep(spark, sf):
    out = ordered.kalman_sweep(by_user(spark, sf, "value"), ["user_id"], ORDER, "value", [(0.1, 4.0), (0.5, 4.0), (2.0, 1.0)])
    return rounded(out, "rms", "median", "std")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED ({E}), g AS (SELECT unnest([0.35, 0.65, 0.9])::DOUBLE AS a),
r AS (SELECT user_id, rn, a, value, value AS y FROM e, g WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, a, e.value, (1 - a) * e.value + (1 - (1 - a)) * y FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1),
d AS (SELECT user_id, a, abs(value - lag(value) OVER w) AS x, abs(y - lag(y) OVER w) AS z FROM r WINDOW w AS (PARTITION BY user_id, a ORDER BY rn))
SELECT user_id, format('{{:g}}', a) AS option, round(avg(x), 6) AS raw_noise, round(avg(z), 6) AS smooth_noise, round(100 * (1 - avg(z) / (avg(x) + 1e-9)), 6) AS reduction_pct FROM d GROUP BY ALL""")
def noise_filter_sweep(spark, sf):
    out = ordered.noise_sweep(by_user(spark, sf, "value"), ["user_id"], ORDER, "value", [0.35, 0.65, 0.9])
    return rounded(out, "raw_noise", "smooth_noise", "reduction_pct")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED ({E}), r AS (SELECT user_id, rn, event_id, event_type AS stable, event_type AS pending, 1 AS c FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, e.event_id, CASE WHEN (CASE WHEN e.event_type = r.pending THEN r.c + 1 ELSE 1 END) >= 3 THEN e.event_type ELSE r.stable END, e.event_type, CASE WHEN e.event_type = r.pending THEN r.c + 1 ELSE 1 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, stable FROM r""")
def consecutive_hysteresis(spark, sf):
    out = ordered.fold(by_user(spark, sf, "event_type"), ["user_id"], ORDER, ["event_type"], lambda: ordered.Hysteresis(3), "stable", "string")
    return out.select("user_id", "event_id", "stable")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED ({E}), r AS (SELECT user_id, rn, event_id, 'GOOD' AS s, value AS m, (value >= 20)::INT AS k FROM e WHERE rn = 1 UNION ALL
  SELECT user_id, rn, event_id, CASE WHEN goal <> '' AND k + 1 >= 2 THEN goal ELSE s END, m, CASE WHEN goal = '' OR k + 1 >= 2 THEN 0 ELSE k + 1 END FROM (
    SELECT user_id, rn, event_id, s, m, k, CASE s WHEN 'GOOD' THEN CASE WHEN m >= 20 THEN 'DEGRADED' ELSE '' END WHEN 'DEGRADED' THEN CASE WHEN m >= 50 THEN 'BAD' WHEN m <= 14 THEN 'GOOD' ELSE '' END ELSE CASE WHEN m <= 32 THEN 'DEGRADED' ELSE '' END END AS goal FROM (
      SELECT e.user_id, e.rn, e.event_id, r.s, r.k, (1 - 0.25::DOUBLE) * r.m + 0.25::DOUBLE * e.value AS m FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)))
SELECT user_id, event_id, s AS state FROM r""")
def skew_gate(spark, sf):
    out = ordered.fold(by_user(spark, sf, "value"), ["user_id"], ORDER, ["value"], lambda: ordered.SkewGate(hold=2), "state", "string")
    return out.select("user_id", "event_id", "state")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT *, CASE WHEN value > 40 THEN 'glare' WHEN value > 20 THEN 'fog' ELSE 'default' END AS d FROM ({E})),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS event_id, 'default' AS stable, '' AS candidate, 0 AS streak FROM e UNION ALL
  SELECT user_id, rn, event_id, CASE WHEN d = stable OR streak >= need THEN d ELSE stable END, CASE WHEN d = stable OR streak >= need THEN '' ELSE d END, CASE WHEN d = stable OR streak >= need THEN 0 ELSE streak END FROM (
    SELECT e.user_id, e.rn, e.event_id, e.d, r.stable, CASE WHEN e.d = r.candidate THEN r.streak + 1 ELSE 1 END AS streak, CASE WHEN e.d IN ('glare', 'fog') THEN 2 WHEN r.stable = 'fog' THEN 2 ELSE 3 END AS need
    FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, event_id, stable AS preset FROM r WHERE rn > 0""")
def preset_debounce(spark, sf):
    preset = F.when(F.col("value") > 40, "glare").when(F.col("value") > 20, "fog").otherwise("default")
    out = ordered.fold(by_user(spark, sf, "value").withColumn("desired", preset), ["user_id"], ORDER, ["desired"], lambda: ordered.Debounce(usual=3, special={"glare": (2, 3), "fog": (2, 2)}), "preset", "string")
    return out.select("user_id", "event_id", "preset")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT *, epoch_us(ts) / 1e6 AS t FROM ({E})), r AS (SELECT user_id, rn, event_id, value AS x, 0.0::DOUBLE AS d, t FROM e WHERE rn = 1 UNION ALL
  SELECT user_id, rn, event_id, x + c / (c + 1) * (v - x), d, t FROM (SELECT *, 2 * pi() * (1.15::DOUBLE + 0.018::DOUBLE * abs(d)) * dt AS c FROM (
    SELECT user_id, rn, event_id, v, x, t, dt, d + (2 * pi() * dt) / (2 * pi() * dt + 1) * ((v - x) / dt - d) AS d FROM (
      SELECT e.user_id, e.rn, e.event_id, e.value AS v, r.x, r.d, e.t, CASE WHEN e.t > r.t THEN e.t - r.t ELSE 1e-6::DOUBLE END AS dt FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))))
SELECT user_id, event_id, round(x, 6) AS smooth FROM r""")
def one_euro(spark, sf):
    rows = by_user(spark, sf, "value").withColumn("t", micros() / 1e6)
    return rounded(ordered.fold(rows, ["user_id"], ORDER, ["value", "t"], ordered.OneEuro, "smooth", "double").select("user_id", "event_id", "smooth"), "smooth")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT *, least(0.98, value / 100) AS p FROM ({E})), r AS (SELECT user_id, rn, event_id, p AS fog, 1 - p AS rain FROM e WHERE rn = 1 UNION ALL
  SELECT user_id, rn, event_id, f / (f + g), g / (f + g) FROM (SELECT e.user_id, e.rn, e.event_id, CASE WHEN e.p > r.fog THEN 0.8::DOUBLE * e.p + (1 - 0.8::DOUBLE) * r.fog ELSE 0.3::DOUBLE * e.p + (1 - 0.3::DOUBLE) * r.fog END AS f,
    0.55::DOUBLE * (1 - e.p) + (1 - 0.55::DOUBLE) * r.rain AS g FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, event_id, round(fog, 6) AS fog, round(rain, 6) AS rain FROM r""")
def posterior_ema(spark, sf):
    p = F.least(F.lit(0.98), F.col("value") / 100)
    rows = by_user(spark, sf, "value").withColumn("proba", F.to_json(F.struct(p.alias("fog"), (1 - p).alias("rain"))))
    out = ordered.fold(rows, ["user_id"], ORDER, ["proba"], lambda: ordered.Posterior(["fog", "rain"], 0.55, {"fog": (0.8, 0.3)}), "posterior", "string")
    return rounded(out.select("user_id", "event_id", F.from_json("posterior", "fog double, rain double").alias("s")).select("user_id", "event_id", "s.*"), "fog", "rain")


@query(f"""
WITH RECURSIVE k AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, turn, sha256(coalesce(text, '')) AS t FROM conversations),
b AS (SELECT unhex('{bytes(c ^ 0x36 for c in b"key".ljust(64, b"\0")).hex()}') AS i, unhex('{bytes(c ^ 0x5C for c in b"key".ljust(64, b"\0")).hex()}') AS o),
r AS (SELECT conv_id, rn, turn, sha256(o || unhex(sha256(i || encode('{{"prev": null, "text": "' || t || '"}}')))) AS s FROM k, b WHERE rn = 1 UNION ALL
  SELECT k.conv_id, k.rn, k.turn, sha256(o || unhex(sha256(i || encode('{{"prev": "' || r.s || '", "text": "' || k.t || '"}}')))) FROM r JOIN k ON k.conv_id = r.conv_id AND k.rn = r.rn + 1, b)
SELECT conv_id, turn, s AS signature, true AS valid FROM r""")
def hash_chain(spark, sf):
    """Signatures of the digests of each turn, each with the one before; all must hold."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))
    chained = ordered.fold(rows, ["conv_id"], ["turn"], ["text"], lambda: ordered.HashChain(b"key"), "signature", "string")
    return ordered.verify_chain(chained, ["conv_id"], ["turn"], "text", "signature", b"key").select("conv_id", "turn", "signature", "valid")


@query(f"""
WITH RECURSIVE e AS MATERIALIZED ({E}), r AS (SELECT user_id, rn, event_id, CASE WHEN value > 30 THEN 'alert' ELSE '' END AS t, CASE WHEN value > 30 THEN 8 ELSE 0 END AS k FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, e.event_id, CASE WHEN e.value > 30 THEN 'alert' WHEN r.k > 0 THEN r.t ELSE '' END, CASE WHEN e.value > 30 THEN 8 WHEN r.k > 0 THEN r.k - 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, t AS alert FROM r""")
def alert_hold(spark, sf):
    rows = by_user(spark, sf, "value").withColumn("text", F.when(F.col("value") > 30, "alert").otherwise(""))
    return ordered.fold(rows, ["user_id"], ORDER, ["text"], ordered.Hold, "alert", "string").select("user_id", "event_id", "alert")


# ---- statistics ----


@query("""
WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT e.event_id, e.event_type, value, med, abs(value - med) AS dev FROM events e JOIN m USING (event_type)), k AS (SELECT event_type, median(dev) AS mad FROM d GROUP BY 1)
SELECT event_id, event_type, round(0.6745 * (value - med) / (mad + 1e-6), 6) AS z, 0.6745 * (value - med) / (mad + 1e-6) > 3.5 AS outlier FROM d JOIN k USING (event_type)""")
def mad_outliers(spark, sf):
    out = statistics.mad_flags(table(spark, sf, "events"), ["event_type"], "value")
    return rounded(out.select("event_id", "event_type", "z", "outlier"), "z")


@query("""
WITH t AS (SELECT value AS v FROM events WHERE event_id % 2 = 0), s AS (SELECT value * 1.1 AS v FROM events WHERE event_id % 2 = 1),
e AS (SELECT list_sort(list_distinct(quantile_cont(v, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM t),
b AS (SELECT i, e[i] AS lo, e[i + 1] AS hi, i = len(e) - 1 AS last FROM e, generate_series(1, 10) g(i) WHERE i < len(e)),
c AS (SELECT i, (SELECT count(*) FROM t WHERE v >= lo AND (v < hi OR last AND v <= hi)) AS n, (SELECT count(*) FROM s WHERE v >= lo AND (v < hi OR last AND v <= hi)) AS m FROM b),
p AS (SELECT greatest(n / sum(n) OVER (), 1e-6) AS x, greatest(m / sum(m) OVER (), 1e-6) AS y FROM c)
SELECT round(sum((y - x) * ln(y / x)), 9) AS psi FROM p""")
def drift_psi(spark, sf):
    e = table(spark, sf, "events")
    out = statistics.psi(e.where("event_id % 2 = 0").select(F.col("value").alias("v")), e.where("event_id % 2 = 1").select((F.col("value") * 1.1).alias("v")), "v")
    return rounded(out, "psi", digits=9)


@query("""
WITH u AS (SELECT event_type, value AS v, 1 AS l, 0 AS r FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type, value, 0, 1 FROM events WHERE event_id % 2 = 1),
c AS (SELECT event_type, v, sum(l) AS l, sum(r) AS r FROM u GROUP BY ALL),
f AS (SELECT event_type, v, abs(sum(l) OVER (PARTITION BY event_type ORDER BY v) / sum(l) OVER (PARTITION BY event_type) - sum(r) OVER (PARTITION BY event_type ORDER BY v) / sum(r) OVER (PARTITION BY event_type)) AS g, lead(v) OVER (PARTITION BY event_type ORDER BY v) - v AS d FROM c)
SELECT event_type, round(max(g), 9) AS ks, round(sum(g * coalesce(d, 0)), 6) AS w1 FROM f GROUP BY 1""")
def drift_ks_w1(spark, sf):
    e = table(spark, sf, "events")
    out = statistics.ks_w1(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "value", ["event_type"])
    return rounded(rounded(out, "ks", digits=9), "w1")


@query("""
WITH t AS (SELECT value FROM events WHERE event_id % 2 = 0), s AS (SELECT value FROM events WHERE event_id % 2 = 1), q AS (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM t)
SELECT (SELECT round(avg(value), 6) FROM t) AS train_mean, (SELECT round(stddev_pop(value), 6) FROM t) AS train_std, (SELECT round(median(value), 6) FROM t) AS train_median, round(a, 6) AS train_p5, round(b, 6) AS train_p95,
  (SELECT round(avg(value), 6) FROM s) AS sensor_mean, (SELECT round(stddev_pop(value), 6) FROM s) AS sensor_std, (SELECT round(median(value), 6) FROM s) AS sensor_median, (SELECT round(quantile_cont(value, 0.05), 6) FROM s) AS sensor_p5, (SELECT round(quantile_cont(value, 0.95), 6) FROM s) AS sensor_p95,
  (SELECT round(avg((value < a OR value > b)::INT), 9) FROM s) AS out_of_range_rate FROM q""")
def drift_moments(spark, sf):
    e = table(spark, sf, "events")
    out = statistics.drift_summary(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "value")
    return rounded(rounded(out, *[c for c in out.columns if c != "out_of_range_rate"]), "out_of_range_rate", digits=9)


@query(f"""
WITH b AS (SELECT *, (predicted = truth)::INT AS ok, CASE WHEN conf < 0.1 THEN 0 WHEN conf < 0.2 THEN 1 WHEN conf < 0.30000000000000004 THEN 2 WHEN conf < 0.4 THEN 3 WHEN conf < 0.5 THEN 4 WHEN conf < 0.6000000000000001 THEN 5 WHEN conf < 0.7000000000000001 THEN 6 WHEN conf < 0.8 THEN 7 WHEN conf < 0.9 THEN 8 ELSE 9 END AS bin FROM ({CONF})),
g AS (SELECT bin, count(*) AS n, avg(conf) AS c, avg(ok) AS a FROM b GROUP BY 1)
SELECT round((SELECT sum(n * abs(a - c)) / sum(n) FROM g), 9) AS ece, round((SELECT avg((conf - ok) ** 2) FROM b), 9) AS brier""")
def calibration_error(spark, sf):
    return rounded(statistics.ece(scored(spark, sf), "conf", F.col("predicted") == F.col("truth")), "ece", "brier", digits=9)


@query(f"""
WITH l AS (SELECT DISTINCT truth AS label FROM ({CONF}) UNION SELECT DISTINCT predicted FROM ({CONF})), c AS (SELECT label, (SELECT count(*) FROM ({CONF}) WHERE truth = label AND predicted = label) AS tp, (SELECT count(*) FROM ({CONF}) WHERE truth <> label AND predicted = label) AS fp, (SELECT count(*) FROM ({CONF}) WHERE truth = label AND predicted <> label) AS fn FROM l)
SELECT label, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, tp + fn AS support, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM c""")
def class_report(spark, sf):
    return rounded(statistics.class_scores(scored(spark, sf), "truth", "predicted"), "precision", "recall", "f1", digits=9)


@query(f"""
WITH l AS (SELECT DISTINCT truth AS label FROM ({CONF}) UNION SELECT DISTINCT predicted FROM ({CONF})), c AS (SELECT label, (SELECT count(*) FROM ({CONF}) WHERE truth = label AND predicted = label) AS tp, (SELECT count(*) FROM ({CONF}) WHERE truth <> label AND predicted = label) AS fp, (SELECT count(*) FROM ({CONF}) WHERE truth = label AND predicted <> label) AS fn FROM l)
SELECT round(sum(tp) / sum(tp + fn), 9) AS accuracy, round(avg(tp / (tp + fn)) FILTER (tp + fn > 0), 9) AS balanced_accuracy, round(avg(2 * tp / (2 * tp + fp + fn)), 9) AS macro_f1, round(sum(2 * tp / (2 * tp + fp + fn) * (tp + fn)) / sum(tp + fn), 9) AS weighted_f1 FROM c""")
def overall_report(spark, sf):
    return rounded(statistics.overall_scores(scored(spark, sf), "truth", "predicted"), "accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", digits=9)


@query(f"""
WITH t AS (SELECT unnest([0.3, 0.5, 0.62, 0.8, 0.9999])::DOUBLE AS threshold), s AS (SELECT threshold, count(truth) FILTER (conf >= threshold) AS n, count(*) AS total,
  count_if(conf >= threshold AND truth = 'F' AND predicted = 'F')::BIGINT AS tp, count_if(conf >= threshold AND truth <> 'F' AND predicted = 'F')::BIGINT AS fp, count_if(conf >= threshold AND truth = 'F' AND predicted <> 'F')::BIGINT AS fn,
  count_if(conf >= threshold AND truth = 'P' AND predicted = 'P')::BIGINT AS tp2, count_if(conf >= threshold AND truth <> 'P' AND predicted = 'P')::BIGINT AS fp2, count_if(conf >= threshold AND truth = 'P' AND predicted <> 'P')::BIGINT AS fn2 FROM t, ({CONF}) GROUP BY 1),
f AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS a, CASE WHEN tp2 > 0 THEN 2 * tp2 / (2 * tp2 + fp2 + fn2) ELSE 0 END AS b FROM s)
SELECT threshold, n AS n_accepted, round(1 - n / total, 9) AS abstention, round(a, 9) AS f1_0, round(b, 9) AS f1_1, round((0.0::DOUBLE + a + b) / 2, 9) AS macro_f1 FROM f""")
def threshold_sweep(spark, sf):
    out = statistics.threshold_sweep(scored(spark, sf), "conf", "truth", "predicted", ["F", "P"], [0.3, 0.5, 0.62, 0.8, 0.9999])
    return rounded(out, "abstention", "f1_0", "f1_1", "macro_f1", digits=9)


@query("""
WITH p AS (SELECT l_linenumber AS k, floor(least(255, l_quantity * 5)) AS a, floor(least(255, l_extendedprice / 420)) AS b FROM lineitem),
n AS (SELECT k, least(31, floor(a * 32 / 255)) AS x, least(31, floor(b * 32 / 255)) AS y, count(*) AS n FROM p GROUP BY ALL),
j AS (SELECT k, n / sum(n) OVER (PARTITION BY k) AS p, sum(n) OVER (PARTITION BY k, x) / sum(n) OVER (PARTITION BY k) AS px, sum(n) OVER (PARTITION BY k, y) / sum(n) OVER (PARTITION BY k) AS py FROM n),
m AS (SELECT k, sum(p * log2(p / (px * py))) AS mi FROM j GROUP BY 1),
ea AS (SELECT k, -sum(p * log2(p)) AS h FROM (SELECT k, a, count(*) / sum(count(*)) OVER (PARTITION BY k) AS p FROM p GROUP BY k, a) GROUP BY 1), eb AS (SELECT k, -sum(p * log2(p)) AS h FROM (SELECT k, b, count(*) / sum(count(*)) OVER (PARTITION BY k) AS p FROM p GROUP BY k, b) GROUP BY 1),
c AS (SELECT k, corr(a, b) AS rho FROM p GROUP BY 1)
SELECT k AS l_linenumber, round(mi, 9) AS mi, round(greatest(0, mi / greatest(sqrt(ea.h * eb.h), 1e-9) * (rho + 1) / 2), 9) AS nmi_rho FROM m JOIN ea USING (k) JOIN eb USING (k) JOIN c USING (k)""")
def mutual_information(spark, sf):
    out = statistics.mutual_information(table(spark, sf, "lineitem"), F.col("l_quantity") * 5, F.col("l_extendedprice") / 420, ["l_linenumber"])
    return rounded(out, "mi", "nmi_rho", digits=9)


@query("""SELECT l_linenumber, round(CASE WHEN avg((l_quantity - 50 * l_tax) ** 2) < 1e-10 THEN 100 ELSE 10 * log10(255.0 * 255 / avg((l_quantity - 50 * l_tax) ** 2)) END, 9) AS psnr FROM lineitem GROUP BY 1""")
def psnr_by_group(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("b", 50 * F.col("l_tax"))
    return rounded(statistics.psnr(rows, "l_quantity", "b", keys=["l_linenumber"]), "psnr", digits=9)


@query("""
WITH h AS (SELECT event_type, value, r, ((event_id + 1)::UBIGINT * 2654435761 + (r + 1)::UBIGINT * 2246822519) & 4294967295::UBIGINT AS h FROM events, range(100) t(r)),
a AS (SELECT event_type, value, r, (xor(h, h >> 15) * 739982445::UBIGINT) & 4294967295::UBIGINT AS h FROM h), b AS (SELECT event_type, value, r, (xor(h, h >> 12) * 695872825::UBIGINT) & 4294967295::UBIGINT AS h FROM a),
u AS (SELECT event_type, value, r, xor(h, h >> 15) / 4294967296 AS u FROM b), w AS (SELECT event_type, value, r, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238463)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT + (u >= 0.999916758850712)::INT AS w FROM u),
m AS (SELECT event_type, r, sum(value * w) / sum(w) AS m FROM w GROUP BY ALL)
SELECT event_type, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY 1""")
def bootstrap_interval(spark, sf):
    return rounded(statistics.bootstrap_mean(table(spark, sf, "events"), ["event_type"], "value", "event_id", 100), "low", "high")


@query("""
WITH d AS (SELECT l_linenumber, l_quantity - 25.5 AS d FROM lineitem), c AS (SELECT l_linenumber, count_if(d > 0)::BIGINT AS up, count_if(d < 0)::BIGINT AS down FROM d GROUP BY 1),
p AS (SELECT l_linenumber, up, down, least(1, 2 * sum(exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2)))) AS p FROM c, range(100000) t(i) WHERE i <= least(up, down) GROUP BY ALL),
t AS (SELECT l_linenumber, abs(d) AS m, count(*) AS t, count_if(d > 0) AS u FROM d GROUP BY ALL), r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY l_linenumber ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS r FROM t),
s AS (SELECT l_linenumber, sum(r * u) AS w, sum(t)::BIGINT AS n, sum(t ** 3 - t) AS tie FROM r GROUP BY 1)
SELECT l_linenumber, up, down, round(p, 6) AS p, w, n, round((w - n * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) AS z FROM p JOIN s USING (l_linenumber)""")
def paired_tests(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_linenumber", (F.col("l_quantity") - 25.5).alias("d"))
    s = statistics.sign_test(rows, ["l_linenumber"], "d")
    return rounded(s.join(statistics.wilcoxon(rows, ["l_linenumber"], "d").drop("p", "tie"), "l_linenumber"), "p", "z")


@query("""
WITH d AS (SELECT l_linestatus AS k, l_quantity - 25 AS d FROM lineitem), o AS (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS r FROM d),
c AS (SELECT k, count(*) AS n, avg(d) AS mean, median(d) AS median, stddev_samp(d) AS std, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS iqr, count_if(d > 0)::BIGINT AS up, count_if(d < 0)::BIGINT AS down FROM d GROUP BY 1),
e AS (SELECT *, floor(n * (0.5 - 1.959963984540054 * 0.5 / sqrt(n)))::BIGINT AS lower FROM c),
p AS (SELECT k, least(1, 2 * sum(exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2)))) AS p FROM e, range(100000) t(i) WHERE i <= least(up, down) GROUP BY ALL)
SELECT k AS l_linestatus, n, round(mean, 6) AS mean, median, round(std, 6) AS std, iqr, (SELECT d FROM o WHERE o.k = e.k AND r = lower) AS low, (SELECT d FROM o WHERE o.k = e.k AND r = n - 1 - lower) AS high, round(p, 6) AS sign_p FROM e JOIN p USING (k)""")
def paired_summary(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_quantity") - 25).alias("d"))
    return rounded(statistics.paired_summary(rows, ["l_linestatus"], "d").drop("wilcoxon_p"), "mean", "std", "sign_p")
