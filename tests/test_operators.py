import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import rules
from framewright.operators import aggregates, graph, joins, learning, ordered, ranks, splits, statistics, validation


def test_summary(spark):
    df = spark.createDataFrame([(1, 5.0, 4.0), (1, 7.0, 8.0), (1, 6.0, 5.0), (2, 3.0, None)], "k int, v double, b double")
    got = {r["k"]: r for r in aggregates.metric_summary(df, ["k"], "v", "b").collect()}
    assert [round(got[1][c], 6) for c in ("mean", "median", "p25", "p75", "p95", "win_rate")] == [6, 6, 5.5, 6.5, 6.9, 0.666667]
    assert got[2]["std"] == 0.0 and got[2]["delta"] is None


def test_summary_holds_no_key_s_values_in_a_task(spark):
    """Quantiles by ranks: no buffer has all distinct values of a key; null keys and keys without values stay."""
    df = spark.range(4000).selectExpr("if(id % 4 = 3, null, id % 4) AS k", "if(id % 4 = 2, null, id * 37 % 4000 / 7) AS v")
    out = aggregates.metric_summary(df, ["k"], "v")
    assert "percentile" not in out._jdf.queryExecution().toString()
    got = {r["k"]: r for r in out.collect()}
    assert set(got) == {0, 1, 2, None} and got[2]["n"] == 0 and got[2]["median"] is None and got[2]["p95"] is None
    for k in (0, 1, None):
        x = [i * 37 % 4000 / 7 for i in range(4000) if i % 4 == (3 if k is None else k)]
        assert [got[k][c] for c in ("median", "p25", "p75", "p95")] == pytest.approx(np.quantile(x, [0.5, 0.25, 0.75, 0.95]).tolist())
        assert got[k]["n"] == 1000 and got[k]["std"] == pytest.approx(np.std(x, ddof=1))


def test_hamming_pairs(spark):
    hexes = ["0000000000000000", "0000000000000003", "000000000000001f", "ffffffffffffffff"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hexes)], "id int, x string").select("id", F.conv("x", 16, -10).cast("long").alias("h"))
    for k, want in ((2, {(0, 1)}), (4, {(0, 1), (1, 2)})):
        assert {(r["a"], r["b"]) for r in joins.hamming_pairs(df, None, "h", "id", k).collect()} == want


def test_hamming_pairs_against_all(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) & (2**64 - 1) for b in base * 8]
    rows = [(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, h long")
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if (values[a] ^ values[b]).bit_count() <= 4}
    assert sorted((x["a"], x["b"]) for x in joins.hamming_pairs(df, None, "h", "id", 4).collect()) == sorted(want)


def test_hamming_links_shuffle_no_pairs(spark):
    """Many near hashes in several blocks: all pairs of classes, and no pair goes through an exchange."""
    r = random.Random(3)
    values = [0xF0F0F0F0F0F0F0F0 ^ sum(1 << r.randrange(64) for _ in range(r.randrange(6))) & (2**64 - 1) for _ in range(700)]
    rows = [(None if i % 50 == 0 else i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)]
    classes = {}
    for i, h in rows:
        classes.setdefault(h % 2**64, []).append(i)
    of = [(min(x for x in ids if x is not None), len(ids), h) for h, ids in classes.items() if any(x is not None for x in ids)]
    want = sorted((a, b, (g ^ h).bit_count(), m, n) for a, m, g in of for b, n, h in of if a < b and (g ^ h).bit_count() <= 7)
    df = spark.createDataFrame(rows, "id int, h long")
    for more in ({}, {"block": 100}):
        out = joins.hamming_links(df, "h", "id", 7, **more)
        assert sorted((x["a"], x["b"], x["distance"], x["n_a"], x["n_b"]) for x in out.collect()) == want
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    as_text = joins.hamming_links(df.selectExpr("lpad(id, 4, '0') AS id", "h"), "h", "id", 7, block=100)
    assert sorted((int(x["a"]), int(x["b"]), x["distance"], x["n_a"], x["n_b"]) for x in as_text.collect()) == want
    assert joins.hamming_links(df.where("id < 0"), "h", "id", 7).count() == 0


def test_nearest_classes_against_all(spark, monkeypatch):
    """Several cells, blocks and tiles; copies and zero vectors tie, null vectors come last, and scores
    are those of the sum from the first component to the last."""
    monkeypatch.setattr(learning, "PAIRS", 2_000, raising=False)
    r = np.random.default_rng(5)
    v = r.normal(size=(400, 7))
    v[50:120], v[120:140], v[140:150] = v[3], 0, v[3] * 1e200
    train = [(i, None if i % 40 == 7 else v[i].tolist(), None if i % 90 == 3 else f"c{i % 5}") for i in range(300)]
    test = [(i, None if i == 310 else v[i if i % 3 else 3].tolist()) for i in range(300, 400)]
    a, b = spark.createDataFrame(train, "id int, v array<double>, l string"), spark.createDataFrame(test, "id int, v array<double>")
    got = {x["id"]: (x["predicted"], x["votes"]) for x in learning.nearest_classes(a, b, "id", "v", "l", 5).collect()}
    assert len(got) == 100
    for i, q in test:
        score = lambda t: -math.inf if q is None or t is None else float(np.cumsum(np.array(q) * t)[-1])
        top = sorted(train, key=lambda t: (-score(t[1]), t[0]))[:5]
        n = {}
        for t in top:
            n[t[2]] = n.get(t[2], 0) + 1
        assert got[i][1] == max(n.values()) and got[i][0] in [c for c, m in n.items() if m == max(n.values())]
    few = learning.nearest_classes(a.where("id in (7, 8, 9)"), b.where("id in (310, 311)"), "id", "v", "l", 5).collect()
    assert {(x["id"], x["votes"]) for x in few} == {(310, 1), (311, 1)}
    wide = learning.nearest_classes(a, b, "id", "v", "l", 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in wide


def test_nearest_classes_with_infinite_components(spark):
    """NaN is the largest score, then infinity, as in the SQL."""
    rows = [(1, [1.0, float("inf")], "inf"), (2, [float("nan"), 1.0], "nan"), (3, [2.0, 2.0], "two"), (4, [-1.0, float("-inf")], "low")]
    a = spark.createDataFrame(rows, "id int, v array<double>, l string")
    b = spark.createDataFrame([(9, [1.0, 1.0])], "id int, v array<double>")
    for k, want in ((1, ["nan"]), (4, ["inf", "low", "nan", "two"])):
        got = learning.nearest_classes(a, b, "id", "v", "l", k).first()
        assert got["predicted"] == want[0] and got["votes"] == 1
    assert learning.nearest_classes(a.where("id <> 2"), b, "id", "v", "l", 1).first()["predicted"] == "inf"


def test_nearest_prefers_the_session(spark):
    kind = "id int, s string, ts timestamp"
    at = lambda n: __import__("datetime").datetime(2024, 1, 1, 0, 0, n)
    a = spark.createDataFrame([(1, "x", at(10)), (2, "y", at(10)), (3, None, at(11)), (4, "x", at(30))], kind)
    b = spark.createDataFrame([(7, "x", at(14)), (8, None, at(11)), (9, "x", at(6)), (10, None, at(9))], kind)
    got = {r["id"]: (r["near_id"], r["gap"]) for r in joins.nearest(a, b, "ts", "id", "s").collect()}
    assert got == {1: (7, 4.0), 2: (8, 1.0), 3: (8, 0.0), 4: (7, 16.0)}


def test_one_to_one_is_greedy(spark):
    r = random.Random(2)
    pairs = [(a, b, r.randrange(20)) for a in range(15) for b in range(15) if r.random() < 0.3]
    used_a, used_b, want = set(), set(), set()
    for a, b, g in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            want.add((a, b))
            used_a.add(a)
            used_b.add(b)
    got = joins.one_to_one(spark.createDataFrame(pairs, "l int, r int, gap int"), "l", "r", "gap")
    assert {(x["l"], x["r"]) for x in got.collect()} == want


def test_fallback_join_takes_the_first_known_key(spark):
    left = spark.createDataFrame([(1, "a", "z"), (2, "", "b"), (3, "q", None)], "id int, k1 string, k2 string")
    look = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "a", 30)], "o int, f string, v int")
    assert {r["id"]: r["pred_v"] for r in joins.fallback_join(left, look, ["k1", "k2"], ["f"], "id", "o").collect()} == {1: 30, 2: 20}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    top = {i: i for e in links for i in e}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {x["node"]: x["label"] for x in graph.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {i: find(i) for e in links for i in e if e[0] != e[1]}


def test_cluster_split_has_no_leakage(spark):
    rows = [(i, f"c{i % 7}", f"g{i % 5 if i < 20 else i}", "fog" if i % 3 else "rain") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, cluster string, grp string, label string")
    groups = splits.super_groups(df, "id", ["cluster", "grp"])
    out = splits.grouped(groups, "super_group", "label", "id", 0.5, seed=3)
    assert all(r["overlap"] == 0 for r in splits.leakage(out, ["cluster", "grp"]).collect())


def test_stratified_keeps_both_sides(spark):
    df = spark.createDataFrame([(i, "a" if i < 2 else "b" if i < 3 else "c") for i in range(30)], "id int, label string")
    got = {(r["label"], r["split"]): r["count"] for r in splits.stratified(df, "label", "id", 0.99).groupBy("label", "split").count().collect()}
    assert got == {("a", "train"): 1, ("a", "test"): 1, ("b", "train"): 1, ("c", "train"): 26, ("c", "test"): 1}


def drive(machine, values):
    return [machine(*v) if isinstance(v, tuple) else machine(v) for v in values]


@pytest.mark.parametrize(("name", "need"), [("glare", 2), ("rain", 10), ("transition", 12), ("fog", 6), ("haze", 18)])
def test_debounce_onset(name, need):
    got = drive(ordered.Debounce(), [name] * need)
    assert got[:-1] == ["default"] * (need - 1) and got[-1] == name


@pytest.mark.parametrize(("name", "need"), [("glare", 20), ("rain", 25), ("transition", 30), ("fog", 18)])
def test_debounce_decay(name, need):
    m = ordered.Debounce()
    drive(m, [name] * 40)
    got = drive(m, ["default"] * need)
    assert got[-2:] == [name, "default"]


def test_skew_gate():
    m = ordered.SkewGate(alpha=1.0, hold=3)
    assert drive(m, [25.0] * 3)[-1] == "DEGRADED" and drive(m, [60.0] * 3)[-1] == "BAD" and drive(m, [None])[-1] == "BAD" and drive(m, [20.0] * 3)[-1] == "DEGRADED"


def test_machines():
    assert drive(ordered.Ema(1.0), [3.0, 5.0]) == [3.0, 5.0] and drive(ordered.Ema(0.5), [0.0, 4.0]) == [0.0, 2.0]
    assert abs(drive(ordered.Kalman(), [0.0] + [10.0] * 200)[-1] - 10) < 0.1
    assert ordered.Kalman(predict_first=True)(5.0) == 5.0
    assert drive(ordered.Hysteresis(3), list("abbba")) == ["a", "a", "a", "b", "b"]
    assert drive(ordered.Hold(2), ["x", "", "", "", "y"]) == ["x", "x", "x", "", "y"]
    assert drive(ordered.MotionGate(1.0, 2, 3), [2, 0, 2, 2, 0, 0, 0, 0, 2, 2]) == [False, False, False, True, True, True, False, False, False, True]
    assert drive(ordered.MotionGate(1.0, 1, 3), [2, None, None, None]) == [True, True, False, False]
    assert drive(ordered.RainMedian(3), [1.0, 9.0, 2.0, 3.0]) == [1.0, 9.0, 2.0, 3.0] and drive(ordered.RainMedian(3), [5.0, 5.1, 5.2, 5.3, 9.0])[-2:] == [5.3, 5.3]
    p = ordered.Posterior(["a", "b"], 0.5)
    assert p('{"a": 1.0, "b": 0.0}') == '{"a": 1.0, "b": 0.0}' and p('{"a": 0.0, "b": 1.0}') == '{"a": 0.5, "b": 0.5}'
    assert drive(ordered.OneEuro(), [(1.0, 0.0), (1.0, 0.1)]) == [1.0, 1.0]
    c = ordered.HashChain(b"k")
    assert c("x") != c("x")


def test_fold_over_batches(spark):
    rows = [(k, i, float((i * 7 + k) % 11)) for k in range(3) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        df = spark.createDataFrame(rows, "k int, i int, v double").repartition(5)
        each = ordered.fold(df, ["k"], ["i"], ["v"], ordered.Ema, "e", "double").collect()
        last = ordered.fold(df, ["k"], ["i"], ["v"], ordered.Ema, "e", "double", last=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(3):
        want = drive(ordered.Ema(), [v for q, _, v in rows if q == k])
        assert [r["e"] for r in sorted(each, key=lambda r: r["i"]) if r["k"] == k] == want
        assert [r["e"] for r in last if r["k"] == k] == [want[-1]]


def test_drift(spark):
    t = spark.createDataFrame([(float(i),) for i in range(6)], "v double")
    s = spark.createDataFrame([(float(i),) for i in range(5, 9)], "v double")
    d = statistics.ks_w1(t, s, "v").first()
    assert d["ks"] == pytest.approx(5 / 6) and d["w1"] == pytest.approx(4.0)
    assert statistics.psi(t, s, "v").first()["psi"] >= 0 and statistics.drift_summary(t, s, "v").first()["out_of_range_rate"] > 0


def test_tests_against_plain(spark):
    from math import comb

    d = [3, -1, 2, 5, -4, 6, 7, 0, 2]
    df = spark.createDataFrame([(1, float(x)) for x in d], "k int, d double")
    up, down = sum(x > 0 for x in d), sum(x < 0 for x in d)
    want = min(1.0, 2 * sum(comb(up + down, i) for i in range(min(up, down) + 1)) / 2 ** (up + down))
    assert statistics.sign_test(df, ["k"], "d").first()["p"] == pytest.approx(want)
    none = spark.createDataFrame([(1, 0.0), (1, 1e-12), (1, None)], "k int, d double")
    assert math.isnan(statistics.sign_test(none, ["k"], "d").first()["p"])
    many = spark.range(100_001).selectExpr("1 AS k", "cast(id % 2 * 2 - 1 AS double) AS d")
    assert statistics.sign_test(many, ["k"], "d").first()["p"] == pytest.approx(1.0)
    lop = spark.range(40_000).selectExpr("1 AS k", "if(id % 100 < 49, 1.0D, -1.0D) AS d")
    want = 2 * sum(math.exp(math.lgamma(40_001) - math.lgamma(i + 1) - math.lgamma(40_001 - i) - 40_000 * math.log(2)) for i in range(19_601))
    assert statistics.sign_test(lop, ["k"], "d").first()["p"] == pytest.approx(want, rel=1e-6)
    w = statistics.wilcoxon(df, ["k"], "d").first()
    assert w["n"] == 8 and w["w"] == pytest.approx(sum([4, 2.5, 6, 7, 8, 2.5]))


def test_paired_tests_of_millions_of_rows(spark):
    """Both tests sum whole: terms beyond the first 100,000 carry all of p, and n cubed fits no long."""
    n, up = 2_000_000, 999_300
    df = spark.range(n).selectExpr("1 AS k", f"if(id < {up}, 1, -1) * (1 + id % 3) AS d")
    term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2))
    assert statistics.sign_test(df, ["k"], "d").first()["p"] == pytest.approx(2 * math.fsum(map(term, range(up - 20_000, up + 1))), rel=1e-6)
    d = np.arange(n)
    size = np.bincount(d % 3)
    rank = (np.cumsum(size) - size + (size + 1) / 2)[d % 3]
    w, tie = int(rank[:up].sum()), sum(int(t) ** 3 - int(t) for t in size)
    got = statistics.wilcoxon(df, ["k"], "d").first()
    assert got["n"] == n and got["w"] == pytest.approx(w, abs=1)
    assert got["z"] == pytest.approx((w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), rel=1e-6)


def test_signed_ranks_against_all_signs(spark):
    """p by trying all signs of the ranks, which is what the exact test counts."""
    from itertools import product

    d = [1.5, -2.25, 3.0, 4.5, -0.5, 6.0, 7.25]
    df = spark.createDataFrame([(1, x) for x in d] + [(2, 1.0)], "k int, d double")
    got = {r["k"]: r for r in statistics.wilcoxon(df, ["k"], "d").collect()}
    order = sorted(abs(x) for x in d)
    w = sum(order.index(abs(x)) + 1 for x in d if x > 0)
    low = min(w, 28 - w)
    n = sum(sum(r for r, up in zip(range(1, 8), signs, strict=True) if up) <= low for signs in product((0, 1), repeat=7))
    assert got[1]["w"] == w and got[1]["p"] == pytest.approx(min(1.0, 2 * n / 2**7)) and math.isnan(got[2]["p"])


def test_median_interval_is_that_of_many_rounds(spark):
    """The ends by rank against resampling with replacement."""
    import numpy as np

    r = np.random.default_rng(4)
    for n in (1, 3, 15, 41):
        x = np.sort(r.normal(size=n))
        df = spark.createDataFrame([(1, float(v)) for v in x] + [(1, None), (1, float("nan"))], "k int, v double")
        got = statistics.bootstrap_median(df, ["k"], "v", least=3).first()
        if n < 3:
            assert got["low"] is None and statistics.bootstrap_median(df, ["k"], "v").first()["low"] == x[0]
            continue
        draws = np.sort(r.choice(x, (20_000, n)), axis=1)[:, n // 2]
        low, high = np.searchsorted(x, np.percentile(draws, [2.5, 97.5]))
        assert abs(np.searchsorted(x, got["low"]) - low) <= 1 and abs(np.searchsorted(x, got["high"]) - high) <= 1


def test_ranks_and_quantiles_against_plain(spark):
    import numpy as np

    r = random.Random(3)
    rows = [(r.choice([None, 1, 2]), r.choice([0.5, 1.5, float(r.randrange(40))]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, v double, i int").repartition(5)
    got = {x["i"]: x for x in ranks.running(df.withColumn("one", F.lit(1)), ["k"], ["v", "i"], {"n": "one"}, {"after": "v"}).collect()}
    for k in (None, 1, 2):
        own = sorted((v, i) for g, v, i in rows if g == k)
        for at, (_, i) in enumerate(own):
            after = own[at + 1][0] if at + 1 < len(own) else None
            assert (got[i]["before_n"], got[i]["total_n"], got[i]["after"]) == (at, len(own), after)
        q = {x["k"]: x for x in ranks.quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}[k]
        assert [q["a"], q["b"], q["c"]] == pytest.approx(np.percentile([v for v, _ in own], [0, 37, 100]).tolist())
    assert {(x["i"], x["rank"]) for x in ranks.ranked(df, ["k"], ["v", "i"]).collect()} == {(i, x["before_n"]) for i, x in got.items()}


def test_carried_against_plain(spark):
    """Last and first known value around each row, by frames that Spark goes through once."""
    r = random.Random(6)
    rows = [(r.choice([None, 1, 2]), i, r.choice([None, None, float(i)])) for i in range(300)]
    got = ranks.carried(spark.createDataFrame(rows, "k int, i int, v double").repartition(5), ["k"], ["i"], F.col("v"))
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    for k, i, prev, after in got.select("k", "i", "__prev", "__next").collect():
        known = [v for g, _, v in rows if g == k and v is not None]
        assert (prev, after) == (max((v for v in known if v <= i), default=None), min((v for v in known if v >= i), default=None))


def test_normalised_mutual_information_keeps_polarity(spark):
    """Against the formula: entropies over 256 levels, information over 32 bins of 0 to 255."""
    import numpy as np

    r = np.random.default_rng(2)
    a = r.integers(0, 256, 900)
    b = np.clip(a + r.integers(-20, 20, 900), 0, 255)
    frame = lambda x, y: spark.createDataFrame([(1, float(p), float(q)) for p, q in zip(x, y, strict=True)] + [(1, None, 3.0), (1, float("nan"), 3.0)], "k int, a double, b double")
    got = {n: statistics.mutual_information(frame(a, y), F.col("a"), F.col("b"), ["k"]).first() for n, y in (("same", a), ("inverted", 255 - a), ("near", b), ("flat", a * 0 + 7))}
    h, _, _ = np.histogram2d(a, b, bins=32, range=[[0, 255], [0, 255]])
    p = h / h.sum()
    e = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    mi = (p[p > 0] * np.log2(p[p > 0] / e[p > 0])).sum()
    entropy = lambda x: -sum(c * math.log2(c) for c in np.bincount(x)[np.bincount(x) > 0] / len(x))
    assert got["near"]["mi"] == pytest.approx(mi)
    assert got["near"]["nmi_rho"] == pytest.approx(mi / math.sqrt(entropy(a) * entropy(b)) * (np.corrcoef(a, b)[0, 1] + 1) / 2)
    assert got["inverted"]["mi"] > 3 and abs(got["inverted"]["nmi_rho"]) < 1e-9 and 0.5 < got["same"]["nmi_rho"] < 1
    assert got["flat"]["nmi_rho"] == 0


def test_missing_measures_count_as_in_the_rules(spark):
    """NaN is larger than all numbers in Spark; it must not trip a rule, and a missing measure is 0."""
    nan = float("nan")
    rows = [(1, nan, 0.1, nan, 0.1), (2, 0.5, nan, 3.0, 1.0), (3, None, 0.1, 3.0, nan), (4, 0.5, 0.1, 3.0, 1.0), (5, float("inf"), 0.1, 3.0, None)]
    df = spark.createDataFrame(rows, "id int, pct_highlight_saturated double, baseline_pct_highlight_saturated double, noise_proxy double, baseline_noise_proxy double").withColumn("mask_area_ratio", F.when(F.col("id") == 1, F.lit(nan)).otherwise(F.lit(0.5)))
    got = {(r["id"], r["failure_type"]) for r in validation.failure_cases(df, ["id"]).collect()}
    assert got == {(4, "clipping_increase"), (4, "noise_increase"), (2, "noise_increase")}
    names = ("mean", "std", "p95", "glare", "dark", "sharpness", "saturation")
    cases = [((80.0, 50.0, nan, 0.0, 0.1, 300.0, 20.0), "normal_day"), ((80.0, 50.0, None, None, None, 300.0, 20.0), "normal_day"), ((50.0, 10.0, 100.0, 0.0, 0.1, None, 20.0), "fog"), ((nan,) * 7, "unknown_or_out_of_scope"), ((None,) * 7, "normal_night"), ((nan, nan, 250.0, nan, nan, nan, nan), "glare")]
    frame = spark.createDataFrame([(*c, i) for i, (c, _) in enumerate(cases)], ", ".join(f"{n} double" for n in names) + ", i int")
    got = {r["i"]: r["h"] for r in frame.select("i", rules.heuristic_label(*[F.col(n) for n in names], F.lit("x")).alias("h")).collect()}
    assert [got[i]["label"] for i in range(len(cases))] == [want for _, want in cases] and got[5]["confidence"] == 0.78


def test_null_keys_are_one_key(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), (1, 1, 3.0), (None, 3, 6.0)], "k int, i int, v double")
    got = {(r["k"], r["i"]): r["e"] for r in ordered.fold(df, ["k"], ["i"], ["v"], lambda: ordered.Ema(0.5), "e", "double").collect()}
    assert got == {(None, 1): 2.0, (None, 2): 3.0, (None, 3): 4.5, (1, 1): 3.0}


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.3,), (0.30000000000000004,), (1.0,), (0.0,)], "p double").select(statistics.bin_of(F.col("p")).alias("b"))
    assert [r["b"] for r in df.collect()] == [2, 3, 9, 0]


def test_failures_and_validation(spark):
    df = spark.createDataFrame([(1, -0.1, 0.9, "alignment failed"), (2, 0.2, 0.5, "ok"), (3, None, 0.0005, None)], "id int, foreground_contrast_gain double, mask_area_ratio double, alignment_status string")
    got = {(r["id"], r["failure_type"]) for r in validation.failure_cases(df, ["id"]).collect()}
    assert got == {(1, "fusion_target_faded"), (1, "mask_wrong_region"), (1, "alignment_drift"), (3, "mask_wrong_region")}
    bad = spark.createDataFrame([(1, float("nan"), "nir"), (2, 1.0, None)], "id int, nir_std double, nir_channel string")
    assert {(r["id"], r["error"]) for r in validation.errors(bad, "id").collect()} == {(1, "nir_std is not finite"), (2, "invalid nir_channel")}


def test_forest_learns_and_predicts(spark):
    r = np.random.default_rng(0)
    rows = [(int(i), float(x), float(y), "a" if x + y > 0 else "b") for i, (x, y) in enumerate(r.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id int, x1 double, x2 double, label string")
    model = learning.train(df, ["x1", "x2"], "label", learning.classifiers()["tree"])
    got = learning.predict_top2(model, df, ["id", "label"]).collect()
    assert sum(g["top1_label"] == g["label"] for g in got) > 270 and all(g["top1_proba"] >= g["top2_proba"] for g in got)


def test_models_are_compared(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), float(x), float(y), "a" if x > 0 else "b") for i, (x, y) in enumerate(r.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "id int, x1 double, x2 double, label string")
    got = {(g["classifier"], g["features"]): g["accuracy"] for g in learning.compare(df, df, {"both": ["x1", "x2"], "second": ["x2"]}, "label", ["tree", "logistic"]).collect()}
    assert len(got) == 4 and got["tree", "both"] > 0.95 > got["logistic", "second"]
    from pyspark.ml.classification import RandomForestClassifier

    model = learning.train(df, ["x1", "x2"], "label", RandomForestClassifier(numTrees=4, maxDepth=3, labelCol="y", featuresCol="x", seed=1))
    v = [x["variance"] for x in learning.tree_variance(model, df, "id").collect()]
    assert len(v) == 200 and max(v) > 0 and min(v) >= 0
