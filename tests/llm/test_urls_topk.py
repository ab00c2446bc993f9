import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import topk, urls


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


URLS = [
    "http://www.Example.com/en/7817?x=1", "https://example.com/en/1", "http://a.com/en/", "http://notexample.com/en/7", "https://b.net/de/1#t", "http://x.example.net/de/81", "http://x.example.net/de/9",
    "http://q.org/es/3", "http://q.org/fr/3", "http://com/en/7", "ftp://net?de/", "nonsense", "", None, "://", "http://É.org/es/", "http://a.b.c.d.com/en/x", "http://example.com", "http://u:p@h.com:80/en/",
]


def test_urls_against_plain(spark):
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(URLS * 3)], "page_id long, url string, host string")
    got = urls.judge_urls(pages).collect()
    assert len(got) == 3 * len(URLS)
    for r in got:
        host, path = split((URLS * 3)[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            assert (r["rule"], r["verdict"]) == max(fits)[1:]
        else:
            assert r["rule"] is None and r["verdict"] in ("allow", "block")


def test_language_models_tell_urls_apart(spark):
    r = random.Random(1)
    name = lambda a: "".join(r.choice(a) for _ in range(8))
    good, bad = ([f"{name(a)}.org/{name(a)}" for _ in range(300)] for a in ("abcdef", "uvwxyz"))
    rows = [(u, True) for u in good[:250]] + [(u, False) for u in bad[:250]]
    m = urls.train(spark.createDataFrame(rows, "url string, accepted boolean"))
    assert (m.difference([u.encode() for u in good[250:]]) >= m.threshold).all()
    assert (m.difference([u.encode() for u in bad[250:]]) < m.threshold).all()


def test_difference_against_plain():
    """With buckets enough for no two contexts to meet, the models are plain counts."""
    text, order, buckets = [b"abcab", b"bca"], 2, 2**20
    table = np.zeros(4 * (order + 1) * buckets)
    of, ctx, both = urls.contexts(text, order, buckets)
    np.add.at(table, urls._cells(np.array([1, 1])[of], ctx, both, order, buckets), 1)
    c, b = Counter(), Counter()
    padded = [b"\x02" * order + t + b"\x03" for t in text]
    for t in padded:
        for i in range(order, len(t)):
            for k in range(order + 1):
                c[t[i - k : i]] += 1
                b[t[i - k : i], t[i]] += 1
    for t, d in zip(padded, urls.LanguageModels(table, order, buckets).difference(text), strict=True):
        logs = 0.0
        for i in range(order, len(t)):
            p = 1 / 256
            for k in range(order + 1):
                p = (b[t[i - k : i], t[i]] + urls.STRENGTH * p) / (c[t[i - k : i]] + urls.STRENGTH)
            logs += math.log(p) - math.log(1 / 256)
        assert d == pytest.approx(logs / (len(t) - order))


def test_trained_models_against_plain_counts(spark):
    """More contexts than any fixed table had places; counts and differences are those of plain dicts."""
    r = random.Random(5)
    taught = [("".join(r.choice("abcdefghijklmnop./") for _ in range(30)), bool(i % 2)) for i in range(4000)]
    models = urls.train(spark.createDataFrame(taught, "url string, accepted boolean").repartition(3))
    c, b = Counter(), Counter()
    for u, side in taught:
        if zlib.crc32(u.encode()) % 5:
            t = b"\x02" * 5 + u.encode() + b"\x03"
            for i in range(5, len(t)):
                for k in range(6):
                    c[side, t[i - k : i]] += 1
                    b[side, t[i - k : i], t[i]] += 1
    assert len({x[1:] for x in c} | {x[1:] for x in b}) > 2**17
    assert models.counts.count() == len({x[1:] for x in c}) + len({x[1:] for x in b})
    for u, d in zip([u for u, _ in taught[:20]], models.difference([u.encode() for u, _ in taught[:20]]), strict=True):
        t, logs = b"\x02" * 5 + u.encode() + b"\x03", [0.0, 0.0]
        for i in range(5, len(t)):
            for side in (False, True):
                p = 1 / 256
                for k in range(6):
                    p = (b[side, t[i - k : i], t[i]] + urls.STRENGTH * p) / (c[side, t[i - k : i]] + urls.STRENGTH)
                logs[side] += math.log(p)
        assert d == pytest.approx((logs[1] - logs[0]) / (len(t) - 5))


def test_urls_empty_and_null(spark):
    kind = "page_id long, url string"
    assert urls.judge_urls(spark.createDataFrame([], kind)).count() == 0
    got = urls.judge_urls(spark.createDataFrame([(None, None), (None, None), (1, "http://x.io/" + "y" * 50_000)], kind)).collect()
    assert len(got) == 3 and all(r["verdict"] == "allow" for r in got if r["host"] == "")


def plain_topk(rows, k):
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in whole.items() if i != q and len(w) == len(whole[q]))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize(("node", "block", "held"), [(4096, 1024, 32_000_000), (16, 3, 200)])
def test_topk_against_plain(spark, monkeypatch, node, block, held):
    monkeypatch.setattr(topk, "NODE", node)
    monkeypatch.setattr(topk, "HELD", held)
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", block)
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.float32(r.normal(0, 0.3, 8))]) for i in range(150)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)] + [(500, [1.0, 2.0]), (520, [3.0, -1.0]), (540, [1e7] * 8), (560, [2e7, -1.0] * 4), (561, [2e7, 3.0] * 4)]
    rows += [(200, None), (220, [None] * 8), (240, [float("nan")] * 8), (260, [float("inf")] + [0.0] * 7), (280, []), (None, [0.1] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(4)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0).collect()
    assert {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got} == plain_topk(rows, 20)


def test_topk_of_floats_and_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [0.5])], kind), F.col("vec_id") % 20 == 0).count() == 0
    twice = topk.top_k(spark.createDataFrame([(0, [0.5]), (0, [0.5]), (3, [0.25]), (3, [0.25])], kind), F.col("vec_id") % 20 == 0).collect()
    assert all(r["vec_id"] == 3 and r["score"] == 32 * 16 for r in twice)


def test_topk_beyond_64_bits_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e20, 1.0]), (1, [2.0, 1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(df, F.col("vec_id") % 20 == 0).collect()
