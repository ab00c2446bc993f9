"""Document operators against plain versions, with the odd cases of data.py in every table."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.llm import classifier, lines, mixing, near, packing, quality, sharding, substrings

from . import data

TOKENS = packing.Tokens("word_bpe_49k.json")
WORDS = lambda t: (t or "").encode().split()


@pytest.fixture(scope="module")
def docs(spark):
    return data.frame(spark).cache()


@pytest.fixture(scope="module")
def plain():
    return data.rows()


# ---- quality ----


def test_quality_against_plain(spark, docs, plain):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    for row in plain:
        text = row[1] or ""
        w, r = WORDS(text), got[row[0]]
        marked = [False] * len(w)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        for i in range(len(w) - 2):
            if windows[tuple(w[i : i + 3])] > 1:
                marked[i : i + 3] = [True] * 3
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        assert (r["__n_words"], r["__n_repeat_words"], r["__n_dup_lines"]) == (len(w), sum(marked), dup)
        assert r["__word_chars"] == sum(len(x.decode()) for x in w)
        assert r["__base_failed"] == (len(w) < 50 or 100 * sum(marked) > 50 * len(w))
        assert r["size"] == 7 and r["h1"] == "clash"


def test_repetition_limits_decide(spark):
    import random

    r = random.Random(2)
    block = " ".join(data.words(r, 60, 10**6))
    clean = " ".join(data.words(r, 300, 10**6))
    rows = [(1, clean), (2, f"{block} {clean} {block}"), (3, f"{block} {block} " + " ".join(data.words(r, 150, 10**6)))]
    got = {x["doc_id"]: x for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["__longest_repeat"] for k in (1, 2, 3)] == [0, 60, 60]
    assert [got[k]["__covered_words"] for k in (1, 2, 3)] == [0, 120, 120]
    assert [got[k]["__kept"] for k in (1, 2, 3)] == [True, True, False]


# ---- lines ----


def plain_lines(rows, least=10):
    key = lambda x: x.encode().strip().lower().decode()
    holders = defaultdict(set)
    for row in rows:
        for line in (row[1] or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(row[0])
    out = {}
    for row in rows:
        parts = (row[1] or "").split("\n")
        kept = [x for x in parts if len(holders[key(x)]) < 2 or min(holders[key(x)]) == row[0]]
        out[row[0]] = (len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("shard_keys", [200_000, 1])
def test_lines_against_plain(spark, docs, plain, shard_keys):
    got = {r["doc_id"]: (r["__n_lines"], r["__n_dropped"], r["__sha"]) for r in lines.drop_repeated_lines(docs, shard_keys=shard_keys).collect()}
    assert got == plain_lines(plain)
    assert sum(x[1] for x in got.values()) > 10


def test_perfect_hash_round_trip():
    import numpy as np

    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    for h in (f := lines.PerfectHash(keys), lines.PerfectHash.load(f.dump())):
        assert sorted(h(keys).tolist()) == list(range(5000))
    assert lines.PerfectHash(keys[:0]).dump()


def test_lines_with_equal_first_hash_halves():
    import numpy as np

    shard = lines.Shard(lines.packed(np.array([5, 5, 9]), np.array([1, 2, 3]), np.array([2, 4, 2]), np.array([10, 20, 30])))
    count, first = shard.find(np.array([5, 5, 9, 9, 7]), np.array([1, 2, 3, 4, 1]))
    assert first.tolist() == [10, 20, 30, 2**63 - 1, 2**63 - 1] and count.tolist() == [2, 4, 2, 0, 0]
    none = np.empty(0, np.int64)
    assert lines.Shard(lines.packed(none, none, none, none)).find(np.array([5]), np.array([1]))[0].tolist() == [0]


def test_common_lines_are_decided_where_they_are_read(spark, docs, plain, monkeypatch):
    monkeypatch.setattr(lines, "COMMON", 3)
    got = {r["doc_id"]: (r["__n_lines"], r["__n_dropped"], r["__sha"]) for r in lines.drop_repeated_lines(docs).collect()}
    assert got == plain_lines(plain)


def test_lines_of_least_documents_and_shared_ids(spark):
    a, b, c = "a line of three rows", "a line of two rows only", "one more line, of one id"
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\n{c}"), (2, f"{c}\n{c}"), (3, f"{b}\n{a}"), (None, c), (None, f"{a}\nnone"), (None, f"{a}\nnone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for documents, gone in ((2, [0, 0, 1, 1, 1, 1, 2]), (3, [0, 0, 1, 1, 1, 1, 1])):
        got = lines.drop_repeated_lines(df, documents=documents).collect()
        assert sorted(r["__n_dropped"] for r in got) == sorted(gone), documents
        assert all(r["text"] == "" for r in got if r["doc_id"] is None and r["__n_lines"] == 1)


# ---- near duplicates ----


def plain_near(rows, percent):
    sets = {}
    for row in rows:
        w = WORDS("".join(c.lower() if "A" <= c <= "Z" else c for c in row[1] or ""))
        sets[row[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    top[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("percent", [80, 85, 93])
def test_near_against_plain(spark, docs, plain, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(docs, percent=percent).collect()}
    assert got == plain_near(plain, percent)


def test_near_of_shared_and_missing_ids(spark):
    """Texts of one id, and texts without one, are linked each by its own words."""
    import random

    r = random.Random(8)
    a, b, c = (data.words(r, 80, 10**6) for _ in range(3))
    near_of = lambda w, i: " ".join([*w[:40], f"z{i}", *w[41:]])
    rows = [(3, " ".join(a)), (3, " ".join(b)), (5, near_of(a, 1)), (2, near_of(b, 2)), (None, near_of(a, 3)), (None, " ".join(c)), (None, near_of(c, 4)), (None, " ".join(c)), (None, "")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or 99, x["component_id"] or 99) for x in got) == [(2, 2), (3, 2), (3, 3), (5, 3), (99, 3), (99, 99), (99, 99), (99, 99), (99, 99)]
    assert len({x["component_version"] for x in got if x["component_id"] is None and x["n_shingles"]}) == 1


def test_near_group_around_the_threshold(spark, monkeypatch):
    """Hubs settle only part of such a group; blocks must find the other links."""
    import random

    r = random.Random(5)
    base = data.words(r, 120, 10**6)
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.choice([2, 3, 4])):
            w[r.randrange(120)] = f"y{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "CHUNK", 64)
    got = {x["doc_id"]: x["component_id"] for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    want = {k: v[1] for k, v in plain_near(rows, 80).items()}
    assert got == want and 1 < len(set(want.values())) < 120


# ---- substrings ----


def plain_substrings(rows, window=50):
    w = {row[0]: WORDS(row[1]) for row in rows}
    first = {}
    for i in sorted(w):
        for k in range(len(w[i]) - window + 1):
            first.setdefault(tuple(w[i][k : k + window]), i)
    out = {}
    for i, x in w.items():
        gone = [False] * len(x)
        for k in range(len(x) - window + 1):
            if first[tuple(x[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(a for a, g in zip(x, gone, strict=True) if not g)
        out[i] = (len(x), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, substrings.BATCHES, 6])
def test_substrings_against_plain(spark, docs, plain, batches):
    got = {r["doc_id"]: (r["__n_words"], r["__n_removed"], r["__sha"]) for r in substrings.drop_repeated_windows(docs, batches=batches).collect()}
    assert got == plain_substrings(plain)
    assert sum(x[1] for x in got.values()) > 500


def test_index_compacts_and_takes_later_documents(spark, docs, plain):
    """What came before is known from the index; its documents are not given again."""
    index = substrings.FingerprintIndex(spark, fanout=1)
    got, runs = {}, []
    for low, high in ((0, 60), (60, 120), (120, 10_000)):
        for r in substrings.drop_repeated_windows(docs.where(f"doc_id >= {low} and doc_id < {high}"), batches=1, index=index).collect():
            got[r["doc_id"]] = (r["__n_words"], r["__n_removed"], r["__sha"])
        runs.append((len(index.anchors.names), len(index.windows.names)))
    assert got == plain_substrings(plain)
    assert index.anchors.made > 3 and all(max(r) == 1 for r in runs)
    index.close()


@pytest.mark.parametrize("name", ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.enabled"])
def test_a_run_is_one_file_for_each_bucket(spark, name):
    """Each file of a local folder costs its writer a chmod process, and one for its checksum."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set(name, "false")
        spark.conf.set("spark.sql.shuffle.partitions", 12)
        runs = substrings.SortedRuns(spark, ["hash"], {"first": F.min}, 2)
        runs.expect(5 * substrings.ROWS_A_BUCKET)
        run = runs.write(spark.range(2000).groupBy(F.xxhash64(F.col("id") % 1000).alias("hash")).agg(F.min("id").alias("first")))
        runs.add(run)
        files = [r["f"] for r in spark.table(run).select(F.input_file_name().alias("f")).distinct().collect()]
        assert (runs.buckets, len(files)) == (5, 5)
        assert sorted(r["first"] for r in spark.table(run).collect()) == list(range(1000))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "12"
        runs.close()
    finally:
        spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_substrings_of_shared_ids(spark):
    import random

    r = random.Random(9)
    a, b, c = (" ".join(data.words(r, 60, 10**6)) for _ in range(3))
    rows = [(1, a), (2, f"{b} {a}"), (2, f"{b} x"), (3, f"{c} {b}"), (None, c), (None, f"y {c}"), (None, f"y {c}")]
    got = substrings.drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 99, r["__n_words"], r["__n_removed"]) for r in got) == [(1, 60, 0), (2, 61, 0), (2, 120, 60), (3, 120, 60), (99, 60, 60), (99, 61, 60), (99, 61, 60)]


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=14), max_size=8), st.integers(1, 4))
@settings(max_examples=5, deadline=None)
def test_substrings_of_few_words(spark, texts, batches):
    """Words that repeat everywhere: blocks, anchors and windows in all mixtures."""
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = substrings.drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), window=4, anchor=2, batches=batches).collect()
    assert {r["doc_id"]: (r["__n_words"], r["__n_removed"], r["__sha"]) for r in got} == plain_substrings(rows, 4)


# ---- mixing ----


def test_mix(spark, docs, plain):
    got = mixing.copies_of(docs).collect()
    assert len(got) == len(plain)
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in mixing.copies_of(docs.repartition(5)).collect())
    size = Counter()
    for row in plain:
        size[row[3]] += len(WORDS(row[1]))
    taken, largest, target = Counter(), Counter(), {}
    for r in got:
        assert r["source_size"] == size[r["source"]] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    share, left, full = {}, 1.5 * sum(size.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        w = {s: (5, 2, 1)[order.index(s) % 3] for s in rest}
        new = {s: left * w[s] / sum(w.values()) for s in rest}
        over = {s for s in rest if new[s] > 2 * size[s]}
        if not over:
            share |= new
            break
        for s in over:
            share[s] = 2 * size[s]
            left -= 2 * size[s]
        full |= over
    assert {s: pytest.approx(v) for s, v in share.items()} == target


def test_mix_emits_rows(spark, docs):
    out = mixing.mix_sources(docs)
    assert out.columns == docs.columns
    want = {r["doc_id"]: r["copies"] for r in mixing.copies_of(docs).collect()}
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in want.items() if v})


# ---- packing ----


def test_pack(spark, docs, plain):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(docs, keep_ids=True).collect()
    by = {(r["doc_id"], r["piece"]): r for r in got}
    n, total, sequences = 0, 0, defaultdict(list)
    for row in plain:
        ids = np.array([*tok.encode(row[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part, r = ids[at : at + 2048], by[row[0], k]
            assert (r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) == (at, len(part), zlib.crc32(part.tobytes()), part.tobytes())
            n, total = n + 1, total + len(part)
    assert n == len(got)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 1


@pytest.mark.parametrize("text", ["don't 's' it'S", "a<|endoftext|>. <|startoftext|>b", "ÀÉÎ.. é. ́x", "ΑΣ. ΑΣ", "x1.2,3!?", "İI ǅ.", "中文。 mixed中文.", " a b.", "½. ²! ٣;"])
def test_tokens_of_odd_texts(text):
    import numpy as np

    t = packing.Tokens("word_bpe_49k.json")
    whole = t.of.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(t(text.encode()), "<u4").tolist() == whole


@given(st.text("aBcDéÉßñ ẖH\u0331\u030c\u0301.,!?'sTd<|>12½…中\n\t\u00a0#Σσİ", max_size=30))
@settings(max_examples=400, deadline=None)
def test_tokens_of_any_text(text):
    import numpy as np

    t = TOKENS
    assert np.frombuffer(t(text.encode()), "<u4").tolist() == t.of.encode(text, add_special_tokens=False).ids


def test_tokens_of_all_plain_letters():
    import numpy as np

    t = packing.Tokens("word_bpe_49k.json")
    for c in map(chr, range(33, 0x260)):
        for text in (c, f"a{c}B", f"{c}{c}th."):
            assert np.frombuffer(t(text.encode()), "<u4").tolist() == t.of.encode(text, add_special_tokens=False).ids, text


def test_known_tokens_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_BYTES", 20_000)
    t = packing.Tokens("word_bpe_49k.json")
    for i in range(2000):
        t(b"w%d" % i)
        t(b"x" * 5000 + b"%d" % i)
    assert max(map(len, [*t, *t.before])) <= packing.LONGEST
    assert all(sum(len(k) + len(v) + 160 for k, v in d.items()) <= 20_400 for d in (t, t.before))


def test_genetic_packing_keeps_all_and_gains(spark):
    import random

    r = random.Random(3)
    counts = dict(Counter(r.randint(400, 1000) for _ in range(3000)))
    first = packing.best_fit(counts, 2048)
    last = packing.pack_lengths(spark, counts, islands=2, epochs=2, children=12)
    held = Counter()
    for p, n in last.items():
        assert sum(p) <= 2048
        for x in p:
            held[x] += n
    assert held == Counter(counts)
    assert packing.lower_bound(counts, 2048) <= sum(last.values()) < sum(first.values())


# ---- sharding ----


def test_shards(spark, docs, plain):
    got = sharding.assign_shards(docs, 7).collect()
    rows = Counter(r["shard"] for r in got)
    assert max(rows.values()) - min(rows.values()) <= 1 and len(got) == len(plain)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {row[0]: (row[1] or "").encode() for row in plain}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 16, zlib.crc32(text[r["doc_id"]])) for r in got)


def test_ring_spans_follow_the_keys():
    """Against keys placed one by one: own shards first, then overflow clockwise."""
    import random

    r = random.Random(4)
    owner = [r.randrange(5) for _ in range(30)]
    counts = [r.randrange(20) for _ in range(30)]
    caps = sharding.capacities(sum(counts), 5)
    load, place, over = [0] * 5, {}, []
    for arc, n in enumerate(counts):
        for k in range(n):
            if load[owner[arc]] < caps[owner[arc]]:
                load[owner[arc]] += 1
                place[arc, k] = owner[arc]
            else:
                over.append((arc, k))
    for arc, k in over:
        node = arc
        while load[owner[node]] >= caps[owner[node]]:
            node = (node + 1) % 30
        load[owner[node]] += 1
        place[arc, k] = owner[node]
    got = {}
    took = sharding.spans(counts, owner, caps)
    for i, (arc, first, shard, _) in enumerate(took):
        end = took[i + 1][1] if i + 1 < len(took) and took[i + 1][0] == arc else counts[arc]
        got |= {(arc, k): shard for k in range(first, end)}
    assert got == place


def test_slack_limits_movement(spark, docs):
    move = lambda slack: sum(a["shard"] != b["shard"] for a, b in zip(*[sharding.assign_shards(docs, n, slack=slack).orderBy("doc_id").collect() for n in (6, 7)], strict=True))
    assert move(2.0) <= 0.4 * docs.count()


# ---- classifier ----


def test_classifier_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = classifier.score_documents(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    pos, neg = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert sum(a > b for a in pos for b in neg) >= 0.95 * len(pos) * len(neg)


def plain_statistics(text):
    import math

    b = (text or "").encode()
    if not b:
        return [0.0] * len(classifier.STATISTICS)
    w, rows = b.split(), [x for x in b.split(b"\n") if x.strip()]
    n, m = max(1, len(w)), max(1, len(rows))
    times = Counter(b)
    shares = [sum(v for k, v in times.items() if f(k)) / len(b) for f in (
        lambda k: 65 <= k <= 90, lambda k: 97 <= k <= 122, lambda k: 48 <= k <= 57, lambda k: k == 32, lambda k: k == 10, lambda k: k == 46, lambda k: k == 44,
        lambda k: k in b"!?", lambda k: k in b"#*$%&|<>", lambda k: k == 124, lambda k: k in b"()[]{}", lambda k: k >= 128,
    )]
    return [
        math.log(1 + len(w)), len(b) / n, len(set(w)) / n, sum(x == y for x, y in zip(w, w[1:])) / n, math.log(1 + len(rows)), math.log(1 + len(w) / m),
        1 - len(set(rows)) / m, sum(len(x) < 30 for x in rows) / m, -sum(v / len(b) * math.log2(v / len(b)) for v in times.values()), *shares,
    ]


def test_classifier_against_plain(spark):
    import numpy as np

    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    odd = [(10**9 + k, t) for k, t in enumerate([None, "", " \n", "É!", "#" * 5000])]
    docs = docs.select("doc_id", "text").unionAll(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [(r["doc_id"], plain_statistics(r["text"])) for r in docs.collect()]
    known = {}
    for r in labels.collect():
        if r["quality"] in (0, 1):
            known[r["doc_id"]] = max(r["quality"], known.get(r["doc_id"], 0))
    part = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    taught = [(i, x) for i, x in rows if i in known and part[i]]
    x = np.array([x for _, x in taught])
    mean, scale = x.mean(0), x.std(0)
    scale[scale <= 1e-9] = 1
    rng = np.random.default_rng(7)
    turn, shift = rng.normal(0, 1 / classifier.WIDTH, (x.shape[1], classifier.FEATURES)), rng.uniform(0, 2 * np.pi, classifier.FEATURES)

    def lift(x):
        z = np.clip((np.array(x) - mean) / scale, -6, 6)
        return np.array([*(np.sqrt(2 / classifier.FEATURES) * np.cos(z @ turn + shift)), *(z / 6), 1.0])

    fit = [(lift(x), known[i]) for i, x in taught if part[i] > 1]
    z, y = np.array([a for a, _ in fit]), np.array([b for _, b in fit], float)
    ridge = classifier.RIDGE * len(z) / z.shape[1]
    # ridge regression as least squares with a row for each weight
    weights = np.linalg.lstsq(np.vstack([z, np.sqrt(ridge) * np.eye(z.shape[1])]), np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    low, high = classifier.LOWEST, classifier.HIGHEST
    raw = {i: float(np.clip(lift(x) @ weights, low, high)) for i, x in rows}
    bins = defaultdict(list)
    for i, _ in taught:
        if part[i] == 1:
            bins[min(int((raw[i] - low) / (high - low) * classifier.BINS), classifier.BINS - 1)].append(known[i])
    blocks = [[(low + (k + 0.5) / classifier.BINS * (high - low), v) for v in bins[k]] for k in sorted(bins)]
    value = lambda block: sum(v for _, v in block) / len(block)
    while any(value(a) >= value(b) for a, b in zip(blocks, blocks[1:])):
        k = next(k for k in range(len(blocks) - 1) if value(blocks[k]) >= value(blocks[k + 1]))
        blocks[k : k + 2] = [blocks[k] + blocks[k + 1]]
    xs, ys = [sum(c for c, _ in b) / len(b) for b in blocks], [value(b) for b in blocks]
    got = {r["doc_id"]: r for r in classifier.score_documents(docs, labels).collect()}
    assert len(got) == len(rows) and len(fit) > 20 and len(blocks) > 1
    for i, _ in rows:
        want = 0.999 * np.interp(raw[i], xs, ys) + 0.001 * (raw[i] - low) / (high - low)
        assert got[i]["score"] == pytest.approx(want, abs=1e-5), i
        assert got[i]["held_out"] == (part[i] == 0) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_isotonic_curve_rises():
    import numpy as np

    x, y = classifier.isotonic(np.arange(6.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.8]), np.ones(6))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and y[1] == pytest.approx(1.1 / 3)


# ---- odd tables, for all of them ----

OPERATORS = {
    "quality": quality.quality_rules, "lines": lines.drop_repeated_lines, "near": near.near_duplicates, "substrings": substrings.drop_repeated_windows,
    "copies": mixing.copies_of, "mix": mixing.mix_sources, "pack": packing.pack_documents, "shards": sharding.assign_shards,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](data.empty(spark)).count() == 0


@pytest.mark.parametrize("name", [k for k in OPERATORS if k != "mix"])
def test_null_ids_and_repeated_rows(spark, name):
    row = (5, "one two three four five six seven eight nine ten " * 12, "en", "src0", 1, 7, "clash", 1)
    more = [row, row, (None, *row[1:]), (None, None, None, None, None, None, None, None)]
    got = OPERATORS[name](data.frame(spark, n=5, more=more)).collect()
    if name == "pack":
        assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    else:
        assert len(got) == len(data.rows(n=5)) + 4


def test_repeated_rows_mix(spark):
    row = (5, "one two three", "en", "src0", 1, 7, "clash", 1)
    out = mixing.mix_sources(data.frame(spark, n=5, more=[row, row])).where("doc_id = 5").count()
    assert 0 <= out <= 4


@pytest.mark.parametrize("share", [0.3, 1.5])
def test_mix_of_equal_rows_and_rows_without_id(spark, share):
    rows = [(5, "one two three", "big")] * 400 + [(None, f"one two t{i}", "big") for i in range(400)] + [(5, f"one two u{i}", "big") for i in range(50)]
    docs = spark.createDataFrame([*rows, (1, "four words are here", "a"), (2, None, "b")], "doc_id long, text string, source string").repartition(3)
    target = {r["source"]: r["target"] for r in mixing.copies_of(docs, share=share).collect()}
    got = mixing.mix_sources(docs, share=share).collect()
    taken = sum(len(WORDS(r["text"])) for r in got if r["source"] == "big")
    assert abs(taken - target["big"]) <= 3
    low, high = int(target["big"] / 2550), int(target["big"] / 2550) + 1
    times = Counter((r["doc_id"], r["text"]) for r in got)
    for key, n in Counter(r[:2] for r in rows).items():
        assert (times[key] in (low, high)) if n == 1 else abs(times[key] - n * target["big"] / 2550) <= 2


def test_classifier_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert classifier.score_documents(data.empty(spark), labels).count() == 0
    got = classifier.score_documents(data.frame(spark, n=5), labels).collect()
    assert len(got) == len(data.rows(n=5)) and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(0, 1), (None, 0), (3, None), (6, 7), (9, 0), (9, 1)], "doc_id long, quality int")
    assert classifier.score_documents(data.frame(spark, n=5, more=[(None, "x", None, None, None, None, None, None)]), odd).count() == len(data.rows(n=5)) + 1
