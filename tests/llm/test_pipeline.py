"""The stages against plain versions, each on what its predecessor kept."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framewright.llm import quality

from . import data
from .test_documents import WORDS, plain_lines, plain_near


def repeated(words, n):
    """Places of words in runs of n words that are found twice or more."""
    runs = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return {k for i in range(len(words) - n + 1) if runs[tuple(words[i : i + n])] > 1 for k in range(i, i + n)}


def longest(words):
    low, high = 0, len(words)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if repeated(words, mid) else (low, mid - 1)
    return low


def plain_quality(rows):
    for row in rows:
        w = WORDS(row[1])
        if len(w) >= 50 and 100 * len(repeated(w, 3)) <= 50 * len(w):
            if len(repeated(w, quality.MIN_REPEAT)) <= quality.MOST_COVERED * len(w) and longest(w) <= quality.MOST_LONGEST:
                yield row


def plain_line_texts(rows):
    key = lambda x: x.encode().strip().lower().decode()
    holders = defaultdict(set)
    for row in rows:
        for line in row[1].split("\n"):
            holders[key(line)].add(row[0])
    for i, text, source in rows:
        yield i, "\n".join(x for x in text.split("\n") if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i), source


def plain_mix(rows):
    size = Counter()
    for row in rows:
        size[row[2]] += len(WORDS(row[1]))
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, target = 1.5 * sum(size.values()), list(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s], left = 2 * size[s], left - 2 * size[s]
        free = [s for s in free if s not in over]
    for s in order:
        offset = int(hashlib.md5(("0:null" if s is None else f"0:s{s}").encode()).hexdigest()[:4], 16) % 1024 / 1024
        rate = target[s] / size[s]
        for k, row in enumerate(sorted((r for r in rows if r[2] == s), key=lambda r: (len(WORDS(r[1])), r[0]))):
            yield from [row] * (math.floor((k + 1) * rate + offset) - math.floor(k * rate + offset))


def test_run_against_plain(spark, tmp_path):
    more = [(2000 + i, " ".join(data.words(random.Random(i), 2500, 3000)), "en", s, 0, 7, "clash", 1) for i, s in enumerate(["src0", None, "src2"])]
    data.frame(spark, more=more).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r[0], r[1], r[3]) for r in [*data.rows(), *more]]
    fine = list(plain_quality(rows))
    assert 0 < len(fine) < len(rows)
    rows = list(plain_line_texts(fine))
    first = plain_near(rows, 80)
    rows = [r for r in rows if first[r[0]][2] or not first[r[0]][0]]
    assert 0 < len(rows) < len(fine)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text, _ in plain_mix(rows):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[i, at // 2048, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(s)])]
        assert [at for at, _ in sorted(s)] == ends[:-1] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(k[3] * n for k, n in want.items()) // 2048) + 1


def test_stages(spark, tmp_path):
    docs = data.frame(spark, n=60).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    state = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, state, str(tmp_path))
        assert out.columns == docs.columns
        before = [(r["doc_id"], r["text"]) for r in state.collect()]
        out.write.parquet(f"{tmp_path}/{name}")
        state = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [(r["doc_id"], r["text"], r["n_chars"]) for r in state.collect()]
        if name == "lines":
            assert {i: t.count("\n") + 1 for i, t, _ in kept[name]} == {i: max(1, a - b) for i, (a, b, _) in plain_lines(before).items()}
            assert all(len(t) == n for _, t, n in kept[name])
        if name == "near":
            assert sorted(i for i, _, _ in kept[name]) == sorted(i for i, v in plain_near(before, 80).items() if v[2])
    assert 0 < len(kept["near"]) < len(kept["lines"]) == len(kept["quality"])
    assert max(Counter(i for i, _, _ in kept["mix"]).values()) <= 2
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"]) for r in whole).keys() == Counter((r["doc_id"], r["piece"]) for r in corpus_pipeline.pack(spark, state, "").collect()).keys()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, data.empty(spark), "").count() == 0
    text = "some words that are long enough for the rules to keep them " + " ".join(f"z{i}" for i in range(80))
    row = (7, text, "en", "src0", 1, 7, "clash", 1)
    docs = data.frame(spark, n=8, more=[row, row, (None, *row[1:]), (None,) * 8])
    out = stage(spark, docs, "")
    got = out.collect()
    if name != "pack":
        assert out.columns == docs.columns
    if name == "near":
        assert [r["doc_id"] for r in got if r["text"] == text] == [7] and sum(r["doc_id"] is None for r in got) == 1
    if name == "quality":
        assert sum(r["text"] == text for r in got) == 3 and all(r["text"] for r in got)
    assert got
