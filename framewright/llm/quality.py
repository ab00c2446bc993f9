"""Quality rules: word counts and repetition found by suffix arrays."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, text_slices

WHITE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Words of a repeat that counts; most of a text's words under such repeats; words of the longest one.
MIN_REPEAT, MOST_COVERED, MOST_LONGEST = 10, 0.30, 400
#: The base rules: words at least, and most per cent of words in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _starts(changed: np.ndarray) -> np.ndarray:
    """For each place, the first place of its run, given where runs begin."""
    return np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))


def repeats(words: np.ndarray, base: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Per place of `words`: whether a run of `base` words that begins here occurs twice or more,
    and the longest run from here that occurs twice or more (0 if under `base`).

    words holds numbers from 0 on; texts that must not match have numbers of their own. Suffixes
    are sorted by their first `base` words, then groups of equal ones by twice as many, as long
    as there are any; places that are alone are not touched again. The ranks of each length are
    kept, and give the common prefix of neighbours in the sorted order by halving steps.
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < base:
        return np.zeros(n, bool), best
    padded = np.concatenate([words.astype(np.int64) + 1, np.zeros(base, np.int64)])
    key, span = padded[:n].copy(), int(padded.max()) + 1
    for k in range(1, base):
        if span ** (k + 1) >= 2**62:
            _, key = np.unique(key, return_inverse=True)
        key = key * span + padded[k : n + k]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    changed = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = _starts(changed)
    rank = np.empty(n, np.int64)
    rank[order] = first
    alone = changed & np.concatenate([changed[1:], [True]])
    active = np.flatnonzero(~alone)
    twice = np.zeros(n, bool)
    twice[order[active]] = True
    if not len(active):
        return twice, best
    neighbours = active[1:][(np.diff(active) == 1) & ~changed[active[1:]]]
    levels, h = [(base, rank.astype(np.int32 if n < 2**31 else np.int64))], base
    while len(active):
        at = order[active]
        nxt = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + nxt
        by = np.argsort(key, kind="stable")
        order[active] = at = at[by]
        key = key[by]
        old = rank[at]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = old + _starts(new) - _starts(group)
        h *= 2
        levels.append((h, rank.astype(levels[0][1].dtype)))
        active = active[~(new & np.concatenate([new[1:], [True]]))]
    a, b, common = order[neighbours - 1], order[neighbours], np.zeros(len(neighbours), np.int64)
    for h, ranks in reversed(levels):
        pa_, pb = a + common, b + common
        inside = np.maximum(pa_, pb) < n
        same = inside & (ranks[np.minimum(pa_, n - 1)] == ranks[np.minimum(pb, n - 1)])
        common += h * same
    more = np.ones(len(a), bool)
    for _ in range(base - 1):
        pa_, pb = a + common, b + common
        more &= (np.maximum(pa_, pb) < n) & (words[np.minimum(pa_, n - 1)] == words[np.minimum(pb, n - 1)])
        common += more
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return twice, best


def covered(first: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Places under a union of spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + length, -1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[bytes | None], min_repeat: int = MIN_REPEAT) -> np.ndarray:
    """One row of NAMES for each text (null: as empty)."""
    out = np.zeros((len(texts), len(NAMES)), np.int64)
    numbers, sizes, at = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            sizes.append(0)
            continue
        words = text.split()
        bare = text.translate(None, WHITE)
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[i, :4] = len(words), len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace")), len(bare) - len(bare.translate(None, SYMBOLS)), len(lines) - len(set(lines))
        own: defaultdict[bytes, int] = defaultdict()
        own.default_factory = own.__len__
        numbers.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)) + at)
        at += len(own)
        sizes.append(len(words))
    if not at:
        return out
    every = np.concatenate(numbers)
    n = len(every)
    twice, best = repeats(every)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    three = np.flatnonzero(twice)
    out[:, 4] = np.bincount(text_of, covered(three, np.full(len(three), 3), n), len(texts))
    long = np.flatnonzero(best >= min_repeat)
    out[:, 5] = np.bincount(text_of, covered(long, best[long], n), len(texts))
    np.maximum.at(out[:, 6], text_of, best)
    return out


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, most_covered: float = MOST_COVERED, most_longest: int = MOST_LONGEST, name: str = "text") -> DataFrame:
    """docs with the measures, base_failed and kept, as columns that start with two underscores.

    In each text, a suffix array over its words and the longest common prefixes of neighbouring
    suffixes find the maximal repeated runs of words. The spans of all runs of `min_repeat` words or
    more are united: __covered_words of them, the longest run has __longest_repeat words. A text is
    kept if it passes the base rules, at most `most_covered` of its words are covered and no
    repeat is longer than `most_longest` words. One pass without a shuffle.

    Null and empty texts have no words and fail the base rules. Other columns and repeated rows
    stay as they are; an empty table gives an empty result.
    """
    from pyspark.sql import types as T

    names = docs.columns
    at = names.index(name)

    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, name):
            got = measure(bytes_of(b.column(at)), min_repeat)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(got[:, k]) for k in range(len(NAMES))]], names=[*names, *[f"__{x}" for x in NAMES]])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(f"__{x}", T.LongType()) for x in NAMES]])
    out = docs.mapInArrow(rule, schema)
    failed = (F.col("__n_words") < LEAST_WORDS) | (100 * F.col("__n_repeat_words") > MOST_REPEATED * F.col("__n_words"))
    fine = (F.col("__covered_words") <= F.lit(float(most_covered)) * F.col("__n_words")) & (F.col("__longest_repeat") <= most_longest)
    return out.withColumn("__base_failed", failed).withColumn("__kept", ~F.col("__base_failed") & fine)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"__{x}").alias(x) for x in [*NAMES, "base_failed", "kept"]])


QUERIES = {"op4_quality": op4_quality}
