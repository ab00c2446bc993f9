"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import os
import random
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, bytes_of, checkpoint, ranked, rows_of, text_slices

CAPACITY, TOKENIZER, END = 2048, "word_bpe_49k.json", 0
#: Islands, epochs between migrations, solutions of an island, children of an epoch.
ISLANDS, EPOCHS, POPULATION, CHILDREN = 4, 3, 6, 24
#: Bytes of the known words of a task, by a rough count; beyond that, those that it has not met again
#: since are forgotten. Words over LONGEST bytes are not kept.
KNOWN_BYTES, LONGEST = 32_000_000, 128
#: Bytes of texts that are cut into pieces at once.
SLICE = 6_000_000

Bins = Counter  # of patterns: how many bins hold just these lengths, in falling order


# ---- the grouping genetic algorithm, on counts of lengths ----


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    return max(-(-sum(n * c for n, c in counts.items()) // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))


def best_fit(counts: dict[int, int], capacity: int, bins: Bins | None = None, order: list[int] | None = None) -> Bins:
    """Adds the counted lengths to the bins, each to the fullest bin that has room.

    Equal lengths are placed together, so the work depends on the number of different lengths and
    patterns, not on the number of documents.
    """
    by_room: dict[int, list[list]] = {}
    for pattern, n in (bins or {}).items():
        by_room.setdefault(capacity - sum(pattern), []).append([pattern, n])
    rooms = np.zeros(capacity + 1, bool)
    rooms[list(by_room)] = True
    for length in order or sorted(counts, reverse=True):
        left = counts.get(length, 0)
        while left > 0:
            ahead = rooms[length:]
            room = length + int(ahead.argmax()) if ahead.any() else -1
            if room < 0:
                each = capacity // length
                full, rest = divmod(left, each)
                for pattern, n in (((length,) * each, full), ((length,) * rest, 1)):
                    if n and pattern:
                        r = capacity - length * len(pattern)
                        by_room.setdefault(r, []).append([pattern, n])
                        rooms[r] = True
                break
            entry = by_room[room][-1]
            took = min(left, entry[1])
            entry[1] -= took
            left -= took
            if not entry[1]:
                by_room[room].pop()
                rooms[room] = bool(by_room[room])
            r = room - length
            by_room.setdefault(r, []).append([tuple(sorted((*entry[0], length), reverse=True)), took])
            rooms[r] = True
    out: Bins = Counter()
    for entries in by_room.values():
        for pattern, n in entries:
            out[pattern] += n
    return out


def filled(counts: dict[int, int], capacity: int) -> Bins:
    """Largest first, those that one or two other lengths complete to a full bin; the rest best-fit."""
    left, out = np.zeros(capacity + 1, np.int64), Counter()
    for n, c in counts.items():
        left[n] = c
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            room = capacity - length
            one = np.flatnonzero(left[1:room]) + 1
            two = one[left[room - one] > 0]
            best = (length, room) if room and left[room] else (length, int(two[-1]), int(room - two[-1])) if len(two) else (length,)
            need = Counter(best)
            times = min(int(left[n]) // k for n, k in need.items())
            if sum(best) < capacity or not times:
                break
            for n, k in need.items():
                left[n] -= k * times
            out[tuple(sorted(best, reverse=True))] += times
    return best_fit({int(n): int(left[n]) for n in np.flatnonzero(left)}, capacity, out)


def cost(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, fuller and emptier bins rather than even ones."""
    return sum(bins.values()), -sum(n * (sum(p) / capacity) ** 2 for p, n in bins.items())


def _fitting(bins: Bins, left: Counter, patterns: list) -> Bins:
    """Whole bins of the patterns, as often as the lengths that are left allow; takes them off."""
    out: Bins = Counter()
    for p in patterns:
        need = Counter(p)
        n = min(bins[p], *(left[x] // k for x, k in need.items()))
        if n > 0:
            out[p] = n
            for x, k in need.items():
                left[x] -= n * k
    return out


def crossover(a: Bins, b: Bins, counts: dict[int, int], capacity: int, rng: random.Random) -> Bins:
    """Well-filled bins of b are injected whole; bins of a with lengths that are then used up are
    removed; displaced lengths are placed best-fit."""
    left = Counter(counts)
    well = [p for p in b if sum(p) >= capacity - 2 and rng.random() < 0.6]
    child = _fitting(b, left, well)
    for p, n in _fitting(a, left, sorted(a, key=sum, reverse=True)).items():
        child[p] += n
    return best_fit({x: n for x, n in left.items() if n}, capacity, child)


def mutate(bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """Some bins, above all poorly filled ones, are emptied, and their lengths placed anew."""
    kept, out = Counter(), Counter()
    for p, n in bins.items():
        gone = n if sum(p) < capacity - 2 and rng.random() < 0.7 else rng.randint(0, n) if rng.random() < 0.05 else 0
        if n > gone:
            kept[p] = n - gone
        for x in p:
            out[x] += gone
    order = sorted((x for x in out if out[x]), key=lambda x: -x * rng.uniform(0.9, 1.1))
    return best_fit(out, capacity, kept, order)


def evolve(counts: dict[int, int], capacity: int, guests: list[Bins], seed: int, population: int, children: int) -> list[Bins]:
    """One epoch of an island: its solutions, best first. It ends early at the lower bound."""
    rng, least = random.Random(seed), lower_bound(counts, capacity)
    pool = list(guests)
    while len(pool) < population:
        if len(pool) == len(guests):
            pool.append(filled(counts, capacity) if seed % 2 else best_fit(counts, capacity))
        else:
            order = sorted(counts, key=lambda x: -x * rng.uniform(0.85, 1.15))
            pool.append(best_fit(counts, capacity, None, order))
    pool.sort(key=lambda s: cost(s, capacity))
    for _ in range(children):
        if cost(pool[0], capacity)[0] <= least:
            break
        a, b = (min(rng.sample(pool, 2), key=lambda s: cost(s, capacity)) for _ in range(2))
        child = mutate(crossover(a, b, counts, capacity, rng), capacity, rng)
        pool = sorted([*pool, child], key=lambda s: cost(s, capacity))[:population]
    return pool


def _dump(bins: Bins) -> str:
    return json.dumps([[*p, n] for p, n in sorted(bins.items(), reverse=True)])


def _load(text: str) -> Bins:
    return Counter({tuple(x[:-1]): x[-1] for x in json.loads(text)})


def pack_lengths(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, children: int = CHILDREN, seed: int = 1) -> Bins:
    """Bins for the counted lengths, as few as the islands find.

    Each island is a Spark task with solutions of its own; after each epoch its best one moves to
    the next island. What travels are counts by length and by pattern: their size depends on
    the capacity, not on the number of documents. Lost tasks are repeated with the same seed.
    """
    if not counts:
        return Counter()
    hist, elites = json.dumps(sorted(counts.items())), [[] for _ in range(islands)]
    best: Bins | None = None
    for epoch in range(epochs):
        rows = [(i, seed + 1000 * epoch + i, hist, elites[i]) for i in range(islands)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    own = dict(map(tuple, json.loads(r["hist"])))
                    pool = evolve(own, capacity, [_load(x) for x in r["guests"]], r["seed"], population, children)
                    yield pa.RecordBatch.from_pylist([{"island": r["island"], "pool": [_dump(x) for x in pool[:2]]}], pa.schema([("island", pa.int32()), ("pool", pa.list_(pa.string()))]))

        start = rows_of(spark, "island int, seed long, hist string, guests array<string>", rows).repartition(islands, "island")
        pools = {r.island: list(r.pool) for r in start.mapInArrow(run, "island int, pool array<string>").collect()}
        best = min((_load(x) for p in pools.values() for x in p), key=lambda s: cost(s, capacity))
        if cost(best, capacity)[0] <= lower_bound(counts, capacity):
            break
        elites = [[*pools[i], pools[(i - 1) % islands][0]] for i in range(islands)]
    return best


# ---- tokens and places ----


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for the letters from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class Tokens(dict):
    """Ids of each text between ASCII white space, as bytes of little-endian 32-bit numbers.

    The tokenizer drops white space and never joins across it, and its normaliser works on each
    such piece alone; so a text's ids are those of its pieces one after the other. It lower-cases,
    and it never joins an ASCII letter or digit with a mark of MARKS after it; so texts are
    lower-cased (but for letters before non-ASCII bytes, which may be accents) and cut there first, which
    leaves far fewer different pieces. Texts that may name a special token are left as they are. A
    piece of letters below PLAIN goes to the tokenizer's model at once, others through all of it.

    Texts are cut a batch at a time. What it knows is kept in two generations of KNOWN_BYTES each and ends with its task.
    """

    MARKS, PLAIN = b".,!?;:|%&$*#", chr(0x250)

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.of, self.before, self.held = Tokenizer.from_file(path), {}, 0
        self.model, self.letters = self.of.model, byte_letters()
        every = [bytes([b]) for b in range(256)]
        self.lower = np.frombuffer(b"".join(every).lower(), np.uint8)
        self.alnum, self.space, self.mark = (np.array([f(b) for b in every]) for f in (bytes.isalnum, bytes.isspace, lambda b: b in self.MARKS))

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            # ASCII letters alone, in lower case as they mostly are, need no more than the model
            ids = self._plain(word.decode()) if word.isalpha() and word.islower() else self._other(word)
        if len(word) <= LONGEST:
            if self.held >= KNOWN_BYTES:
                self.before, self.held = dict(self), 0
                self.clear()
            self[word] = ids
            self.held += len(word) + len(ids) + 160  # two objects and a place in the table
        return ids

    def _plain(self, text: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _other(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if word.isalpha():
            return self[word.lower()]
        if text.isalpha() and max(text) < self.PLAIN and "\u0130" not in text:
            small = text.lower()
            if small != text:
                return self[small.encode()]
            return self._plain(word.decode("latin-1").translate(self.letters))
        ids = self.of.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def words(self, texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of all texts, each different one once, and how many come before each text's end."""
        ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
        a = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # each text with a space after it
        after = np.append(a[1:], np.uint8(32))
        small, cut = np.where(after < 128, self.lower[a], a), self.alnum[a] & self.mark[after]
        for i, text in enumerate(texts):
            if b"<|" in text:
                own = slice(ends[i], ends[i + 1])
                small[own], cut[own] = a[own], False
        black = ~self.space[a]
        first = black.copy()
        first[1:] &= ~black[:-1] | cut[:-1]
        data = small[black]
        edges = np.append(np.flatnonzero(first[black]), len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        return words.dictionary_encode(), np.searchsorted(np.flatnonzero(first), ends)

    def __call__(self, text: bytes | None) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text; those of a piece are looked up once for all places that have it."""
        words, ends = self.words([t or b"" for t in texts])
        if not len(words):
            return [b""] * len(texts)
        ids = pa.array(list(map(self.__getitem__, words.dictionary.to_pylist())), pa.large_binary()).take(words.indices)
        _, edges, data = ids.buffers()
        at = np.frombuffer(edges, np.int64)[ends].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(at, at[1:])]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the tokens of each row of docs with the
    end token, cut into pieces of `capacity`; ids are bytes of little-endian 32-bit numbers."""
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        for b in text_slices(batches, "text", SLICE):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, own in enumerate(tokens.batch(bytes_of(b.column(1)))):
                all_ids = own + end
                for k, at in enumerate(range(0, len(all_ids), 4 * capacity)):
                    part = all_ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
            cols = [b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(ids, pa.binary())] * keep_ids], names=[*names, *["ids"] * keep_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def slots(bins: Bins) -> np.ndarray:
    """(length, first rank, first sequence, offset) of each item of each pattern, sorted; the ranks
    of a length go through its items in this order, sequence by sequence."""
    out, used, base = [], Counter(), 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in pattern:
            out.append((length, used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = False, **islands: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of each row's pieces.

    Pieces of full length are sequences of their own. For the others, the driver gathers how many
    have each length (`capacity` rows at most), packs these counts, and gives each rank within a
    length its place. Ranks come from range partitions, so one length may have most pieces.

    A null or empty text is the end token alone. Null ids and repeated rows are packed like
    others, each row by itself. Other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    # written first: range partitioning reads its input twice, and would cut the texts twice
    pieces = checkpoint(token_pieces(docs, capacity, tokenizer, keep_ids))
    pieces = checkpoint(ranked(pieces, ["length"], ["doc_id", "piece"]))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = counts.pop(capacity, 0)
    bins = pack_lengths(docs.sparkSession, counts, capacity, **islands)
    if full:
        bins = Counter(bins) + Counter({(capacity,): full})
    table = slots(bins)
    code = table[:, 0] * 2**40 + table[:, 1]
    names = [c for c in pieces.columns if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = table[np.searchsorted(code, length * 2**40 + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])], names=[*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in pieces.schema.fields if f.name != "rank"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return pieces.mapInArrow(place, schema)


def op3_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_pack": op3_pack}
