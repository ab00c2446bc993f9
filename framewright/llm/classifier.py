"""Quality classifier: random Fourier features, ridge regression and isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, checkpoint, text_slices

#: Random features, width of the Gaussian kernel over standardised statistics, ridge, bins of raw scores.
FEATURES, WIDTH, RIDGE, BINS = 256, 4.0, 1e-3, 2000
LOWEST, HIGHEST, THRESHOLD = -0.5, 1.5, 0.3
#: Partial sums are added up in this many groups before the driver gets them.
GROUPS = 8
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10,),
    "stop": b".", "comma": b",", "loud": b"!?", "symbol": b"#*$%&|<>", "pipe": b"|", "bracket": b"()[]{}", "high": range(128, 256),
}
STATISTICS = ["log_words", "word_length", "distinct", "adjacent", "log_lines", "line_words", "repeated_lines", "short_lines", "entropy", *_CLASSES]


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of STATISTICS for each text; null and empty texts: zeros."""
    out = np.zeros((len(texts), len(STATISTICS)), np.float64)
    masks = np.zeros((256, len(_CLASSES)))
    for k, places in enumerate(_CLASSES.values()):
        masks[list(places), k] = 1
    for i, text in enumerate(texts):
        if not text:
            continue
        words = text.split()
        n = len(words)
        lines = [x for x in text.split(b"\n") if x.strip()]
        share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text)
        some = share[share > 0]
        m = max(1, len(lines))
        out[i, :9] = (
            np.log1p(n), len(text) / max(1, n), len(set(words)) / max(1, n), sum(map(eq, words, words[1:])) / max(1, n), np.log1p(len(lines)), np.log1p(n / m),
            1 - len(set(lines)) / m, sum(len(x) < 30 for x in lines) / m, -(some * np.log2(some)).sum(),
        )
        out[i, 9:] = share @ masks
    return out


def fold(doc_id: Column | str) -> Column:
    """0 to 4 by the CRC-32 of the id as text; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


class Model:
    """Random cosine features and the identity of standardised statistics, with ridge weights."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turn, self.shift = rng.normal(0, 1 / width, (len(mean), features)), rng.uniform(0, 2 * np.pi, features)
        self.weights, self.xs, self.ys = None, np.array([0.0]), np.array([0.5])

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift), z / 6, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.lift(x) @ self.weights, LOWEST, HIGHEST) if self.weights is not None else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated to 0..1; a thousandth of the raw score keeps the order within flat parts."""
        raw = self.raw(x)
        return 0.999 * np.interp(raw, self.xs, self.ys) + 0.001 * (raw - LOWEST) / (HIGHEST - LOWEST)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and values of the blocks, both rising."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, n, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, len(STATISTICS)))


def document_statistics(docs: DataFrame, name: str = "text") -> DataFrame:
    """(doc_id, x) for each row of docs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            x = statistics(bytes_of(b.column(1)))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(name).alias("text")).mapInArrow(find, f"doc_id {kind}, x array<double>")


def _summed(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """The normal equations over all rows (x, y): summed in each partition, then in GROUPS."""
    size = len(model.mean) + len(model.shift) + 1

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((size, size + 1))
        n = 0
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                z = model.lift(np.stack(part.column(0).to_numpy(zero_copy_only=False)))
                total[:, :size] += z.T @ z
                total[:, size] += z.T @ part.column(1).to_numpy(zero_copy_only=False)
                n += part.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["g", "n", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size * (size + 1)), 0
        for b in batches:
            for k, body in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                total += np.frombuffer(body.as_py(), np.float64)
                n += k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["g", "n", "total"])

    kind = "g int, n long, total binary"
    got = rows.mapInArrow(local, kind).repartition(GROUPS, "g").mapInArrow(add, kind).collect()
    total = sum((np.frombuffer(r.total, np.float64) for r in got), np.zeros(size * (size + 1))).reshape(size, size + 1)
    return total[:, :size], total[:, size], sum(r.n for r in got)


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = 7) -> Model:
    """A model from rows (x, y, calibrate): weights from those not for calibration, the isotonic
    curve from the others. Without rows all scores are 0.5.

    The driver gets moments, GROUPS matrices and counts of BINS bins, however many rows there are.
    """
    size = len(STATISTICS)
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[k]) for k in range(size)], *[F.sum(F.col("x")[k] * F.col("x")[k]) for k in range(size)]).first()
    n = sums[0]
    if not n:
        return Model(np.zeros(size), np.ones(size), features, width, seed)
    mean = np.array(sums[1 : size + 1], float) / n
    spread = np.sqrt(np.maximum(np.array(sums[size + 1 :], float) / n - mean**2, 0))
    model = Model(np.round(mean, 9), np.round(np.where(spread > 1e-9, spread, 1), 9), features, width, seed)
    a, b, m = _summed(rows.where("not calibrate").select("x", F.col("y").cast("double")), model)
    model.weights = np.linalg.solve(a + ridge * max(1, m) / len(a) * np.eye(len(a)), b)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(np.stack(batch.column(0).to_numpy(zero_copy_only=False)))
                at = np.minimum(((raw - LOWEST) / (HIGHEST - LOWEST) * BINS).astype(np.int32), BINS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "y"])

    held = rows.where("calibrate").select("x", F.col("y").cast("double")).mapInArrow(bins, "bin int, y double")
    held = sorted(held.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect())
    if held:
        at, k, y = (np.array(c, float) for c in zip(*held, strict=True))
        model.xs, model.ys = isotonic(LOWEST + (at + 0.5) / BINS * (HIGHEST - LOWEST), y / k, k)
    else:
        model.xs, model.ys = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Statistics of each whole text are computed once. Labelled documents whose id has a CRC-32 not
    divisible by 5 teach: remainders 2 to 4 the weights, 1 the calibration. Scores depend on the
    text alone. Of several labels of an id the highest counts; labels other than 0 and 1, null
    labels and labels without a document are left out. Null and empty texts have statistics 0
    and a score like others. Repeated rows have equal scores. Other columns are ignored; without
    labels all scores are about 0.5, an empty table gives an empty result.
    """
    every = checkpoint(document_statistics(docs))
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).alias("y"))
    taught = every.withColumn("fold", fold("doc_id")).where("fold <> 0").join(known, F.col("doc_id") == F.col("__id"))
    model = fit(checkpoint(taught.select("x", "y", (F.col("fold") == 1).alias("calibrate"))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(np.stack(b.column(1).to_numpy(zero_copy_only=False))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = every.mapInArrow(score, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op5_quality_score": op5_quality_score}
