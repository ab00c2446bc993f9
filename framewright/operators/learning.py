"""Scaling, classifiers, predictions and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def fit_scalers(rows: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """(group, mean and population deviation of each feature); deviations of 0 become 1."""
    aggs = [a for f in features for a in (F.avg(f).alias(f"{f}_mean"), F.when(F.stddev_pop(f) > 0, F.stddev_pop(f)).otherwise(1.0).alias(f"{f}_std"))]
    return rows.groupBy(group).agg(*aggs)


def scale(rows: DataFrame, scalers: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Standardised features by group; rows of a group that was not fitted stay as they are."""
    out = rows.join(scalers, group, "left")
    new = {f: F.when(F.col(f"{f}_std").isNotNull(), (F.col(f) - F.col(f"{f}_mean")) / F.col(f"{f}_std")).otherwise(F.col(f)) for f in features}
    return out.withColumns(new).select(*rows.columns)


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight, so that all classes weigh the same."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy()
    n = n.withColumn("weight", F.sum("__n").over(every) / (F.count(F.lit(1)).over(every) * F.col("__n"))).drop("__n")
    return rows.join(n, label)


def classifiers(seed: int = 42) -> dict:
    """Named classifiers to compare."""
    multi = lambda c: C.OneVsRest(classifier=c, labelCol="y", featuresCol="x", weightCol="weight")
    kw = {"labelCol": "y", "featuresCol": "x"}
    forest = lambda n: C.RandomForestClassifier(numTrees=n, maxDepth=20, minInstancesPerNode=4, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed, **kw)
    return {
        "logistic": C.LogisticRegression(weightCol="weight", **kw), "linear_svc": multi(C.LinearSVC(weightCol="weight")), "gaussian_nb": C.NaiveBayes(modelType="gaussian", weightCol="weight", **kw),
        "tree": C.DecisionTreeClassifier(maxDepth=8, weightCol="weight", seed=seed, **kw), "forest_50": forest(50), "forest_100": forest(100), "forest_200": forest(200),
        "boosted": multi(C.GBTClassifier(maxIter=20, seed=seed)),
    }


def train(rows: DataFrame, features: Sequence[str], label: str, classifier) -> PipelineModel:
    """A pipeline of label index, feature vector (an error on nulls) and classifier."""
    stages = [StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep"), VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="error"), classifier]
    return Pipeline(stages=stages).fit(balanced(rows, label))


def predict(model: PipelineModel, rows: DataFrame, tau: float = 0.62) -> DataFrame:
    """rows with the two likeliest classes, their probabilities, entropy in bits and accepted."""
    from framewright.functions.arrays import entropy_bits

    names = F.array(*[F.lit(x) for x in [*model.stages[0].labels, "unknown"]])
    p = vector_to_array("probability")
    ranked = F.sort_array(F.transform(p, lambda v, i: F.struct(v.alias("p"), i.alias("i"))), asc=False)
    out = model.stages[2].transform(model.stages[1].transform(rows)).withColumn("__p", p).withColumn("__r", ranked)
    pick = lambda k: [F.element_at(names, F.col("__r")[k]["i"] + 1).alias(f"top{k + 1}_label"), F.col("__r")[k]["p"].alias(f"top{k + 1}_proba")]
    return out.select(*rows.columns, *pick(0), *pick(1), entropy_bits(F.col("__p")).alias("posterior_entropy"), (F.col("__r")[0]["p"] >= tau).alias("accepted"))


def predict_top2(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    return predict(model, rows).select(*keep, "top1_label", "top1_proba", "top2_label", "top2_proba", "posterior_entropy", "accepted")


def compare(train_rows: DataFrame, test_rows: DataFrame, feature_sets: dict[str, Sequence[str]], label: str, names: Sequence[str], seeds: Sequence[int] = (42,)) -> DataFrame:
    """One row for each classifier, feature set and seed with its overall scores on the test rows.

    The loop is over models, not over data: each fit and each evaluation is a job of its own."""
    from functools import reduce

    from .statistics import overall_scores

    out = []
    for features_name, features in feature_sets.items():
        for seed in seeds:
            for name in names:
                model = train(train_rows.dropna(subset=list(features)), features, label, classifiers(seed)[name])
                got = predict_classes(model, test_rows.dropna(subset=list(features)))
                scores = overall_scores(got, label, "predicted")
                out.append(scores.select(F.lit(name).alias("classifier"), F.lit(features_name).alias("features"), F.lit(seed).alias("seed"), "*"))
    return reduce(DataFrame.unionAll, out)


def predict_classes(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with the predicted label; for classifiers with and without probabilities."""
    names = F.array(*[F.lit(x) for x in [*model.stages[0].labels, "unknown"]])
    out = model.stages[2].transform(model.stages[1].transform(rows))
    return out.select(*rows.columns, F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))


def tree_variance(model: PipelineModel, rows: DataFrame, id_column: str) -> DataFrame:
    """(id, variance): mean over classes of the variance of the trees' probabilities, for forests of
    moderate size; each tree is one column of the same scan."""
    forest = model.stages[2]
    out = model.stages[1].transform(rows)
    for i, tree in enumerate(forest.trees):
        t = tree.copy()
        t = t.setFeaturesCol("x").setPredictionCol(f"p{i}").setProbabilityCol(f"q{i}").setRawPredictionCol(f"r{i}")
        out = t.transform(out).drop(f"p{i}", f"r{i}")
    n, k = len(forest.trees), forest.numClasses
    q = [vector_to_array(f"q{i}") for i in range(n)]
    per = []
    for c in range(k):
        m = sum((x[c] for x in q), F.lit(0.0)) / n
        per.append(sum((F.pow(x[c] - m, 2) for x in q), F.lit(0.0)) / n)
    return out.select(id_column, (sum(per, F.lit(0.0)) / k).alias("variance"))


#: Bytes of the queries that a cell holds; training rows, and queries, that are compared at once; pairs that are work for a task.
HELD, BLOCK, TILE, PAIRS = 32_000_000, 4096, 128, 1 << 25


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors without nulls as doubles, a row each."""
    flat, n = column.flatten(), len(column)
    if flat.null_count or n and (pc.min_max(column.value_lengths())["min"] != pc.min_max(column.value_lengths())["max"]):
        raise ValueError("vectors must be of one length and hold no nulls")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _scaled(x: np.ndarray, by: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """x divided by `by` and its rows' norms; rows that aren't finite are 0."""
    with np.errstate(invalid="ignore"):
        y = np.where(np.isfinite(x).all(1)[:, None], x / by, 0)
    return y, np.sqrt((y * y).sum(1))


class _Held:
    """The queries of a cell, with the k best training rows of each so far.

    Products in single precision, plus a bound of their error, pick the candidates; those get the sum of
    products in doubles from the first component to the last, as SQL's inner product does, so that equal
    vectors have equal scores. NaN is the largest score."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int) -> None:
        self.ids, self.values, self.k = ids, values, k
        self.odd = ~np.isfinite(values).all(1)
        top = np.abs(values).max(1, initial=0)
        self.scale = np.where((top > 0) & ~self.odd, top, 1.0)
        y, self.norm = _scaled(values, self.scale[:, None])
        self.slack = (4 * values.shape[1] + 32) * 2.0**-24
        self.single = np.hstack([y, self.slack * self.norm[:, None] + 1e-30]).astype(np.float32)
        self.score, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.label, self.size = np.empty((len(ids), k), object), np.zeros(len(ids), int)

    def meet(self, ids: np.ndarray, values: np.ndarray, labels: np.ndarray) -> None:
        """Takes in training rows, which come by rising id. Of equal vectors the first k are enough."""
        if values.shape[1] != self.values.shape[1]:
            raise ValueError("vectors must be of one length and hold no nulls")
        rows = np.ascontiguousarray(values).view(np.dtype((np.void, values.itemsize * values.shape[1]))).ravel()
        _, of = np.unique(rows, return_inverse=True)
        order = np.argsort(of, kind="stable")
        place = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        keep = np.sort(order[place < self.k])
        ids, values, labels = ids[keep], values[keep], labels[keep]
        odd = ~np.isfinite(values).all(1)
        scale = np.abs(values[~odd]).max(initial=0) or 1.0
        y, norm = _scaled(values, scale)
        single = np.hstack([y, norm[:, None] + 1e-30]).astype(np.float32).T.copy()
        for a in range(0, len(self.ids), TILE):
            q = slice(a, a + TILE)
            s = self.single[q] @ single
            least = np.where(self.size[q] < self.k, -np.inf, self.score[q, -1])
            with np.errstate(over="ignore"):
                least = np.where(np.isnan(least), np.inf, least / self.scale[q] / scale).astype(np.float32)
            take = s >= np.nextafter(least, np.float32(-np.inf))[:, None]
            plain = not (odd.any() or self.odd[q].any())
            if plain and len(ids) > self.k and np.count_nonzero(take) > 8 * self.k * len(s):
                # the k-th largest bound, less what bounds exceed scores by at most
                least = np.partition(s, -self.k, axis=1)[:, -self.k] - 4 * self.slack * (self.norm[q] * norm.max() + 1e-6)
                take &= s >= least.astype(np.float32)[:, None]
            elif not plain:
                take |= odd[None, :] | self.odd[q][:, None]
            at, to = np.divmod(np.flatnonzero(take), len(ids))
            if len(at):
                self._merge(a, at, to, ids, values, labels)

    def _merge(self, a: int, at: np.ndarray, to: np.ndarray, ids: np.ndarray, values: np.ndarray, labels: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            score = np.concatenate([np.cumsum(self.values[a + at[i : i + 16384]] * values[to[i : i + 16384]], axis=1)[:, -1] for i in range(0, len(at), 16384)])
        n = len(self.size[a : a + TILE])
        mine, place = np.nonzero(np.arange(self.k) < self.size[a : a + TILE, None])
        at, score = np.concatenate([mine, at]), np.concatenate([self.score[a + mine, place], score])
        ids, labels = np.concatenate([self.found[a + mine, place], ids[to]]), np.concatenate([self.label[a + mine, place], labels[to]])
        nan = np.isnan(score)
        order = np.lexsort((ids, -np.where(nan, np.inf, score), ~nan, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        order, at, rank = order[rank < self.k], at[rank < self.k], rank[rank < self.k]
        for name, x in (("score", score), ("found", ids), ("label", labels)):
            getattr(self, name)[a + at, rank] = x[order]
        self.size[a : a + TILE] = np.bincount(at, minlength=n)

    def best(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.ids), 8192):
            at, place = np.nonzero(np.arange(self.k) < self.size[a : a + 8192, None])
            at += a
            cols = [pa.array(self.ids[at]), pa.array(self.found[at, place]), pa.array(self.label[at, place].tolist(), kind), pa.array(self.score[at, place])]
            yield pa.RecordBatch.from_arrays(cols, names=["qid", "tid", "l", "score"])


def _best_in_cell(k: int):
    """The k best training rows of a cell's queries: rows come sorted by cell, queries (kind 0) first, then
    the training rows, which stream past them, by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held, kind = None, [], None, None
        for b in batches:
            kind = b.schema.field("l").type
            own = b.column("cell").to_numpy() * 2 + b.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else []
            for x, y in zip(edges, edges[1:], strict=False):
                part = b.slice(x, y - x)
                if own[x] // 2 != now:
                    if held:
                        yield from held.best(kind)
                    now, waiting, held = own[x] // 2, [], None
                if own[x] % 2 == 0:
                    waiting.append((part.column("id").to_numpy(), _matrix(part.column("v"))))
                    continue
                if waiting:
                    held, waiting = _Held(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), k), []
                for at in range(0, y - x if held else 0, BLOCK):
                    some = part.slice(at, BLOCK)
                    labels = np.empty(some.num_rows, object)
                    labels[:] = some.column("l").to_pylist()
                    held.meet(some.column("id").to_numpy(), _matrix(some.column("v")), labels)
        if held:
            yield from held.best(kind)

    return run


def nearest_classes(train_rows: DataFrame, test_rows: DataFrame, id_column: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """(id, predicted, votes): majority of the k training rows with the largest inner product, ties
    to the smaller id, and of classes to the smaller label. Null vectors have no score and come last.

    Test rows are a stated query set, and all pairs are compared. Both sides are dealt out on a grid, so
    that a cell holds HELD bytes of queries at most and each of its training rows streams past them
    once. There are no more cells than keep the cores busy, of a shape that makes few copies."""
    spark, kind = train_rows.sparkSession, train_rows.schema[label].dataType.simpleString()
    q = test_rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))
    tr = train_rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).alias("l"))
    size = lambda d: d.agg(F.count("v"), F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    (n_q, all_q, dim), (n_t, all_t, _) = size(q), size(tr)
    cells = max(1, min(4 * spark.sparkContext.defaultParallelism, n_q * n_t // PAIRS))
    gq = max(1, -(-n_q * 8 * dim // HELD), round((cells * n_q / max(1, n_t)) ** 0.5))
    gn = max(1, -(-cells // gq))
    own = lambda g: F.pmod(F.xxhash64("id"), F.lit(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    asked = q.where("v is not null").select(own(gq).alias("i"), every(gn).alias("j"), F.lit(0).alias("kind"), "id", "v", F.lit(None).cast(kind).alias("l"))
    known = tr.where("v is not null").select(every(gq).alias("i"), own(gn).alias("j"), F.lit(1).alias("kind"), "id", "v", "l")
    dealt = asked.unionAll(known).withColumn("cell", F.col("i") * gn + F.col("j")).repartitionById(gq * gn, F.col("cell")).select("cell", "kind", "id", "v", "l").sortWithinPartitions("cell", "kind", "id")
    near = dealt.mapInArrow(_best_in_cell(k), f"qid long, tid long, l {kind}, score double")
    unscored = lambda a, b: a.select(F.col("id").alias("qid")).crossJoin(b.orderBy("id").limit(k).select(F.col("id").alias("tid"), "l", F.lit(None).cast("double").alias("score")))
    if n_t < min(k, all_t):
        near = near.unionAll(unscored(q.where("v is not null"), tr.where("v is null")))
    if n_q < all_q:
        near = near.unionAll(unscored(q.where("v is null"), tr))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "tid"))
    votes = near.withColumn("r", place).where(F.col("r") <= k).groupBy("qid", "l").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy(F.col("qid").alias(id_column)).agg(F.min_by("l", F.struct((-F.col("votes")).alias("o"), "l")).alias("predicted"), F.max("votes").alias("votes"))
