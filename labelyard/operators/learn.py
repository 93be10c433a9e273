"""Model stages: out-of-fold logistic regression, batch scoring and its throughput."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .persist import cut

#: Steps that a fit may take, pairs that a step remembers, and the gradient at which it ends, as a
#: share of the weights.
STEPS, MEMORY, ENOUGH = 300, 12, 1e-7


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    lists = batch.column(at)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _summed(parts: DataFrame, *keys: str) -> dict[tuple, np.ndarray]:
    """Sums of ``v`` (array<double>) by key, of one row for each task and key, in the order of the
    tasks, so that they don't depend on which task ends first."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task")
        return rows.iloc[:1].assign(v=[np.stack(rows["v"].to_numpy()).sum(axis=0)])

    return {tuple(r[k] for k in keys): np.array(r["v"]) for r in parts.groupBy(*keys).applyInPandas(add, parts.schema).collect()}


def moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each fold of rows (fold, features array) the sums of products of (1, features): the
    number of rows, the sums and the Gram matrix, in one aggregation that combines in the tasks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in it:
            if not batch.num_rows:
                continue
            fold, x = batch.column(0).to_numpy(), _matrix(batch, 1)
            x = np.hstack((np.ones((len(x), 1)), x))
            for f in np.unique(fold).tolist():
                own = x[fold == f]
                held[f] = held.get(f, 0) + own.T @ own
        task, said = TaskContext.get().partitionId(), [(f, i, v) for f, m in held.items() for i, v in enumerate(m)]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _, _ in said], pa.int32()), pa.array([i for _, i, _ in said], pa.int32()), pa.array([task] * len(said), pa.int32()), pa.array([v for _, _, v in said], pa.list_(pa.float64()))], names=["fold", "i", "task", "v"])

    found = _summed(rows.select(F.col("fold").cast("int"), "features").mapInArrow(run, "fold int, i int, task int, v array<double>"), "fold", "i")
    wide = 1 + max((i for _, i in found), default=-1)
    return {f: np.stack([found[f, i] for i in range(wide)]) for f in sorted({f for f, _ in found})}


class FoldProblem:
    """The regression that predicts one fold: which classes its training rows have, their weights,
    how features are scaled, and the factor of a bound on the curvature."""

    def __init__(self, train: np.ndarray, counts: np.ndarray, weight: Callable[[np.ndarray], np.ndarray], c: float):
        n = train[0, 0]
        self.classes = np.flatnonzero(counts)
        self.mean = train[0, 1:] / n
        spread = np.sqrt(np.maximum(np.diag(train)[1:] / n - self.mean**2, 0))
        self.scale = np.where(spread > 1e-12, spread, 1.0)
        self.weight = np.zeros(len(counts))
        self.weight[self.classes] = weight(counts[self.classes].astype(float))
        self.total = float(counts @ self.weight)
        self.ridge = np.append(np.zeros(1), np.full(len(self.mean), 1 / c))
        to = np.diag(np.append(1.0, 1 / self.scale))
        to[0, 1:] = -self.mean / self.scale
        # the curvature is at most half of the weighted Gram matrix for each class
        self.bound = np.linalg.cholesky(to.T @ train @ to * (self.total / n / 2) + np.diag(self.ridge + 1e-9 * n))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.hstack((np.ones((len(x), 1)), (x - self.mean) / self.scale))

    def soften(self, g: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.bound.T, np.linalg.solve(self.bound, g.T)).T


def _log_probs(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _gradients(data: DataFrame, problems: dict[int, FoldProblem], at: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """Loss and gradient of each fold's problem in ``at``, from one pass over all rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad = dict.fromkeys(at, 0.0), {f: np.zeros_like(w) for f, w in at.items()}
        for batch in it:
            if not batch.num_rows:
                continue
            fold, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch, 2)
            for f, w in at.items():
                p = problems[f]
                train = fold != f
                z, own = p.standard(x[train]), np.searchsorted(p.classes, y[train])
                weight, logs = p.weight[y[train]], _log_probs(z @ w.T)
                loss[f] -= float(weight @ logs[np.arange(len(own)), own])
                d = np.exp(logs)
                d[np.arange(len(own)), own] -= 1
                grad[f] += (d * weight[:, None]).T @ z
        task = TaskContext.get().partitionId()
        said = [(f, np.append(loss[f], grad[f].ravel())) for f in at]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in said], pa.int32()), pa.array([task] * len(said), pa.int32()), pa.array([v for _, v in said], pa.list_(pa.float64()))], names=["held", "task", "v"])

    found = _summed(data.select("fold", "true_id", "features").mapInArrow(run, "held int, task int, v array<double>"), "held")
    out = {}
    for f, w in at.items():
        v, p = found[(f,)], problems[f]
        out[f] = v[0] + float((p.ridge * w * w).sum()) / 2, v[1:].reshape(w.shape) + p.ridge * w
    return out


class _Descent:
    """One problem's path: limited-memory steps that begin with the bound on the curvature."""

    def __init__(self, problem: FoldProblem, wide: int):
        self.problem, self.w = problem, np.zeros((len(problem.classes), wide))
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.loss, self.grad, self.way, self.step, self.done = np.inf, self.w, self.w, 1.0, False

    def propose(self) -> np.ndarray:
        return self.w + self.step * self.way

    def take(self, at: np.ndarray, loss: float, grad: np.ndarray) -> None:
        if np.isfinite(self.loss) and loss > self.loss + 1e-4 * self.step * float((self.grad * self.way).sum()) and self.step > 1e-6:
            self.step /= 2
            return
        if np.isfinite(self.loss):
            s, y = at - self.w, grad - self.grad
            if (s * y).sum() > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
                self.pairs = [*self.pairs, (s, y)][-MEMORY:]
        self.w, self.loss, self.grad, self.step = at, loss, grad, 1.0
        self.done = float(np.abs(grad).max()) <= ENOUGH * self.problem.total
        q, back = grad.copy(), []
        for s, y in reversed(self.pairs):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            back.append(a)
        q = self.problem.soften(q)
        for (s, y), a in zip(self.pairs, reversed(back), strict=True):
            q += (a - (y * q).sum() / (s * y).sum()) * s
        self.way = -q


def fit_folds(rows: DataFrame, labels: int, weights: str | float = 0.25, c: float = 1.0) -> tuple[dict[int, FoldProblem], dict[int, np.ndarray]]:
    """For each fold the softmax regression of all rows outside it, for rows (fold, true_id, features
    array): features are standardised by the training rows, the ridge is 1 / ``c``, the intercepts
    have none. ``weights``: "none", "balanced", or an exponent a for (training rows of the class)
    ** -a.

    All folds take their steps together: a pass over the rows sums every fold's loss and gradient in
    the tasks, and the driver has one vector of classes x features for each fold.
    """
    data = cut(rows.select(F.col("fold").cast("int").alias("fold"), F.col("true_id").cast("int").alias("true_id"), "features"))
    counts: dict[int, np.ndarray] = {}
    # a row for each fold and class
    for f, y, n in data.groupBy("fold", "true_id").count().collect():
        counts.setdefault(f, np.zeros(labels, np.int64))[y] = n
    sums = moments(data)

    def weight(n: np.ndarray) -> np.ndarray:
        if weights == "none":
            return np.ones_like(n)
        return n.sum() / (len(n) * n) if weights == "balanced" else n ** -float(weights)

    problems, paths = {}, {}
    for f in sums:
        others = [g for g in sums if g != f]
        if others:
            problems[f] = FoldProblem(sum(sums[g] for g in others), sum(counts[g] for g in others), weight, c)
            paths[f] = _Descent(problems[f], len(sums[f]))
    for _ in range(STEPS):
        at = {f: p.propose() for f, p in paths.items() if not p.done}
        if not at:
            break
        for f, (loss, grad) in _gradients(data, problems, at).items():
            paths[f].take(at[f], loss, grad)
    else:
        raise ValueError(f"no end after {STEPS} steps")
    return problems, {f: p.w for f, p in paths.items()}


def out_of_fold(rows: DataFrame, labels: int, weights: str | float = 0.25, c: float = 1.0) -> DataFrame:
    """(id, fold, true_id, pred_id, probs) for rows (id, fold, true_id, features array): each fold is
    predicted by ``fit_folds``' model of the other folds. Classes that a model hasn't seen have
    probability 0. With a single fold there is nothing to learn from, and no rows."""
    problems, fitted = fit_folds(rows, labels, weights, c)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fold, probs = batch.column(1).to_numpy(), np.zeros((batch.num_rows, labels))
            x = _matrix(batch, 3) if batch.num_rows else np.zeros((0, 1))
            for f in np.unique(fold).tolist():
                own, p = fold == f, problems[f]
                probs[np.ix_(own, p.classes)] = np.exp(_log_probs(p.standard(x[own]) @ fitted[f].T))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, probs.size + 1, labels), pa.int32()), pa.array(probs.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(probs.argmax(axis=1).astype("i4")), lists], names=["id", "fold", "true_id", "pred_id", "probs"])

    known = rows.select(F.col("id").cast("long"), F.col("fold").cast("int").alias("fold"), F.col("true_id").cast("int"), "features")
    some = known.filter(F.col("fold").isin(list(problems)) if problems else F.lit(False))
    return some.mapInArrow(run, "id long, fold int, true_id int, pred_id int, probs array<double>")


def score_with(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Batch scoring: ``load`` runs once in each task and returns what scores a batch."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in it:
            yield model(batch)

    return rows.mapInPandas(run, schema)


class Throughput:
    """Rows and seconds of a scoring run by fold, observed while it runs, without a second pass.

    ``scored`` wraps the run; once its result has been written or collected, ``table`` has a row for
    each of ``folds``: rows, the seconds that its rows took in tasks (a batch's seconds are shared by
    its rows), and rows a second of the whole run.
    """

    def __init__(self, folds: list[int]):
        self.folds, self.seen, self.began = folds, Observation(), 0.0

    def scored(self, rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, fold: str = "fold") -> DataFrame:
        def timed() -> Callable[[pd.DataFrame], pd.DataFrame]:
            model = load()

            def run(batch: pd.DataFrame) -> pd.DataFrame:
                began = time.perf_counter()
                out = model(batch)
                return out.assign(_seconds=(time.perf_counter() - began) / max(len(out), 1))

            return run

        done = score_with(rows, timed, schema + ", _seconds double")
        own = [x for f in self.folds for x in (F.count_if(F.col(fold) == f).alias(f"n{f}"), F.coalesce(F.sum(F.when(F.col(fold) == f, F.col("_seconds"))), F.lit(0.0)).alias(f"s{f}"))]
        self.began = time.time()
        return done.observe(self.seen, F.count(F.lit(1)).alias("n"), *own).drop("_seconds")

    def table(self, spark) -> DataFrame:
        found = self.seen.get  # waits for the run's end
        wall = max(time.time() - self.began, 1e-9)
        rows = [(f, found[f"n{f}"], found[f"s{f}"], wall, found[f"n{f}"] / wall) for f in self.folds]
        return spark.createDataFrame(rows, "fold int, rows long, task_seconds double, wall_seconds double, rows_per_second double")
