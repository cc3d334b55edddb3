"""Training of the linear scorer: full batches or mini-batches, Adam, plateau schedule, early stop, best checkpoint; whole runs by configuration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import IGNORED
from ..operators import loader
from ..operators.metrics import Plateau, append_log, binary_metrics, observed, predicted
from ..session import new_folder, ship_package, staged
from ..sources import config, weights


@dataclass
class Fitted:
    """Weights and bias of the best epoch, and the log (epoch, loss, f1, rate)."""

    weights: list[float]
    bias: float
    best_epoch: int = 0
    log: list[tuple[int, float, float, float]] = field(default_factory=list)
    last: list[float] = field(default_factory=list)


def _logit(weights: list[float], bias: float):
    out = F.lit(float(bias))
    for i, w in enumerate(weights):
        out = out + F.get("f", F.lit(i)) * F.lit(float(w))
    return out


def fit_linear(train: DataFrame, validate: DataFrame, num_bands: int, epochs: int = 100, rate: float = 1e-4, patience: int = 20) -> Fitted:
    """Rows are f (array of bands) and y (1, 0, or ignored). An epoch is one partial-aggregated pass over the rows.

    The gradient's sums, one for each band, are all that reaches the driver. The best epoch is the first with the
    highest validation F1; training stops after `patience` epochs without a better one.
    """
    train, validate = (d.where(F.col("y") != IGNORED).select("f", "y").persist() for d in (train, validate))
    w, m1, m2 = [0.0] * (num_bands + 1), [0.0] * (num_bands + 1), [0.0] * (num_bands + 1)
    best, out, bad, schedule = float("-inf"), Fitted(w[:-1], w[-1]), 0, Plateau(rate)
    for epoch in range(1, epochs + 1):
        p = 1 / (1 + F.exp(-_logit(w[:-1], w[-1])))
        error = p - F.col("y")
        rows = train.withColumn("_e", error).withColumn("_l", -F.log(F.greatest(F.when(F.col("y") == 1, p).otherwise(1 - p), F.lit(1e-12))))
        sums = rows.agg(F.count(F.lit(1)), F.avg("_l"), *[F.avg(F.col("_e") * F.get("f", F.lit(i))) for i in range(num_bands)], F.avg("_e")).first()
        if not sums[0]:
            raise ValueError("no labelled rows to train on")
        for i, g in enumerate(sums[2:]):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.999 * m2[i] + 0.001 * g * g
            w[i] -= rate * (m1[i] / (1 - 0.9**epoch)) / (math.sqrt(m2[i] / (1 - 0.999**epoch)) + 1e-8)
        scored = validate.select("y", predicted(F.lit(0.0), _logit(w[:-1], w[-1])).alias("pred"))
        row = binary_metrics(scored).first()
        f1 = row["f1"] if row else 0.0
        out.log.append((epoch, float(sums[1]), float(f1), rate))
        if f1 > best:
            best, bad = f1, 0
            out.weights, out.bias, out.best_epoch = w[:-1], w[-1], epoch
        else:
            bad += 1
            if bad >= patience:
                break
        rate = schedule.step(f1)
    train.unpersist()
    validate.unpersist()
    return out


def evaluate_linear(test: DataFrame, fitted: Fitted) -> DataFrame:
    """Metrics of the best epoch's weights on held-out rows."""
    return binary_metrics(test.select("y", predicted(F.lit(0.0), _logit(fitted.weights, fitted.bias)).alias("pred")))


@dataclass
class Adam:
    """Parameters (bands, then the bias) and Adam's moments."""

    w: np.ndarray
    m1: np.ndarray
    m2: np.ndarray
    steps: int = 0

    @classmethod
    def fresh(cls, n: int) -> Adam:
        return cls(np.zeros(n), np.zeros(n), np.zeros(n))

    def batch(self, f: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One step on the labelled rows of a batch; its mean loss. A batch without labelled rows changes nothing (NaN)."""
        on = y != IGNORED
        if not on.any():
            return float("nan")
        f, y = f[on], y[on]
        p = 1 / (1 + np.exp(-(f @ self.w[:-1] + self.w[-1])))
        loss = float(-np.log(np.maximum(np.where(y == 1, p, 1 - p), 1e-12)).mean())
        g = np.append((p - y) @ f, (p - y).sum()) / len(y)
        self.steps += 1
        self.m1 = 0.9 * self.m1 + 0.1 * g
        self.m2 = 0.999 * self.m2 + 0.001 * g * g
        self.w = self.w - rate * (self.m1 / (1 - 0.9**self.steps)) / (np.sqrt(self.m2 / (1 - 0.999**self.steps)) + 1e-8)
        return loss


def _steps(start: Adam, rate: float):
    """Adam over a partition's batches, which come in order; one row: its parameters, moments and losses."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Adam(start.w, start.m1, start.m2, start.steps)
        n = total = 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None

        def step():
            nonlocal n, total
            loss = own.batch(np.concatenate([f for f, _ in held]), np.concatenate([y for _, y in held]), rate)
            if not math.isnan(loss):
                n, total = n + 1, total + loss

        for part in parts:
            batch, y = part["batch"].to_numpy(), part["y"].to_numpy()
            f = part["f"].flatten().to_numpy().reshape(len(y), -1)
            cuts = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and batch[lo] != last:
                    step()
                    held = []
                last = batch[lo]
                held.append((f[lo:hi], y[lo:hi]))
        if held:
            step()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([list(own.w)]), pa.array([list(own.m1)]), pa.array([list(own.m2)]), pa.array([own.steps], pa.int64()), pa.array([n], pa.int64()), pa.array([float(total)])], ["w", "m1", "m2", "steps", "n", "loss"])

    return run


def fit_batches(train: DataFrame, validate: DataFrame, num_bands: int, size: int = 8, epochs: int = 100, rate: float = 1e-4, patience: int = 20, workers: int = 1, seed: int = 0, log: str | None = None) -> Fitted:
    """Rows are key (distinct), f (array of bands) and y. Each epoch shuffles the rows anew and drops an incomplete last batch.

    A worker takes every workers-th batch, in order, and steps through them from the epoch's start; the workers'
    parameters and moments are averaged by their batches. One worker is plain mini-batch training. An epoch's loss is
    the mean of its batches' losses. Validation counts are observed in the pass that predicts and appended to `log`.
    """
    spark = train.sparkSession
    ship_package(spark)
    rows = staged(loader.indexed(train.select("key", F.col("f").cast("array<double>").alias("f"), F.col("y").cast("long").alias("y")), "key"), "train-rows")
    n = rows.count()
    validate = validate.where(F.col("y") != IGNORED).select("f", "y").persist()
    at, schedule, bad, best = Adam.fresh(num_bands + 1), Plateau(rate), 0, float("-inf")
    out = Fitted([0.0] * num_bands, 0.0)
    log = log or new_folder(spark, "training-log")
    for epoch in range(1, epochs + 1):
        dealt = loader.batches(rows, n, size, epoch, seed, drop_last=True).withColumn("worker", F.col("batch") % workers)
        dealt = dealt.repartition(workers, "worker").sortWithinPartitions("batch", "place") if workers > 1 else dealt.coalesce(1).sortWithinPartitions("batch", "place")
        made = dealt.select("batch", "f", "y").mapInArrow(_steps(at, rate), "w array<double>, m1 array<double>, m2 array<double>, steps long, n long, loss double").collect()  # a row for each worker
        if not made:
            raise ValueError("no batch with labelled rows to train on")
        share = np.array([r["n"] for r in made], float)
        share /= share.sum()
        w, m1, m2 = (np.einsum("i,ij->j", share, np.array([r[c] for r in made])) for c in ("w", "m1", "m2"))
        at = Adam(w, m1, m2, max(r["steps"] for r in made))
        loss = sum(r["loss"] for r in made) / sum(r["n"] for r in made)
        scored, seen = observed(validate.select("y", predicted(F.lit(0.0), _logit(list(w[:-1]), float(w[-1]))).alias("pred")))
        scored.write.format("noop").mode("overwrite").save()
        f1 = append_log(spark, log, "validate", epoch, seen, loss)["f1"]
        out.log.append((epoch, float(loss), float(f1), rate))
        if f1 > best:
            best, bad = f1, 0
            out.weights, out.bias, out.best_epoch = [float(x) for x in w[:-1]], float(w[-1]), epoch
        else:
            bad += 1
            if bad >= patience:
                break
        rate = schedule.step(f1)
    out.last = [float(x) for x in w]
    validate.unpersist()
    return out


NONE = {"n": 0, "tp": 0, "fp": 0, "fn": 0, "tn": 0, "precision": 0.0, "recall": 0.0, "f1": 0.0, "accuracy": 0.0}


def test(rows: DataFrame, path: str) -> DataFrame:
    """Metrics of the best weights under `path` on held-out rows (f, y); zeros if there are none or no row is labelled."""
    spark = rows.sparkSession
    try:
        found = weights.read(spark, f"{path}/best")
    except AnalysisException:  # nothing was trained
        found = {}
    if not found:
        return spark.createDataFrame([tuple(NONE.values())], ", ".join(f"`{k}` {'long' if isinstance(v, int) else 'double'}" for k, v in NONE.items()))
    return evaluate_linear(rows, Fitted([float(x) for x in found["linear.weight"].ravel()], float(found["linear.bias"].ravel()[0])))


#: Parameters of a training run, by their names in the configuration.
PARAMETERS = ("train_output", "num_epochs", "lr", "patience", "batch_size", "num_bands")


def run(params: DataFrame, splits: dict[str, DataFrame], workers: int = 1, seed: int = 0) -> DataFrame:
    """A training run by configuration rows (position, name, value) that hold PARAMETERS.

    splits: `train`, `val` and `test` rows (key, f, y). Under train_output: `best` and `last` weights and the `log`.
    Returns the test's metrics.
    """
    path, epochs, rate, patience, size, bands = config.project(params, PARAMETERS)
    spark = params.sparkSession
    fit = fit_batches(splits["train"], splits["val"], int(bands), int(size), int(epochs), float(rate), int(patience), workers, seed, f"{path}/log")
    layers = lambda w: {"linear.weight": np.array([w[:-1]]), "linear.bias": np.array(w[-1:])}
    weights.write(spark, layers([*fit.weights, fit.bias]), f"{path}/best")
    weights.write(spark, layers(fit.last), f"{path}/last")
    return test(splits["test"], path)
