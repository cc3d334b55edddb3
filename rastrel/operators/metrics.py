"""Classification metrics, losses and the choice of the best epoch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import IGNORED


def predicted(l0: Column, l1: Column) -> Column:
    return F.when(l1 > l0, 1).otherwise(0)


def binary_metrics(rows: DataFrame, by: list[str] | None = None, y: str = "y", pred: str = "pred") -> DataFrame:
    """n, tp, fp, fn, tn, precision, recall, f1, accuracy of class 1 over rows that aren't ignored; 0 where undefined."""
    by = by or []
    hit = lambda a, b: F.count(F.when((F.col(y) == a) & (F.col(pred) == b), 1))
    counts = rows.where(F.col(y) != IGNORED).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*by, "n", "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + F.col("tn"), F.col("n")).alias("accuracy"))


def batch_losses(rows: DataFrame, batch: str = "batch", y: str = "y", p1: str = "p1") -> DataFrame:
    """batch, loss: mean cross-entropy over the labelled rows of each batch; NaN if it has none."""
    py = F.when(F.col(y) == 1, F.col(p1)).when(F.col(y) == 0, 1 - F.col(p1))
    return rows.groupBy(batch).agg(F.coalesce(F.avg(-F.log(py)), F.lit(float("nan"))).alias("loss"))


def epoch_loss(batches: DataFrame) -> DataFrame:
    """Unweighted mean of the batches' losses."""
    return batches.agg(F.count(F.lit(1)).alias("n_batches"), F.avg("loss").alias("loss"))


def batched(rows: DataFrame, index: str, size: int, drop_last: bool = False) -> DataFrame:
    """Adds batch (from 0) of `size` rows by a gapless index; an incomplete last batch can be dropped."""
    d = rows.withColumn("batch", F.floor(F.col(index) / size).cast("long"))
    if not drop_last:
        return d
    whole = d.groupBy("batch").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).select("batch")
    return d.join(whole, "batch", "left_semi")


def best_epoch(log: DataFrame, patience: int, by: list[str] | None = None) -> DataFrame:
    """Epochs that ran, with improved (strictly better than all before) and the wait since the last of these.

    Training stops at the first epoch whose wait reaches `patience`; later rows of the log are left out.
    """
    w = Window.partitionBy(*(by or [])).orderBy("epoch")
    before = F.max("f1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = log.withColumn("improved", F.col("f1") > F.coalesce(before, F.lit(float("-inf"))))
    last = F.coalesce(F.max(F.when(F.col("improved"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    d = d.withColumn("best_epoch", last).withColumn("wait", F.col("epoch") - last)
    stopped = F.coalesce(F.max("wait").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_stopped", stopped >= patience).where(~F.col("_stopped")).drop("_stopped")


@dataclass
class Plateau:
    """Learning rate that falls by `factor`, down to `least`, after more than `patience` epochs without a better f1."""

    rate: float = 1e-4
    factor: float = 0.5
    patience: int = 5
    least: float = 1e-6
    threshold: float = 1e-4
    best: float = float("-inf")
    bad: int = 0

    def step(self, f1: float) -> float:
        """The rate after an epoch that reached f1."""
        if f1 > (self.best * (1 + self.threshold) if self.best > 0 else self.best):
            self.best, self.bad = f1, 0
        else:
            self.bad += 1
        if self.bad > self.patience:
            self.rate, self.bad = max(self.rate * self.factor, self.least), 0
        return self.rate


def learning_rates(log: DataFrame, rate: float = 1e-4, patience: int = 5, factor: float = 0.5, least: float = 1e-6, threshold: float = 1e-4, by: Sequence[str] = ()) -> DataFrame:
    """`by`, epoch, rate (after the epoch) of `Plateau` replayed over logs (by, epoch, f1), one for each run.

    A run's epochs are folded in order by one expression: all runs in one job, a row for each epoch.
    """
    runs = log.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("epoch", "f1"))).alias("_log"))
    number = lambda v, k: F.lit(v).cast(k)
    empty = F.array().cast(f"array<struct<epoch:{log.schema['epoch'].dataType.simpleString()},rate:double>>")
    start = F.struct(number(float("-inf"), "double").alias("best"), number(0, "int").alias("bad"), number(rate, "double").alias("rate"), empty.alias("out"))

    def step(s, x):
        better = x["f1"] > F.when(s["best"] > 0, s["best"] * (1 + threshold)).otherwise(s["best"])
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        falls = bad > patience
        now = F.when(falls, F.greatest(s["rate"] * factor, F.lit(least))).otherwise(s["rate"])
        row = F.struct(x["epoch"].alias("epoch"), now.alias("rate"))
        return F.struct(F.when(better, x["f1"].cast("double")).otherwise(s["best"]).alias("best"), F.when(falls, 0).otherwise(bad).alias("bad"), now.alias("rate"), F.concat(s["out"], F.array(row)).alias("out"))

    folded = runs.select(*by, F.explode(F.aggregate("_log", start, step, lambda s: s["out"])).alias("x"))
    return folded.select(*by, "x.epoch", "x.rate")


def observed(rows: DataFrame, y: str = "y", pred: str = "pred") -> tuple[DataFrame, Observation]:
    """`rows`, and their counts n, tp, fp, fn, tn, which the first action over them fills in on its way."""
    seen, real = Observation(), F.col(y) != IGNORED
    hit = lambda a, b: F.count(F.when((F.col(y) == a) & (F.col(pred) == b), 1))
    return rows.observe(seen, F.count(F.when(real, 1)).alias("n"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn")), seen


def rates(n: int, tp: int, fp: int, fn: int, tn: int) -> dict[str, float]:
    """precision, recall, f1, accuracy of class 1; 0 where undefined."""
    ratio = lambda a, b: a / b if b else 0.0
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, n)}


LOG = "run string, epoch int, n long, tp long, fp long, fn long, tn long, precision double, recall double, f1 double, accuracy double, loss double"


def append_log(spark: SparkSession, path: str, run: str, epoch: int, seen: Observation, loss: float | None = None) -> dict[str, float]:
    """Append what was observed to the log table under `path`, one row an epoch; returns the row's metrics."""
    counts = {k: int(v or 0) for k, v in seen.get.items()}
    made = rates(**counts)
    spark.createDataFrame([(run, epoch, *(counts[k] for k in ("n", "tp", "fp", "fn", "tn")), *made.values(), loss)], LOG).write.mode("append").parquet(path)
    return made
