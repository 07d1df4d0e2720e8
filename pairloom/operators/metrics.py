"""Confusion matrices, accuracies, precision and recall, losses and epoch choice.

Predictions are rows with label and pred. Every metric starts from the counts of (label, pred), summed before the
shuffle: after that the work is classes x classes rows, whatever the number of predictions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import before_row


def _pair_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("label").cast("int").alias("label"), F.col("pred").cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("count"))


def _grid(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("c").alias("label"), F.explode("all").alias("pred"))


def confusion_matrix(rows: DataFrame, classes: int | None = 4) -> DataFrame:
    """label, pred, count for all classes, or (classes None) for those that occur as label or prediction."""
    counts = _pair_counts(rows)
    if classes is None:
        seen = counts.select(F.explode(F.array("label", "pred")).alias("c")).distinct()
        every = seen.agg(F.sort_array(F.collect_set("c")).alias("all"))  # as long as there are classes
        grid = _grid(every.select("all", F.explode("all").alias("c")))
    else:
        numbers = F.array(*[F.lit(c) for c in range(classes)])
        grid = _grid(rows.sparkSession.range(1).select(numbers.alias("all"), F.explode(numbers).alias("c")))
    d = grid.join(counts, ["label", "pred"], "left")
    return d.select("label", "pred", F.coalesce("count", F.lit(0)).alias("count"))


def _per_class(rows: DataFrame, classes: int) -> DataFrame:
    """label, tp, truth and guessed of every class."""
    m = confusion_matrix(rows, classes)
    truth = m.groupBy("label").agg(F.sum(F.when(F.col("label") == F.col("pred"), F.col("count")).otherwise(0)).alias("tp"), F.sum("count").alias("truth"))
    guessed = m.groupBy(F.col("pred").alias("label")).agg(F.sum("count").alias("guessed"))
    return truth.join(guessed, "label")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def class_accuracies(rows: DataFrame, classes: int = 4) -> DataFrame:
    """label and accuracy of every class; 0 for a class without rows."""
    return _per_class(rows, classes).select("label", _ratio(F.col("tp"), F.col("truth")).alias("accuracy"))


def present_class_accuracies(rows: DataFrame) -> DataFrame:
    """label and accuracy of the classes that have rows."""
    return rows.groupBy("label").agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"))


def overall_accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"))


def accuracy_summary(rows: DataFrame, classes: int = 4) -> DataFrame:
    """macro_accuracy (absent classes count 0) and overall_accuracy, one row."""
    # Over all predictions, also those of labels outside the classes.
    hit = F.sum(F.when(F.col("label") == F.col("pred"), F.col("count")).otherwise(0)) / F.sum("count")
    per = class_accuracies(rows, classes).agg(F.avg("accuracy").alias("macro_accuracy"))
    return per.withColumn("_k", F.lit(1)).join(_pair_counts(rows).agg(hit.alias("overall_accuracy")).withColumn("_k", F.lit(1)), "_k").drop("_k")


def precision_recall_f1(rows: DataFrame, classes: int = 4) -> DataFrame:
    """label, precision, recall, f1 of every class; 0 where nothing can be divided."""
    d = _per_class(rows, classes).select("label", _ratio(F.col("tp"), F.col("guessed")).alias("precision"), _ratio(F.col("tp"), F.col("truth")).alias("recall"))
    return d.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_precision_recall_f1(rows: DataFrame, classes: int = 4) -> DataFrame:
    return precision_recall_f1(rows, classes).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def batch_losses(rows: DataFrame, class_weights: list[float] | None = None) -> DataFrame:
    """batch, loss (weighted mean) and n, from rows of batch, label and loss."""
    w = F.lit(1.0) if class_weights is None else F.get(F.array(*[F.lit(float(x)) for x in class_weights]), F.col("label").cast("int"))
    return rows.groupBy("batch").agg((F.sum(w * F.col("loss")) / F.sum(w)).alias("loss"), F.count(F.lit(1)).alias("n"))


def running_loss(rows: DataFrame, class_weights: list[float] | None = None) -> DataFrame:
    """The batches' weighted mean losses, averaged by batch size: not the weighted mean over all rows."""
    return batch_losses(rows, class_weights).agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def cross_entropy(logits: Column, label: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return top + F.log(total) - F.get(logits, label.cast("int"))


def best_epoch(log: DataFrame) -> DataFrame:
    """The first epoch with the highest score above 0 (epoch, score); no row if none is."""
    return log.where("score > 0").agg(F.max_by(F.struct("epoch", "score"), F.struct("score", -F.col("epoch"))).alias("b")).where("b IS NOT NULL").select("b.*")


def improvements(log: DataFrame) -> DataFrame:
    """The epochs at which a checkpoint is written: score above all before and above 0. The log has a row an epoch."""
    d = before_row(log, "epoch", F.col("score"), "_b", largest=True)
    return d.where(F.col("score") > F.greatest(F.coalesce("_b", F.lit(0.0)), F.lit(0.0))).select("epoch", "score")
