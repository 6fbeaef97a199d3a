"""Holdout evaluation: ROC-AUC, average precision, threshold metrics, confusion.

The curve metrics need, for every distinct score, the positives and negatives
with a strictly higher score.  A window without a partition key would run in a
single task, so the cumulation is distributed instead:

1. counts per distinct score (partial aggregation), range-partitioned by score
   and written once, each row with its partition;
2. totals per partition give offsets (one row per partition, broadcast);
3. running sums inside each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ACTUAL_LABELS, DECISION_THRESHOLD, PREDICTED_LABELS
from ..session import materialize


def score_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) != 1).cast("long")).alias("neg"))


def cumulative_from_top(counts: DataFrame, slices: int | None = None) -> DataFrame:
    """Add pos_above / neg_above: counts at strictly higher scores (distributed prefix sum).

    ``slices`` fixes the number of range partitions (default: sized by AQE)."""
    by_score = [F.desc("score")]
    ranged = counts.repartitionByRange(slices, *by_score) if slices else counts.repartitionByRange(*by_score)
    ranged = materialize(ranged.withColumn("slice", F.spark_partition_id()), "score-counts")
    totals = ranged.groupBy("slice").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offsets = totals.select(
        "slice",
        F.coalesce(F.sum("tp").over(before), F.lit(0)).alias("pos_off"),
        F.coalesce(F.sum("tn").over(before), F.lit(0)).alias("neg_off"))
    inner = Window.partitionBy("slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(F.broadcast(offsets), "slice")
            .withColumn("pos_above", F.col("pos_off") + F.coalesce(F.sum("pos").over(inner), F.lit(0)))
            .withColumn("neg_above", F.col("neg_off") + F.coalesce(F.sum("neg").over(inner), F.lit(0)))
            .drop("pos_off", "neg_off"))


def curve_metrics(df: DataFrame, score: str = "score", label: str = "label",
                  slices: int | None = None) -> DataFrame:
    """M11 ROC-AUC (ties count half) and M12 average precision, one row."""
    cum = cumulative_from_top(score_counts(df, score, label), slices)
    P, N = F.sum("pos"), F.sum("neg")
    tp_at = F.col("pos_above") + F.col("pos")
    fp_at = F.col("neg_above") + F.col("neg")
    # undefined (NULL) when the holdout holds a single class
    return cum.agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") * 0.5)),
                     (P * N).cast("double")).alias("roc_auc"),
        F.try_divide(F.sum(F.when(F.col("pos") > 0, F.col("pos") * tp_at / (tp_at + fp_at))),
                     P.cast("double")).alias("average_precision"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return curve_metrics(df, score, label).select("roc_auc")


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return curve_metrics(df, score, label).select("average_precision")


def _counts(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    pred = (F.col(score) >= threshold)
    act = (F.col(label) == 1)
    s = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return df.agg(s(act & pred).alias("tp"), s(~act & pred).alias("fp"),
                  s(~act & ~pred).alias("tn"), s(act & ~pred).alias("fn"))


def classification_metrics(df: DataFrame, score: str = "score", label: str = "label",
                           threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Accuracy, precision, recall, F1 for wins at p >= threshold; 0 when undefined."""
    c = _counts(df, score, label, threshold)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    z = lambda e: F.coalesce(e, F.lit(0.0))
    return c.select(
        z(F.try_divide(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
        z(F.try_divide(tp, tp + fp)).alias("precision_win"),
        z(F.try_divide(tp, tp + fn)).alias("recall_win"),
        z(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1_win"))


def confusion_matrix(df: DataFrame, score: str = "score", label: str = "label",
                     threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """[[TN, FP], [FN, TP]] as four labelled rows."""
    c = _counts(df, score, label, threshold)
    (loss, win), (said_loss, said_win) = ACTUAL_LABELS, PREDICTED_LABELS
    return c.select(F.stack(F.lit(4), F.lit(loss), F.lit(said_loss), F.col("tn"), F.lit(loss), F.lit(said_win), F.col("fp"),
                            F.lit(win), F.lit(said_loss), F.col("fn"), F.lit(win), F.lit(said_win), F.col("tp"))
                    .alias("actual", "predicted", "n"))
