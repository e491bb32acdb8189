"""Classifier evaluation (V1-V7): confusion counts, metrics, ROC/PR curves, AUC.

Curves reduce the scored rows to one row per distinct score first (partial
aggregation), then take running sums over the descending scores with the
range-partitioned helper instead of a single-partition window. The trapezoid
for the AUC needs only each point and its predecessor, and the predecessor is
the running sum minus the point's own counts, so no ``lag`` is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.ranking import ordered_running
from .text import _c


def confusion(scored: DataFrame, label_col: str = "label", score_col: str = "score",
              threshold: float = 0.5) -> DataFrame:
    """V1: one row (tp, fp, tn, fn) with prediction = score >= threshold."""
    pred = F.col(score_col) >= F.lit(threshold)
    y = F.col(label_col)
    return scored.agg(
        F.count_if(pred & (y == 1)).alias("tp"),
        F.count_if(pred & (y == 0)).alias("fp"),
        F.count_if(~pred & (y == 0)).alias("tn"),
        F.count_if(~pred & (y == 1)).alias("fn"),
    )


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    """V2 + V6: accuracy, precision, recall, F1 (zero-safe) and the overfit flag."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    precision = _div(tp, tp + fp)
    recall = _div(tp, tp + fn)
    accuracy = _div(tp + tn, F.greatest(total, F.lit(1.0)))
    out = cm.select(
        "tp", "fp", "tn", "fn",
        accuracy.alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
    )
    f1 = _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).withColumn("overfit", F.col("accuracy") > F.lit(L.OVERFIT_ACCURACY))


def _score_groups(scored: DataFrame, label_col: str, score_col: str) -> DataFrame:
    y = F.col(label_col)
    return scored.groupBy(F.col(score_col).alias("score")).agg(
        F.count_if(y == 1).cast("double").alias("tp_g"),
        F.count_if(y != 1).cast("double").alias("fp_g"),
        F.count_if(y == 0).cast("double").alias("neg_g"),
    )


def _cumulative(scored: DataFrame, label_col: str, score_col: str) -> DataFrame:
    g = _score_groups(scored, label_col, score_col).withColumn("neg_score", -F.col("score"))
    return ordered_running(g, ["neg_score"], ["tp_g", "fp_g", "neg_g"], rank_col="point")


def roc_curve(scored: DataFrame, label_col: str = "label", score_col: str = "score") -> DataFrame:
    """V3: (point, threshold, fpr, tpr, fpr_prev, tpr_prev); point 0 is (0, 0) at top score + 1.

    Fails at run time unless both classes are present.
    """
    c = _cumulative(scored, label_col, score_col)
    pos, neg = F.col("total_tp_g"), F.col("total_neg_g")
    bad = (pos == 0) | (neg == 0)
    fpr = F.when(bad, F.raise_error(F.lit("Both positive and negative samples are required to compute ROC"))
                 ).otherwise(_div(F.col("cum_fp_g"), neg))
    point = F.struct(
        F.col("point").cast("long").alias("point"), F.col("score").alias("threshold"),
        fpr.alias("fpr"), _div(F.col("cum_tp_g"), pos).alias("tpr"),
        _div(F.col("cum_fp_g") - F.col("fp_g"), neg).alias("fpr_prev"),
        _div(F.col("cum_tp_g") - F.col("tp_g"), pos).alias("tpr_prev"),
    )
    origin = F.struct(
        F.lit(0).cast("long").alias("point"), (F.col("score") + 1.0).alias("threshold"),
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
        F.lit(None).cast("double").alias("fpr_prev"), F.lit(None).cast("double").alias("tpr_prev"),
    )
    rows = F.when(F.col("point") == 1, F.array(origin, point)).otherwise(F.array(point))
    return c.select(F.explode(rows).alias("p")).select("p.*")


def roc_auc(roc: DataFrame) -> DataFrame:
    """V4: trapezoid area under the ROC points (one row)."""
    area = (F.col("fpr") - F.col("fpr_prev")) * (F.col("tpr") + F.col("tpr_prev")) / 2.0
    return roc.filter(F.col("point") > 0).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("roc_auc"))


def pr_curve(scored: DataFrame, label_col: str = "label", score_col: str = "score") -> DataFrame:
    """V5: (point, threshold, precision, recall); point 0 is precision 1, recall 0, no threshold.

    Fails at run time when there is no positive row.
    """
    c = _cumulative(scored, label_col, score_col)
    pos = F.col("total_tp_g")
    tp, fp = F.col("cum_tp_g"), F.col("cum_fp_g")
    recall = F.when(pos == 0, F.raise_error(
        F.lit("At least one positive sample is required to compute precision/recall"))).otherwise(_div(tp, pos))
    point = F.struct(F.col("point").cast("long").alias("point"), F.col("score").alias("threshold"),
                     _div(tp, tp + fp).alias("precision"), recall.alias("recall"))
    origin = F.struct(F.lit(0).cast("long").alias("point"), F.lit(None).cast("double").alias("threshold"),
                      F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    rows = F.when(F.col("point") == 1, F.array(origin, point)).otherwise(F.array(point))
    return c.select(F.explode(rows).alias("p")).select("p.*")


METRIC_ORDER = ["accuracy", "precision", "recall", "f1", "roc_auc", "tp", "fp", "tn", "fn"]


def evaluate(scored: DataFrame, label_col: str = "label", score_col: str = "score",
             threshold: float = 0.5) -> DataFrame:
    """V7: long table (metric, value) — V1, V2, V4 and the V6 overfit flag as 0/1."""
    cm = metrics_from_confusion(confusion(scored, label_col, score_col, threshold))
    stacked = cm.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
        for n in ["accuracy", "precision", "recall", "f1", "tp", "fp", "tn", "fn", "overfit"]
    ])).alias("m")).select("m.metric", "m.value")
    auc = roc_auc(roc_curve(scored, label_col, score_col)).select(
        F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
    return stacked.unionByName(auc)


def stratified_split(df: DataFrame, id_col: str = "id", label_col: str = "label",
                     test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """M9: per label, train = first max(1, floor(n (1 - test))) rows in a seeded hash order;
    test = the rest, or the group's last row when the rest is empty.

    Adds ``split_rank``, ``is_train`` and ``is_test``. The order is md5 of
    ``id:seed`` (portable across engines); ranking runs range-partitioned.
    """
    keyed = df.withColumn("_h", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))))
    slices = F.conv(F.substring("_h", 1, 2), 16, 10).cast("int")  # 256 even slices along the hash
    r = ordered_running(keyed, ["_h", id_col], group_cols=[label_col], rank_col="split_rank", slice_expr=slices)
    sp = F.greatest(F.lit(1), F.floor(F.col("group_rows") * (1.0 - test_size)))
    n = F.col("group_rows")
    rank = F.col("split_rank")
    return r.select(
        *df.columns, rank.alias("split_rank"),
        (rank <= sp).alias("is_train"),
        ((rank > sp) | ((sp >= n) & (rank == n))).alias("is_test"),
    )
