"""Metrics and losses as Spark aggregates of truth ``y`` and score ``p`` (or class columns)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import running

EPS = 1e-7


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _hit(p, threshold: float) -> Column:
    return _c(p) >= threshold


def accuracy(y, p, threshold: float = 0.5) -> Column:
    return F.avg(((_c(y) >= 0.5) == _hit(p, threshold)).cast("double"))


def class_accuracy(y, predicted) -> Column:
    return F.avg((_c(y) == _c(predicted)).cast("double"))


def top_k_accuracy(y, scores, k: int = 5) -> Column:
    """Share of rows whose true class has fewer than k classes with greater scores."""
    own = F.get(_c(scores), _c(y).cast("int"))
    return F.avg((F.size(F.filter(_c(scores), lambda s: s > own)) < k).cast("double"))


def true_positives(y, p, threshold: float = 0.5) -> Column:
    return F.count_if((_c(y) >= 0.5) & _hit(p, threshold))


def false_positives(y, p, threshold: float = 0.5) -> Column:
    return F.count_if((_c(y) < 0.5) & _hit(p, threshold))


def true_negatives(y, p, threshold: float = 0.5) -> Column:
    return F.count_if((_c(y) < 0.5) & ~_hit(p, threshold))


def false_negatives(y, p, threshold: float = 0.5) -> Column:
    return F.count_if((_c(y) >= 0.5) & ~_hit(p, threshold))


def precision(y, p, threshold: float = 0.5) -> Column:
    tp = true_positives(y, p, threshold)
    return F.try_divide(tp, tp + false_positives(y, p, threshold))


def recall(y, p, threshold: float = 0.5) -> Column:
    tp = true_positives(y, p, threshold)
    return F.try_divide(tp, tp + false_negatives(y, p, threshold))


def f_score_loss(y, p, beta: float = 1.0, eps: float = 1e-6) -> Column:
    """1 - F(beta) from the soft sums of scores."""
    t, s = _c(y), _c(p)
    tp, fp, fn = F.sum(t * s), F.sum((1 - t) * s), F.sum(t * (1 - s))
    b2 = beta * beta
    prec, rec = tp / (tp + fp + eps), tp / (tp + fn + eps)
    return 1 - (1 + b2) * prec * rec / (b2 * prec + rec + eps)


def _mean(fn: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda y, p: F.avg(fn(_c(y).cast("double"), _c(p).cast("double")))


def _log_cosh(y: Column, p: Column) -> Column:
    d = F.abs(p - y)
    return d + F.log1p(F.exp(-2 * d)) - F.ln(F.lit(2.0))


def _bounded(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


mean_squared_error = _mean(lambda y, p: (y - p) * (y - p))
mean_absolute_error = _mean(lambda y, p: F.abs(y - p))
mean_absolute_percentage_error = _mean(lambda y, p: 100 * F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPS)))
mean_squared_logarithmic_error = _mean(lambda y, p: F.pow(F.log1p(F.greatest(y, F.lit(EPS))) - F.log1p(F.greatest(p, F.lit(EPS))), F.lit(2.0)))
mean_relative_error = _mean(lambda y, p: F.coalesce(F.try_divide(F.abs(y - p), y), F.lit(0.0)))
log_cosh = _mean(_log_cosh)
huber = _mean(lambda y, p: F.when(F.abs(y - p) <= 1, 0.5 * (y - p) * (y - p)).otherwise(F.abs(y - p) - 0.5))
hinge = _mean(lambda y, p: F.greatest(F.lit(0.0), 1 - (2 * y - 1) * p))
squared_hinge = _mean(lambda y, p: F.pow(F.greatest(F.lit(0.0), 1 - (2 * y - 1) * p), F.lit(2.0)))
poisson = _mean(lambda y, p: p - y * F.ln(p + EPS))
binary_crossentropy = _mean(lambda y, p: -(y * F.ln(_bounded(p)) + (1 - y) * F.ln(1 - _bounded(p))))
kl_divergence = _mean(lambda y, p: _bounded(y) * F.ln(_bounded(y) / _bounded(p)))


def root_mean_squared_error(y, p) -> Column:
    return F.sqrt(mean_squared_error(y, p))


def categorical_hinge(y, scores) -> Column:
    """max(0, 1 + the greatest score of a wrong class - the true class's score)."""
    own = F.get(_c(scores), _c(y).cast("int"))
    wrong = F.array_max(F.filter(_c(scores), lambda s, i: i != _c(y)))
    return F.avg(F.greatest(F.lit(0.0), 1 + wrong - own))


def sparse_crossentropy(y, scores) -> Column:
    return F.avg(-F.ln(_bounded(F.get(_c(scores), _c(y).cast("int")))))


def cosine_similarity(a, b) -> Column:
    dot = lambda x, z: F.aggregate(F.zip_with(x, z, lambda u, v: (u * v).cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, z = _c(a), _c(b)
    return F.avg(F.try_divide(dot(x, z), F.sqrt(dot(x, x)) * F.sqrt(dot(z, z))))


REGISTRY: dict[str, Callable[..., Column]] = {
    "Accuracy": accuracy, "BinaryAccuracy": accuracy, "CategoricalAccuracy": class_accuracy, "SparseCategoricalAccuracy": class_accuracy, "TopKCategoricalAccuracy": top_k_accuracy, "SparseTopKCategoricalAccuracy": top_k_accuracy,
    "TruePositives": true_positives, "FalsePositives": false_positives, "TrueNegatives": true_negatives, "FalseNegatives": false_negatives, "Precision": precision, "Recall": recall, "FScoreLoss": f_score_loss,
    "MeanSquaredError": mean_squared_error, "RootMeanSquaredError": root_mean_squared_error, "MeanAbsoluteError": mean_absolute_error, "MeanAbsolutePercentageError": mean_absolute_percentage_error,
    "MeanSquaredLogarithmicError": mean_squared_logarithmic_error, "MeanRelativeError": mean_relative_error, "LogCosh": log_cosh, "LogCoshError": log_cosh, "Huber": huber, "Hinge": hinge, "SquaredHinge": squared_hinge, "CategoricalHinge": categorical_hinge, "Poisson": poisson,
    "BinaryCrossentropy": binary_crossentropy, "CategoricalCrossentropy": sparse_crossentropy, "SparseCategoricalCrossentropy": sparse_crossentropy, "KLDivergence": kl_divergence, "CosineSimilarity": cosine_similarity,
    "Mean": lambda p: F.avg(p), "Sum": lambda p: F.sum(p),
}


def confusion(df: DataFrame, y: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def mean_iou(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """Mean over classes of hits by the union of truth and prediction."""
    c = confusion(df, y, predicted)
    sides = F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("class")
    per = c.select(sides, "n", F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")).groupBy("class").agg((F.sum("hit") / F.sum("n")).alias("iou"))
    return per.agg(F.avg("iou").alias("mean_iou"))


def roc(df: DataFrame, y: str, p: str) -> DataFrame:
    """(score, tp, fp, positives, negatives, pos, neg) at each distinct score, from the greatest down.

    Scores are combined before they are ordered, so ties count together: ``pos`` and ``neg`` have the
    score itself. Distinct scores are summed in ranges, not in one task.
    """
    counts = df.groupBy(F.col(p).alias("score")).agg(F.sum(F.when(F.col(y) >= 0.5, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) < 0.5, 1).otherwise(0)).alias("neg"))
    summed = running(counts, [F.desc("score")], {"tp": "pos", "fp": "neg"})
    total = counts.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return summed.join(F.broadcast(total)).select("score", "tp", "fp", "positives", "negatives", "pos", "neg")


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule."""
    area = F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0
    return roc(df, y, p).agg(F.sum(F.try_divide(area, F.col("positives") * F.col("negatives"))).alias("auc"))


def sensitivity_at_specificity(df: DataFrame, y: str, p: str, least: float) -> DataFrame:
    return roc(df, y, p).where(1 - F.try_divide(F.col("fp"), F.col("negatives")) >= least).agg(F.coalesce(F.max(F.try_divide(F.col("tp"), F.col("positives"))), F.lit(0.0)).alias("sensitivity"))


def specificity_at_sensitivity(df: DataFrame, y: str, p: str, least: float) -> DataFrame:
    return roc(df, y, p).where(F.try_divide(F.col("tp"), F.col("positives")) >= least).agg(F.coalesce(F.max(1 - F.try_divide(F.col("fp"), F.col("negatives"))), F.lit(0.0)).alias("specificity"))
