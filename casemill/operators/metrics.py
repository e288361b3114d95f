"""Classification metrics as one grouped pass over the predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.arrays import argmax
from casemill.operators.joins import literal_table


# Row and column of the confusion matrix for what is not among its classes.
OTHER = "other"


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def confusion_counts(
    df: DataFrame, label: str, prediction: str, weight: str | None = None
) -> DataFrame:
    """Weight per (label, prediction) pair: the table all label metrics are computed from."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.sum(_weight(weight)).alias("weight")
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: list) -> DataFrame:
    """One row per true class in the order given and one for all others, one column per predicted class and one
    for all others, 0 where empty.

    A label or prediction that is missing or not among ``classes`` counts as ``OTHER``, so the cells sum up to
    the rows.
    """
    known = [F.when(F.col(c).isin(classes), F.col(c).cast("string")).otherwise(OTHER) for c in (label, prediction)]
    pairs = df.groupBy(known[0].alias("label"), known[1].alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )
    classes = [*map(str, classes), OTHER]

    def cell(true, predicted):
        here = (F.col("label") == F.lit(true)) & (F.col("prediction") == F.lit(predicted))
        return F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias(f"predicted_{predicted}")

    rows = [F.struct(F.lit(c).alias("label"), *[cell(c, p) for p in classes]) for c in classes]
    return pairs.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def class_counts(confusion: DataFrame, labels: list | None = None) -> DataFrame:
    """True positives, true and predicted weight per class.

    A class seen only in the predictions counts; ``labels`` restricts the classes, and a label seen
    nowhere counts with zeros.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("weight")).otherwise(0.0)
    sides = F.array(
        F.struct(
            F.col("label").alias("class"),
            hit.alias("tp"),
            F.col("weight").alias("actual"),
            F.lit(0.0).alias("predicted"),
        ),
        F.struct(
            F.col("prediction").alias("class"),
            F.lit(0.0).alias("tp"),
            F.lit(0.0).alias("actual"),
            F.col("weight").alias("predicted"),
        ),
    )
    rows = confusion.select(F.inline(sides))
    if labels is not None:
        kind = dict(confusion.dtypes)["label"]
        zeros = literal_table(confusion.sparkSession, {"class": labels}, {"class": kind}).select(
            "class", *[F.lit(0.0).alias(c) for c in ("tp", "actual", "predicted")]
        )
        rows = rows.filter(F.col("class").isin(labels)).unionByName(zeros)
    return rows.groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted")
    )


def _f1(tp: Column, actual: Column, predicted: Column) -> Column:
    """Harmonic mean of precision and recall; 0 where nothing is true or predicted."""
    return F.coalesce(F.try_divide(2 * tp, actual + predicted), F.lit(0.0))


_CLASS_F1 = ("tp", "actual", "predicted")


def accuracy(
    df: DataFrame,
    label: str,
    prediction: str,
    normalize: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Share (or, not normalised, weight) of equal pairs. Array columns must be equal as a whole."""
    w = _weight(weight)
    right = F.sum(F.when(F.col(label) == F.col(prediction), w).otherwise(0.0))
    return df.agg((F.try_divide(right, F.sum(w)) if normalize else right).alias("accuracy"))


def f1_score(
    df: DataFrame,
    label: str,
    prediction: str,
    average: str | None = "binary",
    pos_label=1,
    labels: list | None = None,
    weight: str | None = None,
) -> DataFrame:
    """F1 as one row, or one row per class for ``average=None``."""
    confusion = confusion_counts(df, label, prediction, weight)
    if average == "binary":
        per_class = class_counts(confusion, [pos_label])
    else:
        per_class = class_counts(confusion, labels)
    f1 = _f1(*map(F.col, _CLASS_F1))
    if average is None:
        return per_class.select("class", f1.alias("f1"))
    averages = {
        "binary": F.max(f1),
        "macro": F.avg(f1),
        "micro": _f1(F.sum("tp"), F.sum("actual"), F.sum("predicted")),
        "weighted": F.coalesce(
            F.try_divide(F.sum(f1 * F.col("actual")), F.sum("actual")), F.lit(0.0)
        ),
    }
    return per_class.agg(averages[average].alias("f1"))


def f1_multilabel(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Macro F1 over the positions of two 0/1 arrays."""
    cells = df.select(F.posexplode(F.arrays_zip(F.col(label).alias("y"), F.col(prediction).alias("p"))))
    y, p = F.col("col.y").cast("double"), F.col("col.p").cast("double")
    per_position = cells.groupBy("pos").agg(
        F.sum(y * p).alias("tp"), F.sum(y).alias("actual"), F.sum(p).alias("predicted")
    )
    return per_position.agg(F.avg(_f1(*map(F.col, _CLASS_F1))).alias("f1"))


def f1_samples(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean over the rows of the F1 of two 0/1 arrays; row by row, without a shuffle of rows."""

    def total(items):
        return F.aggregate(items, F.lit(0.0), lambda a, x: a + x.cast("double"))

    y, p = F.col(label), F.col(prediction)
    both = F.zip_with(y, p, lambda a, b: a * b)
    return df.agg(F.avg(_f1(total(both), total(y), total(p))).alias("f1"))


def eval_bundle(df: DataFrame, label: str, scores: str) -> DataFrame:
    """Accuracy, macro F1 and weighted F1 of the arg-max class, from one confusion table."""
    predicted = df.select(F.col(label).alias("label"), argmax(F.col(scores)).alias("prediction"))
    per_class = class_counts(confusion_counts(predicted, "label", "prediction"))
    f1 = _f1(*map(F.col, _CLASS_F1))
    return per_class.agg(
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
        (F.sum(f1 * F.col("actual")) / F.sum("actual")).alias("weighted_f1"),
    )


def eval_groups(df: DataFrame, label: str, prediction: str, group: str) -> DataFrame:
    """The metrics of ``eval_bundle`` for each value of ``group``, from one confusion table of them all."""
    counts = df.groupBy(F.col(group).alias("group"), F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    hit, n, none = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0), F.col("n"), F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("class"), hit.alias("tp"), n.alias("actual"), none.alias("predicted")),
        F.struct(F.col("prediction").alias("class"), none.alias("tp"), none.alias("actual"), n.alias("predicted")),
    )
    per_class = counts.select("group", F.inline(sides)).groupBy("group", "class").agg(*(F.sum(c).alias(c) for c in _CLASS_F1))
    f1 = _f1(*map(F.col, _CLASS_F1))
    return per_class.groupBy(F.col("group").alias(group)).agg(
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
        (F.sum(f1 * F.col("actual")) / F.sum("actual")).alias("weighted_f1"),
    )


def misclassified(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows whose prediction is not the label; one that is missing is wrong, unless both are."""
    return df.filter(~F.col(label).eqNullSafe(F.col(prediction)))
