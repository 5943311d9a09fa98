"""Loss arithmetic over a column of logits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lexweave.operators.vocabulary import COMPACT_PAD

SMOOTHING = 0.1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row; named in a lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_sum_exp(logits: Column) -> Column:
    return let(F.array_max(logits), lambda top: top + F.ln(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))))


def log_softmax(logits: Column) -> Column:
    return let(log_sum_exp(logits), lambda whole: F.transform(logits, lambda x: x - whole))


def argmax(values: Column) -> Column:
    """Index of the greatest value from 0, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def gather(values: Column, index: Column) -> Column:
    return F.get(values, index)


def smoothed_nll(logits: Column, target: Column, smoothing: float = SMOOTHING) -> Column:
    """Label-smoothed negative log likelihood without the one-hot matrix: the log-softmax enters only through the target's
    value and the mean."""
    return let(log_sum_exp(logits), lambda whole: -((1 - smoothing) * (gather(logits, target) - whole) + smoothing * (mean(logits) - whole)))


def token_losses(rows: DataFrame, logits: str = "logits", target: str = "target", pad: int = COMPACT_PAD, smoothing: float = SMOOTHING) -> DataFrame:
    """``rows`` with valid (0 or 1), log_p (of the target), smooth (the smoothed loss) and hit (argmax is the target)."""
    x = F.transform(F.col(logits), lambda v: v.cast("double"))
    wide = rows.withColumn("__x", x)
    t = F.col(target)
    return wide.withColumns({
        "valid": (t != pad).cast("int"), "log_p": gather(F.col("__x"), t) - log_sum_exp(F.col("__x")),
        "smooth": smoothed_nll(F.col("__x"), t, smoothing), "hit": (argmax(F.col("__x")) == t).cast("int"),
    }).drop("__x")


def batch_losses(losses: DataFrame, *by: str) -> DataFrame:
    """Of each batch: loss (masked mean of the smoothed loss), nll_sum, correct, tokens. A batch of padding has loss 0."""
    return losses.groupBy(*by).agg(
        (F.sum(F.col("smooth") * F.col("valid")) / F.greatest(F.sum("valid"), F.lit(1))).alias("loss"), (-F.sum(F.col("log_p") * F.col("valid"))).alias("nll_sum"),
        F.sum(F.col("hit") * F.col("valid")).alias("correct"), F.sum("valid").alias("tokens"),
    )
