"""Token-weighted metrics of batches, and early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexweave.operators.scan import running_sums


def accuracy(correct: Column, tokens: Column) -> Column:
    """Per cent of the tokens."""
    return 100.0 * correct / F.greatest(tokens, F.lit(1))


def perplexity(nll_sum: Column, tokens: Column) -> Column:
    return F.exp(nll_sum / F.greatest(tokens, F.lit(1)))


def batch_metrics(stats: DataFrame) -> DataFrame:
    """Adds accuracy and perplexity of each batch to (nll_sum, correct, tokens)."""
    return stats.withColumns({"accuracy": accuracy(F.col("correct"), F.col("tokens")), "perplexity": perplexity(F.col("nll_sum"), F.col("tokens"))})


def epoch_metrics(stats: DataFrame, *by: str) -> DataFrame:
    """Of each epoch (or other group): accuracy weighted by tokens, perplexity of the token-weighted mean negative log
    likelihood (the mean comes first, then the exponential), and loss as the plain mean over batches."""
    return stats.groupBy(*by).agg(
        accuracy(F.sum("correct"), F.sum("tokens")).alias("accuracy"), perplexity(F.sum("nll_sum"), F.sum("tokens")).alias("perplexity"),
        F.avg("loss").alias("loss"), F.sum("tokens").alias("tokens"),
    )


def running_metrics(stats: DataFrame, order: str, *by: str) -> DataFrame:
    """The same after each batch of its epoch, whose batches may fill any number of tasks."""
    one = F.when(F.col("loss").isNotNull(), F.lit(1))
    sums = {"__correct": F.col("correct"), "__tokens": F.col("tokens"), "__nll": F.col("nll_sum"), "__loss": F.col("loss"), "__n": one}
    far = running_sums(stats, [order], sums, list(by))
    return far.select(
        *by, order, accuracy(F.col("__correct"), F.col("__tokens")).alias("accuracy"), perplexity(F.col("__nll"), F.col("__tokens")).alias("perplexity"),
        (F.col("__loss") / F.col("__n")).alias("loss"), F.col("__tokens").alias("tokens"),
    )


def early_stopping(epochs: DataFrame, patience: int, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """epoch, loss, best (least loss so far), since (epochs since the last one that was strictly better than all before),
    stop (since >= patience). There is a row for each epoch, so one window holds them all."""
    order = Window.orderBy(epoch)
    before = F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = epochs.select(epoch, loss, (before.isNull() | (F.col(loss) < before)).alias("__better"))
    last = F.max(F.when(F.col("__better"), F.col(epoch))).over(order)
    return marked.select(epoch, loss, F.min(loss).over(order).alias("best"), (F.col(epoch) - last).alias("since")).withColumn("stop", F.col("since") >= patience)
