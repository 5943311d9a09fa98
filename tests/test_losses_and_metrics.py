import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import losses, metrics


@pytest.fixture(scope="module")
def logits():
    return np.random.default_rng(3).normal(0, 2, (7, 11)), [3, 0, 10, 1, 0, 7, 2]


def test_smoothed_loss_is_the_one_hot_form(spark, logits):
    x, t = logits
    df = spark.createDataFrame([(0, r.tolist(), k) for r, k in zip(x, t, strict=True)], "b int, logits array<double>, target int")
    got = losses.batch_losses(losses.token_losses(df), "b").first()
    log_p = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
    one_hot = np.eye(11)[t] * 0.9 + 0.1 / 11
    valid = np.array(t) != 0
    assert got["tokens"] == 5
    assert got["loss"] == pytest.approx(-(one_hot * log_p).sum(axis=1)[valid].sum() / 5, rel=1e-12)
    assert got["nll_sum"] == pytest.approx(-log_p[np.arange(7), t][valid].sum(), rel=1e-12)
    assert got["correct"] == int(((x.argmax(axis=1) == t) & valid).sum())


def test_log_softmax_and_argmax(spark):
    r = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 5.0, 5.0])], "x array<double>, y array<double>").select(losses.log_softmax(F.col("x")).alias("l"), losses.argmax(F.col("y")).alias("a")).first()
    assert r["l"][2] == pytest.approx(-0.40760596444438) and r["a"] == 1


def test_a_batch_of_padding(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0)], "b int, logits array<double>, target int")
    got = metrics.batch_metrics(losses.batch_losses(losses.token_losses(df), "b")).first()
    assert (got["loss"], got["tokens"], got["accuracy"], got["perplexity"]) == (0.0, 0, 0.0, 1.0)


@pytest.fixture(scope="module")
def stats(spark):
    rows = [(1, 0, 2.0, 10.0, 3, 10), (1, 1, 4.0, 0.0, 0, 0), (1, 2, 6.0, 90.0, 27, 30), (2, 0, 1.0, 4.0, 1, 2)]
    return spark.createDataFrame(rows, "epoch int, step int, loss double, nll_sum double, correct long, tokens long")


def test_epoch_metrics_weigh_by_tokens(stats):
    one = metrics.epoch_metrics(stats, "epoch").where("epoch = 1").first()
    assert one["accuracy"] == 75.0 and one["perplexity"] == pytest.approx(math.exp(2.5)) and one["loss"] == 4.0


def test_running_metrics_start_anew_each_epoch(stats):
    got = metrics.running_metrics(stats, "step", "epoch").orderBy("epoch", "step").collect()
    assert [r["accuracy"] for r in got] == [30.0, 30.0, 75.0, 50.0]
    assert got[3]["perplexity"] == pytest.approx(math.exp(2.0)) and [r["loss"] for r in got] == [2.0, 3.0, 4.0, 1.0]


def test_early_stopping(spark):
    df = spark.createDataFrame(list(enumerate([5.0, 4.0, 4.0, 4.5, 3.0, 3.1, 3.2, 3.3])), "epoch int, loss double")
    got = metrics.early_stopping(df, 3).orderBy("epoch").collect()
    assert [r["since"] for r in got] == [0, 0, 1, 2, 0, 1, 2, 3] and [r["stop"] for r in got] == [False] * 7 + [True]
    assert got[-1]["best"] == 3.0
