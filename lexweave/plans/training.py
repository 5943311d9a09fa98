"""Training of the translation model over a corpus's batches.

Each partition takes its batches of the epoch one after another from common parameters; the partitions' parameters are
averaged by their tokens after the epoch. Metrics are tables: a row for each batch, aggregated by ``operators.metrics``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexweave.operators import batches, layout, metrics, translation
from lexweave.plans.config import ModelConfig, TrainingConfig
from lexweave.plans.corpus import Corpus
from lexweave.plans.session import cut, shuffle_partitions
from lexweave.sources.jsonl import write_config, write_vocabulary

STATS = "epoch int, split string, step long, loss double, nll_sum double, correct long, tokens long"


def _averaged(made: DataFrame, shape: translation.Parameters) -> translation.Parameters:
    """Averages the partitions' parameters by tokens, number by number, summed before they are exchanged."""
    place = F.posexplode("x").alias("at", "value")
    sums = made.select("i", "n", place).groupBy("i", "at").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))
    flat, out, at = sums.orderBy("i", "at").select("value").toArrow()["value"].to_numpy(), {}, 0  # one model
    for k, v in shape.items():
        out[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def train_epoch(rows: DataFrame, model: ModelConfig, run: TrainingConfig, parameters: translation.Parameters, epoch: int) -> tuple[translation.Parameters, DataFrame]:
    """The next parameters and the batches' statistics. ``rows``: place (the batch's in this epoch's order) and the
    columns of ``layout.matrices``."""
    shared = rows.sparkSession.sparkContext.broadcast(parameters)
    slice_ = 1 << 14

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {k: v.copy() for k, v in shared.value.items()}
        adam, stats, tokens = translation.Adam(run.learning_rate, beta_2=run.beta_2), [], 0
        for frame in frames:
            for _, r in frame.iterrows():
                s = translation.train_step(model, own, adam, layout.to_numpy(r), run.smoothing, run.seed + epoch * 1_000_003 + int(r["place"]))
                stats.append((-1, None, s[3], int(r["place"]), *s[:3]))
                tokens += s[3]
        yield pd.DataFrame(stats, columns=["i", "x", "n", "step", "loss", "nll_sum", "correct"])
        if tokens:
            flat = np.concatenate([v.ravel() for v in own.values()])
            for i in range(0, len(flat), slice_):
                yield pd.DataFrame([(i // slice_, flat[i : i + slice_], tokens, 0, 0.0, 0.0, 0)], columns=["i", "x", "n", "step", "loss", "nll_sum", "correct"])

    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "place").sortWithinPartitions("place")
    made = cut(dealt.mapInPandas(work, "i int, x array<double>, n long, step long, loss double, nll_sum double, correct long"))
    stats = made.where("i < 0").select(F.lit(epoch).alias("epoch"), F.lit("train").alias("split"), "step", "loss", "nll_sum", "correct", F.col("n").alias("tokens"))
    return _averaged(made.where("i >= 0").select("i", "x", "n"), parameters), stats


def evaluate(rows: DataFrame, model: ModelConfig, run: TrainingConfig, parameters: translation.Parameters, epoch: int, split: str = "valid") -> DataFrame:
    """Statistics of each batch under the parameters, without a step."""
    shared = rows.sparkSession.sparkContext.broadcast(parameters)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            stats = [(epoch, split, int(r["batch_id"]), *translation.valid_step(model, shared.value, layout.to_numpy(r), run.smoothing)) for _, r in frame.iterrows()]
            yield pd.DataFrame(stats, columns=["epoch", "split", "step", "loss", "nll_sum", "correct", "tokens"])

    return rows.mapInPandas(work, STATS)


def train(corpus: Corpus, model: ModelConfig, run: TrainingConfig, path: str) -> tuple[translation.Parameters, DataFrame]:
    """Trains until the epochs end or the valid loss has not improved for ``patience`` epochs. Under ``path``, which is
    replaced: settings, vocabulary, a checkpoint for each epoch, the metrics and the model."""
    spark = corpus.spark
    write_config(spark, run, f"{path}/config")
    write_config(spark, model, f"{path}/model_config")
    write_vocabulary(corpus.vocabulary, f"{path}/vocabulary")
    batched = cut(corpus.batched(run))
    flat = cut(layout.matrices(layout.pad_batches(batched)))
    training, validation = flat.where("split = 'train'"), flat.where("split = 'valid'")
    parameters, history = translation.initial(model, run.seed), None
    for epoch in range(run.epochs):
        order = batches.epoch_order(batched, run.seed, epoch)
        parameters, stats = train_epoch(training.join(order, "batch_id"), model, run, parameters, epoch)
        stats = cut(stats.unionByName(evaluate(validation, model, run, parameters, epoch)))
        history = stats if history is None else history.unionByName(stats)
        _save(spark, parameters, f"{path}/checkpoints/{epoch}")
        losses = metrics.epoch_metrics(history.where("split = 'valid'"), "epoch").select("epoch", "loss")
        last = metrics.early_stopping(losses, run.patience).orderBy(F.desc("epoch")).first()
        if last is not None and last["stop"]:
            break
    if history is not None:
        metrics.epoch_metrics(history, "epoch", "split").coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    _save(spark, parameters, f"{path}/model")
    return parameters, history


def _save(spark, parameters: translation.Parameters, path: str) -> None:
    spark.createDataFrame([(bytearray(translation.to_bytes(parameters)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> translation.Parameters:
    return translation.from_bytes(bytes(spark.read.parquet(path).first()["model"]))
