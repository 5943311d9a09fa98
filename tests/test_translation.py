import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions.tokens import Tokenizer
from lexweave.operators import losses, metrics, translation
from lexweave.operators.autograd import Value
from lexweave.operators.split import SplitConfig
from lexweave.plans.config import ModelConfig, TrainingConfig
from lexweave.plans.corpus import Corpus
from lexweave.plans.training import load, train
from lexweave.sources.jsonl import pairs_from_rows, read_config

SMALL = ModelConfig(20, width=16, layers=2, heads=4, dropout=0.0)
SRC = np.array([[4, 7, 8, 9, 2], [3, 10, 2, 0, 0]])
TGT_IN = np.array([[1, 11, 12, 0], [1, 13, 14, 15]])
TGT_OUT = np.array([[11, 12, 2, 0], [13, 14, 15, 2]])


def model(seed=1):
    return translation.Model(SMALL, translation.initial(SMALL, seed))


def test_shapes():
    assert model().logits(SRC, TGT_IN).shape == (2, 4, 20)
    assert model().logits(SRC).shape == (2, 5, 20)


def test_later_targets_and_padding_change_nothing():
    base = model().logits(SRC, TGT_IN).data
    later = TGT_IN.copy()
    later[1, 3] = 6
    assert np.allclose(model().logits(SRC, later).data[1, :3], base[1, :3])
    longer = np.concatenate([SRC, np.zeros((2, 3), dtype=int)], axis=1)
    assert np.allclose(model().logits(longer, TGT_IN).data, base)


def test_gradients_are_like_differences():
    p = translation.initial(SMALL, 2)
    m = translation.Model(SMALL, p)
    logits = m.logits(SRC, TGT_IN)
    (start, *_), gradient = translation.loss(logits.data, TGT_OUT, 0.1)
    logits.differentiate(gradient)
    rng = np.random.default_rng(0)
    for name in ("embedding", "encoder.0.self.q", "encoder.1.in", "decoder.0.cross.v", "decoder.1.self.o.bias", "decoder.norm.gain", "encoder.0.norm.shift"):
        at = tuple(int(rng.integers(n)) for n in p[name].shape)
        moved = {k: v.copy() for k, v in p.items()}
        moved[name][at] += 1e-5
        after = translation.valid_step(SMALL, moved, {"src": SRC, "tgt_in": TGT_IN, "tgt_out": TGT_OUT}, 0.1)[0]
        assert (after - start) / 1e-5 == pytest.approx(m.p[name].gradient[at], abs=2e-5, rel=1e-3), name


def test_loss_is_that_of_the_columns(spark):
    logits = model().logits(SRC, TGT_IN).data
    rows = [(0, logits[i, j].tolist(), int(TGT_OUT[i, j])) for i in range(2) for j in range(4)]
    want = losses.batch_losses(losses.token_losses(spark.createDataFrame(rows, "b int, logits array<double>, target int")), "b").first()
    assert translation.loss(logits, TGT_OUT, 0.1)[0] == pytest.approx(tuple(want)[1:])


def test_blocked_rows_and_reshape():
    x = Value(np.ones((2, 3)))
    assert x.softmax(np.array([[True] * 3, [False, True, False]])).data.tolist() == [[0, 0, 0], [0.5, 0, 0.5]]


def test_steps_learn_a_batch():
    p, adam = translation.initial(SMALL, 3), translation.Adam(1e-2, beta_2=0.98)
    batch = {"src": SRC, "tgt_in": TGT_IN, "tgt_out": TGT_OUT}
    first = translation.train_step(SMALL, p, adam, batch, 0.1, 0)
    for _ in range(60):
        last = translation.train_step(SMALL, p, adam, batch, 0.1, 0)
    assert last[0] < 0.5 * first[0] and last[2] == last[3] == 7
    again = translation.from_bytes(translation.to_bytes(p))
    assert translation.valid_step(SMALL, again, batch, 0.1)[2] == 7


def test_training_run(spark, tmp_path):
    rows = [dict(src_lang="en", tgt_lang="pt_BR", src=f"abc {i % 7} {chr(97 + i)}", tgt=f"xyz {i % 7} {chr(97 + i)}") for i in range(20)]
    corpus = Corpus(pairs_from_rows(spark, rows), Tokenizer(spark), SplitConfig(0, 200))
    run = TrainingConfig(epochs=3, batch_size=8, learning_rate=3e-3, patience=2)
    config = ModelConfig(len(corpus.dictionary), width=16, layers=1, heads=2, dropout=0.1)
    parameters, history = train(corpus, config, run, str(tmp_path / "run"))
    by_epoch = metrics.epoch_metrics(history.where("split = 'train'"), "epoch").orderBy("epoch").collect()
    assert len(by_epoch) >= 2 and by_epoch[-1]["loss"] < by_epoch[0]["loss"]
    again = load(spark, str(tmp_path / "run/model"))
    assert all(np.allclose(again[k], v, atol=1e-2) for k, v in parameters.items())
    assert load(spark, str(tmp_path / "run/checkpoints/0")).keys() == parameters.keys()
    assert read_config(spark, str(tmp_path / "run/config"))["batch_size"] == 8
    assert spark.read.json(str(tmp_path / "run/metrics")).where(F.col("split") == "valid").count() == len(by_epoch)
