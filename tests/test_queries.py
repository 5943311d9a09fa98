"""Registered queries against their SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from lexweave.plans import artifact_queries
from lexweave.plans.oracles import ORACLES
from lexweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda df: sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()), key=str)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert artifact_queries.QUERIES.keys() - artifact_queries.ORACLES.keys() == {"q_forward", "q_train_step"}  # tested below


@pytest.mark.parametrize("name", sorted(artifact_queries.ORACLES))
def test_artifact_query(spark, db, name):
    same(artifact_queries.QUERIES[name](spark, SF).toPandas(), db.execute(artifact_queries.ORACLES[name]).df())


def plain_forward(p, src, tgt, heads=2):
    """Log-probabilities of the one-layer model, position by position and number by number."""
    width = p["embedding"].shape[1]
    size = width // heads

    def embed(ids):
        place = lambda i, j: math.sin(i / 10000 ** (j / width)) if j % 2 == 0 else math.cos(i / 10000 ** ((j - 1) / width))
        return [[p["embedding"][t][j] + place(i, j) for j in range(width)] for i, t in enumerate(ids)]

    def norm(x, name):
        mean = sum(x) / width
        spread = math.sqrt(sum((v - mean) ** 2 for v in x) / width + 1e-5)
        return [(v - mean) / spread * g + s for v, g, s in zip(x, p[f"{name}.gain"], p[f"{name}.shift"], strict=True)]

    def linear(x, name):
        return [sum(v * p[name][i][j] for i, v in enumerate(x)) + p[f"{name}.bias"][j] for j in range(p[name].shape[1])]

    def attend(x, memory, name, seen):
        q, k, v = ([linear(y, f"{name}.{part}") for y in ys] for part, ys in (("q", x), ("k", memory), ("v", memory)))
        out = []
        for i in range(len(x)):
            row = []
            for h in range(heads):
                part = range(h * size, (h + 1) * size)
                w = [math.exp(sum(q[i][d] * k[j][d] for d in part) / math.sqrt(size)) if seen(i, j) else 0.0 for j in range(len(memory))]
                row += [sum(a * v[j][d] for j, a in enumerate(w)) / sum(w) for d in part]
            out.append(linear(row, f"{name}.o"))
        return out

    gelu = lambda v: v * 0.5 * (1 + math.tanh(math.sqrt(2 / math.pi) * (v + 0.044715 * v**3)))
    add = lambda x, y: [[a + b for a, b in zip(r, s, strict=True)] for r, s in zip(x, y, strict=True)]
    normed = lambda x, name: [norm(r, name) for r in x]
    feed = lambda x, name: add(x, [linear([gelu(v) for v in linear(r, f"{name}.in")], f"{name}.out") for r in normed(x, f"{name}.norm")])

    def log_p(x):
        scores = [[sum(a * b for a, b in zip(r, e, strict=True)) for e in p["embedding"]] for r in x]
        return [[s - math.log(sum(map(math.exp, r))) for s in r] for r in scores]

    x = embed(src)
    own = normed(x, "encoder.0.self.norm")
    memory = normed(feed(add(x, attend(own, own, "encoder.0.self", lambda i, j: True)), "encoder.0"), "encoder.norm")
    y = embed(tgt)
    own = normed(y, "decoder.0.self.norm")
    y = add(y, attend(own, own, "decoder.0.self", lambda i, j: j <= i))
    y = add(y, attend(normed(y, "decoder.0.cross.norm"), memory, "decoder.0.cross", lambda i, j: True))
    return log_p(normed(feed(y, "decoder.0"), "decoder.norm")), log_p(memory)


def test_forward_is_like_a_plain_one(spark):
    got = {(r["n_nationkey"], r["side"], r["pos"], r["token"]): r["log_p"] for r in artifact_queries.q_forward(spark, SF).collect()}
    p = {k: v.data for k, v in artifact_queries._model().p.items()}
    nations = spark.read.parquet(f"{SF}/nation.parquet").collect()
    assert len(got) == len(nations) * 5 * artifact_queries.KINDS
    for r in nations:
        key, region = r["n_nationkey"], r["n_regionkey"]
        for side, rows in zip(("decoder", "encoder"), plain_forward(p, artifact_queries._ids(key, region)[0], [1, 1 + region]), strict=True):
            for i, row in enumerate(rows):
                assert row == pytest.approx([got[key, side, i, v] for v in range(artifact_queries.KINDS)], abs=2e-6)


def test_steps_lower_the_loss(spark):
    rows = artifact_queries.q_train_step(spark, SF).collect()
    loss = {(r["n_nationkey"], r["step"]): r["loss"] for r in rows}
    assert all(r["tokens"] == 2 for r in rows) and all(loss[k, 5] < loss[k, 0] for k, _ in loss)


@pytest.mark.parametrize("name", [
    "q_conversation_pairs", "q_normalize_key", "q_fnv1a", "q_components", "q_split_counts", "q_vocab", "q_decode", "q_items", "q_build_stats", "q_splitmix", "q_bucketed", "q_batches_any_length",
    "q_batch_stats", "q_epoch_order", "q_pad", "q_masks", "q_matrices", "q_causal_mask", "q_log_softmax", "q_smoothed_loss", "q_perplexity", "q_running_metrics", "q_early_stop",
])
def test_query(spark, db, name):
    same(QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df())
