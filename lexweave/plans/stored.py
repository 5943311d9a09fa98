"""A corpus on disk: whole or absent step by step, items and batches read by number."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.operators import layout, store
from lexweave.plans.config import TrainingConfig
from lexweave.sources.artifacts import Artifacts
from lexweave.sources.jsonl import read_config, read_vocabulary, write_config, write_vocabulary

STEPS = ("vocabulary", "config", "stats", "items", "batches", "tensors")


def save(corpus, path: str, config: TrainingConfig, resume: bool = False, per_items: int = store.PER_CLUSTER, per_batches: int = 1024, per_tensors: int = 64) -> StoredCorpus:
    """Vocabulary, settings, statistics, items, batches and tensor shards under ``path``. Each step is written beside what
    stands there and replaces it at once. ``resume``: steps that are there already for the same settings stay."""
    artifacts = Artifacts(corpus.spark, path)
    settings = json.dumps([asdict(config), asdict(corpus.split), corpus.max_length, corpus.both, per_items, per_batches, per_tensors], sort_keys=True, default=str)
    facts = {"settings": hashlib.sha256(settings.encode()).hexdigest()}
    write = {
        "vocabulary": lambda p: write_vocabulary(corpus.vocabulary, p),
        "config": lambda p: write_config(corpus.spark, config, p),
        "stats": lambda p: corpus.stats().coalesce(1).write.json(p),
        "items": lambda p: store.write_clustered(corpus.items, p, "item_idx", per_items),
        "batches": lambda p: store.write_clustered(corpus.batched(config), p, "batch_id", per_batches, ["pos_in_batch"]),
        "tensors": lambda p: store.write_tensors(layout.batch_matrices(corpus.batched(config)), p, per_tensors),
    }
    per = {"items": per_items, "batches": per_batches, "tensors": per_tensors}
    for step in STEPS:
        if not (resume and artifacts.has(step, **facts)):
            artifacts.commit(step, write[step], **facts, **({"per": per[step]} if step in per else {}))
    return StoredCorpus(corpus.spark, path)


class StoredCorpus:
    """What ``save`` has left; every look-up follows the last manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.artifacts = spark, Artifacts(spark, path)

    def vocabulary(self) -> DataFrame:
        return read_vocabulary(self.spark, self.artifacts.folder("vocabulary"))

    def config(self) -> dict:
        return read_config(self.spark, self.artifacts.folder("config"))

    def stats(self) -> DataFrame:
        return self.spark.read.json(self.artifacts.folder("stats"))

    def rows(self, step: str) -> DataFrame:
        return store.read_clustered(self.spark, self.artifacts.folder(step))

    def _at(self, step: str, key: str, split: str, number: int) -> DataFrame:
        return store.at(self.rows(step), key, split, number, self.artifacts.facts(step)["per"])

    def item(self, split: str, number: int) -> DataFrame:
        """The row of one item; none beyond the end."""
        return self._at("items", "item_idx", split, number)

    def batch(self, split: str, number: int) -> DataFrame:
        """The items of one batch, by pos_in_batch."""
        return self._at("batches", "batch_id", split, number)

    def tensor(self, split: str, number: int) -> DataFrame:
        """The row of one batch's matrices; ``store.to_matrices`` makes them arrays."""
        return self._at("tensors", "batch_id", split, number)

    def __len__(self) -> int:
        return self.rows("items").count()

    def sizes(self) -> DataFrame:
        """split, items."""
        return self.rows("items").groupBy("split").agg(F.count("*").alias("items"))
