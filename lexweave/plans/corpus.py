"""A corpus from pair records to batches, each step a lazy table that is computed once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.functions.tokens import Tokenizer
from lexweave.operators import batches, items, layout
from lexweave.operators.indexing import dense_index
from lexweave.operators.split import SplitConfig, assign_splits, bucketed, place_splits
from lexweave.operators.vocabulary import Dictionary, distinct_ids, vocabulary_of
from lexweave.plans.config import TrainingConfig
from lexweave.plans.session import cut, stored
from lexweave.plans.stored import StoredCorpus, save
from lexweave.sources.jsonl import read_pairs


class Corpus:
    """``pairs``: ord, src_lang, tgt_lang, src, tgt. Splits see every pair, the vocabulary every split; only then are splits
    chosen and lengths checked. Steps that several others read are checkpointed.

    ``order``: pairs come without ord, and with these columns, which give their order; ord is then given to rows without
    texts (of pairs that are too long for an item) instead of the pairs themselves. Pairs without either will do for the
    statistics. ``texts``: whether items are to get their ids. ``assigned``, ``coded`` and ``encoded`` need pairs with ord."""

    def __init__(self, pairs: DataFrame, tokenizer: Tokenizer, split: SplitConfig = SplitConfig(), max_length: int = items.MAX_LENGTH, both_directions: bool = True, order: list[str] | None = None, texts: bool = True):
        self.spark, self.tokenizer, self.split, self.max_length, self.both = pairs.sparkSession, tokenizer, split, max_length, both_directions
        self.pairs, self.order, self.texts = pairs, order or [], texts

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokenizer: Tokenizer, **options) -> Corpus:
        return cls(stored(read_pairs(spark, path)), tokenizer, **options)  # lines are parsed once

    @cached_property
    def assigned(self) -> DataFrame:
        return stored(assign_splits(self.pairs, self.split).select("ord", "src_lang", "tgt_lang", "src", "tgt", "least", "split"))

    @cached_property
    def sizes(self) -> DataFrame:
        """ord, split, languages, src_n and tgt_n (numbers of tokens): what splits, lengths and batches depend on; with ``texts``
        also src_fit and tgt_fit, the texts of the pairs that aren't too long for an item. They stay with their row, so ids need no
        second look at the pairs."""
        counted = self.pairs.withColumns({"src_n": self.tokenizer.count(F.col("src")), "tgt_n": self.tokenizer.count(F.col("tgt"))})
        keep = [*[c for c in ("ord", *self.order) if c in self.pairs.columns], "src_lang", "tgt_lang", "src_n", "tgt_n"]
        if self.texts:
            fits = (F.col("src_n") < self.max_length) & (F.col("tgt_n") < self.max_length)
            counted = counted.withColumns({f"{c}_fit": F.when(fits, F.col(c)) for c in ("src", "tgt")})
            keep += ["src_fit", "tgt_fit"]
        placed = place_splits(counted, self.split, keep)
        return dense_index(placed, self.order, "ord").drop(*self.order) if self.order else stored(placed)

    @cached_property
    def vocabulary(self) -> DataFrame:
        """Of the texts of every split; so it waits for none."""
        return cut(vocabulary_of(distinct_ids(self.tokenizer.used(self.pairs, "src", "tgt"))))

    @cached_property
    def dictionary(self) -> Dictionary:
        return Dictionary(self.vocabulary)

    def _coded(self, pairs: DataFrame) -> DataFrame:
        ids = lambda c: self.dictionary.encode(self.tokenizer.encode(F.col(c)))
        return pairs.select("ord", "src_lang", "tgt_lang", ids("src").alias("src_ids"), ids("tgt").alias("tgt_ids"))

    @property
    def coded(self) -> DataFrame:
        """ord, languages, src_ids and tgt_ids in the compact id space; ids are made where they are read, and written nowhere."""
        return self._coded(self.pairs)

    @property
    def encoded(self) -> DataFrame:
        """``coded`` with split."""
        return self.coded.join(self.sizes.select("ord", "split"), "ord").select("ord", "split", "src_lang", "tgt_lang", "src_ids", "tgt_ids")

    @cached_property
    def lengths(self) -> DataFrame:
        """The items without their ids."""
        return stored(items.number(items.with_lengths(self.sizes, self.both), self.max_length))

    def _with_ids(self, rows: DataFrame) -> DataFrame:
        if not self.texts:
            raise ValueError("a corpus without texts has no ids")
        fit = self.sizes.where("src_fit is not null").select("ord", "src_lang", "tgt_lang", F.col("src_fit").alias("src"), F.col("tgt_fit").alias("tgt"))
        return items.with_ids(rows, self._coded(fit))

    @cached_property
    def items(self) -> DataFrame:
        columns = ["ord", "split", "dir", "src_lang", "tgt_lang", "src_ids", "tgt_ids", "src_len", "tgt_len", "item_idx"]
        return stored(self._with_ids(self.lengths).select(*columns))

    def stats(self) -> DataFrame:
        return items.stats_of(items.with_lengths(self.sizes, self.both), self.max_length)

    def summary(self) -> DataFrame:
        """name, value: the numbers of pairs, components and vocabulary entries."""
        heads = bucketed(self.pairs, keep=[])[2]
        first = heads.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.count("*").alias("components"))
        rows = first.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("pairs", "components")])))
        return rows.unionByName(self.vocabulary.agg(F.count("*").alias("value")).select(F.lit("vocabulary").alias("name"), "value"))

    def planned(self, config: TrainingConfig, **options) -> DataFrame:
        """``batched`` without ids: which item stands where."""
        return batches.bucket(self.lengths, config.batch_size, config.max_tokens, config.seed, **options)

    def batched(self, config: TrainingConfig) -> DataFrame:
        columns = ["ord", "split", "dir", "src_lang", "tgt_lang", "src_ids", "tgt_ids", "src_len", "tgt_len", "item_idx", "batch_id", "pos_in_batch"]
        return self._with_ids(self.planned(config)).select(*columns)

    def batch_stats(self, config: TrainingConfig) -> DataFrame:
        """What the batches are like, from the lengths alone: items are neither encoded nor numbered."""
        kept = items.with_reason(items.with_lengths(self.sizes, self.both), self.max_length).where("dropped is null")
        return batches.planned_stats(kept.select("split", "src_len", "tgt_len"), config.batch_size, config.max_tokens)

    def epoch_order(self, config: TrainingConfig, epoch: int, split: str = "train") -> DataFrame:
        """``batches.epoch_order``, from the lengths alone: it depends on the number of batches only."""
        counted = self.batch_stats(config).where(F.col("split") == split).first()
        return batches.order_of(self.spark, counted["batches"] if counted else 0, config.seed, epoch)

    def layout(self, config: TrainingConfig) -> DataFrame:
        return layout.with_masks(layout.pad_batches(self.batched(config)))

    def save(self, path: str, config: TrainingConfig, **options) -> StoredCorpus:
        """Writes what ``stored.save`` states; a failure leaves what stood there before."""
        return save(self, path, config, **options)
