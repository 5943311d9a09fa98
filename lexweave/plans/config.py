"""Settings of corpora, models and runs; plain values that turn into JSON and back."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from lexweave.operators.split import SplitConfig

# The sizes that the trainer tries one after another, and what tells that memory ran out.
BATCH_SIZES = (128, 64, 32, 16, 8, 4, 2, 1)
MEMORY_SIGNS = ("out of memory", "out-of-memory", "outofmemory", "out_of_memory", "alloc")


@dataclass(frozen=True)
class ModelConfig:
    vocabulary_size: int
    width: int = 256
    layers: int = 3
    heads: int = 4
    max_length: int = 128
    dropout: float = 0.1

    @property
    def hidden(self) -> int:
        return 4 * self.width


@dataclass(frozen=True)
class TrainingConfig:
    """Defaults of a run; ``full_run`` has those of the complete corpus."""

    epochs: int = 10
    batch_size: int = 64
    workers: int = 4
    seed: int = 42
    learning_rate: float = 1e-4
    beta_2: float = 0.999
    tokens_per_item: int = 24
    patience: int = 5
    smoothing: float = 0.1
    split: SplitConfig = field(default_factory=SplitConfig)

    @property
    def max_tokens(self) -> int:
        """Padded tokens that a batch may hold."""
        return self.batch_size * self.tokens_per_item

    @classmethod
    def full_run(cls, batch_size: int = BATCH_SIZES[0]) -> TrainingConfig:
        return cls(epochs=50, batch_size=batch_size, learning_rate=5e-4, beta_2=0.98)


def is_memory_error(error: BaseException | str) -> bool:
    text = str(error).lower()
    return any(sign in text for sign in MEMORY_SIGNS)


def with_smaller_batches(run: Callable[[TrainingConfig], object], config: TrainingConfig, sizes: Iterable[int] = BATCH_SIZES):
    """The result of ``run`` at the first batch size that memory suffices for; any other error goes on to the caller."""
    for size in sizes:
        try:
            return run(replace(config, batch_size=size))
        except Exception as error:
            if not (isinstance(error, MemoryError) or is_memory_error(error)):
                raise
            last = error
    raise MemoryError("no batch size is small enough") from last


def first_working(candidates: Iterable[tuple[str, Callable[[], object]]], forced: str | None = None) -> tuple[str, object]:
    """The first candidate whose probe succeeds, with the probe's value; ``forced`` allows one name only."""
    named = list(candidates)
    if forced is not None and forced not in {n for n, _ in named}:
        raise ValueError(f"unknown choice {forced!r}; known are {', '.join(n for n, _ in named)}")
    failures = []
    for name, probe in named:
        if forced in (None, name):
            try:
                return name, probe()
            except Exception as error:
                failures.append(f"{name}: {error}")
    raise RuntimeError("; ".join(failures) or "nothing to choose from")
