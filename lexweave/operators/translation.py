"""A pre-norm Transformer for translation over compact ids, in numpy, with shared embeddings on both sides and the output."""

from __future__ import annotations

import io

import numpy as np

from lexweave.operators.autograd import Value
from lexweave.operators.vocabulary import COMPACT_PAD
from lexweave.plans.config import ModelConfig

Parameters = dict[str, np.ndarray]


def initial(config: ModelConfig, seed: int) -> Parameters:
    rng = np.random.default_rng(seed)
    d, h = config.width, config.hidden
    matrix = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
    out: Parameters = {"embedding": rng.normal(0, d**-0.5, (config.vocabulary_size, d))}

    def norm(name):
        out[f"{name}.gain"], out[f"{name}.shift"] = np.ones(d), np.zeros(d)

    def attention(name):
        for part in ("q", "k", "v", "o"):
            out[f"{name}.{part}"], out[f"{name}.{part}.bias"] = matrix(d, d), np.zeros(d)
        norm(f"{name}.norm")

    for side, kinds in (("encoder", ("self",)), ("decoder", ("self", "cross"))):
        for layer in range(config.layers):
            name = f"{side}.{layer}"
            for kind in kinds:
                attention(f"{name}.{kind}")
            out |= {f"{name}.in": matrix(d, h), f"{name}.in.bias": np.zeros(h), f"{name}.out": matrix(h, d), f"{name}.out.bias": np.zeros(d)}
            norm(f"{name}.norm")
        norm(f"{side}.norm")
    return out


def positions(length: int, width: int) -> np.ndarray:
    """Sines and cosines of the place."""
    angle = np.arange(length)[:, None] / 10_000 ** (2 * (np.arange(width) // 2) / width)
    return np.where(np.arange(width) % 2 == 0, np.sin(angle), np.cos(angle))


class Model:
    """Parameters as values, and the forward pass over padded batches."""

    def __init__(self, config: ModelConfig, parameters: Parameters, dropout: float = 0.0, seed: int = 0):
        self.config, self.p = config, {k: Value(v) for k, v in parameters.items()}
        self.dropout, self.rng = dropout, np.random.default_rng(seed)

    def _drop(self, x: Value) -> Value:
        if not self.dropout:
            return x
        return x * Value((self.rng.random(x.shape) >= self.dropout) / (1 - self.dropout))

    def _norm(self, x: Value, name: str) -> Value:
        return x.normed(self.p[f"{name}.gain"], self.p[f"{name}.shift"])

    def _linear(self, x: Value, name: str) -> Value:
        return x @ self.p[name] + self.p[f"{name}.bias"]

    def _attend(self, x: Value, memory: Value, name: str, blocked: np.ndarray) -> Value:
        b, n, d = x.shape
        heads, size = self.config.heads, d // self.config.heads
        split = lambda v: v.reshape(b, v.shape[1], heads, size).transpose(0, 2, 1, 3)
        q, k, v = (split(self._linear(s, f"{name}.{part}")) for part, s in (("q", x), ("k", memory), ("v", memory)))
        weights = (q @ k.transpose(0, 1, 3, 2)).scale(size**-0.5).softmax(np.broadcast_to(blocked, (b, heads, n, memory.shape[1])))
        return self._linear((self._drop(weights) @ v).transpose(0, 2, 1, 3).reshape(b, n, d), f"{name}.o")

    def _feed(self, x: Value, name: str) -> Value:
        own = self._linear(self._norm(x, f"{name}.norm"), f"{name}.in").gelu()
        return x + self._drop(self._linear(self._drop(own), f"{name}.out"))

    def _embed(self, ids: np.ndarray) -> Value:
        """Embeddings, unscaled, and places."""
        return self._drop(self.p["embedding"].rows(ids) + Value(positions(ids.shape[1], self.config.width)))

    def encode(self, src: np.ndarray) -> Value:
        x, blocked = self._embed(src), (src == COMPACT_PAD)[:, None, None, :]
        for layer in range(self.config.layers):
            name = f"encoder.{layer}"
            own = self._norm(x, f"{name}.self.norm")
            x = self._feed(x + self._drop(self._attend(own, own, f"{name}.self", blocked)), name)
        return self._norm(x, "encoder.norm")

    def decode(self, memory: Value, src: np.ndarray, tgt_in: np.ndarray) -> Value:
        n = tgt_in.shape[1]
        later = np.arange(n)[None, :] > np.arange(n)[:, None]
        x, blocked = self._embed(tgt_in), later[None, None] | (tgt_in == COMPACT_PAD)[:, None, None, :]
        across = (src == COMPACT_PAD)[:, None, None, :]
        for layer in range(self.config.layers):
            name = f"decoder.{layer}"
            own = self._norm(x, f"{name}.self.norm")
            x = x + self._drop(self._attend(own, own, f"{name}.self", blocked))
            x = x + self._drop(self._attend(self._norm(x, f"{name}.cross.norm"), memory, f"{name}.cross", across))
            x = self._feed(x, name)
        return self._norm(x, "decoder.norm")

    def logits(self, src: np.ndarray, tgt_in: np.ndarray | None = None) -> Value:
        """(batch, length, vocabulary) through the embedding's transpose; of the encoder's output without a target."""
        memory = self.encode(src)
        return self.project(memory if tgt_in is None else self.decode(memory, src, tgt_in))

    def project(self, hidden: Value) -> Value:
        """Logits, by the embeddings again."""
        return hidden @ self.p["embedding"].transpose(1, 0)


def loss(logits: np.ndarray, target: np.ndarray, smoothing: float) -> tuple[tuple[float, float, int, int], np.ndarray]:
    """(loss, nll_sum, correct, tokens) of a batch, and the loss's gradient by the logits."""
    shifted = logits - logits.max(axis=-1, keepdims=True)
    log_p = shifted - np.log(np.exp(shifted).sum(axis=-1, keepdims=True))
    valid = target != COMPACT_PAD
    tokens, n = int(valid.sum()), logits.shape[-1]
    own = np.take_along_axis(log_p, target[..., None], axis=-1)[..., 0]
    each = -((1 - smoothing) * own + smoothing * log_p.mean(axis=-1))
    wanted = np.full(logits.shape, smoothing / n)
    np.put_along_axis(wanted, target[..., None], 1 - smoothing + smoothing / n, axis=-1)
    gradient = (np.exp(log_p) - wanted) * (valid / max(tokens, 1))[..., None]
    stats = (float((each * valid).sum() / max(tokens, 1)), float(-(own * valid).sum()), int(((logits.argmax(axis=-1) == target) & valid).sum()), tokens)
    return stats, gradient


class Adam:
    def __init__(self, rate: float, beta_1: float = 0.9, beta_2: float = 0.999, epsilon: float = 1e-5):
        self.rate, self.beta_1, self.beta_2, self.epsilon, self.step_ = rate, beta_1, beta_2, epsilon, 0
        self.m: Parameters = {}
        self.v: Parameters = {}

    def step(self, parameters: Parameters, gradients: Parameters) -> None:
        self.step_ += 1
        for k, g in gradients.items():
            self.m[k] = self.beta_1 * self.m.get(k, 0.0) + (1 - self.beta_1) * g
            self.v[k] = self.beta_2 * self.v.get(k, 0.0) + (1 - self.beta_2) * g * g
            m, v = self.m[k] / (1 - self.beta_1**self.step_), self.v[k] / (1 - self.beta_2**self.step_)
            parameters[k] -= self.rate * m / (np.sqrt(v) + self.epsilon)


def train_step(config: ModelConfig, parameters: Parameters, adam: Adam, batch: dict[str, np.ndarray], smoothing: float, seed: int) -> tuple[float, float, int, int]:
    """One step on one batch, in place; the batch's statistics before it."""
    model = Model(config, parameters, config.dropout, seed)
    logits = model.logits(batch["src"], batch["tgt_in"])
    stats, gradient = loss(logits.data, batch["tgt_out"], smoothing)
    logits.differentiate(gradient)
    adam.step(parameters, {k: v.gradient for k, v in model.p.items() if v.gradient is not None})
    return stats


def valid_step(config: ModelConfig, parameters: Parameters, batch: dict[str, np.ndarray], smoothing: float) -> tuple[float, float, int, int]:
    return loss(Model(config, parameters).logits(batch["src"], batch["tgt_in"]).data, batch["tgt_out"], smoothing)[0]


def to_bytes(parameters: Parameters) -> bytes:
    """A compact record: half precision is enough for a finished model."""
    out = io.BytesIO()
    np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in parameters.items()})
    return out.getvalue()


def from_bytes(data: bytes) -> Parameters:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k].astype(np.float64) for k in found.files}
