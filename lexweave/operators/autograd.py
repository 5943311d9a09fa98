"""A small reverse-mode differentiation over numpy arrays: what a translation model needs and no more."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _fit(gradient: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sums a gradient over the axes that broadcasting has added or widened."""
    while gradient.ndim > len(shape):
        gradient = gradient.sum(axis=0)
    for axis, n in enumerate(shape):
        if n == 1 and gradient.shape[axis] != 1:
            gradient = gradient.sum(axis=axis, keepdims=True)
    return gradient


class Value:
    """An array, and how its gradient flows back to what it was made of."""

    def __init__(self, data, parents: tuple[Value, ...] = (), back: Callable[[np.ndarray], tuple] | None = None):
        self.data, self.parents, self.back, self.gradient = np.asarray(data, dtype=np.float64), parents, back, None

    @property
    def shape(self):
        return self.data.shape

    def __add__(self, other: Value) -> Value:
        return Value(self.data + other.data, (self, other), lambda g: (_fit(g, self.shape), _fit(g, other.shape)))

    def __mul__(self, other: Value) -> Value:
        return Value(self.data * other.data, (self, other), lambda g: (_fit(g * other.data, self.shape), _fit(g * self.data, other.shape)))

    def __matmul__(self, other: Value) -> Value:
        def back(g):
            return _fit(g @ np.swapaxes(other.data, -1, -2), self.shape), _fit(np.swapaxes(self.data, -1, -2) @ g, other.shape)

        return Value(self.data @ other.data, (self, other), back)

    def scale(self, k: float) -> Value:
        return Value(self.data * k, (self,), lambda g: (g * k,))

    def reshape(self, *shape: int) -> Value:
        return Value(self.data.reshape(shape), (self,), lambda g: (g.reshape(self.shape),))

    def transpose(self, *axes: int) -> Value:
        return Value(self.data.transpose(axes), (self,), lambda g: (g.transpose(np.argsort(axes)),))

    def gelu(self) -> Value:
        x = self.data
        t = np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3))
        slope = 0.5 * (1 + t) + 0.5 * x * (1 - t**2) * np.sqrt(2 / np.pi) * (1 + 3 * 0.044715 * x**2)
        return Value(0.5 * x * (1 + t), (self,), lambda g: (g * slope,))

    def rows(self, index: np.ndarray) -> Value:
        """Rows by index: an embedding."""

        def back(g):
            out = np.zeros(self.shape)
            np.add.at(out, index, g)
            return (out,)

        return Value(self.data[index], (self,), back)

    def softmax(self, blocked: np.ndarray) -> Value:
        """Over the last axis, with no mass where ``blocked``; a row that is wholly blocked is zero."""
        x = np.where(blocked, -np.inf, self.data)
        top = x.max(axis=-1, keepdims=True)
        e = np.where(blocked, 0.0, np.exp(x - np.where(np.isfinite(top), top, 0.0)))
        p = e / np.maximum(e.sum(axis=-1, keepdims=True), 1e-300)
        return Value(p, (self,), lambda g: (p * (g - (g * p).sum(axis=-1, keepdims=True)),))

    def normed(self, gain: Value, shift: Value, epsilon: float = 1e-5) -> Value:
        """Layer normalisation over the last axis."""
        centred = self.data - self.data.mean(axis=-1, keepdims=True)
        deviation = np.sqrt((centred**2).mean(axis=-1, keepdims=True) + epsilon)
        x = centred / deviation

        def back(g):
            gx = g * gain.data
            own = (gx - gx.mean(axis=-1, keepdims=True) - x * (gx * x).mean(axis=-1, keepdims=True)) / deviation
            return own, _fit(g * x, gain.shape), _fit(g, shift.shape)

        return Value(x * gain.data + shift.data, (self, gain, shift), back)

    def differentiate(self, gradient: np.ndarray) -> None:
        """Fills ``gradient`` of everything that this value was made of."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack.extend((p, False) for p in v.parents)
        self.gradient = gradient
        for v in reversed(order):
            if v.back is not None:
                for parent, g in zip(v.parents, v.back(v.gradient), strict=True):
                    parent.gradient = g if parent.gradient is None else parent.gradient + g
