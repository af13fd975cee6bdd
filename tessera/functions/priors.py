"""Logarithms of prior densities of fit parameters, with gradients; x may be an array."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


class Free:
    """No preference."""

    def value(self, x):
        return np.zeros_like(np.asarray(x, float))

    def gradient(self, x):
        return np.zeros_like(np.asarray(x, float))


@dataclass(frozen=True)
class Normal(Free):
    mu: float
    std: float

    def value(self, x):
        return -0.5 * ((np.asarray(x) - self.mu) / self.std) ** 2 - math.log(self.std) - 0.5 * math.log(2 * math.pi)

    def gradient(self, x):
        return (self.mu - np.asarray(x)) / self.std**2


def _inside(x, ok, value, outside):
    """value(x) where ok holds, outside elsewhere; value sees only good places."""
    x = np.asarray(x, float)
    return np.where(ok, value(np.where(ok, x, 1.0)), outside)


@dataclass(frozen=True)
class LogNormal(Free):
    mu: float
    std: float

    def value(self, x):
        return _inside(x, np.asarray(x) > 0, lambda v: Normal(self.mu, self.std).value(np.log(v)) - np.log(v), -np.inf)

    def gradient(self, x):
        return _inside(x, np.asarray(x) > 0, lambda v: (Normal(self.mu, self.std).gradient(np.log(v)) - 1) / v, 0.0)


@dataclass(frozen=True)
class Uniform(Free):
    left: float
    right: float

    def _ok(self, x):
        return (np.asarray(x) >= self.left) & (np.asarray(x) <= self.right)

    def value(self, x):
        return np.where(self._ok(x), -math.log(self.right - self.left), -np.inf)


@dataclass(frozen=True)
class LogUniform(Uniform):
    def value(self, x):
        return _inside(x, self._ok(x), lambda v: -math.log(math.log(self.right / self.left)) - np.log(v), -np.inf)

    def gradient(self, x):
        return _inside(x, self._ok(x), lambda v: -1 / v, 0.0)


@dataclass(frozen=True)
class Mix(Free):
    """Weighted mixture; weights are divided by their sum."""

    parts: tuple[tuple[float, Free], ...]

    def _logs(self, x):
        total = sum(w for w, _ in self.parts)
        return np.stack([math.log(w / total) + p.value(x) for w, p in self.parts])

    def value(self, x):
        return np.logaddexp.reduce(self._logs(x), axis=0)

    def gradient(self, x):
        logs = self._logs(x)
        top = np.logaddexp.reduce(logs, axis=0)
        share = np.where(np.isfinite(top), np.exp(logs - np.where(np.isfinite(top), top, 0)), 0)
        return (share * np.stack([p.gradient(x) for _, p in self.parts])).sum(0)


@dataclass(frozen=True)
class Independent:
    """One prior for each parameter; x has the parameters last."""

    parts: tuple[Free, ...]

    def value(self, x):
        return sum(p.value(x[..., i]) for i, p in enumerate(self.parts))

    def gradient(self, x):
        return np.stack([p.gradient(x[..., i]) for i, p in enumerate(self.parts)], -1)
