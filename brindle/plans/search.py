"""A seeded sequential search: random first, then by the ratio of densities of good and other trials."""

from __future__ import annotations

import math

import numpy as np

FIRST, CANDIDATES, GOOD = 10, 24, 0.25


class Search:
    def __init__(self, space: dict[str, dict], seed: int):
        self.space, self.rng, self.trials = space, np.random.default_rng(seed), []

    def _scaled(self, spec: dict) -> tuple[float, float]:
        low, high = spec["low"], spec["high"]
        return (math.log(low), math.log(high)) if spec.get("log") else (float(low), float(high))

    def _real(self, spec: dict, u: float):
        x = math.exp(u) if spec.get("log") else u
        if "step" in spec:
            x = spec["low"] + round((x - spec["low"]) / spec["step"]) * spec["step"]
        x = min(spec["high"], max(spec["low"], x))
        return int(round(x)) if spec["type"] == "int" else float(x)

    def _inner(self, spec: dict, x) -> float:
        return math.log(x) if spec.get("log") else float(x)

    def ask(self) -> dict:
        out = {}
        done = sorted(self.trials, key=lambda t: t[1])
        good = done[: max(1, math.ceil(GOOD * len(done)))]
        for name, spec in self.space.items():
            if spec["type"] == "categorical":
                choices = spec["choices"]
                weights = np.ones(len(choices))
                if len(done) >= FIRST:
                    for params, _ in good:
                        weights[choices.index(params[name])] += 1
                out[name] = choices[int(self.rng.choice(len(choices), p=weights / weights.sum()))]
                continue
            low, high = self._scaled(spec)
            if len(done) < FIRST or low == high:
                out[name] = self._real(spec, self.rng.uniform(low, high))
                continue
            width = (high - low) / 5
            a = np.array([self._inner(spec, p[name]) for p, _ in good])
            b = np.array([self._inner(spec, p[name]) for p, _ in done[len(good) :]] or [(low + high) / 2])
            u = np.clip(self.rng.choice(a, CANDIDATES) + self.rng.normal(0, width, CANDIDATES), low, high)
            near = lambda c: np.exp(-0.5 * ((u[:, None] - c[None]) / width) ** 2).mean(1) + 1e-12
            out[name] = self._real(spec, float(u[np.argmax(near(a) / near(b))]))
        return out

    def tell(self, params: dict, value: float) -> None:
        self.trials.append((params, value))
