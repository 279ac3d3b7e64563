"""Run configuration: frozen sections with checked values, and documents that extend others."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, is_dataclass

from sievemill.functions import vocab as V


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Waves:
    first: int = V.FIRST_WAVE
    refill: int = V.REFILL
    most: int = V.MOST_CANDIDATES

    def __post_init__(self) -> None:
        _check(0 < self.first <= self.most and 0 < self.refill <= self.most, "waves must be positive and fit the candidate limit")


@dataclass(frozen=True)
class Labels:
    rollouts: int = V.LABEL_ROLLOUTS
    retries: int = V.RETRIES

    def __post_init__(self) -> None:
        _check(self.rollouts > 0 and self.retries >= 0, "label rollouts must be positive")


@dataclass(frozen=True)
class Scores:
    rollouts: int = V.SCORE_ROLLOUTS
    retries: int = V.RETRIES
    low: float = V.BAND[0]
    high: float = V.BAND[1]

    def __post_init__(self) -> None:
        _check(self.rollouts > 1, "a score needs two rollouts at least")
        _check(0.0 <= self.low < self.high <= 1.0, "band must satisfy 0 <= low < high <= 1")


@dataclass(frozen=True)
class Novelty:
    near: float = V.NEAR
    parent_ceiling: float = V.PARENT_CEILING
    containment: float = V.CONTAINMENT
    shared: int = V.SHARED
    sibling: float = V.SIBLING
    least_chars: int = V.QUESTION_CHARS[0]
    most_chars: int = V.QUESTION_CHARS[1]

    def __post_init__(self) -> None:
        _check(all(0 < x <= 1 for x in (self.near, self.parent_ceiling, self.containment, self.sibling)), "thresholds must be in (0, 1]")
        _check(0 < self.least_chars <= self.most_chars and self.shared > 0, "question length bounds")


@dataclass(frozen=True)
class Selection:
    batch: int = V.BATCH
    lag: int = V.LAG
    remeasure: int = V.REMEASURE
    per_cell: int = V.PER_CELL

    def __post_init__(self) -> None:
        _check(self.batch > 0 and self.per_cell > 0 and self.remeasure >= 0, "batch and cap must be positive")
        _check(self.lag == 1, "selection lag is one iteration")


@dataclass(frozen=True)
class Config:
    seed: int = 42
    max_cycles: int = V.MAX_CYCLES
    max_updates: int = V.MAX_UPDATES
    waves: Waves = field(default_factory=Waves)
    labels: Labels = field(default_factory=Labels)
    scores: Scores = field(default_factory=Scores)
    novelty: Novelty = field(default_factory=Novelty)
    selection: Selection = field(default_factory=Selection)


def build(values: Mapping, kind: type = Config):
    """A config of nested values; unknown names raise."""
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings in {kind.__name__}: {sorted(unknown)}")
    default = kind()
    return kind(**{k: build(v, type(getattr(default, k))) if is_dataclass(getattr(default, k)) else v for k, v in values.items()})


def merged(base: Mapping, over: Mapping) -> dict:
    return {**base, **{k: merged(base[k], v) if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else v for k, v in over.items()}}


def load(path: str, read: Callable[[str], str], _on_way: tuple[str, ...] = ()) -> dict:
    """The JSON document at a path over the one it names under "extends", which is relative to it; a circle raises."""
    if path in _on_way:
        raise ValueError("configs extend each other: " + " -> ".join((*_on_way, path)))
    values = json.loads(read(path))
    if not isinstance(values, dict):
        raise ValueError(f"{path} is not an object")
    if base := values.pop("extends", None):
        values = merged(load(path.rpartition("/")[0] + "/" + base if "/" in path else base, read, (*_on_way, path)), values)
    return values
