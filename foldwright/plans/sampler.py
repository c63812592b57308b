"""What proposes points and folds what came of them: the levels of a sweep as one kind of node."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

from foldwright.plans.control import Control


class Sampler(Protocol):
    """`ask` proposes points from a state and says whether it is done; `tell` adds one outcome; `result` closes."""

    def begin(self) -> Any: ...

    def ask(self, state: Any) -> tuple[Sequence[Any], bool]: ...

    def tell(self, state: Any, point: Any, outcome: Any) -> Any: ...

    def result(self, state: Any) -> Any: ...

    def size(self, state: Any) -> int | None:
        """How many points there will be, or None if that isn't known."""


def run(sampler: Sampler, of: Callable[[Any], Any], control: Control) -> Any:
    """Asks until the sampler is done. A batch runs side by side and is told in the order of its points.

    A batch without points from a sampler that isn't done would go on for ever, so it is an error.
    """
    state, done = sampler.begin(), False
    while not done:
        points, done = sampler.ask(state)
        if not points and not done:
            raise RuntimeError(f"{type(sampler).__name__} proposes nothing and is not done")
        for p, outcome in zip(points, control.run([lambda p=p: of(p) for p in points]), strict=True):
            state = sampler.tell(state, p, outcome)
    return sampler.result(state)


@dataclass(frozen=True)
class Fixed:
    """All points in one batch: a grid's configurations, or the folds of a resampling."""

    points: Sequence[Any]
    close: Callable[[list[tuple[Any, Any]]], Any] = list

    def begin(self) -> list:
        return []

    def ask(self, state: list) -> tuple[Sequence[Any], bool]:
        return self.points, True

    def tell(self, state: list, point: Any, outcome: Any) -> list:
        return [*state, (point, outcome)]

    def result(self, state: list) -> Any:
        return self.close(state)

    def size(self, state: list) -> int:
        return len(self.points)
