"""A graph of named stages: checks, order, closure, windows and runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...] = ()


@dataclass
class Graph:
    stages: list[Stage]
    events: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        names = [s.name for s in self.stages]
        if len(set(names)) != len(names):
            raise ValueError("two stages have one name")
        if unknown := {n for s in self.stages for n in s.needs} - set(names):
            raise ValueError(f"unknown stages: {sorted(unknown)}")
        try:
            self._sorted()
        except CycleError as e:
            raise ValueError("the stages form a cycle") from e

    def _sorted(self) -> list[str]:
        return list(TopologicalSorter({s.name: s.needs for s in self.stages}).static_order())

    def order(self) -> list[str]:
        """Stages in the order of declaration, as far as needs allow."""
        done: list[str] = []
        left = list(self.stages)
        while left:
            s = next(x for x in left if set(x.needs) <= set(done))
            done.append(s.name)
            left.remove(s)
        return done

    def closure(self, targets: Iterable[str]) -> list[str]:
        """The targets and all that they need, in order."""
        needs = {s.name: s.needs for s in self.stages}
        todo, found = list(targets), set()
        while todo:
            n = todo.pop()
            if n not in needs:
                raise ValueError(f"unknown stage: {n}")
            if n not in found:
                found.add(n)
                todo += needs[n]
        return [n for n in self.order() if n in found]

    def window(self, start: str | None = None, through: str | None = None) -> list[str]:
        order = self.order()
        a = order.index(start) if start else 0
        b = order.index(through) if through else len(order) - 1
        if a > b:
            raise ValueError("the window ends before it starts")
        return order[a : b + 1]

    def run(self, names: Iterable[str], status: Callable[[str], str], act: Callable[[str], None], rebuild: Iterable[str] = ()) -> None:
        """Skip what is complete, run what is missing; stale or failed stages stop the run unless they are to be rebuilt."""
        again = set(rebuild)
        for n in names:
            state = status(n)
            if state == "complete" and n not in again:
                self.events.append((n, "skipped"))
                continue
            if state in ("stale", "failed") and n not in again:
                self.events.append((n, "stopped"))
                raise RuntimeError(f"{n} is {state}")
            act(n)
            self.events.append((n, "ran"))
