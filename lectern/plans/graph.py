"""A linear graph of stages over a state: each stage returns what it adds or changes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

State = dict[str, Any]


class Graph:
    def __init__(self) -> None:
        self.nodes: dict[str, Callable[[State], State]] = {}
        self.edges: dict[str, list[str]] = {}
        self.entry: str | None = None

    def add_node(self, name: str, stage: Callable[[State], State]) -> Graph:
        if name in self.nodes:
            raise ValueError(f"node {name} exists")
        self.nodes[name] = stage
        return self

    def add_edge(self, source: str, target: str) -> Graph:
        self.edges.setdefault(source, []).append(target)
        return self

    def set_entry_point(self, name: str) -> Graph:
        self.entry = name
        return self

    def compile(self) -> Compiled:
        if self.entry is None:
            raise ValueError("no entry point")
        order, at = [], self.entry
        while at in self.nodes:
            if at in order:
                raise ValueError(f"{at} comes up again: stages must not loop")
            order.append(at)
            at = (self.edges.get(at) or [""])[0]  # the first edge leads on
        return Compiled([(n, self.nodes[n]) for n in order])


class Compiled:
    def __init__(self, stages: list[tuple[str, Callable[[State], State]]]) -> None:
        self.stages = stages

    def invoke(self, state: State) -> State:
        state = dict(state)
        state.setdefault("trace", [])
        for name, stage in self.stages:
            state |= stage(state) or {}
            state["trace"].append(name)
        return state


def chain(*stages: tuple[str, Callable[[State], State]]) -> Compiled:
    g = Graph()
    for name, stage in stages:
        g.add_node(name, stage)
    for (a, _), (b, _) in zip(stages, stages[1:], strict=False):
        g.add_edge(a, b)
    return g.set_entry_point(stages[0][0]).compile()
