"""The low-level API: a graph of named sources, processors, stores and sinks, wired by name.

Processors are functions from their parents' frames (and the stores they name) to a frame, so the graph is a way to write
down DataFrame lineage; nothing runs until a sink is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class TopologyError(ValueError):
    pass


@dataclass
class Topology:
    sources: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    processors: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = field(default_factory=dict)
    stores: dict[str, tuple[Callable[[], DataFrame], tuple[str, ...]]] = field(default_factory=dict)
    sinks: dict[str, tuple[Callable[[DataFrame], object], tuple[str, ...]]] = field(default_factory=dict)
    wrapper: Callable[[str, Callable[..., DataFrame]], Callable[..., DataFrame]] | None = None
    _made: dict[str, DataFrame] = field(default_factory=dict)

    def _new(self, name: str, parents: Sequence[str] = ()) -> tuple[str, ...]:
        if not name or name in self.sources or name in self.processors or name in self.sinks:
            raise TopologyError(f"the name {name!r} is empty or taken")
        for p in parents:
            if p not in self.sources and p not in self.processors:
                raise TopologyError(f"{name!r} has an unknown parent {p!r}")
        return tuple(parents)

    def add_source(self, name: str, read: Callable[[], DataFrame]) -> Topology:
        self._new(name)
        self.sources[name] = read
        return self

    def add_processor(self, name: str, process: Callable[..., DataFrame], *parents: str) -> Topology:
        """Several parents' frames are given in order; stores connected to it as keyword arguments."""
        if not parents:
            raise TopologyError(f"{name!r} has no parent")
        self.processors[name] = (process, self._new(name, parents))
        return self

    def add_store(self, name: str, read: Callable[[], DataFrame], *processors: str) -> Topology:
        for p in processors:
            if p not in self.processors:
                raise TopologyError(f"the store {name!r} is connected to an unknown processor {p!r}")
        self.stores[name] = (read, processors)
        return self

    def add_sink(self, name: str, write: Callable[[DataFrame], object], *parents: str) -> Topology:
        self.sinks[name] = (write, self._new(name, parents))
        return self

    def frame(self, name: str) -> DataFrame:
        """The frame of a source or processor; shared parents are built once."""
        if name not in self._made:
            if name in self.sources:
                self._made[name] = self.sources[name]()
            else:
                process, parents = self.processors[name]
                process = self.wrapper(name, process) if self.wrapper else process
                stores = {s: read() for s, (read, users) in self.stores.items() if name in users}
                self._made[name] = process(*(self.frame(p) for p in parents), **stores)
        return self._made[name]

    def run(self) -> dict[str, object]:
        out = {}
        for name, (write, parents) in self.sinks.items():
            out[name] = [write(self.frame(p)) for p in parents]
        return out

    def describe(self) -> str:
        """Subtopologies: nodes that are connected to each other, by name."""
        edges = [(p, n) for n, (_, ps) in [*self.processors.items(), *self.sinks.items()] for p in ps]
        group = {n: n for n in [*self.sources, *self.processors, *self.sinks]}
        for a, b in edges * max(1, len(group)):
            group[a] = group[b] = min(group[a], group[b])
        lines = []
        for i, g in enumerate(sorted(set(group.values()))):
            lines.append(f"Sub-topology: {i}")
            for n in (n for n in group if group[n] == g):
                kind = "Source" if n in self.sources else "Processor" if n in self.processors else "Sink"
                stores = [s for s, (_, users) in self.stores.items() if n in users]
                lines.append(f"  {kind}: {n}" + (f" (stores: {', '.join(stores)})" if stores else "") + f" --> {', '.join(b for a, b in edges if a == n) or 'none'}")
        return "\n".join(lines)
