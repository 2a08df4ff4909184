"""Declared pipelines: manifests, validation, order, and running nodes as DataFrame transformations.

The graph is small and lives on the driver; the data that nodes transform never does.
"""

from __future__ import annotations

import heapq
import json
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "pipeline string, name string, type string, depends_on array<string>, config string"


class GraphError(ValueError):
    """A pipeline that cannot be ordered."""


@dataclass
class Context:
    """What nodes share: frames by name, settings, and a flag that stops the run."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    metadata: dict[str, object] = field(default_factory=dict)
    cancelled: bool = False

    def cancel(self) -> None:
        self.cancelled = True


class Node(ABC):
    """A step. It reads frames of its context and returns the one it makes."""

    name: str

    @abstractmethod
    def process(self, context: Context) -> DataFrame | None: ...


@dataclass
class TransformNode(Node):
    """A function of the context as a node."""

    name: str
    transform: Callable[[Context], DataFrame | None]

    def process(self, context: Context) -> DataFrame | None:
        return self.transform(context)


class Graph:
    """Nodes with dependencies, run in order."""

    def __init__(self):
        self.nodes: dict[str, Node] = {}
        self.depends: dict[str, tuple[str, ...]] = {}

    def add(self, node: Node, depends_on: tuple[str, ...] | list[str] = ()) -> Graph:
        self.nodes[node.name], self.depends[node.name] = node, tuple(depends_on)
        return self

    def __len__(self) -> int:
        return len(self.nodes)

    def order(self) -> list[str]:
        return topological_order(self.depends)

    def run(self, context: Context) -> Context:
        """Nodes in order; a cancelled context stops between nodes, and an error stops the run."""
        for name in self.order():
            if context.cancelled:
                raise GraphError("cancelled")
            made = self.nodes[name].process(context)
            if made is not None:
                context.frames[name] = made
        return context


def topological_order(depends: dict[str, tuple[str, ...]]) -> list[str]:
    """Dependencies first; of the nodes that are ready, the least name first."""
    for name, needs in depends.items():
        for d in needs:
            if d not in depends:
                raise GraphError(f"{name} depends on {d}, which is not there")
    waiting = {n: len(set(d)) for n, d in depends.items()}
    ready = [n for n, k in waiting.items() if not k]
    heapq.heapify(ready)
    out = []
    while ready:
        n = heapq.heappop(ready)
        out.append(n)
        for m, needs in depends.items():
            if n in needs:
                waiting[m] -= 1
                if not waiting[m]:
                    heapq.heappush(ready, m)
    if len(out) < len(depends):
        raise GraphError("cycle among " + ", ".join(sorted(set(depends) - set(out))))
    return out


def read_manifest(text: str) -> list[dict]:
    """The nodes of a YAML or JSON manifest: name, type, depends_on, config."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    return [{"pipeline": data.get("name", ""), "name": n["name"], "type": n.get("type", ""), "depends_on": list(n.get("depends_on", [])), "config": json.dumps(n.get("config", {}))} for n in data.get("nodes", [])]


def missing_dependencies(edges: DataFrame) -> DataFrame:
    """(pipeline, name, dep) of edges (pipeline, name, dep) whose dependency is no node: an anti-join."""
    names = edges.select("pipeline", F.col("name").alias("dep")).distinct()
    return edges.where("dep <> ''").join(names, ["pipeline", "dep"], "left_anti").select("pipeline", "name", "dep")


def cyclic_pipelines(edges: DataFrame) -> DataFrame:
    """(pipeline): those in which some node comes to itself, however long the way. One Arrow group a manifest."""

    def run(frame):
        import pandas as pd

        needs: dict[str, set] = {}
        for r in frame.itertuples():
            needs.setdefault(r.name, set()).update([r.dep] if r.dep else [])
        while gone := [n for n, d in needs.items() if not d & needs.keys()]:
            for n in gone:
                del needs[n]
        return pd.DataFrame([(frame.pipeline.iloc[0],)] * bool(needs), columns=["pipeline"])

    return edges.groupBy("pipeline").applyInPandas(run, "pipeline string")


def orders(edges: DataFrame) -> DataFrame:
    """(pipeline, place, name, error): the order of every pipeline of a table of edges, or why it has none."""

    def run(frame):
        import pandas as pd

        depends: dict[str, tuple] = {}
        for r in frame.itertuples():
            depends[r.name] = (*depends.get(r.name, ()), *([r.dep] if r.dep else []))
        try:
            found = [(frame.pipeline.iloc[0], i, n, None) for i, n in enumerate(topological_order(depends))]
        except GraphError as e:
            found = [(frame.pipeline.iloc[0], -1, None, str(e))]
        return pd.DataFrame(found, columns=["pipeline", "place", "name", "error"])

    return edges.groupBy("pipeline").applyInPandas(run, "pipeline string, place int, name string, error string")


# Jobs and events


def last_status(events: DataFrame) -> DataFrame:
    """(job_id, status, n) of event rows (job_id, seq, status)."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.count(F.lit(1)).alias("n"))


def queue_counts(events: DataFrame) -> DataFrame:
    return last_status(events).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


def next_jobs(events: DataFrame) -> DataFrame:
    """Pending jobs, first come first; cancelled ones are not handed out."""
    first = events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.min("event_id").alias("first_event"))
    return first.where("status = 'pending'").select("job_id", "first_event")


# Plugins


class Plugin(ABC):
    """A named change of a document frame."""

    name: str
    version = "1"

    def init(self) -> None: ...

    @abstractmethod
    def handle(self, action: str, frame: DataFrame, metadata: dict) -> DataFrame: ...

    def cleanup(self) -> None: ...


class Registry:
    """Plugins in the order they were registered."""

    def __init__(self):
        self.plugins: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        if plugin.name in self.plugins:
            raise ValueError(f"{plugin.name} is registered already")
        plugin.init()
        self.plugins[plugin.name] = plugin

    def unregister(self, name: str) -> None:
        self.plugins.pop(name).cleanup()

    def has(self, name: str) -> bool:
        return name in self.plugins

    def list(self) -> list[str]:
        return list(self.plugins)

    def handle(self, name: str, action: str, frame: DataFrame, metadata: dict | None = None) -> DataFrame:
        return self.plugins[name].handle(action, frame, metadata or {})

    def handle_all(self, action: str, frame: DataFrame, metadata: dict | None = None, names: set[str] | None = None) -> DataFrame:
        for name, plugin in self.plugins.items():
            if names is None or name in names:
                frame = plugin.handle(action, frame, metadata or {})
        return frame
