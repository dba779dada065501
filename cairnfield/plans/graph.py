"""Projects: graphs of steps in JSON, checked, put in order and turned into lazy DataFrames.

A document has ``format``, ``version``, ``nodes`` (id, iid, config) and ``edges`` (src, dst,
out_type, in_type). Nothing is computed while a graph is compiled, beyond the extents that
lattices need; shared upstream steps are compiled once.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from . import ports
from .nodes import NODES, Node

FORMAT, VERSION = "survey-graph", 2


class ProjectError(ValueError):
    pass


@dataclass(frozen=True)
class Edge:
    src: str
    dst: str
    out_type: str
    in_type: str


@dataclass
class Graph:
    nodes: dict[str, tuple[str, dict[str, Any]]] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Graph:
        return cls.parse(json.loads(Path(path).read_text(encoding="utf-8")))

    @classmethod
    def parse(cls, doc: dict) -> Graph:
        if not isinstance(doc, dict) or not isinstance(doc.get("nodes"), list) or not isinstance(doc.get("edges"), list):
            raise ProjectError("not a project: nodes and edges are missing")
        if not isinstance(doc.get("version"), int) or doc["version"] > VERSION:
            raise ProjectError(f"version {doc.get('version')!r} isn't supported")
        g = cls()
        for n in doc["nodes"]:
            if n["iid"] in g.nodes:
                raise ProjectError(f"two steps are called {n['iid']}")
            g.nodes[n["iid"]] = (n["id"], dict(n.get("config") or {}))
        for e in doc["edges"]:
            if e["src"] not in g.nodes or e["dst"] not in g.nodes:
                raise ProjectError(f"an edge ends nowhere: {e['src']} - {e['dst']}")
            g.edges.append(Edge(e["src"], e["dst"], e["out_type"], e["in_type"]))
        return g

    def dump(self) -> dict:
        return {"format": FORMAT, "version": VERSION, "nodes": [{"iid": k, "id": i, "config": c} for k, (i, c) in self.nodes.items()], "edges": [vars(e) for e in self.edges]}

    def node(self, iid: str) -> Node:
        return NODES[self.nodes[iid][0]]

    def order(self) -> list[str]:
        """Providers before consumers; as the document has them where that leaves a choice."""
        sorter = TopologicalSorter({k: [e.src for e in self.edges if e.dst == k] for k in self.nodes})
        try:
            return list(sorter.static_order())
        except CycleError as e:
            raise ProjectError(f"a cycle: {' - '.join(e.args[1])}") from None

    def without_drafts(self) -> Graph:
        """Steps that need inputs and have none at all are drafts, and don't run."""
        wired = {x for e in self.edges for x in (e.src, e.dst)}
        return self._only({k for k in self.nodes if k in wired or k not in self.nodes or self.nodes[k][0] not in NODES or not self.node(k).inputs})

    def _only(self, keep: set[str]) -> Graph:
        return Graph({k: v for k, v in self.nodes.items() if k in keep}, [e for e in self.edges if e.src in keep and e.dst in keep])

    def pruned(self, drop: set[str]) -> Graph:
        """Without some steps; what they would have got goes on to those that they fed, where types fit."""
        g = Graph(dict(self.nodes), list(self.edges))
        for d in [k for k in self.order() if k in drop]:
            into, out = [e for e in g.edges if e.dst == d], [e for e in g.edges if e.src == d]
            g.edges = [e for e in g.edges if d not in (e.src, e.dst)]
            g.edges += [Edge(i.src, o.dst, i.out_type, o.in_type) for o in out for i in into if ports.fits(i.out_type, o.in_type)]
            del g.nodes[d]
        return g

    def upstream(self, iid: str) -> Graph:
        keep, todo = set(), [iid]
        while todo:
            k = todo.pop()
            if k not in keep:
                keep.add(k)
                todo += [e.src for e in self.edges if e.dst == k]
        return self._only(keep)

    def boundary(self, chosen: set[str]) -> tuple[Graph, list[Edge]]:
        """The subgraph of some steps, and the edges that cross its border."""
        return self._only(chosen), [e for e in self.edges if (e.src in chosen) != (e.dst in chosen)]

    def deferred(self) -> set[str]:
        """Consolidating steps and all that is downstream of them: they run after all segments."""
        late = {k for k, (i, _) in self.nodes.items() if i.startswith("consolidate_")}
        for k in self.order():
            if any(e.src in late for e in self.edges if e.dst == k):
                late.add(k)
        return late

    def problems(self) -> list[str]:
        """Why the graph can't run; empty if it can."""
        return self.errors() + self.blocks()

    def blocks(self) -> list[str]:
        """What is missing: files that aren't chosen, inputs that aren't wired."""
        out = []
        for k, (i, config) in self.nodes.items():
            if i not in NODES:
                continue
            n = NODES[i]
            if "path" in n.defaults and not n.inputs and not config.get("path"):
                out.append(f"{k}: no file is chosen")
            into = [e for e in self.edges if e.dst == k]
            for name, kind in n.inputs.items():
                if name not in n.optional and not any(ports.fits(e.out_type, kind) for e in into):
                    out.append(f"{k}: input {name} ({kind}) isn't wired")
        return out

    def errors(self) -> list[str]:
        """What is wrong: unknown steps or settings, ports that don't fit, cycles."""
        out = []
        for k, (i, config) in self.nodes.items():
            if i not in NODES:
                out.append(f"{k}: there is no step {i}")
            elif extra := set(config) - set(NODES[i].defaults):
                out.append(f"{k}: no such setting: {', '.join(sorted(extra))}")
        for e in self.edges:
            if not ports.fits(e.out_type, e.in_type):
                out.append(f"{e.src} - {e.dst}: {e.out_type} doesn't fit {e.in_type}")
            if self.nodes[e.src][0] in NODES and e.out_type not in self.node(e.src).outputs.values():
                out.append(f"{e.src}: it gives no {e.out_type}")
        try:
            self.order()
        except ProjectError as e:
            out.append(str(e))
        return out

    def fingerprints(self) -> dict[str, str]:
        """Of each step with all that it depends on: the same text means the same result."""
        out: dict[str, str] = {}
        for k in self.order():
            i, config = self.nodes[k]
            settings = (self.node(k).defaults if i in NODES else {}) | config
            up = [f"{e.in_type}:{out[e.src]}" for e in self.edges if e.dst == k]
            stamp = ""
            if (p := settings.get("path")) and Path(str(p)).exists():
                s = Path(p).stat()
                stamp = f"{s.st_size}:{s.st_mtime_ns}"
            out[k] = hashlib.sha1(json.dumps([i, settings, up, stamp], sort_keys=True, default=str).encode()).hexdigest()[:16]
        return out

    def compile(self, spark: SparkSession) -> dict[str, dict[str, Any]]:
        """Outputs of each step by port name."""
        if found := self.problems():
            raise ProjectError("; ".join(found))
        done: dict[str, dict[str, Any]] = {}
        for k in self.order():
            n = self.node(k)
            given: dict[str, Any] = {name: [] for name in n.many}
            left = [e for e in self.edges if e.dst == k]
            for name, kind in n.inputs.items():
                # Inputs take edges by type, in the order of wiring.
                fit = [e for e in left if ports.fits(e.out_type, kind)]
                for e in fit if name in n.many else fit[:1]:
                    left.remove(e)
                    value = done[e.src][next(p for p, t in self.node(e.src).outputs.items() if t == e.out_type)]
                    if name in n.many:
                        given[name].append(value)
                    else:
                        given[name] = value
            done[k] = n.run(spark, **given, **(n.defaults | self.nodes[k][1]))
        return done


def over_files(graph: Graph, files: list[str]) -> list[Graph]:
    """The graph once for each file, in order, repeats left out: a queue."""
    out = []
    for f in dict.fromkeys(files):
        nodes = {k: (i, c | {"path": f}) if i == "load_points" else (i, c) for k, (i, c) in graph.nodes.items()}
        out.append(Graph(nodes, list(graph.edges)))
    return out
