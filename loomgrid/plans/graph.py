"""Named-node graphs over DataFrames: declaration, groups, validation and (partial) evaluation.

    with Graph("g") as g:
        a = g.node("load", lambda inputs: spark.read.parquet(path))
        b = g.node("rank", lambda inputs: rank(inputs["default"]))
        a >> b
    Runner(g, store).run("rank")

A node's function takes a dict from input channel to DataFrame and gives a DataFrame. Nothing is
computed until a result is used; a node with ``materialise=True`` is written to the artifact store,
and later runs read its latest version instead of computing it again.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NodeFunction = Callable[[dict[str, DataFrame]], DataFrame]


class GraphError(ValueError):
    """A graph that cannot be evaluated, with all that is wrong with it."""


@dataclass(frozen=True)
class Edge:
    node_from: str
    node_to: str
    input_id: str = "default"


def check_id(name: str) -> str:
    """A dotted identifier: non-empty parts without white space or slashes."""
    if not name or any(not part or any(c.isspace() or c in "/\\" for c in part) for part in name.split(".")):
        raise GraphError(f"{name!r} is not a dotted identifier")
    return name


@dataclass
class Node:
    """A named step of a graph."""

    graph: Graph
    id: str
    run: NodeFunction
    op: str = "node"
    materialise: bool = False

    def __rshift__(self, other):
        """Wire into the other's default input; lists fan out, ports take their channel."""
        for target in other if isinstance(other, (list, tuple)) else [other]:
            node, channel = (target.node, target.input_id) if isinstance(target, Port) else (target, "default")
            if isinstance(node, Group):
                for entry in node.entries:
                    self >> entry
            else:
                self.graph.edge(self.id, node.id, channel)
        return other

    def __rrshift__(self, others):
        for source in others:
            source >> self
        return self

    def port(self, input_id: str) -> Port:
        return Port(self, input_id)

    def __add__(self, other: Node) -> Node:
        return self.graph.merge([*self._parts(), *other._parts()])

    def _parts(self) -> list[Node]:
        return self.graph.merged.get(self.id, [self])


@dataclass(frozen=True)
class Port:
    """An input channel of a node."""

    node: Node
    input_id: str


@dataclass
class Group:
    """Nodes under one prefix, with entries and one output."""

    entries: list[Node]
    output: Node
    members: list[Node] = field(default_factory=list)

    def __rshift__(self, other):
        return self.output >> other


@dataclass
class Graph:
    """Nodes and edges by name; ``scope`` puts a prefix before the names of what is declared inside."""

    name: str
    nodes: dict[str, Node] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    merged: dict[str, list[Node]] = field(default_factory=dict)
    prefix: tuple[str, ...] = ()

    def __enter__(self) -> Graph:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            validate(self)
            REGISTRY.add(self)

    def node(self, name: str, run: NodeFunction, *, op: str = "node", materialise: bool = False) -> Node:
        full = check_id(".".join([*self.prefix, name]))
        if full in self.nodes:
            raise GraphError(f"the node {full!r} exists already")
        self.nodes[full] = Node(self, full, run, op, materialise)
        return self.nodes[full]

    def edge(self, node_from: str, node_to: str, input_id: str = "default") -> None:
        made = Edge(node_from, node_to, input_id)
        if made not in self.edges:
            self.edges.append(made)

    def group(self, name: str, build: Callable[[Graph], tuple[Iterable[Node], Node]]) -> Group:
        """Nodes that ``build`` declares, under the prefix ``name``; it returns (entries, output)."""
        before, outer = set(self.nodes), self.prefix
        self.prefix = (*outer, name)
        try:
            entries, output = build(self)
        finally:
            self.prefix = outer
        return Group(list(entries), output, [n for i, n in self.nodes.items() if i not in before])

    def merge(self, parts: list[Node]) -> Node:
        """An ordered union of nodes; the same parts give the same node again."""
        import hashlib

        digest = hashlib.sha1("\0".join(p.id for p in parts).encode()).hexdigest()[:10]
        name = f"merge_{digest}"
        if name not in self.nodes:
            n = len(parts)

            def run(inputs: dict[str, DataFrame]) -> DataFrame:
                rows = [inputs[f"part:{i}"].withColumn("input_idx", F.lit(i)) for i in range(n)]
                return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)

            self.nodes[name] = Node(self, name, run, "merge")
            for i, p in enumerate(parts):
                self.edge(p.id, name, f"part:{i}")
            self.merged[name] = parts
        return self.nodes[name]

    def inputs(self, node_id: str) -> list[Edge]:
        return [e for e in self.edges if e.node_to == node_id]


class Registry:
    """Graphs by name; the first of a name counts."""

    def __init__(self):
        self._all: list[Graph] = []

    def add(self, graph: Graph) -> None:
        self._all.append(graph)

    def get(self, name: str) -> Graph:
        for g in self._all:
            if g.name == name:
                return g
        raise KeyError(name)

    def names(self) -> list[str]:
        return [g.name for g in self._all]

    def clear(self) -> None:
        self._all.clear()


REGISTRY = Registry()


def find_cycle(edges: list[Edge]) -> list[str]:
    """The nodes of a cycle in order, its first node again at the end; empty without one."""
    after: dict[str, list[str]] = {}
    for e in edges:
        after.setdefault(e.node_from, []).append(e.node_to)
    done: set[str] = set()
    for start in after:
        path, todo = [], [(start, iter(after.get(start, ())))]
        on_path = {start}
        path.append(start)
        while todo and start not in done:
            node, rest = todo[-1]
            nxt = next((n for n in rest if n not in done), None)
            if nxt is None:
                done.add(node)
                on_path.discard(node)
                path.pop()
                todo.pop()
            elif nxt in on_path:
                return [*path[path.index(nxt) :], nxt]
            else:
                on_path.add(nxt)
                path.append(nxt)
                todo.append((nxt, iter(after.get(nxt, ()))))
    return []


def validate(graph: Graph) -> None:
    """Fail with everything that is wrong: endpoints that miss, inputs wired twice, cycles."""
    wrong = [f"edge to or from the unknown node {i!r}" for e in graph.edges for i in (e.node_from, e.node_to) if i not in graph.nodes]
    seen: set[tuple[str, str]] = set()
    for e in graph.edges:
        if (e.node_to, e.input_id) in seen:
            wrong.append(f"input {e.input_id!r} of {e.node_to!r} is wired twice")
        seen.add((e.node_to, e.input_id))
    if cycle := find_cycle(graph.edges):
        wrong.append("cycle: " + " -> ".join(cycle))
    if wrong:
        raise GraphError("; ".join(wrong))


class MemoryStore:
    """Artifacts of a session, by node."""

    def __init__(self):
        self._all: dict[str, DataFrame] = {}

    def load(self, node_id: str) -> DataFrame | None:
        return self._all.get(node_id)

    def save(self, node_id: str, df: DataFrame) -> DataFrame:
        self._all[node_id] = df
        return df


class TableStore:
    """Artifacts as Parquet folders named by time under ``root/<node>``; the latest one counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, node_id: str) -> str:
        return f"{self.root}/{node_id.replace('.', '/')}"

    def _versions(self, node_id: str) -> list[str]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._folder(node_id))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = lambda s: fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and done(s))

    def load(self, node_id: str) -> DataFrame | None:
        found = self._versions(node_id)
        return self.spark.read.parquet(f"{self._folder(node_id)}/{found[-1]}") if found else None

    def save(self, node_id: str, df: DataFrame) -> DataFrame:
        stamp = datetime.datetime.now().strftime("%Y-%m-%d_%H%M%S_%f")
        path = f"{self._folder(node_id)}/{stamp}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)


class Runner:
    """Evaluates a graph, in whole or in part.

    Outside the part that is asked for, a node's latest artifact is used where there is one; inside it,
    never, so that no stale result comes back.
    """

    def __init__(self, graph: Graph, store: MemoryStore | TableStore | None = None):
        validate(graph)
        self.graph, self.store = graph, store or MemoryStore()

    def downstream(self, node_id: str) -> set[str]:
        found, todo = {node_id}, [node_id]
        while todo:
            at = todo.pop()
            for e in self.graph.edges:
                if e.node_from == at and e.node_to not in found:
                    found.add(e.node_to)
                    todo.append(e.node_to)
        return found

    def waves(self, wanted: set[str] | None = None) -> list[list[str]]:
        """Nodes in order of evaluation: each wave needs only the waves before it. Declaration order within a wave."""
        left = [i for i in self.graph.nodes if wanted is None or i in wanted]
        out, done = [], set()
        while left:
            ready = [i for i in left if all(e.node_from in done or e.node_from not in left for e in self.graph.inputs(i))]
            if not ready:
                raise GraphError(f"stalled: {left} wait for each other")
            out.append(ready)
            done |= set(ready)
            left = [i for i in left if i not in done]
        return out

    def _evaluate(self, wanted: set[str], fresh: set[str]) -> dict[str, DataFrame]:
        results: dict[str, DataFrame] = {}
        need, todo = set(), list(wanted)
        while todo:
            at = todo.pop()
            if at in need:
                continue
            need.add(at)
            stored = None if at in fresh else self.store.load(at)
            if stored is not None:
                results[at] = stored
            else:
                todo += [e.node_from for e in self.graph.inputs(at)]
        for wave in self.waves(need - results.keys()):
            for i in wave:
                node = self.graph.nodes[i]
                made = node.run({e.input_id: results[e.node_from] for e in self.graph.inputs(i)})
                if made is None:
                    raise GraphError(f"the node {i!r} gave no result")
                results[i] = self.store.save(i, made) if node.materialise else made
        return results

    def run_all(self) -> dict[str, DataFrame]:
        """Every node anew."""
        return self._evaluate(set(self.graph.nodes), set(self.graph.nodes))

    def run(self, node_id: str, *, downstream: bool = False, force_upstream: bool = False) -> dict[str, DataFrame] | DataFrame:
        """One node anew from its inputs' latest artifacts; with ``downstream`` also all that depends on it.

        An input without an artifact is an error unless ``force_upstream`` lets it be computed.
        """
        if node_id not in self.graph.nodes:
            raise KeyError(node_id)
        part = self.downstream(node_id) if downstream else {node_id}
        if not force_upstream and not downstream:
            missing = [e.node_from for e in self.graph.inputs(node_id) if self.store.load(e.node_from) is None]
            if missing:
                raise GraphError(f"no artifact of {missing}")
        results = self._evaluate(part, part)
        return {i: results[i] for i in part} if downstream else results[node_id]

    def run_group(self, group: Group) -> dict[str, DataFrame]:
        part = {n.id for n in group.members}
        results = self._evaluate(part, part)
        return {i: results[i] for i in part}


def tap(df: DataFrame, store: MemoryStore | TableStore, name: str, strict: bool = True) -> DataFrame:
    """Keep ``df`` as an artifact and go on from it; an empty one is an error if strict."""
    kept = store.save(name, df)
    if strict and kept.isEmpty():
        raise GraphError(f"{name!r} is empty")
    return kept


# The same checks as relations, for graphs that are tables: node (id), edge (node_from, node_to, input_id).


def entry_nodes(node: DataFrame, edge: DataFrame) -> DataFrame:
    return node.join(edge.select(F.col("node_to").alias("id")), "id", "left_anti")


def output_nodes(node: DataFrame, edge: DataFrame) -> DataFrame:
    return node.join(edge.select(F.col("node_from").alias("id")), "id", "left_anti")


def missing_endpoints(node: DataFrame, edge: DataFrame) -> DataFrame:
    ends = edge.select(F.col("node_from").alias("id")).union(edge.select(F.col("node_to").alias("id"))).distinct()
    return ends.join(node.select("id"), "id", "left_anti")


def doubled_inputs(edge: DataFrame) -> DataFrame:
    return edge.groupBy("node_to", "input_id").agg(F.count("*").alias("n")).where("n > 1")


def closure(edge: DataFrame, start: DataFrame, limit: int = 10_000) -> DataFrame:
    """(id): all that the ids of ``start`` reach, themselves included, level by level."""
    found = start.select("id").distinct().checkpoint() if start.sparkSession.sparkContext.getCheckpointDir() else start.select("id").distinct().cache()
    level = found
    for _ in range(limit):
        nxt = level.join(edge.select(F.col("node_from").alias("id"), "node_to"), "id").select(F.col("node_to").alias("id")).distinct()
        level = nxt.join(found, "id", "left_anti").cache()
        if level.isEmpty():
            return found
        found = found.union(level).cache()
    raise GraphError("the closure did not end")


def ready_nodes(edge: DataFrame, done: DataFrame) -> DataFrame:
    """(id, n_inputs): nodes all of whose inputs are done (id)."""
    waits = edge.join(done.select(F.col("id").alias("node_from"), F.lit(1).alias("ok")), "node_from", "left")
    return waits.groupBy(F.col("node_to").alias("id")).agg(F.count("*").alias("n_inputs"), F.count("ok").alias("n_done")).where("n_inputs = n_done").drop("n_done")
