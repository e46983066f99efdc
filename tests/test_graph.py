"""Graphs: wiring, validation, order, and partial runs."""

import pytest

from loomgrid.plans import config
from loomgrid.plans.graph import REGISTRY, Edge, Graph, GraphError, MemoryStore, Runner, TableStore, find_cycle, tap, validate


def build(spark, calls):
    g = Graph("g")

    def make(name, value):
        def run(inputs):
            calls.append(name)
            total = sum(df.first().v for df in inputs.values()) + value
            return spark.createDataFrame([(total,)], "v long")

        return g.node(name, run)

    a, b, c, d = (make(n, v) for n, v in (("a", 1), ("b", 10), ("c", 100), ("d", 1000)))
    a >> [b, c]
    b >> d
    c >> d.port("side")
    return g


def test_run_all_and_waves(spark):
    calls = []
    g = build(spark, calls)
    r = Runner(g)
    assert r.waves() == [["a"], ["b", "c"], ["d"]]
    assert r.run_all()["d"].first().v == 1112 and calls == ["a", "b", "c", "d"]


def test_partial_runs(spark):
    calls = []
    g = build(spark, calls)
    store = MemoryStore()
    r = Runner(g, store)
    with pytest.raises(GraphError, match="no artifact"):
        r.run("b")
    assert r.run("b", force_upstream=True).first().v == 11 and calls == ["a", "b"]
    calls.clear()
    store.save("a", spark.createDataFrame([(5,)], "v long"))
    assert r.run("b").first().v == 15 and calls == ["b"]
    calls.clear()
    # Inside the part that is run anew, what is stored does not count.
    store.save("b", spark.createDataFrame([(0,)], "v long"))
    assert r.run("b", downstream=True)["d"].first().v == 1120 and calls == ["b", "c", "d"]


def test_validation():
    g = Graph("bad")
    a, b = g.node("a", None), g.node("b", None)
    a >> b
    b >> a
    g.edge("a", "x")
    g.edges.append(Edge("x", "b"))
    with pytest.raises(GraphError) as e:
        validate(g)
    assert "unknown node 'x'" in str(e.value) and "wired twice" in str(e.value) and "cycle: a -> b -> a" in str(e.value)
    with pytest.raises(GraphError):
        g.node("a", None)
    with pytest.raises(GraphError):
        g.node("no spaces", None)
    assert find_cycle([Edge("a", "b"), Edge("b", "c")]) == []


def test_groups_merges_and_registry(spark):
    REGISTRY.clear()
    one = lambda inputs: spark.createDataFrame([(1,)], "v long")
    with Graph("whole") as g:
        s = g.node("s", one)
        grp = g.group("sub", lambda g: ([g.node("in", lambda i: i["default"])], g.nodes["sub.in"]))
        s >> grp
        t = g.node("t", one)
        m = grp.output + t
        assert (grp.output + t) is m and m.id.startswith("merge_")
    assert REGISTRY.get("whole") is g and REGISTRY.names() == ["whole"]
    rows = Runner(g).run_all()[m.id].collect()
    assert sorted((r.v, r.input_idx) for r in rows) == [(1, 0), (1, 1)]
    assert set(Runner(g).run_group(grp)) == {"sub.in"}


def test_table_store_and_tap(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    for v in (1, 2):
        tap(spark.createDataFrame([(v,)], "v long"), store, "x.y")
    assert store.load("x.y").first().v == 2 and store.load("z") is None
    with pytest.raises(GraphError, match="empty"):
        tap(spark.createDataFrame([], "v long"), store, "e")


def test_config():
    assert config.deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}, "d": 3}) == {"a": {"b": 1, "c": [2]}, "d": 3}
    assert config.resolve_seeds(5) == [5] and config.resolve_seeds([1, 2]) == config.resolve_seeds([1, 2], 2) == [1, 2]
    drawn = config.resolve_seeds("random", 3)
    assert len(drawn) == 3 and all(0 <= s < 1 << 31 for s in drawn) and len(config.resolve_seeds(None)) == 1
    for seed, batch in (([1], 2), (5, 3), ([], None), (5, 0), ("random", -1)):
        with pytest.raises(ValueError):
            config.resolve_seeds(seed, batch)
    made = config.resolve_context({"guidance_scale": 4.0, "steps": None})
    assert made["cfg"] == 4.0 and made["steps"] == 30
