import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, relationships

CALLS = "from_file string, from_symbol string, to_file string, to_symbol string, name string, kind string, line int, edge_ordinal int"


def calls(spark, pairs):
    rows = [("m", a, "m" if k == "internal" else None, b, b, k, n, n) for n, (a, b, k) in enumerate(pairs)]
    return spark.createDataFrame(rows, CALLS)


PAIRS = [("a", "b", "internal"), ("a", "c", "internal"), ("b", "d", "internal"), ("c", "d", "internal"), ("d", "a", "internal"), ("d", "print", "external"), ("c", "x", "unresolved")]


def callables(spark, names="abcd"):
    return spark.createDataFrame([("m", s) for s in names], "file string, symbol string")


def test_trace_is_a_preorder_that_expands_a_node_once(spark):
    start = spark.createDataFrame([("f", "m", "a")], "flow_id string, file string, symbol string")
    steps = graph.traces(start, calls(spark, PAIRS)).orderBy("step_index").collect()
    assert [(s.depth, s.symbol) for s in steps] == [(0, "a"), (1, "b"), (2, "d"), (3, "a"), (3, "print"), (1, "c"), (2, "d"), (2, "x")]


def test_depth_limit_and_segment_bounds(spark):
    page, coverage = graph.segment(callables(spark), calls(spark, PAIRS), "m:a", limit=3, offset=1, depth=2)
    assert [r.symbol for r in page.collect()] == ["b", "d", "c"]
    assert coverage["eligible"] == 6 and coverage["observed"] == 8 and coverage["omitted_before"] == 1 and coverage["depth_omitted"] == 2
    assert coverage["omitted_before"] + coverage["returned"] + coverage["omitted_after"] == coverage["eligible"]
    with pytest.raises(ValueError):
        graph.segment(callables(spark), calls(spark, PAIRS), "m:a", offset=99)


def test_ambiguous_names_have_no_neighbours(spark):
    twice = spark.createDataFrame([("m", "a"), ("n", "a")], "file string, symbol string")
    row = graph.resolve_callable(twice, "a").first()
    assert row.ambiguous and not row.found and len(row.candidates) == 2
    assert graph.call_neighbors(twice, calls(spark, PAIRS), "a").count() == 0
    assert {r.symbol for r in graph.call_neighbors(callables(spark), calls(spark, PAIRS), "d").collect()} == {"b", "c"}


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for n in nodes:
                if a in reach[n] and b not in reach[n]:
                    reach[n].add(b)
                    changed = True
    loops = {a for a, b in edges if a == b}
    return {frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in loops or any(n in reach[m] and m in reach[n] for m in nodes if m != n)}


def test_cycles_and_load_order_against_brute_force(spark):
    rng = random.Random(4)
    edges = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(18)})
    frame = spark.createDataFrame(edges, "src int, dst int")
    rows = graph.cycles(frame).collect()
    got = {}
    for r in rows:
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(v) for v in got.values()} == brute_components(edges)
    level = {r.node: (r.component, r.level) for r in graph.load_order(frame).collect()}
    for a, b in edges:
        assert level[a][0] == level[b][0] or level[a][1] > level[b][1]


def test_reachability_from_an_index_is_null_without_one(spark):
    schema = "canonical_path string, outgoing_internal_links array<string>"
    linked = spark.createDataFrame([("index.md", ["a.md"]), ("a.md", ["gone.md"]), ("b.md", ["a.md"])], schema)
    assert {r.path: r.reachable for r in graph.reachable_pages(linked).collect()} == {"index.md": True, "a.md": True, "b.md": False}
    assert all(r.reachable is None for r in graph.reachable_pages(linked.filter("canonical_path <> 'index.md'")).collect())


def test_materialized_edges_do_not_depend_on_order(spark):
    rows = [("calls", "a", "b", "extracted", "resolved", None, f"e{k % 5}") for k in range(7)] + [("depends_on", "a", "lib", "extracted", "external", False, "x")]
    schema = "kind string, source string, target string, origin string, resolution string, explicit boolean, evidence string"
    results = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        results.append([tuple(r) for r in graph.materialize_edges(spark.createDataFrame(rows, schema)).collect()])
    assert results[0] == results[1] and len(results[0]) == 1
    row = graph.materialize_edges(spark.createDataFrame(rows, schema)).first()
    assert row.observed == 7 and row.samples == ["e0", "e1", "e2"] and row.truncated


def test_ring_with_a_hub_has_known_counts(spark):
    n = 20
    edges = [(k, (k + 1) % n) for k in range(n)] + [(n, k) for k in range(n)]
    degree = {r.node: (r.fan_in, r.fan_out) for r in graph.degrees(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert degree[n] == (0, n) and all(degree[k] == (2, 1) for k in range(n))
    assert graph.reachable(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(0,)], "n int")).count() == n


def test_bases_resolve_in_order(spark):
    classes = spark.createDataFrame([("a.py", "A", ["B", "mod.C", "D", "E"]), ("a.py", "B", []), ("mod.py", "C", []), ("d.ts", "D", []), ("x.py", "E", []), ("y.py", "E", [])], "path string, name string, bases array<string>")
    bindings = spark.createDataFrame([("a.py", "E", "x.py", "E")], "path string, name string, target_path string, target_name string")
    languages = spark.createDataFrame([("a.py", "python")], "path string, language string")
    got = {r.base: (r.base_path, r.via) for r in relationships.resolve_bases(classes, bindings, languages).collect()}
    assert got == {"B": ("a.py", "same-file"), "mod.C": ("mod.py", "qualified"), "D": (None, None), "E": ("x.py", "import")}


def test_type_references_match_by_containment(spark):
    functions = spark.createDataFrame([("a.py", "f", [("x", "UserList")], "int", ["cached"])], "path string, name string, params array<struct<name:string,type:string>>, return_type string, decorators array<string>")
    visible = spark.createDataFrame([("a.py", "User", "m.py"), ("b.py", "int", "n.py")], "path string, class_name string, class_path string")
    assert [(r.class_name, r.function) for r in relationships.type_references(functions, visible).collect()] == [("User", "f")]


def test_imports_prefer_the_child_module(spark):
    files = spark.createDataFrame([("p/__init__.py",), ("p/c.py",), ("q.py",)], "path string")
    imports = spark.createDataFrame([("x.py", 1, "p", "c"), ("x.py", 2, "p", "d"), ("x.py", 3, "numpy", None)], "path string, ordinal int, module string, name string")
    got = {r.ordinal: (r.targets, r.resolution) for r in relationships.resolve_imports(imports, files).collect()}
    assert got == {1: (["p/c.py"], "resolved"), 2: (["p/__init__.py"], "resolved"), 3: (None, "external")}


def test_overview_keeps_one_step_per_callee_and_boundary_examples(spark):
    start = spark.createDataFrame([("f", "m", "a")], "flow_id string, file string, symbol string")
    steps = graph.traces(start, calls(spark, PAIRS))
    chosen = graph.overview(steps, 6).orderBy("place").collect()
    symbols = [c.symbol for c in chosen]
    assert symbols.count("d") == 1 and "print" in symbols and "x" in symbols
    left = graph.omission_groups(steps, graph.overview(steps, 3)).agg({"count": "sum"}).first()[0]
    assert left == 7 - 3


def test_graph_queries_take_all_orders_and_customers(spark, tmp_path):
    from tessera.plans.queries import QUERIES

    spark.range(3000).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    pairs = [(0, 1), (1, 2), (7, 1), (8, 2), (999, 5)]  # 0 -> 1 -> 9, 7 -> 50, 8 -> 58, 999 -> 995
    pairs += [(2142, 1)]  # -> 2995, past the first 1500 customers
    spark.createDataFrame([(c, k) for c, k in pairs], "o_custkey bigint, o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    edges = {(r.component, r.node, r.level) for r in QUERIES["load_order"](spark, str(tmp_path)).collect()}
    assert {int(n) for _, n, _ in edges} == {0, 1, 7, 8, 9, 50, 58, 995, 999, 2142, 2995}
    assert {n: level for _, n, level in edges}[0] == 2
    assert QUERIES["import_cycles"](spark, str(tmp_path)).count() == 0
    traces = QUERIES["flow_traces"](spark, str(tmp_path)).collect()
    assert len({r.flow_id for r in traces}) == 3000 and len(traces) == 3000 + 7
    assert [r.symbol for r in sorted(traces, key=lambda r: r.step_index) if r.flow_id == "f0"] == ["0", "1", "9"]


def test_a_step_of_cycles_starts_from_what_the_last_one_changed(spark):
    store, n = spark._jsparkSession.sharedState().statusStore(), 12
    before = store.executionsList().size()
    ring = spark.createDataFrame([(k, (k - 1) % n) for k in range(n)], "src int, dst int")
    assert sorted((r.component, r.node, r.size) for r in graph.cycles(ring).collect()) == [("0", k, n) for k in range(n)]
    done, joined = store.executionsList(), 0
    for k in range(before, done.size()):
        number = done.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "Join" in node.name() and "Inner" in node.desc():
                metrics = (node.metrics().apply(j) for j in range(node.metrics().size()))
                joined += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    assert joined < 100  # each of the twelve steps would take all twelve edges
