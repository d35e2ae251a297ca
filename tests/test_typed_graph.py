"""The typed graph: owners, every kind of observation, merging that no order or repeat changes, and its checks."""

import random

from tessera.operators import typed_graph as g

CONCEPTS = [("m:a", "a.py", None), ("e:A", "a.py", "A"), ("e:run", "a.py", "run"), ("m:b", "b.py", None), ("e:B1", "b.py", "B"), ("e:B2", "b.py", "B"), ("e:A.x", "a.py", "A.x")]


def inputs(spark, seed=None):
    shuffled = lambda rows: random.Random(seed).sample(rows, len(rows)) if seed is not None else rows
    make = lambda rows, shape: spark.createDataFrame(shuffled(rows), shape)
    concepts = make(CONCEPTS, "locator string, source_path string, symbol string")
    calls = [("a.py", "A.go", "b.py", "B.do", "b.do", "internal", f"{k:02d}") for k in range(9)] + [("a.py", "run", None, None, "print", "external", "p"), ("a.py", "run", None, None, "x", "ambiguous", "x"), ("a.py", "run", "a.py", "run", "run", "internal", None), ("z.py", "f", None, None, "y", "external", "y"), ("a.py", "run", "lost.py", "q", "q", "internal", "q")]
    imports = [("a.py", "b", ["b.py"], "resolved", "1"), ("a.py", "two", ["a.py", "b.py"], "ambiguous", "2"), ("b.py", "os", None, "external", "3"), ("b.py", "@/gone", None, "internal", "4")]
    return (
        g.containment(concepts),
        g.call_observations(make(calls, "from_path string, from_symbol string, to_path string, to_symbol string, expression string, kind string, evidence string"), concepts),
        g.import_observations(make(imports, "path string, module string, targets array<string>, resolution string, evidence string"), concepts),
        g.entry_observations(make([("api", "a.py", "A.go", "e")], "category string, path string, symbol string, evidence string"), concepts),
        g.effect_observations(make([("a.py", "A.go", "reads", "env", "TOKEN", "r"), ("a.py", "A.go", "writes", "file", "out", "w"), ("a.py", "A.go", "returns", "x", "y", "n")], "path string, symbol string, effect string, kind string, target string, evidence string"), concepts),
        g.dependency_observations(make([("a.py", "requests", True, "d"), ("a.py", "ignored", False, "i")], "path string, package string, explicit boolean, evidence string"), concepts),
    ), concepts


def test_edges_of_every_kind(spark):
    observed, concepts = inputs(spark)
    edges = {(r.kind, r.source, r.target, r.resolution): r for r in g.merged(*observed).collect()}
    assert {k[1:3] for k in edges if k[0] == "contains"} == {("m:a", "e:A"), ("m:a", "e:run"), ("e:A", "e:A.x"), ("m:b", "e:B1"), ("m:b", "e:B2")}
    call = edges["calls", "e:A", "m:b", "resolved"]  # B is claimed twice, so its file stands for it
    assert (call.observed, call.emitted, call.samples, call.truncated) == (9, 3, ["00", "01", "02"], True)
    alone = edges["calls", "e:run", "e:run", "resolved"]
    assert (alone.observed, alone.emitted, alone.samples, alone.truncated) == (1, 0, [], False)
    assert ("calls", "e:run", "print", "external") in edges and ("calls", "e:run", "x", "ambiguous") in edges and ("calls", "e:run", "q", "unresolved") in edges
    assert {k[1:] for k in edges if k[0] == "imports"} == {("m:a", "m:b", "resolved"), ("m:a", "m:a", "ambiguous"), ("m:a", "m:b", "ambiguous"), ("m:b", "os", "external"), ("m:b", "@/gone", "unresolved")}
    assert {k[:3] for k in edges if k[0] in ("entrypoint_for", "reads", "writes", "depends_on")} == {("entrypoint_for", "entry:api:a.py:A.go", "e:A"), ("reads", "e:A", "env:TOKEN"), ("writes", "e:A", "file:out"), ("depends_on", "m:a", "requests")}
    found = g.merged(*observed)
    assert g.problems(found, concepts).count() == 0
    assert {r.kind: (r.observed, r.omitted) for r in g.coverage(found).collect()}["calls"] == (13, 7)


def test_no_order_matters(spark):
    first = sorted(map(tuple, g.merged(*inputs(spark)[0]).collect()), key=str)
    for seed in (1, 2):
        observed = inputs(spark, seed)[0]
        assert sorted(map(tuple, g.merged(*reversed(observed)).repartition(5).collect()), key=str) == first


def test_problems_are_told(spark):
    observed, concepts = inputs(spark)
    edges = g.merged(*observed).limit(1)
    bad = edges.withColumn("kind", g.F.lit("odd")).unionByName(edges.withColumn("key", g.F.lit("k"))).unionByName(edges.withColumn("target", g.F.lit("none")).withColumn("target_kind", g.F.lit("concept"))).unionByName(edges.withColumn("kind", g.F.lit("vendor/contains")).withColumn("target_kind", g.F.lit("external")))
    assert sorted(r.problem for r in g.problems(bad, concepts).collect())[:2] == ["unknown-concept", "unknown-kind"] and g.problems(bad, concepts).count() == 4


def test_observations_are_read_once(spark):
    """Pieces are counted, then dealt by edge: nothing is joined, and no key, which doesn't compress, is moved."""
    row = lambda target, evidence: ("calls", "c", "external", target, "o", "external", evidence)
    rows = [row("a", e) for e in ("4", "2", None, "1", "3", "2")] + [row("b", None), row("b", None), row("c", "1")]
    found = g.merged(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in g.OBSERVATION)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2 and not any("key#" in line for line in plan.split("\n") if "Exchange" in line)
    assert {r.target: (r.observed, r.emitted, r.samples, r.truncated) for r in found.collect()} == {"a": (6, 3, ["1", "2", "3"], True), "b": (2, 0, [], False), "c": (1, 1, ["1"], False)}
