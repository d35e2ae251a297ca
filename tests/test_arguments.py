"""Arguments bound to parameters, and where the parameters of a trace's steps get their values."""

import pytest

from tessera.operators import arguments, flows, graph, scopes
from tessera.sources.python_scopes import python_facts

FILES = {
    "a.py": """
from b import save, both, Box

def run(payload, flag=True):
    save(payload, 1, mode="w")
    both(*payload, z=2, **flag)
    both(1, 2, 3, 4, z=5, q=6)
    Box(payload)
    payload = 3

def main(data):
    helper(data)
    save()

def helper(item):
    save(item)
    save(item + 1, extra=item)

class C:
    def m(self, x): pass
    def go(self, y):
        self.m(y)
        self.m(y, y)
""",
    "b.py": """
def save(item, times=1, *, mode="r"):
    keep(item)

def keep(value):
    pass

def both(a, b, *rest, z, **more):
    pass

class Box:
    def __init__(self, inside, lid=None):
        pass
""",
}


@pytest.fixture(scope="module")
def known(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    facts = graph.checkpointed(python_facts(files))
    resolved = graph.checkpointed(scopes.resolve_scoped_calls(facts, scopes.module_index(files)))
    return facts, resolved


def test_arguments_meet_parameters(known):
    facts, resolved = known
    lines = {(r.from_path, r.ordinal): r.line for r in resolved.collect()}
    got = {}
    for r in arguments.bind_arguments(facts, resolved).collect():
        got.setdefault((r.file, lines[r.file, r.edge_ordinal], r.to_symbol), set()).add((r.parameter, r.via, r.text))
    assert got["a.py", 5, "save"] == {("item", "position", "payload"), ("times", "position", "1"), ("mode", "keyword", "'w'")}
    assert got["a.py", 6, "both"] == {(None, "unknown", "*payload"), (None, "unknown", "flag"), ("z", "keyword", "2"), ("a", "unknown", None), ("b", "unknown", None)}
    assert got["a.py", 7, "both"] == {("a", "position", "1"), ("b", "position", "2"), ("rest", "rest", "3"), ("rest", "rest", "4"), ("z", "keyword", "5"), ("more", "rest", "6")}
    assert got["a.py", 8, "Box"] == {("inside", "position", "payload"), ("lid", "default", None)}
    assert got["a.py", 13, "save"] == {("item", "missing", None), ("times", "default", None), ("mode", "default", None)}
    assert got["a.py", 17, "save"] == {("item", "position", "item + 1"), (None, "surplus", "item"), ("times", "default", None), ("mode", "default", None)}
    assert got["a.py", 22, "C.m"] == {("x", "position", "y")} and got["a.py", 23, "C.m"] == {("x", "position", "y"), (None, "surplus", "y")}


def test_values_are_followed_along_a_trace(spark, known):
    facts, resolved = known
    starts = spark.createDataFrame([("m", "a.py", "main"), ("r", "a.py", "run")], "flow_id string, file string, symbol string")
    steps = graph.checkpointed(graph.traces(starts, arguments.call_edges(resolved)))
    bound = arguments.bind_arguments(facts, resolved)
    rows = arguments.parameter_origins(steps, bound, facts).collect()
    named = {(r.flow_id, r.step_index): r.symbol for r in steps.collect()}
    got = {(r.flow_id, r.step_index, named[r.flow_id, r.step_index], r.parameter): (r.origin_step, r.origin) for r in rows if r.via == "position"}
    assert got["m", 1, "helper", "item"] == (0, "data") == got["m", 2, "save", "item"] == got["m", 3, "keep", "value"]
    assert got["m", 4, "save", "item"] == (4, "item + 1")
    assert got["r", 1, "save", "item"] == (1, "payload")  # bound again in run, so not surely its parameter
    assert got["r", 1, "save", "times"] == (1, "1")
    transfers = flows.data_flow(steps, spark.createDataFrame([], "path string, symbol string, effect_kind string, kind string, target string"), starts.selectExpr("flow_id", "false AS truncated"), arguments.call_arguments(facts))[0]
    first = transfers.filter("flow_id = 'r' AND to_step = 1").first()
    assert first.arguments == ["payload", "1", "mode='w'"] and first.site_file == "a.py" and first.line == 5 and first.col == 4
