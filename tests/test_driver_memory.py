"""Nothing that grows with the input is broadcast, and an operation derives only the frames that it reads."""

import pytest

from tessera.operators import scopes
from tessera.plans import code_queries
from tessera.plans.queries import QUERIES
from tessera.sources.python_scopes import python_facts

DATA = "/root/testdata/sf0.001"


def broadcasts(spark, name):
    """How many tables the executions of a query broadcast, checkpoints included."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    QUERIES[name](spark, DATA).collect()
    done, found = store.executionsList(), 0
    for k in range(before, done.size()):
        nodes = store.planGraph(done.apply(k).executionId()).allNodes()
        found += sum(nodes.apply(n).name().startswith("BroadcastExchange") for n in range(nodes.size()))
    return found


@pytest.mark.parametrize("name", ["argument_bindings", "flow_gaps", "typed_edges", "dependency_operation"])
def test_code_queries_broadcast_nothing(spark, name):
    assert broadcasts(spark, name) == 0


@pytest.mark.parametrize("name", ["flow_boundaries", "typed_edge_coverage"])
def test_what_reads_flows_and_edges_broadcasts_nothing(spark, name):
    assert broadcasts(spark, name) == 0


def test_surface_resolves_no_calls(spark, monkeypatch):
    def never(*_):
        raise AssertionError("the surface needs no calls")

    monkeypatch.setattr(scopes, "resolve_scoped_calls", never)
    monkeypatch.setattr(code_queries, "python_facts", never)
    assert QUERIES["surface_operation"](spark, DATA).count() == 100


def test_symbol_resolves_calls_once(spark, monkeypatch):
    real, seen = scopes.resolve_scoped_calls, []
    monkeypatch.setattr(scopes, "resolve_scoped_calls", lambda *a: seen.append(1) or real(*a))
    QUERIES["symbol_operation"](spark, DATA).count()
    assert len(seen) == 1


def test_parsing_is_dealt_to_as_many_tasks_as_shuffles_have(spark):
    files = spark.createDataFrame([(f"m{k}.py", "x = f()\n") for k in range(40)], "path string, content string")
    facts = python_facts(files)
    assert facts.rdd.getNumPartitions() == 4 and facts.filter("fact = 'call'").count() == 40
