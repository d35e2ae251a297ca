"""Rows of a key at a time, streamed: across batches, with nulls, without a frame for each key; parsing dealt to many tasks."""

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.groups import by_group
from tessera.plans import code_queries  # noqa: F401  (registers its queries)
from tessera.plans.queries import QUERIES
from tessera.sources.python_scopes import python_facts
from tessera.sources.yaml_streams import infrastructure_resources

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).select(F.when(F.col("id") >= 10, F.col("id") % 9).alias("key"), "id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("even"))
        found = by_group(rows, "key", ["id"], lambda g: [(g[0]["key"], len(g), [r["id"] for r in g] == sorted(r["id"] for r in g), sum(r["even"] is None for r in g))], "key long, n int, ordered boolean, odd int")
        got = {r.key: (r.n, r.ordered, r.odd) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {None: (10, True, 5)} | {k: (len(ids), True, sum(i % 2 for i in ids)) for k in range(9) for ids in [[i for i in range(10, 100) if i % 9 == k]]}
    assert got == want


def test_requests_and_traces_make_no_frame_a_key(spark):
    for name in ("joint_budgets", "flow_traces"):
        text = plan(QUERIES[name](spark, DATA))
        assert "FlatMapGroupsInPandas" not in text and "BroadcastExchange" not in text


def test_parsing_is_dealt(spark):
    files = spark.createDataFrame([("a.yaml", "kind: A\n"), ("b.py", "f()\n")], "path string, content string").coalesce(1)
    assert "Exchange hashpartitioning(path" in plan(infrastructure_resources(files))
    assert "Exchange hashpartitioning(path" in plan(python_facts(files))


def test_trace_keeps_numbers_whole_beside_nulls(spark):
    starts = spark.createDataFrame([("f", "a", "x")], "flow_id string, file string, symbol string")
    edges = spark.createDataFrame([("a", "x", "a", "y", "y", "internal", 3, 1), ("a", "x", None, "z", "z", "external", None, 2)], "from_file string, from_symbol string, to_file string, to_symbol string, name string, kind string, line int, edge_ordinal int")
    got = [(r.step_index, r.symbol, r.line) for r in graph.traces(starts, edges, 2).orderBy("step_index").collect()]
    assert got == [(0, "x", None), (1, "y", 3), (2, "z", None)]


def test_yaml_is_read_once_by_libyaml_and_refused_by_the_plain_parser(monkeypatch):
    import pytest
    import yaml

    from tessera.sources import yaml_streams

    text = "a: &x\n  n: 1\n  q: '1'\n  e:\n  t: !!str 2\n---\n- *y\n".replace("*y", "|\n  two\n  lines")
    slow = yaml_streams._composed(text, True, yaml.SafeLoader)
    seen, real = [], yaml_streams._composed
    monkeypatch.setattr(yaml_streams, "_composed", lambda t, typed, loader: seen.append(loader) or real(t, typed, loader))
    assert yaml_streams.compose(text, typed=True) == slow and seen == [yaml.CSafeLoader]
    for wrong in ("a: 1\na: 2\n", "a: [1\n", "a: \x01\n", "*a\n", "a: !own 1\n", "a: \ud800\n"):
        with pytest.raises(yaml_streams.Refused) as fast:
            yaml_streams.compose(wrong)
        with pytest.raises(yaml_streams.Refused) as plain:
            real(wrong, False, yaml.SafeLoader)
        assert str(fast.value) == str(plain.value)
