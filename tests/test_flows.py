import json

from tessera.operators import declarations, flows, graph


def test_data_flow_of_a_trace(spark):
    steps = spark.createDataFrame(
        [("f", 0, 0, "a.py", "run", "entry", None, None, None), ("f", 1, 1, "r.py", "save", "internal", "save", 3, 1), ("f", 2, 2, None, "print", "external", "print", 4, 1), ("f", 3, 1, None, "x", "unresolved", "x", 5, 2)],
        graph.TRACE,
    )
    effects = spark.createDataFrame([("r.py", "save", "boundary_effects", "db", "table"), ("r.py", "save", "reads", "db", "other")], "path string, symbol string, effect_kind string, kind string, target string")
    cut = spark.createDataFrame([("f", True)], "flow_id string, truncated boolean")
    transfers, boundaries, gaps = flows.data_flow(steps, effects, cut)
    assert [(r["from"], r["to"], r.from_step) for r in transfers.orderBy("to_step").collect()] == [("run", "save", 0), ("save", "print", 1), ("run", "x", 0)]
    assert [(r.symbol, r.target) for r in boundaries.collect()] == [("save", "table")]
    assert {r.gap for r in gaps.collect()} == {"external_call", "unresolved_call", "truncated_flow"}


def test_calls_resolve_by_file_import_and_receiver(spark):
    calls = spark.createDataFrame([("a.py", "run", n, t, 1, k) for k, (n, t) in enumerate([("local", None), ("save", None), ("get", "Repo"), ("dumps", None), ("lost", None), ("twice", None)])], "from_file string, from_symbol string, name string, receiver_type string, line int, edge_ordinal int")
    callables = spark.createDataFrame([("a.py", "local", "local", None), ("r.py", "save", "save", None), ("r.py", "Repo.get", "get", "Repo"), ("a.py", "twice", "twice", None), ("a.py", "twice", "twice", None)], "file string, symbol string, name string, owner string")
    bindings = spark.createDataFrame([("a.py", "save", "r.py", "save"), ("a.py", "dumps", None, "dumps")], "path string, name string, target_path string, target_name string")
    got = {r.name: (r.to_file, r.to_symbol, r.kind) for r in flows.resolve_calls(calls, callables, bindings).collect()}
    assert got == {"local": ("a.py", "local", "internal"), "save": ("r.py", "save", "internal"), "get": ("r.py", "Repo.get", "internal"), "dumps": (None, "dumps", "external"), "lost": (None, "lost", "unresolved"), "twice": (None, "twice", "unresolved")}


def test_selectors(spark):
    records = declarations.with_occurrence(spark.createDataFrame([("a.py", "X.m", "m", 1), ("a.py", "X.m", "m", 9), ("b.py", "m", "m", 1)], "path string, symbol string, name string, line int"))
    count = lambda s: declarations.select_declarations(records, s).count()
    assert [count("m"), count("a.py:X.m"), count("a.py:X.m#2"), count("a.py:m"), count("X.m")] == [3, 2, 1, 0, 2]


def test_sanitizing_and_requirements(spark):
    payload = {"Author": 1, "content_hash": "x", "out_path": "/home/x", "path": "rel/x", "keep": [{"remote_url": 1, "n": 2}]}
    assert declarations.sanitized(payload) == {"out_path": "[REDACTED:absolute-path]", "path": "rel/x", "keep": [{"n": 2}]}
    row = spark.createDataFrame([(json.dumps(payload),)], "j string").select(declarations.sanitized_udf("j").alias("s")).first()
    assert "home" not in row.s
    document = {"components": {"U": {"type": "object", "required": ["id"], "properties": {"id": {}}}}}
    assert declarations.required_fields({"type": "array", "items": {"$ref": "#/components/U"}}, document) == ({"[].id"}, False)
    assert declarations.required_fields({"oneOf": []}, document)[1]


def test_impact_and_site_links(spark):
    changed = spark.createDataFrame([("a.py",)], "path string")
    pages = spark.createDataFrame([("a.py", "a.md"), ("b.py", "b.md")], "source string, page string")
    edges = spark.createDataFrame([("a.py", "b.py"), ("b.py", "c.py")], "src string, dst string")
    operations = spark.createDataFrame([("a.py", "GET /a")], "handler string, operation string")
    findings = spark.createDataFrame([("a.py", "r")], "path string, rule string")
    rows = declarations.impact(changed, pages, edges, operations, findings).collect()
    assert sorted(r.section for r in rows) == ["edge", "finding", "identity", "operation", "page"]
    html = spark.createDataFrame([("x/i.html", '<a href="j.html"></a><a href="/k.html#s"></a><a href="https://e.org"></a>')], "path string, html string")
    files = spark.createDataFrame([("x/j.html",)], "path string")
    assert [r.target for r in declarations.site_links(html, files).collect()] == ["k.html"]
