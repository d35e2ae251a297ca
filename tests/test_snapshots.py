import json
import random
import re

import pytest

from tessera.operators import aggregates, diffs, lint, markdown, scoring
from tessera.plans.surface import Knowledge, Plugins
from tessera.sources import readers, sinks
from tessera.streaming import events as streams

BASIS = "locator string, scope string, source_path string, extractor_ref string, producer string, source_content_hash string, concept_observation_hash string"


def test_freshness_one_row_per_outcome(spark):
    base = ("m", "p.py", "x", "w", "c", "o")
    recorded = [(name, *values, modeled) for name, values, modeled in [("current", base, True), ("bytes", base, True), ("both", base, True), ("obs", base, True), ("scope", base, True), ("gone", ("m", "gone.py", "x", "w", "c", "o"), True), ("nolive", base, True), ("unmodeled", base, False), ("nobasis", ("m", "p.py", "x", "w", None, "o"), True), ("producer", base, True)]]
    live = [("current", *base), ("bytes", "m", "p.py", "x", "w", "c2", "o"), ("both", "m", "p.py", "x", "w", "c2", "o2"), ("obs", "m", "p.py", "x", "w", "c", "o2"), ("scope", "e", "p.py", "x", "w", "c", "o"), ("gone", *base), ("producer", "m", "p.py", "x", "w2", "c", "o")]
    r = spark.createDataFrame(recorded, BASIS + ", modeled boolean")
    l, s = spark.createDataFrame(live, BASIS), spark.createDataFrame([("p.py",)], "path string")
    got = {x.locator: x.state for x in diffs.freshness(r, l, s).collect()}
    assert got == {"current": "current", "bytes": "nonsemantic-source-change", "both": "source-changed", "obs": "basis-incompatible", "scope": "basis-incompatible", "gone": "source-missing", "nolive": "unknown", "unmodeled": "unknown", "nobasis": "unknown", "producer": "basis-incompatible"}
    assert {x.state for x in diffs.freshness(r, None, s).collect()} == {"unknown"}


def test_ambiguous_moves_raise(spark):
    before = spark.createDataFrame([("a.py", "X"), ("a.py", "X"), ("a.py", "Y")], "path string, name string")
    after = spark.createDataFrame([("b.py", "X"), ("b.py", "Y")], "path string, name string")
    with pytest.raises(ValueError):
        diffs.unique_moves(before, after, ["name"], strict=True)
    assert diffs.unique_moves(before.filter("name = 'Y'"), after, ["name"], strict=True).count() == 1


def document(paths):
    return json.dumps({"paths": paths})


def test_api_diff(spark):
    old = {"/a/{id}": {"get": {"responses": {"200": {}, "404": {}}, "parameters": [{"name": "q", "in": "query"}]}}, "/b": {"post": {"responses": {"201": {}}}}}
    new = {"/a/{key}": {"get": {"responses": {"204": {}}, "parameters": [{"name": "q", "in": "query", "required": True}], "requestBody": {"required": True}}}}
    exports = spark.createDataFrame([("baseline", document(old)), ("candidate", document(new))], "side string, document string")
    findings = diffs.operations_diff(*readers.openapi_operations(exports))
    assert {(f.code, f.detail) for f in findings.collect()} == {("operation-removed", "absent from candidate"), ("required-input-added", "query q"), ("required-input-added", "request body"), ("success-response-removed", "200")}
    assert diffs.diff_status(findings).first().status == "breaking"
    same = spark.createDataFrame([("baseline", document(old)), ("candidate", document(old))], "side string, document string")
    assert diffs.diff_status(diffs.operations_diff(*readers.openapi_operations(same))).first().status == "compatible"


def test_queue_weights(spark):
    page = lambda p: ("module", p, p + ".py")
    pages = spark.createDataFrame([page("a"), page("b"), page("c"), ("log", "log", None)], "kind string, canonical_path string, source_path string")
    fresh = spark.createDataFrame([("a", "source-changed"), ("c", "unknown")], "path string, state string")
    issues = spark.createDataFrame([("b", "error", "x")], "path string, severity string, category string")
    work = spark.createDataFrame([("a", ["s"], "done")], "path string, signals array<string>, status string")
    metrics = spark.createDataFrame([("b.py", 50), ("c.py", 9)], "source_path string, fan_in int")
    reach = spark.createDataFrame([("a", False), ("b", None), ("c", True)], "path string, reachable boolean")
    rows = scoring.maintenance_queue(pages, work, fresh, issues, metrics, reach).collect()
    assert [(r.path, r.score) for r in rows] == [("b", 125), ("a", 90)] and all(r.total == 2 for r in rows)


def test_health_strictness(spark):
    schema = "id int, mismatch boolean, availability string, snapshot string, governance string, drift string, evaluated boolean, expired_reviews int, verification string"
    rows = spark.createDataFrame([(1, False, "available", "ok", "valid", "indeterminate", True, 0, "passed"), (2, True, "absent", "ok", "valid", "none", True, 0, "passed"), (3, False, "available", "ok", "valid", "none", True, 0, "stale"), (4, False, "available", "ok", "valid", "none", True, 0, "passed")], schema)
    assert [r.status for r in scoring.health(rows).orderBy("id").collect()] == ["degraded", "unhealthy", "unhealthy", "healthy"]
    assert scoring.health(rows, strict=True).orderBy("id").first().status == "unhealthy"


def test_budget_fit_demotes_from_the_tail():
    entries = [{"path": p, "detail": "deep", "deep": "d" * 80, "slim": "s" * 30, "summary": "x" * 10} for p in "abc"]
    for budget in range(0, 320, 7):
        kept = scoring.fit_sources(entries, budget)
        size = len(json.dumps({e["path"]: e[e["detail"]] for e in kept}, separators=(",", ":")))
        assert size <= budget or not kept
        ranks = [scoring.LEVELS.index(e["detail"]) for e in kept]
        assert ranks == sorted(ranks) and [e["path"] for e in kept] == list("abc")[: len(kept)]


def test_joint_budget_keeps_the_best():
    sources = [{"path": p, "priority": q, "detail": "deep", "deep": "d" * 50, "slim": "s" * 20, "summary": "x"} for p, q in (("a", "high"), ("b", "low"))]
    concepts = [{"locator": "ca", "source_path": "a"}, {"locator": "cb", "source_path": "b"}]
    relations = [{"from": "ca", "to": "cb"}]
    out = scoring.fit_joint(sources, concepts, relations, 60)
    assert [s["path"] for s in out["sources"]] == ["a"] and [c["locator"] for c in out["concepts"]] == ["ca"] and out["relations"] == []
    assert scoring.fit_joint(sources, concepts, relations, 5) == {}


def test_sections_parents_ends_and_locators(spark):
    source = "---\nx: 1\n---\n# A\ntext\n## B\n```\n# no\n```\n## B\n### C ###\nend\n# D"
    text, found = markdown.parse_sections(source, "p.md")
    assert [(s["level"], s["title"], s["occurrence"]) for s in found] == [(1, "A", 1), (2, "B", 1), (2, "B", 2), (3, "C", 1), (1, "D", 1)]
    assert found[3]["parent"] == found[2]["locator"] and found[0]["end"] == text.index("# D") and found[1]["end"] == found[2]["start"]
    rows = markdown.sections(spark.createDataFrame([("p.md", source), ("q.md", ""), ("r.md", None)], "path string, content string")).collect()
    assert len(rows) == 5 and rows[0].locator == "p.md#A" and rows[2].locator == "p.md#A/B~2"


def test_links_classes_and_resolution(spark):
    pages = spark.createDataFrame([("a/x.md", "[p](y.md) ![i](../img/z.png) [e](https://e.org) [u](../../up.md) [q](#s) `[c](no.md)`"), ("a/y.md", "")], "path string, content string")
    found = markdown.link_observations(pages)
    assert [r.target_class for r in found.orderBy("ordinal").collect()] == ["page", "asset", "external", "escape", "anchor"]
    registry = spark.createDataFrame([("a/y.md",), ("img/z.png",), ("img/z.png",)], "path string")
    got = {r.raw_target: r.resolution for r in markdown.resolve_links(found, registry).collect()}
    assert got["y.md"] == "resolved" and got["../img/z.png"] == "ambiguous" and got["https://e.org"] == "external" and got["../../up.md"] == "unresolved"


def test_unified_diff_paths():
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n--- a/not.py\n+++ b/not.py\n context\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+hi\nrename from old.py\nrename to moved.py\n"
    assert readers.diff_paths(diff) == [("x.py", None, "modified"), ("new.py", None, "added"), ("moved.py", "old.py", "rename")]
    with pytest.raises(ValueError):
        readers.diff_paths("--- x.py\n+++ x.py\n", strict=True)


@pytest.mark.parametrize(
    ("rule", "yes", "no"),
    [("*.log", ["a.log", "x/b.log", "x.log/y"], ["a.logs"]), ("/*.log", ["a.log"], ["x/a.log"]), ("build/", ["build/a", "x/build/b"], ["build", "x/build"]), ("/build/", ["build", "build/a/b"], ["x/build/a"]), ("docs/**", ["docs", "docs/a/b"], ["x/docs/a"]), ("a/*.py", ["a/x.py", "a/b/x.py", "a/x.py/z"], ["b/a/x.py"]), ("[!a]?", ["bc", "x/bc"], ["ab", "b/"]), ("a.b", ["a.b", "x/a.b/c"], ["axb"])],
)
def test_ignore_rules_as_regular_expressions(rule, yes, no):
    pattern = readers.rule_regex(readers.ignore_rules(rule)[0])
    assert all(re.match(pattern, p) for p in yes) and not any(re.match(pattern, p) for p in no)
    below = readers.rule_regex(readers.ignore_rules(rule, "base")[0])
    assert all(re.match(below, "base/" + p) for p in yes) and not any(re.match(below, p) for p in yes)


def test_ignore_rules_last_match_wins(spark):
    rules = readers.ignore_rules("*.log\n!keep.log\n/build/\ndocs/**\n")
    files = spark.createDataFrame([(p,) for p in ("a.log", "x/keep.log", "build/a.py", "src/build/a.py", "docs/x/y.md", "main.py")], "path string")
    assert {r.path for r in readers.not_ignored(files, rules).collect()} == {"x/keep.log", "src/build/a.py", "main.py"}


def test_python_inventory_and_entry_points(spark):
    source = "import os\nfrom a.b import c\nclass X(Y):\n    def m(self, q: int) -> str: ...\n@app.get('/v/{id}')\ndef h(): ...\ndef main(): ...\n"
    inventory = readers.python_inventory(spark.createDataFrame([("s.py", source), ("bad.py", "def (")], "path string, content string"))
    assert {(r.kind, r.name) for r in inventory.collect()} == {("import", None), ("import", "c"), ("class", "X"), ("method", "m"), ("function", "h"), ("function", "main"), ("route", "GET /v/{id}")}
    assert {(r.category, r.symbol) for r in readers.entry_points(inventory).collect()} == {("api", "h"), ("main", "main")}


def test_infrastructure_and_dockerfile(spark):
    files = spark.createDataFrame([("d/Dockerfile", "FROM x AS b\n# c\nRUN a \\\n  b\n"), ("k.yaml", "apiVersion: v1\nkind: Pod\nmetadata:\n  name: web\n"), ("n.txt", "hello")], "path string, content string")
    assert {(r.path, r.adapter) for r in readers.infrastructure(files).collect()} == {("d/Dockerfile", "dockerfile"), ("k.yaml", "kubernetes")}
    assert readers.dockerfile("FROM x AS b\n# c\nRUN a \\\n  b\n") == [(1, "FROM", "x AS b", "b"), (3, "RUN", "a b", "b")]


def test_events_files_and_windows(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts":"2024-01-02T00:00:00Z","event":"validation"}\nnot json\n{"ts":"bad","event":"x"}\n{"ts":"2024-01-01T00:00:00Z","event":"validation"}\n')
    assert readers.events(spark, str(tmp_path), "12h", "2024-01-02T06:00:00Z").count() == 1
    for bad in ("0d", "x", -1):
        with pytest.raises(ValueError):
            readers.window_seconds(bad)


def test_wiki_scan_store_and_slices(spark, tmp_path):
    root = tmp_path / "wiki"
    (root / "modules").mkdir(parents=True)
    (root / "modules" / "m.md").write_text("# Mod\nx")
    (root / "index.md").write_text("no title")
    pages = {r.path: (r.kind, r.title) for r in readers.wiki_pages(spark, str(root)).collect()}
    assert pages == {"modules/m.md": ("modules", "Mod"), "index.md": ("index", "index")}
    sinks.write_store(spark.createDataFrame([("a", 1), ("b", 2)], "locator string, v int"), str(tmp_path / "store"))
    store = spark.read.parquet(str(tmp_path / "store"))
    assert readers.select_slice(store, ["a"]).count() == 1
    with pytest.raises(ValueError):
        readers.select_slice(store, ["a", "b"], max_records=1)


def test_lint_rules_and_plugins(spark):
    pages = spark.createDataFrame([("index.md",), ("a.md",), ("b.md",)], "path string")
    links = spark.createDataFrame([("index.md", "page", "a.md", "a.md"), ("a.md", "page", "gone.md", "gone.md")], "path string, target_class string, resolved string, raw_target string")
    own = lambda wiki: lint.issues(wiki["pages"].filter("path = 'a.md'"), "info", "own", lint.F.lit("m"), lint.F.col("path"))
    plugins = Plugins()
    plugins.register("lint_rule", "own", own)
    with pytest.raises(ValueError):
        plugins.register("lint_rule", "own", own)
    got = [(r.category, r.path) for r in lint.lint({"pages": pages, "links": links}, extra=plugins.components["lint_rule"]).collect()]
    assert got == [("broken_links", "a.md"), ("orphan", "b.md"), ("own", "a.md")]


def test_query_operations(spark):
    concepts = spark.createDataFrame([("l1", "u1", "k1", "c.md")], "locator string, uid string, natural_key string, canonical_path string")
    edges = spark.createDataFrame([("calls", "a", "b", "extracted", "resolved"), ("reads", "b", "a", "extracted", "resolved")], "kind string, source string, target string, origin string, resolution string")
    k = Knowledge(concepts=concepts, relationships=edges, graph_edges=edges, dependencies=spark.createDataFrame([("a", "b")], "src string, dst string"))
    assert k.query("concept", "u1").count() == 1
    assert k.query("typed", "a", kinds=["reads"]).first().total == 1
    assert k.query("related", "a").count() == 2
    assert k.query("dependency", "a").first().direction == "outbound"
    with pytest.raises(ValueError):
        k.query("nothing")


def test_unevaluated_counts_stay_null(spark):
    rows = spark.createDataFrame([("module", True, None)], "kind string, modeled boolean, state string")
    assert all(r.current is None and r.compared is None for r in aggregates.coverage(rows, evaluated=False).collect())


def test_streaming_matches_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(source)
    events.write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{c} {t}" for c, t in events.dtypes)
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        schema = schema.replace("timestamp_ntz", "timestamp")
    stream = streams.windowed(streams.event_stream(spark, str(tmp_path / "in"), schema), late="3650 days")
    got = streams.drain(stream, "windows", str(tmp_path / "cp"), "complete")
    assert got.agg({"n": "sum"}).first()[0] == events.count()


def plain_joint(sources, concepts, relations, budget):
    """Joint fit by looking at every choice and encoding everything at each step."""
    sources, concepts, relations = [dict(s) for s in sources], list(concepts), list(relations)
    rank = {s["path"]: ({"high": 0, "medium": 1, "low": 2}[s["priority"]], s["fresh"]) for s in sources}
    of = lambda c: rank.get(c["source_path"], (2, 0))
    best = min(concepts, key=lambda c: (of(c), c["locator"]), default=None)
    required = {min(sources, key=lambda s: (rank[s["path"]], s["path"]))["path"]} if sources else set()
    required |= {best["source_path"]} if best else set()
    size = lambda: len(json.dumps({"c": [c["locator"] for c in concepts], "r": relations, "s": {s["path"]: s[s["detail"]] for s in sources}}, ensure_ascii=False, sort_keys=True).encode())
    while size() > budget:
        choices = [((*rank[s["path"]], 4, k), sources, s) for k, s in enumerate(sources) if s["detail"] != "summary"]
        choices += [((*rank[s["path"]], 2, k), sources, s) for k, s in enumerate(sources) if s["detail"] == "summary" and s["path"] not in required]
        choices += [((*of(c), 3, k), concepts, c) for k, c in enumerate(concepts) if c is not best]
        held = {c["locator"]: of(c) for c in concepts}
        choices += [((*min((held[x] for x in (r["from"], r["to"]) if x in held), default=(3, 1)), 5, k), relations, r) for k, r in enumerate(relations)]
        if not choices:
            return {}
        _, where, item = max(choices, key=lambda c: c[0])
        if where is sources and item["detail"] != "summary":
            item["detail"] = {"deep": "slim", "slim": "summary"}[item["detail"]]
        else:
            where.remove(item)
            if where is concepts:
                was, names = {item["locator"]}, {c["locator"] for c in concepts}
                relations[:] = [r for r in relations if not ({r["from"], r["to"]} & was) or {r["from"], r["to"]} & names]
    return {"sources": sources, "concepts": concepts, "relations": relations}


def some_request(rng):
    paths = [f"p{k}" for k in range(rng.randint(0, 6))]
    sources = [{"path": p, "priority": rng.choice(["high", "medium", "low"]), "fresh": rng.randint(0, 1), "detail": rng.choice(["deep", "slim"]), "deep": "dü" * rng.randint(10, 40), "slim": "s" * rng.randint(5, 20), "summary": "x"} for p in paths]
    concepts = [{"locator": f"c{k}", "source_path": rng.choice([*paths, "elsewhere"])} for k in range(rng.randint(0, 6))]
    relations = [{"key": f"r{k}", "from": rng.choice(["c0", "c1", "c2", "none"]), "to": rng.choice(["c2", "c3", "other"])} for k in range(rng.randint(0, 6))]
    return sources, concepts, relations


def test_joint_budget_equals_the_plain_way(spark):
    rng, wanted, entries, budgets = random.Random(4), {}, [], []
    for n in range(250):
        sources, concepts, relations = some_request(rng)
        budget = rng.randint(4, 120) * 4
        plain = plain_joint(sources, concepts, relations, budget)
        assert scoring.fit_joint(sources, concepts, relations, budget) == plain, n
        if n % 10 == 0 and sources:
            place = iter(range(1000))
            entries += [(n, "source", s["path"], next(place), s["priority"], s["fresh"], s["detail"], s["deep"], s["slim"], s["summary"], None, None, None) for s in sources]
            entries += [(n, "concept", c["locator"], next(place), *[None] * 6, c["source_path"], None, None) for c in concepts]
            entries += [(n, "relation", r["key"], next(place), *[None] * 7, r["from"], r["to"]) for r in relations]
            budgets.append((n, budget // 4))
            wanted |= {(n, "source", s["path"]): s["detail"] for s in plain.get("sources", [])} | {(n, "concept", c["locator"]): None for c in plain.get("concepts", [])} | {(n, "relation", r["key"]): None for r in plain.get("relations", [])}
    shape = "request int, kind string, item string, place int, priority string, fresh int, detail string, deep string, slim string, summary string, source_path string, `from` string, `to` string"
    got = scoring.fit_joint_requests(spark.createDataFrame(entries, shape), spark.createDataFrame(budgets, "request int, tokens int")).collect()
    assert len(got) == len(entries) and {(r.request, r.kind, r.item): r.detail for r in got if not r.omitted} == wanted
