import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.operators import aggregates, bounds, diffs, lint, reports
from tessera.plans.surface import Knowledge
from tessera.sources import readers

APP = '''
from fastapi import FastAPI, APIRouter
app = FastAPI()
items = APIRouter(prefix="/items")

@items.get("/{item_id}", response_model=Item, status_code=201)
async def read(item_id: int, q: str | None = None): ...

@app.api_route("/both", methods=["GET", "post"])
def both() -> Reply: ...

@cache.get("/no")
def other(): ...

app.include_router(items, prefix="/api")
'''


def test_api_routes(spark):
    files = spark.createDataFrame([("a.py", APP), ("b.py", "def ("), ("c.py", None)], "path string, content string")
    got = {(r.method, r.route): r for r in readers.api_routes(files).collect()}
    assert set(got) == {("GET", "/api/items/{item_id}"), ("GET", "/both"), ("POST", "/both")}
    read = got["GET", "/api/items/{item_id}"]
    assert (read.handler, read.status, read.response) == ("read", 201, "Item")
    assert [(p.name, p.location, p.type) for p in read.parameters] == [("item_id", "path", "int"), ("q", "query or body", "str | None")]
    assert got["GET", "/both"].response == "Reply"


def test_bounded_yaml_and_exports(spark):
    pytest.importorskip("yaml")
    assert readers.bounded_yaml("a: 1\nb: [x, {c: true}]\n") == {"a": 1, "b": ["x", {"c": True}]}
    assert readers.bounded_yaml("") is None
    assert readers.bounded_yaml("a: &x 1\non: *x\n12: 'no'") == {"a": 1, "on": 1, "12": "no"}
    for text in ("a: 1\na: 2", "!!python/object:x {}", "a: 1\n---\nb: 2", "[" * 99 + "]" * 99, "a: [", "x: " + "y" * 100):
        with pytest.raises(ValueError):
            readers.bounded_yaml(text, most_bytes=300 if "y" * 50 not in text else 50)
    exports = spark.createDataFrame([("baseline", "paths:\n  /a:\n    get:\n      responses: {'200': {}}\n"), ("candidate", '{"paths": {"/a": {"get": {"responses": {"404": {}}}}}}')], "side string, document string")
    findings = diffs.operations_diff(*readers.openapi_operations(exports))
    assert [r.code for r in findings.collect()] == ["success-response-removed"]
    assert "breaking: 1" in reports.api_report(findings)


def test_missing_frames_are_reported(spark):
    pages = spark.createDataFrame([("a b.md",)], "path string")
    got = lint.lint({"pages": pages}, ["conventions", "orphans"], tell_missing=True).collect()
    assert lint.lint({"pages": pages}, ["conventions", "orphans"]).count() == 1
    assert [(r.category, r.message) for r in got] == [("convention", "page name has unusual characters"), ("lint", "rule orphans not run: no frame links")]

    def broken(wiki):
        return {}["bug"]

    with pytest.raises(KeyError):
        lint.lint({"pages": pages}, ["broken"], {"broken": broken})


def test_conflicting_identities_are_refused(spark):
    ledger = spark.createDataFrame([("k", "u1"), ("k", "u2")], "natural_key string, uid string")
    with pytest.raises(ValueError):
        diffs.allocate_identities(ledger, ledger)


def test_bounds_keep_null_owners_and_exact_totals(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("a", 5)], "o string, v int")
    got = {(r.o, r.v): (r.place, r.total, r.returned, r.truncated) for r in bounds.bounded_per(df, ["o"], [F.col("v")], 2).collect()}
    assert got == {(None, 1): (1, 2, 2, False), (None, 2): (2, 2, 2, False), ("a", 3): (1, 3, 2, True), ("a", 4): (2, 3, 2, True)}
    capped = aggregates.capped_with_counts(df, ["o"], [F.col("v")], 1).collect()
    assert {(r.o, r.v, r.observed, r.emitted, r.omitted) for r in capped} == {(None, 1, 2, 1, 1), ("a", 3, 3, 1, 2)}


def test_pages_bound_to_a_basis(spark):
    df, basis = spark.range(10), spark.createDataFrame([("h1",)], "hash string")
    assert [r.id for r in reports.basis_page(df, basis, "h1", [F.col("id")], 3, 2).collect()] == [3, 4]
    with pytest.raises(ValueError):
        reports.basis_page(df, basis, "h0", [F.col("id")], 3, 2)


def test_sizes_counts_and_chunks(spark):
    df = spark.createDataFrame([(1, '{"b": "ä", "a": [1]}'), (2, "{"), (3, None), (4, "")], "id int, j string")
    assert [r.s for r in df.select(hashing.canonical_size("j").alias("s")).collect()] == [len('{"a":[1],"b":"ä"}'.encode()), None, None, None]
    assert [r.s for r in df.filter("id = 1").select(hashing.canonical_size("j", "ascii_compact").alias("s")).collect()] == [len('{"a":[1],"b":"\\u00e4"}')]
    counts = spark.sql("SELECT map('a', 1, 'b', 2, 'c', -1) AS m").select(hashing.allowed_counts("m", ["a", "c"]).alias("m")).first().m
    assert counts == {"a": 1}
    chunks = reports.numbered_chunks(df, "id", "j", 7).orderBy("id", "chunk").collect()
    assert "".join(r.body for r in chunks if r.id == 1) == '{"b": "ä", "a": [1]}' and [r.chunk for r in chunks if r.id == 4] == [0]


def test_impact_answers_with_sections_and_an_identity(spark):
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    known = Knowledge(
        inventory=frame([("a.py", "a.md"), ("b.py", "b.md")], "path string, page string"),
        surface=frame([("a.py", "x.md")], "source_path string, canonical_path string"),
        declared=frame([], "source string, page string"),
        dependencies=frame([("a.py", "b.py")], "src string, dst string"),
        findings=frame([("a.py", "r1")], "path string, rule string"),
    )
    rows = known.query("impact", changed=frame([("a.py",)], "path string")).collect()
    assert sorted((r.section, r.item) for r in rows if r.section != "identity") == [("edge", "a.py -> b.py"), ("finding", "r1 a.py"), ("page", "a.md"), ("page", "x.md")]
    report = reports.impact_report(known.query("impact", changed=frame([("a.py",)], "path string")))
    assert "- page: 2" in report and "identity: sha256:" in report


def test_other_reports_are_bounded(spark):
    changes = spark.createDataFrame([(f"t{k:03}", "added") for k in range(250)], "topic string, change string")
    text = reports.publication_report(changes, changes.limit(3))
    assert "- added: 250" in text and "50 more rows" in text and "uncovered pages: 3" in text
    queue = spark.createDataFrame([("a|b", 3), ("c", 9)], "path string, score int")
    assert reports.queue_report(queue).index("| c | 9 |") < reports.queue_report(queue).index("| a\\|b | 3 |")
