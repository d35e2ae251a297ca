"""Steps whose memory, shuffles or broadcasts grew faster than they had to: their plans, and results at the edges."""

import pyarrow as pa

from tessera.functions import text
from tessera.operators import api_schemas, diffs, markdown, search
from tessera.sources.api_exports import export_facts


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_section_extents_sort_once_and_join_nothing(spark):
    rows = [(1, 0, 1, "a", 90), (1, 10, 2, "b", 90), (1, 20, 2, "b", 90), (1, 30, 1, "a", 90), (1, 30, 1, "a", 90), (2, 5, 3, "c", 40), (None, 0, 1, "a", 7), (None, 5, 2, "b", 7)]
    found = markdown.section_extents(spark.createDataFrame(rows, "doc_id int, start int, level int, title string, length int"))
    assert "Join" not in plan(found)
    got = sorted((tuple(r) for r in found.select("doc_id", "start", "end", "parent_start", "occurrence").collect()), key=str)
    assert got == sorted([(1, 0, 30, None, 1), (1, 10, 20, 0, 1), (1, 20, 30, 0, 2), (1, 30, 90, None, 2), (2, 5, 40, None, 1), (None, 0, 7, None, 1), (None, 5, 7, None, 1)], key=str)


def test_an_audit_deals_both_sides_once(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (3, None), (None, "n"), (None, "n")], "path int, hash string")
    right = spark.createDataFrame([(1, "a"), (2, "d"), (3, None), (4, "e"), (4, "e"), (None, "n")], "path int, hash string")
    found = diffs.audit_equal(left, right, ["path"])
    assert "Join" not in plan(found) and plan(found).count("Exchange hashpartitioning") == 1
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted([(1, "a", "left-only"), (1, "b", "left-only"), (2, "c", "left-only"), (None, "n", "left-only"), (2, "d", "right-only"), (4, "e", "right-only"), (4, "e", "right-only"), (1, "a", "repeated"), (1, "a", "repeated"), (1, "b", "repeated")], key=str)


def test_api_differences_broadcast_nothing(spark):
    body = lambda k: f'{{"requestBody": {{"content": {{"application/json": {{"schema": {{"type": "object", "required": [{k}], "properties": {{"a": {{"type": "string"}}}}}}}}}}}}}}'
    document = lambda k: f'{{"openapi": "3.1.0", "paths": {{"/x": {{"post": {body(k)}}}}}}}'
    exports = spark.createDataFrame([("one", "baseline", document("")), ("one", "candidate", document('"a"'))], "api string, side string, document string")
    found = api_schemas.api_differences(export_facts(exports))
    assert ("required-input-added", "application/json /a") in {(r.code, r.detail) for r in found.collect()}
    assert "Broadcast" not in plan(found)  # as it was run: what compresses well would have become broadcasts on the way


def test_texts_are_python_strings_a_slice_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(text, "SLICE", 2)
    column = pa.array(["Ab", None, "STRASSE", "Straße", "ΣΑΣ"])
    assert text.order_key_udf.func(column).to_pylist() == ["ab", None, "strasse", "strasse", "σασ"]
    assert text.folded_udf.func(column.slice(0, 2)).to_pylist() == ["ab", ""]
    assert text.link_targets_udf.func(pa.array(["a/b.md", "c.md"]), pa.array(["[x](y.md)", None])).to_pylist() == [["a/y.md"], []]
    assert text.order_key_udf.func(column.slice(0, 0)).to_pylist() == []


def test_a_substring_search_returns_no_folded_text(spark):
    pages = spark.createDataFrame([(1, "one STRASSE"), (2, "Straße two"), (3, None), (4, "nothing")], "ordinal int, content string")
    found = search.substring_search(pages, "straße")
    assert [(r.ordinal, r.snippet) for r in found.collect()] == [(1, "one STRASSE"), (2, "Straße two")]
    assert "locate(" not in plan(found)
