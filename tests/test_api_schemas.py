"""API differences over bodies: media types, nested fields, references, cycles, compositions, malformed parts."""

import json

import pytest

from tessera.operators import api_schemas
from tessera.sources.api_exports import export_facts


def document(body=None, components=None, path="/items/{id}", responses=None, **more):
    operation = {"responses": responses or {"200": {"description": "ok"}}} | more
    if body is not None:
        operation["requestBody"] = {"content": {m: {"schema": s} for m, s in body.items()}}
    return {"openapi": "3.1.0", "paths": {path: {"post": operation}}, "components": {"schemas": components or {}}}


NAMED = {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "inner": {"$ref": "#/components/schemas/B"}}}
REF = {"$ref": "#/components/schemas/A"}


@pytest.fixture(scope="module")
def found(spark):
    b = lambda *required, **more: {"type": "object", "required": list(required), "properties": {"n": {"type": "integer"}, "seen": {"type": "string", "readOnly": True}} | more}
    loop = {"a": {"$ref": "#/components/schemas/A"}}
    listed = {"application/json": {"type": "array", "items": {"$ref": "#/components/schemas/B"}}}
    param = lambda name, where="query", required=True: {"parameters": [{"name": name, "in": where, "required": required}]}
    cases = {
        "same": (document({"application/json": REF}, {"A": NAMED, "B": b()}), document({"application/json": REF}, {"A": NAMED, "B": b()}, path="/items/{key}")),
        "nested": (document({"application/json": REF}, {"A": NAMED, "B": b()}), document({"application/json": REF}, {"A": NAMED, "B": b("n", "seen")})),
        "listed": (document(listed, {"B": b()}), document(listed, {"B": b("n", "x/y")})),
        "cycle": (document({"application/json": REF}, {"A": NAMED, "B": b(**loop)}), document({"application/json": REF}, {"A": NAMED, "B": b("n", **loop)})),
        "composed": (document({"application/json": {"type": "object"}}), document({"application/json": {"oneOf": []}})),
        "nowhere": (document({"application/json": REF}), document({"application/json": REF})),
        "media": (document({"application/json": {}, "text/plain": {"type": "string"}}), document({"application/json": {}})),
        "answers": (document(responses={"200": {"content": {"application/json": {"schema": b("n")}}}, "201": {}}), document(responses={"200": {"content": {"application/json": {"schema": b()}}}})),
        "inputs": (document(**param("q", required=False)), document(**param("q"))),
        "header": (document(**param("X-Id", "header")), document(**param("x-id", "header"))),
        "slot": (document(**param("id", "path")), document(path="/items/{other}", **param("other", "path"))),
        "doubtful": (document(**param("q", required=False)), document(parameters=[{"name": "q", "in": "query", "required": True}, {"$ref": "#/components/parameters/none"}])),
        "gone": (document(), {"openapi": "3.1.0", "paths": {}}),
        "unread": (document(), {"openapi": "3.1.0", "paths": {"/items/{id}": None}}),
    }
    rows = [(name, side, json.dumps(d)) for name, pair in cases.items() for side, d in zip(("baseline", "candidate"), pair)] + [("broken", "baseline", "{"), ("broken", "candidate", "{}")]
    facts = export_facts(spark.createDataFrame(rows, "api string, side string, document string"))
    out = {}
    for r in api_schemas.api_differences(facts).collect():
        out.setdefault(r.api, set()).add((r.code, r.severity, r.detail))
    return out


CHANGED = ("contract-changed", "advisory", "schemas, security or metadata differ")
SHARED = ("components-changed", "advisory", "shared components differ")
HIDDEN = ("request-schema-unknown", "advisory", "composition, a cycle or a reference hides fields")


def test_fields_behind_references(found):
    assert "same" not in found
    assert found["nested"] == {SHARED, ("required-input-added", "breaking", "application/json /inner/n")}
    assert found["listed"] == {SHARED, ("required-input-added", "breaking", "application/json /*/n"), ("required-input-added", "breaking", "application/json /*/x~1y")}


def test_what_cannot_be_told_is_advisory(found):
    assert found["cycle"] == {SHARED, HIDDEN} and found["composed"] == {CHANGED, HIDDEN} and found["nowhere"] == {HIDDEN}
    assert found["doubtful"] == {CHANGED, ("required-input-added", "advisory", "query q"), ("unresolved-contract", "advisory", "candidate: reference '#/components/parameters/none' can't be resolved")}
    assert ("unresolved-contract", "advisory", "baseline: document can't be read: JSONDecodeError") in found["broken"]


def test_media_inputs_and_responses(found):
    assert found["media"] == {CHANGED, ("media-type-removed", "advisory", "request text/plain")}
    assert found["answers"] == {CHANGED, ("success-response-removed", "breaking", "201"), ("response-field-optional", "advisory", "200 application/json /n")}
    assert found["inputs"] == {CHANGED, ("required-input-added", "breaking", "query q")}
    assert found["header"] == {CHANGED} and found["slot"] == {CHANGED}
    assert found["gone"] == {SHARED, ("operation-removed", "breaking", "absent from candidate")}
    assert ("operation-removed", "advisory", "unresolved in candidate") in found["unread"]


def test_no_exports(spark):
    none = spark.createDataFrame([], "api string, side string, document string")
    assert api_schemas.api_differences(export_facts(none)).count() == 0
