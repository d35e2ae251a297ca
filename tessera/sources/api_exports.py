"""OpenAPI exports as rows: operations, inputs, responses, bodies, and their schemas as nodes with edges."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.hashing import canonical_json
from .readers import bounded_yaml

FACTS = "api string, side string, fact string, method string, path string, location string, name string, code string, pointer string, child string, step string, state string, required boolean, detail string"
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
#: Rows that are sent together.
SENT = 20_000
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
LOCATIONS = ("query", "header", "path", "cookie")
# Keywords under which a schema's requirements can't be told, plain types, headers that aren't inputs.
COMPOSED = ("allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$dynamicRef", "dependentRequired")
SCALARS = ("string", "number", "integer", "boolean", "null")
IGNORED_HEADERS = ("accept", "content-type", "authorization")


def escaped(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


class _Export:
    def __init__(self, api: str, side: str, document: dict):
        self.key, self.document, self.walked, self.rows = {"api": api, "side": side}, document, set(), []

    def row(self, fact: str, **more) -> None:
        self.rows.append(self.key | {"fact": fact} | more)

    def at(self, pointer: str):
        """What a local pointer leads to; None where it leads nowhere."""
        value = self.document
        for part in pointer[2:].split("/") if pointer != "#" else []:
            part = part.replace("~1", "/").replace("~0", "~")
            if isinstance(value, list) and part.isdigit() and int(part) < len(value):
                value = value[int(part)]
            elif isinstance(value, dict) and part in value:
                value = value[part]
            else:
                return None
        return value

    def followed(self, value, pointer: str, context: dict) -> tuple[object, str]:
        """A part of an operation that may stand elsewhere, with its pointer; a problem where it can't be had."""
        seen = set()
        while isinstance(value, dict) and "$ref" in value:
            ref = value["$ref"]
            if not isinstance(ref, str) or not ref.startswith("#/") or ref in seen or self.at(ref) is None:
                self.row("problem", detail=f"reference {ref!r} can't be resolved", **context)
                return None, pointer
            seen.add(ref)
            value, pointer = self.at(ref), ref
        return value, pointer

    def schema(self, start: str) -> None:
        """Nodes and edges of a schema and of all that it leads to, each pointer once."""
        waiting = [start]
        while waiting:
            pointer = waiting.pop()
            if pointer in self.walked:
                continue
            self.walked.add(pointer)
            value = self.at(pointer)
            if not isinstance(value, dict):
                self.row("node", pointer=pointer, state="unknown")
                continue
            ref, kind = value.get("$ref"), value.get("type")
            required, properties = ([], {}) if kind == "array" else (value.get("required", []), value.get("properties", {}))
            if ref is not None:
                local = isinstance(ref, str) and ref.startswith("#/") and len(value) == 1
                self.row("node", pointer=pointer, state="reference" if local else "unknown", child=ref if local else None)
                waiting += [ref] if local else []
            elif any(k in value for k in COMPOSED):
                self.row("node", pointer=pointer, state="unknown")
            elif value.get("readOnly") is True:
                self.row("node", pointer=pointer, state="read-only")
            elif kind in SCALARS:
                self.row("node", pointer=pointer, state="plain")
            elif kind not in (None, "object", "array") or not isinstance(required, list) or not all(isinstance(x, str) for x in required) or not isinstance(properties, dict):
                self.row("node", pointer=pointer, state="unknown")
            else:
                self.row("node", pointer=pointer, state="plain")
                for name in dict.fromkeys([*properties, *required]):
                    child = f"{pointer}/properties/{escaped(str(name))}"
                    if name in properties:
                        waiting.append(child)
                    elif child not in self.walked:  # named as required, described nowhere
                        self.walked.add(child)
                        self.row("node", pointer=child, state="plain")
                    self.row("edge", pointer=pointer, child=child, step="/" + escaped(str(name)), required=name in required)
                if "items" in value and kind in (None, "array"):
                    self.row("edge", pointer=pointer, child=f"{pointer}/items", step="/*", required=False)
                    waiting.append(f"{pointer}/items")

    def content(self, value, pointer: str, context: dict, location: str, code: str | None) -> None:
        if not isinstance(value, dict):
            self.row("problem", detail=f"{location} content is malformed", **context)
            return
        for media, body in value.items():
            where = f"{pointer}/content/{escaped(str(media))}"
            if isinstance(body, dict) and "schema" in body:
                self.schema(f"{where}/schema")
                self.row("body", location=location, code=code, name=str(media), pointer=f"{where}/schema", **context)
            else:
                self.row("body", location=location, code=code, name=str(media), **context)
                if not isinstance(body, dict):
                    self.row("problem", detail=f"{location} body {media} is malformed", **context)

    def parameters(self, raw, pointer: str, context: dict, slots: list[str]) -> Iterator[tuple]:
        if not isinstance(raw, list):
            self.row("problem", detail="parameters are no list", **context)
            return
        for k, value in enumerate(raw):
            given, (value, _) = value, self.followed(value, f"{pointer}/{k}", context)
            if value is None and given is not None:
                continue
            name, location = (value.get("name"), value.get("in")) if isinstance(value, dict) else (None, None)
            if not isinstance(name, str) or not name or location not in LOCATIONS:
                self.row("problem", detail="parameter without a name or place", **context)
                continue
            if not isinstance(value.get("required", False), bool) or location == "path" and (name not in slots or value.get("required") is not True):
                self.row("problem", detail=f"parameter {name} contradicts its place", **context)
            # A header's case doesn't count, and a path parameter is the slot that it fills.
            wire = name.casefold() if location == "header" else str(slots.index(name)) if location == "path" and name in slots else name
            if location != "header" or wire not in IGNORED_HEADERS:
                yield location, wire, value.get("required") is True

    def read(self) -> list[dict]:
        self.row("components", detail=canonical_json(self.document.get("components")))
        paths = self.document.get("paths")
        for path, item in sorted((paths if isinstance(paths, dict) else {}).items()):
            at = f"#/paths/{escaped(path)}"
            item, at = self.followed(item, at, {"path": path})
            if not isinstance(item, dict):
                self.row("problem", path=path, detail="path item is malformed")
                continue
            slots = re.findall(r"\{([^}]+)\}", path)
            for method in METHODS:
                if method not in item:
                    continue
                op, here, context = item[method], f"{at}/{method}", {"method": method.upper(), "path": path}
                if not isinstance(op, dict):
                    self.row("problem", detail="operation is malformed", **context)
                    continue
                body, place = self.followed(op.get("requestBody"), f"{here}/requestBody", context)
                self.row("operation", required=isinstance(body, dict) and body.get("required") is True, detail=canonical_json(op), **context)
                if body is not None:
                    self.content(body.get("content") if isinstance(body, dict) else None, place, context, "request", None)
                found = {}  # an operation's own parameter stands for its path's
                for raw, where in ((item.get("parameters", []), f"{at}/parameters"), (op.get("parameters", []), f"{here}/parameters")):
                    own = list(self.parameters(raw, where, context, slots))
                    found |= {key: [x for x in own if x[:2] == key] for key in {x[:2] for x in own}}
                for location, wire, required in (x for own in found.values() for x in own):
                    self.row("parameter", location=location, name=wire, required=required, **context)
                responses = op.get("responses")
                if not isinstance(responses, dict) or not responses:
                    self.row("problem", detail="responses are missing", **context)
                    continue
                for code, value in responses.items():
                    if not str(code).startswith("x-"):
                        self.row("response", code=str(code), **context)
                        value, place = self.followed(value, f"{here}/responses/{escaped(str(code))}", context)
                        if isinstance(value, dict) and "content" in value:
                            self.content(value["content"], place, context, "response", str(code))
        return self.rows


def export_facts(exports: DataFrame) -> DataFrame:
    """Facts of API exports (api, side, document as JSON or YAML); a document that can't be read is a `problem`."""

    def rows_of(api, side, text) -> list[dict]:
        try:
            document = json.loads(text) if text.lstrip().startswith("{") else bounded_yaml(text)
            return _Export(api, side, document if isinstance(document, dict) else {}).read()
        except (ValueError, AttributeError, RecursionError) as wrong:
            return [{"api": api, "side": side, "fact": "problem", "detail": f"document can't be read: {type(wrong).__name__}"}]

    def run(frames):
        for frame in frames:
            held: list[dict] = []
            for given in zip(frame["api"], frame["side"], frame["document"]):
                held += rows_of(*given)
                if len(held) >= SENT:
                    yield pd.DataFrame([[r.get(c) for c in COLUMNS] for r in held], columns=COLUMNS)
                    held = []
            yield pd.DataFrame([[r.get(c) for c in COLUMNS] for r in held], columns=COLUMNS)

    return exports.select("api", "side", "document").mapInPandas(run, FACTS)
