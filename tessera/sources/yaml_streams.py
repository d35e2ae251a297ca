"""YAML streams composed from parser events under budgets, and what infrastructure files say in them.

No YAML constructor runs: scalars stay text (or become plain JSON values on request), keys are always text. Anchors,
aliases, merges and several documents are composed; repeated keys, own tags, keys that aren't scalars, recursive
aliases and streams over a budget are refused whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Budgets of one stream, tags that change nothing, how plain scalars read as JSON values.
MOST_BYTES, MOST_EVENTS, MOST_NODES, MOST_DEPTH, MOST_DOCUMENTS = 1_048_576, 20_000, 20_000, 64, 128
PLAIN_TAGS = {None, "!", *(f"tag:yaml.org,2002:{t}" for t in ("str", "null", "bool", "int", "float", "timestamp", "map", "seq"))}
WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}


class Refused(ValueError):
    """A stream that isn't composed, and why."""


def plain_value(text: str):
    """A plain scalar as a JSON value."""
    if text in WORDS:
        return WORDS[text]
    if re.fullmatch(r"[-+]?[0-9]+", text):
        return int(text)
    return float(text) if re.fullmatch(r"[-+]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))([eE][-+]?[0-9]+)?", text) else text


class _Open:
    """A collection that isn't complete yet."""

    def __init__(self, anchor: str | None, mapping: bool):
        self.anchor, self.value, self.key, self.merged, self.nodes = anchor, {} if mapping else [], None, [], 1

    def add(self, value, nodes: int) -> None:
        self.nodes += nodes
        if isinstance(self.value, list):
            self.value.append(value)
        elif self.key is None:
            if not isinstance(value, str):
                raise Refused("a key is no scalar")
            self.key = (value,)
        else:
            (key,), self.key = self.key, None
            if key == "<<":
                parts = value if isinstance(value, list) else [value]
                if not all(isinstance(p, dict) for p in parts):
                    raise Refused("a merge of something that is no mapping")
                self.merged += parts
            elif key in self.value:
                raise Refused("a repeated key")
            else:
                self.value[key] = value

    def done(self):
        for part in self.merged:  # its own keys count first, then those of earlier merges
            for key, value in part.items():
                self.value.setdefault(key, value)
        return self.value


def compose(text: str, typed: bool = False, most_bytes: int = MOST_BYTES) -> list:
    """The documents of a stream. With `typed` plain scalars read as JSON values, else all are text.

    libyaml reads the stream where it's there; what that refuses the plain parser reads again, whose reason counts.
    """
    try:
        import yaml
    except ImportError as lacking:  # an optional library
        raise Refused("YAML isn't supported here") from lacking
    if len(text.encode(errors="replace")) > most_bytes:
        raise Refused("over the byte budget")
    if fast := getattr(yaml, "CSafeLoader", None):
        try:
            return _composed(text, typed, fast)
        except ValueError:  # Refused, or text that isn't UTF-8
            pass
    return _composed(text, typed, yaml.SafeLoader)


def _composed(text: str, typed: bool, loader: type) -> list:
    import yaml

    documents, stack, anchors, nodes, ready = [], [], {}, 0, []

    def put(value, anchor: str | None, size: int) -> None:
        if anchor is not None:
            anchors[anchor] = (value, size)
        stack[-1].add(value, size) if stack else ready.append(value)

    try:
        for count, event in enumerate(yaml.parse(text, Loader=loader), 1):
            if count > MOST_EVENTS:
                raise Refused("over the event budget")
            if isinstance(event, yaml.DocumentStartEvent):
                anchors.clear()
                ready.clear()
                if len(documents) >= MOST_DOCUMENTS:
                    raise Refused("over the document budget")
            elif isinstance(event, yaml.DocumentEndEvent):
                if ready and ready[0] not in ("", None):
                    documents.append(ready[0])
            elif isinstance(event, yaml.AliasEvent):
                if event.anchor not in anchors:
                    raise Refused("an alias that is recursive or has no anchor")
                value, size = anchors[event.anchor]
                nodes += size
                put(value, None, size)
            elif isinstance(event, yaml.ScalarEvent):
                if event.tag not in PLAIN_TAGS or event.tag in ("tag:yaml.org,2002:map", "tag:yaml.org,2002:seq"):
                    raise Refused("a tag of its own")
                nodes += 1
                is_key = bool(stack) and isinstance(stack[-1].value, dict) and stack[-1].key is None
                put(plain_value(event.value) if typed and not is_key and not event.style and event.tag is None else event.value, event.anchor, 1)
            elif isinstance(event, yaml.CollectionStartEvent):
                if event.tag not in PLAIN_TAGS:
                    raise Refused("a tag of its own")
                stack.append(_Open(event.anchor, isinstance(event, yaml.MappingStartEvent)))
                nodes += 1
                if len(stack) > MOST_DEPTH:
                    raise Refused("over the depth budget")
            elif isinstance(event, yaml.CollectionEndEvent):
                done = stack.pop()
                put(done.done(), done.anchor, done.nodes)
            if nodes > MOST_NODES:
                raise Refused("over the node budget")
    except yaml.YAMLError as wrong:
        mark = getattr(wrong, "problem_mark", None)
        raise Refused(f"malformed at line {mark.line + 1}" if mark else "malformed") from wrong
    return documents


def mapping(value) -> dict:
    return value if isinstance(value, dict) else {}


def rows_in(value) -> list:
    return value if isinstance(value, list) else []


def word(value) -> str:
    return value if isinstance(value, str) else ""


def words(value) -> list[str]:
    """The texts of a list, a single text, or a mapping's keys."""
    return [value] if isinstance(value, str) and value else [x for x in value if isinstance(x, str)] if isinstance(value, (list, dict)) else []


def _facts(**values) -> dict[str, str]:
    """What is said: texts, and lists of texts with commas between; nothing that is empty."""
    found = {k.replace("_", "-"): v if isinstance(v, str) else ",".join(words(v)) for k, v in values.items()}
    return {k: v for k, v in found.items() if v}


# Each adapter yields (kind, name, scope, facts) of the resources of one document.


def _github(root: dict, path: str) -> Iterator[tuple]:
    yield "workflow", word(root.get("name")) or path.rsplit("/", 1)[-1], "", _facts(on=words(root.get("on")))
    for name, job in mapping(root.get("jobs")).items():
        steps = [mapping(s) for s in rows_in(mapping(job).get("steps"))]
        yield "job", name, word(root.get("name")), _facts(runs_on=words(mapping(job).get("runs-on")), needs=words(mapping(job).get("needs")), uses=[word(s.get("uses")) for s in steps if s.get("uses")], steps=str(len(steps)))


def _kubernetes(root: dict, path: str) -> Iterator[tuple]:
    if word(root.get("kind")).endswith("List") and "items" in root:
        for item in rows_in(root["items"]):
            yield from _kubernetes(mapping(item), path)
        return
    about, spec = mapping(root.get("metadata")), mapping(root.get("spec"))
    pod = mapping(mapping(spec.get("template")).get("spec")) or spec
    containers = [mapping(c) for c in rows_in(pod.get("containers"))]
    ports = [word(mapping(p).get("port")) for p in rows_in(spec.get("ports"))] + [word(mapping(p).get("containerPort")) for c in containers for p in rows_in(c.get("ports"))]
    yield word(root.get("kind")), word(about.get("name")), word(about.get("namespace")), _facts(api=word(root.get("apiVersion")), replicas=word(spec.get("replicas")), images=[word(c.get("image")) for c in containers], ports=[p for p in ports if p])


def _prometheus(root: dict, path: str) -> Iterator[tuple]:
    for s in map(mapping, rows_in(root.get("scrape_configs"))):
        yield "scrape", word(s.get("job_name")), "", _facts(metrics_path=word(s.get("metrics_path")), targets=[t for c in rows_in(s.get("static_configs")) for t in words(mapping(c).get("targets"))])
    for f in words(root.get("rule_files")):
        yield "rule-file", f, "", {}


def _rules(root: dict, path: str) -> Iterator[tuple]:
    for g in map(mapping, rows_in(root.get("groups"))):
        for r in map(mapping, rows_in(g.get("rules"))):
            yield "alert" if "alert" in r else "record", word(r.get("alert")) or word(r.get("record")), word(g.get("name")), _facts(expr=word(r.get("expr")), severity=word(mapping(r.get("labels")).get("severity")))


def _grafana(root: dict, path: str) -> Iterator[tuple]:
    for d in map(mapping, rows_in(root.get("datasources"))):
        yield "datasource", word(d.get("name")), "", _facts(type=word(d.get("type")), url=word(d.get("url")))
    for p in map(mapping, rows_in(root.get("providers"))):
        yield "provider", word(p.get("name")), word(p.get("folder")), _facts(type=word(p.get("type")), path=word(mapping(p.get("options")).get("path")))


def _promtail(root: dict, path: str) -> Iterator[tuple]:
    for c in map(mapping, rows_in(root.get("clients"))):
        yield "client", word(c.get("url")), "", {}
    for s in map(mapping, rows_in(root.get("scrape_configs"))):
        yield "scrape", word(s.get("job_name")), "", _facts(paths=[word(mapping(mapping(c).get("labels")).get("__path__")) for c in rows_in(s.get("static_configs"))])


def _loki(root: dict, path: str) -> Iterator[tuple]:
    yield "server", "loki", "", _facts(auth=word(root.get("auth_enabled")), port=word(mapping(root.get("server")).get("http_listen_port")))
    for c in map(mapping, rows_in(mapping(root.get("schema_config")).get("configs"))):
        yield "schema", word(c.get("from")), "", _facts(store=word(c.get("store")), objects=word(c.get("object_store")), schema=word(c.get("schema")))


def _address(value) -> str:
    at = mapping(mapping(mapping(value).get("address")).get("socket_address")) or mapping(mapping(value).get("socket_address"))
    return f"{word(at.get('address'))}:{word(at.get('port_value'))}" if at else ""


def _envoy(root: dict, path: str) -> Iterator[tuple]:
    parts = mapping(root.get("static_resources"))
    for x in map(mapping, rows_in(parts.get("listeners"))):
        yield "listener", word(x.get("name")), "", _facts(address=_address(x))
    for c in map(mapping, rows_in(parts.get("clusters"))):
        ends = [_address(mapping(e).get("endpoint")) for g in rows_in(mapping(c.get("load_assignment")).get("endpoints")) for e in rows_in(mapping(g).get("lb_endpoints"))]
        yield "cluster", word(c.get("name")), "", _facts(type=word(c.get("type")), endpoints=[e for e in ends if e])


def _buf(root: dict, path: str) -> Iterator[tuple]:
    yield "module", word(root.get("name")) or path, "", _facts(version=word(root.get("version")), deps=words(root.get("deps")))
    for p in map(mapping, rows_in(root.get("plugins"))):
        yield "plugin", word(p.get("plugin")) or word(p.get("remote")) or word(p.get("local")) or word(p.get("name")), "", _facts(out=word(p.get("out")))


def _model(root: dict, path: str) -> Iterator[tuple]:
    model = root.get("model")
    yield "model", word(model) or word(mapping(model).get("name")), word(root.get("service")) or path.split("/")[-2], _facts(port=word(root.get("port")) or word(mapping(root.get("server")).get("port")))


def _compose(root: dict, path: str) -> Iterator[tuple]:
    for name, s in mapping(root.get("services")).items():
        s = mapping(s)
        yield "service", name, "", _facts(image=word(s.get("image")), ports=words(s.get("ports")), depends_on=words(s.get("depends_on")), networks=words(s.get("networks")))
    for kind in ("networks", "volumes"):
        for name in mapping(root.get(kind)):
            yield kind[:-1], name, "", {}


def adapter_of(path: str, root: dict) -> tuple[str, Callable] | None:
    """What kind of file a document of this path is; the first that fits."""
    # The paths and top-level keys that tell the kinds apart, and their names.
    name, at = path.rsplit("/", 1)[-1], f"/{path}"
    config = name in ("config.yml", "config.yaml")
    tests = [
        (re.search(r"/\.github/workflows/[^/]+\.ya?ml$", at), "github_actions", _github),
        (word(root.get("apiVersion")) and word(root.get("kind")), "kubernetes", _kubernetes),
        (name.startswith("prometheus") and "scrape_configs" in root, "prometheus", _prometheus),
        ("rules" in name and "groups" in root, "prometheus_rules", _rules),
        ("/grafana/provisioning/" in at, "grafana_provisioning", _grafana),
        ("/promtail/" in at and config and "scrape_configs" in root, "promtail", _promtail),
        ("/loki/" in at and config and {"schema_config", "auth_enabled"} & set(root), "loki", _loki),
        (name.startswith("envoy.") and "static_resources" in root, "envoy", _envoy),
        (name in ("buf.yaml", "buf.gen.yaml"), "buf", _buf),
        (re.fullmatch(r"services/llm_[^/]+/config\.ya?ml", path) and "model" in root, "model_service_config", _model),
        (re.match(r"(docker-)?compose[^/]*\.ya?ml$", name) and "services" in root, "compose", _compose),
    ]
    return next(((label, run) for fits, label, run in tests if fits), None)


RESOURCES = "path string, document int, adapter string, kind string, name string, scope string, facts map<string,string>"
COLUMNS = ["path", "document", "adapter", "kind", "name", "scope", "facts"]


def resources_of(path: str, text: str) -> list[tuple]:
    """The resources of a file; a stream that is refused is one row `refused` with the reason."""
    try:
        documents = compose(text)
    except (Refused, RecursionError) as wrong:
        return [(path, None, None, "refused", str(wrong) or "nested too deeply", "", {})]
    out = []
    for k, root in enumerate(documents):
        found = adapter_of(path, mapping(root)) if isinstance(root, dict) else None
        if found:
            out += [(path, k, found[0], *row) for row in found[1](root, path)]
    return out


def infrastructure_resources(files: DataFrame) -> DataFrame:
    """A row for each resource of infrastructure YAML files (path, content), which are dealt by path: a small table's few
    row groups would leave all the parsing to as few tasks."""

    def run(frames):
        for frame in frames:
            rows = [r for p, t in zip(frame["path"], frame["content"]) for r in resources_of(p, t or "")]
            out = pd.DataFrame(rows, columns=COLUMNS)
            yield out.assign(document=out["document"].astype("Int32"))

    return files.filter("lower(path) RLIKE '[.]ya?ml$'").select("path", "content").repartition("path").mapInPandas(run, RESOURCES)
