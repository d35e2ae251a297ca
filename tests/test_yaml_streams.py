"""YAML streams under budgets, and the resources of every kind of infrastructure file."""

import pytest

yaml = pytest.importorskip("yaml")

from tessera.sources import yaml_streams as y  # noqa: E402


def test_composition():
    assert y.compose("a: 1\non: yes\n---\n- x\n---\n") == [{"a": "1", "on": "yes"}, ["x"]]
    assert y.compose("base: &b {x: 1, y: 2}\nuse: {<<: *b, y: 3}\nmany: {<<: [{z: 1}, {z: 2, w: 3}]}") == [{"base": {"x": "1", "y": "2"}, "use": {"y": "3", "x": "1"}, "many": {"z": "1", "w": "3"}}]
    assert y.compose("a: |\n  two\n  lines\nb: 'q'\nc: !!str 3") == [{"a": "two\nlines\n", "b": "q", "c": "3"}]
    assert y.compose("a: [1, -2.5, 1e3, true, null, ~, '1', yes, 0x1f]\n1: {}", typed=True) == [{"a": [1, -2.5, 1000.0, True, None, None, "1", "yes", "0x1f"], "1": {}}]
    assert y.compose("") == [] and y.compose("--- \n---\na: 1") == [{"a": "1"}]


@pytest.mark.parametrize("text", ["a: 1\na: 2", "a: !own 1", "!!python/object:x {}", "? [a]\n: 1", "a: &x [*x]", "a: *none", "a: [", "x: {<<: 3}", "[" * 70 + "]" * 70, "\n---\n".join(["a: 1"] * 130), "x: " + "y" * (1 << 20), "[" + "a," * 20_001 + "]", "a: &a [1,1,1,1,1,1,1,1,1,1]\nb: &b [*a,*a,*a,*a,*a,*a,*a,*a,*a,*a]\nc: &c [*b,*b,*b,*b,*b,*b,*b,*b,*b,*b]\nd: &d [*c,*c,*c,*c,*c,*c,*c,*c,*c,*c]\ne: [*d,*d,*d]"])
def test_refused_streams(text):
    with pytest.raises(y.Refused):
        y.compose(text)


FILES = {
    ".github/workflows/ci.yml": "name: CI\non: [push, pull_request]\njobs:\n  test:\n    runs-on: ubuntu\n    steps: [{uses: a/b@v1}, {run: x}]\n  ship:\n    needs: test\n    runs-on: [self, big]\n",
    "k8s/all.yaml": "apiVersion: apps/v1\nkind: Deployment\nmetadata: {name: web, namespace: prod}\nspec: {replicas: 3, template: {spec: {containers: [{image: 'web:1', ports: [{containerPort: 80}]}]}}}\n---\napiVersion: v1\nkind: List\nitems:\n- {apiVersion: v1, kind: Service, metadata: {name: web}, spec: {ports: [{port: 80}, {port: 443}]}}\n",
    "ops/prometheus.yml": "scrape_configs:\n- job_name: a\n  static_configs: [{targets: ['x:1', 'y:2']}]\nrule_files: [r.yml]\n",
    "ops/alert-rules.yml": "groups:\n- name: g\n  rules: [{alert: Down, expr: up == 0, labels: {severity: page}}, {record: r, expr: e}]\n",
    "ops/grafana/provisioning/d.yaml": "datasources: [{name: P, type: prometheus, url: 'http://p'}]\nproviders: [{name: D, folder: F, type: file, options: {path: /d}}]\n",
    "ops/promtail/config.yml": "clients: [{url: 'http://l'}]\nscrape_configs: [{job_name: s, static_configs: [{labels: {__path__: /var/log}}]}]\n",
    "ops/loki/config.yaml": "auth_enabled: false\nserver: {http_listen_port: 3100}\nschema_config: {configs: [{from: 2020-01-01, store: tsdb, object_store: s3, schema: v13}]}\n",
    "ops/envoy.yaml": "static_resources:\n  listeners: [{name: in, address: {socket_address: {address: 0.0.0.0, port_value: 80}}}]\n  clusters: [{name: up, type: STATIC, load_assignment: {endpoints: [{lb_endpoints: [{endpoint: {address: {socket_address: {address: h, port_value: 9}}}}]}]}}]\n",
    "buf.gen.yaml": "version: v1\nplugins: [{plugin: go, out: gen}]\n",
    "services/llm_big/config.yaml": "model: m-7\nport: 8000\n",
    "docker-compose.yml": "x: &d {image: base}\nservices:\n  a: {<<: *d, ports: ['80:80'], depends_on: {b: {condition: ok}}}\n  b: {image: other}\nvolumes: {v: }\n",
    "notes.yaml": "a: 1\n",
    "bad.yml": "a: [",
    "k8s/readme.md": "apiVersion: v1\nkind: Pod\n",
    "list.yaml": "- apiVersion: v1\n",
}
WANTED = {
    (".github/workflows/ci.yml", "github_actions", "workflow", "CI", ""): {"on": "push,pull_request"},
    (".github/workflows/ci.yml", "github_actions", "job", "test", "CI"): {"runs-on": "ubuntu", "uses": "a/b@v1", "steps": "2"},
    (".github/workflows/ci.yml", "github_actions", "job", "ship", "CI"): {"runs-on": "self,big", "needs": "test", "steps": "0"},
    ("k8s/all.yaml", "kubernetes", "Deployment", "web", "prod"): {"api": "apps/v1", "replicas": "3", "images": "web:1", "ports": "80"},
    ("k8s/all.yaml", "kubernetes", "Service", "web", ""): {"api": "v1", "ports": "80,443"},
    ("ops/prometheus.yml", "prometheus", "scrape", "a", ""): {"targets": "x:1,y:2"},
    ("ops/prometheus.yml", "prometheus", "rule-file", "r.yml", ""): {},
    ("ops/alert-rules.yml", "prometheus_rules", "alert", "Down", "g"): {"expr": "up == 0", "severity": "page"},
    ("ops/alert-rules.yml", "prometheus_rules", "record", "r", "g"): {"expr": "e"},
    ("ops/grafana/provisioning/d.yaml", "grafana_provisioning", "datasource", "P", ""): {"type": "prometheus", "url": "http://p"},
    ("ops/grafana/provisioning/d.yaml", "grafana_provisioning", "provider", "D", "F"): {"type": "file", "path": "/d"},
    ("ops/promtail/config.yml", "promtail", "client", "http://l", ""): {},
    ("ops/promtail/config.yml", "promtail", "scrape", "s", ""): {"paths": "/var/log"},
    ("ops/loki/config.yaml", "loki", "server", "loki", ""): {"auth": "false", "port": "3100"},
    ("ops/loki/config.yaml", "loki", "schema", "2020-01-01", ""): {"store": "tsdb", "objects": "s3", "schema": "v13"},
    ("ops/envoy.yaml", "envoy", "listener", "in", ""): {"address": "0.0.0.0:80"},
    ("ops/envoy.yaml", "envoy", "cluster", "up", ""): {"type": "STATIC", "endpoints": "h:9"},
    ("buf.gen.yaml", "buf", "module", "buf.gen.yaml", ""): {"version": "v1"},
    ("buf.gen.yaml", "buf", "plugin", "go", ""): {"out": "gen"},
    ("services/llm_big/config.yaml", "model_service_config", "model", "m-7", "llm_big"): {"port": "8000"},
    ("docker-compose.yml", "compose", "service", "a", ""): {"image": "base", "ports": "80:80", "depends-on": "b"},
    ("docker-compose.yml", "compose", "service", "b", ""): {"image": "other"},
    ("docker-compose.yml", "compose", "volume", "v", ""): {},
    ("bad.yml", None, "refused", "malformed at line 1", ""): {},
}


def test_resources_of_every_kind(spark):
    rows = y.infrastructure_resources(spark.createDataFrame([*FILES.items(), ("none.yml", None)], "path string, content string")).collect()
    assert {(r.path, r.adapter, r.kind, r.name, r.scope): r.facts for r in rows} == WANTED and len(rows) == len(WANTED)
    assert {r.document for r in rows if r.kind == "Service"} == {1}
