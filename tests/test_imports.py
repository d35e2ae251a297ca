"""Imports to files by language: Python packages and src folders, TypeScript aliases, Go modules, Haskell, Rust."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import imports


def test_normalized_paths(spark):
    cases = {"a/./b//c": "a/b/c", "a/../b": "b", "../a": "../a", "a/../../b": "../b", "": "", "/a/b/..": "a", "..": "..", "../../x/..": "../.."}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", imports.normalized(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in rows} == cases


def test_configurations(spark):
    configs = [("web/tsconfig.json", json.dumps({"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./*", "../shared/*"], "lib": ["lib/main.ts"]}}})), ("tsconfig.json", "{"), ("x/tsconfig.json", "[]"), ("y/tsconfig.json", '{"compilerOptions": {}}')]
    got = {(r.root, r.pattern): r.targets for r in imports.ts_alias_rules(spark.createDataFrame(configs, "path string, content string")).collect()}
    assert got == {("web", "@/*"): ["web/src/*", "web/shared/*"], ("web", "lib"): ["web/src/lib/main.ts"]}
    manifests = [("go.mod", "// x\nmodule example.org/top // y\n\ngo 1.2"), ("sub/go.mod", 'module "example.org/top/sub"'), ("bad/go.mod", "go 1.2")]
    assert {(r.root, r.module) for r in imports.go_module_scopes(spark.createDataFrame(manifests, "path string, content string")).collect()} == {("", "example.org/top"), ("sub", "example.org/top/sub")}


FILES = [
    ("src/app/__init__.py", "python"), ("src/app/core.py", "python"), ("src/app/sub/deep.py", "python"), ("tool.py", "python"), ("core.py", "python"), ("lone/src/app/core.py", "python"), ("lone/src/main.py", "python"),
    ("web/src/a.ts", "typescript"), ("web/src/b.js", "javascript"), ("web/shared/b.ts", "typescript"), ("web/src/ui/index.tsx", "typescript"), ("web/src/lib/main.ts", "typescript"), ("other/c.ts", "typescript"),
    ("cmd/main.go", "go"), ("pkg/x.go", "go"), ("pkg/y.go", "go"), ("sub/z.go", "go"), ("sub/in/w.go", "go"), ("hs/Data.hs", "haskell"), ("hs/Main.hs", "haskell"), ("src/net/tcp.rs", "rust"), ("src/main.rs", "rust"),
]
MODULES = {"hs/Data.hs": "My.Data", "hs/Main.hs": "Main"}
IMPORTS = {
    ("src/app/sub/deep.py", "app", "core", "from"): ["src/app/core.py"],
    ("src/app/sub/deep.py", "..", "core", "from"): ["src/app/core.py"],
    ("src/app/sub/deep.py", "..core", "x", "from"): ["src/app/core.py"],
    ("src/app/sub/deep.py", "app", "other", "from"): ["src/app/__init__.py"],
    ("src/app/core.py", "core", None, "import"): ["core.py"],
    ("tool.py", "core", None, "import"): ["core.py"],
    ("lone/src/main.py", "app.core", None, "import"): ["lone/src/app/core.py"],
    ("tool.py", "json", None, "import"): "external",
    ("web/src/a.ts", "@/b", None, None): ["web/shared/b.ts", "web/src/b.js"],
    ("web/src/a.ts", "@/ui", None, None): ["web/src/ui/index.tsx"],
    ("web/src/a.ts", "lib", None, None): ["web/src/lib/main.ts"],
    ("web/src/a.ts", "@/none", None, None): "internal",
    ("other/c.ts", "@/b", None, None): "external",
    ("web/src/a.ts", "./b", None, None): ["web/src/b.js"],
    ("web/src/a.ts", "./b.js", None, None): ["web/src/b.js"],
    ("web/src/a.ts", "../shared/b.ts", None, None): ["web/shared/b.ts"],
    ("web/src/a.ts", "./b.ts", None, None): "external",
    ("cmd/main.go", "example.org/top/pkg", None, None): ["pkg/x.go", "pkg/y.go"],
    ("sub/z.go", "example.org/top/sub/in", None, None): ["sub/in/w.go"],
    ("cmd/main.go", "example.org/top/sub/in", None, None): ["sub/in/w.go"],
    ("cmd/main.go", "example.org/top/lost", None, None): "internal",
    ("cmd/main.go", "fmt", None, None): "external",
    ("pkg/x.go", "../sub", None, None): ["sub/z.go"],
    ("hs/Main.hs", "My.Data", None, None): ["hs/Data.hs"],
    ("src/main.rs", "net::tcp", None, None): ["src/net/tcp.rs"],
    ("src/main.rs", "std::io", None, None): "external",
}


def test_import_targets(spark):
    files = spark.createDataFrame([(p, l, MODULES.get(p)) for p, l in FILES], "path string, language string, module string")
    rows = spark.createDataFrame([(p, k, m, n, kind) for k, (p, m, n, kind) in enumerate(IMPORTS)], "path string, ordinal int, module string, name string, kind string")
    rules = spark.createDataFrame([("web", "@/*", ["web/src/*", "web/shared/*"]), ("web", "lib", ["web/src/lib/main.ts"])], "root string, pattern string, targets array<string>")
    scopes = spark.createDataFrame([("", "example.org/top"), ("sub", "example.org/top/sub")], "root string, module string")
    got = {r.ordinal: r.targets or r.resolution for r in imports.import_targets(rows, files, rules, scopes).collect()}
    for k, (case, wanted) in enumerate(IMPORTS.items()):
        assert got[k] == wanted, (case, got[k])


def test_import_targets_of_nothing(spark):
    none = spark.createDataFrame([], "path string, ordinal int, module string, name string, kind string")
    files = spark.createDataFrame([], "path string, language string")
    rules, scopes = spark.createDataFrame([], "root string, pattern string, targets array<string>"), spark.createDataFrame([], "root string, module string")
    assert imports.import_targets(none, files, rules, scopes).count() == 0


@pytest.mark.parametrize("language", [None, "cobol"])
def test_unknown_languages_use_plain_paths(spark, language):
    files = spark.createDataFrame([("a/b.cob", language), ("a/c.cob", language)], "path string, language string")
    rows = spark.createDataFrame([("a/b.cob", 1, "./c", None, None)], "path string, ordinal int, module string, name string, kind string")
    rules, scopes = spark.createDataFrame([], "root string, pattern string, targets array<string>"), spark.createDataFrame([], "root string, module string")
    got = imports.import_targets(rows, files, rules, scopes).first()
    assert got.resolution == ("resolved" if language else "external")
