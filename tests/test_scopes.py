"""Names over scopes and files: shadowing, closures, receivers, constructions, imports; Go packages; the derived query."""

import pytest

from tessera.operators import scopes
from tessera.sources.python_scopes import absolute_module, python_facts, scope_facts

FILES = {
    "pkg/__init__.py": "from .core import helper as exported\nfrom . import core\n",
    "pkg/core.py": "def helper():\n    pass\n\ndef twice():\n    pass\n\ndef twice():\n    pass\n\nclass Box:\n    def go(self):\n        return self.step()\n    def step(self):\n        return helper()\n    def again(self):\n        self.missing()\n\nclass Odd(Box):\n    def go(self):\n        pass\n",
    "pkg/loop_a.py": "from pkg.loop_b import thing\n",
    "pkg/loop_b.py": "from pkg.loop_a import thing\n",
    "app.py": """
import os.path
import pkg.core
import pkg.core as c
from pkg import exported, core
from pkg.core import Box, Odd, twice
from pkg.loop_a import thing
from elsewhere import far

value = 3

def outer(x, call=len):
    def helper():
        return inner2()
    def inner2():
        return helper()
    helper()
    x()
    far()
    exported()
    core.helper()
    c.helper()
    pkg.core.helper()
    os.path.join('a')
    thing()
    twice()
    print(value())
    unknown()
    (lambda: helper())()

class Box2:
    name = len
    def helper(self):
        return helper()
    def run(self):
        self.run()
        box = Box()
        box.step()
        odd = Odd()
        odd.go()
        odd = 3
        far2 = far()
        far2.x()
        b = Box()
        b.nothing()
        k = Odd()
        k.go()

class Set:
    def __init__(self):
        self.act = 1
    def act(self):
        pass

def use():
    s = Set()
    s.act()
    global shared
    shared = Box()
    return [helper() for helper in (1, 2)]

def later():
    shared.go()
    exported.attr()
""",
}


@pytest.fixture(scope="module")
def resolved(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    rows = scopes.resolve_scoped_calls(python_facts(files), scopes.module_index(files)).collect()
    return {(r.from_path, r.from_symbol, r.expression): r for r in rows}


def meaning(resolved, symbol, expression, path="app.py"):
    r = resolved[path, symbol, expression]
    return r.kind, r.reason, r.to_path and f"{r.to_path}:{r.to_symbol}"


def test_closures_shadow_and_are_seen_before_their_definition(resolved):
    assert meaning(resolved, "outer", "helper") == ("internal", None, "app.py:outer.<locals>.helper")
    assert meaning(resolved, "outer.<locals>.helper", "inner2") == ("internal", None, "app.py:outer.<locals>.inner2")
    assert meaning(resolved, "outer.<locals>.inner2", "helper") == ("internal", None, "app.py:outer.<locals>.helper")
    assert meaning(resolved, "outer.<locals>.<lambda>", "helper") == ("internal", None, "app.py:outer.<locals>.helper")


def test_class_names_are_not_seen_in_methods(resolved):
    assert meaning(resolved, "Box2.helper", "helper") == ("unresolved", "unbound", None)
    assert meaning(resolved, "Box2.run", "self.run") == ("internal", None, "app.py:Box2.run")
    assert meaning(resolved, "Box.again", "self.missing", "pkg/core.py") == ("unresolved", "not-declared", None)


def test_imports_are_followed(resolved):
    for name in ("exported", "core.helper", "c.helper", "pkg.core.helper"):
        assert meaning(resolved, "outer", name) == ("internal", None, "pkg/core.py:helper"), name
    assert meaning(resolved, "outer", "far") == ("external", "outside", None) == meaning(resolved, "outer", "os.path.join")
    assert meaning(resolved, "outer", "thing") == ("unresolved", "import-cycle", None)
    assert meaning(resolved, "outer", "twice")[0] == "ambiguous" and len(resolved["app.py", "outer", "twice"].candidates) == 2
    assert meaning(resolved, "later", "exported.attr") == ("unresolved", "not-declared", None)


def test_what_is_not_certain_stays_unresolved(resolved):
    assert meaning(resolved, "outer", "x") == ("unresolved", "parameter-binding", None)
    assert meaning(resolved, "outer", "value") == ("unresolved", "value-binding", None)
    assert meaning(resolved, "outer", "unknown") == ("unresolved", "unbound", None)
    assert meaning(resolved, "outer", "print") == ("external", "builtin", None)
    assert meaning(resolved, "outer", None) == ("unresolved", "dynamic", None)
    assert meaning(resolved, "use", "helper") == ("unresolved", "value-binding", None)


def test_constructions(resolved):
    assert meaning(resolved, "Box2.run", "box.step") == ("internal", "constructed-receiver", "pkg/core.py:Box.step")
    assert resolved["app.py", "Box2.run", "box.step"].constructor == "Box"
    assert meaning(resolved, "Box2.run", "odd.go") == ("unresolved", "rebound", None)
    assert meaning(resolved, "Box2.run", "far2.x") == ("unresolved", "constructor-unavailable", None)
    assert meaning(resolved, "Box2.run", "b.nothing") == ("unresolved", "constructor-method-unavailable", None)
    assert meaning(resolved, "Box2.run", "k.go") == ("unresolved", "constructor-dispatch-unsupported", None)
    assert meaning(resolved, "use", "s.act") == ("unresolved", "constructor-member-replaced", None)
    assert meaning(resolved, "later", "shared.go") == ("internal", "constructed-receiver", "pkg/core.py:Box.go")
    assert meaning(resolved, "use", "Box") == ("internal", None, "pkg/core.py:Box")


def test_chains_by_intervals_equal_the_parsers(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    facts = python_facts(files).filter("fact = 'scope'")
    made = {(r.path, r.scope): r.chain for r in scopes.scope_chains(facts.select("path", "scope", "what", "opens", "closes")).collect()}
    assert made == {(r.path, r.scope): r.chain for r in facts.collect()}


def test_facts_of_odd_files(spark):
    assert absolute_module("a/b/c.py", 2, "d") == "a.d" and absolute_module("a.py", 1, "") == ""
    assert scope_facts("x.py", "def (")[0]["fact"] == "error"
    files = spark.createDataFrame([("bad.py", "def ("), ("none.py", None), ("empty.py", "")], "path string, content string")
    assert scopes.resolve_scoped_calls(python_facts(files), scopes.module_index(files)).count() == 0
    assert sorted(r.path for r in python_facts(files).filter("fact = 'error'").collect()) == ["bad.py"]


def test_go_packages(spark):
    packages = spark.createDataFrame([("a/x.go", "a", "m/a"), ("a/y.go", "a", "m/a"), ("b/z.go", "b", "m/b")], "path string, package string, module string")
    functions = spark.createDataFrame([("a/x.go", "Run", None, True), ("a/y.go", "Do", "T", True), ("a/y.go", "hide", None, False), ("b/z.go", "Two", None, True), ("a/x.go", "dup", None, False), ("a/y.go", "dup", None, False)], "path string, name string, receiver string, exported boolean")
    calls = [("b/z.go", 1, "Run", "import", "m/a", None), ("b/z.go", 2, "hide", "import", "m/a", None), ("b/z.go", 3, "Println", "import", "fmt", None), ("a/x.go", 4, "Do", "receiver", None, "T"), ("a/x.go", 5, "hide", "package", None, None), ("a/x.go", 6, "dup", "package", None, None), ("a/x.go", 7, "len", "builtin", None, None), ("b/z.go", 8, "Do", "receiver", None, "T"), ("a/x.go", 9, "f", None, None, None)]
    got = {r.ordinal: (r.kind, r.to_path) for r in scopes.resolve_go_calls(spark.createDataFrame(calls, "path string, ordinal int, name string, binding string, module string, receiver string"), functions, packages).collect()}
    assert got == {1: ("internal", "a/x.go"), 2: ("unresolved", None), 3: ("external", None), 4: ("internal", "a/y.go"), 5: ("internal", "a/y.go"), 6: ("ambiguous", None), 7: ("external", None), 8: ("unresolved", None), 9: ("unresolved", None)}
