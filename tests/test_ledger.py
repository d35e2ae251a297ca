"""Identities over snapshots, lifecycle changes, and infrastructure plans with tombstones."""

from tessera.operators import ledger


def intervals(spark, present, moves):
    rows = spark.createDataFrame([(s, l) for l, snaps in present.items() for s in snaps], "snapshot int, locator string")
    return ledger.identity_intervals(rows, spark.createDataFrame(moves, "snapshot int, old_locator string, new_locator string"))


def test_moves_returns_and_recreations(spark):
    present = {"a": [1, 2], "b": [3, 4], "c": [5], "kept": [1, 2, 3, 4, 5], "hole": [1, 4, 5], "old": [1, 2], "fresh": [4, 5], "x": [1, 2, 5], "y": [3, 4, 5], "back": [1, 4, 5], "away": [2, 3]}
    got = intervals(spark, present, [(3, "a", "b"), (5, "b", "c"), (3, "x", "y"), (2, "back", "away"), (4, "away", "back")])
    rows = {(r.locator, r.valid_from): r for r in got.collect()}
    assert rows["c", 5].uid == rows["b", 3].uid == rows["a", 1].uid and rows["c", 5].how == "moved"
    assert rows["hole", 4].uid == rows["hole", 1].uid and rows["hole", 4].how == "returned"
    assert rows["fresh", 4].uid != rows["old", 1].uid and rows["fresh", 4].how == "allocated"
    assert rows["x", 5].uid != rows["y", 3].uid == rows["x", 1].uid and rows["x", 5].conflict == "alias-owned"
    assert rows["back", 4].uid == rows["back", 1].uid and rows["back", 4].how == "moved" and rows["back", 4].conflict is None
    records = {r.locator: r for r in ledger.identity_records(got, 5).collect()}
    assert records["c"].aliases == ["a", "b"] and records["c"].retired_at is None and records["back"].aliases == ["away"]
    assert records["old"].retired_at == 3 and records["kept"].since == 1
    assert {r.locator for r in ledger.identities_at(got, 3).collect()} == {"b", "kept", "y", "away"}


def test_moves_that_cannot_be(spark):
    got = {(r.locator, r.valid_from): (r.how, r.conflict) for r in intervals(spark, {"a": [1], "b": [1], "c": [2], "d": [2]}, [(2, "a", "c"), (2, "b", "c"), (2, "none", "d")]).collect()}
    assert got["c", 2] == ("allocated", "forked-move") and got["d", 2] == ("allocated", "move-without-origin")
    assert intervals(spark, {}, []).count() == 0


def test_lifecycles(spark):
    records = spark.createDataFrame([(u,) for u in "abcdefg"], "uid string")
    changes = [("a", 1, "active", None), ("a", 2, "superseded", "b"), ("a", 3, "active", None), ("b", 1, "superseded", None), ("c", 1, "active", "a"), ("d", 1, "superseded", "d"), ("e", 1, "superseded", "zz"), ("f", 1, "superseded", "g"), ("g", 1, "superseded", "f")]
    got = {(r.uid, r.seq): r.error for r in ledger.lifecycle_errors(records, spark.createDataFrame(changes, "uid string, seq int, state string, successor string")).collect()}
    assert got == {("a", 3): "after-end", ("b", 1): "successor-required", ("c", 1): "successor-not-allowed", ("d", 1): "self-successor", ("e", 1): "unknown-successor", ("f", 1): "successor-cycle", ("g", 1): "successor-cycle"}
    chain = [(str(k), 1, "superseded", str(k + 1)) for k in range(9)]
    records = spark.createDataFrame([(str(k),) for k in range(10)], "uid string")
    assert ledger.lifecycle_errors(records, spark.createDataFrame(chain, "uid string, seq int, state string, successor string")).count() == 0


def test_infrastructure_with_tombstones(spark):
    shape = "path string, adapter string, content_hash string, observation_hash string, page string"
    recorded = spark.createDataFrame([("same", "k8s", "1", "1", "p1"), ("changed", "k8s", "2", "2", "p2"), ("gone", "k8s", "3", "3", "p3"), ("from", "k8s", "4", "4", "p4"), ("out", "k8s", "5", "5", "p5")], shape)
    live = spark.createDataFrame([("same", "k8s", "1", "1", "p1"), ("changed", "k8s", "2", "x", "p2"), ("to", "k8s", "4", "4", "p6"), ("new", "k8s", "7", "7", "p7"), ("risen", "k8s", "8", "8", "p8")], shape)
    tombstones = spark.createDataFrame([("risen", "p8"), ("dead", "p9"), ("haunted", "p10"), ("out2", "p11")], "path string, page string")
    pages = spark.createDataFrame([("p10",), ("p1",)], "page string")
    selected = spark.createDataFrame([(p,) for p in ("same", "changed", "gone", "from", "to", "new", "risen", "dead", "haunted")], "path string")
    plan = ledger.infrastructure_sync(recorded, tombstones, live, pages, selected)
    got = {r.path: (r.action, r.moved_from) for r in plan.collect()}
    assert got == {"same": ("unchanged", None), "changed": ("changed", None), "gone": ("removed", None), "to": ("moved", "from"), "new": ("added", None), "risen": ("revived", None), "dead": ("buried", None), "haunted": ("repair", None), "out": ("deselected", None), "out2": ("deselected", None)}
    assert sorted(r.path for r in ledger.next_tombstones(plan).collect()) == ["dead", "gone", "haunted"]
