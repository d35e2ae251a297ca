"""Replay of maintenance events: transitions, errors, batch against stream, observations and reconciliation."""

import random

from tessera.operators import maintenance as m

EVENTS = "record bigint, seq bigint, kind string, basis string, owner string, expected string"


def test_transitions():
    state, error = m.transition(m.NONE, "register", "b1", "o", None)
    assert error is None and state == ("present", "present", "open", "b1", None, "o", 1)
    assert m.transition(state, "register", "b1", "o", None) == (state, "registered-before")
    assert m.transition(m.NONE, "observe", "b1", None, None)[1] == "not-registered"
    assert m.transition(state, "acknowledge", "b2", None, None) == (state, "stale-basis")
    held, _ = m.transition(state, "acknowledge", "b1", None, m.state_hash(state))
    assert held[2] == "acknowledged" and m.transition(held, "observe", "b1", None, m.state_hash(state))[1] == "unexpected-state"
    opened, _ = m.transition(held, "observe", "b2", None, None)
    assert opened[2] == "open" and m.transition(opened, "observe", "b1", None, None)[0][2] == "acknowledged"
    gone, _ = m.transition(held, "delete", None, None, None)
    assert gone[0] == "deleted" and gone[2] == "open" and m.transition(gone, "observe", "b1", None, None)[1] == "not-present"
    assert m.transition(gone, "delete", None, None, None)[1] == "deleted-before" and m.transition(gone, "confirm-move", "b", None, None)[1] == "no-owner"
    assert m.transition(gone, "confirm-move", "b9", "p", None)[0] == ("present", "present", "open", "b9", None, "p", 4)
    assert m.transition(held, "confirm-move", "b", "p", None)[1] == "nothing-moved" and m.transition(held, "odd", None, None, None)[1] == "unknown-kind"
    unclear, _ = m.transition(held, "ambiguous-move", None, None, None)
    assert unclear[0] == "ambiguous" and m.transition(unclear, "ambiguous-move", None, None, None)[1] == "ambiguous-before"
    half, _ = m.transition(held, "delete-target", None, None, None)
    assert half[1] == "deleted" and m.transition(half, "delete-target", None, None, None)[1] == "not-present"


def some_events(n, records, seed):
    rng = random.Random(seed)
    kinds = ["register", "observe", "observe", "acknowledge", "acknowledge", "delete", "delete-target", "ambiguous-move", "confirm-move", "odd"]
    return [(rng.randrange(records), k, rng.choice(kinds), rng.choice(["a", "b", None]), rng.choice(["o1", "o2", None]), None) for k in range(n)]


def folded(rows):
    states, out = {}, {}
    for record, seq, kind, basis, owner, expected in sorted(rows, key=lambda r: r[1]):
        states[record], error = m.transition(states.get(record, m.NONE), kind, basis, owner, expected)
        out[record, seq] = (error, *states[record])
    return out, {k: v for k, v in states.items() if v[0] is not None}


def test_replay_of_many_records_and_of_a_long_one(spark):
    rows = some_events(3000, 12, 1)
    history = m.replay(spark.createDataFrame(rows, EVENTS).repartition(7))
    wanted, states = folded(rows)
    assert {(r.record, r.seq): tuple(r)[3:] for r in history.collect()} == wanted
    assert {r.record: tuple(r)[1:] for r in m.current_records(history).collect()} == states
    counts = {(r.kind, r.error): r.n for r in m.error_counts(history).collect()}
    assert sum(counts.values()) == sum(v[0] is not None for v in wanted.values()) and ("odd", "unknown-kind") in counts
    held = {r.record for r in m.latest_acknowledged(history).collect()}
    assert held <= {k for k, v in states.items() if v[2] == "acknowledged"}
    assert m.replay(spark.createDataFrame([], EVENTS)).count() == 0


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = some_events(120, 5, 2)
    schema = "record bigint, seq bigint, kind string, basis string, owner string"
    for k in range(3):
        spark.createDataFrame([r[:5] for r in rows[k * 40 : k * 40 + 40]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(rows[0][0], 3, "observe", "a", None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = m.replay_stream(stream).writeStream.outputMode("append").format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("replayed").collect()
    assert [(r.seq, r.error) for r in got if r.error == "out-of-order"] == [(3, "out-of-order")]
    assert {(r.record, r.seq): tuple(r)[3:] for r in got if r.error != "out-of-order"} == folded(rows)[0]


def test_observations_and_reconciliation(spark):
    owners = spark.createDataFrame([(o, f"{o}.py", "f", "p", o) for o in "abcdefg"], "owner string, source_path string, symbol string, page string, section string")
    sources = spark.createDataFrame([(f"{o}.py", "f", f"h{o}") for o in "abdeg"] + [("e.py", "f", "again")], "path string, symbol string, hash string")
    sections = spark.createDataFrame([("p", o, f"s{o}") for o in "abceg"], "page string, section string, hash string")
    seen = m.observations(owners, sources, sections)
    facts = {r.owner: (r.presence, r.target_presence, r.basis is not None) for r in seen.collect()}
    assert facts == {"a": ("present", "present", True), "b": ("present", "present", True), "c": ("deleted", "present", False), "d": ("present", "deleted", False), "e": ("ambiguous", "present", False), "f": ("deleted", "deleted", False), "g": ("present", "present", True)}
    basis = {r.owner: r.basis for r in seen.collect()}
    rows = [(k, 1, "register", basis[o] if o == "a" else "old", o, None) for k, o in enumerate("abcdeh")] + [(9, 1, "register", "x", "g", None), (9, 2, "delete", None, None, None)]
    done = {r.owner: r for r in m.reconciled(m.replay(spark.createDataFrame(rows, EVENTS)), seen).collect()}
    assert {o: r.event for o, r in done.items()} == {"a": None, "b": "observe", "c": "delete", "d": "delete-target", "e": "ambiguous-move", "h": None, "g": None}
    assert done["b"].basis == basis["b"] and done["g"].presence == "deleted" and all(r.error is None for r in done.values())
    first = {r.owner: r.event for r in m.reconciled(m.replay(spark.createDataFrame([], EVENTS)), seen).collect()}
    assert first == {"a": "register", "b": "register", "g": "register"}
