"""Maintenance evidence: what is observed of each record's source and prose, and the replay of its events.

A record's events are replayed in order by a state machine. In a batch they stream through a task sorted, so a record
with any number of events needs one state's memory; in a stream the state is kept between micro-batches. Both call the
same transition. An event that its state doesn't allow is an error and changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Kinds of events and states of presence.
KINDS = ("register", "observe", "acknowledge", "delete", "delete-target", "ambiguous-move", "confirm-move")
PRESENT, DELETED, AMBIGUOUS = "present", "deleted", "ambiguous"
STATE = "presence string, target_presence string, status string, basis string, acknowledged string, owner string, version bigint"
_FIELDS = [c.split()[0] for c in STATE.split(", ")]
EVENT = ["record", "seq", "kind", "basis", "owner", "expected"]
NONE = (None, None, None, None, None, None, 0)


def state_hash(state: tuple) -> str:
    """What an event can name as the state that it expects."""
    return hashlib.sha256("\x1f".join("" if v is None else str(v) for v in state).encode()).hexdigest()


def transition(state: tuple, kind: str, basis: str | None, owner: str | None, expected: str | None) -> tuple[tuple, str | None]:
    """(state after the event, error): the state as it was where the event isn't allowed."""
    presence, target, status, now, acknowledged, held, version = state
    if expected is not None and expected != state_hash(state):
        return state, "unexpected-state"
    if kind not in KINDS:
        return state, "unknown-kind"
    if kind == "register":
        return (state, "registered-before") if presence is not None else ((PRESENT, PRESENT, "open", basis, None, owner, 1), None)
    if presence is None:
        return state, "not-registered"
    whole = presence == PRESENT and target == PRESENT
    if kind == "observe":
        if not whole:
            return state, "not-present"
        return (PRESENT, PRESENT, "acknowledged" if basis is not None and basis == acknowledged else "open", basis, acknowledged, held, version + 1), None
    if kind == "acknowledge":
        if not whole:
            return state, "not-present"
        return (state, "stale-basis") if basis != now or basis is None else ((PRESENT, PRESENT, "acknowledged", now, basis, held, version + 1), None)
    if kind == "delete":
        return (state, "deleted-before") if presence == DELETED else ((DELETED, target, "open", None, None, held, version + 1), None)
    if kind == "delete-target":
        return (state, "not-present") if not whole else ((PRESENT, DELETED, "open", now, None, held, version + 1), None)
    if kind == "ambiguous-move":
        return (state, "ambiguous-before") if presence == AMBIGUOUS else ((AMBIGUOUS, target, "open", now, None, held, version + 1), None)
    if presence == PRESENT and target == PRESENT:
        return state, "nothing-moved"
    return (state, "no-owner") if owner is None else ((PRESENT, PRESENT, "open", basis, None, owner, version + 1), None)


def _normal(value):
    return None if pd.isna(value) else value


def _replayed(frames: Iterator[pd.DataFrame], state: tuple = NONE, record=None) -> Iterator[tuple[pd.DataFrame, object, tuple]]:
    """(rows with their states and errors, the last record, its state) of frames sorted by record and seq."""
    for frame in frames:
        rows = []
        for r in frame[EVENT].itertuples(index=False):
            if r.record != record:
                record, state = r.record, NONE
            state, error = transition(state, r.kind, *map(_normal, (r.basis, r.owner, r.expected)))
            rows.append((r.record, r.seq, r.kind, error, *state))
        yield pd.DataFrame(rows, columns=["record", "seq", "kind", "error", *_FIELDS]), record, state


def _events(events: DataFrame) -> DataFrame:
    return events.select("record", "seq", "kind", *[F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in EVENT[3:]])


def replay(events: DataFrame) -> DataFrame:
    """Each event (record, seq, kind, basis, owner, expected) with its error or null, and the record's state after it.

    Events of a record with the same seq are in the order of their kind and basis.
    """
    kind = events.schema["record"].dataType.simpleString()
    rows = _events(events).repartition("record").sortWithinPartitions("record", "seq", "kind", "basis")
    return rows.mapInPandas(lambda frames: (out for out, _, _ in _replayed(frames)), f"record {kind}, seq bigint, kind string, error string, {STATE}")


def current_records(history: DataFrame) -> DataFrame:
    """The last state of each record that was ever registered."""
    per = history.groupBy("record").agg(F.max_by(F.struct(*_FIELDS), F.struct("seq", "version")).alias("s"))
    return per.select("record", "s.*").filter("presence IS NOT NULL")


def replay_stream(events: DataFrame) -> DataFrame:
    """The same for a stream: the state of a record is kept between micro-batches. An event that comes after a later one is
    an error, `out-of-order`."""
    kind = events.schema["record"].dataType.simpleString()
    output = f"record {kind}, seq bigint, kind string, error string, {STATE}"

    def run(key, frames, held):
        state, last = NONE, None
        if held.exists:
            *state, last = held.get
            state = tuple(map(_normal, state))
        frame = pd.concat(list(frames)).sort_values(["seq", "kind", "basis"], na_position="first")
        late = frame["seq"] <= last if last is not None else pd.Series(False, index=frame.index)
        if late.any():
            out = frame.loc[late, ["record", "seq", "kind"]].assign(error="out-of-order", **dict(zip(_FIELDS, state)))
            yield out
        for out, _, state in _replayed([frame[~late]], state, key[0]):
            if len(out):
                held.update((*state, int(frame["seq"].max())))
                yield out

    return _events(events).groupBy("record").applyInPandasWithState(run, output, f"{STATE}, last bigint", "append", "NoTimeout")


def observations(owners: DataFrame, sources: DataFrame, sections: DataFrame) -> DataFrame:
    """(owner, presence, target_presence, basis): what is there of each owner now.

    owners: owner, source_path, symbol, page, section; sources: path, symbol, hash; sections: page, section, hash. A
    source that isn't there is deleted, a symbol that it has several times is ambiguous; a section that isn't there is a
    deleted target. The basis is a digest of both hashes, null where either is missing.
    """
    found = sources.groupBy(F.col("path").alias("source_path"), "symbol").agg(F.count("*").alias("n"), F.min("hash").alias("source_hash"))
    prose = sections.groupBy("page", "section").agg(F.min("hash").alias("prose_hash"))
    j = owners.join(found, ["source_path", "symbol"], "left").join(prose, ["page", "section"], "left")
    presence = F.when(F.col("n").isNull(), DELETED).when(F.col("n") > 1, AMBIGUOUS).otherwise(PRESENT)
    both = (presence == PRESENT) & F.col("prose_hash").isNotNull()
    return j.select("owner", presence.alias("presence"), F.when(F.col("prose_hash").isNull(), DELETED).otherwise(PRESENT).alias("target_presence"), F.when(both, F.sha2(F.concat_ws("\x1f", "source_hash", "prose_hash"), 256)).alias("basis"))


def pending_events(records: DataFrame, observed: DataFrame) -> DataFrame:
    """Events (record, owner, kind, basis) that bring records up to what is observed; none where nothing has changed.

    An owner without a record is registered if source and prose are there. A record whose owner is ambiguous, or that was
    deleted, waits for a confirmed move, also when its source or prose comes back. A record of an owner that isn't
    observed stays as it is.
    """
    r = records.select("record", "owner", F.col("presence").alias("was"), F.col("target_presence").alias("target_was"), F.col("basis").alias("old_basis"))
    j = r.join(observed, "owner", "full_outer")
    there = (F.col("presence") == PRESENT) & (F.col("target_presence") == PRESENT)
    kind = (
        F.when(F.col("record").isNull(), F.when(there, "register"))
        .when(F.col("presence").isNull() | (F.col("was") != PRESENT), F.lit(None))
        .when(F.col("presence") == DELETED, "delete")
        .when(F.col("presence") == AMBIGUOUS, "ambiguous-move")
        .when((F.col("target_presence") == DELETED) & (F.col("target_was") == PRESENT), "delete-target")
        .when(there & (F.col("target_was") == PRESENT) & ~F.col("basis").eqNullSafe(F.col("old_basis")), "observe")
    )
    new = F.sha2(F.concat_ws("\x1f", F.lit("record"), "owner"), 256)
    return j.select(F.coalesce(F.col("record").cast("string"), new).alias("record"), "owner", kind.alias("kind"), F.when(kind.isin("register", "observe"), F.col("basis")).alias("basis")).filter("kind IS NOT NULL")


def reconciled(history: DataFrame, observed: DataFrame) -> DataFrame:
    """All records after the pending events; `event` is what happened to each, null where nothing did."""
    records = current_records(history).withColumn("record", F.col("record").cast("string"))
    events = pending_events(records, observed)
    # The next event of a record continues its history, so it is replayed from the state and not from the start.
    both = events.withColumnsRenamed({"owner": "new_owner", "basis": "new_basis"}).join(records, "record", "full_outer")

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                state = tuple(_normal(getattr(r, f)) for f in _FIELDS)
                state = NONE if state[0] is None else state
                event, error = _normal(r.kind), None
                if event is not None:
                    state, error = transition(state, event, _normal(r.new_basis), _normal(r.new_owner), None)
                rows.append((r.record, event, error, *state))
            yield pd.DataFrame(rows, columns=["record", "event", "error", *_FIELDS])

    return both.mapInPandas(run, f"record string, event string, error string, {STATE}")


def error_counts(history: DataFrame) -> DataFrame:
    """How often each kind of event failed, why, and the first place of each failure."""
    first = F.min(F.struct("record", "seq"))
    return history.filter("error IS NOT NULL").groupBy("kind", "error").agg(F.count("*").alias("n"), first.alias("first")).select("kind", "error", "n", F.col("first.record").alias("first_record"), F.col("first.seq").alias("first_seq"))


def latest_acknowledged(history: DataFrame) -> DataFrame:
    """The last acknowledgement of each record that still holds."""
    held = history.filter("kind = 'acknowledge' AND error IS NULL").withColumn("k", F.row_number().over(Window.partitionBy("record").orderBy(F.desc("seq")))).filter("k = 1")
    now = current_records(history).filter("status = 'acknowledged'").select("record")
    return held.join(now, "record", "left_semi").select("record", "seq", "basis")
