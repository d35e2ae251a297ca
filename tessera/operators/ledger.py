"""Identities over snapshots: when each coordinate was valid, which identity it belonged to, and what was retired.

A coordinate's presence is an interval of snapshots. An interval continues an identity if a declared move leads into it,
or if the coordinate comes back without having been moved away; otherwise it is a new identity. So a deletion with a
recreation elsewhere is never taken for a move. Identities are found by pointer doubling: as many joins as the
logarithm of the longest history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_uid
from .diffs import infrastructure_moves
from .graph import checkpointed


def presence_intervals(snapshots: DataFrame) -> DataFrame:
    """(locator, valid_from, valid_to): the runs of consecutive snapshots in which each locator is there."""
    seen = snapshots.select("locator", "snapshot").distinct()
    per = Window.partitionBy("locator").orderBy("snapshot")
    runs = seen.withColumn("run", F.col("snapshot") - F.row_number().over(per))
    return runs.groupBy("locator", "run").agg(F.min("snapshot").alias("valid_from"), F.max("snapshot").alias("valid_to")).drop("run")


def identity_intervals(snapshots: DataFrame, moves: DataFrame) -> DataFrame:
    """(uid, locator, valid_from, valid_to, how, root_locator, root_from, conflict) of every presence interval.

    snapshots: snapshot (consecutive numbers), locator; moves: snapshot, old_locator, new_locator. `how` is allocated, moved
    or returned. `conflict` names a coordinate that a moved identity still has as an alias and another one takes
    (alias-owned), a move from where nothing was (move-without-origin), or several moves into one coordinate (forked-move).
    """
    spans = checkpointed(presence_intervals(snapshots))
    into = moves.groupBy(F.col("new_locator").alias("locator"), F.col("snapshot").alias("valid_from")).agg(F.count_distinct("old_locator").alias("origins"), F.min("old_locator").alias("old_locator"))
    rows = spans.join(into, ["locator", "valid_from"], "left")
    # The origin is the old coordinate's last interval that began before the move.
    old = spans.select(F.col("locator").alias("old_locator"), F.col("valid_from").alias("old_from"))
    origin = rows.filter("origins = 1").join(old, "old_locator").filter("old_from < valid_from").groupBy("locator", "valid_from").agg(F.max("old_from").alias("old_from"))
    rows = rows.join(origin, ["locator", "valid_from"], "left")
    # A coordinate that comes back continues its last interval, unless a move led away since that began.
    per = Window.partitionBy("locator").orderBy("valid_from")
    rows = rows.withColumn("last_from", F.lag("valid_from").over(per))
    away = moves.select(F.col("old_locator").alias("locator"), F.col("snapshot").alias("left_at"))
    gone = rows.filter("last_from IS NOT NULL").join(away, "locator").filter("left_at > last_from AND left_at <= valid_from").select("locator", "valid_from", F.lit(True).alias("moved_away")).distinct()
    rows = rows.join(gone, ["locator", "valid_from"], "left")
    moved = F.col("old_from").isNotNull()
    back = ~moved & F.col("origins").isNull() & F.col("last_from").isNotNull() & F.col("moved_away").isNull()
    how = F.when(moved, "moved").when(back, "returned").otherwise("allocated")
    conflict = F.when(F.col("origins") > 1, "forked-move").when(F.col("origins").isNotNull() & ~moved, "move-without-origin").when(~moved & F.col("moved_away"), "alias-owned")
    before = F.when(moved, F.struct(F.col("old_locator").alias("locator"), F.col("old_from").alias("valid_from"))).when(back, F.struct(F.col("locator").alias("locator"), F.col("last_from").alias("valid_from")))
    here = F.struct(F.col("locator").alias("locator"), F.col("valid_from").alias("valid_from"))
    rows = rows.select(here.alias("here"), "valid_to", how.alias("how"), conflict.alias("conflict"), F.coalesce(before, here).alias("root"))
    while True:
        rows = checkpointed(rows)
        step = rows.select(F.col("here").alias("root"), F.col("root").alias("further"))
        further = rows.join(step, "root").withColumn("moves_on", F.col("further") != F.col("root"))
        if further.filter("moves_on").isEmpty():
            break
        rows = further.withColumn("root", F.col("further")).drop("further", "moves_on")
    uid = stable_uid("identity", F.concat_ws("\x1f", "root.locator", F.col("root.valid_from").cast("string")))
    return rows.select(uid.alias("uid"), "here.locator", "here.valid_from", "valid_to", "how", F.col("root.locator").alias("root_locator"), F.col("root.valid_from").alias("root_from"), "conflict")


def identities_at(intervals: DataFrame, snapshot: int) -> DataFrame:
    """(uid, locator) of the identities that are there in a snapshot."""
    return intervals.filter((F.col("valid_from") <= snapshot) & (F.col("valid_to") >= snapshot)).select("uid", "locator")


def identity_records(intervals: DataFrame, last: int) -> DataFrame:
    """(uid, locator, aliases, since, retired_at) of each identity: its last coordinate, those it had before, when it began and,
    if it isn't in the last snapshot, when it went."""
    per = intervals.groupBy("uid").agg(F.max_by(F.struct("locator", "valid_to"), "valid_from").alias("now"), F.array_sort(F.collect_set("locator")).alias("all"), F.min("valid_from").alias("since"))
    return per.select("uid", "now.locator", F.array_except("all", F.array("now.locator")).alias("aliases"), "since", F.when(F.col("now.valid_to") < last, F.col("now.valid_to") + 1).alias("retired_at"))


def lifecycle_errors(records: DataFrame, changes: DataFrame) -> DataFrame:
    """(uid, seq, error) of lifecycle changes (uid, seq, state, successor) that can't be: a successor that is missing where
    one is due, given where none is, unknown, the identity itself, or one that leads back; a change after the end."""
    known = records.select(F.col("uid").alias("successor"), F.lit(True).alias("known")).distinct()
    ended = F.max(F.when(F.col("state").isin("superseded", "retired"), F.col("seq"))).over(Window.partitionBy("uid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    j = changes.withColumn("ended", ended).join(known, "successor", "left")
    simple = (
        F.when(F.col("ended").isNotNull(), "after-end")
        .when((F.col("state") == "superseded") & F.col("successor").isNull(), "successor-required")
        .when((F.col("state") != "superseded") & F.col("successor").isNotNull(), "successor-not-allowed")
        .when(F.col("successor") == F.col("uid"), "self-successor")
        .when(F.col("successor").isNotNull() & F.col("known").isNull(), "unknown-successor")
    )
    j = checkpointed(j.select("uid", "seq", "state", "successor", simple.alias("error")))
    # Successors form a forest unless they loop; doubled pointers that don't end are in or before a loop.
    links = j.filter("error IS NULL AND state = 'superseded'").select("uid", F.col("successor").alias("to"))
    reach, rounds = checkpointed(links), 1
    n = links.count()
    while rounds < n:
        step = reach.select(F.col("uid").alias("to"), F.col("to").alias("further"))
        new = checkpointed(reach.join(step, "to").select("uid", F.col("further").alias("to")))
        rounds *= 2
        reach = new
        if new.isEmpty():
            break
    looped = reach.select("uid").distinct() if n > 0 and rounds >= n and n > 1 else reach.limit(0).select("uid")
    loops = j.filter("error IS NULL AND state = 'superseded'").join(looped, "uid", "left_semi").select("uid", "seq", F.lit("successor-cycle").alias("error"))
    return j.filter("error IS NOT NULL").select("uid", "seq", "error").unionByName(loops)


def infrastructure_sync(recorded: DataFrame, tombstones: DataFrame, live: DataFrame, pages: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(path, action, page, moved_from) from recorded to live infrastructure sources, tombstones included.

    recorded and live: path, adapter, content_hash, observation_hash, page; tombstones: path, page; pages: page, those that
    are there. Actions: added, revived (a tombstone's source is back), changed, unchanged, moved (its old page is to be
    cleaned up), removed (becomes a tombstone), buried (a tombstone that stays), repair (one whose page is still there),
    deselected (recorded or tombstone, outside `selected`).
    """
    if selected is None:
        outside = recorded.limit(0).select("path", "page")
    else:
        chosen = selected.select("path").distinct()
        outside = recorded.select("path", "page").unionByName(tombstones.select("path", "page")).join(chosen, "path", "left_anti")
        recorded, tombstones = recorded.join(chosen, "path", "left_semi"), tombstones.join(chosen, "path", "left_semi")
    old = recorded.select("path", F.col("page").alias("old_page"), F.concat_ws(":", "content_hash", "observation_hash").alias("old"))
    new = live.select("path", F.col("page").alias("new_page"), F.concat_ws(":", "content_hash", "observation_hash").alias("new"))
    dead = tombstones.select("path", F.col("page").alias("dead_page"))
    j = old.join(new, "path", "full_outer").join(dead, "path", "left")
    action = F.when(F.col("old").isNull(), F.when(F.col("dead_page").isNotNull(), "revived").otherwise("added")).when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    plan = checkpointed(j.select("path", action.alias("action"), F.coalesce("new_page", "old_page").alias("page"), "old_page"))
    moves = infrastructure_moves(recorded.join(plan.filter("action = 'removed'"), "path", "left_semi"), live.join(plan.filter("action = 'added'"), "path", "left_semi")).select(F.col("new_path").alias("path"), F.col("old_path").alias("moved_from"))
    plan = plan.join(moves.select(F.col("moved_from").alias("path")), "path", "left_anti").join(moves, "path", "left")
    plan = plan.select("path", F.when(F.col("moved_from").isNotNull(), "moved").otherwise(F.col("action")).alias("action"), "page", "moved_from")
    there = pages.select("page", F.lit(True).alias("there")).distinct()
    buried = tombstones.select("path", "page").join(live.select("path"), "path", "left_anti").join(there, "page", "left").select("path", F.when(F.col("there"), "repair").otherwise("buried").alias("action"), "page", F.lit(None).cast("string").alias("moved_from"))
    deselected = outside.select("path", F.lit("deselected").alias("action"), "page", F.lit(None).cast("string").alias("moved_from")).distinct()
    return plan.unionByName(buried).unionByName(deselected)


def next_tombstones(plan: DataFrame) -> DataFrame:
    """(path, page) of the tombstones after a plan has been carried out."""
    return plan.filter(F.col("action").isin("removed", "buried", "repair")).select("path", "page")
