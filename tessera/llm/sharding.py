"""K-d tree partitioning, with DataFrame functions alone.

The documents' metadata is a cloud of weighted points: a point per group of equal texts, the group's bytes as weight. A
node is split at the weighted median of the dimension in which it is widest, so that its parts hold bytes in proportion
to the room of the leaves below them, until the leaves reach the target. Medians come from distributed histograms
that are narrowed down pass by pass: all nodes of a level share each pass, and the driver sees at most BUCKETS sums
per node.

A group heavier than HEAVY of a shard would unbalance any split. There are shards / HEAVY of those at most; they are
put first, heaviest first, each whole into the shard with the most room, and the tree splits the others to fill the
room that is left. Only a group that fits into no shard's room is dealt out, by a hash of the id, over several.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, release

#: Histogram cells per node and pass; a cell with one point, or less than this share of its node, goes to one side whole.
BUCKETS, TOLERANCE = 4096, 1e-3
#: The share of a shard beyond which a group of equal texts is placed before the tree is built.
HEAVY = 1 / 32
#: Rows that one task numbers within a shard.
SLOT_ROWS = 50_000
#: Positions in a dimension: [0, 2^SCALE).
SCALE = 24


@dataclass
class Node:
    """A node of the tree: leaves first..first+leaves-1 lie below it."""

    path: int
    leaves: int
    first: int

    def children(self) -> tuple[Node, Node]:
        left = self.leaves // 2
        return Node(2 * self.path, left, self.first), Node(2 * self.path + 1, self.leaves - left, self.first + left)


def _position(value: Column, low: float, high: float) -> Column:
    """A number's place in its range as a long in [0, 2^SCALE)."""
    span = (high - low) or 1.0
    return F.least(F.lit((1 << SCALE) - 1), F.greatest(F.lit(0), F.floor((value - F.lit(low)) / F.lit(span) * F.lit(float((1 << SCALE) - 1))))).cast("bigint")


def _hash_position(value: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value, F.lit(seed)), 64 - SCALE)


def _small_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """At most one row per tree node, shard or heavy group, as literals in the plan; text is an expression."""
    literal = lambda v: "CAST(NULL AS BIGINT)" if v is None else v if isinstance(v, str) else f"{int(v)}L"
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})"))


def _medians(points: DataFrame, nodes: dict[int, tuple[int, float, float]]) -> dict[int, tuple]:
    """For each node (dimension, total weight, share) the bound (b0, b1, b2) at that share of its weight.

    Each pass cuts the range that still holds the wanted weight into BUCKETS cells. When one position alone
    is still too heavy, the content hash breaks the tie, and after it the id hash.
    """
    state = {n: {"key": 0, "fix": [None, None], "low": 0, "high": 1 << SCALE, "before": 0.0} for n in nodes}
    done: dict[int, tuple] = {}
    while state:
        for s in state.values():
            s["width"] = max(1, -(-(s["high"] - s["low"]) // BUCKETS))
        rows = [(n, nodes[n][0], s["key"], *s["fix"], s["low"], s["high"], s["width"]) for n, s in state.items()]
        wanted_cells = _small_table(points.sparkSession, "node, dim, which, fix0, fix1, low, high, width", rows)
        first = F.element_at("at", (F.col("dim") + 1).cast("int"))
        current = F.when(F.col("which") == 0, first).when(F.col("which") == 1, F.col("content")).otherwise(F.col("own"))
        fixed = ((F.col("which") < 1) | (first == F.col("fix0"))) & ((F.col("which") < 2) | (F.col("content") == F.col("fix1")))
        here = points.join(wanted_cells, "node").filter(fixed & (current >= F.col("low")) & (current < F.col("high")))
        cell = F.floor((current - F.col("low")) / F.col("width")).cast("int")
        sums: dict[int, list] = {}
        for r in here.groupBy("node", cell.alias("cell")).agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect():
            sums.setdefault(r.node, []).append((r.cell, float(r.w), r.n))
        for n in list(state):
            s, (_, total, share) = state[n], nodes[n]
            run, wanted = s["before"], share * total
            cells = sorted(sums[n])
            for cell_no, weight, rows_in in cells:
                if run + weight >= wanted or cell_no == cells[-1][0]:
                    break
                run += weight
            low = s["low"] + cell_no * s["width"]
            high = min(s["high"], low + s["width"])
            if rows_in == 1 or weight <= TOLERANCE * total or (high - low == 1 and s["key"] == 2):
                at = low if wanted - run < run + weight - wanted else high
                done[n] = (*[f for f in s["fix"] if f is not None], at, None, None)[:3]
                del state[n]
            elif high - low == 1:
                s["fix"][s["key"]] = low
                s |= {"key": s["key"] + 1, "low": 0, "high": 1 << SCALE, "before": run}
            else:
                s |= {"low": low, "high": high, "before": run}
    return done


def placed_first(heavy: list[tuple[int, int]], room: list[float]) -> list[list[tuple[int, float]]]:
    """For each heavy group (key, bytes) its shards as (shard, share up to and with it); `room` shrinks.

    A group goes whole where there is most room; where it fits nowhere, it fills one shard after another.
    """
    out: list[list[tuple[int, float]]] = [[] for _ in heavy]
    for k in sorted(range(len(heavy)), key=lambda k: (-heavy[k][1], heavy[k][0])):
        left = size = heavy[k][1]
        while left > 0:
            shard = max(range(len(room)), key=lambda s: (room[s], -s))
            part = left if room[shard] >= left or room[shard] <= 0 else room[shard]
            room[shard] -= part
            left -= part
            out[k].append((shard, 1 - left / size))
    return out


def tree_leaves(points: DataFrame, room: list[float]) -> DataFrame:
    """`points` (content, own, at array, size) with the leaf each falls into: leaf k gets a share of bytes like room[k].

    `at` holds a point's positions; points at one position are ordered by content and own. Each level's outcome is
    written, so that no pass repeats the levels above it.
    """
    dimensions = len(points.first()["at"])
    points = materialize(points.withColumn("node", F.lit(1).cast("bigint")), "level")
    level, leaves = [Node(1, len(room), 0)], []
    space = lambda n: sum(max(0.0, r) for r in room[n.first : n.first + n.leaves])
    while level:
        leaves += [n for n in level if n.leaves == 1]
        level = [n for n in level if n.leaves > 1]
        if not level:
            break
        # One pass finds each node's weight and its extent in each dimension.
        at = lambda k: F.element_at("at", k + 1)
        extents = [(F.max(at(k)) - F.min(at(k))).alias(f"e{k}") for k in range(dimensions)]
        seen = {r.node: r for r in points.groupBy("node").agg(F.sum("size").alias("w"), *extents).collect()}
        wanted = {}
        for node in level:
            if node.path in seen:
                r, total = seen[node.path], space(node)
                extent = [r[f"e{k}"] for k in range(dimensions)]
                share = space(node.children()[0]) / total if total else (node.leaves // 2) / node.leaves
                wanted[node.path] = (extent.index(max(extent)), float(r.w), share)
        bounds = _medians(points, wanted) if wanted else {}
        if bounds:
            first = F.element_at("at", (F.col("dim") + 1).cast("int"))
            b0, b1, b2 = F.col("b0"), F.col("b1"), F.col("b2")
            tie = b1.isNotNull() & ((F.col("content") < b1) | ((F.col("content") == b1) & b2.isNotNull() & (F.col("own") < b2)))
            left = (first < b0) | ((first == b0) & tie)
            child = F.when(b0.isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(left, 0).otherwise(1))
            table = _small_table(points.sparkSession, "node, dim, b0, b1, b2", [(n, wanted[n][0], *b) for n, b in bounds.items()])
            below = materialize(points.join(table, "node", "left").withColumn("node", child).drop("dim", "b0", "b1", "b2"), "level")
            release(points)
            points = below
        level = [c for n in level for c in n.children()]
    leaf_of = _small_table(points.sparkSession, "node, leaf", [(n.path, n.first) for n in leaves])
    return points.join(leaf_of, "node").drop("node").withColumn("leaf", F.col("leaf").cast("int"))


def kd_shards(docs: DataFrame, shards: int, dimensions: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard): `shards` leaves of near-equal bytes.

    `dimensions` maps names to numeric metadata columns; null counts as the least value, a group has the least of its
    rows. A document's size is its text's UTF-8 bytes plus one; a null text has size 1 and is in one group with empty
    ones. Repeated rows are members of their group as often as they occur. Only ids, sizes and positions are written to
    the shared folder and read by the passes; texts, however long, are read once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [f"d_{k}" for k in range(len(dimensions))]
    raw = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        *[c.cast("double").alias(n) for n, c in zip(names, dimensions.values())],
    )
    raw = materialize(raw, "points")
    spans = raw.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)], F.sum("size").alias("total")).first()
    if spans.total is None:
        return raw.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"))
    place = lambda n: _position(F.coalesce(F.col(n), F.lit(spans[f"min_{n}"])), spans[f"min_{n}"], spans[f"max_{n}"]) if spans[f"min_{n}"] is not None else F.lit(0).cast("bigint")
    positions = F.array(*[F.coalesce(F.min(place(n)), F.lit(0).cast("bigint")) for n in names])
    groups = materialize(raw.groupBy("key", "text_crc32", F.col("size").alias("each")).agg(F.sum("size").alias("size"), positions.alias("at")), "groups")
    room = [spans.total / shards] * shards
    # Few by their definition: at most shards / HEAVY groups.
    heavy = groups.filter(F.col("size") > spans.total / shards * HEAVY).collect()
    first = placed_first([(r.key, r["size"]) for r in heavy], room)

    same = ["key", "text_crc32", "each"]
    docs = raw.select("doc_id", "size", "text_crc32", "key", F.col("size").alias("each"))
    out = []
    light = groups.filter(F.col("size") <= spans.total / shards * HEAVY)
    if light.limit(1).count():
        own = _hash_position(F.struct(*same), 2).alias("own")
        leaves = tree_leaves(light.select(*same, "size", _hash_position(F.col("key"), 1).alias("content"), own, "at"), room)
        out.append(docs.join(leaves.select(*same, F.col("leaf").alias("shard")), same))
    if heavy:
        draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 11) / F.lit(float(1 << 53))
        parts_of = lambda parts: "array(" + ", ".join(f"named_struct('up', {float(up)!r}D, 'shard', {int(s)})" for s, up in parts) + ")"
        table = _small_table(raw.sparkSession, "key, text_crc32, each, parts", [(r.key, r.text_crc32, r.each, parts_of(parts)) for r, parts in zip(heavy, first)])
        shard = F.coalesce(F.filter("parts", lambda p: draw < p["up"])[0]["shard"], F.element_at("parts", -1)["shard"])
        out.append(docs.join(table, same).withColumn("shard", shard))
    found = out[0] if len(out) == 1 else out[0].select("doc_id", "size", "text_crc32", "shard").unionByName(out[1].select("doc_id", "size", "text_crc32", "shard"))
    return found.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))


def with_slots(sharded: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Adds slot: places 0, 1, ... within each shard, without bringing a shard's rows to one task.

    A shard is dealt into parts by a hash of the id; rows are numbered within a part and shifted by the
    rows of the parts before it.
    """
    sharded = materialize(sharded.withColumn("n", F.lit(1)), "shards").drop("n")
    n = sharded.count()
    parts = max(16, -(-n // (16 * slot_rows)))
    dealt = sharded.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "part", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1
    return dealt.withColumn("number", number).join(offsets, ["shard", "part"]).select(*sharded.columns, (F.col("before") + F.col("number")).cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard): shards 0 to `shards`-1 of near-equal bytes.

    The dimensions are size, bytes a character, lines and, where there are such columns, language and source. Null and
    empty texts have size 1 and are one group; a null language or source is a value of its own; repeated rows get a slot
    each; ties are ordered by content; an empty table gives no rows; other columns are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size, chars = F.octet_length(text), F.length(text)
    dimensions = {
        "size": F.log1p(size),
        "script": F.when(chars > 0, size / chars).otherwise(1.0),
        "lines": F.log1p(F.regexp_count(text, F.lit("\n"))),
        **{c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("lang", "source") if c in docs.columns},
    }
    out = with_slots(kd_shards(docs, shards, dimensions))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
