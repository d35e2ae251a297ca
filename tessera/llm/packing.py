"""Best-fit packing in a hierarchy of rounds.

Every partition tokenizes its documents, cuts those that are longer than a sequence and packs the pieces
best-fit, longest first. Nearly full bins are emitted. Underfull bins become the items of the next round,
where a few partitions' worth meet in one task (a tree), are packed best-fit again, and so on until one
task is left or a round saves nothing. Tokens themselves never move: a piece carries its length and
checksum, and a round moves (bin, fill) pairs only.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteEncoder, process_own
from .common import byte_view, materialize, row_slices, string_column

#: A bin with at most this share of a sequence left over is final.
SLACK = 1 / 64
#: Pieces that one task packs at once, and bins that meet in one task of a later round.
LOCAL_ITEMS, ROUND_ITEMS, FAN_IN = 200_000, 20_000, 8


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit by falling size: each item's bin and offset, and each bin's fill.

    Bins with the same room left are kept on one stack; the sorted list of rooms in use is at most
    `capacity` long, so an item costs one bisection.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    rooms: list[int] = []
    stacks: dict[int, list[int]] = {}
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            chosen, room = len(fills), capacity
            fills.append(0)
        else:
            room = rooms[at]
            chosen = stacks[room].pop()
            if not stacks[room]:
                del stacks[room], rooms[at]
        bins[i], offsets[i] = chosen, capacity - room
        fills[chosen] += size
        left = room - size
        if left:
            if left not in stacks:
                stacks[left] = []
                bisect.insort(rooms, left)
            stacks[left].append(chosen)
    return bins, offsets, np.asarray(fills, np.int64)


def cut_pieces(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of documents with so many tokens: first pieces take the remainders, others are full."""
    counts = -(-tokens // capacity)
    first = tokens - (counts - 1) * capacity
    row = np.repeat(np.arange(len(tokens)), counts)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
    return row, piece, start, np.where(piece > 0, capacity, first[row])


class _Pieces:
    """Pieces of the documents taken in so far, packed together when there are enough of them."""

    def __init__(self):
        self.ids, self.parts, self.rows = [], [], 0

    def add(self, ids: pa.Array, encoded: list[np.ndarray], end: bytes, capacity: int) -> None:
        row, piece, start, length = cut_pieces(np.asarray([len(e) + 1 for e in encoded], np.int64), capacity)
        crc = np.zeros(len(row), np.int64)
        views, first = [memoryview(e).cast("B") if len(e) else b"" for e in encoded], start << 2
        for k, (r, a, b) in enumerate(zip(row.tolist(), first.tolist(), (first + (length << 2)).tolist())):
            view = views[r]
            crc[k] = zlib.crc32(view[a:b]) if b <= len(view) else zlib.crc32(end, zlib.crc32(view[a:]))
        self.ids.append(ids.take(pa.array(row)))
        self.parts.append(np.stack((piece, start, length, crc)))
        self.rows += len(row)

    def packed(self, capacity: int, first_bin: int) -> tuple[pa.RecordBatch, int]:
        table = np.concatenate(self.parts, axis=1)
        bins, offsets, fills = best_fit(table[2], capacity)
        columns = [pa.concat_arrays(self.ids), *map(pa.array, table), pa.array(bins + first_bin), pa.array(offsets), pa.array(fills[bins])]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "fill"]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, names=names), first_bin + len(fills)


def _round(bins: DataFrame, group, capacity: int) -> DataFrame:
    """Packs the bins of each group as items; rows (bin, into, at, fill)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        which, at, fills = best_fit(frame["fill"].to_numpy(), capacity)
        heads = np.full(len(fills), -1, np.int64)
        head_at = np.flatnonzero(at == 0)
        heads[which[head_at]] = frame["bin"].to_numpy()[head_at]  # a merged bin keeps the id of its first item
        return pd.DataFrame({"bin": frame["bin"], "into": heads[which], "at": at, "fill": fills[which]})

    return bins.withColumn("g", group).groupBy("g").applyInPandas(run, "bin bigint, into bigint, at bigint, fill bigint")


def pack_documents(docs: DataFrame, path: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece.

    `path` names the tokenizer; `ranks` may name the same vocabulary as merge ranks, which encode faster.
    A null text counts as empty and is the end id alone. Repeated rows and ids, and null ids, are packed as
    documents of their own; of pieces of equal length any may come first; an empty table gives no rows; other
    columns are not looked at. A long text is encoded stretch by stretch. No text is shuffled; one row of about 60 bytes per piece is written to the shared folder, and
    pieces of underfull bins alone are joined with the outcome of the rounds.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, _Pieces()
        next_bin = TaskContext.get().partitionId() << 36
        for batch in batches:
            if not batch.num_rows:
                continue
            own = own or process_own(ByteEncoder, path, ranks)
            column = string_column(batch, "text")
            for low, high in row_slices(byte_view(column)[1], slice_bytes):
                texts = column.slice(low, high - low).to_pylist()
                held.add(batch.column(0).slice(low, high - low), [own.encode(t) for t in texts], end, capacity)
                if held.rows >= LOCAL_ITEMS:
                    out, next_bin = held.packed(capacity, next_bin)
                    yield out
        if held.rows:
            out, next_bin = held.packed(capacity, next_bin)
            yield out

    schema = f"doc_id {kind.simpleString()}, piece bigint, start bigint, length bigint, ids_crc32 bigint, bin bigint, at bigint, fill bigint"
    pieces = materialize(rows.mapInArrow(run, schema), "pieces")
    final = F.col("fill") >= F.lit(capacity - int(capacity * SLACK))
    placed = _place(pieces.filter(~final & (F.col("at") == 0)).select("bin", "fill"), capacity)
    columns = ["doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32"]
    done = pieces.filter(final).select(*columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    moved = pieces.filter(~final).drop("fill").join(placed.withColumnRenamed("at", "base"), "bin")
    return done.unionByName(moved.select(*columns, F.col("sequence_id"), (F.col("base") + F.col("at")).alias("offset")))


def _place(bins: DataFrame, capacity: int) -> DataFrame:
    """Where each underfull bin ends up: rows (bin, sequence_id, at)."""
    state = materialize(bins.select("bin", F.col("bin").alias("sequence_id"), F.lit(0).cast("bigint").alias("at"), "fill"), "bins")
    level = 36  # the bits below number a partition's own bins
    n = state.count()
    partitions = state.agg(F.max(F.shiftright("bin", 36))).first()[0]
    partitions = 0 if partitions is None else int(partitions) + 1
    width = partitions
    while n and (width > 1 or level == 36):
        level += FAN_IN.bit_length() - 1
        width = -(-width // FAN_IN)
        tops = state.filter((F.col("at") == 0) & (F.col("bin") == F.col("sequence_id"))).select("bin", "fill")
        underfull = tops.filter(F.col("fill") < capacity - int(capacity * SLACK))
        # Bins of one subtree meet; a subtree with too many for one task is dealt out over several.
        per_group = max(1, -(-n // max(1, width * ROUND_ITEMS)))
        group = F.struct(F.shiftright("bin", level).alias("tree"), F.pmod(F.xxhash64("bin"), F.lit(per_group)).alias("part"))
        merged = _round(underfull, group, capacity).select(F.col("bin").alias("sequence_id"), "into", F.col("at").alias("base"), F.col("fill").alias("merged"))
        state = materialize(
            state.join(merged, "sequence_id", "left").select(
                "bin",
                F.coalesce("into", "sequence_id").alias("sequence_id"),
                (F.col("at") + F.coalesce("base", F.lit(0))).alias("at"),
                F.coalesce("merged", "fill").alias("fill"),
            ),
            f"bins{level}",
        )
        left = state.filter((F.col("bin") == F.col("sequence_id")) & (F.col("fill") < capacity - int(capacity * SLACK))).count()
        if not left or (left == n and width <= 1):
            break
        n = left
    return state.select("bin", "sequence_id", "at")
