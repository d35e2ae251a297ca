"""Byte n-gram models whose counts and probabilities never travel whole: texts meet them by joins sharded by n-gram.

1. Texts are taken in blocks of rows of a file. Each block asks for the distinct n-grams it holds; requests travel
   packed, sharded by a hash of the n-gram.
2. The n-grams asked for are joined, order by order, with their counts, their contexts' totals and the next lower
   order's probabilities, all sharded by n-gram. A context has 256 successors at most, so no key is hot.
3. The answers go back to the blocks that asked, where each text's n-grams are looked up and summed.

Several models are computed side by side: model 0 has all counts, model k those of all folds but the k-th, so that
texts the counts were taken from can be scored as if they hadn't been seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_view, materialize, release, row_slices, string_column

#: The order, and the byte that stands before a text (none that occurs in UTF-8).
ORDER, START = 5, 0xFF
SYMBOLS = 256
#: Rows of a block, bytes of text looked at together, distinct n-grams held before they are sent.
BLOCK_ROWS, SLICE, HELD = 1 << 13, 1 << 20, 2 << 20
#: Bytes of text for a shard of n-grams, and the fewest and most shards; bytes of text scored in a task.
SHARD_BYTES, SHARDS, TASK_BYTES = 64 << 20, (64, 4096), 16 << 20
#: Bytes of text that travel together.
BUNDLE = 4 << 20
#: Blocks that are dealt out in turn, by a broadcast table of 12 bytes each; more are spread well enough by a hash.
NUMBERED = 1_000_000


def codes_of(flat: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The n-gram that ends at each byte of flat[ends[0]:ends[-1]] as an int64, with START before a row's first.

    `before` has the bytes before the first row where that goes on from an earlier slice.
    """
    rows, pad, data = len(ends) - 1, ORDER - 1, flat[ends[0] : ends[-1]]
    padded = np.full(len(data) + rows * pad, START, np.uint8)
    at = np.arange(len(data)) + np.repeat((np.arange(rows) + 1) * pad, np.diff(ends))
    padded[at] = data
    if before is not None and len(before):
        padded[pad - len(before) : pad] = before
    code = np.zeros(len(data), np.int64)
    for k in range(pad, -1, -1):
        code = (code << 8) | padded[at - k]
    return code


def _slices(flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, codes) of slices; a row longer than a slice comes in several, each with the bytes before it."""
    for low, high in row_slices(ends, SLICE):
        if ends[high] - ends[low] <= SLICE:
            yield low, ends[low : high + 1], codes_of(flat, ends[low : high + 1])
        else:
            for a in range(int(ends[low]), int(ends[high]), SLICE):
                part = np.asarray([a, min(a + SLICE, int(ends[high]))])
                yield low, part, codes_of(flat, part, flat[max(int(ends[low]), a - ORDER + 1) : a])


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that agree in all columns."""
    n = len(columns[0])
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return zip(at.tolist(), [*at[1:].tolist(), n])


def _packed(codes: np.ndarray) -> bytes:
    return zlib.compress(np.diff(codes, prepend=0).astype("<i8").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i8"))


def _shard(codes: np.ndarray, shards: int) -> np.ndarray:
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def ngram_counts(texts: DataFrame, groups: list[str]) -> DataFrame:
    """Rows (code, *groups): counts of n-grams over the rows of (g, text) by g, the position in `groups`; added up within a task first."""

    def sent(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys >> 8), pa.array((keys & 255).astype(np.int32)), pa.array(counts)], names=["code", "g", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            group = batch.column(0).to_numpy()
            for low, ends, codes in _slices(*byte_view(string_column(batch, "text"))):
                new, n = np.unique(codes << 8 | np.repeat(group[low : low + len(ends) - 1], np.diff(ends)), return_counts=True)
                keys, at = np.unique(np.concatenate((keys, new)), return_inverse=True)
                counts = np.bincount(at, np.concatenate((counts, n)), len(keys)).astype(np.int64)
                if len(keys) > HELD:
                    yield sent(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield sent(keys, counts)

    found = texts.select(F.col("g").cast("int").alias("g"), "text").mapInArrow(run, "code bigint, g int, c bigint")
    return found.groupBy("code").agg(*[F.sum(F.when(F.col("g") == k, F.col("c")).otherwise(0)).alias(name) for k, name in enumerate(groups)])


def held_out(counts: DataFrame, folds: list[str]) -> DataFrame:
    """Rows (code, m0, m1, ...): all folds' counts together, then without the first, without the second, and so on."""
    total = sum((F.col(f) for f in folds[1:]), F.col(folds[0]))
    return counts.select("code", total.alias("m0"), *[(total - F.col(f)).alias(f"m{k + 1}") for k, f in enumerate(folds)])


def _suffix(order: int) -> Column:
    return F.col("code").bitwiseAND((1 << (8 * order)) - 1)


def probabilities(counts: DataFrame, wanted: DataFrame, lower: Callable[[str], Column], smoothing: Callable[[DataFrame, list[str]], dict[str, tuple[Column, Column, Column]]]) -> DataFrame:
    """Rows (code, *models): of each wanted n-gram, the probability of its last byte after the others; written.

    `counts` has a column of counts for each model. `lower(model)` makes the next lower order's counts from the rows
    that share a suffix. `smoothing` gives by model what a count keeps, the sum of a context's counts that it is
    divided by, and the context's share for the lower order. A context never seen leaves everything to that.
    """
    models = counts.columns[1:]
    tables, asked = {ORDER: materialize(counts, "counts5")}, {ORDER: materialize(wanted.select("code").distinct(), "asked5")}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = materialize(tables[order + 1].groupBy(_suffix(order).alias("code")).agg(*[lower(m).alias(m) for m in models]), f"counts{order}")
        asked[order] = materialize(asked[order + 1].select(_suffix(order).alias("code")).distinct(), f"asked{order}")
    below, before = None, None
    for order in range(1, ORDER + 1):
        table = tables[order]
        parts = smoothing(table, models)
        context = F.shiftright("code", 8)
        totals = table.groupBy(context.alias("context")).agg(*[f for m in models for f in (parts[m][1].alias(f"total_{m}"), parts[m][2].alias(f"share_{m}"))])
        rows = asked[order].join(table.select("code", *[parts[m][0].alias(f"kept_{m}") for m in models]), "code", "left").withColumn("context", context).join(totals, "context", "left")
        rows = rows.withColumn("suffix", _suffix(order - 1)).join(below, "suffix") if order > 1 else rows.withColumns({f"below_{m}": F.lit(1.0 / SYMBOLS) for m in models})
        p = {m: F.when(F.col(f"total_{m}") > 0, F.coalesce(f"kept_{m}", F.lit(0.0)) / F.col(f"total_{m}") + F.col(f"share_{m}") * F.col(f"below_{m}")).otherwise(F.col(f"below_{m}")) for m in models}
        found = materialize(rows.select("code", *[p[m].alias(m) for m in models]), f"p{order}")
        below = found.select(F.col("code").alias("suffix"), *[F.col(m).alias(f"below_{m}") for m in models])
        release(table, asked[order], before)
        before = found
    return found


def in_blocks(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """`docs` with the block of each row, which stays the same whatever tasks read the files; and what was written for it."""
    written = None
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:  # not a plain scan of Parquet files
        docs = written = materialize(docs, "blocks")
    block = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BLOCK_ROWS))
    return docs.select(block.alias("block"), *docs.columns), written


def _requests(rows: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, block, model, codes): the distinct n-grams of each block, packed."""

    def sent(held: dict[tuple[int, int], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for (block, model), parts in held.items():
            codes = np.unique(np.concatenate(parts))
            if not len(codes):
                continue
            shard = _shard(codes, shards)
            order = np.argsort(shard, kind="stable")
            names, at = np.unique(shard[order], return_index=True)
            packed = [_packed(c) for c in np.split(codes[order], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), block)), pa.array(np.full(len(names), model, np.int32)), pa.array(packed, pa.binary())], names=["shard", "block", "model", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            blocks, models = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(blocks, kind="stable")
            blocks, models, column = blocks[order], models[order], string_column(batch, "text").take(pa.array(order))
            for low, high in _runs(blocks):
                parts = held.setdefault((int(blocks[low]), int(models[low])), [])
                for _, _, codes in _slices(*byte_view(column.slice(low, high - low))):
                    parts.append(np.unique(codes))
                    if len(parts) > 8:
                        parts[:] = [np.unique(np.concatenate(parts))]
            if sum(len(x) for parts in held.values() for x in parts) > HELD:
                yield from sent(held)
                held = {}
        yield from sent(held)

    return rows.select("block", "model", "text").mapInArrow(run, "shard int, block bigint, model int, codes binary")


def _distinct(requests: DataFrame, parts: int) -> DataFrame:
    """Rows (code): the n-grams that any block asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != shard or len(held) > 64:
                    held = [np.unique(np.concatenate(held))] if held else []
                    if name != shard and held:
                        yield pa.RecordBatch.from_arrays([pa.array(held.pop())], names=["code"])
                    shard = name
                held.append(_unpacked(data.as_py()))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["code"])

    return requests.select("shard", "codes").repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(run, "code bigint")


def _answers(requests: DataFrame, found: DataFrame, shards: int, parts: int) -> DataFrame:
    """Rows (block, codes, logs): each request with its model's value of each n-gram."""
    name = F.pandas_udf(lambda codes: codes.__class__(_shard(codes.to_numpy(), shards)), "int")
    models = found.columns[1:]
    nothing = lambda t: F.lit(None).cast(t)
    table = found.select(name("code").alias("shard"), nothing("bigint").alias("block"), F.lit(0).alias("model"), nothing("binary").alias("codes"), "code", *[F.col(m).cast("float").alias(m) for m in models])
    asked = requests.select("shard", "block", "model", "codes", nothing("bigint").alias("code"), *[nothing("float").alias(m) for m in models])
    both = table.unionByName(asked).repartition(parts, "shard").sortWithinPartitions("shard", F.asc_nulls_first("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, codes, logs = None, [], []
        for batch in batches:
            names, packed = batch.column(0).to_numpy(), batch.column(3)
            for low, high in _runs(names, packed.is_null().to_numpy(zero_copy_only=False)):
                if names[low] != shard:
                    shard, codes, logs = names[low], [], []
                if not packed[low].is_valid:
                    codes.append(batch.column(4).slice(low, high - low).to_numpy())
                    logs.append(np.stack([batch.column(5 + k).slice(low, high - low).to_numpy() for k in range(len(models))]))
                    continue
                if len(codes) != 1 or not np.all(codes[0][1:] > codes[0][:-1]):
                    whole, values = np.concatenate(codes), np.concatenate(logs, axis=1)
                    order = np.argsort(whole)
                    codes, logs = [whole[order]], [values[:, order]]
                which = batch.column(2).slice(low, high - low).to_numpy()
                part = packed.slice(low, high - low)
                values = [logs[0][m][np.searchsorted(codes[0], _unpacked(p.as_py()))].astype("<f4").tobytes() for m, p in zip(which, part)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, high - low), part, pa.array(values, pa.binary())], names=["block", "codes", "logs"])

    return both.mapInArrow(run, "block bigint, codes binary, logs binary")


def _bundles(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (block, bundle): the texts and kept columns of a block's rows of a batch, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            batch, names, packed = batch.take(pa.array(order)), [], []
            for low, high in _runs(batch.column(0).to_numpy()):
                part = batch.slice(low, high - low)
                for a, b in row_slices(byte_view(string_column(part, "text"))[1], BUNDLE):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(part.slice(a, b - a))
                    names.append(batch.column(0)[low].as_py())
                    packed.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], names=["block", "bundle"])

    return rows.select("block", "text", *keep).mapInArrow(run, "block bigint, bundle binary")


def _scored(rows: DataFrame, keep: list[str], answers: DataFrame, parts: int) -> DataFrame:
    """Rows (*keep, n, ll): bytes and the sum of the values of every row's n-grams, which meets its block's answers.

    A task has whole blocks, one after the other. Up to NUMBERED blocks are dealt out in turn.
    """
    blocks = answers.select("block").distinct()
    few = blocks.count() <= NUMBERED
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keep}
    nothing = F.lit(None).cast("binary")
    both = answers.select("block", "codes", "logs", nothing.alias("bundle")).unionByName(_bundles(rows, keep).select("block", nothing.alias("codes"), nothing.alias("logs"), "bundle"))
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")
    if few:
        numbers = blocks.select("block", ((F.row_number().over(Window.orderBy("block")) - 1) % parts).alias("number"))
        both, part = both.join(F.broadcast(numbers), "block", "left"), F.coalesce("number", part)
    both = both.repartitionById(parts, part).sortWithinPartitions("block", F.col("codes").isNull()).select("block", "codes", "logs", "bundle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, codes, logs = None, [], []
        for batch in batches:
            for name, asked, values, bundle in zip(*(batch.column(k) for k in range(4))):
                if name != block:
                    block, codes, logs = name, [], []
                if asked.is_valid:
                    codes.append(_unpacked(asked.as_py()))
                    logs.append(np.frombuffer(values.as_py(), "<f4"))
                    continue
                if len(codes) > 1:
                    whole, flat = np.concatenate(codes), np.concatenate(logs)
                    order = np.argsort(whole)
                    codes, logs = [whole[order]], [flat[order]]
                for part in pa.ipc.open_stream(bundle.as_buffer()):
                    flat, ends = byte_view(string_column(part, "text"))
                    sums = np.zeros(part.num_rows)
                    for first, offsets, found in _slices(flat, ends):
                        if len(found):
                            filled = np.flatnonzero(np.diff(offsets))
                            sums[first + filled] += np.add.reduceat(logs[0][np.searchsorted(codes[0], found)], (offsets[:-1] - offsets[0])[filled], dtype=np.float64)
                    yield pa.RecordBatch.from_arrays([*[part.column(2 + k) for k in range(len(keep))], pa.array(np.diff(ends)), pa.array(sums)], names=[*keep, "n", "ll"])

    return both.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in kinds.items()], "n bigint, ll double"]))


def score_rows(rows: DataFrame, keep: list[str], values: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (*keep, n, ll) of all `rows` (block, model, text, *keep): bytes, and the sum of the n-grams' values; written.

    `values` gets the n-grams asked for, as rows (code), and returns rows (code, one value for each model), made from a
    written table whose place it carries on.
    """
    rows = rows.withColumn("block", F.xxhash64("block", "model"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(SHARDS[1], max(SHARDS[0], size // SHARD_BYTES))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    requests = materialize(_requests(rows, shards), "requests")
    found = values(_distinct(requests, min(shards, max(width, 8))))
    answers = materialize(_answers(requests, found, shards, min(shards, max(width, 8))), "answers")
    release(requests, found)
    out = materialize(_scored(rows, keep, answers, max(width, size // TASK_BYTES)), "likelihoods")
    release(answers)
    return out
