"""Line dedup over content-defined passages.

A text is cut into words (a code point of a script written without spaces is one of its own). A chunk begins at
every line, and within a line at the words whose hash, taken with the word before, is the least of some WINDOW
words in a row (winnowing). So chunks have at most WINDOW words, and where they begin depends on the words near by
alone. A passage runs from where a chunk begins to the first chunk end at least LEAST_WORDS words and LEAST_BYTES
bytes on, or back from a line's end by as much. A repeated run of 4 * WINDOW - 2 words and one passage (19 words at
most where LEAST_BYTES doesn't lengthen it), so of 49, holds whole passages wherever it stands in a line; a
repeated line, or run of lines, is covered from end to end. Passages whose hashes repeat are candidates; they meet by
their bytes, whole. A passage that occurs more than once in the corpus is kept where it occurs first (by document id
and place) and removed wherever else its bytes are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_view, materialize, release, row_slices, sized, string_column

#: Words in a row of which one begins a chunk; the least words and bytes of a passage.
WINDOW, LEAST_WORDS, LEAST_BYTES = 8, 12, 60
#: Bits of a filter of hashes for each of them, and in all at most (32 MB, whatever the corpus); bits of a block of it.
BITS_EACH, FILTER_BITS, BLOCK_BITS, PROBES = 16, 1 << 28, 1 << 20, 3
BUCKETS = 1 << 12
#: A passage counted so often (at most twice a batch that has it less often) is common; of those the commonest, and the tasks their places go to.
OFTEN, MOST_COMMON, SALTS = 64, 100_000, 256
SLICE = 1 << 20
#: Passages of more bytes than this travel as their SHA-256; candidates that are sent together.
LONG_PASSAGE, SENT = 1 << 16, 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


BYTE_POWERS = _powers(0x9E3779B97F4A7C15, 1 << 10)
WORD_BASE = 0xD1342543DE82EF95
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTE_VALUES = np.where(SPACE, 0, _powers(0xBF58476D1CE4E5B9, 257)[1:])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin in the bytes of several texts, which begin at `offsets`."""
    opens = np.ones(len(data) + 4, bool)
    opens[1 : len(data)] = SPACE[data[:-1]]
    opens[offsets] = True
    at = np.flatnonzero(data >= 0xE0)
    if len(at):  # scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Han, wide forms
        a, b = data[at], data[np.minimum(at + 1, len(data) - 1)]
        alone = (a >= 0xE3) & (a <= 0xE9) | (a == 0xEF) | (a == 0xF0) & (b >= 0xA0) | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b == 0x9E) | (b == 0x9F))
        at, a = at[alone], a[alone]
        opens[at] = opens[at + np.where(a >= 0xF0, 4, 3)] = True
    return np.flatnonzero(opens[: len(data)] & ~SPACE[data])


def _cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(words' places, words' hashes, is it a line's first, first words of chunks, each text's first word)."""
    u = _word_starts(data, offsets[:-1])
    rows = np.searchsorted(u, offsets)
    if not len(u):
        return u, np.zeros(0, np.uint64), np.zeros(0, bool), u, rows
    place = np.arange(u[0], len(data)) - np.repeat(u, np.diff(u, append=len(data)))
    h = _mixed(np.add.reduceat(BYTE_VALUES[data[u[0] :]] * BYTE_POWERS[place & 1023], u - u[0]))
    first = np.zeros(len(u) + 1, bool)
    first[np.searchsorted(u, np.flatnonzero(data == 10))] = True
    first[rows] = True
    first = first[: len(u)]
    key = h.copy()
    key[1:] += h[:-1] * np.uint64(WORD_BASE)
    key = (_mixed(key) >> np.uint64(32) | np.uint64(1)) << np.uint64(32) | np.arange(len(u), dtype=np.uint64)
    key[first] = 0
    least = np.concatenate((key, np.zeros(WINDOW, np.uint64)))
    for s in (1, 2, 4):
        least[:-s] = np.minimum(least[:-s], least[s:])
    most = np.concatenate((np.zeros(WINDOW, np.uint64), least[: len(u)]))
    for s in (1, 2, 4):
        most[s:] = np.maximum(most[s:], most[:-s].copy())
    return u, h, first, np.flatnonzero(most[WINDOW:] == key), rows


def chunks_of(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, words) of each chunk, in order; white space belongs to the chunk before it."""
    data = np.frombuffer(text.encode(), np.uint8)
    u, _, _, cuts, _ = _cuts(data, np.asarray([0, len(data)]))
    chars = np.append(np.cumsum((data & 0xC0) != 0x80) - 1, len(text))
    for a, b in zip(cuts, np.append(cuts[1:], len(u))):
        yield int(chars[u[a]]), int(chars[u[b]] if b < len(u) else len(text)), int(b - a)


def _passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, end, hash) of each passage; places are in bytes of `data`."""
    u, h, first, cuts, rows = _cuts(data, offsets)
    if not len(u):
        return u, u, u, h
    n = len(u)
    where = np.append(u, len(data))
    stops = where.copy()  # where what ends before a word ends: at the next word, or with its text
    stops[rows[:0:-1]] = offsets[:0:-1]
    ends = np.append(cuts, n)
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    j = np.maximum(np.searchsorted(ends, cuts + LEAST_WORDS), np.searchsorted(stops[ends], where[cuts] + LEAST_BYTES))
    fits = j < len(ends)
    a, b = cuts[fits], ends[j[fits]]
    line_ends = np.append(np.flatnonzero(first)[1:], n)
    j = np.minimum(np.searchsorted(ends, line_ends - LEAST_WORDS, "right"), np.searchsorted(where[ends], stops[line_ends] - LEAST_BYTES, "right")) - 1
    a, b = np.concatenate((a, ends[j[j >= 0]])), np.concatenate((b, line_ends[j >= 0]))
    row = row_of[a]
    whole = b <= rows[row + 1]
    pairs = np.unique(a[whole] << 32 | b[whole])
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    row = row_of[a]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(WORD_BASE, n), dtype=np.uint64)))
    back = _powers(pow(WORD_BASE, -1, 1 << 64), n)
    return row, where[a], np.where(b == rows[row + 1], offsets[row + 1], where[b]), _mixed((sums[b] - sums[a]) * back[a]).view(np.int64)


def _probes(h: np.ndarray, size: int) -> list[np.ndarray]:
    h = h.view(np.uint64)
    return [_mixed(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size) for k in range(PROBES)]


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    some = np.ones(len(h), bool)
    for p in _probes(h, 8 * len(bits)):
        some &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return some


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    flat, ends = byte_view(column)
    for low, high in row_slices(ends, SLICE):
        yield low, flat[ends[low] : ends[high]], ends[low : high + 1] - ends[low]


def _repeated_hashes(rows: DataFrame) -> DataFrame:
    """Rows (hash, n): the passage hashes that occur more than once, and how often; of a batch two are counted, or OFTEN.

    Hashes travel packed, BUCKETS by their low bits.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_passages(data, offsets)[3] for _, data, offsets in _slices(string_column(batch, "text"))]
            found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
            # Twice says enough, but one that is common within a batch is common, however few batches there are.
            found = np.concatenate((found, found[n > 1], np.repeat(found[n >= OFTEN], OFTEN - 2)))
            bucket = found & (BUCKETS - 1)
            order = np.argsort(bucket, kind="stable")
            names, at = np.unique(bucket[order], return_index=True)
            packed = pa.array([x.tobytes() for x in np.split(found[order], at[1:])] if len(names) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), packed], names=["bucket", "hashes"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x.as_buffer(), np.int64) for batch in batches for x in batch.column(1)]
        found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found[n > 1]), pa.array(n[n > 1])], names=["hash", "n"])

    return rows.select("text").mapInArrow(pack, "bucket bigint, hashes binary").repartition("bucket").mapInArrow(repeated, "hash bigint, n bigint")


def filter_of(repeated: DataFrame) -> np.ndarray:
    """A Bloom filter over the repeated hashes, sized by their count up to FILTER_BITS; its blocks are put together in the cluster."""
    size = min(FILTER_BITS, max(BLOCK_BITS, 1 << (BITS_EACH * repeated.count()).bit_length()))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in _probes(batch.column(0).to_numpy().astype(np.int64), size):
                p = np.unique(p.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(p // BLOCK_BITS), pa.array((p % BLOCK_BITS).astype(np.int32))], names=["block", "bit"])

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BLOCK_BITS, bool)
        bits[frame["bit"].to_numpy()] = True
        return pd.DataFrame({"block": frame["block"].iloc[:1].to_numpy(), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    found = repeated.mapInArrow(positions, "block bigint, bit int").groupBy("block").applyInPandas(block, "block bigint, bits binary")
    out = np.zeros((size // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for r in found.toLocalIterator():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _bytes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of ranges that begin with a word, without the white space at their ends."""
    words = np.maximum.accumulate(np.where(SPACE[data], 0, np.arange(len(data))))
    size = words[end - 1] + 1 - start if len(end) else end
    if size.max(initial=0) > LONG_PASSAGE:  # a word of many kilobytes is in it
        whole = [data[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist())]
        return pa.array([b if len(b) <= LONG_PASSAGE else hashlib.sha256(b).digest() for b in whole], pa.binary())
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    taken = data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(taken))])


def _candidates(rows: DataFrame, shared) -> DataFrame:
    """A row per passage that passes the filter, with its bytes and whether its hash is a common one.

    start and end are in characters; `shared` is the broadcast filter with the common hashes in order.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, common = shared.value
        for batch in batches:
            for low, data, offsets in _slices(string_column(batch, "text")):
                found = _passages(data, offsets)
                some = passes(bits, found[3])
                chars = np.concatenate((np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)))
                for at in range(0, int(some.sum()), SENT):
                    row, start, end, h = (x[some][at : at + SENT] for x in found)
                    near = np.searchsorted(common, h)
                    known = common[np.minimum(near, len(common) - 1)] == h if len(common) else np.zeros(len(h), bool)
                    take, base = pa.array(row + low, pa.int64()), chars[offsets[row]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(chars[start] - base), pa.array(chars[end] - base), _bytes_of(data, start, end), pa.array(known)], names=["doc_id", "rid", "start", "end", "passage", "common"])

    return rows.mapInArrow(run, f"doc_id {kind}, rid bigint, start bigint, end bigint, passage binary, common boolean")


def _merged(removed: DataFrame) -> DataFrame:
    """Ranges that touch or overlap put together, text by text."""
    schema = removed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            start, end = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            order = np.lexsort((start, row))
            row, start, end = row[order], start[order], end[order]
            reach = np.maximum.accumulate(end + (row << 40)) - (row << 40)  # the furthest end so far, text by text
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(row)) - 1
            ranges = pa.StructArray.from_arrays([pa.array(start[at]), pa.array(reach[last])], names=["start", "end"])
            joined = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(len(lists) + 1)).astype(np.int32)), ranges)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), joined], names=["doc_id", "rid", "ranges"])

    return removed.mapInArrow(run, schema)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, rid, ranges): the character ranges to be removed from the texts that have any.

    rid is the text's hash; rows that repeat a doc_id with one text count as one document. A passage that
    overlaps the kept one in the same text stays.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("rid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    repeated = materialize(_repeated_hashes(rows), "repeated")
    often = repeated.filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "hash").limit(MOST_COMMON).select("hash").toPandas()["hash"].to_numpy(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((filter_of(repeated.select("hash")), np.sort(often)))
    candidates = materialize(_candidates(rows, shared), "passages")
    shared.destroy()
    release(repeated)
    # Places meet by their passage's bytes, and the first in order is the one kept. Those of a common passage are dealt over SALTS
    # tasks; the place that is kept of each comes from partial minima.
    place = F.struct("doc_id", "rid", "start", "end")
    first = sized(candidates.filter("common").groupBy("passage").agg(F.min(place).alias("least")), "kept")
    salt = F.when(F.col("least").isNotNull(), F.pmod(F.xxhash64("rid", "start"), F.lit(SALTS))).otherwise(0)
    marked = candidates.join(first, "passage", "left").withColumn("salt", salt)
    in_order = Window.partitionBy("passage", "salt").orderBy("doc_id", "rid", "start", "end").rowsBetween(Window.unboundedPreceding, 0)
    same = marked.withColumn("kept", F.coalesce("least", F.first(place).over(in_order)))
    at_kept = F.col("kept.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("kept.rid") == F.col("rid")) & (F.col("kept.end") > F.col("start"))
    removed = same.filter(~at_kept).groupBy("doc_id", "rid").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    out = materialize(_merged(removed), "ranges")
    release(candidates, first)
    return out


def _cut(docs: DataFrame) -> DataFrame:
    """Rows (row, removed): each row of `docs` as a struct, its text without repeated passages, and the removed ranges."""
    found = repeated_ranges(docs)
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(found.select(F.xxhash64("doc_id", "rid"))))
    # Only texts that may have ranges are joined; the filter lets none of these through to the others.
    hit = F.pandas_udf(lambda key: pd.Series(passes(bits.value, key.to_numpy(np.int64))), "boolean")
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("hash")).withColumn("hit", hit(F.xxhash64("row.doc_id", "hash")))
    ranges = found.select("doc_id", "rid", F.col("ranges").alias("removed"))
    joined = keyed.filter("hit").join(ranges, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("rid")), "left")
    # What lies between the removed ranges: from each range's end to the next one's start.
    old = F.col("row.text")
    froms = F.concat(F.array(F.lit(0).cast("bigint")), F.col("removed.end"))
    tos = F.concat(F.col("removed.start"), F.array(F.length(old).cast("bigint")))
    kept = F.zip_with(froms, tos, lambda a, b: F.substring(old, (a + 1).cast("int"), (b - a).cast("int")))
    text = F.when(F.col("removed").isNull(), old).otherwise(F.array_join(kept, ""))
    cut = joined.select(F.col("row").withField("text", text).alias("row"), "removed")
    return cut.unionByName(keyed.filter("NOT hit").select("row", F.lit(None).cast(cut.schema["removed"].dataType).alias("removed")))


def dedup_lines(docs: DataFrame, keep_emptied: bool = True) -> DataFrame:
    """`docs` with repeated passages removed from `text`; without keep_emptied, texts of which nothing is left go.

    Null and empty texts stay as they are; a text without repeats is not touched, however long. Ties between places go
    to the least (doc_id, text hash, place); a null doc_id sorts first. Rows that repeat a doc_id with one text count
    as one document and stay alike. An empty table gives no rows; no other column's name clashes.
    """
    out = _cut(docs)
    return (out if keep_emptied else out.filter(F.col("removed").isNull() | (F.trim("row.text") != ""))).select("row.*")


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per document: characters before, removed ranges and characters, and the text that is left."""
    out = _cut(docs.select("doc_id", "text", F.length("text").cast("bigint").alias("n_chars")))
    removed = F.coalesce(F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"]), F.lit(0).cast("bigint"))
    n_removed = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("bigint")
    return out.select("row.doc_id", "row.n_chars", n_removed.alias("n_removed"), removed.alias("chars_removed"), F.col("removed").isNotNull().alias("repeats"), "row.text")
