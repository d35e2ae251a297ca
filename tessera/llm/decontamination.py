"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of benchmark words, grouped by length. For each length a shift table over blocks of
two words tells how far the search may jump; where it may not, the block's bucket of patterns is compared
word by word. Patterns come in blocks of bounded size: one pass over the documents per block, each with its
own tables, and the passes' hits are put together per document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import materialize, sized, string_column

#: Bytes of benchmark text whose tables one pass holds in each worker.
BLOCK_BYTES = 4 << 20
LEAK = StructType([StructField("n_words", LongType()), StructField("ranges", ArrayType(StructType([StructField("from", IntegerType()), StructField("to", IntegerType())]))), StructField("items", ArrayType(StringType()))])
#: A-Z to lower case; what is no word byte to a space.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """All windows of `size` words; a shorter text is one window, an empty one none."""
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


class WuManber:
    """Search for many word sequences of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.bucket.setdefault(pattern[length - self.block :], {}).setdefault(pattern[0], []).append((pattern, owners))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, owners) of every occurrence."""
        length, block, default, shift = self.length, self.block, self.default, self.shift
        at, n = length, len(words)
        while at <= n:
            key = tuple(words[at - block : at])
            jump = shift.get(key, default)
            if jump:
                at += jump
                continue
            start = at - length
            for pattern, owners in self.bucket[key].get(words[start], ()):  # the suffix chose the bucket, the first word the list
                if tuple(words[start:at]) == pattern:
                    yield start, owners
            at += 1


def build(items: Iterable[tuple[int, bytes]], size: int) -> list[WuManber]:
    """One searcher per pattern length, the owners of a pattern as positions in `items`."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for owner, text in items:
        for window in windows_of(words_of(text), size):
            by_length.setdefault(len(window), {}).setdefault(window, []).append(owner)
    return [WuManber(patterns, length) for length, patterns in sorted(by_length.items())]


def covered(starts: list[int], lengths: list[int]) -> list[tuple[int, int]]:
    """Disjoint [from, to) ranges of hit words."""
    ranges: list[list[int]] = []
    for start, length in sorted(zip(starts, lengths)):
        if ranges and start <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], start + length)
        else:
            ranges.append([start, start + length])
    return [(a, b) for a, b in ranges]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Benchmark items in blocks of bounded size; one block is on the driver at a time."""
    items = benchmark.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-int(total) // limit)
    for part in range(parts):
        block = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part) if parts > 1 else items
        yield [(r.i, r.t.encode()) for r in block.toLocalIterator()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (row, leak): each row of `docs` as a struct, and struct(n_words, ranges array<struct<from,to>> of hit words, items array<string>).

    Null texts have no words. Items with a null id or text are not searched for, repeated items count once. Repeated
    documents give repeated rows, an empty table none; no column name of `docs` clashes. The documents pass through
    map-only for one block of items. For several, the first pass is written with a number per row; the others yield the
    rows with hits alone, which are put together and joined to it.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    docs = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))

    def pass_over(rows: DataFrame, items: list[tuple[str, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)
        fields = StructType([*(f for f in rows.schema.fields if f.name != "text"), StructField("leak", LEAK)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searchers = None
            out_type = None
            for batch in batches:
                if searchers is None:
                    names = [i for i, _ in shared.value]
                    searchers = build(((k, t) for k, (_, t) in enumerate(shared.value)), size)
                    out_type = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), ("items", pa.list_(pa.string()))])
                leaks = []
                for text in string_column(batch, "text").cast(pa.large_binary()):
                    words = words_of(text.as_py())
                    starts, lengths, owners = [], [], set()
                    for searcher in searchers:
                        for start, who in searcher.search(words):
                            starts.append(start)
                            lengths.append(searcher.length)
                            owners.update(who)
                    ranges = covered(starts, lengths) if starts else ()
                    leaks.append({"n_words": len(words), "ranges": [{"from": a, "to": b} for a, b in ranges], "items": sorted({names[o] for o in owners})})
                kept = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(leaks, out_type)], names=[*kept, "leak"])

        return rows.mapInArrow(run, fields)

    first = next(blocks, [])
    later = next(blocks, None)
    if later is None:
        return pass_over(docs, first)
    base = materialize(pass_over(docs.withColumn("at", F.monotonically_increasing_id()), first), "leaks")
    narrow, block, hits = base.select("at", F.col(f"row.{text_col}").cast("string").alias("text")), later, None
    while block is not None:
        found = pass_over(narrow, block).filter(F.size("leak.items") > 0)
        hits = found if hits is None else hits.unionByName(found)
        block = next(blocks, None)
    more = sized(hits.groupBy("at").agg(F.flatten(F.collect_list("leak.ranges")).alias("r"), F.flatten(F.collect_list("leak.items")).alias("i")), "hits")
    joined = base.join(more, "at", "left").withColumn("ranges", F.array_sort(F.concat("leak.ranges", F.coalesce("r", F.array().cast(LEAK["ranges"].dataType)))))
    items = F.array_sort(F.array_distinct(F.concat("leak.items", F.coalesce("i", F.array().cast("array<string>")))))
    union = F.aggregate(
        "ranges",
        F.array().cast("array<struct<from:int,to:int>>"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (r["from"] <= F.element_at(done, -1)["to"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["from"].alias("from"), F.greatest(F.element_at(done, -1)["to"], r["to"]).alias("to")))),
        ).otherwise(F.concat(done, F.array(r))),
    )
    return joined.select("row", F.struct("leak.n_words", union.alias("ranges"), items.alias("items")).cast(LEAK).alias("leak"))


def leak_report(docs: DataFrame, benchmark: DataFrame, size: int = 10, **options) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, their digest, and whether any was hit."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, size, **options)
    n_hit = F.aggregate("leak.ranges", F.lit(0).cast("bigint"), lambda n, r: n + (r["to"] - r["from"]))
    return found.select(
        "row.doc_id",
        "leak.n_words",
        n_hit.alias("n_hit"),
        F.size("leak.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "leak.items"), 256).alias("items_sha256"),
        (F.size("leak.items") > 0).alias("contaminated"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, **options) -> DataFrame:
    """The documents in which no benchmark window occurs; null and empty texts stay."""
    return find_leaks(docs, benchmark, size, **options).filter(F.size("leak.items") == 0).select("row.*")
