"""N-gram Jaccard self-join by filtering under several global token orders.

Documents with the same shingle set form a class. Two classes can reach the similarity only if they share a
token among the first few (the prefix) of their sets under *every* global order of tokens. Order 1 puts
tokens that are frequent in the corpus last, so that its prefixes are rare tokens; it generates candidates.
Candidates that don't share a prefix token under orders 2 and 3 as well, or differ too much in size, are
dropped before the sets are compared.

What is asked for is which documents are linked, directly or through others. So inside a token's bucket not
all pairs are tried: first all members with the least one; then, after links have been closed into
components, members outside its component with the least of them; and in the end every remaining pair whose
members lie in different components. A pair within one component needs no check, so a bucket that holds a
large group of near copies costs about its size, and no link that joins two components is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import materialize, release, sized, string_column
from .line_dedup import filter_of, passes
from .shingles import mixed, shingle_sets

#: log2 of the slots of the frequency sketch (a byte each when broadcast), and its blocks.
SLOTS_LOG2, BLOCKS = 22, 64
#: Sketches that one task adds up; star rounds before remaining pairs are tried; partners of one left row in a task.
MERGE, STAR_ROUNDS, PARTNERS = 64, 2, 200
#: Size bands in which a size doubles, for the pairs that are left after the star rounds.
BANDS = 16
FACTS_OF_HEADS = ("own", "id", "n", "every", "end", "pos")


def least_overlap(n: int, percent: int) -> int:
    """The fewest tokens that a set of n shares with any set it reaches `percent` with."""
    return -(-n * percent // 100)


def token_frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """Rank of each sketch slot by how many documents have a token in it: a byte per slot, 2^SLOTS_LOG2 in all.

    Tasks add up sketches of their own documents; sketches are merged block by block in a tree. The table's
    size is fixed whatever the corpus. Any ranks give a valid global order, so the sketch costs no links.
    """
    slots = 1 << SLOTS_LOG2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint32)
        for batch in batches:
            for tokens in shingle_sets(string_column(batch, "text"), size):
                counts[(tokens >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)] += 1  # slots repeat too rarely to matter
        part = TaskContext.get().partitionId()
        data = [zlib.compress(np.minimum(b, 65535).astype("<u2").tobytes(), 1) for b in np.split(counts, BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([part] * BLOCKS, pa.int64()), pa.array(data, pa.binary())], names=["block", "part", "data"])

    def merge(key, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(slots // BLOCKS, np.uint64)
        for frame in frames:
            for data in frame["data"]:
                raw = np.frombuffer(zlib.decompress(data), "<u2" if wide_in == 2 else "<u4")
                total += raw
        yield pd.DataFrame({"block": [key[0]], "part": [key[1]], "data": [zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)]})

    sketch = docs.select(F.col("text")).mapInArrow(run, "block int, part bigint, data binary")
    sketch = materialize(sketch, "sketch")
    wide_in = 2
    while True:
        parts = sketch.agg(F.max("part")).first()[0]
        if wide_in == 4 and not parts:
            break
        grouped = sketch.withColumn("part", F.floor(F.col("part") / MERGE).cast("bigint")).groupBy("block", "part")
        merged = materialize(grouped.applyInPandas(_whole(merge), "block int, part bigint, data binary"), "sketch")
        release(sketch)
        sketch, wide_in = merged, 4
    ranks = np.zeros(slots, np.uint8)
    for row in sketch.collect():  # BLOCKS rows
        counts = np.frombuffer(zlib.decompress(row.data), "<u4").astype(np.float64)
        ranks[row.block * (slots // BLOCKS) : (row.block + 1) * (slots // BLOCKS)] = np.round(4 * np.log2(counts + 1))
    release(sketch)
    return ranks


def _whole(merge):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return next(merge(key, iter([frame])))

    return run


def describe_sets(docs: DataFrame, size: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """Rows (doc_id, n, sig, end, p1, p2, p3): set size, set digest, and prefixes under three orders; p1 in its order, up to end."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.astype(np.uint64)
        for batch in batches:
            sizes, sigs, ends, prefixes = [], [], [], ([], [], [])
            for tokens in shingle_sets(string_column(batch, "text"), size):
                n = len(tokens)
                sizes.append(n)
                sigs.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                keep = n - least_overlap(n, percent) + 1 if n else 0
                rank = table[(tokens >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)] << np.uint64(56)
                for k, out in enumerate(prefixes):
                    other = mixed(tokens, k + 2)
                    order = (rank | (other >> np.uint64(8))) if k < 2 else other
                    first = np.argpartition(order, keep - 1)[:keep] if 0 < keep < n else np.arange(keep)
                    if k == 0:
                        first = first[np.argsort(order[first])]
                        ends.append(int(order[first[-1]] >> np.uint64(1)) if keep else 0)
                    out.append(tokens[first].view(np.int64) if k == 0 else (other[first] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(ends, pa.int64()), pa.array(prefixes[0], pa.list_(pa.int64())), *(pa.array(p, pa.list_(pa.int32())) for p in prefixes[1:])],
                names=["doc_id", "n", "sig", "end", "p1", "p2", "p3"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, sig binary, end bigint, p1 array<bigint>, p2 array<int>, p3 array<int>")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """Pairs (a, b) with the tokens their sets have in common, and whether they reach the similarity.

    Each left text meets its partners in the stream of one task: texts of (a, salt) come first, then the
    partners' texts one by one, so that memory holds one set. A left row with many partners is salted.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("k"))
    salted = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / PARTNERS)).cast("int").alias("salt"))
    salted = materialize(salted, "pairs")
    left = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("id")).select("a", "salt", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "text")
    right = salted.join(texts, F.col("b") == F.col("id")).select("a", "salt", "b", "text")
    stream = left.unionByName(right).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            keys, partners = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), batch.column(2).to_pylist()
            a, b, shared, reached = [], [], [], []
            for at, partner, tokens in zip(keys, partners, shingle_sets(string_column(batch, "text"), size)):
                if at != key:
                    key, own = at, []
                if partner is None:
                    own.append(tokens)
                    continue
                counts = [(len(np.intersect1d(mine, tokens, assume_unique=True)), len(mine)) for mine in own]
                a.append(at[0])
                b.append(partner)
                shared.append(max((n for n, _ in counts), default=0))
                reached.append(any(100 * n >= percent * (m + len(tokens) - n) for n, m in counts))
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.column(0).type), pa.array(b, batch.column(2).type), pa.array(shared, pa.int64()), pa.array(reached, pa.bool_())], names=["a", "b", "common", "ok"])

    schema = StructType([*pairs.select("a", "b").schema.fields, StructField("common", LongType()), StructField("ok", BooleanType())])
    out = materialize(stream.mapInArrow(run, schema), "verified")
    release(salted)
    return out


def components(links: DataFrame) -> DataFrame:
    """Rows (id, comp) for every end of a link: the least id reachable.

    Least labels travel along links and labels are looked up in each other, so a chain halves per round.
    Only minima are aggregated, never lists, so a hub costs no memory.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, F.col("id") == F.col("a")).select("id", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("comp").alias("far"))
        new = materialize(lower.join(jump, "low", "left").select("id", F.least("low", "far").alias("comp"), (F.least("low", "far") != F.col("comp")).alias("moved")), "labels")
        release(labels)
        labels = new
        if not new.filter("moved").limit(1).count():
            release(both)
            return labels


def link_classes(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for every document.

    `docs` needs doc_id and text. Null or empty texts, and texts of white space, have no set and are linked
    with nothing. Equal sets are linked. Rows that repeat a doc_id count as one document; a null doc_id has a
    null component.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranks = token_frequencies(docs, size)
    described = materialize(describe_sets(docs, size, percent, ranks).withColumn("row", F.monotonically_increasing_id()), "sets")
    info = materialize(described.select("doc_id", "n", "sig"), "info")

    real = described.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # A class is found by its digest alone; only then are the prefixes of its least id taken.
    first = F.min(F.struct("doc_id", "row")).alias("f")
    least = sized(real.groupBy("sig").agg(first).select("f.row"), "least")
    classes = materialize(real.join(least, "row", "left_semi").select("sig", F.col("doc_id").alias("id"), "n", "end", "p1", "p2", "p3"), "classes")
    release(described, least)
    rows = classes.select("id", F.posexplode("p1").alias("pos", "token"))
    shared = materialize(rows.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1"), "shared")
    # A filter of fixed size keeps most other tokens from the join, which is exact.
    bits = spark.sparkContext.broadcast(filter_of(shared.select("token")))
    maybe = F.pandas_udf(lambda tokens: pd.Series(passes(bits.value, tokens.to_numpy(np.int64))), "boolean")
    rows = rows.filter(maybe("token"))
    # Most tokens have one class and are gone here. own: a class's tokens before this one that no other class
    # has in its prefix. Whoever has this token in its prefix lacks those: it would have them there as well.
    # every: the same over the whole prefix; whoever's prefix ends later in the order lacks all of those.
    by_place = Window.partitionBy("id").orderBy("pos")
    members = rows.join(shared, "token").withColumn("own", F.col("pos") - F.row_number().over(by_place) + 1)
    members = members.withColumn("others", F.count("*").over(Window.partitionBy("id")))
    sizes = classes.select("id", "n", "end", F.size("p1").alias("kept"))  # joined to the few rows left, not carried by all
    members = members.join(sizes, "id").withColumn("every", F.col("kept") - F.col("others")).drop("kept", "others")
    # The head of a bucket: the member with the fewest tokens of its own, most like an original.
    members = materialize(members, "members-alone")
    heads = members.groupBy("token").agg(F.min(F.struct(*FACTS_OF_HEADS)).alias("h"))
    buckets = materialize(members.join(heads, "token"), "members")
    release(members, shared)
    bits.destroy()
    members = buckets
    needed = sized(members.select("id").distinct(), "needed")
    texts = materialize(docs.join(needed, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts")
    prefixes = materialize(classes.join(needed, "id", "left_semi").select("id", "p2", "p3"), "prefixes")
    release(needed)
    written = [classes, members, texts, prefixes]

    facts = ["id", "n", "own", "every", "end", "pos"]

    def reach(a: str, b: str):
        """Whether two sets whose first shared token in the order is this one can be similar.

        Either lacks all of the other's tokens before it, and those behind it that no other class has.
        """
        (na, oa, va, ea, pa), (nb, ob, vb, eb, pb) = ([F.col(f"{x}{c}") for c in facts[1:]] for x in (a, b))
        oa, ob = pa + F.when(eb >= ea, va - oa).otherwise(0), pb + F.when(ea >= eb, vb - ob).otherwise(0)
        return F.least(na - oa, nb - ob) * 100 >= F.greatest(na + ob, nb + oa) * percent

    def candidates(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
        """Pairs not tried before that share prefix tokens under the other orders as well."""
        pairs = pairs.select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "tokens-shared")
        ends = sized(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ends")
        few = materialize(prefixes.join(ends, "id", "left_semi"), "prefixes-needed")  # prefixes are wide: only those of the pairs move
        passing.extend((pairs, ends, few))
        left, right = (few.select(F.col("id").alias(x), F.col("p2").alias(f"p2{x}"), F.col("p3").alias(f"p3{x}")) for x in "ab")
        joined = pairs.join(left, "a").join(right, "b")
        return joined.filter(F.arrays_overlap("p2a", "p2b") & F.arrays_overlap("p3a", "p3b")).select("a", "b")

    comps, known, tried = None, None, None
    passing: list[DataFrame] = []

    def labelled(frame: DataFrame) -> DataFrame:
        if comps is None:
            return frame.withColumn("c", F.col("id"))
        return frame.join(comps.select("id", "comp"), "id", "left").withColumn("c", F.coalesce("comp", "id")).drop("comp")

    def settle(pairs: DataFrame) -> bool:
        """Verifies candidates and closes links; False if there was none."""
        nonlocal comps, known, tried
        found = materialize(candidates(pairs, tried), "candidates")
        release(*passing)
        passing.clear()
        n = found.count()
        if not n:
            release(found)
            return False
        tried = found if tried is None else tried.unionByName(found)
        more = verified(found, texts, size, percent, max(width, n // 4000))
        known = more if known is None else known.unionByName(more)
        written.extend((found, more))
        release(comps)
        comps = components(known.filter("ok"))
        return True

    def labelled_heads(frame: DataFrame) -> DataFrame:
        """Members with their component and that of their bucket's head."""
        frame = labelled(frame)
        if comps is None:
            return frame.withColumn("hc", F.col("h.id"))
        return frame.join(comps.select(F.col("id").alias("hid"), F.col("comp").alias("hcomp")), F.col("h.id") == F.col("hid"), "left").withColumn("hc", F.coalesce("hcomp", "h.id")).drop("hid", "hcomp")

    def star(frame: DataFrame) -> DataFrame:
        near = labelled_heads(frame).filter((F.col("c") != F.col("hc")) & reach("", "h."))
        return near.select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b"))

    outside = members
    for step in range(STAR_ROUNDS):
        if not settle(star(outside)) or step == STAR_ROUNDS - 1:
            break
        # Members that the head's component has not taken in go on, with the least of them as head. A bucket of two is
        # settled by its one pair.
        out = materialize(labelled_heads(outside.filter("k > 2")).filter("c <> hc").select("token", "k", *facts), "outside-alone")
        outside = materialize(out.join(out.groupBy("token").agg(F.min(F.struct(*FACTS_OF_HEADS)).alias("h")), "token"), "outside")
        release(out)
        written.append(outside)
    # What is left: pairs across components in one bucket, each with one member outside its head's component.
    now = materialize(labelled_heads(members.filter("k > 2")), "labelled")
    written.append(now)
    if known is not None:
        # How much each member shares with its bucket's head is known by now, where that pair was compared. Two
        # members share at most what neither lost of the head, and of what they have besides only what isn't own.
        counted = known.groupBy("a", "b").agg(F.max("common").alias("common"))
        both = counted.unionByName(counted.select(F.col("b").alias("a"), F.col("a").alias("b"), "common")).withColumnsRenamed({"a": "head", "b": "one"})
        both = sized(both, "common")
        now = now.join(both, (F.col("h.id") == F.col("head")) & (F.col("id") == F.col("one")), "left").drop("head", "one")
        now = materialize(now.withColumn("common", F.when(F.col("id") == F.col("h.id"), F.col("n")).otherwise(F.col("common"))), "labelled")
        release(both)
        written.append(now)
    else:
        now = now.withColumn("common", F.lit(None).cast("bigint"))
    fields = (*facts, "c", "common")
    # Sizes that a member's partner can have, given the tokens before this one: partners are met by size band, so a
    # member whose own edits come first in the order never meets the mass of sets of its bucket that are as large as it.
    least, most = F.ceil(F.col("n") * percent / 100), F.floor((F.col("n") - F.col("pos")) * 100 / percent) - F.col("pos")
    band = lambda n: F.floor(F.log2(n) * BANDS).cast("int")
    now, apart = now.drop("h", "hc", "k"), now.filter("c <> hc").drop("h", "hc", "k")
    beyond = apart.filter(least <= most).withColumn("band", F.explode(F.sequence(band(least), band(most))))
    beyond = beyond.select("token", "band", *[F.col(c).alias(f"x_{c}") for c in fields])
    rest = lambda x: F.col(f"{x}n") - F.col(f"{x}common") - F.col(f"{x}own")
    shared_most = F.least("common", "x_common") + F.least(rest(""), rest("x_"))
    possible = shared_most.isNull() | (shared_most * 100 >= (F.col("n") + F.col("x_n") - shared_most) * percent)
    cross = beyond.join(now.withColumn("band", band(F.col("n"))), ["token", "band"]).filter((F.col("c") != F.col("x_c")) & reach("", "x_") & possible)
    settle(cross.select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")))

    named = classes.select("sig", F.col("id").alias("component"))
    if comps is not None:
        named = classes.select("sig", "id").join(comps.select("id", "comp"), "id", "left").select("sig", F.coalesce("comp", "id").alias("component"))
    named = materialize(named, "components")
    release(comps, *written)  # what is returned reads info and named alone
    out = info.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
    return out.join(named, "sig", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay when one of each linked group is kept: the one with the least id.

    Of rows that repeat a doc_id and its text one stays, whatever their other columns; rows that repeat a doc_id
    with other texts stay or go together. A null doc_id is compared with nothing but such repeated rows. Null and
    empty texts are linked with nothing.
    """
    gone = link_classes(docs, size, percent).filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("text").cast("binary")).alias("digest"))
    again = docs.groupBy(F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("binary")).alias("hash")).count().filter("count > 1").drop("count")
    left = rows.join(sized(gone, "gone"), F.col("row.doc_id") == F.col("gone"), "left_anti")
    again, same = sized(again, "again"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("hash"))
    one = left.join(again, same, "left_semi").select("row", "row.doc_id", "row.text").dropDuplicates(["doc_id", "text"])
    return left.join(again, same, "left_anti").select("row").unionByName(one.select("row")).select("row.*")
