"""The whole removal of repeated passages against a plain model, and how much of planted passages it takes."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_passages(text):
    """(start, end) in characters, by the rule over the text's chunks: forwards from each chunk, backwards from each line's end."""
    chunks, out = list(line_dedup.chunks_of(text)), set()
    size = lambda a, b: len(text[a:b].encode())
    for k, (start, _, _) in enumerate(chunks):
        words = 0
        for _, end, n in chunks[k:]:
            words += n
            if words >= line_dedup.LEAST_WORDS and size(start, end) >= line_dedup.LEAST_BYTES:
                out.add((start, end))
                break
    last = [k for k, (_, end, _) in enumerate(chunks) if k + 1 == len(chunks) or "\n" in text[chunks[k][0] : end]]
    for k in last:
        words = 0
        for start, _, n in reversed(chunks[: k + 1]):
            words += n
            if words >= line_dedup.LEAST_WORDS and size(start, chunks[k][1]) >= line_dedup.LEAST_BYTES:
                out.add((start, chunks[k][1]))
                break
    return out


def plain_removal(rows, rids):
    """{(doc_id, text): text that is left}: of each passage's places the first stays, others go unless they overlap it."""
    places = collections.defaultdict(list)
    for doc, text in set(rows):
        for a, b in plain_passages(text or ""):
            places[text[a:b].rstrip(" \t\n\x0b\x0c\r")].append((doc is not None, doc or 0, rids[text], a, b, text))
    gone = collections.defaultdict(set)
    for found in places.values():
        first = min(found)
        for place in found:
            same = place[:3] == first[:3]
            if not (same and first[4] > place[3]):
                gone[place[:3], place[5]] |= set(range(place[3], place[4]))
    return {(doc, text): "".join(c for k, c in enumerate(text) if k not in gone[(doc is not None, doc or 0, rids[text]), text]) if text else text for doc, text in set(rows)}


def words(rng, n):
    return [rng.choice(["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))), "日本", "x1"]) for _ in range(n)]


def some_texts(seed):
    rng = random.Random(seed)
    shared = [" ".join(words(rng, rng.randint(8, 70))) for _ in range(12)]
    out = []
    for _ in range(70):
        parts = [" ".join(words(rng, rng.randint(0, 30))) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(1, 6))]
        out.append(rng.choice(["", "  ", "\n"]) + "".join(p + rng.choice([" ", "\n", "\n\n", "  \n "]) for p in parts))
    return out + [None, "", " \n", shared[0], shared[0], "short repeated line", "short repeated line"]


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_the_plain_model(spark, seed):
    rng, texts = random.Random(seed), some_texts(seed)
    rows = [(k if rng.random() < 0.95 else None, t) for k, t in enumerate(texts)]
    rows += rows[:3]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)
    rids = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    wanted = plain_removal(rows, rids)
    got = collections.Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs.repartition(5)).collect())
    assert got == collections.Counter((d, wanted[d, t]) for d, t in rows)


def test_nearly_all_words_of_long_repeats_go(spark):
    rng = random.Random(9)
    passages = [" ".join(words(rng, 60)) for _ in range(20)]
    table, planted = [], 0
    for k in range(200):
        inside = " ".join(words(rng, rng.randint(5, 40))) + rng.choice([" ", ". ", "\n"]) + passages[k % 20] + rng.choice([" ", ".\n"]) + " ".join(words(rng, rng.randint(5, 40)))
        table.append((k, inside, "en", "s", 0))
        planted += 60 * (k >= 20)
    before = sum(len(t.split()) for _, t, *_ in table)
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(table, DOCS)).collect()}
    taken = before - sum(len(t.split()) for t in left.values())
    assert 0.9 * planted <= taken <= planted
    clean = [(k, " ".join(words(np_rng, 80)), "en", "s", 0) for k, np_rng in enumerate(map(random.Random, range(100, 130)))]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(clean, DOCS)).collect()} == {k: t for k, t, *_ in clean}


def test_bytes_of_ranges():
    data = np.frombuffer("ab cd  \n ef".encode(), np.uint8)
    assert line_dedup._bytes_of(data, np.array([0, 3, 9]), np.array([3, 8, 11])).to_pylist() == [b"ab", b"cd", b"ef"]
    assert line_dedup._bytes_of(data, np.zeros(0, np.int64), np.zeros(0, np.int64)).to_pylist() == []


def test_a_repeated_word_of_many_kilobytes(spark):
    giant = " ".join([*[f"v{k}" for k in range(60)], "x" * 200_000, *[f"w{k}" for k in range(60)]])
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame([(1, giant, "en", "s", 0), (2, giant, "en", "s", 0), (3, "other " + giant, "en", "s", 0)], DOCS)).collect()}
    assert left[1] == giant and not left[2].strip() and len(left[3]) < 200
