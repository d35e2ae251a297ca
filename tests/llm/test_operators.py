"""Every operator against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm import decontamination, fingerprints, jaccard_join, language_id, line_dedup, ngrams, packing, quality, registry, sharding, shingles, token_counts, toxicity  # noqa: E402
from tessera.llm.bpe import ByteEncoder, UnitCounter, stretches  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
AWKWARD = [None, "", " ", "\n", "Ab", "Über  die\tBrücke\r\n\r\n", "日本語　テスト\n次", "x y", "a" * 3000, "it's <|endoftext|>  odd <|startoftext|>", "12 34,5 $%&", "é combining"]


def rows(texts, start=0):
    return [(start + k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]


def frame(spark, texts, start=0):
    return spark.createDataFrame(rows(texts, start), DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(120)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:8]] + texts[:5] + AWKWARD
    return texts


# Decontamination -------------------------------------------------------------------------------------------


def brute_leaks(texts, items, size=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    fold = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = fold(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    out = []
    for t in texts:
        w, hit, found = fold(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_leaks_match_brute_force(spark, corpus, block):
    items = [(k, " ".join(t.split()[3:18])) for k, t in enumerate(corpus[:9])] + [(20, "Ab!"), (21, "ab"), (22, None), (23, ""), (9, corpus[0]), (9, corpus[0])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.leak_report(frame(spark, corpus), bench, block_bytes=block).orderBy("doc_id").collect()
    wanted = brute_leaks(corpus, items)
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == wanted
    kept = {r.doc_id for r in decontamination.drop_leaks(frame(spark, corpus), bench, block_bytes=block).collect()}
    assert kept == {k for k, w in enumerate(wanted) if not w[4]}


def test_leaks_keep_clashing_columns_and_long_texts(spark, corpus):
    bench = spark.createDataFrame([(1, corpus[0]), (2, corpus[1]), (3, corpus[2])], "item_id bigint, text string")
    docs = frame(spark, corpus + [" ".join(corpus[5:40] * 8) + " " + corpus[0]]).withColumns({n: packing.F.lit("x") for n in ("leak", "row", "at", "ranges", "__leak")})
    docs = docs.unionAll(docs.limit(3))
    for block in (1 << 20, 100):
        kept = decontamination.drop_leaks(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns
        wanted = brute_leaks([r.text for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
        assert kept.count() == sum(not w[4] for w in wanted)


def test_leaks_of_empty_tables(spark, corpus):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.leak_report(frame(spark, corpus), empty).filter("contaminated").count() == 0
    assert decontamination.leak_report(frame(spark, []), empty).count() == 0


# Fingerprints ----------------------------------------------------------------------------------------------


def test_fingerprints_are_homomorphic_and_order_free():
    text = b"one paragraph here, long enough\nanother one that is longer still\n\nthird"
    whole = fingerprints.Fingerprint.of(text)
    shuffled = fingerprints.Fingerprint.of(b"third\n\nanother one that is longer still\none paragraph here, long enough")
    assert whole.hex() == shuffled.hex()
    grown = whole.inserted(b"a new paragraph")
    assert grown.hex() == fingerprints.Fingerprint.of(text + b"\na new paragraph").hex() != whole.hex()
    assert grown.deleted(b"a new paragraph").hex() == whole.hex()
    assert fingerprints.Fingerprint.from_hex(whole.hex()).likeness(whole) == 1.0


def test_sketch_of_slices_equals_the_whole(monkeypatch):
    text = bytes(random.Random(1).choices(b"abc def\n", k=5000))
    whole = fingerprints.Fingerprint.of(text).hex()
    monkeypatch.setattr(fingerprints, "_SLICE", 256)
    assert fingerprints.Fingerprint.of(text).hex() == whole


def test_likeness_follows_shared_text():
    rng = random.Random(2)
    a = bytes(rng.choices(b"abcdefghij ", k=4000))
    b = a[:2000] + bytes(rng.choices(b"abcdefghij ", k=2000))
    c = bytes(rng.choices(b"abcdefghij ", k=4000))
    f = fingerprints.Fingerprint.of
    assert 0.3 < f(a).likeness(f(b)) < 0.7 and f(a).likeness(f(c)) < 0.25


@pytest.mark.parametrize("target", [1 << 30, 200])
def test_edits_match_brute_force(spark, corpus, target):
    got = {r.doc_id: r for r in fingerprints.fingerprints_with_edits(frame(spark, corpus), target_bytes=target).collect()}
    n = len(corpus)
    assert len(got) == n
    for k, text in enumerate(corpus):
        text, following = text or "", corpus[k - 1 if k else n - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[k]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == fingerprints.Fingerprint.of(text.encode()).hex() and row.edited_fingerprint == fingerprints.Fingerprint.of(edited.encode()).hex()
        assert 0 <= row.near_edited <= 1 and row.near_next == pytest.approx(fingerprints.Fingerprint.of(text.encode()).likeness(fingerprints.Fingerprint.of(following.encode())))


@pytest.mark.parametrize("size", [20_000, 70_000, 200_000])
def test_likeness_of_long_repetitive_texts(size):
    f = fingerprints.Fingerprint.of
    assert f(b"a" * size).likeness(f(b"a" * (size // 2) + b"b" * (size // 2))) == pytest.approx(0.667, abs=0.01)
    long = fingerprints.Fingerprint.from_hex(f(b"a" * size).hex())
    assert long.likeness(f(b"a" * (size // 2))) == f(b"a" * size).likeness(f(b"a" * (size // 2)))


def brute_fingerprint(text):
    """Sums over paragraphs of their digests and of their windows' signs, one by one."""
    identity, sketch = [0] * fingerprints.IDENTITY, [0] * fingerprints.SKETCH
    m, width = [int(x) for x in fingerprints._MULTIPLIERS], fingerprints.WINDOW
    for p in text.split(b"\n"):
        digest = hashlib.blake2b(p, digest_size=8 * fingerprints.IDENTITY).digest()
        identity = [(x + int.from_bytes(digest[8 * k : 8 * k + 8], "little")) % 2**64 for k, x in enumerate(identity)]
        for at in range(max(1, len(p) - width + 1)):
            hashes = [(b + 1) * m[4] % 2**64 for b in p[at : at + width]]
            if len(p) < width:
                h = len(p) * m[5] % 2**64
                for x in hashes:
                    h = (h * m[0] + x) % 2**64
            else:
                for k in range(4):  # pairs, pairs of pairs, and so on
                    hashes = [(a * m[k] + b) % 2**64 for a, b in zip(hashes[::2], hashes[1::2])]
                h = hashes[0]
            h = (h ^ h >> 31) * m[6] % 2**64
            h = (h ^ h >> 29) * m[7] % 2**64
            lane = (h ^ h >> 32) >> 40 & 2 * fingerprints.SKETCH - 1
            sketch[lane % fingerprints.SKETCH] += 1 if lane < fingerprints.SKETCH else -1
    return b"".join(x.to_bytes(8, "little") for x in identity).hex() + b"".join((x % 2**32).to_bytes(4, "little") for x in sketch).hex()


def test_fingerprints_match_brute_force(spark, corpus):
    texts = [(t or "").encode() for t in corpus] + [b"line of some length\n" * 9 + b"x", b"\n\n"]
    assert [fingerprints.Fingerprint.of(t).hex() for t in texts] == [brute_fingerprint(t) for t in texts]


def test_edits_of_text_ids_nulls_repeats_and_clashes(spark):
    table = [("b", "bb bb", 1), ("a", "aaaa", 2), (None, "null one", 3), (None, "null two", 4), ("c", "cccc", 5), ("c", "cc cc", 6), ("d", None, 7)] + [(f"k{k:03}", f"text {k} " * 9, k) for k in range(200)]
    docs = spark.createDataFrame(table, "doc_id string, text string, part int")
    order = sorted(((i, t or "") for i, t, _ in table if i), key=lambda r: r[1])
    order = sorted(order, key=lambda r: r[0], reverse=True) + [(None, "null one"), (None, "null two")]
    for target in (1 << 30, 100):
        got = fingerprints.fingerprints_with_edits(docs, target_bytes=target).collect()
        wanted = []
        for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
            wanted.append((i or "", len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()))
        assert sorted((r.doc_id or "", r.n_chars, r.edited_sha256) for r in got) == sorted(wanted)


def test_edits_of_one_row_and_none(spark):
    assert fingerprints.fingerprints_with_edits(frame(spark, [])).count() == 0
    row = fingerprints.fingerprints_with_edits(frame(spark, ["abcd"])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


# Tokens and packing ----------------------------------------------------------------------------------------


SEAMS = ["ab", " ", "  ", "<|endoftext|>", "<|startoft", "ext|>", "1", "'s", "é", "日本", "\n", "!!", "İ", "\u0308", "\u3000", "\xa0", "\x1c", "\u200b", "x"]


def odd_texts(seed, n):
    rng = random.Random(seed)
    for k in range(n):
        text = "".join(rng.choices(SEAMS, k=rng.randint(50, 400)))
        yield text + "q" * rng.randint(50, 900) + " " + text if k % 5 == 0 else text


def test_encoders_do_as_the_library_does(corpus, monkeypatch):
    byte, plain = (ByteEncoder(public_tokenizers.path(registry.BYTE_BPE), ranks) for ranks in (public_tokenizers.path(registry.BYTE_RANKS), None))
    texts = [t or "" for t in corpus] + list(odd_texts(1, 200))
    wanted = [plain.library.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (1 << 18, 30):
        monkeypatch.setattr("tessera.llm.bpe.stretches", lambda t, m=most: stretches(t, m))
        assert [byte.encode(t).tolist() for t in texts] == wanted == [plain.encode(t).tolist() for t in texts]
    for memory in (400_000, 40, 0):
        counter = UnitCounter(public_tokenizers.path(registry.WORD_BPE), memory)
        assert counter.count_many(texts) == [counter.whole(t) for t in texts] == counter.count_many(texts)


def test_token_counts_of_short_and_spliced_texts(spark, corpus):
    path = public_tokenizers.path(registry.WORD_BPE)
    whole = UnitCounter(path).whole
    texts = [*corpus, " ".join(t or "" for t in corpus[:40]), "a\xa0b\u3000c " * 900]
    docs = frame(spark, texts).unionAll(frame(spark, texts[:1]))
    for chunk in (16_000, 100):
        got = token_counts.token_counts(docs.withColumn("n_tokens", packing.F.lit("clash")), path, limit=50, chunk=chunk, overlap=30).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            text = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), whole(text), whole(text) > 50)
    assert token_counts.token_counts(frame(spark, []), path).count() == 0


def test_resynchronisation_splices_and_widens(corpus):
    library = UnitCounter(public_tokenizers.path(registry.WORD_BPE)).library
    huge = [" ".join(t or "" for t in corpus), "q" * 4000 + " end " + "word " * 500, "abcdefgh" * 600, *odd_texts(2, 300)]
    for chunk, overlap in ((100, 40), (333, 60), (1000, 400), (60, 5)):
        own = token_counts.Resynchroniser(library, chunk, overlap)
        assert [own.count(t) for t in huge] == [len(library.encode(t, add_special_tokens=False)) for t in huge]
        assert own.splices > 5 and own.widenings > 5


def test_best_fit_places_everything_once():
    sizes = np.asarray(random.Random(3).choices(range(1, 101), k=400))
    bins, at, fills = packing.best_fit(sizes, 100)
    assert fills.max() <= 100 and fills.sum() == sizes.sum() and len(fills) <= 1.15 * np.ceil(sizes.sum() / 100)
    for b in range(len(fills)):
        inside = sorted(zip(at[bins == b], sizes[bins == b]))
        assert inside[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(inside, inside[1:]))


def test_packing_round_trip(spark, corpus):
    path = public_tokenizers.path(registry.BYTE_BPE)
    library, capacity = ByteEncoder(path).library, 64
    docs = frame(spark, corpus).withColumn("fill", packing.F.lit("clash")).repartition(5)
    got = packing.pack_documents(docs, path, capacity=capacity).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    total = 0
    for k, t in enumerate(corpus):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        pieces = sorted(by_doc[k], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and all(p.length == capacity for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[p.start : p.start + p.length], "<u4").tobytes())
        assert sum(p.length for p in pieces) == len(ids)
    for places in by_sequence.values():
        places.sort()
        assert places[0][0] == 0 and sum(n for _, n in places) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    assert len(by_sequence) <= 1.1 * -(-total // capacity)
    repeated = frame(spark, ["one text"] * 3 + [None, ""]).withColumn("doc_id", packing.F.lit(None).cast("bigint"))
    assert sorted(r.length for r in packing.pack_documents(repeated, path).collect()) == [1, 1, 3, 3, 3]
    assert packing.pack_documents(frame(spark, []), path).count() == 0


# Line dedup ------------------------------------------------------------------------------------------------


def passage(seed, sentences=8):
    rng = random.Random(seed)
    return " ".join(" ".join("".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(8)).capitalize() + "." for _ in range(sentences))


def test_chunks_cover_texts():
    for text in [passage(1), passage(2).replace(". ", ".\n"), "a\n\n\nb", "", "x" * 500, "\n"]:
        chunks = list(line_dedup.chunks_of(text))
        assert all(a < b for a, b, _ in chunks) and all(x[1] <= y[0] for x, y in zip(chunks, chunks[1:]))
        assert "".join(text[a:b] for a, b, _ in chunks).split() == text.split()


def test_repeated_passages_are_removed_once(spark):
    shared, lines = passage(7), passage(8, 12).replace(". ", ".\n")
    texts = [f"{passage(k)}\n{shared}\n{passage(k + 50)}" for k in range(20, 26)] + [f"Head {k}.\n{lines}\nFoot {k}." for k in range(4)] + [passage(99), None, "", "short\nlines"]
    docs = frame(spark, texts)
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert [k for k in range(6) if shared in out[k]] == [0]
    assert all(passage(k + 20) in out[k] and passage(k + 70) in out[k] for k in range(6))
    assert out[6] == texts[6] and all(len(out[k]) < 0.5 * len(texts[k]) for k in (7, 8, 9))
    assert out[10] == texts[10] and out[11] is None and out[12] == "" and out[13] == "short\nlines"
    copies = frame(spark, [passage(5)] * 3)
    assert sorted((r.text or "").strip() == "" for r in line_dedup.dedup_lines(copies).collect()) == [False, True, True]
    same_row = docs.limit(1).unionAll(docs.limit(1))
    assert line_dedup.dedup_report(same_row).filter("repeats").count() == 0
    assert line_dedup.dedup_report(frame(spark, [])).count() == 0


def test_a_very_common_passage_is_dealt_out_and_columns_may_clash(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "OFTEN", 4)
    shared = passage(7)
    texts = [f"{passage(100 + k)}\n{shared}\n{passage(300 + k)}" for k in range(40)] + [(passage(500) + " ") * 3 + passage(501, 400)]
    docs = frame(spark, texts).withColumns({n: packing.F.lit(1) for n in ("__id", "__rid", "__r", "removed", "row", "hash", "hit", "start", "digest")})
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert [k for k in range(40) if shared in got[k]] == [0] and all(passage(100 + k) in got[k] and passage(300 + k) in got[k] for k in range(40))
    assert passage(501, 400) in got[40]


def test_passages_inside_lines_and_among_short_lines_are_found(spark):
    prose = lambda seed, n, stop=". ": stop.join(passage(seed + k, 1)[:-1] for k in range(n)) + stop.strip()
    han = lambda seed, n: "".join(map(chr, random.Random(seed).choices(range(0x4E00, 0x5E00), k=n)))
    cases = []
    for k in range(20):
        words = prose(10_000 + 50 * k, 7).split()[:50]  # 50 words, cut anywhere in sentences
        for body in (" ".join(words), " ".join(words).replace(".", ""), "\n".join(" ".join(words[i : i + 5]) for i in range(0, 50, 5)), "\n\n".join(" ".join(words[i : i + 7]) for i in range(0, 50, 7)), han(k, 80)):
            cases.append(body)
    texts = []
    for k, body in enumerate(cases):
        glue = "\n" if "\n" in body else "" if ord(body[0]) > 0x3000 else " "
        around = (lambda s: han(s, 60)) if not glue else (lambda s: prose(s, 6, ".\n" if glue == "\n" else ". "))
        texts += [around(100_000 + 40 * k + 10 * j) + glue + body + glue + around(500_000 + 40 * k + 10 * j) for j in range(2)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    for k, body in enumerate(cases):
        first, second, cut = out[2 * k], out[2 * k + 1], len(texts[2 * k + 1]) - len(out[2 * k + 1])
        assert first == texts[2 * k] and 0.24 * len(body) <= cut <= len(body) + 1
        assert second[:20] == texts[2 * k + 1][:20] and second[-20:] == texts[2 * k + 1][-20:]
        assert "\n" not in body or cut >= len(body)


# Language --------------------------------------------------------------------------------------------------


def test_gradient_matches_differences():
    model = language_id.ByteLanguageModel(["a", "b"], hidden=3)
    for p in model.parameters():
        p *= 2
    rng = np.random.default_rng(0)
    windows, mask, labels = rng.integers(97, 105, (5, 4)).astype(np.uint8), np.ones((5, 4), np.float32), rng.integers(0, 2, 4)
    mask[3:, 0] = 0
    _, grads = model.gradients(windows, mask, labels)
    for p, g in zip(model.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, eps = p[at], 1e-2
        p[at] = kept + eps
        up = model.gradients(windows, mask, labels)[0]
        p[at] = kept - eps
        down = model.gradients(windows, mask, labels)[0]
        p[at] = kept
        assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=0.05, abs=2e-4)


def test_pooled_probabilities_match_brute_force(monkeypatch):
    model = language_id.ByteLanguageModel(["a", "b", "c"], hidden=4)

    def brute(text):
        total = np.zeros(3)
        for at in range(0, len(text), language_id.WINDOW):
            window = text[at : at + language_id.WINDOW]
            padded, states = window.ljust(language_id.WINDOW), []
            for d, order in ((model.forward, range(len(padded))), (model.backward, reversed(range(len(padded))))):
                h, seen, n = np.zeros(4), {}, 4
                for t in order:
                    a = d.inputs[padded[t]].astype(float)
                    z, r = (1 / (1 + np.exp(-(a[k * n : k * n + n] + h @ d.gates[:, k * n : k * n + n]))) for k in (0, 1))
                    h = (1 - z) * h + z * np.tanh(a[2 * n :] + (r * h) @ d.candidate)
                    seen[t] = h
                states.append(seen)
            for t in range(len(window)):
                e = np.exp(np.concatenate([states[0][t], states[1][t]]) @ model.out + model.bias)
                total += e / e.sum()
        return total / max(1, len(text))

    texts = [b"", b"x", b"some words " * 3, bytes(random.Random(2).choices(range(1, 128), k=700)), b"y" * 48, b"z" * 97]
    wanted = [brute(t) for t in texts]
    for size in (1 << 18, 100):
        monkeypatch.setattr(language_id, "SLICE", size)
        got = language_id.scores_of(model, *shingles.byte_view(pa.array([t.decode() for t in texts], pa.large_string())))
        assert np.allclose(got, wanted, atol=1e-4)


def test_rows_are_drawn_whole_and_for_every_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ROWS_IN_ALL", 600)
    table = [(k, f"word{k} " * (4000 if k % 7 == 0 else 3), f"l{k % 300}", "s", 0) for k in range(1500)]
    sample = language_id.training_sample(spark.createDataFrame(table + table[:20], DOCS))
    assert len({l for l, _ in sample}) == len({f"l{k % 300}" for k in range(1500) if zlib.crc32(str(k).encode()) % 4 != 2}) and len(sample) <= 600
    assert max(len(t) for _, t in sample) > 20_000


def test_identified_rows_keep_clashing_columns(spark):
    table = [(i, t, l, "s", 0) for i, t, l in languages(1)] + [(900, None, "aa", "s", 0), (901, "12", "aa", "s", 0)]
    docs = spark.createDataFrame(table, DOCS).withColumns({n: packing.F.lit("x") for n in ("score", "row", "letter", "__lang")})
    kept = language_id.keep_identified(docs.unionAll(docs.limit(2)))
    assert kept.columns == docs.columns and kept.count() >= len(table) - 4 and not kept.filter("doc_id >= 900").count()
    assert language_id.keep_identified(docs.limit(0)).count() == 0


def languages(k):
    rng = random.Random(k)
    kinds = {"aa": ["the", "of", "ing", "was"], "bb": ["über", "sch", "nicht", "öl"]}
    return [(i, " ".join(rng.choice(kinds[l]) for _ in range(rng.randint(3, 40))), l) for i in range(160) for l in [rng.choice(["aa", "bb"])]]


def test_languages_are_learned_from_the_text(spark):
    table = [(i, t, l, "s", 0) for i, t, l in languages(1)] + [(900, None, "aa", "s", 0), (901, "", "aa", "s", 0), (902, "123 $$", "bb", "s", 0), (903, "der öl " * 9000, None, "s", 0)]
    got = {r.doc_id: r for r in language_id.language_report(spark.createDataFrame(table, DOCS)).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 for k, r in got.items())
    assert np.mean([got[i].lang_pred == l for i, _, l in languages(1) if got[i].held_out]) > 0.95
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "bb"
    assert language_id.language_report(frame(spark, [])).count() == 0
    nothing = spark.createDataFrame([(1, "text", None, "s", 4)], DOCS)
    assert language_id.language_report(nothing).first().lang_pred == "und"


# Sharding --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("copies", [2, 150, 2000])
def test_shards_are_even_whole_and_gapless(spark, corpus, copies):
    texts = [f"{t} {k}" for k in range(6) for t in corpus if t is not None] + [None, ""] + corpus[:20] * 3 + ["copy of one text"] * copies
    docs = frame(spark, texts).withColumns({"lang": packing.F.when(packing.F.col("doc_id") % 3 > 0, "en"), "node": packing.F.lit(1), "key": packing.F.lit("k")})
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t) and r.law == "bytes" and r.grown_shard is None
    load, slots, homes, weight = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[texts[r.doc_id] or ""].add(r.shard)
        weight[texts[r.doc_id] or ""] += r.size
    assert set(load) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(load.values()) / 16
    assert max(load.values()) - min(load.values()) <= 0.1 * share + 2 * max(r.size for r in got if weight[texts[r.doc_id] or ""] <= share / 32)
    assert all(len(h) == 1 for t, h in homes.items() if weight[t] <= share)
    plain = docs.select("doc_id", "text").unionAll(docs.select("doc_id", "text").limit(2))
    assert sharding.shard_documents(plain).count() == len(texts) + 2
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_tree_matches_brute_force(spark):
    rng = random.Random(8)
    points = [(k, rng.randrange(1 << 24), rng.randrange(1 << 24), [rng.choice([5, 9, rng.randrange(1 << 20)]), rng.randrange(1 << 23)], rng.randint(1, 90)) for k in range(300)]
    room = [5.0, 1.0, 2.0, 2.0, 4.0]
    table = spark.createDataFrame(points, "id int, content bigint, own bigint, at array<bigint>, size bigint")
    got = {r.id: r.leaf for r in sharding.tree_leaves(table, room).collect()}

    def split(some, first, leaves):
        if leaves == 1:
            return {p[0]: first for p in some}
        extent = [max(p[3][d] for p in some) - min(p[3][d] for p in some) for d in (0, 1)]
        d = extent.index(max(extent))
        ordered, left = sorted(some, key=lambda p: (p[3][d], p[1], p[2])), leaves // 2
        wanted = sum(p[4] for p in some) * sum(room[first : first + left]) / sum(room[first : first + leaves])
        sums = [0, *np.cumsum([p[4] for p in ordered])]
        at = min(range(len(sums)), key=lambda k: (abs(sums[k] - wanted), -sums[k]))
        return split(ordered[:at], first, left) | split(ordered[at:], first + left, leaves - left)

    assert got == split(points, 0, 5)


def test_heavy_groups_are_placed_whole_where_they_fit():
    room = [10.0, 10.0, 10.0]
    assert sharding.placed_first([(1, 8), (2, 9), (3, 4)], room) == [[(1, 1.0)], [(0, 1.0)], [(2, 1.0)]] and room == [1.0, 2.0, 6.0]
    room = [10.0, 10.0, 10.0]
    assert [s for s, _ in sharding.placed_first([(1, 25)], room)[0]] == [0, 1, 2] and room == [0.0, 0.0, 5.0]


# Quality ---------------------------------------------------------------------------------------------------


def brute_kneser_ney(texts):
    order, grams = ngrams.ORDER, collections.Counter()
    for t in texts:
        s = [ngrams.START] * (order - 1) + list((t or "").encode())
        for k in range(order - 1, len(s)):
            grams[tuple(s[k - order + 1 : k + 1])] += 1
    tables = {order: grams}
    for n in range(order - 1, 0, -1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])

    def discount(n):
        of = collections.Counter(tables[n].values())
        n1, n2, n3, n4 = (of[k] for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            return 0.5, 0.75, 0.9
        y = n1 / (n1 + 2 * n2)
        return min(max(1 - 2 * y * n2 / n1, 0.05), 0.95), min(max(2 - 3 * y * n3 / n2, 0.1), 1.9), min(max(3 - 4 * y * n4 / n3, 0.1), 2.9)

    discounts = {n: discount(n) for n in tables}

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / ngrams.SYMBOLS
        rest = [c for g, c in tables[n].items() if g[:-1] == gram[:-1]]
        if not rest:
            return p(gram[1:])
        d = lambda c: min(discounts[n][min(c, 3) - 1], c)
        c = tables[n].get(gram, 0)
        return (c - d(c) if c else 0) / sum(rest) + sum(map(d, rest)) / sum(rest) * p(gram[1:])

    return p


KN_TEXTS = ["abab abba baab cabab", "the cat sat. The cat ran", "abra cadabra abra über", ""]


def test_kneser_ney_matches_brute_force(spark):
    grams = [b"abab ", bytes([255] * 4) + b"a", b"abaX.", b"zzzzz", b"the c", b"xx\xc3\xbc!", *[b"abab" + bytes([k]) for k in range(256)]]
    wanted = spark.createDataFrame([(int.from_bytes(g, "big"),) for g in grams], "code bigint")
    counts = ngrams.ngram_counts(frame(spark, KN_TEXTS).selectExpr("0 AS g", "text"), ["m0"])
    got = {r.code: r.m0 for r in quality.kneser_ney(counts, wanted).collect()}
    p = brute_kneser_ney(KN_TEXTS)
    assert all(got[int.from_bytes(g, "big")] == pytest.approx(p(tuple(g)), rel=1e-9) for g in grams)
    assert sum(got[int.from_bytes(b"abab" + bytes([k]), "big")] for k in range(256)) == pytest.approx(1)


def thresholds(trusted):
    """By language, and for one without trusted documents: (language, bits) of each trusted document."""
    by = collections.defaultdict(list)
    for lang, bits in trusted:
        by[lang].append(bits)
    top = lambda x: sorted(x)[max(0, int(np.ceil(quality.QUANTILE * len(x))) - 1)]
    mean = {lang: sum(x) / len(x) for lang, x in by.items()}
    spread = top([bits - mean[lang] for lang, bits in trusted])
    own = {lang: 2 ** ((len(x) * top(x) + quality.SHRUNK * (mean[lang] + spread)) / (len(x) + quality.SHRUNK)) for lang, x in by.items()}
    return own, 2 ** top([bits for _, bits in trusted])


def test_perplexities_and_thresholds_match_brute_force(spark, monkeypatch):
    texts = [*KN_TEXTS, "abab the cat", "QX!! $$", None, "über alles abra" * 30, "the cat ran. abra"]
    langs = ["en", "en", "de", "de", "en", None, "fr", "de", "en"]
    table = [(k, t, l, "s", 0) for k, (t, l) in enumerate(zip(texts, langs))] + [(2, texts[2], "de", "s", 0)]
    known = {0, 1, 2, 3, 8}
    labels = spark.createDataFrame([(k, 1, 0) for k in known] + [(1, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(table, DOCS).withColumns({n: packing.F.lit(1) for n in ("block", "code", "n", "ll", "own", "model", "trusted_id", "docs")})
    fold = {r.doc_id: r.fold for r in docs.select("doc_id", packing.F.expr(f"pmod(xxhash64(text), {quality.FOLDS})").alias("fold")).collect()}
    model = lambda k: fold[k] if k in known else None
    trusted = [(k, t, l) for k, t, l, *_ in table if k in known]
    models = {f: brute_kneser_ney([t for k, t, _ in trusted if fold[k] != f]) for f in [None, *range(quality.FOLDS)]}

    def ll(k, t):
        s, p = bytes([ngrams.START] * (ngrams.ORDER - 1)) + (t or "").encode(), models[model(k)]
        return sum(np.log2(p(tuple(s[k - ngrams.ORDER + 1 : k + 1]))) for k in range(ngrams.ORDER - 1, len(s)))

    size = lambda t: len((t or "").encode())
    mean = sum(ll(k, t) for k, t, _ in trusted) / sum(size(t) for _, t, _ in trusted)
    bits = {k: -(ll(k, t) + quality.PRIOR * mean) / (size(t) + quality.PRIOR) for k, t, *_ in table}
    limit, overall = thresholds([(l, bits[k]) for k, _, l in trusted])
    monkeypatch.setattr(ngrams, "BLOCK_ROWS", 2)
    for piece in (1 << 20, 7):
        monkeypatch.setattr(ngrams, "SLICE", piece)
        got = quality.quality_report(docs, labels).collect()
        assert len(got) == len(table)
        for r in got:
            assert r.perplexity == pytest.approx(2 ** bits[r.doc_id], rel=1e-4)
            assert r.threshold == pytest.approx(limit.get(r.lang, overall), rel=1e-4) and r.keep == (r.perplexity <= r.threshold)


def test_quality_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.quality_report(frame(spark, []), labels).count() == 0


def test_quality_keeps_clean_text(spark):
    good = [passage(k, 4) for k in range(80)]
    bad = ["$$%% ##&& " * 30, "QX!! ZZ!! " * 30]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(80)] + [(80, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_report(frame(spark, [*good, *bad, None, ""]), labels).collect()}
    assert sum(got[k].keep for k in range(80)) >= 79 and not got[80].keep and not got[81].keep and got[82].keep and got[83].keep
    none = labels.filter("quality > 1")
    assert all(r.keep for r in quality.quality_report(frame(spark, good[:3]), none).collect())


def test_a_rare_language_has_its_own_quantile(spark):
    rare = [" ".join(w[::-1].upper() for w in passage(300 + k, 4).split()) for k in range(5)]
    table = [(k, passage(k, 4), "en", "s", 0) for k in range(60)] + [(100 + k, t, "xx", "s", 0) for k, t in enumerate(rare)] + [(200, passage(200, 4), "yy", "s", 0)]
    labels = spark.createDataFrame([(k, 1, 0) for k in [*range(60), *range(100, 105)]], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(table, DOCS), labels).collect()}
    trusted = [("en", np.log2(got[k].perplexity)) for k in range(60)] + [("xx", np.log2(got[k].perplexity)) for k in range(100, 105)]
    limit, overall = thresholds(trusted)
    assert got[100].threshold == pytest.approx(limit["xx"]) and got[0].threshold == pytest.approx(limit["en"]) and got[200].threshold == pytest.approx(overall)


def test_unseen_good_text_stays_like_trusted_text(spark):
    good = [passage(k, 6) for k in range(300)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 300, 2)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in quality.quality_report(frame(spark, good), labels).filter("keep").collect()}
    assert sum(k % 2 for k in kept) >= 145 and len(kept) - sum(k % 2 for k in kept) >= 145


# Jaccard join ----------------------------------------------------------------------------------------------


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def edited_family(seed, copies, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9999)}" for _ in range(80)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(words))
            words[k : k + rng.randint(0, 1)] = [f"n{rng.randrange(10**6)}"] * rng.randint(0, 1)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, corpus, size, percent):
    chain = [" ".join(f"c{k}" for k in range(s, s + 100)) for s in range(0, 40, 2)]
    texts = corpus + edited_family(1, 40, 5) + edited_family(2, 25, 3) + chain + ["The THE the", "the the THE", "a b", "A B"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_classes(frame(spark, texts), size, percent).collect()}
    assert [got[k] for k in range(len(texts))] == brute_components(texts, size, percent)
    kept = {r.doc_id for r in jaccard_join.near_duplicates(frame(spark, texts), size, percent).collect()}
    assert kept == {k for k, (_, c) in got.items() if k == c}


def test_many_near_but_unlinked_sets_make_few_pairs(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(500):  # each loses or changes so much of the base that hardly any two are linked
        words, at = list(base), rng.randrange(70)
        if k % 2:
            words[at : at + 14] = [f"n{k}x{j}" for j in range(14)]
        else:
            words[at : at + rng.randint(14, 30)] = []
        texts.append(" ".join(words))
    tried, count = [], jaccard_join.verified

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return count(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    got = {r.doc_id: r.component_id for r in jaccard_join.link_classes(frame(spark, texts), 5, 80).collect()}
    assert [got[k] for k in range(500)] == [c for _, c in brute_components(texts, 5, 80)]
    assert sum(tried) < 500 * 499 / 2 / 4


def test_repeated_rows_and_clashing_columns(spark):
    table = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "q", "x"), (None, "q", "y"), (2, None, "x"), (2, None, "y"), (3, "a b c d e f", "z"), (4, "", "z"), (5, "", "z")]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, component_id string")
    kept = sorted((r.doc_id or 0, r.text) for r in jaccard_join.near_duplicates(docs).collect() if r.text is not None)
    assert kept == [(0, "q"), (1, "a b c d e f"), (4, ""), (5, "")]


def test_join_of_empty_and_null_ids(spark):
    assert jaccard_join.link_classes(frame(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a b c d", None), (3, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 2)], "doc_id bigint, text string, id int")
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard_join.link_classes(odd).collect() if r.doc_id) == [(3, 3), (5, 3), (5, 3)]


def test_shingle_hashes_do_not_depend_on_slices(monkeypatch, corpus):
    column = pa.array([t or "" for t in corpus], pa.large_string())
    whole = [s.tolist() for s in shingles.shingle_sets(column, 3)]
    monkeypatch.setattr(shingles, "SLICE", 100)
    assert [s.tolist() for s in shingles.shingle_sets(column, 3)] == whole


# Toxicity --------------------------------------------------------------------------------------------------


def toxic_corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    out = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["wombatface", "muckraker", "dunderhead"])
        out.append((k, " ".join(text) + ".", toxic))
    return out


def test_toxicity_on_held_out_and_gapped_insults(spark):
    data = toxic_corpus(4, 600)
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t, _ in data] + [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "plain words " * 4000 + "you wombatface. " + "more words " * 30000, "en", "s", 0)], DOCS)
    labels = spark.createDataFrame([(k, 1, int(x)) for k, _, x in data] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[k].predicted, int(x)) for k, _, x in data if got[k].held_out]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _, _ in data)
    assert np.mean([a == b for a, b in held]) > 0.95
    assert got[9000].predicted == 0 and got[9001].predicted == 0 and got[9002].predicted == 1
    model = toxicity.fit([t for _, t, _ in data], [int(x) for _, _, x in data])
    flat, ends = shingles.byte_view(pa.array(["hello m.u.c.k.r.a.k.e.r there", "hello muckxraker there", "hello m u c k r a k e r there", "a plain sentence of words"], pa.large_string()))
    scores = model.scores(model.margins(flat, ends))
    assert scores[0] > 0.5 and scores[2] > 0.5 and scores[1] > scores[3]


def brute_kernel(a, b):
    def triples(w):
        out = collections.Counter()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + toxicity.REACH + 1)):
                for k in range(j + 1, min(len(w), j + toxicity.REACH + 1)):
                    out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = triples(a), triples(b)
    return sum(v * y[t] for t, v in x.items())


def letters(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return toxicity.letters_of(data, np.asarray([0, len(data)]))


def test_string_kernel_matches_brute_force_and_the_map_its_matrix():
    stems = ["wombatface", "muckraker", "dunder", "table", "anana"]
    model = toxicity.StringKernelSVM.with_landmarks([letters(w).symbol for w in stems])
    gram = np.asarray([[brute_kernel(a, b) for b in stems] for a in stems]) ** toxicity.POWER
    assert np.allclose(model.kernel(letters(". ".join(stems))) ** toxicity.POWER, gram, rtol=1e-4)
    mapped = model.features(letters(". ".join(stems)))
    assert np.allclose(mapped @ mapped.T, gram, atol=2e-3 * np.trace(gram) / len(stems))
    sentence = "a womb xatface, ananas mxuckraker able. other"
    words = ["a", "womb", "xatface", "ananas", "mxuckraker", "able"]
    assert np.allclose(model.kernel(letters(sentence))[0], [max(brute_kernel(w, s) for w in words) for s in stems], rtol=1e-4)


def test_toxicity_of_long_texts_does_not_depend_on_slices(monkeypatch):
    rng = random.Random(9)
    words = ["wombatface", "muck", "raker", "i", "d", "o", "table", "ananas", "bxle.", "x!", "n.", "\n", "...", "-", "é"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\t", ""]) for _ in range(rng.randint(1, 400))) for _ in range(60)] + ["muckraker" * 40, "a b " * 200, "", ". " * 90]
    model = toxicity.StringKernelSVM.with_landmarks([letters(w).symbol for w in ("wombatface", "muckraker", "table", "idioto")])
    model.slope, model.bias = np.asarray([0.5, 0.3, -0.4, 0.2]), -0.7
    column = shingles.byte_view(pa.array(texts, pa.large_string()))
    whole = model.margins(*column)
    for size in (16, 60, 300):
        monkeypatch.setattr(toxicity, "SLICE", size)
        monkeypatch.setattr(toxicity, "WORDS", 7)
        assert np.allclose(model.margins(*column), whole)


def test_training_takes_rows_of_any_length_and_stays_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 5)
    monkeypatch.setattr(toxicity, "CLEAN_ROWS", 7)
    table = [(k, "long words " * 4000 if k % 2 else "short", None, None, 0) for k in range(60)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(90)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(table + table, DOCS).withColumn("toxic", packing.F.lit(9))
    texts, y = toxicity.training_sample(docs.dropDuplicates(["doc_id"]), labels)
    assert len(y) == 12 and sum(y) == 5 and max(map(len, texts)) == 44_000
    report = toxicity.toxicity_report(docs, labels)
    assert report.count() == 120 and report.select("doc_id", "score").distinct().count() == 60


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity_report(frame(spark, ["a", None]), none).agg({"predicted": "max"}).first()[0] == 0


# Pipeline --------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    table = [(i, t + " " + passage(i, 5), l, f"s{i % 4}", 0) for i, t, l in languages(2)]
    shared = passage(777)
    table += [(400 + k, f"{passage(800 + k)}\n{shared}", "aa", "s", 0) for k in range(4)]
    near = " ".join(f"w{k}" for k in range(9))  # too short a passage to be taken out before
    table += [(500, near, "aa", "s", 0), (501, near.upper(), "aa", "s", 0), (600, None, None, None, None), (601, "12 34", "aa", "s", 0)]
    table += [(700, passage(991), "aa", "s", 0)]
    spark.createDataFrame(table, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage(991, 3)), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "packing" or docs.columns == columns
    assert not {600, 601} & ids["language_id"] and len(ids["language_id"]) >= len(table) - 4
    assert {501, 500} & ids["jaccard_join"] == {500} and 700 not in ids["decontamination"]
    assert ids["packing"] == ids["decontamination"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_of_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    table = [(i, t + " " + passage(i, 5), l, f"s{i % 4}", 0) for i, t, l in languages(2)[:60]]
    table += table[:3] + [(None, passage(9000), "aa", None, None)] * 2 + [(901, None, "aa", None, None), (902, "", None, "s", 0), (903, " \n", "bb", "s", 0)]
    docs = spark.createDataFrame(table, DOCS).withColumns({n: packing.F.lit("x") for n in ("row", "score", "removed", "leak", "id", "token", "__gone", "fill", "bin")})
    for name, frame_of in (("some", docs), ("none", docs.limit(0))):
        frame_of.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, None), (None, "a b")], "item_id bigint, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        kept = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage, function in corpus_pipeline.STAGES[:-1]:
            function(spark, kept, str(tmp_path / name)).write.parquet(str(tmp_path / name / stage))
            kept = spark.read.parquet(str(tmp_path / name / stage))
            assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.collect()]
        assert len(ids) == len(set(ids)) and (len(ids) == 61 if name == "some" else not ids)
        assert corpus_pipeline.run(spark, str(tmp_path / name)).select("doc_id").distinct().count() == len(ids)
