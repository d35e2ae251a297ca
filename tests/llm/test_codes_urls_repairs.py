"""Vector codes, the URL filter and conversation repair against brute force and SQL: nulls, ties, repeats, long and empty rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair as repair
from tessera.llm import ngrams, oracles, url_filter
from tessera.llm import vector_codes as codes

VECTORS = "vec_id bigint, embedding array<float>, label int"

# Vector codes ----------------------------------------------------------------------------------------------


def random_vectors(n, size, seed=1):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(12)]
    out = [(k, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(centers)], rng.choice([0, 1, 2, None])) for k in range(n)]
    return out + [(n + k, list(out[7][1]), 1) for k in range(30)]  # many copies of one vector


def brute_codes(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    v = np.floor(1024 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    parts = np.split(v, 4, axis=1)
    books = [p[:256].copy() for p in parts]

    def assigned():
        out = []
        for part, book in zip(parts, books):
            d = ((part[:, None] - book[None]) ** 2).sum(2)
            out.append((d.argmin(1), d.min(1)))
        return out

    for _ in range(4):
        for part, book, (best, _) in zip(parts, books, assigned()):
            for e in set(best.tolist()):
                book[e] = part[best == e].sum(0) // (best == e).sum()
    found = assigned()
    errors = sum(d for _, d in found).tolist()
    by_label = collections.Counter()
    for r, e in zip(rows, errors):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for row in b.tolist() for x in row).encode()).hexdigest()
    return sorted((r[0], "".join(f"{b[k]:02x}" for b, _ in found), e, by_label[r[2]], digest) for k, (r, e) in enumerate(zip(rows, errors)))


@pytest.mark.parametrize(("n", "size"), [(400, 16), (40, 8)])
def test_codes_match_brute_force_and_sql(spark, tmp_path, n, size):
    rows = random_vectors(n, size)
    odd = [(1000, None, 1), (1001, [1.0, None] * (size // 2), 1), (1002, [float("nan")] * size, 2), (1003, [float("inf")] * size, None)]
    frame = spark.createDataFrame(rows + odd, VECTORS)
    got = codes.vector_codes(frame.withColumns({c: F.lit("x") for c in ("v", "l", "code", "error")}))
    wanted = brute_codes(rows)
    assert sorted(map(tuple, got.collect())) == wanted
    frame.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert sorted((con.execute(oracles.CODES)).fetchall()) == wanted


def test_codes_of_awkward_tables(spark):
    assert codes.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    assert codes.vector_codes(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    (r,) = codes.vector_codes(spark.createDataFrame([(1, [], 1)], VECTORS)).collect()
    assert (r.code, r.error, r.label_error) == ("00000000", 0, 0)
    rows = codes.vector_codes(spark.createDataFrame([(None, [1.0] * 6, None), (3, [2.0] * 6, None), (3, [2.0] * 6, None), (4, [1.0] * 5, 1)], VECTORS)).collect()
    assert sorted((r.vec_id is None, r.code, r.error) for r in rows) == [(False, "00000000", 0), (False, "00000000", 0), (True, "02020202", 0)]
    huge = codes.vector_codes(spark.createDataFrame([(k, [3e38 * (-1) ** k] * 64, 0) for k in range(2)] + [(9, [0.5] * 64, 0)], VECTORS)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in huge) == [(0, "00000000", 0), (1, "01010101", 0), (9, "02020202", 0)]


def test_annulus_holds_the_nearest_entry_at_any_magnitude():
    rng = np.random.default_rng(3)
    for high, width in ((3, 2), (40, 16), (1 << 27, 8)):  # the last is beyond what doubles hold exactly
        book = rng.integers(-high, high, (200, width))
        book[50:60] = book[:10]
        parts = np.concatenate((rng.integers(-high, high, (300, width)), book[::7]))
        found, errors = codes.Codebook(book).nearest(parts)
        d = ((parts[:, None] - book[None]) ** 2).sum(2)
        assert (found == d.argmin(1)).all() and (errors == d.min(1)).all()


# URL filter ------------------------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"
TLDS = ["com", "net", "org"]


def some_urls(n=300, seed=2):
    rng = random.Random(seed)
    return [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'm.', 'Blog.'])}{rng.choice('abc') * 3}.Example.{rng.choice(TLDS)}/{rng.choice(['en', 'fr', 'de'])}/{rng.randrange(99)}{rng.choice(['', '?a=/b', '#top', '/'])}" for _ in range(n)]


def split_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_parts_and_rules(spark):
    urls = ["http://A.NET/x?y#z", "https://net", "http://net/", "ftp://x.example.net/en/1://q/e", "no scheme", "", None, "://h?p/", "http://EXAMPLE.org/fr/\nx", "http://É.org/fr/", "a\nb://notexample.net/en/", "http://example.com.net/de/", "x://h#/a", "http://example.com/de"]
    host, path = url_filter.url_parts(F.col("url"))
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host.alias("h"), path.alias("p"), *[c.alias(n) for c, n in zip(url_filter.rule_for(host, path), "rv")]).collect()
    for r in rows:
        assert (r.h, r.p) == split_url(r.url) and (r.r, r.v) == rule_of(r.h, r.p), r


def brute_ratio(accepted, rejected):
    """log2 P(url | accepted) - log2 P(url | rejected) under Witten-Bell models of order 5."""

    def model(urls):
        tables = [collections.Counter() for _ in range(6)]
        for u in urls:
            s = [ngrams.START] * 4 + list(u.encode())
            for k in range(4, len(s)):
                for n in range(1, 6):
                    tables[n][tuple(s[k - n + 1 : k + 1])] += 1

        after = [collections.defaultdict(dict) for _ in range(6)]
        for n in range(1, 6):
            for g, c in tables[n].items():
                after[n][g[:-1]][g[-1]] = c

        def p(gram):
            n = len(gram)
            if not n:
                return 1 / 256
            seen = after[n].get(gram[:-1])
            if not seen:
                return p(gram[1:])
            total, kinds = sum(seen.values()), len(seen)
            return (seen.get(gram[-1], 0) + kinds * p(gram[1:])) / (total + kinds)

        return p

    a, r = model(accepted), model(rejected)

    def score(url):
        s = [ngrams.START] * 4 + list((url or "").encode())
        grams = [tuple(s[k - 4 : k + 1]) for k in range(4, len(s))]
        return sum(math.log2(a(g) / r(g)) for g in grams) / len(grams) if grams else 0.0

    return score


def test_url_verdicts_match_brute_force(spark, monkeypatch):
    urls = [*some_urls(), None, "", "odd", "http://ünï.example.org/de/" + "x" * 300]
    frame = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)] + [(None, urls[0], "")], PAGES).withColumns({c: F.lit(1) for c in ("text", "model", "block", "score", "n")})
    monkeypatch.setattr(ngrams, "BLOCK_ROWS", 40)
    got = url_filter.url_verdicts(frame).collect()
    assert len(got) == len(urls) + 1 and {r.page_id for r in got} == {None, *range(len(urls))}
    ruled = {k: rule_of(*split_url(u)) for k, u in enumerate(urls)}
    of = lambda verdict: [u for k, u in enumerate(urls) if ruled[k][1] == verdict] + [urls[0]] * (ruled[0][1] == verdict)
    score = brute_ratio(of("allow"), of("block"))
    shift = {round(score(urls[r.page_id]) - r.score, 4) for r in got if r.page_id is not None and r.rule is None}
    assert len(shift) == 1  # the threshold
    for r in got:
        url = urls[r.page_id or 0]
        assert (r.host, r.path) == split_url(url) and r.rule == rule_of(r.host, r.path)[0]
        assert r.verdict == (rule_of(r.host, r.path)[1] or ("allow" if r.score >= 0 else "block"))
    known = [r for r in got if r.rule]  # each scored without its fold
    assert sum((r.score >= 0) == (r.verdict == "allow") for r in known) >= 0.95 * len(known)


def test_calibration(spark):
    rows = lambda a, r: spark.createDataFrame([(x, "allow") for x in a] + [(x, "block") for x in r], "score double, verdict string")
    assert url_filter.calibrated_threshold(rows([1.0], [])) is None
    assert url_filter.calibrated_threshold(rows([1.0, 2.0], [-1.0, -2.0])) == 0.0
    assert 1.5 < url_filter.calibrated_threshold(rows([1.75, 2.0, 99.0], [1.5, -99.0])) <= 1.75
    assert -2.0 < url_filter.calibrated_threshold(rows([-1.0] * 9 + [-9.0], [-2.0] * 9 + [5.0])) <= -1.0


def test_urls_without_rules_and_empty_tables(spark):
    assert url_filter.url_verdicts(spark.createDataFrame([], PAGES)).count() == 0
    rows = url_filter.url_verdicts(spark.createDataFrame([(1, None, ""), (2, "http://a.example.org/fr/1", ""), (3, "http://b.com/", "")], PAGES)).collect()
    assert sorted((r.page_id, r.rule, r.verdict, r.score) for r in rows) == [(1, None, "allow", None), (2, "org/fr/", "allow", None), (3, None, "allow", None)]


# Conversation repair ---------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute_repair(rows):
    """Every way to every role state, turn by turn, without a heuristic."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, *[" " if x is None else x for x in r[2:]]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else "-")
        seen.add((role, text))
    ways = {0: (0, "", ())}

    def better(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def with_inserts(ways):
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                after = 3 if state == 2 else 2
                better(ways, after, (cost + 5, audit + "I", (*lines, ["user:", "assistant:"][after - 2])))
        return ways

    for (_, _, role, text), fault in zip(rows, faults):
        role, text, after = " " if role is None else role, " " if text is None else text, {}
        for state, (cost, audit, lines) in with_inserts(ways).items():
            better(after, state, (cost + 2, audit + "D", lines))
            if fault in "-t":
                cost += 5 * (fault == "t")
                to = 3 if state == 2 else 2
                better(after, to, (cost + 1, audit + "R", (*lines, f"{['user', 'assistant'][to - 2]}:{text}")))
                if role[:1] == "s" and state == 0 or role[:1] == "ua"[to - 2]:
                    better(after, 1 if role[:1] == "s" else to, (cost, audit + "K", (*lines, f"{role}:{text}")))
        ways = after
    cost, audit, lines = min((w for s, w in with_inserts(ways).items() if s in (0, 3)), key=lambda w: w[:2])
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [(" " if r[2] is None else r[2])[:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, lines


def random_turns(convs, most, seed):
    rng, out = random.Random(seed), []
    for c in convs:
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            out.append((c, None if rng.random() < 0.05 else t + rng.randint(0, 1), role, rng.choice(["", " \n", "Yes.", "no", "Why?", "Hm! ", "ü…", None, f"text {t}.", f"text {t}"])))
    return out


@pytest.mark.parametrize("most", [7, 60, 900])
def test_repairs_match_brute_force(spark, most):
    rows = random_turns([None, *range(40 if most < 100 else 3)], most, most)
    frame = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(5) for c in ("fault", "copy", "copies")})
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    made = collections.defaultdict(list)
    for r in sorted(repair.repaired_turns(frame).collect(), key=lambda r: r.position):
        made[r.conv_id].append(f"{r.role}:{r.text}")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(frame).collect()}
    assert set(got) == set(by)
    for conv, turns in by.items():
        *wanted, lines = brute_repair(turns)
        assert got[conv][:-1] == tuple(wanted) and made[conv] == list(lines), conv
        assert got[conv][-1] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in made[conv]))


def test_damage_and_sql(spark, tmp_path):
    rows = [(c, t, *r) for c, t, *r in random_turns([None, *range(60)], 9, 5)] + [(7000, 1, "user", "A."), (7001, None, None, None)]
    frame = spark.createDataFrame(rows, TURNS)
    got = sorted(map(tuple, repair.repair_report(repair.damage(frame)).collect()), key=str)
    frame.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert got == sorted(con.execute(oracles.REPAIRS).fetchall(), key=str)
    hurt = collections.defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        hurt[c] += [row] * {0: 0, 3: 2}.get(kind, 1)
    for conv, *values, audit, digest in got:
        *wanted, lines = brute_repair(hurt[conv])
        assert [*values, audit] == wanted and digest == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert {c for c, *_ in got} == {c for c, *_ in rows}


def test_repair_of_empty_and_long_conversations(spark):
    assert repair.repair_report(repair.damage(spark.createDataFrame([], TURNS))).count() == 0
    long = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}." + "x." * (t % 50)) for t in range(3000)]
    (r,) = repair.repair_report(spark.createDataFrame(long, TURNS)).collect()
    assert (r.cost, r.audit, r.gaps, r.illegal) == (0, "K" * 3000, 0, 0)
    (r,) = repair.repair_report(spark.createDataFrame([(1, 5, "user", "y." * 10**6)], TURNS)).collect()
    assert (r.cost, r.audit) == (2, "D") and r.repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_segments_change_nothing(monkeypatch):
    for segment in (1, 2, 5, 30):
        monkeypatch.setattr(repair, "SEGMENT", segment)
        for seed in range(60):
            rows, lines, seen = random_turns([1], 30, seed), [], set()
            rows = sorted([(c, t, *[" " if x is None else x for x in r]) for c, t, *r in rows], key=lambda r: (r[1] is not None, r[1] or 0, *r[2:]))
            whole = repair._Conversation(lambda role, text: lines.append(f"{role}:{text}"))
            for _, turn, role, text in rows:
                kept = text.strip()
                whole.add(turn, role, text, "b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else "-")
                seen.add((role, text))
            assert [*whole.end(), tuple(lines)] == list(brute_repair(rows)), (segment, seed)


def test_heuristic_never_exceeds_the_cost():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(0, 8)
        initials, faults = "".join(rng.choice("suax ") for _ in range(n)), "".join(rng.choice("bdt--") for _ in range(n))
        (cost, audit) = next(iter(repair.cheapest_edits(initials, faults, repair.EMPTY, True).values()))
        assert cost >= 2 * (n - faults.count("-")) and len(audit) - audit.count("I") == n
