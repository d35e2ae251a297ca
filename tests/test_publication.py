"""Topic findings, reviews that match, went stale or are missing, coverage, and the check of a wiki."""

from tessera.operators import publication as p

BASE, NEXT = "baseline", "candidate"


def frames(spark, **changes):
    topics = [(s, t, "o", f"{t}.md", None, "wiki") for s in (BASE, NEXT) for t in ("same", "dep", "moved", "stale", "lost", "anchor")] + [(BASE, "gone", "o", "g.md", None, "wiki"), (NEXT, "new", "o", "n.md", "a", "wiki"), (BASE, "edit", "o", "e.md", None, "wiki"), (NEXT, "edit", "o2", "e.md", None, "wiki")]
    names = {t for _, t, *_ in topics}
    inputs = [(s, t, f"d:{t}", f"arch/{t}.md", f"h{t}") for s, t, *_ in topics if t not in ("dep", "moved", "stale", "lost")]
    inputs += [(BASE, "dep", "d", None, "1"), (NEXT, "dep", "d", None, "2"), (BASE, "moved", "d", "arch/old.md", "1"), (NEXT, "moved", "d", "arch/new.md", "1"), (BASE, "stale", "d", "arch/old.md", "1"), (NEXT, "stale", "d", "arch/old.md", "1"), (BASE, "lost", "d", None, "1"), (NEXT, "lost", "d", None, None)]
    pages = [(s, f"arch/{t}.md", t) for s in (BASE, NEXT) for t in names] + [(BASE, "arch/old.md", "u"), (NEXT, "arch/new.md", "u"), (NEXT, "arch/free.md", None), (NEXT, "arch/private/x.md", None)]
    targets = [(s, t, "unresolved-anchor" if t == "anchor" else "available", f"t{t}") for s, t, *_ in topics]
    settings = [(s, changes.get("tag", "v1") if s == NEXT else "v1", "pinned", "wiki") for s in (BASE, NEXT)]
    if changes.get("first"):
        topics, inputs, pages, targets, settings = ([r for r in rows if r[0] == NEXT] for rows in (topics, inputs, pages, targets, settings))
    make = spark.createDataFrame
    return make(topics, "side string, topic string, owner string, wiki_page string, anchor string, edit_at string"), make(inputs, "side string, topic string, dependency string, page string, hash string"), make(pages, "side string, path string, uid string"), make(targets, "side string, topic string, state string, hash string"), make(settings, "side string, release_tag string, source_policy string, destination string")


def test_findings_and_reviews(spark):
    given = frames(spark)
    found = p.topic_findings(*given)
    rows = {r.topic: r for r in found.collect()}
    assert {t: (r.status, r.reasons) for t, r in rows.items()} == {
        "dep": ("needs-review", ["dependency-changed d"]),
        "moved": ("needs-review", ["architecture-page-moved arch/old.md arch/new.md"]),
        "stale": ("incomplete", ["architecture-page-moved arch/old.md arch/new.md"]),
        "lost": ("incomplete", ["dependency-changed d", "evidence-unavailable d"]),
        "anchor": ("incomplete", ["target unresolved-anchor"]),
        "gone": ("needs-review", ["dependency-changed d:gone", "mapping-retired", "target-changed"]),
        "new": ("needs-review", ["dependency-changed d:new", "initial-review", "target-changed"]),
        "edit": ("needs-review", ["mapping-changed"]),
    }
    reviews = spark.createDataFrame(
        [("dep", "o", "still-current", rows["dep"].review_basis), ("gone", "o", "retired", rows["gone"].review_basis), ("new", "o", "still-current", "old"), ("edit", "o", "still-current", rows["edit"].review_basis), ("lost", "o", "still-current", rows["lost"].review_basis), ("same", "o", "still-current", "x"), ("nowhere", "o", "retired", "x")],
        "topic string, owner string, decision string, review_basis string",
    )
    reviewed = p.reviewed_findings(found, reviews)
    assert {r.topic: r.status for r in reviewed.collect() if r.status.startswith("rev")} == {"dep": "reviewed-current", "gone": "reviewed-retired"}
    states = sorted((r.topic, r.state) for r in p.review_states(found, reviews).collect())
    assert states == [("dep", "matched"), ("edit", "missing"), ("edit", "stale"), ("gone", "matched"), ("lost", "blocked"), ("moved", "missing"), ("new", "missing"), ("new", "stale"), ("nowhere", "idle"), ("same", "idle")]
    again = {r.topic: r.review_basis for r in p.topic_findings(*[f.repartition(3) for f in given]).collect()}
    assert again == {t: r.review_basis for t, r in rows.items()}
    coverage = p.page_coverage(given[2], given[1], ["arch/private/**"])
    left = {r.path: r.state for r in coverage.collect()}
    assert left["arch/free.md"] == "unmapped" and left["arch/private/x.md"] == "excluded" and left["arch/new.md"] == "mapped"
    one = p.publication_state(reviewed, coverage, given[3]).first()
    assert (one.complete, one.review_required, one.ready, one.incomplete, one.reviewed) == (False, True, False, 3, 2)


def test_a_new_tag_reopens_everything_and_no_baseline_is_a_first_review(spark):
    before = {r.topic: r.review_basis for r in p.topic_findings(*frames(spark)).collect()}
    tagged = {r.topic: r for r in p.topic_findings(*frames(spark, tag="v2")).collect()}
    assert "release-tag-changed" in tagged["same"].reasons and all(tagged[t].review_basis != b for t, b in before.items())
    first = {r.topic: r.reasons for r in p.topic_findings(*frames(spark, first=True)).collect()}
    assert "initial-review" in first["same"] and "target-changed" not in first["same"] and "gone" not in first


def test_wiki_problems(spark):
    files = ["Home.md", "A-page.md", "sub/B.md", "other/b.md", "img/x.png", "img/y.exe", "../up.md", ".git/c.md", "X.rst", "dir", "dir/f.md", "Case.md", "case.md", "a?.md"]
    links = [("Home.md", t, False, False) for t in ("A page", "A-page", "a-page", "A-page#one", "A-page#none", "#top", "none", "https://x", "javascript:x", "/root", "../x", "img/x.png", "mailto:a@b", "//cdn")]
    links += [("Home.md", "/A-page", False, True), ("Home.md", "img/x.png", True, False), ("Home.md", "img/y.exe", True, False), ("Home.md", "A-page.md", True, False)]
    frame = spark.createDataFrame([(f, 10) for f in files] + [("big.md", 99)], "path string, bytes bigint")
    got = {(r.path, r.kind, r.detail) for r in p.wiki_problems(frame, spark.createDataFrame(links, "path string, target string, image boolean, wiki boolean"), spark.createDataFrame([("A-page.md", "one"), ("Home.md", "top")], "path string, anchor string"), file_bytes=50, total_bytes=100).collect()}
    assert got == {
        ("../up.md", "invalid-path", ""), (".git/c.md", "invalid-path", ""), ("a?.md", "invalid-path", ""), ("big.md", "file-limit", ""), ("", "total-limit", ""), ("X.rst", "unsupported-page", ""), ("case.md", "path-collision", "case.md"), ("dir/f.md", "tree-collision", "dir"),
        ("sub/B.md", "route-collision", "b"), ("other/b.md", "route-collision", "b"), ("Case.md", "route-collision", "case"), ("case.md", "route-collision", "case"), ("Home.md", "unsafe-link", "a-page"), ("Home.md", "missing-anchor", "A-page#none"), ("Home.md", "missing-link", "none"),
        ("Home.md", "unsafe-link", "javascript:x"), ("Home.md", "unsafe-link", "/root"), ("Home.md", "unsafe-link", "../x"), ("Home.md", "image-format", "img/y.exe"), ("Home.md", "image-page", "A-page.md"),
    }
    none = spark.createDataFrame([], "path string, bytes bigint")
    assert [r.kind for r in p.wiki_problems(none, spark.createDataFrame([], "path string, target string, image boolean, wiki boolean"), spark.createDataFrame([], "path string, anchor string")).collect()] == ["missing-home"]
