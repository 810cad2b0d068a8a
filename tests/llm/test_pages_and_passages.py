"""Pages with awkward class names, hosts that agree on a container, passages without blanks, input columns that clash."""

import random

import pytest

from subpanel.llm import decontaminate, extraction, quality, substring

PART = "Some words of the article stand here. " * 12
LINE = PART.strip()


@pytest.mark.parametrize("page", [
    f"<div class='container no-sidebar'><p>{PART}</p></div>",
    f"<div class='post comments-open'><p>{PART}</p></div>",
    f"<div class='sidebar-left content'><p>{PART}</p></div><div class=comments><p>{PART * 3}</p></div>",
    f"<div class=content><p>{PART}</p></div><div class='ad-slot'>Buy</div><div class=sidebar-right>Side</div><div id=site-navigation>Menu</div>",
])
def test_marks_in_class_names(page):
    assert extraction.main_text(f"<html><body>{page}</body></html>", []) == LINE


def test_sections_of_an_article_stay():
    page = (f"<article><h1>Title</h1><p>{PART}</p><section id=discussion><h2 id=discussion>Discussion</h2><p>One.</p></section>"
            "<section id=related-work><p>Two.</p></section><div class=social-history>Three.</div><div class=comments>A reader.</div></article>")
    assert extraction.main_text(page, []) == f"Title\n{LINE}\nDiscussion\nOne.\nTwo.\nThree."
    assert extraction.main_text(f"<div class=post><header><h1>Head</h1></header><p>{PART}</p></div>", []) == f"Head\n{LINE}"


def test_the_hosts_choice_corrects_a_page(spark):
    plain = f"<body><div class=story><p>{PART}</p></div></body>"
    teased = f"<body><article class=teaser><p>{PART}{PART}</p></article><div class=story><p>{LINE} Own.</p></div></body>"
    rows = [(i, f"http://a.example/{i}", plain) for i in range(8)] + [(8, "http://a.example/8", teased), (9, "http://b.example/", teased)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r["page_id"]: r["text"] for r in extraction.extract(pages).collect()}
    assert found[0] == LINE and found[8] == f"{LINE} Own."  # a.example agrees on div.story
    assert found[9] == (PART + PART).strip()  # no other page tells of b.example


def test_extraction_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, host string, paths string"
    rows = [(1, None, None, "old", "h", "p"), (1, None, None, "old", "h", "p"), (2, "http://[", "", None, None, None), (None, "http://x/", f"<p>{PART}", "old", "h", "p")]
    found = extraction.extract(spark.createDataFrame(rows, schema))
    assert sorted(found.columns) == ["host", "html", "page_id", "paths", "text", "url"]
    assert sorted((r["page_id"] or 0, r["text"], r["host"] or "") for r in found.collect()) == [(0, LINE, "h"), (1, "", "h"), (1, "", "h"), (2, "", "")]
    assert extraction.extract(spark.createDataFrame([], schema)).count() == 0


def test_deep_pages():
    deep = extraction.Page("<div class=abcdefgh>x" * 25_000)
    assert len(deep.nodes) == 25_001 and len({n[1] for n in deep.nodes}) == 25_001
    assert max(len(n[1]) for n in deep.nodes) == 16
    assert extraction.main_text("<div class=abcdefgh>x" * 25_000, []).count("x") == 25_000


def han(n, seed):
    draw = random.Random(seed)
    return "".join(chr(draw.randint(0x4E00, 0x9FA5)) for _ in range(n))


def test_passages_without_blanks(spark):
    passage = han(600, 1)
    rows = [(1, han(300, 2) + passage + han(200, 3)), (2, han(123, 4) + passage + han(77, 5)), (3, han(2000, 6)), (4, han(2000, 6)), (5, han(900, 7))]
    found = {r["doc_id"]: r["text"] for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    given = dict(rows)
    assert found[1] == given[1] and found[3] == given[3] and found[5] == given[5]
    assert found[4] == ""
    assert found[2].startswith(given[2][:123]) and found[2].endswith(given[2][-77:]) and len(found[2]) < 200 + 0.2 * 600


def test_chunks_end_with_characters():
    text = "a few words " * 5 + han(500, 8) + " é" + "x" * 400 + "é" * 300
    data, start = text.encode(), 0
    for end in substring.boundaries(data):
        data[start:end].decode()
        assert end - start <= substring.MOST + 128
        start = end
    assert start == len(data)


def plain_dedup(rows):
    """Bytes that go from each text, in order of ids, by a walk through all chunks."""
    kept, gone = set(), {}
    for key, text in sorted(rows):
        run, words, own, total = None, 0, substring.chunks(text), 0
        seen = set()
        for start, end, n, digest in own:
            if digest in kept or digest in seen:
                run, words = (start if run is None else run, words + n)
                last = end
            else:
                total += last - run if run is not None and words >= substring.MIN_RUN_WORDS else 0
                run, words = None, 0
                seen.add(digest)
        total += last - run if run is not None and words >= substring.MIN_RUN_WORDS else 0
        kept |= {d for *_, d in own}
        gone[key] = total
    return gone


def test_substring_against_a_plain_walk(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: sum(s["end"] - s["start"] for s in r["removed"]) for r in substring.dedup(docs.repartition(5)).collect()}
    assert got == want and any(want.values())


def test_input_columns_come_back(spark):
    schema = "doc_id long, text string, removed string, verdict string, contaminated string, kept string, quality_score string, n_chars long"
    rows = [(i, f"The reader found number {i} of the stories good, and it was told well by all of them. " * (i % 5 + 1), "r", "v", "c", "k", "q", None)
            for i in range(1, 30)]
    docs = spark.createDataFrame(rows, schema)
    names = ["removed", "verdict", "contaminated", "kept", "quality_score"]
    items = spark.createDataFrame([(1, "nothing of this stands anywhere")], "item_id long, text string")
    for out in (substring.without_repeats(docs), decontaminate.clean(docs, items), quality.keep_good(docs)):
        assert out.columns == docs.columns
        assert {tuple(r[n] for n in names) for r in out.collect()} <= {("r", "v", "c", "k", "q")}
    assert decontaminate.clean(docs, items).count() == 29
