"""Boilerplate of a host: copies of a page, hosts beyond a task, small hosts."""

import pytest

from llm import html_text


def page(own):
    return "".join(f"<p>{b}</p>" for b in ("Read more on our site now", own, "Copyright of the host"))


def words_of(i):
    return f"page {i} says " + " ".join(f"w{i}x{k}" for k in range(12))


def texts(spark, rows):
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    return {r.page_id: r.text for r in got}


@pytest.mark.parametrize("url", ["http://a.example.org/%d", None])
def test_copies_count_once(spark, url):
    """40 copies of an article fill a host: its text stays, and what all pages share goes from the copies too."""
    rows = [(i, url and url % i, page(words_of(0) if i < 40 else words_of(i))) for i in range(65)]
    assert texts(spark, rows) == {i: words_of(0) if i < 40 else words_of(i) for i in range(65)}


def test_repeated_rows_are_one_page(spark):
    rows = [(1, "http://a.example.org/", page(words_of(1)))] * 25
    assert texts(spark, rows) == {1: "\n".join(("Read more on our site now", words_of(1), "Copyright of the host"))}


@pytest.mark.parametrize("runs", [1_000_000, -1])
def test_large_pages_are_judged_over_the_host(spark, monkeypatch, runs):
    """Shards of a few pages: share and number of pages are of the whole host; a passage on a third stays."""
    monkeypatch.setattr(html_text, "SHARD_BYTES", 600)
    monkeypatch.setattr(html_text, "BROADCAST_RUNS", runs, raising=False)
    own = {i: words_of(i) + ("</p><p>a passage that some pages share" if i % 3 == 0 else "") for i in range(60)}
    got = texts(spark, [(i, "http://a.example.org/%d" % i, page(t)) for i, t in own.items()])
    assert got == {i: t.replace("</p><p>", "\n") for i, t in own.items()}


def test_small_hosts(spark):
    """Notices on all pages of a host of 18 or 4 pages go; two pages are too few, and copies are no further pages."""
    own = [(h, i) for h, n in (("a", 18), ("b", 4), ("c", 2)) for i in range(n)] + [("c", 1)] * 5
    rows = [(100 * ord(h) + i, f"http://{h}.example.org/{i}", page(words_of(i))) for h, i in own]
    whole = lambda i: "\n".join(("Read more on our site now", words_of(i), "Copyright of the host"))
    assert texts(spark, rows) == {100 * ord(h) + i: whole(i) if h == "c" else words_of(i) for h, i in own}
