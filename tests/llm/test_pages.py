"""WARC archives and main text of pages."""

import gzip
import itertools
import random
import time
import zlib

import pytest

from packetloom.llm import mainhtml, warc

BIG = "<p>" + "same payload " * 20 + "</p>"


def test_round_trip_with_revisits(spark, tmp_path):
    rows = [(5, "http://a", BIG), (3, "http://b\r\nX: 1", BIG), (9, None, BIG), (4, "u", None), (6, "u", None), (7, "v", "x\r\n\r\ny"), (8, "w", "é" * 60), (None, "n", BIG)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumnRenamed("url", "address")
    kinds = warc.record_kinds(df, "page_id", "html")
    whole, members = str(tmp_path / "whole"), str(tmp_path / "members")
    warc.write_monolithic(warc.as_records(kinds, "page_id", "address", "html").coalesce(1), whole)
    index = warc.normalise(spark, whole, members)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_records(index, members).collect()}
    size = len(BIG.encode())
    assert got == {
        "5": (size, "revisit", "3"), "3": (size, "response", None), "9": (size, "revisit", "3"), "4": (0, "response", None), "6": (0, "response", None),
        "7": (6, "response", None), "8": (120, "response", None), None: (size, "response", None),
    }
    (archive,) = (tmp_path / "members").glob("*.warc.gz")
    data = archive.read_bytes()
    lines = archive.with_name(archive.name + ".idx").read_text().splitlines()
    assert len(lines) == 8
    for line in lines:
        offset, length, name = line.split(" ")
        member = zlib.decompress(data[int(offset) : int(offset) + int(length)], 31)
        assert member.startswith(b"WARC/1.1\r\n") and f"WARC-Record-ID: {name}\r\n".encode() in member
    # One stream before, and the same records after.
    (stream,) = (tmp_path / "whole").glob("*.gz")
    assert gzip.decompress(stream.read_bytes()) == gzip.decompress(data)


def test_normaliser_takes_members_and_names_damage():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    cut_within = gzip.compress(record + record[:9]) + gzip.compress(record[9:] + record)
    for content in (gzip.compress(record * 3), gzip.compress(record) * 3, cut_within):
        assert [r for _, r in warc.split_records(memoryview(content), "f")] == [record] * 3
    assert list(warc.split_records(memoryview(b""), "f")) == []
    for bad in (gzip.compress(record)[:-12], gzip.compress(record[:-3]), gzip.compress(b"no record\r\n\r\n")):
        with pytest.raises(ValueError, match="f:"):
            list(warc.split_records(memoryview(bad), "f"))


def test_empty_table_of_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    records = warc.as_records(warc.record_kinds(df, "page_id", "html"), "page_id", "url", "html")
    warc.write_monolithic(records, str(tmp_path / "w"))
    index = warc.normalise(spark, str(tmp_path / "w"), str(tmp_path / "m"))
    assert warc.read_records(index, str(tmp_path / "m")).collect() == []


PROSE = "It was the third time that year that the river had risen over the old stone bridge, and nobody was surprised."
PAGE = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var a = "<p>{PROSE}</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a><p>A daily paper</p></header><nav><ul><li><a href="/a">World</a><li><a href="/b">Sport</a></ul></nav>
<div class="cookie-notice"><p>{PROSE} We use cookies.</p></div><div id="sidebar"><p>Most read this week in our paper.</p></div>
<article><h1>The   river &amp;\n the bridge</h1><p>{PROSE}<p><b>Fish &lt;3</b> &#8211; and caf&eacute;s.<div class="ad">Buy now, {PROSE}</div><p>{PROSE}</p>
<form><label>Mail</label><input name="m"><p>Join our list today.</p></form><blockquote>So it goes.</blockquote></article>
<section class="comments"><h2>Comments</h2><p>{PROSE} I was there too, and {PROSE}</p></section><aside><p>{PROSE}</p></aside>
<footer>&copy; 2024 The paper. All rights reserved.</footer></body></html>"""


def test_article_without_its_surroundings():
    assert mainhtml.main_text(PAGE).split("\n") == ["The river & the bridge", PROSE, "Fish <3 – and cafés.", PROSE, "So it goes."]


@pytest.mark.parametrize("page", [
    '<body class="has-sidebar">{}</body>', '<div class="no-sidebar">{}</div>', '<body class="search-results"><main>{}</main></body>',
    '<body class="single-post comments-open">{}</body>', '<div class="main-content with-sidebar">{}</div>', '<div class="post tags-news">{}</div>',
    '<div class="article social-share-enabled">{}</div>', '<div class="story popular">{}</div>', '<body><form>{}</form></body>',
    '<div id="page" class="search-page"><h1>' + PROSE + "</h1>{}</div>",
])
def test_names_of_the_whole_page_say_nothing_against_its_article(page):
    article = "".join(f"<p>{PROSE} {i}</p>" for i in range(4))
    around = '<nav><a href="/">Home</a></nav>', '<div class="sidebar widget"><p>Most read this week.</p></div><div class="comments"><p>' + PROSE + "</p></div>"
    got = mainhtml.main_text(around[0] + page.format(article) + around[1]).split("\n")
    assert [g for g in got if g != PROSE] == [f"{PROSE} {i}" for i in range(4)]
    assert (PROSE in got) == ("<h1>" in page)


def test_long_and_deep_pages_take_time_in_proportion():
    start = time.monotonic()
    assert mainhtml.main_text(f"<p>{PROSE}</p>" + "<a " * 300_000).startswith(PROSE)
    deep = mainhtml.main_text("<div>x" * 100_000 + "</p>" * 100_000 + f"<p>{PROSE}</p>")
    assert isinstance(deep, str)
    assert mainhtml.main_text(f"<article><p>{PROSE} 1 <2 <!-- {PROSE}") == f"{PROSE} 1 <2"
    assert time.monotonic() - start < 20


def test_plain_and_broken_pages():
    assert mainhtml.main_text(f"<body><p>{PROSE}<p>{PROSE}") == f"{PROSE}\n{PROSE}"
    assert mainhtml.main_text(f"<article><p>{PROSE}</p><!-- open {PROSE}") == PROSE
    assert mainhtml.main_text(f"<article><p>{PROSE} 1 < 2</p><script>{PROSE}") == f"{PROSE} 1 < 2"
    assert mainhtml.main_text(None) == mainhtml.main_text("") == mainhtml.main_text("<p> &nbsp; </p>") == ""


def test_minimum_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 8)
        scores = [rng.randrange(-40, 41) / 10 for _ in range(n)]
        ties = [(a, b, rng.randrange(0, 30) / 10) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def price(labels, scores=scores, ties=ties):
            wrong = sum(s for s, k in zip(scores, labels, strict=True) if s > 0 and not k) - sum(s for s, k in zip(scores, labels, strict=True) if s < 0 and k)
            return wrong + sum(c for a, b, c in ties if labels[a] != labels[b])

        best = min(price(labels) for labels in itertools.product([False, True], repeat=n))
        assert price(mainhtml.minimum_cut(scores, ties)) == pytest.approx(best, abs=1e-6)


def test_main_text_edges(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 3), (1, "u", PAGE, 3), (None, None, None, None), (2, "v", "", 1)], "page_id int, url string, html string, n_chars int")
    got = mainhtml.with_main_text(df).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [0, got[1].n_chars, got[1].n_chars, 0] and got[1].n_chars == len(got[1].text)
    assert mainhtml.with_main_text(df.limit(0)).columns == ["page_id", "url", "html", "text", "n_chars"]
