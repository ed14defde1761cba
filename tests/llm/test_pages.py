"""Main text and WARC archives."""

import base64
import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest

from arealis.llm import html, warc
from arealis.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="post">
<div id="cookie-notice">We use cookies.</div><header><h1>Site name</h1><nav><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul></nav></header>
<article><header class="article-header"><h1>The  title</h1></header><p>First <b>para</b>graph &amp; more&nbsp;text,<br>second line.<p>Unclosed &lt;next&gt; one.
<div class="ad">Buy this now, it is cheap.</div><ul><li>A point that matters, too.<li>And one more.</ul><form><p>Your mail: <input> <button>Send</button></form></article>
<section class="comments"><h3>Comments</h3><p>I liked this very much, thanks a lot for writing it.</p></section>
<aside><p>Something else that is written at length here, to be read by nobody.</p></aside><footer>&copy; 2020</footer><!-- <p>hidden</p> -->"""


def test_article_without_what_surrounds_it():
    want = "The title First paragraph & more text, second line. Unclosed <next> one. A point that matters, too. And one more."
    assert html.main_text(ARTICLE, html.PRIOR) == want


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</div>", "<!--", "<script>x", "<p class='a>b</p>", "<![CDATA[ x ]]>", "&#x110000; &bogus;", "<a" * 200_000, "<a \"" * 100_000, "<a =\"" * 50_000 + ">", "<!-" * 100_000, "<div>" * 3000 + "x", "x" * 3_000_000])
def test_odd_pages_do_not_fail(page):
    assert isinstance(html.main_text(page, html.PRIOR), str)


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 9)
        gain = np.array([rng.choice([rng.uniform(-2, 2), 0.5, -0.5]) for _ in range(n)])
        edges = [(i, i + 1, rng.uniform(0, 1.5)) for i in range(n - 1)] + [(i, i + 2, rng.uniform(0, 1)) for i in range(n - 2)]

        def cost(x):
            return sum(-g if k else 0 for g, k in zip(gain, x)) + sum(c for a, b, c in edges if x[a] != x[b])

        best = min(cost(x) for x in itertools.product((0, 1), repeat=n))
        assert cost(html.minimum_cut(gain, edges)) == pytest.approx(best)


def test_query_takes_the_articles(spark):
    import html as standard
    import re

    got = {r.page_id: r for r in QUERIES["op8_main_text"](spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(standard.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = " ".join(b for b in blocks if b)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, digest string")


ROWS = [(1, "u1", "a"), (2, "u2", "a"), (3, None, None), (4, "u\r\n4", ""), (5, "u5", "b\r\n\r\nc é"), (6, "u6", "a"), (None, "u7", "a"), (None, None, "only"), (8, "u8", "x" * (17 << 20)), (9, "u9", "a"), (9, "u9", "a")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("per", [1, 3, 1000])
def test_round_trip(spark, tmp_path, per):
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, ROWS).coalesce(2), path, records_per_archive=per)
    read = warc.read_archives(spark, path)
    got = sorted((r.record_id or 0, r.type, r.payload_digest, r.refers_to, r.payload_bytes) for r in warc.resolved(read).collect())
    top = {"a": 9, "": 4}
    want = []
    for i, _, t in ROWS:
        text = t or ""
        revisit = i is not None and text in top and top[text] != i
        want.append((i or 0, "revisit" if revisit else "response", digest(text), top[text] if revisit else None, len(text.encode())))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2]))
    texts = {(r.record_id, bytes(r.payload).decode()) for r in read.where("type = 'response'").collect()}
    assert texts == {(i, t or "") for i, _, t in ROWS if i is None or (t or "") not in top or top[t or ""] == i}
    for f in (tmp_path / "w").glob("part-*"):  # whole files are sound gzip streams
        data = f.read_bytes()
        while data:
            d = zlib.decompressobj(31)
            assert d.decompress(data).startswith(b"WARC/1.1\r\n") or d.eof
            assert d.eof
            data = d.unused_data


def test_least_size_and_nothing(spark, tmp_path):
    warc.write_archives(pages(spark, ROWS[:4]), str(tmp_path / "a"), least=2)
    assert warc.read_archives(spark, str(tmp_path / "a")).where("type = 'revisit'").count() == 0
    warc.write_archives(pages(spark, []), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_damaged_archives_are_found():
    good = warc.member(1, "u", b"payload" * 9000, digest("payload" * 9000), None, False)
    assert [h["warc-record-id"] for _, h, _ in warc.records(memoryview(good + good))] == ["<urn:x-record:1>"] * 2
    flipped = warc.member(1, "u", b"payload", digest("other"), None, False)
    for bad in (good[:-9], good[: len(good) // 2], b"junk" + good, good + b"\x00" * 30):
        with pytest.raises((ValueError, zlib.error)):
            list(warc._parsed("f", bad))
    with pytest.raises(ValueError, match="payload digest"):
        list(warc._parsed("f", flipped))


@pytest.mark.parametrize(
    "inner, want",
    [
        ('<section id="discussion"><h2>Discussion</h2><p>Short paragraph.</p></section>', "Discussion Short paragraph."),
        ('<p class="related">Two sentences stand here. Both of them belong to the text.</p>', "Two sentences stand here. Both of them belong to the text."),
        ("<p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b</annotation></math> is positive.</p>", "The sum a+b is positive."),
        ('<div class="comments"><p>I liked this one.</p></div><aside>More</aside>', ""),
    ],
)
def test_article_keeps_what_only_a_name_speaks_against(inner, want):
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>First paragraph of the text, with a sentence.</p>{inner}</article><footer>Imprint</footer></body>"
    assert html.main_text(page, html.PRIOR) == f"Title First paragraph of the text, with a sentence. {want}".strip()


@pytest.mark.parametrize(
    "made",
    [
        lambda n: "<div>" * n + "</span>" * (2 * n),
        lambda n: "<b>" * n + "<p>x" * n,
        lambda n: "<![CDATA[x>" * n,
        lambda n: "<b>" * n + "x</div>" * n,
        lambda n: "<table><tr>" + "<b>" * n + "<td>x" * n,
    ],
)
def test_broken_pages_take_linear_time(made):
    def seconds(n):
        page, best = made(n), 9e9
        for _ in range(3):
            start = time.process_time()
            html.blocks(page)
            best = min(best, time.process_time() - start)
        return best

    assert seconds(8000) < 8 * seconds(2000) + 0.05
