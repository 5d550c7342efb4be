import hashlib
import html
import re

import numpy as np
import pytest

from barlake.llm import html_hosts, warc
from edge_rows import CLASHES

SMALL = "/root/testdata/sf0.001"


def plain_text(page):
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", article)]
    return "\n".join(x for x in parts if x)


def test_articles_of_all_pages(spark):
    got = {r.page_id: r for r in html_hosts.op1_main_text(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (plain_text(r.html), len(plain_text(r.html)), r.url)


def test_structure():
    page = (
        '<html><body class="no-sidebar"><div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header>'
        "<div id=content><h2>Title &eacute;</h2><p>First&nbsp;para <b>bold</b>ly <i>x</i></p><p>second<br/>line<ul><li>one<li>two</ul></div>"
        '<section id="comments"><article class="comment"><p>nice</p></article></section><form><input>go</form><script>var x="<p>no</p>";</script></body></html>'
    )
    assert html_hosts.parsed(page)[0] == ["Title é", "First para boldly x", "second line", "one", "two"]
    page = "<article><header><h1>T</h1></header><p>a<aside>side</aside>b</p><div class='ad'>buy</div><footer>f</footer></article>tail <!-- open"
    assert html_hosts.parsed(page)[0] == ["T", "a", "b"]
    assert html_hosts.parsed("")[0] == [] and html_hosts.parsed("a < b & c")[0] == ["a < b & c"]


@pytest.mark.parametrize(
    "inside",
    ["<svg width=1/>", "<svg/>", "<select><option>a<option>b", "<template>", "<object data=x>", "<select>" * 3000 + "</select>", "<svg><path d=x></svg>", "<template><article>t</article></template>"],
)
def test_elements_left_out_keep_the_text_behind_them(inside):
    page = f"<html><body><nav>menu</nav><article><p>First part.</p>{inside}<p>Last part.</p></article><footer>f</footer></body></html>"
    assert html_hosts.parsed(page)[0] == ["First part.", "Last part."]


def test_formulas_and_deep_elements_stay():
    page = "<article><p>First <math><mi>x</mi><annotation>tex</annotation></math>.</p>%s<p>Last part.</p></article><nav>menu</nav>"
    assert html_hosts.parsed(page % "")[0] == ["First x .", "Last part."]
    assert html_hosts.parsed(page % ("<div>" * 900 + "deep" + "</div>" * 900))[0] == ["First x .", "deep", "Last part."]
    assert html_hosts.parsed(page % ("<div>" * 900 + "<nav>deep</nav>" + "</div>" * 900))[0] == ["First x .", "Last part."]


@pytest.mark.parametrize("wrapper", ['<div class="page has-sidebar">%s</div>', "<form action=x>%s</form>", '<div id="with-comments"><form>%s</form></div>'])
def test_wrappers_of_the_article_are_no_chrome(wrapper):
    article = '<nav>menu</nav><article class="post comments-open"><p>Text.</p><div class="share-bar">share</div><div class="comments"><article>reply</article></div></article>'
    page = wrapper % article + '<div class="related-posts"><p>other</p></div>'
    assert html_hosts.parsed(page)[0] == ["Text."]
    assert html_hosts.parsed('<main><p>Text.</p></main><div class="related-posts"><article>teaser</article></div>')[0] == ["Text."]
    assert html_hosts.parsed(wrapper % "<p>Only text.</p><nav>menu</nav>")[0] == ["Only text."]


def test_suffix_ranks_equal_sorted_suffixes():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 3, 200)
    starts = np.array([0, 50, 51, 120, 200])
    stream = np.repeat(np.arange(4), np.diff(starts))
    left = starts[1:][stream] - np.arange(200)
    _, rank = html_hosts.suffix_ranks(tokens, left, 6)
    first = [tuple(tokens[k : min(k + 6, k + left[k])]) for k in range(200)]
    for a in range(200):
        for b in range(200):
            assert (rank[a] == rank[b]) == (first[a] == first[b])


def test_repeats_decide_where_no_article_is_marked(spark):
    plate = " ".join(f"plate{k}" for k in range(30))
    rows = [(k, f"http://h.example/{k}", f"<div>{plate}</div><div>own words of page {' '.join(f'p{k}w{j}' for j in range(20))}</div>") for k in range(6)]
    rows += [(10, "http://other.example/", f"<div>{plate}</div>"), (11, "http://other.example/copy", f"<div>{plate}</div>")]
    rows += [(12, None, None), (12, None, ""), (None, "x", "<p>text</p>"), (13, "http://h.example/a", f"<article>{plate}</article>")]
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(v) for n, v in CLASHES.items()})
    got = html_hosts.extracted(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    # what the pages share goes on into the common beginning of their own blocks
    assert all(text[k] == " ".join(f"p{k}w{j}" for j in range(20)) for k in range(6))
    assert text[10] == text[11] == text[13] == plate and text[12] == "" and text[None] == "text"
    assert html_hosts.extracted(pages.limit(0)).collect() == []


def test_archive_round_trip_and_revisits(spark, tmp_path):
    big = "é" * 600 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "u", big), (5, None, big), (3, "a\r\nb", big), (4, "u", "x"), (6, "u", "x"), (7, "u", None), (None, "n", big), (9, "u", "z" * 3_000_000)]
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(v) for n, v in CLASHES.items()})
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    got = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == len(rows)
    for page_id, _, page in rows:
        raw, own = (page or "").encode(), got[page_id]
        assert (own.payload_bytes, own.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        again = page == big and page_id != 5
        assert (own.record_type, own.refers_to) == (("revisit", 5) if again else ("response", None))
        assert bytes(own.payload) == (b"" if again else raw)
    assert warc.read_archive(spark, path, where="record_type = 'revisit' AND payload_bytes > 1000").count() == 3
    assert {r.page_id for r in warc.read_archive(spark, path, payload=False, where="page_id IN (4, 6)").collect()} == {4, 6}
    empty = str(tmp_path / "empty")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).collect() == []


def test_skipped_payloads_are_not_read(tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 5000000\r\n\r\n"
    path = tmp_path / "x.warc"
    path.write_bytes(b"".join(record % (b"response" if k == 2 else b"other", k) + b"y" * 5_000_000 + b"\r\n\r\n" for k in range(4)))
    read = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            read.append(n)
            return self.file.read(n)

    with path.open("rb") as f:
        got = list(warc.read_records(Counted(f), path.stat().st_size, lambda h: h["record_type"] == "response", True, chunk=4096))
    assert [(h["page_id"], len(p)) for h, p in got] == [(2, 5_000_000)] and sum(read) < 5_100_000


def test_query_equals_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in warc.op7_warc_round_trip(spark, SMALL).collect()}
    groups = {}
    for r in pages:
        groups.setdefault(r.html, []).append(r.page_id)
    for r in pages:
        raw, top = r.html.encode(), max(groups[r.html])
        again = len(raw) >= 1000 and top != r.page_id
        own = got[r.page_id]
        assert (own.payload_bytes, own.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (own.record_type, own.refers_to) == (("revisit", top) if again else ("response", None))
