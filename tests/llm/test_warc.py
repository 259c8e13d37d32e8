import gzip
import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import warc

PAGE = """<!DOCTYPE html><html><head><title> A &amp; B
</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no --><p class="a>b">One&nbsp;two
three<br/>four</p><p>five <b>six</b>&#233;<a href="/x?a=1&amp;b=2">seven</a> &lt;tag&gt;</p><ul><li>eight<li>nine</ul>"""


def test_text_and_metadata():
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nX-Odd:  v:w \r\n\r\n" + PAGE.encode()
    meta, text = warc.derive_one("<urn:uuid:1>", "http://e/", "2024-05-05T00:00:00Z", block, None, "sha1:GIVEN")
    assert text["block"].decode() == "A & B\nOne two three\nfour\nfive sixéseven <tag>\neight\nnine"
    lines = meta["block"].decode().split("\r\n")
    assert "http-status: 404 Not Found" in lines and "http-header-x-odd: v:w" in lines and "title: A & B" in lines
    assert "outlink: /x?a=1&b=2" in lines and "source-payload-digest: sha1:GIVEN" in lines
    named = {h["name"]: h["value"] for h in text["headers"]}
    assert named["WARC-Refers-To"] == "<urn:uuid:1>" and named["WARC-Refers-To-Date"] == "2024-05-05T00:00:00Z"
    assert named["WARC-Block-Digest"] == warc.digest(text["block"]) and named["Content-Length"] == str(len(text["block"]))


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_words_match_a_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        parser = Plain()
        parser.feed(r.html)
        parser.close()
        got, want = warc.text_of(r.html), "".join(parser.out)
        assert "".join(got.split()).startswith("".join(want.split())), r.page_id


def test_edges(spark):
    rows = [("<urn:uuid:1>", "u", "d", None), (None, None, None, b""), ("i", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89"), ("j", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=latin-1\r\n\r\n\xe9"), ("k", "u", "d", b"HTTP/broken"), ("k", "u", "d", b"HTTP/broken")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "record_id string, target_uri string, date string, block binary, headers string")
    got = warc.derive(frame, keep=["record_id"]).collect()
    kinds = [(r.record_id, r.record_type) for r in got]
    assert len(got) == 11 and ("i", "conversion") not in kinds and kinds.count(("k", "metadata")) == 2
    assert [bytes(r.block).decode() for r in got if kinds[got.index(r)] == ("j", "conversion")] == ["é"]
    assert not [h for r in got if r.record_id is None for h in r.headers if h.name == "WARC-Refers-To"]
    assert warc.derive(frame.limit(0)).count() == 0
    long = spark.createDataFrame([(1, None, "<p>x" * 300_000), (1, "u", None), (None, "u", "")], "page_id long, url string, html string")
    assert warc.derive(warc.responses_of(long), keep=["page_id"]).count() == 6


def test_files_round_trip(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = warc.derive(warc.responses_of(pages))
    warc.write(made, str(tmp_path / "out"))
    back = {bytes(r.block) + str(sorted(map(tuple, r.headers))).encode() for r in warc.read(spark, str(tmp_path / "out/*.txt")).collect()}
    want = made.collect()
    assert back == {bytes(r.block) + str(sorted(map(tuple, r.headers))).encode() for r in want}
    members = b"".join(gzip.compress(warc.serialised(r.headers, bytes(r.block))) for r in want[:5])
    assert [b for _, b in warc.parse(members)] == [bytes(r.block) for r in want[:5]]


GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = ["<a ", "<a", "<br>", "<br/", "</p", ">", "<!", "<!--", "-->", "<!x", '"', "'", " href=", "href='", 'href="x"', "x", " ", "<script>", "</script >", "<STYLE ", "</style>", "<title>", "<TITLE ", "</title>", "</ title", "\n", "<", "=", "<b ", "&amp;"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_scanning_equals_the_expressions(page):
    assert warc._gone(page) == GONE.sub("", page)
    found = TITLE.search(page)
    assert warc._title(page) == (found[1] if found else None)
    assert warc._links(page) == [a or b or c for a, b, c in LINK.findall(page)]
    broken = warc._BREAK.sub("|", page)
    assert warc._without(page, re.compile(warc._BREAK_HEAD, re.I), "|") == broken
    assert warc._without(page, re.compile(warc._TAG_HEAD + "|<!"), "") == warc._TAG.sub("", page)


@pytest.mark.parametrize("part", ["<a x ", "<a", "<title>", "<title", "<!", "<!--", "<script ", "<script>", "<br x=\"", "<a href='", "<a href=", "href ", "<p \"'", "</p", "<a 'x' \"y\" "])
def test_malformed_pages_take_linear_time(part):
    page = part * (1_000_000 // len(part))
    began = time.perf_counter()
    warc.derive_one("i", "u", "d", page.encode(), None, None)
    assert time.perf_counter() - began < 4


def test_what_is_no_record_is_kept_and_passed_over(spark, tmp_path):
    good = [warc.serialised([{"name": "A", "value": str(i)}, {"name": "Content-Length", "value": "3"}], b"abc") for i in range(3)]
    data = good[0] + b"junk\r\n" + good[1] + b"WARC/1.1\r\nContent-Length: many\r\n\r\nx\n" + good[2] + b"WARC/1.1\r\ncut"
    rows = list(warc.parse(data))
    assert [h[0]["value"] for h, _ in rows if h] == ["0", "1", "2"]
    assert [b for h, b in rows if h is None] == [b"junk\r\n", b"WARC/1.1\r\nContent-Length: many\r\n\r\nx\n", b"WARC/1.1\r\ncut"]
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data)[:40])
    back = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.headers is None for r in back) == [False] * 3 + [True] * 4
    empty = spark.createDataFrame([([("Content-Length", "0")], None)], "headers array<struct<name:string,value:string>>, block binary")
    warc.write(empty, str(tmp_path / "out"))
    assert [bytes(r.block) for r in warc.read(spark, str(tmp_path / "out/*.txt")).collect()] == [b""]
