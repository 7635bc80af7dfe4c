"""Derived records against the standard library's HTML parser, and by the rules of the format."""

import base64
import hashlib
import json
from html.parser import HTMLParser

from conftest import SMALL

from hostwatch.llm import queries, warc


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template", "noscript", "svg", "iframe", "object"):
            self.skip += 1
        self.out.append("\n" if tag in warc._BLOCK_TAGS else "")
        self.links += [(f"{tag}@{k}", v or "") for k in ("href", "src", "action") for n, v in attrs if n == k]

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template", "noscript", "svg", "iframe", "object"):
            self.skip -= 1
        self.out.append("\n" if tag in warc._BLOCK_TAGS else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if data == "\n" else data.replace("\n", " "))


def check(page, rows, url, html):
    metadata, conversion = sorted(rows, key=lambda r: r.kind, reverse=True)
    assert (metadata.kind, conversion.kind) == ("metadata", "conversion") and metadata.refers_to == conversion.refers_to and metadata.record_id != conversion.record_id
    payload = (html or "").encode()
    want = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    for r in rows:
        headers, block = warc.parse(bytes(r.record))
        headers = dict(headers)
        assert headers["WARC-Type"] == r.kind and headers["WARC-Refers-To"] == r.refers_to and headers["WARC-Target-URI"] == (url or "")
        assert headers["WARC-Block-Digest"] == r.block_digest == warc.digest(block) and int(headers["Content-Length"]) == r.content_length == len(block)
        assert bytes(r.record).endswith(b"\r\n\r\n") and r.source_payload_digest == want
    about = json.loads(warc.parse(bytes(metadata.record))[1])
    assert about["source"]["payload_digest"] == want and about["source"]["payload_digest_holds"] is True and about["http"]["status"] == "HTTP/1.1 200 OK"
    assert dict(about["source"]["headers"])["WARC-Record-ID"] == metadata.refers_to
    return about, warc.parse(bytes(conversion.record))[1].decode()


def test_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = {}
    for r in queries.op8_warc(spark, SMALL).collect():
        found.setdefault(r.page_id, []).append(r)
    assert found.keys() == pages.keys()
    for page, rows in found.items():
        about, text = check(page, rows, pages[page].url, pages[page].html)
        parser = Plain()
        parser.feed(pages[page].html)
        parser.close()
        assert text.split() == "".join(parser.out).split()
        assert [k for k, _ in parser.links] == [x["kind"] for x in about["html"]["links"]]


def test_odd_rows(spark):
    long = "<p>" + "a b<br>" * 100_000 + "<a \"" * 20_000 + "<!-- " * 20_000
    rows = [(1, "http://x/", None), (2, None, ""), (None, "http://y/\r\nX: y", "<title>T &amp; U</title><p>a&lt;b&gt; c</p><script>var t='</p>';</script><!-- no --><a href=\"/q?a=1&amp;b=2\">l</a>"),
            (3, "http://x/", long), (4, "http://z", "é <b>x</b>y <style>p{</style> z<script>open"), (4, "http://z", "é <b>x</b>y <style>p{</style> z<script>open")]
    df = spark.createDataFrame([(*r, "w", "k") for r in rows], "page_id long, url string, html string, warc string, kind string").repartition(2)
    got = {}
    for r in warc.derive(warc.responses(df)).collect():
        got.setdefault(r.page_id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {1: 2, 2: 2, None: 2, 3: 2, 4: 4}
    about, text = check(None, got[None], "http://y/  X: y", rows[2][2])
    assert about["html"]["title"] == "T & U" and about["html"]["links"][0]["url"].endswith("/q?a=1&b=2") and text == "T & U\na<b> c\nl"
    assert check(1, got[1], "http://x/", None)[1] == ""
    assert "é xy z" == check(4, [r for r in got[4] if r.kind == "metadata"][:1] + [r for r in got[4] if r.kind == "conversion"][:1], "http://z", rows[4][2])[1]
    assert warc.derive(warc.responses(df.where("false"))).count() == 0


def test_other_records():
    assert warc.derived(None) == [] and warc.derived(b"") == [] and warc.derived(b"no record") == []
    assert warc.derived(warc.build([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:x>")], b"GET / HTTP/1.1\r\n\r\n")) == []
    image = warc.derived(warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Payload-Digest", "sha1:WRONG")], b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\nabc"))
    assert [r["kind"] for r in image] == ["metadata"] and json.loads(warc.parse(image[0]["record"])[1])["source"]["payload_digest_holds"] is False
    latin = warc.derived(warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], b"HTTP/1.1 200 OK\nContent-Type: text/plain; charset=latin-1\n\n\xe9"))
    assert warc.parse(latin[1]["record"])[1].decode() == "é"
