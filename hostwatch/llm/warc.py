"""Derived WARC records: a metadata record and a plain-text conversion record for each response, linked to it.

A row holds one WARC record as bytes.  Every response gives a metadata record (JSON: the source's WARC and HTTP headers and
digests, title, meta tags and links) and, if its payload is HTML or plain text, a conversion record.  Both carry
``WARC-Refers-To`` with the response's identifier, its target and date.  Identifiers follow from the response's, so a
task that runs again writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from functools import lru_cache
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

VERSION = "WARC/1.1"
#: Given to records made from a table without dates.
EPOCH = "1970-01-01T00:00:00Z"

#: Comments, elements whose content is no text, tags with quoted attributes, declarations; unclosed ones reach to the end.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|iframe|object)\b(?>[^>]*)(?:>.*?(?:</\1\s*>|\Z)|\Z)"
                     r"|<(/?)([a-z][a-z0-9:-]*)((?>(?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*'|[\"'])*+))>|<[!?](?>[^>]*)(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-z_:][-a-z0-9_:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BLOCK_TAGS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre "
                        "section table tbody td tfoot th thead title tr ul".split())
_LINK_ATTRIBUTES = ("href", "src", "action")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record; the length of its block is added to its headers."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    first, *lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).replace("\r\n", "\n").split("\n")
    return first, [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines) if k.strip()]


def _split(data: bytes) -> tuple[bytes, bytes]:
    found = re.search(rb"\r?\n\r?\n", data)
    return (data[:found.start()], data[found.end():]) if found else (data, b"")


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes] | None:
    """Headers and block of a record, or None if the bytes are no WARC record."""
    head, rest = _split(record)
    first, headers = _fields(head)
    if not first.startswith("WARC/"):
        return None
    length = next((v for k, v in headers if k.lower() == "content-length"), "")
    return headers, rest[:int(length)] if length.isdigit() else rest


def text_of(source: str) -> tuple[str, str, list[tuple[str, str]], list[tuple[str, str]]]:
    """Plain text, title, links (kind, address) and meta tags of an HTML source."""
    out, links, metas, at, title_from, title = [], [], [], 0, None, ""
    source = source.replace("\0", " ")  # zero marks where lines end
    for m in _MARKUP.finditer(source):
        out.append(source[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in _BLOCK_TAGS:
            out.append("\0")
        if tag == "title":
            if not m[2]:
                title_from = len(out)
            elif title_from is not None:
                title = title or " ".join(html.unescape("".join(out[title_from:]).replace("\0", " ")).split())
                title_from = None
        if m[4] and not m[2]:
            attributes = {a[1].lower(): html.unescape(next((v for v in a.groups()[1:] if v is not None), "")) for a in _ATTRIBUTE.finditer(m[4])}
            links += [(f"{tag}@{k}", attributes[k]) for k in _LINK_ATTRIBUTES if k in attributes]
            if tag == "meta":
                name = attributes.get("name") or attributes.get("property") or attributes.get("http-equiv")
                metas += [(name, attributes["content"])] if name and "content" in attributes else [("charset", attributes["charset"])] if "charset" in attributes else []
    out.append(source[at:])
    lines = (" ".join(line.split()) for line in "".join(out).split("\0"))
    return html.unescape("\n".join(line for line in lines if line)), title, links, metas


@lru_cache(4096)
def _resolved(base: str, address: str) -> str:
    if address.startswith(("http://", "https://")) and "/." not in address:
        return address
    try:
        return urljoin(base, address)
    except ValueError:
        return address


def _charset(content_type: str) -> str:
    import codecs

    named = re.search(r"charset\s*=\s*\"?([\w.:-]+)", content_type, re.I)
    try:
        return codecs.lookup(named[1]).name if named else "utf-8"
    except LookupError:
        return "utf-8"


def derived(record: bytes | None) -> list[dict]:
    """The records derived from one; none from other types, from bytes that are no record, and from null."""
    parsed = parse(record) if record else None
    if parsed is None:
        return []
    headers, block = parsed
    of = {k.lower(): v for k, v in reversed(headers)}
    if of.get("warc-type") != "response":
        return []
    http_head, payload = _split(block)
    status, http = _fields(http_head)
    content_type = next((v for k, v in http if k.lower() == "content-type"), "")
    kind = content_type.partition(";")[0].strip().lower()
    uri, date, source_id, payload_digest = of.get("warc-target-uri", ""), of.get("warc-date", EPOCH), of.get("warc-record-id", ""), digest(payload)
    body = payload.decode(_charset(content_type), "replace")
    text, title, links, metas = text_of(body) if kind in ("text/html", "application/xhtml+xml", "") else (body if kind.startswith("text/") else None, "", [], [])
    about = {"source": {"headers": headers, "block_digest": digest(block), "payload_digest": payload_digest,
                        "payload_digest_holds": of["warc-payload-digest"] == payload_digest if "warc-payload-digest" in of else None, "payload_length": len(payload)},
             "http": {"status": status, "headers": http},
             "html": {"title": title, "metas": metas, "links": [{"kind": k, "url": _resolved(uri, u)} for k, u in links]}}
    blocks = [("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace"))]
    if text is not None:
        blocks.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    out = []
    for name, its_type, data in blocks:
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source_id}#{name}')}>"
        fields = [("WARC-Type", name), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Refers-To", source_id), ("WARC-Target-URI", uri),
                  ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Block-Digest", digest(data)), ("Content-Type", its_type)]
        out.append({"kind": name, "record_id": own, "refers_to": source_id, "target_uri": uri, "warc_date": date, "content_type": its_type,
                    "source_payload_digest": payload_digest, "block_digest": digest(data), "content_length": len(data), "record": build(fields, data)})
    return out


_TEXTS = ("kind", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "source_payload_digest", "block_digest")
_SCHEMA = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in _TEXTS), ("content_length", pa.int64()), ("record", pa.binary())])


def derive(records: DataFrame) -> DataFrame:
    """One row per derived record of ``records`` (page_id, warc: one record as bytes; more columns are ignored).

    Rows that hold no response give none.  Repeated rows are the same response and give the same records again.
    """
    def run(batches):
        for batch in batches:
            rows = [{"page_id": page, **d} for page, record in zip(batch.column(0).to_pylist(), batch.column(1)) for d in derived(record.as_py())]
            for at in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_pylist(rows[at:at + 1024], schema=_SCHEMA)

    sql = "page_id long, " + ", ".join(f"{c} string" for c in _TEXTS) + ", content_length long, record binary"
    return records.select("page_id", "warc").mapInArrow(run, sql)


def responses(pages: DataFrame, date: str = EPOCH) -> DataFrame:
    """``page_id, warc``: each row of ``pages`` (page_id, url, html; more columns are ignored) as the bytes of a response record.

    Null html is an empty payload, a null url an empty target.
    """
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for page, url, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    payload, url = (source.as_py() or "").encode("utf-8", "surrogatepass"), re.sub(r"[\r\n]", " ", url or "")
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{page}|{url}|{digest(payload)}")
                    out.append(build([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", date), ("WARC-Target-URI", url),
                                      ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)),
                                      ("Content-Type", "application/http; msgtype=response")], block))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["page_id", "warc"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, warc binary")
