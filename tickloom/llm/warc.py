"""WARC derivatives: linked metadata and plain-text conversion records for response records.

For every response two records are built: a ``metadata`` record (application/warc-fields: the source's record
id, date, digests, HTTP status and headers, the page's title and links) and a ``conversion`` record (the text of
an HTML or text payload, UTF-8). Both refer to the response by WARC-Refers-To, with its target URI and date
in WARC-Refers-To-Target-URI and WARC-Refers-To-Date, and carry digests of their own blocks; record ids follow
from the source's id, so a repeated run gives the same records. Digests are labelled sha256 in hex.

Text of HTML: comments, scripts, styles and templates go, block elements and line breaks end a line, other tags
go, character references are decoded, runs of white space are one space, empty lines go. The charset is the
HTTP header's, else UTF-8; undecodable bytes become U+FFFD.

Defined cases: a null block counts as empty; a payload that is neither HTML nor text gives no conversion; a
missing URI, date or digest leaves its header out (digests are computed); a malformed HTTP head counts as
payload without headers; tags that never end are kept as text, references are decoded as browsers do; repeated rows
give equal records; a null record id gives records without WARC-Refers-To; extra columns are not looked at.

Everything is map-only: one row in, at most two rows out.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from .common import lean

# HTML elements that begin and end a line.
_BLOCKS = "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol option p pre section table td tfoot th thead title tr ul"
_REST = r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*>"
_BREAK_HEAD, _TAG_HEAD = rf"</?(?:{_BLOCKS.replace(' ', '|')})(?=[\s/>])", r"<[/!?]?[a-zA-Z]"
_BREAK = re.compile(_BREAK_HEAD + _REST, re.I)
_TAG = re.compile(_TAG_HEAD + _REST + "|<![^>]*>")
_LINES = re.compile(r"\s*\n\s*")
_SPACES = re.compile(r"[^\S\n]+")
_GONE_HEAD = re.compile(r"<!--|<(script|style|template|noscript)\b", re.I)
_GONE_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "template", "noscript")}
_TITLE_HEAD, _TITLE_END = re.compile(r"<title\b", re.I), re.compile(r"</title\s*>", re.I)
_LINK_HEAD = re.compile(r"<a\b", re.I)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_STOPS = re.compile("[\"'>]")


def _ends(page: str):
    """A function that gives the place behind the tag that is open at a place, or -1: quoted parts are skipped.

    Places are to be asked for in order. Every quote and bracket is looked at once, however many tags never end.
    """
    known: dict[int, int] = {}
    near = (0, -1)  # where the text was last searched from, and the first stop from there

    def end(at: int) -> int:
        nonlocal near
        if at > near[1] or at < near[0]:
            stop = _STOPS.search(page, at)
            near = at, stop.start() if stop else len(page)
        at, passed = near[1], []
        while at not in known and at < len(page):
            passed.append(at)
            if page[at] == ">":
                known[at] = at + 1
                break
            close = page.find(page[at], at + 1)
            stop = _STOPS.search(page, close + 1) if close >= 0 else None
            at = stop.start() if stop else len(page)
        found = known.get(at, -1)
        known.update((x, found) for x in passed)
        return found

    return end


def _without(page: str, head: re.Pattern, by: str) -> str:
    """The page with ``by`` for every tag that begins with ``head``; <! may also go up to the next bracket."""
    end, out, at, kept, last = _ends(page), [], 0, 0, page.rfind(">")
    while (m := head.search(page, at)) and m.start() < last:
        stop = end(m.end()) if m[0] != "<!" else -1
        if stop < 0 and m[0].startswith("<!"):
            stop = page.find(">", m.start()) + 1
        at = m.start() + 1
        if stop > 0:
            out += [page[kept : m.start()], by]
            at = kept = stop
    return "".join([*out, page[kept:]])


def _gone(page: str) -> str:
    """The page without comments, scripts, styles and templates."""
    out, at, kept = [], 0, 0
    while m := _GONE_HEAD.search(page, at):
        if m[1] is None:
            stop = page.find("-->", m.end())
            stop = stop + 3 if stop >= 0 else len(page)
        else:
            begin = page.find(">", m.end())
            if begin < 0:  # no tag ends from here, only comments go
                at = page.find("<!--", m.end())
                if at < 0:
                    break
                continue
            close = _GONE_END[m[1].lower()].search(page, begin + 1)
            stop = close.end() if close else len(page)
        out.append(page[kept : m.start()])
        at = kept = stop
    return "".join([*out, page[kept:]])


def _title(page: str) -> str | None:
    """What stands in the first title element that ends."""
    head = _TITLE_HEAD.search(page)
    begin = page.find(">", head.end()) if head else -1
    close = _TITLE_END.search(page, begin + 1) if begin >= 0 else None
    return page[begin + 1 : close.start()] if close else None


def _links(page: str) -> list[str]:
    """The href of every link, in order."""
    out, at, bracket = [], 0, -1
    href = _HREF.search(page)
    while href and (head := _LINK_HEAD.search(page, at)):
        if href.start() < head.end():
            href = _HREF.search(page, head.end())
            continue
        if bracket < head.end() and bracket < len(page):
            bracket = page.find(">", head.end())
            bracket = len(page) if bracket < 0 else bracket
        if href.start() < bracket:
            out.append(href[1] or href[2] or href[3] or "")
            at = href.end()
        else:
            at = head.end()
    return out


def text_of(page: str) -> str:
    """Plain text of an HTML page, in time that is linear in the page's length."""
    page = _SPACES.sub(" ", _gone(page).replace("\n", " "))
    if page.count("<") * len(page) <= 1 << 24:  # the same by two expressions: what they may look at again is bounded
        page = _TAG.sub("", _BREAK.sub("\n", page))
    else:
        page = _without(_without(page, re.compile(_BREAK_HEAD, re.I), "\n"), re.compile(_TAG_HEAD + "|<!"), "")
    text = html.unescape(page).replace("\xa0", " ")
    return _LINES.sub("\n", _SPACES.sub(" ", text)).strip()


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status, headers in order and payload of an HTTP response message."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, sep, v in (x.partition(":") for x in lines) if sep]
    return first.partition(" ")[2], headers, payload


def digest(block: bytes) -> str:
    return f"sha256:{hashlib.sha256(block).hexdigest()}"


def record_id(*parts: str) -> str:
    """A urn:uuid that follows from the parts."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(parts).encode()).digest())}>"


def derive_one(source: str | None, uri: str | None, date: str | None, block: bytes | None, block_digest: str | None, payload_digest: str | None) -> list[dict]:
    """The records of one response."""
    status, headers, payload = http_parts(block or b"")
    own = {"block": block_digest or digest(block or b""), "payload": payload_digest or digest(payload)}
    kind = next((v for k, v in headers if k.lower() == "content-type"), "text/html")
    charset = re.search(r"charset\s*=\s*\"?([\w.:-]+)", kind, re.I)
    try:
        body = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        body = payload.decode("utf-8", "replace")
    media = kind.partition(";")[0].strip().lower()
    is_html = media in ("text/html", "application/xhtml+xml")
    fields = [("source-record-id", source), ("source-date", date), ("source-block-digest", own["block"]), ("source-payload-digest", own["payload"]), ("http-status", status)]
    fields += [(f"http-header-{k.lower()}", v) for k, v in headers]
    if is_html:
        fields.append(("title", " ".join(html.unescape(_title(body) or "").split())))
        fields += [("outlink", " ".join(html.unescape(x).split())) for x in _links(_gone(body))]
    metadata = "".join(f"{k}: {v}\r\n" for k, v in fields if v).encode()
    out = [("metadata", "application/warc-fields", metadata)]
    if is_html or media.startswith("text/"):
        out.append(("conversion", "text/plain; charset=utf-8", (text_of(body) if is_html else body).encode()))
    rows = []
    for what, media, content in out:
        named = [
            ("WARC-Type", what), ("WARC-Record-ID", record_id(what, source or "", own["block"])), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri if source else None), ("WARC-Refers-To-Date", date if source else None),
            ("WARC-Block-Digest", digest(content)), ("Content-Type", media), ("Content-Length", str(len(content))),
        ]
        rows.append({"record_type": what, "headers": [{"name": k, "value": v} for k, v in named if v], "block": content, "source_block_digest": own["block"], "source_payload_digest": own["payload"]})
    return rows


def derive(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Derived records of responses (record_id, target_uri, date, block; block_digest and payload_digest if there).

    Gives the ``keep`` columns, record_type, headers (name, value, in order), block, and the source's digests.
    """
    kept = keep or []
    given = [F.col(c) if c in responses.columns else F.lit(None) for c in ("record_id", "target_uri", "date", "block", "block_digest", "payload_digest")]
    kinds = ["string", "string", "string", "binary", "string", "string"]
    rows = responses.select(*kept, *[c.cast(k).alias(f"__{i}") for i, (c, k) in enumerate(zip(given, kinds, strict=True))])
    header = StructType().add("name", "string").add("value", "string")
    schema = StructType([rows.schema[c] for c in kept]).add("record_type", StringType()).add("headers", ArrayType(header))
    schema = schema.add("block", BinaryType()).add("source_block_digest", StringType()).add("source_payload_digest", StringType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                made = [derive_one(*x) for x in zip(*(c.to_pylist() for c in part.columns[len(kept) :]), strict=True)]
                owner = pa.array([j for j, rows in enumerate(made) for _ in rows], pa.int64())
                flat = [r for rows in made for r in rows]
                columns = [part.column(j).take(owner) for j in range(len(kept))]
                columns += [pa.array([r[f.name] for r in flat], f.type) for f in list(arrow)[len(kept) :]]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(lean(run), schema)


def header(name: str):
    """A named header of ``derive``'s rows."""
    return F.element_at(F.filter("headers", lambda h: h["name"] == name)["value"], 1)


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Response records for a table of pages: an HTTP message around each page, ids from page id and url."""
    body = F.coalesce(F.col(page), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    md5 = F.md5(F.concat_ws("|", F.lit("response"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit(""))).cast("binary"))
    parts = [F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    name = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))
    return pages.select(
        F.col(page_id).alias("page_id"), name.alias("record_id"), F.col(url).alias("target_uri"), F.lit(date).alias("date"),
        F.concat(head.cast("binary"), body).alias("block"),
    )


def serialised(headers: list, block: bytes) -> bytes:
    """One record as it stands in a WARC file."""
    head = "".join(f"{h['name']}: {h['value']}\r\n" for h in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, path: str, records_per_file: int = 100_000) -> None:
    """WARC files under a folder, by Spark's text writer: the two line ends behind a record are its separator.

    Blocks are text (derived records are), a null one is empty; files are bounded by their number of records and not
    compressed.
    """
    head = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), "")
    line = F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), F.coalesce(F.col("block").cast("string"), F.lit("")))
    records.select(line.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[list[dict] | None, bytes]]:
    """Headers and block of every record in a file's bytes, plain or in gzip members.

    Bytes that are no record, up to the next one that begins a line, come as a block without headers (None).
    """
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error):
            yield None, data
            return
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if end >= 0 else []
        headers = [{"name": k.strip(), "value": v.strip()} for k, _, v in (x.partition(":") for x in lines)]
        size = next((h["value"] for h in headers if h["name"].lower() == "content-length"), "0")
        if end < 0 or not re.fullmatch("[0-9]{1,18}", size) or end + 4 + int(size) > len(data):
            stop = data.find(b"\nWARC/", at)
            stop = len(data) if stop < 0 else stop + 1
            yield None, data[at:stop]
            at = stop
            continue
        at = end + 4 + int(size)
        yield headers, data[end + 4 : at]
        while data[at : at + 2] == b"\r\n":
            at += 2


def read(spark, path: str) -> DataFrame:
    """Records (headers, block) of the WARC files under a path; a file is one task's, so files are to be bounded.

    What is no record in a file is a row with null headers; the records around it are read all the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        for batch in batches:
            for data in batch.column(0):
                rows = list(parse(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], kind), pa.array([b for _, b in rows], pa.binary())], names=["headers", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lean(run), "headers array<struct<name:string,value:string>>, block binary")
