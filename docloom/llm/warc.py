"""Derivative records from WARC responses: linked metadata (JSON) and plain-text conversions.

Every response gives two records that refer to it by its record id (WARC-Refers-To) and to each other
(WARC-Concurrent-To). The metadata record keeps the response's WARC header, its digests, the HTTP status and headers as
they came, and the page's title, metas and links; the conversion record is the page's text. It is one pass over the
responses without a shuffle. Files are read and written by Spark's own text source, so any file system will do: records
are read one by one out of a stream, and each is written as a gzip member of its own, which can be read at its offset.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of records that a task holds before it hands them on.
HELD = 1 << 23

RESPONSE = "record_id string, target_uri string, date string, warc_headers string, http_status int, http_headers string, payload binary, block_digest string, payload_digest string"
RECORD = "record_id string, record_type string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, content_length bigint, block_digest string, source_payload_digest string, link_count int, block string"

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: Where a tag ends, or a quoted value starts in which it doesn't.
_TAG_END = re.compile(r"=[ \t\r\n\f]*([\"'])|>")
#: Elements whose content is not part of the page, each with its end.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "noscript", "template")}
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
#: Attributes that hold links, by element.
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "form": "action"}
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str) -> str:
    """A record id that follows from parts, so a task that runs again gives the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def _after_tag(page: str, at: int) -> int:
    """The place after the tag whose inside goes on at `at`; the page's end if it has none, as browsers have it."""
    while m := _TAG_END.search(page, at):
        if not m[1]:
            return m.end()
        at = page.find(m[1], m.end()) + 1
        if not at:
            break
    return len(page)


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of every piece of markup, in one pass.

    Comments and declarations have no name; scripts and the like end after their closing tag.
    """
    at = 0
    while (start := page.find("<", at)) >= 0:
        m = _NAME.match(page, start)
        if m:
            name, closes = m[1].lower(), page[start + 1] == "/"
            at = _after_tag(page, m.end())
            told = page[m.end() : at - 1] if page[at - 1 : at] == ">" else page[m.end() : at]
            if name in _RAW and not closes:
                end = _RAW[name].search(page, at)
                at = _after_tag(page, end.end()) if end else len(page)
            yield start, at, name, closes, told
        elif page.startswith("<!--", start):
            at = page.find("-->", start + 4) + 3
            at = at if at > 2 else len(page)
            yield start, at, "", False, ""
        elif page.startswith(("<!", "<?", "</"), start):
            at = page.find(">", start) + 1 or len(page)
            yield start, at, "", False, ""
        else:  # a bare character
            at = start + 1


def extract(page: str) -> tuple[str, str | None, list[dict[str, str]], list[dict[str, str]]]:
    """(text, title, metas, links) of a page: a line for each block, blanks collapsed, scripts and comments left out.

    Time is linear in the page, whatever it holds; a tag that is never closed takes the rest of the page.
    """
    out, metas, links, at = [], [], [], 0
    title, in_title, anchor = None, None, None
    for start, end, name, closes, told in _tokens(page):
        if start > at:
            out.append(page[at:start])
        at = end
        if not name:
            continue
        if name in _BREAKS:
            out.append("\n")
        if closes:
            if name == "title" and in_title is not None and title is None:
                title = " ".join(html.unescape("".join(out[in_title:])).split())
                in_title = None
            elif name == "a" and anchor is not None:
                anchor[0]["text"] = " ".join(html.unescape("".join(out[anchor[1] :])).split())
                anchor = None
            continue
        if name == "title" and title is None and in_title is None:
            in_title = len(out)
        elif name == "meta" or name in _LINKS:
            held = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(told)}
            if name == "meta":
                metas.append(held)
            elif _LINKS[name] in held:
                links.append({"path": f"{name.upper()}@/{_LINKS[name]}", "url": held[_LINKS[name]]})
                if name == "a":
                    anchor = (links[-1], len(out))
    out.append(page[at:])
    lines = (_BLANKS.sub(" ", x).strip() for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), title, metas, links


def responses_of(df: DataFrame, id_col: str, url_col: str, html_col: str, date: str) -> DataFrame:
    """Response records for a table of pages: the page's id is in the record id, its text in UTF-8 is the payload.

    A null page is an empty payload, a null URL stays null.
    """
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    identity = F.concat_ws("\0", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit("")), F.sha1(payload))
    h = F.sha1(identity)
    rid = F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])
    headers = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    none = F.lit(None).cast("string")
    return df.select(F.col(id_col), rid.alias("record_id"), F.col(url_col).cast("string").alias("target_uri"), F.lit(date).alias("date"), none.alias("warc_headers"), F.lit(200).alias("http_status"), headers.alias("http_headers"), payload.alias("payload"), none.alias("block_digest"), none.alias("payload_digest"))


def _headers(lines: str | None) -> list[tuple[str, str]]:
    return [(k.strip(), v.strip()) for k, found, v in (x.partition(":") for x in (lines or "").split("\r\n")) if found]


def _value(headers: list[tuple[str, str]], name: str) -> str | None:
    """The first value of a header; names are compared without case."""
    return next((v for k, v in headers if k.lower() == name), None)


def _charset(headers: list[tuple[str, str]], payload: bytes) -> str:
    said = (_value(headers, "content-type") or "") + " " + payload[:1024].decode("latin-1")
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", said, re.I)
    try:
        "".encode(m[1] if m else "utf-8")
    except LookupError:
        return "utf-8"
    return m[1] if m else "utf-8"


def _joined(data: bytes) -> bytes:
    """The body that was sent in chunks; what follows a chunk that is cut off or has no size is left out."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        size = re.fullmatch(rb"\s*([0-9a-fA-F]{1,15})\s*(?:;.*)?", data[at:end], re.S)
        n = int(size[1], 16) if size else 0
        if not n:
            break
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def _inflated(data: bytes, kind: str) -> bytes:
    """An unpacked body, as far as it can be; deflate comes with or without a head. gzip may have several members."""
    out = []
    while data:
        unpack = zlib.decompressobj(31 if kind == "gzip" else 15 if data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0 else -15)
        try:
            out += [unpack.decompress(data), unpack.flush()]
        except zlib.error:
            break
        data = unpack.unused_data if kind == "gzip" else b""
    return b"".join(out)


def body(headers: list[tuple[str, str]], payload: bytes) -> bytes | None:
    """The page that a payload holds: chunks joined, gzip and deflate undone; None for an encoding that isn't known.

    Crawlers often keep headers of what they have undone already: a body that doesn't look encoded is taken as it is.
    """
    if "chunked" in (_value(headers, "transfer-encoding") or "").lower() and re.match(rb"\s*[0-9a-fA-F]{1,15}\s*(?:;[^\r\n]*)?\r\n", payload):
        payload = _joined(payload)
    for kind in reversed([x.strip().lower().removeprefix("x-") for x in (_value(headers, "content-encoding") or "").split(",")]):
        if kind == "gzip" and payload[:2] == b"\x1f\x8b" or kind == "deflate" and _inflated(payload, kind):
            payload = _inflated(payload, kind)
        elif kind not in ("", "identity", "gzip", "deflate"):
            return None
    return payload


#: Types of a page that is marked up, and beginnings of those that are text.
_MARKUP = frozenset(("text/html", "application/xhtml+xml", "application/xml", "text/xml"))
_TEXT = ("text/", "application/json", "application/javascript")


def _kind(headers: list[tuple[str, str]], page: bytes) -> str:
    """markup, text or other; without a type, what holds no zero byte counts as markup."""
    said = (_value(headers, "content-type") or "").partition(";")[0].strip().lower()
    if not said:
        return "other" if b"\0" in page[:1024] else "markup"
    return "markup" if said in _MARKUP or said.endswith("+xml") and said != "image/svg+xml" else "text" if said.startswith(_TEXT) else "other"


def derive(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two rows for each response, of type metadata and conversion (see RECORD), after the columns named in keep.

    The metadata record holds all headers of the response, WARC's and HTTP's, in their order, repeated ones included.
    Chunked, gzip and deflate bodies are undone before they are read; digests are those of the bytes as they came. Markup
    becomes text, other text types stay as they are; a response of another type, or in an encoding that isn't known, has
    a metadata record alone, concurrent with none.

    Digests that a response lacks are worked out from its bytes; those it has are kept. A null payload counts as empty:
    its conversion is an empty block. Bytes that the page's character set does not cover become U+FFFD. Repeated
    responses give repeated records; an empty table gives no rows; other columns are not read.
    """
    keep = keep or []
    own = [f.strip().split(" ")[0] for f in RESPONSE.split(",")]
    held = [f"held_{k}" for k in range(len(keep))]
    wanted = responses.select(*[F.col(c) for c in own], *[F.col(c).alias(h) for c, h in zip(keep, held)])

    names = [f.strip().split(" ")[0] for f in RECORD.split(",")]
    types = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def records(r: dict) -> Iterator[tuple]:
        payload = r["payload"] or b""
        http, warc = _headers(r["http_headers"]), _headers(r["warc_headers"])
        page = body(http, payload)
        kind = "other" if page is None else _kind(http, page)
        page = b"" if page is None else page
        text, title, metas, links = "", None, [], []
        if kind == "markup":
            text, title, metas, links = extract(page.decode(_charset(http, page), "replace"))
        elif kind == "text":
            text = page.decode(_charset(http, page), "replace")
        source = r["payload_digest"] or digest(payload)
        head = f"HTTP/1.1 {r['http_status']}\r\n{r['http_headers'] or ''}\r\n\r\n".encode()
        known = [("WARC-Type", "response"), ("WARC-Record-ID", r["record_id"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["date"])]
        whole = {
            "Envelope": {
                "WARC-Header-Metadata": dict(known) | dict(reversed(warc)),
                "WARC-Headers": warc or known,
                "Block-Digest": r["block_digest"] or digest(head + payload),
                "Payload-Metadata": {
                    "Payload-Digest": source,
                    "Payload-Length": len(payload),
                    "Body-Length": len(page),
                    "HTTP-Response-Metadata": {"Status": r["http_status"], "Headers": http, "HTML-Metadata": {"Title": title, "Metas": metas, "Links": links}},
                },
            }
        }
        ids = [urn(r["record_id"] or "", name) for name in ("metadata", "conversion")]
        made = [("metadata", "application/json", json.dumps(whole, ensure_ascii=False)), ("conversion", "text/plain", text)][: 1 if kind == "other" else 2]
        for k, (name, content, block) in enumerate(made):
            data = block.encode("utf-8", "replace")
            yield (ids[k], name, r["record_id"], ids[1 - k] if len(made) == 2 else None, r["target_uri"], r["date"], content, len(data), digest(data), source, len(links), data.decode())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places, size = [], [], 0
            for k in range(b.num_rows):
                for found in records(b.slice(k, 1).select(own).to_pylist()[0]):
                    rows.append(found)
                    places.append(k)
                    size += found[7]
                if rows and (size >= HELD or k == b.num_rows - 1):
                    kept = [b.column(h).take(pa.array(places, pa.int64())) for h in held]
                    yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], [*held, *names])
                    rows, places, size = [], [], 0

    from pyspark.sql import types as T

    schema = T.StructType([*[T.StructField(h, wanted.schema[h].dataType) for h in held], *T._parse_datatype_string(RECORD).fields])
    out = wanted.mapInArrow(each, schema)
    return out.select(*[F.col(h).alias(c) for c, h in zip(keep, held)], *[f.name for f in schema.fields[len(held) :]])


def record_text(df: DataFrame) -> Column:
    """A record as WARC text, without the two line ends that close it. The payload digest is the source's."""
    line = lambda name, c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n")))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\n"),
        line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Concurrent-To", "concurrent_to"),
        line("WARC-Target-URI", "target_uri"), line("WARC-Date", "date"), line("WARC-Block-Digest", "block_digest"),
        line("WARC-Payload-Digest", "source_payload_digest"), line("Content-Type", "content_type"),
        F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"), F.col("block"),
    )


#: A gzip member of nothing.
_NOTHING = gzip.compress(b"", mtime=0)


def _member(record: str) -> bytes:
    """A gzip member of the record, without its last byte, which is zero.

    That byte is the high one of the length; after a record of 16 MB or more a member of nothing follows.
    """
    packed = gzip.compress(record.encode("utf-8", "surrogatepass") + b"\r\n\r\n", mtime=0)
    return packed[:-1] if not packed[-1] else packed + _NOTHING[:-1]


def write_warc(records: DataFrame, path: str) -> None:
    """Files of WARC records under path, one for each partition, named *.warc.gz: each record is a gzip member.

    Members are bytes that the text writer passes through; the zero byte that ends each is its line separator.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                yield pa.RecordBatch.from_arrays([pa.array([_member(x) for x in b.column(0).slice(k, 64).to_pylist()], pa.binary())], ["value"])

    spark = records.sparkSession
    packed = records.select(record_text(records).alias("value")).mapInArrow(each, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in system.listStatus(folder):  # names only
        name = found.getPath().getName()
        if name.endswith(".txt"):
            system.rename(found.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ".warc.gz"))


_MARK = b"WARC/1."


class _Records:
    """Records out of the stretches between marks. A block that holds a mark goes on in the next stretch."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.missing = 0

    def add(self, stretch: bytes) -> tuple[list[tuple[str, str]], bytes] | None:
        """The record that is complete with this stretch."""
        if self.parts:
            self.parts.append(_MARK + stretch)
            self.missing -= len(_MARK) + len(stretch)
        else:
            end = stretch.find(b"\r\n\r\n")
            if end < 0:
                return None  # what stands before the first mark
            n = _value(_headers(stretch[:end].decode("utf-8", "replace")), "content-length") or "0"
            self.parts, self.missing = [stretch], end + 4 + (int(n) if n.isdigit() else 0) - len(stretch)
        if self.missing > 0:
            return None
        data, self.parts = b"".join(self.parts), []
        top, _, block = data.partition(b"\r\n\r\n")
        head = _headers(top.decode("utf-8", "replace").partition("\r\n")[2])
        n = _value(head, "content-length") or "0"
        return head, block[: int(n) if n.isdigit() else 0]


def parse_warc(stretches: Iterator[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(header, block) of each record, from what stands between the marks of a file, in its order.

    A record that the file cuts off is left out.
    """
    open_record = _Records()
    for stretch in stretches:
        if found := open_record.add(stretch):
            yield found


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records (see RESPONSE) of the WARC files at path, packed by record, as a whole, or not at all.

    The text reader unpacks a file as a stream and hands out what stands between marks, so a task holds a few records
    and not the file. A file that isn't packed may be read in parts by several tasks; a mark inside a block is told
    from a record's unless a part begins between the two.
    """
    names = [f.strip().split(" ")[0] for f in RESPONSE.split(",")]
    types = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.binary(), pa.string(), pa.string()]

    def response(head: list[tuple[str, str]], block: bytes) -> tuple:
        top, _, payload = block.partition(b"\r\n\r\n")
        status, _, lines = top.decode("latin-1").partition("\r\n")
        code = re.match(r"HTTP/\S+ (\d+)", status)
        told = [_value(head, f"warc-{name}") for name in ("record-id", "target-uri", "date", "block-digest", "payload-digest")]
        return (*told[:3], "\r\n".join(f"{k}: {v}" for k, v in head), int(code[1]) if code else None, lines, payload, told[3] or digest(block), told[4] or digest(payload))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, own, rows, size = None, _Records(), [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for b in batches:
            for at, stretch in zip(b.column(0), b.column(1)):
                if at.as_py() != file:
                    file, own = at.as_py(), _Records()
                found = own.add(stretch.as_py())
                if found and (_value(found[0], "warc-type") or "").lower() == "response":
                    rows.append(response(*found))
                    size += len(found[1])
                    if size >= HELD:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    part = F.concat_ws(" ", F.col("_metadata.file_path"), F.col("_metadata.file_block_start").cast("string"))
    return spark.read.option("lineSep", _MARK.decode()).text(path).select(part.alias("file"), F.col("value").cast("binary").alias("stretch")).mapInArrow(each, RESPONSE)
