"""WARC derivatives: responses become linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces
from .token_files import _place, _publish

VERSION = "WARC/1.1"
#: Date of responses made from pages, which carry none.
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*")
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
#: Elements whose content is not text, and elements that begin a line.
_HIDDEN = {n: re.compile(f"</{n}", re.I) for n in ("script", "style", "noscript", "template", "svg", "iframe")}
_BLOCK = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html li main nav ol option p pre section table tbody td th thead title tr ul".split()
)
_SPACE = re.compile(r"[^\S\n]+")


def html_to_text(page: str) -> tuple[str, str | None, str | None, list[str]]:
    """Text, title, language and link targets of a whole page, in one pass over its tags.

    Comments, scripts and the like go; entities are resolved; block elements begin lines; runs of
    white space are one space and empty lines go. Unclosed comments and scripts run to the end; a
    '<' that opens no tag is text.
    """
    out: list[str] = []
    links: list[str] = []
    title = lang = None
    title_at = None
    i, n, quoted = 0, len(page), True
    while i < n:
        j = page.find("<", i)
        if j < 0:
            out.append(page[i:])
            break
        out.append(page[i:j])
        if page.startswith("<!--", j):
            k = page.find("-->", j + 4)
            i = n if k < 0 else k + 3
            continue
        m = _TAG.match(page, j)
        if not m:
            if page.startswith(("<!", "<?"), j):
                k = page.find(">", j)
                i = n if k < 0 else k + 1
            else:
                out.append("<")
                i = j + 1
            continue
        k = _REST.match(page, m.end()).end() if quoted else n
        if k >= n or page[k] != ">":
            quoted = False  # no end outside quotes from here on: look no further for quotes
            k = page.find(">", m.end())
            k = n if k < 0 else k
        rest, i = page[m.end() : k], k + 1
        name, closing = m[2].lower(), bool(m[1])
        if name in _BLOCK:
            out.append("\n")
        if name == "title":
            if not closing and title is None:
                title_at = len(out)
            elif closing and title_at is not None:
                title, title_at = " ".join(html_lib.unescape("".join(out[title_at:])).split()), None
        elif closing:
            continue
        elif name == "html" and lang is None and (found := _LANG.search(rest)):
            lang = found[1]
        elif name == "a" and (found := _HREF.search(rest)):
            links.append(html_lib.unescape(found[1] or found[2] or found[3] or "").strip())
        elif name in _HIDDEN and not rest.rstrip().endswith("/"):
            end = _HIDDEN[name].search(page, i)
            i = end.start() if end else n
    lines = (_SPACE.sub(" ", x).strip() for x in html_lib.unescape("".join(out)).replace("\r", "\n").split("\n"))
    return "\n".join(x for x in lines if x), title, lang, [x for x in links if x]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '|'.join(names))}>"


def _safe(value: str) -> str:
    """A header value: line ends cannot break out of it."""
    return " ".join(value.split())


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_safe(v)}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers (in order, folded lines joined) and payload of a response block."""
    cut = min((p, len(s)) if (p := block.find(s)) >= 0 else (len(block), 0) for s in (b"\r\n\r\n", b"\n\n"))
    lines = block[: cut[0]].decode("latin-1").replace("\r\n", "\n").split("\n")
    headers: list[tuple[str, str]] = []
    for x in lines[1:]:
        if x[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {x.strip()}")
        elif ":" in x:
            name, value = x.split(":", 1)
            headers.append((name.strip(), value.strip()))
    return lines[0], headers, block[sum(cut) :]


def decoded(payload: bytes, content_type: str) -> tuple[str, str]:
    found = _CHARSET.search(content_type) or _CHARSET.search(payload[:2048].decode("latin-1"))
    for charset in ([found[1]] if found else []) + ["utf-8"]:
        try:
            return payload.decode(charset), charset.lower()
        except (LookupError, UnicodeDecodeError):
            pass
    return payload.decode("utf-8", "replace"), "utf-8"


def derive_one(source_id: str, uri: str | None, date: str, block: bytes | None) -> list[tuple[str, str, list[tuple[str, str]], bytes]]:
    """(type, record id, headers, block) of the metadata and, for textual payloads, the conversion record."""
    status, headers, payload = parse_http(block or b"")
    kind = next((v for k, v in headers if k.lower() == "content-type"), "text/html" if payload else "")
    meta_id, text_id = record_id(source_id, "metadata"), record_id(source_id, "conversion")
    about = [("WARC-Refers-To", source_id), *([("WARC-Target-URI", uri), ("WARC-Refers-To-Target-URI", uri)] if uri else []), ("WARC-Refers-To-Date", date)]
    fields = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in headers), ("payload-digest", digest(payload)), ("payload-length", str(len(payload)))]
    text = None
    if not payload or re.match(r"text/|application/xhtml", kind, re.I):
        page, charset = decoded(payload, kind)
        title = lang = None
        links: list[str] = []
        text = page
        if not re.match(r"text/plain", kind, re.I):
            text, title, lang, links = html_to_text(page)
        fields += [("charset", charset), *([("title", title)] if title else []), *([("language", lang)] if lang else []), *(("outlink", x) for x in links)]
        fields.append(("conversion", text_id))
    meta = "".join(f"{k}: {_safe(v)}\r\n" for k, v in fields).encode()
    out = [("metadata", meta_id, [*about, ("Content-Type", "application/warc-fields")], meta)]
    if text is not None:
        own = [*about, ("WARC-Concurrent-To", meta_id), ("WARC-Source-Payload-Digest", digest(payload)), ("Content-Type", "text/plain; charset=utf-8")]
        out.append(("conversion", text_id, own, text.encode("utf-8", "replace")))
    return [(t, i, [("WARC-Type", t), ("WARC-Record-ID", i), ("WARC-Date", date), *h, ("WARC-Block-Digest", digest(b))], b) for t, i, h, b in out]


def _derive(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "block"):
            rows = [batch.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "block")]
            at, made = [], []
            for k, (i, u, d, b) in enumerate(zip(*rows, strict=True)):
                for t, own, headers, block in derive_one(i, u, d, b):
                    at.append(k)
                    made.append((own, t, i, u, len(block), digest(block), serialize(headers, block)))
            cols = list(zip(*made, strict=True)) if made else [[]] * 7
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
            taken = batch.select(keep).take(pa.array(at, pa.int64())) if keep else None
            yield pa.RecordBatch.from_arrays(
                [*(taken.columns if keep else []), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                names=[*keep, "record_id", "record_type", "refers_to", "target_uri", "content_length", "block_digest", "record"],
            )

    return run


def derive(responses: DataFrame, keep: dict[str, str] | None = None) -> DataFrame:
    """Metadata and conversion records of response records.

    ``responses``: record_id, target_uri, date (strings) and block (the HTTP response as bytes); the
    columns of ``keep`` (name to type) go along, others are ignored. Per response one metadata record:
    the source's status line and headers, digest and length of its payload, and of HTML its title,
    language and links; and, where the payload is textual or missing, one conversion record with its
    plain text. Both refer to the response and keep its target and date; the conversion names its
    metadata. Ids follow from the source's id, so that a repeated run or row gives the same.

    Null ids get '<urn:uuid:...>' of the target, null dates ``DATE``; null targets leave their headers
    out; null blocks have an empty payload. An empty table gives no rows.
    """
    keep = keep or {}
    rows = responses.select(
        *(F.col(k).cast(t) for k, t in keep.items()),
        F.coalesce(F.col("record_id").cast("string"), F.concat(F.lit("<urn:uuid:"), F.md5(F.coalesce("target_uri", F.lit(""))), F.lit(">"))).alias("record_id"),
        F.col("target_uri").cast("string"),
        F.coalesce(F.col("date").cast("string"), F.lit(DATE)).alias("date"),
        F.col("block").cast("binary"),
    )
    own = "record_id string, record_type string, refers_to string, target_uri string, content_length long, block_digest string, record binary"
    return rows.mapInArrow(_derive(list(keep)), ", ".join([*(f"{k} {t}" for k, t in keep.items()), own]))


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages (page_id, url, html), as a crawler would have stored them."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    name = F.sha1(F.concat_ws("|", F.col("page_id").cast("string"), F.coalesce("url", F.lit("")), F.sha1(body)))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col("page_id").cast("long"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"),
        F.concat(head.cast("binary"), body).alias("block"),
    )


def response_records(responses: DataFrame) -> DataFrame:
    """``record``: each response as a WARC record, its block as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "block"):
            made = []
            for i, u, d, block in zip(*(batch.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "block")), strict=True):
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", i), ("WARC-Date", d), *([("WARC-Target-URI", u)] if u else []), ("Content-Type", "application/http; msgtype=response")]
                made.append(serialize(headers, block or b""))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    return responses.select("record_id", "target_uri", "date", "block").mapInArrow(run, "record binary")


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write the ``record`` column as gzip members into one file a partition; returns part, records.

    Evaluate the result once (save it): that writes the files. A partition without rows leaves a file without records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        count = 0

        def members() -> Iterator[bytes]:
            nonlocal count
            for batch in batches:
                for r in batch.column("record"):
                    count += 1
                    pack = zlib.compressobj(1, wbits=31)  # read again soon: quick rather than small
                    yield pack.compress(r.as_py()) + pack.flush()

        where, path = _place(folder)
        where.create_dir(path, recursive=True)
        _publish(f"{folder}/{part}", members())
        yield pa.RecordBatch.from_pydict({"part": [part], "records": [count]})

    return records.select("record").mapInArrow(run, "part string, records long")


def _plain(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of gzip members, or of a plain file, block by block; each byte is looked at once."""
    unpack = None
    first = True
    for block in blocks:
        if first and block:
            first = False
            if block[:2] == b"\x1f\x8b":
                unpack = zlib.decompressobj(wbits=31)
        if unpack is None:
            yield block
            continue
        rest = memoryview(block)
        while len(rest):
            yield unpack.decompress(rest)
            if not unpack.eof:
                break
            rest = rest[len(rest) - len(unpack.unused_data) :]
            unpack = zlib.decompressobj(wbits=31)


def parse_records(blocks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file's bytes, gzip members or plain; stops at a torn record.

    Holds one record at a time, and of a file no more than a block besides.
    """
    held, at, need = bytearray(), 0, 0
    for part in _plain(blocks):
        held += part
        if len(held) - at < need:
            continue
        while (head := held.find(b"\r\n\r\n", at)) >= 0:
            lines = bytes(held[at:head]).decode("utf-8", "replace").split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
            end = head + 4 + int(headers.get("Content-Length", "0"))
            if end + 4 > len(held):
                need = end + 4 - at
                break
            yield headers, bytes(held[head + 4 : end])
            at, need = end + 4, 0
        if at > 1 << 20:
            del held[:at]
            at = 0


def _blocks(data: pa.Buffer, size: int = 1 << 16) -> Iterator[bytes]:
    view = memoryview(data)
    return (bytes(view[s : s + size]) for s in range(0, len(view), size))


NAMES = ["record_id", "record_type", "refers_to", "target_uri", "date", "block"]
HEADERS = ["WARC-Record-ID", "WARC-Type", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date"]
READ = "record_id string, record_type string, refers_to string, target_uri string, date string, block binary"


def _rows(records: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    held: list[list] = []
    size = 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*held, strict=True))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "block" else pa.string()) for c, n in zip(cols, NAMES, strict=True)], names=NAMES)

    for h, b in records:
        held.append([*(h.get(k) for k in HEADERS), b])
        size += len(b)
        if len(held) == 500 or size > 8 << 20:
            yield batch()
            size = 0
    if held:
        yield batch()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the .warc and .warc.gz files under a path: record_id, record_type, refers_to, target_uri, date, block.

    Any store that Spark reads; a file is one row on its way to a task, of 2 GB at most (``read_parts`` has no such bound).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _rows(parse_records(_blocks(content.as_buffer())))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("content").mapInArrow(run, READ)


def read_parts(parts: DataFrame, folder: str) -> DataFrame:
    """Records of the parts that ``write_warc`` has written to a shared folder, each streamed from its file by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                where, path = _place(f"{folder}/{part}")
                with where.open_input_stream(path) as f:
                    yield from _rows(parse_records(iter(lambda f=f: f.read(1 << 18), b"")))

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.select("part").repartition(n, "part").mapInArrow(run, READ)
