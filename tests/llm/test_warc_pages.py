"""The query over pages against the standard library: gzip, an HTML parser, digests and ids from the pages themselves."""

import gzip
import hashlib
import uuid
import zlib
from html.parser import HTMLParser
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from tailwright.llm.queries import QUERIES
from tailwright.llm.warc import parse_records

SF = "/root/testdata/sf0.001"
HIDDEN = {"script", "style", "noscript", "template", "svg", "iframe"}
LINES = set(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html li main nav ol option p pre section table tbody td th thead title tr ul".split()
)


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in HIDDEN
        if tag in LINES:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in HIDDEN and self.skip > 0
        if tag in LINES:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def text_of(html):
    p = Text()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).replace("\r", "\n").split("\n"))
    return "\n".join(x for x in lines if x)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_derivatives_of_all_pages(spark):
    rows = {r.record_id: r for r in QUERIES["op8_warc_derivatives"](spark, SF).collect()}
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    assert len(rows) == 2 * len(pages)
    for p in pages:
        html = (p["html"] or "").encode()
        name = hashlib.sha1(f"{p['page_id']}|{p['url'] or ''}|{hashlib.sha1(html).hexdigest()}".encode()).hexdigest()
        source = f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}>"
        own = lambda kind, s=source: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{s}|{kind}')}>"
        meta, text = rows[own("metadata")], rows[own("conversion")]
        assert (meta.record_type, text.record_type) == ("metadata", "conversion")
        assert {meta.refers_to, text.refers_to} == {source} and {meta.target_uri, text.target_uri} == {p["url"]}
        want = text_of(html.decode()).encode()
        assert (text.content_length, text.block_crc32, text.block_sha1) == (len(want), zlib.crc32(want), hashlib.sha1(want).hexdigest())


def test_reading_is_linear_and_whole():
    record = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n"
    blocks = [b"b" * (i * 37 % 5000) for i in range(4000)] + [b"long" * 500_000]
    packed = b"".join(gzip.compress(record % (len(b), b), 1) for b in blocks)
    plain = b"".join(record % (len(b), b) for b in blocks)
    for data in (packed, plain):
        for size in (1000, 1 << 16):
            got = [b for _, b in parse_records(data[s : s + size] for s in range(0, len(data), size))]
            assert got == blocks
    assert len(list(parse_records([plain[:-10]]))) == len(blocks) - 1  # the last one is torn
