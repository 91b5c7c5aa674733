from tailwright.llm.common import Workspace
from tailwright.llm.warc import derive, derive_one, digest, html_to_text, parse_http, parse_records, read_parts, read_warc, response_records, responses_of_pages, write_warc


def test_text_of_pages():
    page = '<html lang="fr"><head><title>A &amp; B</title><script>var x="</p>";</script><style>p{}</style></head><body><!-- no --><p>Eins<br>zwei &lt;3</p><div>drei  vier</div><a href="/x?a=1&amp;b=2">l</a> 2 < 3'
    text, title, lang, links = html_to_text(page)
    assert text == "A & B\nEins\nzwei <3\ndrei vier\nl 2 < 3" and (title, lang, links) == ("A & B", "fr", ["/x?a=1&b=2"])
    assert html_to_text("<script>never closed")[0] == "" and html_to_text("")[0] == "" and html_to_text("a<!-- open")[0] == "a"
    assert html_to_text('<a "' * 3000 + "x>y")[0] is not None


def test_http_blocks():
    status, headers, payload = parse_http(b"HTTP/1.1 200 OK\r\nA: b\r\n c\r\nX:y\r\n\r\nbody\r\n\r\nmore")
    assert (status, headers, payload) == ("HTTP/1.1 200 OK", [("A", "b c"), ("X", "y")], b"body\r\n\r\nmore")
    assert parse_http(b"")[2] == b""
    binary = derive_one("<id>", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89")
    assert [x[0] for x in binary] == ["metadata"]


def test_derivatives_refer_to_their_response(spark):
    rows = [(1, "http://a/", "<p>x\r\nWARC-Type: y</p>"), (2, None, None), (3, "http://b/", ""), (3, "http://b/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sources = {r.page_id: r for r in responses_of_pages(pages).collect()}
    out = derive(responses_of_pages(pages), keep={"page_id": "long"}).collect()
    assert len(out) == 8
    for r in out:
        (headers, block), = parse_records([bytes(r.record)])
        assert headers["WARC-Refers-To"] == sources[r.page_id].record_id and headers["WARC-Block-Digest"] == digest(block) == r.block_digest
        assert headers.get("WARC-Refers-To-Target-URI") == r.target_uri and len(block) == r.content_length
        if r.record_type == "metadata":
            payload = bytes(sources[r.page_id].block).split(b"\r\n\r\n", 1)[1]
            assert f"payload-digest: {digest(payload)}" in block.decode() and "http-header-content-type: text/html" in block.decode()
    assert derive(responses_of_pages(pages.limit(0))).count() == 0


def test_files_round_trip(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>é {i}</p>" * i) for i in range(30)], "page_id long, url string, html string")
    records = derive(responses_of_pages(pages))
    folder = f"{Workspace(spark, 'warc').path}/out"
    ws = Workspace(spark, "warc")
    parts = ws.save(write_warc(records.repartition(3), folder), "parts")
    assert parts.agg({"records": "sum"}).first()[0] == 60
    assert sorted(map(str, read_parts(parts, folder).collect())) == sorted(map(str, read_warc(spark, folder).collect()))
    got = {r.record_id: (r.record_type, r.refers_to, digest(bytes(r.block))) for r in read_warc(spark, folder).collect()}
    assert got == {r.record_id: (r.record_type, r.refers_to, r.block_digest) for r in records.collect()}


def test_responses_are_read_as_they_were(spark):
    """A very long page, missing values, repeated rows and a clashing extra column."""
    rows = [(1, "http://a/", "<p>é</p>" * 200_000, "x"), (2, None, None, "y"), (3, "http://b/", "", None), (3, "http://b/", "", None), (None, "http://c/", "<p>no id", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")
    sources = responses_of_pages(pages)
    ws = Workspace(spark, "warc")
    parts = ws.save(write_warc(response_records(sources), f"{ws.path}/in"), "parts")
    got = sorted((r.record_id, r.target_uri, r.date, bytes(r.block)) for r in read_parts(parts, f"{ws.path}/in").collect())
    assert got == sorted((r.record_id, r.target_uri, r.date, bytes(r.block)) for r in sources.collect())
    assert derive(read_parts(parts, f"{ws.path}/in")).count() == 10
