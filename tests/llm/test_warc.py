import gzip
import hashlib
import json

import pytest

from pyspark.sql import functions as F

from anchorline.llm import warc as W

SHAPE = "page_id long, url string, html string, record_id string"
ROWS = [
    (1, "http://a/x", "<html><head><title>T &amp; t</title><script>var a = '<b>';</script></head><body><p>One  two</p><!-- no --><p>Three&nbsp;four</p></body></html>", "clash"),
    (2, None, "", None),
    (3, "http://b", None, None),
    (None, "http://c", "plain é", None),
    (1, "http://a/x", "<html><head><title>T &amp; t</title><script>var a = '<b>';</script></head><body><p>One  two</p><!-- no --><p>Three&nbsp;four</p></body></html>", "clash"),
    (4, "http://d", "<p>" + "long text " * 20000, None),
]


def made(spark):
    return W.derive(W.responses(spark.createDataFrame(ROWS, SHAPE)), carry=("page_id",)).collect()


def test_linked_records(spark):
    got = made(spark)
    sources = {r.page_id: r for r in W.responses(spark.createDataFrame(ROWS, SHAPE)).collect()}
    sha = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
    assert sum(r.record_type == "metadata" for r in got) == len(ROWS)
    assert sorted(str(r.page_id) for r in got if r.record_type == "conversion") == ["1", "1", "4", "None"]
    for r in got:
        s = sources[r.page_id]
        assert r.refers_to == s.record_id and r.target_uri == s.target_uri and r.source_headers == s.http_headers
        assert r.source_digest == sha(s.payload) and r.block_digest == sha(r.block) and r.content_length == len(r.block.encode())
        if r.record_type == "metadata":
            assert f"source-block-digest: {sha(s.http_headers + W.CRLF + s.payload)}" in r.block and f"source-record-id: {s.record_id}" in r.block
    text = next(r.block for r in got if r.page_id == 1 and r.record_type == "conversion")
    assert text == "T & t\nOne two\nThree four"
    assert len({r.record_id for r in got if r.page_id in (2, 3)}) == 2


def test_files_round_trip(spark, tmp_path):
    derived = W.derive(W.responses(spark.createDataFrame(ROWS, SHAPE)))
    members = [bytes(r.member) for r in W.warc_bytes(derived).collect()]
    back = list(W.parse_warc(gzip.decompress(b"".join(members))))
    assert len(back) == derived.count()
    by_id = {r.record_id: r for r in derived.collect()}
    for head, block in back:
        r = by_id[head["warc-record-id"]]
        assert block.decode() == r.block and head["warc-refers-to"] == r.refers_to and head["warc-block-digest"] == r.block_digest


def test_reading_responses(spark, tmp_path):
    parts = []
    for r in W.responses(spark.createDataFrame(ROWS[:2], SHAPE)).collect():
        block = f"{r.http_headers}\r\n{r.payload}".encode()
        parts.append(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {r.record_id}\r\nWARC-Target-URI: {r.target_uri}\r\nWARC-Date: {r.warc_date}\r\nContent-Type: {r.content_type}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = sorted(W.read_warc(spark, str(tmp_path)).collect())
    want = sorted(tuple("None" if v is None else v for v in r) for r in W.responses(spark.createDataFrame(ROWS[:2], SHAPE)).select(*W.RESPONSE_COLUMNS).collect())
    assert [tuple(r) for r in got] == want


def test_source_bytes_headers_and_digests_stay(spark, tmp_path):
    """Payloads that aren't UTF-8 or not text: digests of the file's bytes, its own digests, no conversion of images; headers in the derived files."""
    sha = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    latin, image = "<p>caf\u00e9</p>".encode("latin-1"), b"\x89PNG\xff\xfe<p>no</p>"
    blocks = {"l": b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + latin, "i": b"HTTP/1.1 200 OK\r\ncontent-type: image/png\r\n\r\n" + image}
    more = {"l": "", "i": "WARC-Payload-Digest: sha1:OWN\r\n"}
    (tmp_path / "a.warc").write_bytes(b"".join(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {k}\r\n{more[k]}Content-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for k, b in blocks.items()))
    derived = W.derive(W.read_responses(spark, str(tmp_path))).cache()
    got = {(r.refers_to, r.record_type): r for r in derived.collect()}
    assert sorted(got) == [("i", "metadata"), ("l", "conversion"), ("l", "metadata")]
    assert got["l", "conversion"].block == "caf\u00e9" and got["l", "metadata"].source_digest == sha(latin) and got["i", "metadata"].source_digest == "sha1:OWN"
    assert all(f"source-block-digest: {sha(blocks[k])}" in got[k, "metadata"].block for k in blocks)
    for head, _ in W.parse_warc(gzip.decompress(b"".join(bytes(r.member) for r in W.warc_bytes(derived).collect()))):
        r = got[head["warc-refers-to"], head["warc-type"]]
        assert json.loads(head["warc-source-http-headers"]) == r.source_headers and head["warc-source-payload-digest"] == r.source_digest


def test_files_are_read_in_ranges(spark, tmp_path):
    import random

    rnd = random.Random(6)
    record = lambda k: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: %d\r\nContent-Length: %d\r\n\r\n" % (k, len(blocks[k])) + blocks[k] + b"\r\n\r\n"
    # payloads with what looks like borders of records and of members
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n" + rnd.choice([b"WARC/1.1\r\n\r\n", W.GZIP, b""]) + rnd.randbytes(rnd.choice([0, 10, 3000])) for _ in range(120)]
    members = [gzip.compress(record(k)) for k in range(len(blocks))]
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.warc.gz").write_bytes(b"".join(members[:70]))
    (tmp_path / "many" / "b.warc.gz").write_bytes(b"".join(members[70:]) + bytes(300))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(map(record, range(120)))))
    (tmp_path / "plain.warc").write_bytes(b"".join(map(record, range(120))))
    want = [(str(k), b.partition(b"\r\n\r\n")[2]) for k, b in enumerate(blocks)]
    for path, size in (("many", 700), ("many", 5000), ("many", 1 << 26), ("one.warc.gz", 900), ("plain.warc", 900)):
        got = [(r.record_id, bytes(r.payload)) for r in W.read_responses(spark, str(tmp_path / path), size).collect()]
        assert sorted(got, key=lambda x: int(x[0])) == want
    (tmp_path / "cut.warc.gz").write_bytes(members[0] + members[1][:-20])
    for path in ("cut.warc.gz",):
        with pytest.raises(Exception, match="cut off"):
            W.read_responses(spark, str(tmp_path / path)).collect()
    assert [h["warc-record-id"] for h, _ in W.parse_records(record(3)[i : i + 1] for i in range(len(record(3))))] == ["3"]


def test_references(spark):
    """Numeric and named references, each once; what isn't one stays."""
    cases = {"&mdash;&#8217;&eacute;&#x1F600;": "\u2014\u2019\u00e9\U0001f600", "&amp;lt;": "&lt;", "a & b &nosuch; &#0; &#xD800; &#99999999; &": "a & b &nosuch; &#0; &#xD800; &#99999999; &", "&#39;x&#X41;&apos;": "'xA'", "&nbsp;": " ", "": "", "no": "no"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {r.t: r.u for r in df.select("t", W.resolved(F.col("t")).alias("u")).collect()} == cases | {None: None}


def test_written_files_keep_headers_ids_and_digests(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Foo: bar\r\n  baz\r\n\r\n<p>one</p>"
    (tmp_path / "in.warc").write_bytes(b"".join(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{k}>\r\nWARC-Block-Digest: sha1:B{k}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n" for k in range(5)))
    derived = W.derive(W.read_responses(spark, str(tmp_path / "in.warc"))).repartition(3)
    for _ in range(2):
        written = W.write_warc(derived, f"file://{tmp_path}/out").collect()
        assert sum(r.records for r in written) == 10
    files = sorted((tmp_path / "out").iterdir())
    assert sorted(str(f) for f in files) == sorted(r.path for r in written)
    back = [x for f in files for x in W.parse_warc(gzip.decompress(f.read_bytes()))]
    assert sorted((h["warc-refers-to"], h["warc-type"]) for h, _ in back) == sorted((f"<urn:{k}>", t) for k in range(5) for t in ("metadata", "conversion"))
    for head, text in back:
        assert "X-Foo: bar" in json.loads(head["warc-source-http-headers"])
        if head["warc-type"] == "metadata":
            assert b"http-header-X-Foo: bar baz\r\n" in text and f"source-block-digest: sha1:B{head['warc-refers-to'][5:-1]}".encode() in text


def test_empty(spark):
    assert W.derive(W.responses(spark.createDataFrame([], SHAPE))).count() == 0
