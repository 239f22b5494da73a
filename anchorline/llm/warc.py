"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A response record is a row of ``RESPONSE_COLUMNS``; ``responses`` makes them from
crawled pages, ``read_responses`` from WARC files (payloads as bytes, with digests of what the
file has), ``read_warc`` the same as strings.  ``derive`` gives, for every
response, a ``metadata`` record (the source's HTTP status line and each of its headers, the sizes
and digests of its block and payload) and, where the HTTP content type is text, a
``conversion`` record with the plain text.  Both carry WARC-Refers-To (the
response's record id), its target and date, and digests of their own blocks;
ids are made from the response's id, so that reruns agree.  ``write_warc`` writes records as
WARC/1.1 files, one per partition, each record whole.

All of this but the file codec is DataFrame expressions in one projection.

Defined results: a null url gives a null target; null or empty html gives an empty payload, no
conversion record and still a metadata record; a null page id
counts as an empty one; repeated pages give repeated records with equal ids; a very
long page is one record, whole; an empty table gives no records; extra columns aren't carried.
"""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from html.entities import name2codepoint

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm.common import table

RESPONSE_COLUMNS = ("record_id", "target_uri", "warc_date", "content_type", "http_headers", "payload")
DERIVED_COLUMNS = ("record_id", "record_type", "refers_to", "target_uri", "warc_date", "content_type", "source_headers", "source_digest", "block", "block_digest", "content_length")
#: What ``read_responses`` adds: digests of the source record's own bytes, as the file gives them or by sha256, and the text of a textual payload.
SOURCE_COLUMNS = ("source_block_digest", "source_payload_digest", "source_text")
TEXT_TYPES = r"^(text/.*|application/(.*\+)?xml)$"
DATE = "2024-01-01T00:00:00Z"
#: The character references that have a name in HTML 4, and the apostrophe's of XML; a space that doesn't break is a space here.
NAMED = {"apos": "'"} | {name: chr(code) for name, code in name2codepoint.items()} | {"nbsp": " "}
#: A reference after its "&": a decimal or hexadecimal number, or a name.
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
#: The tags that end a line: fixed values.
LINE_TAGS = "br|p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|section|article|header|footer|nav|title|body|pre|blockquote"
CRLF = "\r\n"
#: How a gzip member begins. Bytes of a file that a task reads records from, of payloads that it holds, and of one read.
GZIP = b"\x1f\x8b\x08"
RANGE_BYTES, BATCH_BYTES, _CHUNK = 1 << 26, 1 << 24, 1 << 20


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A urn:uuid made from the parts' md5."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    piece = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-"), piece(13, 4), F.lit("-"), piece(17, 4), F.lit("-"), piece(21, 12), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages (page_id, url, html)."""
    payload = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    return pages.select("page_id", record_id(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), F.lit("application/http; msgtype=response").alias("content_type"), head.alias("http_headers"), payload.alias("payload"))


def plain_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, line tags end lines, other tags go, references are resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?i)</?({LINE_TAGS})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    t = resolved(t)
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def _char(code: Column) -> Column:
    """The character of a code point; null for none (zero, surrogates, beyond Unicode)."""
    sound = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def resolved(text: Column) -> Column:
    """Numeric and named character references as characters, each once; what isn't a reference stays."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def once(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def char(ref: Column) -> Column:
        number = F.when(F.substring(ref, 1, 2).isin("#x", "#X"), F.conv(F.substring(ref, 3, 9), 16, 10)).otherwise(F.substring(ref, 2, 9)).try_cast("long")
        return F.when(F.startswith(ref, F.lit("#")), _char(number)).otherwise(F.try_element_at(names, ref))

    def after(part: Column, i: Column) -> Column:
        found = once(F.regexp_extract(part, REFERENCE, 1), lambda ref: once(F.struct(ref.alias("ref"), F.when(ref != "", char(ref)).alias("char")), lambda f: F.coalesce(F.concat(f["char"], F.substr(part, F.length(f["ref"]) + 2)), F.concat(F.lit("&"), part))))
        return F.when(i == 0, part).otherwise(found)

    return once(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "&"), after), "")).otherwise(t))


def derive(records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Metadata and conversion records of response records, in DERIVED_COLUMNS, after the carried columns.

    Records of ``read_responses`` bring digests of the source's bytes and the payload's text; others have these made from the payload.
    """
    given = set(records.columns) >= set(SOURCE_COLUMNS)
    source_digest = F.col("source_payload_digest") if given else _digest(F.col("payload"))
    block_digest = F.col("source_block_digest") if given else _digest(F.concat(F.col("http_headers"), F.lit(CRLF), F.col("payload")))
    mime = F.lower(F.regexp_extract("http_headers", r"(?im)^content-type:[ \t]*([^;\s]+)", 1))
    text = F.when((mime == "") | mime.rlike(TEXT_TYPES), plain_text(F.col("source_text" if given else "payload")))
    # a header that is folded over several lines is one line
    lines = F.split(F.regexp_replace("http_headers", "\r\n[ \t]+", " "), CRLF)
    header_lines = F.transform(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x != ""), lambda x: F.concat(F.lit("http-header-"), x, F.lit(CRLF)))
    fields = F.concat(
        F.lit("source-record-id: "), F.col("record_id"), F.lit(CRLF),
        F.lit("source-content-type: "), F.coalesce("content_type", F.lit("")), F.lit(CRLF),
        F.lit("source-block-digest: "), block_digest, F.lit(CRLF),
        F.lit("source-payload-digest: "), source_digest, F.lit(CRLF),
        F.lit("source-payload-length: "), F.octet_length("payload").cast("string"), F.lit(CRLF),
        F.lit("http-status-line: "), F.substring_index("http_headers", CRLF, 1), F.lit(CRLF), F.array_join(header_lines, ""),
    )
    made = records.withColumns({"_meta": fields, "_text": text, "_digest": source_digest})
    one = lambda kind, mime, block: F.struct(F.lit(kind).alias("record_type"), F.lit(mime).alias("content_type"), block.alias("block"))
    both = F.array_compact(F.array(one("metadata", "application/warc-fields", F.col("_meta")), F.when(F.col("_text") != "", one("conversion", "text/plain; charset=utf-8", F.col("_text")))))
    each = made.select(*carry, "record_id", "target_uri", "warc_date", "http_headers", "_digest", F.explode(both).alias("r"))
    return each.select(
        *carry, record_id(F.col("r.record_type"), F.col("record_id")).alias("record_id"), F.col("r.record_type").alias("record_type"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        F.col("r.content_type").alias("content_type"), F.col("http_headers").alias("source_headers"), F.col("_digest").alias("source_digest"), F.col("r.block").alias("block"), _digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"),
    )


def warc_record(r: dict) -> bytes:
    """One record of DERIVED_COLUMNS as WARC/1.1 bytes; the source's HTTP headers are one field, a JSON string."""
    block = (r["block"] or "").encode("utf-8", "replace")
    names = (("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["warc_date"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Block-Digest", r["block_digest"]), ("Content-Type", r["content_type"]), ("Content-Length", str(len(block))),
             ("WARC-Source-Payload-Digest", r["source_digest"]), ("WARC-Source-HTTP-Headers", None if r["source_headers"] is None else json.dumps(r["source_headers"])))
    head = "".join(f"{k}: {v}{CRLF}" for k, v in names if v is not None)
    return f"WARC/1.1{CRLF}{head}{CRLF}".encode("utf-8", "replace") + block + (CRLF * 2).encode()


def warc_bytes(derived: DataFrame) -> DataFrame:
    """record_id and the gzip member of each record, which concatenate to a WARC file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"record_id": pdf["record_id"], "member": [gzip.compress(warc_record(r), mtime=0) for r in pdf.to_dict("records")]})

    return derived.select(*DERIVED_COLUMNS).mapInPandas(run, "record_id string, member binary")


def write_warc(derived: DataFrame, path: str) -> DataFrame:
    """Writes a gzipped WARC/1.1 file per partition, whole records each, to a folder all executors reach; returns path and records of each.

    A file gets its name when it is complete, so that a repeated task replaces it by the same.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        number, n = TaskContext.get().partitionId(), 0
        begun, name = f"{folder}/_begun-{number:05d}-{uuid.uuid4().hex}", f"{folder}/part-{number:05d}.warc.gz"
        with fs.open_output_stream(begun, compression=None) as out:
            for pdf in batches:
                for r in pdf.to_dict("records"):
                    out.write(gzip.compress(warc_record(r), mtime=0))
                    n += 1
        fs.move(begun, name)
        yield pd.DataFrame({"path": [name], "records": [n]})

    return derived.select(*DERIVED_COLUMNS).mapInPandas(run, "path string, records long")


def parse_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of WARC records whose bytes come in chunks; one record is held at a time."""
    source, held, at = iter(chunks), bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(source, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if held[at:].strip(b"\r\n\0"):
                    raise ValueError("a record is cut off")
                return
        lines = held[at:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {lines[0][:20]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, begin = int(head["content-length"]), end + 4 - at
        while len(held) - at < begin + size + 4:
            if not more():
                break
        if len(held) - at < begin + size:
            raise ValueError("a record is cut off")
        yield head, bytes(held[at + begin : at + begin + size])
        at = min(at + begin + size + 4, len(held))


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of the records of an uncompressed WARC file."""
    return parse_records([data])


def _first_member(file: pa.NativeFile, start: int, stop: int) -> int | None:
    """The first place from start on, before stop, where a gzip member begins with a WARC record."""
    at, before = start, b""
    while at < stop:
        file.seek(at)
        piece = file.read(min(_CHUNK, stop - at) + 2)
        data, base = before + piece, at - len(before)
        found = data.find(GZIP)
        while found >= 0:
            if base + found < stop:
                file.seek(base + found)
                with contextlib.suppress(zlib.error):
                    if zlib.decompressobj(31).decompress(file.read(1 << 12), 5) == b"WARC/":
                        return base + found
            found = data.find(GZIP, found + 1)
        at, before = at + len(piece) - 2 if len(piece) > 2 else stop, b""
    return None


def _inflated(file: pa.NativeFile, begin: int, stop: int) -> Iterator[bytes]:
    """The bytes of all gzip members that begin from begin to before stop."""
    file.seek(begin)
    raw, member = b"", zlib.decompressobj(31)
    while raw or (raw := file.read(_CHUNK)):
        if out := member.decompress(raw, _CHUNK):
            yield out
        if member.eof:
            raw, member = member.unused_data or file.read(_CHUNK), zlib.decompressobj(31)
            if not raw.strip(b"\0") or file.tell() - len(raw) >= stop:
                return
        else:
            raw = member.unconsumed_tail


def _range_records(path: str, size: int, start: int, stop: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of the gzip members that begin in a range of a file; of a plain file the range at 0 has them all."""
    where, inner = pafs.FileSystem.from_uri(path)
    with where.open_input_file(inner) as file:
        if file.read(2) == GZIP[:2]:
            if (begin := 0 if start == 0 else _first_member(file, start, stop)) is not None:
                yield from parse_records(_inflated(file, begin, stop))
        elif start == 0:
            file.seek(0)
            yield from parse_records(iter(lambda: file.read(_CHUNK), b""))


def _text(http: str, payload: bytes) -> str | None:
    """The payload by its charset (UTF-8 if none or an unknown one is named); null if its content type isn't text."""
    kind = re.search(r"(?im)^content-type:[ \t]*([^;\s]*)([^\r\n]*)", http)
    if kind and kind[1] and not re.search(TEXT_TYPES, kind[1].lower()):
        return None
    charset = re.search(r"(?i)charset=[\"']?([\w.:-]+)", kind[2]) if kind else None
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def read_responses(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Response records of WARC files, plain or gzipped, in RESPONSE_COLUMNS with the payload's bytes, and SOURCE_COLUMNS.

    Files whose records are gzip members, as crawlers write them, are read in ranges; others, where no place is known to begin a record, in one
    each.  A task holds BATCH_BYTES of payloads, and one record more.
    """

    def row(head: dict[str, str], block: bytes) -> tuple:
        raw, _, payload = block.partition(b"\r\n\r\n")
        http = raw.decode("utf-8", "replace") + CRLF
        digests = (head.get(f"warc-{name}-digest") or "sha256:" + hashlib.sha256(x).hexdigest() for name, x in (("block", block), ("payload", payload)))
        return (head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), head.get("content-type"), http, payload, *digests, _text(http, payload))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*RESPONSE_COLUMNS, *SOURCE_COLUMNS]
        for pdf in batches:
            for path, size, start in zip(pdf["path"], pdf["length"], pdf["start"], strict=True):
                rows, held = [], 0
                for head, block in _range_records(path, size, start, min(size, start + range_bytes)):
                    if head.get("warc-type") == "response":
                        rows.append(row(head, block))
                        held += len(block)
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    # names and sizes only: no content is read here
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))).repartition("path", "start")
    return ranges.mapInPandas(run, ", ".join(f"{c} {'binary' if c == 'payload' else 'string'}" for c in (*RESPONSE_COLUMNS, *SOURCE_COLUMNS)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files in RESPONSE_COLUMNS, payloads read as UTF-8: for text only, as digests of other payloads differ from the file's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(payload=[bytes(x).decode("utf-8", "replace") for x in pdf["payload"]])

    return read_responses(spark, path).select(*RESPONSE_COLUMNS).mapInPandas(run, ", ".join(f"{c} string" for c in RESPONSE_COLUMNS))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and its derived records; the block stands as its digest and length."""
    derived = derive(responses(table(spark, sf_dir, "pages")), carry=("page_id",))
    return derived.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length")


def _sql_uuid(text: str) -> str:
    h = f"md5({text})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _sql_text(html: str) -> str:
    t = rf"regexp_replace({html}, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?({LINE_TAGS})\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    names = "map {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in NAMED.items()) + "}"
    code = "case when r[2:2] in ('x', 'X') then ('0x' || r[3:])::bigint else try_cast(r[2:] as bigint) end"
    char = f"case when r[1:1] = '#' then list_transform([{code}], lambda n: case when n between 1 and 55295 or n between 57344 and 1114111 then chr(n::int) end)[1] else ({names})[r] end"
    part = f"list_transform([regexp_extract(p, '{REFERENCE}', 1)], lambda r: case when i = 1 then p when r <> '' and ({char}) is not null then ({char}) || substr(p, length(r) + 2) else '&' || p end)[1]"
    t = f"list_transform([{t}], lambda t: case when contains(t, '&') then array_to_string(list_transform(string_split(t, '&'), lambda p, i: {part}), '') else t end)[1]"
    t = rf"regexp_replace({t}, '[ \t\r\f]+', ' ', 'g')"
    t = rf"regexp_replace({t}, ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({t}, '^[ \n]+|[ \n]+$', '', 'g')"


_NL = "chr(13) || chr(10)"
ORACLE_SQL = f"""
with p as (
  select page_id, url, coalesce(html, '') as payload, {_sql_uuid("'response|' || coalesce(cast(page_id as varchar), '') || '|' || coalesce(url, '')")} as rid,
         'HTTP/1.1 200 OK' || {_NL} || 'Content-Type: text/html; charset=utf-8' || {_NL} || 'Content-Length: ' || strlen(coalesce(html, '')) || {_NL} as head
  from pages),
r as (
  select *, 'metadata' as record_type,
         'source-record-id: ' || rid || {_NL} || 'source-content-type: application/http; msgtype=response' || {_NL} ||
         'source-block-digest: sha256:' || sha256(head || {_NL} || payload) || {_NL} || 'source-payload-digest: sha256:' || sha256(payload) || {_NL} ||
         'source-payload-length: ' || strlen(payload) || {_NL} || 'http-status-line: HTTP/1.1 200 OK' || {_NL} ||
         'http-header-Content-Type: text/html; charset=utf-8' || {_NL} || 'http-header-Content-Length: ' || strlen(payload) || {_NL} as block from p
  union all
  select *, 'conversion', {_sql_text("payload")} from p)
select page_id, record_type, {_sql_uuid("record_type || '|' || rid")} as record_id, rid as refers_to, url as target_uri, 'sha256:' || sha256(payload) as source_digest,
       'sha256:' || sha256(block) as block_digest, cast(strlen(block) as bigint) as content_length
from r where record_type = 'metadata' or block <> ''
"""
