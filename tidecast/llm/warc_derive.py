"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

Every response gives two records that name it in WARC-Refers-To:

* ``metadata`` (application/json): the response's own WARC headers, HTTP status and headers,
  the page's title and its links with their texts;
* ``conversion`` (text/plain): the page's visible text, block by block.

Both keep the response's target URI, date and payload digest (WARC-Source-Payload-Digest) and carry
the digest of their own block. Record ids are derived from the response's id and the kind, so a
repeated run gives the same records. Tasks write them as WARC/1.1 files, one gzip member per
record, under names of their own; a manifest names the files that count, and ``read`` parses them
back.

A null body is an empty one: its text and links are empty. A null URI gives records without one.
Repeated responses give repeated records. Extra columns are ignored; empty tables give no files.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.tag_paths import read as read_page
from tidecast.session import fresh_path, materialise

VERSION = "WARC/1.1"
RESPONSE = "record_id string, target_uri string, date string, http_header string, body string"
FIELDS = {
    "record_id": "WARC-Record-ID",
    "warc_type": "WARC-Type",
    "refers_to": "WARC-Refers-To",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "source_payload_digest": "WARC-Source-Payload-Digest",
    "block_digest": "WARC-Block-Digest",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
}
RESULT = ", ".join(f"{k} {'long' if k == 'content_length' else 'string'}" for k in FIELDS) + ", block string"
#: A tag, looked for up to the next "<" only, and never twice over the same characters.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*+)([^<>]*+)>")
TITLE_END = re.compile(r"</title", re.I)
HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
MARKUP = re.compile(r"<[^<>]*+>")
UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
ROWS, DATES = 200, 10**9


def responses(pages: DataFrame) -> DataFrame:
    """Pages as WARC responses; id, date and HTTP header follow from the row."""
    body = F.coalesce("html", F.lit(""))
    # nulls are told from empty texts, and rows that differ in their page only have ids of their own
    name = F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col("page_id").cast("string"), F.col("url"), F.md5(body))]))
    parts = [F.substring(name, *x) for x in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    # ids count seconds, over and over within ``DATES``, so that any of them gives a date
    seconds = F.lit(1_700_000_000) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(DATES))
    when = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        when.alias("date"),
        header.alias("http_header"),
        body.alias("body"),
    )


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _words(text: str) -> str:
    return " ".join(html.unescape(text).split())


def title_and_links(seen: str) -> tuple[str | None, list[dict]]:
    """The first title, and every link with its text, in one pass. A link ends at the next one."""
    title, untitled, links, at = None, True, [], None
    for m in TAG.finditer(seen):
        closing, tag, rest = m[1], m[2].lower(), m[3]
        if tag == "title" and not closing and untitled:
            end, untitled = TITLE_END.search(seen, m.end()), False
            title = _words(seen[m.end() : end.start()]) if end else None
        elif tag == "a":
            if at is not None:
                links[-1]["text"] = _words(MARKUP.sub(" ", seen[at : m.start()]))
            href, at = None if closing else HREF.search(rest), None
            if href:
                links.append({"url": html.unescape(href[1] or href[2] or href[3] or ""), "text": ""})
                at = m.end()
    if at is not None:
        links[-1]["text"] = _words(MARKUP.sub(" ", seen[at:]))
    return title, links


def derive(record_id: str, target_uri: str | None, date: str, http_header: str, body: str) -> list[dict]:
    """The two records of a response."""
    payload = body.encode()
    source = {
        "WARC-Type": "response",
        "WARC-Record-ID": record_id,
        "WARC-Target-URI": target_uri,
        "WARC-Date": date,
        "WARC-Payload-Digest": digest(payload),
        "WARC-Block-Digest": digest(http_header.encode() + payload),
        "Content-Length": len(http_header.encode()) + len(payload),
    }
    status, *lines = http_header.strip().split("\r\n")
    seen = UNSEEN.sub("", body)
    title, links = title_and_links(seen)
    about = {
        "envelope": {k: v for k, v in source.items() if v is not None},
        "http": {"status": status, "headers": dict(x.split(": ", 1) for x in lines if ": " in x)},
        "html": {"title": title, "links": links},
    }
    texts = {
        "metadata": ("application/json", json.dumps(about, ensure_ascii=False)),
        "conversion": ("text/plain; charset=utf-8", "\n".join(b.text for b in read_page(body, judge=False).blocks)),
    }
    return [
        {
            "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id + kind)}>",
            "warc_type": kind,
            "refers_to": record_id,
            "target_uri": target_uri,
            "date": date,
            "source_payload_digest": source["WARC-Payload-Digest"],
            "block_digest": digest(text.encode()),
            "content_type": content_type,
            "content_length": len(text.encode()),
            "block": text,
        }
        for kind, (content_type, text) in texts.items()
    ]


def serialize(record: dict) -> bytes:
    """One record in WARC form, as a gzip member of its own."""
    head = [VERSION, *(f"{h}: {record[k]}" for k, h in FIELDS.items() if record[k] is not None)]
    # a URI may not break the header
    head = [re.sub(r"[\r\n]+", " ", x) for x in head]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + record["block"].encode() + b"\r\n\r\n", 3, mtime=0)


def records(stream) -> Iterator[dict]:
    """The records of an opened, decompressed WARC stream."""
    names = {h.lower(): k for k, h in FIELDS.items()}
    while line := stream.readline():
        if not line.strip():
            continue
        found = dict.fromkeys(FIELDS)
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            h, _, v = line.decode().partition(": ")
            if h.lower() in names:
                found[names[h.lower()]] = v
        found["content_length"] = int(found["content_length"])
        yield found | {"block": stream.read(found["content_length"]).decode()}


def write(source: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the derivatives of all responses; returns the manifest (file, n_records)."""
    folder = folder or fresh_path(source.sparkSession, "warc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = pa.fs.FileSystem.from_uri(folder)
        out, name, n = None, f"{uuid.uuid4().hex}.warc.gz", 0
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                if out is None:
                    fs.create_dir(place, recursive=True)
                    out = fs.open_output_stream(f"{place}/{name}", compression=None)
                for row in b.slice(k, ROWS).to_pylist():
                    for r in derive(**row):
                        out.write(serialize(r))
                        n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "n_records": n}])

    cols = source.select(*[c.split()[0] for c in RESPONSE.split(", ")])
    return materialise(cols.mapInArrow(work, "file string, n_records long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """All records of the manifest's files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(k, pa.int64() if k == "content_length" else pa.string()) for k in [*FIELDS, "block"]])
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, path = pa.fs.FileSystem.from_uri(name)
                with fs.open_input_stream(path, compression=None) as f, gzip.open(f) as stream:
                    rows: list = []
                    for r in records(stream):
                        rows.append(r)
                        if len(rows) == ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(work, RESULT)


def query(pages: DataFrame) -> DataFrame:
    """op7: derivative records of all pages, read back from their files."""
    return read(write(responses(pages)))
