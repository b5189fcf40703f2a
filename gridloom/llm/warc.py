"""WARC derivative builder.

Each response record becomes two derived records as WARC/1.1 defines them: a metadata record (fields about the capture,
``application/warc-fields``) and a conversion record (the page's plain text). derivatives() reads whole response records and
keeps what they say: both derived records refer to the response's record id (WARC-Refers-To) and carry its target URI and
date; the metadata block keeps the status line, every HTTP header in its order, the length, title and links, and the
response's own block and payload digests; the conversion names the payload digest too. Digests that the response doesn't
state are computed, and metadata says so of stated ones that don't match (``source-payload-digest-mismatch``). Record ids
are name-based UUIDs of the response id and the kind, so a run again yields the same records. Own digests are SHA-1 in
Base32, as is usual in WARC files. Bodies with a transfer or content coding of gzip, deflate or chunks are decoded for the
text; what can't be decoded is read as it is.

responses() makes response records of a table of pages, which has neither headers nor dates: there the head, the date and
the record id are made up from the page's id and address.

Plain text: script, style, template, noscript, head but its title, and comments go; block elements and line breaks become line feeds;
other tags vanish; character references are decoded; runs of blanks become one, empty lines go.

Defined cases: null html is an empty body, a null url an empty target; rows that repeat keep their rows, with equal record
ids; extra columns are ignored; an empty table gives no rows; text that isn't HTML is its own plain text; a comment or
script that isn't closed ends with the page, a title that isn't closed is none; a null record, one that isn't a response
or one that can't be parsed (of negative length, say) gives no rows of its own but one whose ``error`` says why, and so does
one whose compressed body unfolds to more than is allowed; chunks of negative or damaged size aren't decoded.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import table

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:gridloom:warc")
DATE = "1970-01-01T00:00:00Z"
#: Bytes to which a compressed body may unfold.
MOST_BYTES = 64 << 20
_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(</title\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!?/a-zA-Z][^>]*>")
_ANCHOR = re.compile(r"<a\b[^>]*>?", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v ]+")
SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, content_length long, block_digest string, payload_digest string, record binary, error string"


def untagged(text: str) -> str:
    """A page without its tags. What follows the last ``>`` holds none and isn't searched, so that signs that open a tag
    over and over cost no more than their length."""
    end = text.rfind(">") + 1
    return _TAG.sub("", _BLOCK.sub("\n", text[:end])) + text[end:]


def plain_text(page: str) -> str:
    """The visible text of a page, a line for each block."""
    body = untagged(_GONE.sub(" ", page))
    lines = (_BLANKS.sub(" ", x).strip() for x in html.unescape(body).split("\n"))
    return "\n".join(x for x in lines if x)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}:{key}')}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole WARC record. Line breaks inside a field would end it, so they are percent-encoded."""
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    head = "WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """The fields, in order, and the block of a record. Folded lines belong to the field before them."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields: list[tuple[str, str]] = []
    for x in lines:
        if x[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {x.strip()}")
        else:
            name, _, value = x.partition(":")
            fields.append((name.strip(), value.strip()))
    length = int(value_of(fields, "Content-Length") or 0)
    if length < 0:
        raise ValueError("a negative length")
    if len(rest) < length:
        raise ValueError("the record is cut short")
    return fields, rest[:length]


def value_of(fields: list[tuple[str, str]], name: str) -> str | None:
    """The first value of a name, whatever its case."""
    return next((v for k, v in fields if k.lower() == name.lower()), None)


class TooLarge(ValueError):
    """A body that unfolds to more than is allowed."""


def unchunked(body: bytes) -> bytes:
    """The chunks' data. A size that isn't plain hexadecimal, or a chunk that ends behind the body, isn't a coding."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("not a chunk")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if end + 2 + n > len(body):
            raise ValueError("a chunk is cut short")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def inflated(body: bytes, kind: int, most: int) -> bytes:
    """The members of a zlib (kind 15) or gzip (kind 31) stream, unfolded in steps up to ``most`` bytes together."""
    out, left = [], most
    while body:
        stream = zlib.decompressobj(kind)
        while not stream.eof:
            part = stream.decompress(body, min(1 << 20, left + 1))
            left -= len(part)
            if left < 0:
                raise TooLarge(f"a body unfolds to more than {most} bytes")
            out.append(part)
            if not part and not stream.unconsumed_tail and not stream.eof:
                raise EOFError("a stream is cut short")
            body = stream.unconsumed_tail
        body = stream.unused_data.lstrip(b"\0") if kind == 31 else b""
    return b"".join(out)


def decoded(http: list[tuple[str, str]], body: bytes, most: int) -> str:
    """The payload as text: codings undone as far as they can be, then the stated character set, else UTF-8."""
    codings = f"{value_of(http, 'Content-Encoding') or ''},{value_of(http, 'Transfer-Encoding') or ''}".lower()
    undo = {"chunked": unchunked} | {name: lambda b, k=kind: inflated(b, 31 if b[:2] == b"\x1f\x8b" else k, most) for name, kind in (("gzip", 31), ("x-gzip", 31), ("deflate", 15))}
    for coding in reversed([c.strip() for c in codings.split(",") if c.strip() in undo]):
        try:
            body = undo[coding](body)
        except TooLarge:
            raise
        except (OSError, EOFError, ValueError, zlib.error):
            break
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", value_of(http, "Content-Type") or "", re.I)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def response(target: str, date: str, own_id: str, status: str, http: list[tuple[str, str]], body: bytes) -> bytes:
    """A whole response record."""
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    block = f"{clean(status)}\r\n{''.join(f'{k}: {clean(v)}\r\n' for k, v in http)}\r\n".encode() + body
    return record([("WARC-Type", "response"), ("WARC-Record-ID", own_id), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body)), ("Content-Type", "application/http; msgtype=response")], block)


def derive(data: bytes, most: int = MOST_BYTES) -> list[dict]:
    """The metadata and the conversion record of one response record."""
    fields, block = parse(data)
    if (value_of(fields, "WARC-Type") or "").lower() != "response":
        raise ValueError("not a response record")
    refers_to, target, date = (value_of(fields, n) or "" for n in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    http = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
    about = []
    stated = {}
    for kind, own in (("block", digest(block)), ("payload", digest(body))):
        stated[kind] = value_of(fields, f"WARC-{kind}-Digest") or own
        about.append((f"source-{kind}-digest", stated[kind]))
        if stated[kind].lower().startswith("sha1:") and stated[kind] != own:
            about.append((f"source-{kind}-digest-mismatch", own))
    about += [("source-length", str(len(body))), ("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in http)]
    page = decoded(http, body, most)
    shown = _GONE.sub(" ", page)
    title = _TITLE.search(shown[: shown.rfind(">") + 1])
    title = title if title and title[2] else None  # one that isn't closed is no title
    anchors = (_HREF.search(m[0]) for m in _ANCHOR.finditer(page[: page.rfind(">") + 1]))
    about += [("title", " ".join(html.unescape(_TAG.sub("", title[1])).split()))] if title else []
    about += [("outlink", html.unescape(next(x for x in m.groups() if x is not None))) for m in anchors if m]
    out = []
    meta_id, text_id = record_id(refers_to, "metadata"), record_id(refers_to, "conversion")
    meta = "".join(f"{k}: {v.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n" for k, v in [*about, ("conversion", text_id)]).encode()
    for kind, own, content, made in (("metadata", meta_id, "application/warc-fields", meta), ("conversion", text_id, "text/plain; charset=utf-8", plain_text(page).encode())):
        named = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Block-Digest", digest(made))]
        named += [("WARC-Payload-Digest", stated["payload"])] if kind == "metadata" else [("WARC-Refers-To-Payload-Digest", stated["payload"]), ("WARC-Concurrent-To", meta_id)]
        named.append(("Content-Type", content))
        out.append({"record_type": kind, "record_id": own, "refers_to": refers_to, "target_uri": target, "content_type": content, "content_length": len(made), "block_digest": digest(made), "payload_digest": stated["payload"], "record": record(named, made)})
    return out


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id and record: a response record for each page (page_id, url, html)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = []
            for page, url, text in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html")), strict=True):
                body = (text or "").encode()
                http = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
                made.append(response(url or "", date, record_id(f"{page}:{url or ''}", "response"), "HTTP/1.1 200 OK", http, body))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(made, pa.binary())], ["page_id", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, record binary")


def derivatives(records: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Two rows for each response record (page_id, record); ``record`` is the whole derived record, ready to be appended to
    a file. A record whose body unfolds to over most_bytes is one with an error."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split(" ")[1]] for f in SCHEMA.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[dict] = []
            for page, data in zip(batch.column("page_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                try:
                    rows += [{"page_id": page} | r for r in derive(data or b"", most_bytes)]
                except ValueError as e:
                    rows.append({"page_id": page, "error": str(e)})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return records.select(F.col("page_id").cast("long").alias("page_id"), F.col("record").cast("binary").alias("record")).mapInArrow(run, SCHEMA)


def op9(spark, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))
