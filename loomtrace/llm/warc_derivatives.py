"""Derivatives of web-archive responses: linked metadata and plain-text conversion records.

Every response record gives two records of its own: ``metadata`` (title, language, links, and the
response's header lines and digests as ``application/warc-fields``) and ``conversion`` (the page as
plain text).  Both name their response in ``WARC-Refers-To`` with its URI and date, each names
the other in ``WARC-Concurrent-To``, and both repeat the source's payload digest.
Record identifiers are hashes of what they name, so a lost executor's records come
out the same.  The whole operator is a map: no shuffle.

``response_records`` makes responses of crawled pages, ``archives`` lays them out as gzip members of archive
files, ``parse`` reads any archive's records and ``responses`` picks its responses, so the registered
query derives from records that were read out of real archives.  Pages and archives are read in time
proportional to their length, whatever they hold.

Defined results
  * null or empty html: a response with an empty payload; its conversion block is empty.
  * null url: target URI ``urn:page:<page_id>``; null page_id, or one that is no whole number: ignored (its records could not be named).
  * repeated rows: repeated records with equal identifiers; a page's identifiers differ when its url or html does.
  * unclosed comments and elements stay as text from where they open; a tag without its end stays too.
  * a broken member or record gives a row with ``error`` and reading goes on at the next member or record.
  * line ends in a url become spaces in its record's header, other characters stay.
  * empty table: empty result.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import gzip
import html as html_entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Regular expressions that mean the same to Java and to RE2.
HIDDEN = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|noscript\b.*?</noscript\s*>|template\b.*?</template\s*>|head\b.*?</head\s*>|!doctype[^>]*>)"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
TAG = r"</?[a-zA-Z][^>]*>"
ODD_SPACE = "\t\x0b\x0c\r\xa0"
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
LANG = r"(?is)<html\b[^>]*?\blang=[\x22\x27]?([A-Za-z0-9-]+)"
HREF = r"(?i)<a\s[^>]*?href=[\x22\x27]?([^\x22\x27\s>]+)"


_SPACE = r"[\t\n\f\r ]"
_HIDES = re.compile(r"(?ia)<(?:(!--)|(!doctype)|(script|style|noscript|template|head)\b)")
_HIDDEN_END = {t: re.compile(rf"(?ia)</{t}{_SPACE}*+>") for t in ("script", "style", "noscript", "template", "head")}
_BLOCK, _TAG = re.compile("(?a)" + BLOCK), re.compile(TAG)
_TITLE, _TITLE_END = re.compile(r"(?ia)<title[^>]*>"), re.compile(rf"(?ia)</title{_SPACE}*+>")
_HTML, _LANG = re.compile(r"(?ia)<html\b[^>]*"), re.compile(r"(?ia)\blang=[\x22\x27]?([A-Za-z0-9-]+)")
_A, _HREF = re.compile(rf"(?ia)<a{_SPACE}"), re.compile(r"(?ia)href=[\x22\x27]?([^\x22\x27\t\n\f\r >]+)")
_SPACES, _BREAKS, _WHITE = re.compile(" {2,}"), re.compile(r" ?\n[ \n]*"), re.compile(rf"{_SPACE}+")


def shown(html: str) -> str:
    """What ``HIDDEN`` leaves.  Where an end is missing once, it is missing from there on and not looked for again."""
    out, at, missing = [], 0, set()
    while m := _HIDES.search(html, at):
        kind = m[1] or m[2] or m[3].lower()
        end = -1
        if kind not in missing:
            if m[3]:
                e = _HIDDEN_END[kind].search(html, m.end())
                end = e.end() if e else -1
            else:
                e = html.find("-->" if m[1] else ">", m.end())
                end = e + (3 if m[1] else 1) if e >= 0 else -1
            if end < 0:
                missing.add(kind)
        stop = end if end >= 0 else m.end()
        out.append(html[at : m.start()] if end >= 0 else html[at:stop])
        at = stop
    return "".join(out) + html[at:]


def _spaced(text: str, characters: str) -> str:
    """Each of the characters as a space; a few replacements are far faster than one translation."""
    for c in characters:
        text = text.replace(c, " ")
    return text


def _tags(text: str, pattern: re.Pattern, put: str) -> str:
    """A tag needs a ``>``, so none begins after the last one; before it every opening finds its end."""
    last = text.rfind(">") + 1
    return pattern.sub(put, text[:last]) + text[last:]


def plain_text(html: str) -> str:
    """Visible text: hidden elements dropped, one line for each block, references resolved, white space folded."""
    bare = _tags(_tags(_spaced(shown(html), "\r\n"), _BLOCK, "\n"), _TAG, "")
    if "&" in bare:
        bare = html_entities.unescape(bare)
    return _BREAKS.sub("\n", _SPACES.sub(" ", _spaced(bare, ODD_SPACE))).strip(" \n")


def title(html: str) -> str:
    m = _TITLE.search(html)
    end = _TITLE_END.search(html, m.end()) if m else None
    return _WHITE.sub(" ", html[m.end() : end.start()]).strip(" ") if end else ""


def language(html: str) -> str:
    for m in _HTML.finditer(html):
        k = _LANG.search(m[0], 5)
        if k:
            return k[1]
    return ""


def outlinks(html: str) -> list[str]:
    """The ``href`` of every link, in order of first appearance."""
    found: dict[str, None] = {}
    at, end = 0, -1
    while m := _A.search(html, at):
        if end < m.end():
            end = html.find(">", m.end())
            end = len(html) if end < 0 else end
        k = _HREF.search(html, m.end(), end)
        if k:
            found.setdefault(k[1])
        at = k.end() if k else max(end, m.end())
    return list(found)


def _page_reader() -> Column:
    """A column function ``payload -> struct(text, title, language, links)``."""

    @F.arrow_udf("text string, title string, language string, links array<string>")
    def read(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
        for column in columns:
            rows = [(plain_text(h), title(h), language(h), outlinks(h)) for h in (v.as_py() for v in column)]
            cols = zip(*rows) if rows else ((), (), (), ())
            yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["text", "title", "language", "links"])

    return read


def urn(*parts: Column | str) -> Column:
    """A deterministic ``<urn:uuid:...>`` of the parts."""
    h = F.md5(F.concat_ws("\n", *parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def response_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``(page_id, record_id, target_uri, date, headers, payload, payload_digest)`` of each page; crawl time is a parameter, as pages have none."""
    p = pages.select(F.col("page_id").try_cast("bigint").alias("page_id"), F.translate("url", "\r\n", "  ").alias("url"), F.coalesce("html", F.lit("")).alias("payload")).filter("page_id is not null")
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"))
    p = p.withColumn("target_uri", F.coalesce("url", F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")))).withColumn("payload_digest", digest(F.col("payload")))
    return p.select("page_id", urn(F.lit("response"), F.col("page_id").cast("string"), "target_uri", "payload_digest").alias("record_id"), "target_uri", F.lit(date).alias("date"), headers.alias("headers"), "payload", "payload_digest")


def derive(responses: DataFrame) -> DataFrame:
    """Two linked records of each response.

    Columns: ``page_id, record_type, record_id, refers_to, concurrent_to, target_uri, date, content_type,
    content_length, block_digest, source_digest, source_headers, block``.
    """
    r = responses.withColumn("page", _page_reader()("payload"))
    lines = F.concat(
        F.lit("title: "), F.col("page.title"), F.lit(f"{CRLF}language: "), F.col("page.language"),
        F.lit(f"{CRLF}source-payload-digest: "), F.col("payload_digest"),
        F.lit(f"{CRLF}source-header: "), F.replace("headers", F.lit(CRLF), F.lit(f"{CRLF}source-header: ")),
        F.array_join(F.transform("page.links", lambda u: F.concat(F.lit(f"{CRLF}outlink: "), u)), ""), F.lit(CRLF),
    )
    metadata, conversion = urn(F.lit("metadata"), "record_id"), urn(F.lit("conversion"), "record_id")
    record = lambda kind, own, other, of, block: F.struct(F.lit(kind).alias("record_type"), own.alias("own"), other.alias("other"), F.lit(of).alias("content_type"), block.alias("block"))
    both = F.array(record("metadata", metadata, conversion, "application/warc-fields", lines), record("conversion", conversion, metadata, "text/plain; charset=utf-8", F.col("page.text")))
    made = r.select("page_id", "record_id", "target_uri", "date", "headers", "payload_digest", F.explode(both).alias("d"))
    return made.select(
        "page_id", "d.record_type", F.col("d.own").alias("record_id"), F.col("record_id").alias("refers_to"), F.col("d.other").alias("concurrent_to"), "target_uri", "date", "d.content_type",
        F.octet_length("d.block").alias("content_length"), digest(F.col("d.block")).alias("block_digest"), F.col("payload_digest").alias("source_digest"), F.col("headers").alias("source_headers"), "d.block",
    )


def derivatives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Metadata and conversion records of crawled pages, by way of archives of their responses."""
    return derive(responses(parse(archives(response_records(pages, date)))))


def _members(batch: pa.RecordBatch) -> list[bytes]:
    return [gzip.compress(v.as_py(), 1, mtime=0) for v in batch.column(0)]


def _record(fields: list[tuple[str, Column | str]], *block: Column | str) -> Column:
    """One record as bytes; field names are literals, values are columns."""
    parts = [F.lit("WARC/1.1")]
    for name, c in fields:
        parts += [F.lit(f"{CRLF}{name}: "), F.col(c).cast("string") if isinstance(c, str) else c]
    return F.concat(*parts, F.lit(CRLF + CRLF), *block, F.lit(CRLF + CRLF)).cast("binary")


def archives(responses: DataFrame) -> DataFrame:
    """``(path, content)``: archive files of the responses, one gzip member each; the rows that travel together make one file."""
    http = F.concat("headers", F.lit(CRLF + CRLF), "payload")
    fields = [("WARC-Type", F.lit("response")), ("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Payload-Digest", "payload_digest"), ("X-Page-Id", "page_id"), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(http))]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(["responses.warc.gz"]), pa.array([b"".join(_members(batch))], pa.binary())], ["path", "content"])

    return responses.select(_record(fields, http).alias("record")).mapInArrow(write, "path string, content binary")


def to_bytes(records: DataFrame) -> DataFrame:
    """``(record_id, member)``: each derivative as one gzip member of an archive file; members may be joined in any order."""
    fields = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(_members(batch), pa.binary())], ["record_id", "member"])

    return records.select(_record(fields, "block").alias("record"), "record_id").mapInArrow(pack, "record_id string, member binary")


_MAGIC = b"\x1f\x8b\x08"
_STEP = 1 << 16


def members(blob: bytes) -> Iterator[tuple[bytes, str | None]]:
    """Decompressed gzip members of an archive file, one after another, each with what broke it; after a broken one the next
    place that looks like a member is tried."""
    view, at = memoryview(blob), 0
    while 0 <= at < len(blob):
        one, parts, pos = zlib.decompressobj(31), [], at
        try:
            while not one.eof and pos < len(blob):
                step = view[pos : pos + _STEP]
                parts.append(one.decompress(step))
                pos += len(step)
        except zlib.error as e:
            yield b"", str(e)
        else:
            if one.eof:
                yield b"".join(parts), None
                at = pos - len(one.unused_data)
                continue
            yield b"", "the file ends inside a member"
        at = blob.find(_MAGIC, at + 1)


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)\r?$", re.M)


def records(chunk: bytes) -> Iterator[tuple[list, bytes, str | None]]:
    """(fields, block, what is wrong) of the records in plain bytes; after a wrong one the next line that opens a record is tried."""
    at = 0
    while at < len(chunk):
        head = chunk.find(b"\r\n\r\n", at)
        if not chunk.startswith(b"WARC/", at) or head < 0:
            wrong = "no record begins here"
        else:
            fields = {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in _FIELD.findall(chunk[at:head])}
            size = next((v for k, v in fields.items() if k.lower() == "content-length"), "")
            if size.isdecimal() and head + 4 + int(size) <= len(chunk):
                body = head + 4
                yield list(fields.items()), chunk[body : body + int(size)], None
                at = body + int(size)
                while chunk.startswith(b"\r\n", at):
                    at += 2
                continue
            wrong = "the record ends early" if size.isdecimal() else "the record has no length"
        yield [], b"", wrong
        at = chunk.find(b"\nWARC/", at + 1) + 1 or len(chunk)


def parse(archives: DataFrame) -> DataFrame:
    """``(path, at, headers, block, error)`` of every record in binary files ``(path, content)``, compressed or plain."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
        names = ["path", "at", "headers", "block", "error"]
        out: list[list] = [[] for _ in names]
        held = 0
        for batch in batches:
            for path, file in zip(batch.column(0), batch.column(1)):
                content, at = file.as_py() or b"", 0
                for chunk, broken in members(content) if content[:2] == _MAGIC[:2] else [(content, None)]:
                    for fields, block, wrong in [([], b"", broken)] if broken else records(chunk):
                        for col, v in zip(out, (path.as_py(), at, fields, block, wrong)):
                            col.append(v)
                        at, held = at + 1, held + len(block)
                        if held > 1 << 23:  # one file may hold any number of records
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                            out, held = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return archives.select("path", "content").mapInArrow(read, "path string, at int, headers map<string,string>, block binary, error string")


def responses(parsed: DataFrame) -> DataFrame:
    """The response records among parsed ones, as ``derive`` takes them: ``(page_id, record_id, target_uri, date, headers, payload, payload_digest)``.

    A response without a payload digest gets one, text that is no UTF-8 is read with replacement characters, and a block
    without a blank line is all headers.
    """
    of = lambda name: F.element_at("headers", name)
    http = F.make_valid_utf8(F.col("block").cast("string"))
    cut_at = F.instr(http, CRLF + CRLF)
    p = parsed.filter(F.col("error").isNull() & (F.lower(of("WARC-Type")) == "response")).select(
        of("X-Page-Id").try_cast("bigint").alias("page_id"), of("WARC-Record-ID").alias("record_id"), of("WARC-Target-URI").alias("target_uri"), of("WARC-Date").alias("date"), of("WARC-Payload-Digest").alias("given"),
        F.when(cut_at > 0, F.substring(http, F.lit(1), cut_at - 1)).otherwise(http).alias("http_headers"), F.when(cut_at > 0, F.substring(http, cut_at + 4, F.length(http))).otherwise("").alias("payload"),
    )
    return p.select("page_id", "record_id", "target_uri", "date", F.col("http_headers").alias("headers"), "payload", F.coalesce("given", digest(F.col("payload"))).alias("payload_digest"))
