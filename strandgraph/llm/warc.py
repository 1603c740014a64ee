"""Derivative records of archived responses: linked metadata and plain-text conversions.

Each response gives a metadata record (application/warc-fields: title, outlinks, the source's headers) and a conversion
record (text/plain). Both name the response they refer to, keep its target, date and payload digest, and carry their own
identifier, length and block digest. All of it is SQL functions over one row a response; nothing is shuffled.

Control signs, line ends among them, are left out of the values of headers and of the source's header lines, so that no target or
header can begin a line of its own; the columns keep them.

Every pattern reads a payload in linear time, whatever it holds: comments, scripts and styles that nothing closes run to the
end, and a tag ends at the next angle bracket, so a ">" or "<" inside an attribute's value ends the tag there.

Edge cases: a null payload or target reads as empty and gives records of an empty text; null ids make records
that refer to the digest of the rest; a response without a date gets UNDATED, or the date that the caller names; repeated
responses give repeated records; an empty table gives no rows; further columns are not read. Payloads of any length are converted whole.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Every record has a date; this one says that the source names none.
UNDATED = "1970-01-01T00:00:00Z"
#: Patterns of the conversion, applied in this order; shared with the SQL that checks it.
DROPPED = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^<>]*>"
TAGS = r"<[^<>]*>"
BLANKS, LINES, EDGES = r"[ \t\r\f]+", r" ?\n[ \n]*", r"^[ \n]+|[ \n]+$"
TITLE = r"(?is)<title\b[^<>]*>(.*?)(?:</title\s*>|\z)"
LINK = r"""(?i)<a\s(?:[^<>]*?\s)?href\s*=\s*("[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)"""
#: Signs that no value of a header may hold.
CONTROL = r"[\x00-\x1F\x7F]"
QUOTES, ENDS = r"""^["']|["']$""", r"[\t\r\n]"
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Entities by name; numbers that pages write in the Windows code page stand for its signs; a hard space reads as a space.
ENTITIES = {
    **{name: chr(code) for name, code in name2codepoint.items()},
    **{f"#{n}": bytes([n]).decode("cp1252", "replace") for n in range(128, 160)},
    **{"apos": "'", "nbsp": " ", "#160": " "},
}


def _letter(code: Column) -> Column:
    """The sign of a code point, from its UTF-8 bytes; what is no sign gives the replacement character."""
    low = lambda shift: F.shiftright(code, shift).bitwiseAND(F.lit(63))
    coded = (
        F.when(code < 0x80, code)
        .when(code < 0x800, 0xC080 + F.shiftleft(F.shiftright(code, 6), 8) + low(0))
        .when(code < 0x10000, 0xE08080 + F.shiftleft(F.shiftright(code, 12), 16) + F.shiftleft(low(6), 8) + low(0))
        .otherwise(0xF0808080 + F.shiftleft(F.shiftright(code, 18), 24) + F.shiftleft(low(12), 16) + F.shiftleft(low(6), 8) + low(0))
    )
    fine = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(fine, F.unhex(F.hex(coded)).cast("string")).otherwise("\ufffd")


def _entities(x: Column) -> Column:
    """Entities resolved, each once; a sign that begins none stays."""
    known = F.create_map(*(F.lit(v) for pair in ENTITIES.items() for v in pair))

    def resolved(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, ENTITY, 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).cast("long")
        sign = F.coalesce(known[name], F.when(name.startswith("#"), _letter(number)))
        rest = F.substr(part, F.length(name) + 2)
        return F.when(i == 0, part).when((name != "") & sign.isNotNull(), F.concat(sign, rest)).otherwise(F.concat(F.lit("&"), part))

    return F.when(x.contains("&"), F.array_join(F.transform(F.split(x, "&"), resolved), "")).otherwise(x)


def _squeezed(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, BLANKS, " "), LINES, "\n"), EDGES, "")


def plain_text(shown: Column) -> Column:
    """Visible text of HTML without comments, scripts and styles: a line for each block, entities resolved, white space squeezed."""
    x = F.regexp_replace(F.regexp_replace(shown, BREAKS, "\n"), TAGS, "")
    return _squeezed(_entities(x))


def uuid_of(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def responses(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """Response records from a table of pages (page_id, url, html); ``date`` is when a page was fetched, as WARC writes dates."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html), F.lit(CRLF))
    when = F.lit(None) if date is None else date
    return pages.select(uuid_of(F.lit("response"), key, url).alias("record_id"), url.alias("target_uri"), when.cast("string").alias("date"), head.alias("http_headers"), html.alias("payload"))


def derive(records: DataFrame, undated: str = UNDATED) -> DataFrame:
    """Two rows for each response: record_type, record_id, refers_to, target_uri, date, content_type, content_length,
    block_digest, payload_digest, header, block."""
    none = F.lit("")
    base = records.select(
        *(F.coalesce(c, none).alias(c) for c in ("record_id", "target_uri", "http_headers", "payload")),
        F.coalesce(F.col("date").cast("string"), F.lit(undated)).alias("date"),
    ).select("*", digest(F.col("payload")).alias("payload_digest"), F.regexp_replace("payload", DROPPED, "").alias("shown"))
    title = _squeezed(_entities(F.regexp_replace(F.regexp_extract("shown", TITLE, 1), TAGS, "")))
    found = F.regexp_extract_all("shown", F.lit(LINK), F.lit(1))
    links = F.transform(found, lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(_entities(F.regexp_replace(x, QUOTES, "")), ENDS, ""), F.lit(" L a/@href"), F.lit(CRLF)))
    source = F.transform(F.filter(F.split("http_headers", CRLF), lambda h: h.contains(":")), lambda h: F.concat(F.lit("source-"), F.regexp_replace(h, CONTROL, ""), F.lit(CRLF)))
    fields = F.concat(F.lit("title: "), F.replace(title, F.lit("\n"), F.lit(" ")), F.lit(CRLF), F.array_join(source, ""), F.array_join(links, ""))
    two = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("shown")).alias("block")),
    )
    rows = base.select("record_id", "target_uri", "date", "payload_digest", F.inline(two)).select(
        "record_type",
        uuid_of(F.col("record_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "content_type",
        F.octet_length("block").cast("long").alias("content_length"),
        digest(F.col("block")).alias("block_digest"),
        "payload_digest",
        "block",
    )
    lines = [("WARC-Type: ", "record_type"), ("WARC-Record-ID: ", "record_id"), ("WARC-Refers-To: ", "refers_to"), ("WARC-Target-URI: ", "target_uri"), ("WARC-Date: ", "date"), ("Content-Type: ", "content_type"), ("WARC-Block-Digest: ", "block_digest"), ("WARC-Payload-Digest: ", "payload_digest"), ("Content-Length: ", "content_length")]
    given = ("refers_to", "target_uri", "date")  # the others are made here
    value = lambda c: F.regexp_replace(c, CONTROL, "") if c in given else F.col(c).cast("string")
    header = F.concat(F.lit(f"WARC/1.1{CRLF}"), *(F.coalesce(F.concat(F.lit(name), value(c), F.lit(CRLF)), none) for name, c in lines))
    return rows.withColumn("header", header)
