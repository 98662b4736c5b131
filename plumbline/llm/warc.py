"""Derived WARC/1.1 records: for each response a metadata and a plain-text conversion record that refer to it.

``responses`` makes response records of crawled pages; ``derivatives`` makes of each response record
 - a ``metadata`` record (``application/warc-fields``) with the source's headers that a reader of the text needs: its
   digests, length, content type, the title and the outgoing links, and
 - a ``conversion`` record (``text/plain``) with the page's text.
Both keep WARC-Refers-To, -Target-URI and -Date of the response, and name its digest; the two are linked by
WARC-Concurrent-To. Record ids are UUIDs made of digests, so that a job that runs again makes the same records. Digests
are SHA-1, in hexadecimal, of the block; lengths are in bytes. It is one narrow projection without Python or shuffle.

The response's HTTP status and headers are fields of the metadata record, ``source-http``, a line each.

Text of HTML: scripts, styles, comments and tags go, block tags break lines, character references are decoded, runs of
blanks become one, and blank lines go. All named references of HTML that end in a semicolon are decoded, and all numeric
ones of characters that there are, those of the C1 range as Windows-1252; &nbsp; becomes a space; others stay as they are.
Titles and links are decoded likewise.

Cases: a null page is an empty one, a null URL leaves the target headers out and counts as empty in digests; empty text
makes a conversion of length 0; texts of any length are converted whole; repeated rows make equal records with equal ids;
a null ``page_id`` stays null and ids come from the content; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table

#: When the pages were fetched, as the pages table has no time.
FETCHED = "2024-01-01T00:00:00Z"

BLOCK_TAGS = "p|div|br|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|article|section|header|footer|nav|title|blockquote|pre|td|th"

#: (pattern, replacement), one after another, in a syntax that Java and RE2 read alike; before references are decoded, and after.
TAG_STEPS = (
    (r"(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|!--.*?-->)", " "),
    (rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*> *", "\n"),
    (r"<[^>]*>", ""),
)
BLANK_STEPS = ((r" {2,}", " "), (r" ?\n[\n ]*", "\n"))

#: White space within a line.
BLANKS = "\r\n\t"

TITLE, LINK = r"(?is)<title[^>]*>([^<]*)</title", r'(?i)<a\s[^>]*?href="([^"]*)"'


def _references() -> dict[str, str]:
    """Names with their characters, the frequent ones first, as they are looked for in this order."""
    known = {k[:-1]: v for k, v in html5.items() if k.endswith(";")} | {"nbsp": " ", "NonBreakingSpace": " "}
    first = [*("amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "middot"), *name2codepoint]
    return {k: known[k] for k in dict.fromkeys([*first, *known])}


REFERENCES = _references()

#: Of the numbers 128 to 159.
C1 = [bytes([k]).decode("cp1252", "replace").replace("\ufffd", chr(k)) for k in range(128, 160)]

#: A reference's name, or its number, in what follows an ampersand.
NAME, HEX, DECIMAL = "^(#?[0-9A-Za-z]{1,31});", "^#[xX]0*([0-9a-fA-F]{1,6})$", "^#0*([0-9]{1,7})$"


def _let(value: Column, then) -> Column:
    """``then`` of the value, which is made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def decoded(text: Column) -> Column:
    """``text`` with its character references decoded, each once."""
    # constants, which the optimizer makes once
    named = F.str_to_map(F.lit("\2".join(f"{k}\1{v}" for k, v in REFERENCES.items())), F.lit("\2"), F.lit("\1"))
    c1 = F.split(F.lit("\2".join(C1)), "\2")

    def numbered(code: Column) -> Column:
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(code.between(128, 159), F.get(c1, code - 128)).when(code == 160, " ").when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def meant(name: Column) -> Column:
        number = F.coalesce(F.conv(F.nullif(F.regexp_extract(name, HEX, 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(name, DECIMAL, 1), F.lit("")))
        return F.when(name.startswith("#"), _let(number.cast("int"), numbered)).otherwise(F.try_element_at(named, name))

    def one(part: Column) -> Column:
        put = lambda name: F.coalesce(F.concat(meant(name), F.substring(part, F.length(name) + 2, F.length(part))), F.concat(F.lit("&"), part))
        return _let(F.regexp_extract(part, NAME, 1), put)

    whole = lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))
    return _let(F.split(text, "&", -1), whole)


def _replaced(text: Column, steps: tuple) -> Column:
    for pattern, put in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(put))
    return text


def text_of(html: Column) -> Column:
    return F.btrim(_replaced(decoded(_replaced(F.translate(html, BLANKS, " " * len(BLANKS)), TAG_STEPS)), BLANK_STEPS), F.lit(" \n"))


def _uuid(*parts: Column) -> Column:
    h = F.sha1(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-5"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(block.cast("binary")))


def _size(block: Column) -> Column:
    return F.octet_length(block)


def responses(pages: DataFrame, fetched: str = FETCHED) -> DataFrame:
    """(page_id, record_id, target_uri, warc_date, content_type, http, payload, payload_digest, block_digest, content_length)."""
    p = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string").alias("target_uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("http", F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), _size(F.col("payload")), F.lit("\r\n\r\n")))
    p = p.withColumn("payload_digest", _digest(F.col("payload"))).withColumn("block_digest", _digest(F.concat("http", "payload")))
    return p.select(
        "page_id",
        _uuid(F.lit("response"), F.coalesce("target_uri", F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("block_digest")).alias("record_id"),
        "target_uri",
        F.lit(fetched).alias("warc_date"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        "http",
        "payload",
        "payload_digest",
        "block_digest",
        (_size(F.col("http")) + _size(F.col("payload"))).cast("bigint").alias("content_length"),
    )


def _line(name: str, value: Column) -> Column:
    """A header line, or null without a value; concat_ws leaves nulls out."""
    return F.concat(F.lit(f"{name}: "), value)


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response: page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, block_digest,
    source_digest, content_length, headers, content."""
    title = F.trim(decoded(F.regexp_extract("payload", TITLE, 1)))
    links = F.transform(F.regexp_extract_all("payload", F.lit(LINK), 1), decoded)
    fields = F.concat_ws(
        "\r\n",
        _line("source-block-digest", F.col("block_digest")),
        _line("source-payload-digest", F.col("payload_digest")),
        _line("source-content-length", F.col("content_length").cast("string")),
        _line("source-content-type", F.col("content_type")),
        _line("source-http", F.replace(F.rtrim("http", F.lit("\r\n")), F.lit("\r\n"), F.lit("\r\nsource-http: "))),
        _line("title", F.when(title != "", title)),
        F.when(F.size(links) > 0, F.concat(F.lit("outlink: "), F.array_join(links, "\r\noutlink: "))),
    )
    kinds = [("metadata", "application/warc-fields", F.concat(fields, F.lit("\r\n"))), ("conversion", "text/plain; charset=utf-8", text_of(F.col("payload")))]
    blocks = F.array(*(F.struct(F.lit(k).alias("warc_type"), F.lit(t).alias("type"), c.alias("content")) for k, t, c in kinds))
    one = records.withColumn("made", F.explode(blocks)).select("*", "made.*")
    own, other = (_uuid(k, F.col("record_id")) for k in (F.col("warc_type"), F.when(F.col("warc_type") == "metadata", "conversion").otherwise("metadata")))
    one = one.withColumn("made_digest", _digest(F.col("content"))).withColumn("made_id", own).withColumn("linked", other)
    headers = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        _line("WARC-Type", F.col("warc_type")),
        _line("WARC-Record-ID", F.col("made_id")),
        _line("WARC-Date", F.col("warc_date")),
        _line("WARC-Refers-To", F.col("record_id")),
        _line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        _line("WARC-Refers-To-Date", F.col("warc_date")),
        _line("WARC-Concurrent-To", F.col("linked")),
        _line("WARC-Target-URI", F.col("target_uri")),
        _line("WARC-Block-Digest", F.col("made_digest")),
        _line("Content-Type", F.col("type")),
        _line("Content-Length", _size(F.col("content")).cast("string")),
    )
    return one.select(
        "page_id",
        "warc_type",
        F.col("made_id").alias("record_id"),
        F.col("record_id").alias("refers_to"),
        F.col("linked").alias("concurrent_to"),
        "target_uri",
        F.col("made_digest").alias("block_digest"),
        F.col("block_digest").alias("source_digest"),
        _size(F.col("content")).cast("bigint").alias("content_length"),
        headers.alias("headers"),
        "content",
    )


def serialized(made: DataFrame) -> DataFrame:
    """(record_id, record): each record as it stands in a WARC file."""
    return made.select("record_id", F.encode(F.concat("headers", F.lit("\r\n\r\n"), "content", F.lit("\r\n\r\n")), "utf-8").alias("record"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


def _quoted(x: str) -> str:
    return "E'" + x.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"


def _sql_replaced(text: str, steps: tuple) -> str:
    for pattern, put in steps:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', {_quoted(put)}, 'g')"
    return text


_CODE = f"CAST(coalesce('0x' || nullif(regexp_extract(name, '{HEX}', 1), ''), nullif(regexp_extract(name, '{DECIMAL}', 1), '')) AS INTEGER)"


def _sql_uuid(inner: str) -> str:
    h = f"sha1({inner})"
    return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"


def _sql_lines(*lines: tuple[str, str]) -> str:
    return "concat_ws(E'\\r\\n', " + ", ".join(f"'{name}: ' || {value}" if name else value for name, value in lines) + ")"


SQL = f"""
WITH known AS (SELECT unnest([{", ".join(map(_quoted, REFERENCES))}]) AS k, unnest([{", ".join(map(_quoted, REFERENCES.values()))}]) AS v),
p AS (SELECT row_number() OVER () AS nr, page_id, url AS target_uri, coalesce(html, '') AS payload FROM pages),
h AS (SELECT *, E'HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ' || octet_length(encode(payload)) || E'\\r\\n\\r\\n' AS http FROM p),
raw AS (
  SELECT nr, 'title' AS kind, 0 AS k, regexp_extract(payload, '{TITLE}', 1) AS t FROM p UNION ALL
  SELECT nr, 'text', 0, {_sql_replaced(f"translate(payload, {_quoted(BLANKS)}, '   ')", TAG_STEPS)} FROM p UNION ALL
  SELECT nr, 'link', unnest(generate_series(1, len(l))), unnest(l) FROM (SELECT nr, regexp_extract_all(payload, '{LINK}', 1) AS l FROM p)),
parts AS (SELECT nr, kind, k, unnest(generate_series(1, len(x))) AS nth, unnest(x) AS part FROM (SELECT nr, kind, k, string_split(t, '&') AS x FROM raw)),
names AS (SELECT *, CASE WHEN nth > 1 THEN regexp_extract(part, '{NAME}', 1) ELSE '' END AS name FROM parts),
codes AS (SELECT *, CASE WHEN name[1] = '#' THEN {_CODE} END AS code FROM names),
meant AS (SELECT nr, kind, codes.k, nth, part, name, CASE WHEN code BETWEEN 128 AND 159 THEN [{", ".join(map(_quoted, C1))}][code - 127] WHEN code = 160 THEN ' '
  WHEN code BETWEEN 1 AND 1114111 AND NOT code BETWEEN 55296 AND 57343 THEN chr(code) ELSE v END AS put FROM codes LEFT JOIN known ON known.k = name),
whole AS (SELECT nr, kind, k, string_agg(CASE WHEN nth = 1 THEN part WHEN put IS NULL THEN '&' || part ELSE put || substr(part, length(name) + 2) END, '' ORDER BY nth) AS t FROM meant GROUP BY ALL),
d AS (SELECT *, 'sha1:' || sha1(payload) AS payload_digest, 'sha1:' || sha1(http || payload) AS block_digest,
  octet_length(encode(http)) + octet_length(encode(payload)) AS source_length FROM h),
r AS (SELECT d.*, {_sql_uuid("concat_ws('|', 'response', coalesce(target_uri, ''), coalesce(CAST(page_id AS VARCHAR), ''), block_digest)")} AS source_id,
  trim(a.t, ' ') AS title, trim({_sql_replaced("b.t", BLANK_STEPS)}, E' \\n') AS plain, links
  FROM d JOIN whole a ON a.nr = d.nr AND a.kind = 'title' JOIN whole b ON b.nr = d.nr AND b.kind = 'text'
  LEFT JOIN (SELECT nr, string_agg('outlink: ' || t, E'\\r\\n' ORDER BY k) AS links FROM whole WHERE kind = 'link' GROUP BY nr) c ON c.nr = d.nr),
m AS (
  SELECT page_id, 'metadata' AS warc_type, 'conversion' AS other, 'application/warc-fields' AS type, source_id, target_uri, block_digest AS source_digest,
    {_sql_lines(("source-block-digest", "block_digest"), ("source-payload-digest", "payload_digest"), ("source-content-length", "source_length"), ("source-content-type", "'text/html; charset=utf-8'"), ("source-http", "replace(rtrim(http, E'\\r\\n'), E'\\r\\n', E'\\r\\nsource-http: ')"), ("title", "nullif(title, '')"), ("", "links"))} || E'\\r\\n' AS content FROM r
  UNION ALL
  SELECT page_id, 'conversion', 'metadata', 'text/plain; charset=utf-8', source_id, target_uri, block_digest, plain FROM r),
n AS (SELECT *, 'sha1:' || sha1(content) AS made_digest, {_sql_uuid("warc_type || '|' || source_id")} AS made_id, {_sql_uuid("other || '|' || source_id")} AS linked,
  octet_length(encode(content)) AS size FROM m)
SELECT page_id, warc_type, made_id AS record_id, source_id AS refers_to, linked AS concurrent_to, target_uri, made_digest AS block_digest, source_digest,
  CAST(size AS BIGINT) AS content_length,
  {_sql_lines(("", "'WARC/1.1'"), ("WARC-Type", "warc_type"), ("WARC-Record-ID", "made_id"), ("WARC-Date", f"'{FETCHED}'"), ("WARC-Refers-To", "source_id"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", f"'{FETCHED}'"), ("WARC-Concurrent-To", "linked"), ("WARC-Target-URI", "target_uri"), ("WARC-Block-Digest", "made_digest"), ("Content-Type", "type"), ("Content-Length", "size"))} AS headers,
  content
FROM n
"""
