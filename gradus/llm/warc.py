"""WARC archives: written and read by Spark's text files, and revisits resolved by payload digest.

A file's records are its rows: ``WARC/1.1``, named fields, an empty line, the
block and two line ends.  Spark's text writer puts the line ends between them,
and its reader splits files (also within one) at the version line.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, stream

VERSION = "WARC/1.1"
#: Shorter payloads are always responses.
LEAST_BYTES = 100
_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The named fields that are read, and the column of each.
FIELDS = {
    "type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "digest": "WARC-Payload-Digest",
    "refers_to_record": "WARC-Refers-To",
    "refers_to_uri": "WARC-Refers-To-Target-URI",
    "refers_to_date": "WARC-Refers-To-Date",
    "page_id": "Page-Id",
    "refers_to": "Refers-To-Page-Id",
    "length": "Content-Length",
}


def _field(name: str, value: Column) -> Column:
    """A header line; null where the value is null.  Line ends in a value are percent-encoded, as they would end the line."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A"))


def _record(fields: list[Column], http: Column, payload: Column | None) -> Column:
    block = http if payload is None else F.concat(http, payload)
    head = F.concat_ws(_END, F.lit(VERSION), *fields, _field("Content-Type", F.lit("application/http; msgtype=response")), _field("Content-Length", F.octet_length(block)))
    return F.concat(head, F.lit(2 * _END), block)


def _http(bytes_: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), bytes_.cast("string"), F.lit(2 * _END))


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A response record (column ``value``) for each row, the payload its html in UTF-8.

    Null html is empty; a null url or page_id has no field.  Record ids are made
    of the row's fields and its place in the scan, so repeated rows differ.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("uri"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("h", F.md5(F.concat_ws("|", "page_id", "uri", "digest", "row")))
    urn = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring("h", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    fields = [_field("WARC-Type", F.lit("response")), _field("WARC-Record-ID", urn), _field("WARC-Target-URI", F.col("uri")), _field("WARC-Date", F.lit(date)), _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), _field("Page-Id", F.col("page_id"))]
    return rows.select(_record(fields, _http(F.octet_length("payload")), F.col("payload")).alias("value"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One file for each task; a task that is run again replaces its own file when it commits.

    Compressed files are read by one task each; with "none", readers split them.
    """
    records.select("value").write.mode("overwrite").option("lineSep", 2 * _END).option("compression", compression).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between version lines, and whether it is as long as its fields say."""
    text = spark.read.option("lineSep", VERSION + _END).text(path)
    rows = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).filter("value <> ''")
    rows = rows.withColumn("head", F.substring_index("value", 2 * _END, 1))
    length = F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*(\d+)", 1).try_cast("bigint")
    return rows.withColumn("whole", F.coalesce(F.octet_length("value") == F.octet_length("head") + length + 8, F.lit(False)))


def _stitched(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Records of one file, in order: pieces are joined until they are as long as the first one's fields say."""
    held, size, want = [], 0, None
    mark = (VERSION + _END).encode()
    for *_, value in rows:
        value = bytes(value)
        if held:
            held.append(mark + value)
            size += len(mark) + len(value)
        else:
            held, size, want = [value], len(value), None
        if want is None:
            head, found, _ = b"".join(held).partition(b"\r\n\r\n")
            for line in head.split(b"\r\n") if found else ():
                name, _, said = line.partition(b":")
                if name.strip().lower() == b"content-length" and said.strip().isdigit():
                    want = len(head) + int(said) + 8
            if found and want is None:
                want = 0
        if want is not None and size >= want:
            yield (b"".join(held), size == want)
            held = []
    if held:
        yield (b"".join(held), False)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at path: ``FIELDS``, payload_bytes, http, payload, value and whole.

    Payloads may hold a version line, even a whole archive: pieces shorter than
    their Content-Length are joined with those that follow, file by file; only
    files with such a piece are read again for it, one row at a time in a task.
    A record that is shorter or longer than it says (a torn file) comes with
    ``whole`` false.  payload_bytes is that of the full payload, also for a
    revisit, whose block holds only the HTTP head.
    """
    pieces = _pieces(spark, path)
    torn = pieces.filter("not whole").select(F.col("file").alias("f")).distinct()
    if torn.isEmpty():
        rows = pieces.select("value", "whole")
    else:
        # Few files: what fits is broadcast by Spark's own measure.
        own = pieces.join(torn, F.col("file") == F.col("f"), "left_semi")
        rest = pieces.join(torn, F.col("file") == F.col("f"), "left_anti")
        held = own.select("file", "start", F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("v"))
        joined = stream(held, ["file"], ["start", "row"], _stitched, "value binary, whole boolean", size=64)
        rows = rest.select("value", "whole").unionAll(joined.select(F.col("value").cast("string").alias("value"), "whole"))
    rows = rows.withColumn("head", F.substring_index("value", 2 * _END, 1))
    said = {c: F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1) for c, name in FIELDS.items()}
    rows = rows.select("value", "whole", "head", *[F.when(x != "", x).alias(c) for c, x in said.items()])
    for c in ("page_id", "refers_to", "length"):
        rows = rows.withColumn(c, F.col(c).try_cast("bigint"))
    start = F.octet_length("head") + 5
    rows = rows.withColumn("block", F.substring(F.col("value").cast("binary"), start, F.col("length").cast("int")).cast("string"))
    rows = rows.withColumn("http", F.concat(F.substring_index("block", 2 * _END, 1), F.lit(2 * _END)))
    payload = F.substring(F.col("block").cast("binary"), F.octet_length("http") + 1, F.octet_length("block")).cast("string")
    declared = F.regexp_extract("http", r"(?im)^Content-Length:[ \t]*(\d+)", 1).try_cast("bigint")
    rows = rows.withColumn("payload", F.when(F.col("type") == "response", payload))
    return rows.select(*FIELDS, F.coalesce(F.octet_length("payload").cast("bigint"), declared).alias("payload_bytes"), "http", "payload", "value", "whole")


def resolve(records: DataFrame, work: Workspace, least: int = LEAST_BYTES) -> DataFrame:
    """Of each record that revisits another: its record_id, and record, uri, date and page of that other.

    Of responses with one payload digest and at least ``least`` bytes the
    smallest page_id (nulls last, then the record id) stays.  Only headers are
    shuffled, and a digest's first record is a map-side combined minimum; the
    join is split where many records share a digest.
    """
    heads = records.filter((F.col("type") == "response") & F.col("whole") & (F.col("payload_bytes") >= least)).select("digest", "page_id", "record_id", "uri", "date")
    first = F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "record_id", "uri", "date"))
    firsts = heads.groupBy("digest").agg(first.alias("o"), F.count("*").alias("n")).filter("n > 1")
    firsts = work.save(firsts.select(F.col("digest").alias("d"), "o"), "originals")
    found = heads.join(firsts, F.col("digest") == F.col("d")).filter("record_id <> o.record_id")
    return found.select(F.col("record_id").alias("r"), F.col("o.record_id").alias("to_record"), F.col("o.uri").alias("to_uri"), F.col("o.date").alias("to_date"), F.col("o.page_id").alias("to_page"))


def deduplicated(records: DataFrame, work: Workspace, least: int = LEAST_BYTES) -> DataFrame:
    """The records (column ``value``) with revisits in place of repeated payloads, under fresh headers.

    A revisit keeps its record id, uri, date, digest and HTTP head.  Records
    that are no response, or not whole, are written as they are.  Payloads are
    shuffled once, by record id, which no two records share.
    """
    found = work.save(resolve(records, work, least), "revisits")
    rows = records.join(found, F.col("record_id") == F.col("r"), "left")
    common = [_field(FIELDS[c], F.col(c)) for c in ("record_id", "uri", "date", "digest", "page_id")]
    to = [_field(FIELDS[c], F.col(v)) for c, v in (("refers_to_record", "to_record"), ("refers_to_uri", "to_uri"), ("refers_to_date", "to_date"), ("refers_to", "to_page"))]
    revisit = _record([_field("WARC-Type", F.lit("revisit")), _field("WARC-Profile", F.lit(_PROFILE)), *common, *to], F.col("http"), None)
    response = _record([_field("WARC-Type", F.lit("response")), *common], F.col("http"), F.col("payload"))
    # What is read lacks its version line, and ends with the line ends that the writer adds.
    raw = F.concat(F.lit(VERSION + _END), F.regexp_replace("value", "\r\n\r\n\\z", ""))
    return rows.select(F.when(F.col("r").isNotNull(), revisit).when((F.col("type") == "response") & F.col("whole"), response).otherwise(raw).alias("value"))


def restored(records: DataFrame) -> DataFrame:
    """Records with the payload of the record they refer to where they are revisits (null if that is not there)."""
    bodies = records.filter("type = 'response'").select(F.col("record_id").alias("b"), F.col("payload").alias("body"))
    rows = records.join(bodies, F.col("refers_to_record") == F.col("b"), "left")
    return rows.withColumn("payload", F.coalesce("payload", "body")).drop("b", "body")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` through an archive and its deduplicated copy; digests of responses are taken from what is read back."""
    work = Workspace(spark, "warc")
    write(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), work.path("archive"))
    write(deduplicated(read(spark, work.path("archive")), work), work.path("unique"))
    work.drop("archive", "originals", "revisits")
    kept = read(spark, work.path("unique"))
    digest = F.coalesce(F.sha2("payload", 256), F.regexp_extract("digest", "^sha256:(.*)$", 1))
    return kept.select("page_id", "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x, row_number() OVER () AS id FROM pages),
q AS (
  SELECT page_id, id, strlen(x) AS n, sha256(x) AS d, first_value(id) OVER w AS first_id, first_value(page_id) OVER w AS first_page
  FROM p WINDOW w AS (PARTITION BY x ORDER BY page_id NULLS LAST, id))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND id <> first_id THEN first_page END AS refers_to
FROM q
"""
