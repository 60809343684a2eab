"""Content-addressed WARC archive.

Three tables make an archive: `payloads` holds every distinct payload once under its SHA-256, `headers` holds the
exact bytes of every record's WARC header and HTTP header with the digest of its payload, and both are joined to
give the original records again. Equal digests are verified: rows are the same payload only if SHA-256, SHA-1 and
length agree, and a stored payload must hash to its own name when it is read.

Among records with equal payloads of at least `min_bytes`, the one with the largest id is the response, the others
are revisits that refer to it. The choice needs one maximum per digest, combined before the shuffle; payload bytes
move once, to the one row that keeps them, and never meet the copies. Reading puts every record together again and takes
its figures from those bytes; a payload with very many copies costs only short rows over salted copies.

Cases: a null text is the empty payload; a null url is an empty target; records with a null id are revisits of an
equal payload with an id, and without one a response under the id `none`; rows that repeat an id and payload are
records of the same kind; an empty table gives empty tables; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..session import remove, write_and_read

DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32(hex_digits: Column, digits: int = 40) -> Column:
    """Upper-case base32 of a hex string whose length is a multiple of five digits (20 bits give four letters)."""
    groups = [F.lpad(F.conv(F.substring(hex_digits, k + 1, 5), 16, 32), 4, "0") for k in range(0, digits, 5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _lines(*pairs) -> Column:
    return F.concat(F.lit("WARC/1.1" + END), *(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(END)), F.lit("")) for name, value in pairs), F.lit(END))


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                  date: str = DATE) -> None:
    """Write the tables `headers` and `payloads` below `folder`."""
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), body.alias("payload"))
    digest = {"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")}
    rows.withColumns(digest).drop("payload").write.mode("overwrite").parquet(f"{folder}/digests")
    seen = spark.read.parquet(f"{folder}/digests")
    key = ["sha256", "sha1", "bytes"]
    keeper = seen.groupBy(*key).agg(F.max("page").alias("keeper"))

    r = seen.join(keeper, key)
    first = (F.col("bytes") < min_bytes) | F.col("keeper").isNull() | F.coalesce(F.col("page") == F.col("keeper"), F.lit(False))
    r = r.withColumn("type", F.when(first, "response").otherwise("revisit"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END + "Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    http = F.encode(F.when(first, http).otherwise(F.lit("")), "UTF-8")
    block = F.octet_length(http) + F.when(first, F.col("bytes")).otherwise(0)
    head = _lines(
        ("WARC-Type", F.col("type")), ("WARC-Record-ID", _record_id(F.col("page"))), ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        ("WARC-Date", F.lit(date)), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        ("WARC-Refers-To", F.when(~first, _record_id(F.col("keeper")))), ("WARC-Profile", F.when(~first, F.lit(REVISIT))),
        ("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))), ("Content-Length", block.cast("string")))
    r.select("page", F.encode(head, "UTF-8").alias("header"), http.alias("http"), "sha256").write.mode("overwrite").parquet(f"{folder}/headers")

    # the payload of one row per digest: the keeper's (or, without any id, one of the rows, told apart by nothing else)
    named = rows.where("page is not null").withColumn("sha256", F.sha2("payload", 256)).join(
        keeper.where("keeper is not null").select("sha256", F.col("keeper").alias("page")).distinct(), ["sha256", "page"], "left_semi")
    nameless = rows.where("page is null").withColumn("sha256", F.sha2("payload", 256)).join(
        keeper.where("keeper is null").select("sha256"), "sha256", "left_semi")
    (named.dropDuplicates(["sha256", "page"]).select("sha256", "payload")
     .unionByName(nameless.dropDuplicates(["sha256"]).select("sha256", "payload")).write.mode("overwrite").parquet(f"{folder}/payloads"))
    remove(spark, f"{folder}/digests")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))


def _page(record_id: Column) -> Column:
    return F.nullif(F.regexp_extract(record_id, r"<urn:x-page:(-?[0-9]+)>", 1), F.lit("")).cast("long")


def _verified(payloads: DataFrame) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("payload does not hash to its name "), F.col("sha256")))
    return payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(bad))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(page, record): the original bytes of every record, header, block and closing lines."""
    h = spark.read.parquet(f"{folder}/headers")
    kept = h.where(F.octet_length("http") > 0).join(_verified(spark.read.parquet(f"{folder}/payloads")), "sha256")
    whole = kept.select("page", F.concat("header", "http", "payload", F.encode(F.lit(END + END), "UTF-8")).alias("record"))
    return whole.unionByName(h.where(F.octet_length("http") == 0).select("page", F.concat("header", F.encode(F.lit(END + END), "UTF-8")).alias("record")))


def _after(data: Column) -> Column:
    """Place behind the first empty line, counted in bytes."""
    return F.instr(F.decode(data, "ISO-8859-1"), END + END) + F.lit(len(END + END))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, header_digest) of every record, from its own bytes.

    Records are put together again and taken apart as a reader of the archive does it: header up to the first empty line, a block
    of Content-Length bytes, the payload behind the HTTP header. A revisit has no payload; its figures are those of the record
    that it refers to, found by record id and digest.
    """
    r = records(spark, folder).withColumn("at", _after(F.col("record")))
    r = r.select(F.expr("substring(record, 1, at - 1)").alias("header"), F.expr("substring(record, at)").alias("rest"))
    r = r.withColumn("block", F.substring("rest", F.lit(1), _field("Content-Length").cast("int")))
    r = r.withColumn("payload", F.when(_field("WARC-Type") == "response", F.substring("block", _after(F.col("block")), F.octet_length("block"))))
    r = r.select(_page(_field("WARC-Record-ID")).alias("page_id"), _field("WARC-Type").alias("record_type"), _page(_field("WARC-Refers-To")).alias("refers_to"),
                 F.substring(_field("WARC-Payload-Digest"), 6, 32).alias("header_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    r = write_and_read(r, "archive_index")  # short rows; the bytes are read once
    of = r.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "header_digest")
    seen = of.select("refers_to", "header_digest").distinct()
    first = r.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "header_digest", "payload_bytes", "payload_digest")
    first = first.join(seen, ["refers_to", "header_digest"], "left_semi").dropDuplicates(["refers_to", "header_digest"])
    again = spread_join(of, first, ["refers_to", "header_digest"], "left", salt_by=["page_id"])
    return again.select(*r.columns).unionByName(r.where("record_type = 'response'"))


def split_records(files: DataFrame, content: str = "content") -> DataFrame:
    """(header, http, payload) of every record in WARC bytes, exact to the byte; for reading archives made elsewhere."""

    def cut(data: bytes) -> Iterator[tuple[bytes, bytes, bytes]]:
        at = 0
        while (end := data.find(b"\r\n\r\n", at)) >= 0:
            head = data[at:end + 4]
            fields = dict(line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
            size = int({k.lower(): v for k, v in fields.items()}[b"content-length"])
            block = data[end + 4:end + 4 + size]
            cut_at = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
            yield head, block[:cut_at], block[cut_at:]
            at = end + 4 + size + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v in b.column(0):
                for r in cut(v.as_py() or b""):
                    yield pa.RecordBatch.from_pydict({k: pa.array([x], pa.binary()) for k, x in zip(("header", "http", "payload"), r, strict=True)})

    return files.select(F.col(content).alias("c")).mapInArrow(run, "header binary, http binary, payload binary")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
q AS (
  SELECT *, translate(array_to_string(list_transform(range(0, 8), lambda k: to_base(CAST('0x' || substr(s, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT), 32, 4)), ''),
                      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS digest
  FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to, digest AS header_digest
FROM q
"""
