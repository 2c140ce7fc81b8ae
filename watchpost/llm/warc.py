"""Content-addressed WARC archive.

An archive is two tables in one folder.  ``payloads`` stores the bytes of
every distinct payload once, deflated, under the SHA-256 of the payload.  ``headers`` holds, for each
record, its exact WARC header (and for the HTTP block its HTTP header) with
the digest of its payload.  Joining both gives back the original records byte
by byte.  A payload of at least ``REVISIT_FROM`` bytes that comes again is
written as a revisit of the record with the smallest page_id; smaller ones are
always responses, though their bytes too are stored once.

Only the owner rows' payloads are shuffled for the payload table; hot digests
are counted by a combining minimum and joined back as the unique side, which
adaptive execution splits.

Defined cases: a null html is an empty payload; a null url gives an empty
target URI; line ends inside a url would break its header line and are
percent-encoded; rows that repeat a page_id keep one record each, the first by
url being the response of their payload, and rows equal in page_id, url and
payload are equal records, all responses; a null page_id is written as an
empty id, read back as null and sorts before others.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpost.llm.base import key_of, ship

#: Payloads of fewer bytes are never revisited.
REVISIT_FROM = 100
_STAMP = "2024-01-01T00:00:00Z"
_END = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_END))


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _deflate(payload: pd.Series) -> pd.Series:
    return payload.map(zlib.compress)


def _inflate(stored: pd.Series) -> pd.Series:
    return stored.map(zlib.decompress, na_action="ignore")


def write(pages: DataFrame, path: str) -> None:
    """Write one record per row of (page_id, url, html) to the archive at ``path``."""
    ship(pages.sparkSession)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), key_of("page_id").alias("key"), url.alias("url"),
        body.alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    small = rows.select("page_id", "key", "url", "digest", "size")
    first = small.groupBy("digest").agg(F.min(F.struct("key", "url")).alias("owner"))
    owners = first.select("digest", F.col("owner.key").alias("key"), F.col("owner.url").alias("url"))
    # Payloads are shuffled deflated, and once: the owner is one row but for equal rows.
    deflated = rows.select("digest", "key", "url", F.pandas_udf(_deflate, "binary")("payload").alias("stored"))
    deflated.join(owners, ["digest", "key", "url"], "left_semi").dropDuplicates(["digest", "key", "url"]).select(
        "digest", "stored"
    ).write.option("compression", "none").parquet(f"{path}/payloads")

    at = small.join(first, "digest")
    is_first = (F.col("owner.key") == F.col("key")) & (F.col("owner.url") == F.col("url"))
    head = at.withColumn("revisit", (F.col("size") >= REVISIT_FROM) & ~is_first)
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    key = F.col("owner.key")
    refers = F.when(key != F.lit(-(2**63)), key)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}"), _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.col("size").cast("string")), F.lit(_END),
    )
    block = F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size"))
    header = F.concat(
        F.lit(f"WARC/1.1{_END}"), _line("WARC-Type", kind), _line("WARC-Record-ID", _id(F.col("page_id"))),
        _line("WARC-Date", F.lit(_STAMP)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(
            _line("WARC-Profile", F.lit(
                "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            _line("WARC-Refers-To", _id(refers)),
        )).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", block.cast("string")), F.lit(_END),
    )
    head.withColumn("http", http).select(
        "digest", F.encode(header, "UTF-8").alias("header"), F.encode("http", "UTF-8").alias("http")
    ).write.parquet(f"{path}/headers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The original records: record (its exact bytes), and payload, the full one also of a revisit.

    The join keeps every header; a payload that is missing, or whose bytes do
    not have the digest they are filed under, raises.
    """
    ship(spark)
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("filed"), "stored")
    sound = F.col("payload").isNotNull() & (F.sha2("payload", 256) == F.col("digest"))
    payload = F.when(sound, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload missing or damaged: "), F.col("digest"))).cast("binary")
    )
    joined = headers.join(payloads, headers["digest"] == F.col("filed"), "left")
    inflated = joined.withColumn("payload", F.pandas_udf(_inflate, "binary")("stored"))
    full = inflated.select("header", "http", payload.alias("payload"))
    revisit = F.decode("header", "UTF-8").contains(f"{_END}WARC-Type: revisit{_END}")
    body = F.when(revisit, F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    end = F.encode(F.lit(_END + _END), "UTF-8")
    return full.select(F.concat("header", "http", body, end).alias("record"), "header", "payload")


def fields(records: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest and payload_bytes parsed from read-back records."""
    text = F.decode("header", "UTF-8")

    def value(name: str, pattern: str = "([^\\r\\n]*)") -> Column:
        return F.regexp_extract(text, f"\\n{name}: {pattern}\\r\\n", 1)

    def number(name: str) -> Column:
        return F.nullif(value(name, "<urn:page:(-?[0-9]*)>"), F.lit("")).cast("long")

    return records.select(
        number("WARC-Record-ID").alias("page_id"), value("WARC-Target-URI").alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), value("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
    )
