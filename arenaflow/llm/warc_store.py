"""Content-addressed WARC archive.

``write_archive`` makes two Parquet tables: ``payloads`` with every distinct payload once, compressed and keyed by its SHA-256, and
``headers`` with the exact header block of each record. A payload is compressed before it is shuffled and each task sends one copy
of a digest at most. That equal digests mean equal bytes is verified when writing (length and a second, independent hash must be the
same over all rows of a digest) and when reading (the digest of the restored bytes is computed anew). ``read_archive`` joins the
headers to the payloads and restores the records.

Cases: null html is an empty payload; a null url gives an empty target; line breaks in a url are percent-encoded, as they would end a
header; payloads under ``least`` bytes are always responses; rows that repeat the smallest page_id of a payload are all responses;
a null page_id is never the smallest, and if a payload has no other it is a response.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"


def packed(payload: pd.Series) -> pd.Series:
    z = zstandard.ZstdCompressor(level=3)
    return payload.map(z.compress)


def verified(blob: pd.Series) -> pd.DataFrame:
    z = zstandard.ZstdDecompressor()
    raw = map(z.decompress, blob)
    return pd.DataFrame([(len(r), hashlib.sha256(r).hexdigest()) for r in raw], columns=["bytes", "sha256"])


def restored(blob: pd.Series) -> pd.Series:
    z = zstandard.ZstdDecompressor()
    return blob.map(z.decompress)


def digest_of(payload: str) -> Column:
    return F.sha2(payload, 256)


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def header_block() -> Column:
    """The header of a record with columns page_id, url, digest, bytes, owner and revisit; the url comes last."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(
            line("WARC-Refers-To", record_id(F.col("owner"))),
            line("X-Refers-To-Page", F.col("owner").cast("string")),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        line("WARC-Target-URI", url),
    )


def field(name: str) -> Column:
    """A header's value; the first line of that name counts, and the url can't hold a line break."""
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)


def write_archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes ``path/headers`` and ``path/payloads`` for a record of each row of page_id, url, html; raises if a digest has unequal payloads."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumns(
        {"digest": digest_of("payload"), "bytes": F.octet_length("payload").cast("long")}
    )
    second = F.xxhash64("payload")
    equal = (F.min("bytes") == F.max("bytes")) & (F.min("second") == F.max("second"))
    # the check decides on the column that is written, else the optimizer drops it
    blob = F.when(equal, F.first("blob")).otherwise(F.raise_error(F.lit("one digest, unequal payloads")).cast("binary"))
    packs = rows.select("digest", "bytes", second.alias("second"), F.pandas_udf(packed, "binary")("payload").alias("blob"))
    packs.groupBy("digest").agg(blob.alias("blob")).write.parquet(f"{path}/payloads")
    heads = rows.select("page_id", "url", "digest", "bytes")
    owners = heads.groupBy("digest").agg(F.min("page_id").alias("owner"))
    (
        heads.join(owners, "digest")
        .withColumn("revisit", (F.col("bytes") >= least) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")))
        .select("page_id", "digest", header_block().alias("header"))
        .write.parquet(f"{path}/headers")
    )


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, header, and with ``with_payload`` the
    payload and the record's exact bytes. Every restored payload is hashed again, once for all records that have it; a wrong one raises."""
    stored = spark.read.parquet(f"{path}/payloads").withColumn("r", F.pandas_udf(verified, "bytes long, sha256 string")("blob"))
    stored = stored.select("digest", "r.*", *(["blob"] if with_payload else []))
    joined = spark.read.parquet(f"{path}/headers").join(stored, "digest")
    kind = field("WARC-Type")
    out = joined.select(
        "page_id", F.col("bytes").alias("payload_bytes"),
        F.when(F.col("sha256") == field("WARC-Payload-Digest").substr(8, 64), F.col("sha256"))
        .otherwise(F.raise_error(F.concat(F.lit("wrong payload for "), F.col("digest")))).alias("payload_digest"),
        kind.alias("record_type"), F.when(kind == "revisit", field("X-Refers-To-Page").cast("long")).alias("refers_to"), "header",
        *([F.pandas_udf(restored, "binary")("blob").alias("payload")] if with_payload else []),
    )
    if not with_payload:
        return out
    body = F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    mark = lambda s: F.encode(F.lit(s), "UTF-8")
    return out.withColumn("record", F.concat(F.encode("header", "UTF-8"), mark(CRLF), body, mark(CRLF + CRLF)))
