"""A content-addressed web archive.

Payload bytes are stored once, under their SHA-256; the header block of every record (WARC and HTTP
header, byte for byte) is stored beside, with the address of its payload. Both are tables of
Parquet files, and the original record is header, payload and two line ends, put together by a
join. An address is verified whenever it is read: bytes that do not hash to it end the job.

Of records with equal payloads, of at least ``min_bytes`` bytes, the one with the smallest id is a
response and the others are revisits that refer to it. A group of copies is found by a grouped
minimum over digests, combined in each task first, and payloads are shuffled once.

Null payloads are empty. Null ids are the largest; where a payload has no other, all its records are
responses. Rows that repeat the id of the response are responses as well. Null urls are left out of
the header. Other columns are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.common import written

# The alphabet of RFC 4648, and what the WARC 1.1 standard names revisits.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: five hex digits are four digits of it."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _header(refers: Column) -> Column:
    """WARC and HTTP header of a record; ``refers`` is null for a response."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END + END),
    )
    block = F.octet_length(http) + F.when(refers.isNull(), F.col("payload_bytes")).otherwise(0)

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    def urn(number: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("none")), F.lit(">"))

    kind = F.when(refers.isNull(), "response").otherwise("revisit")
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(F.col("record_id"))),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(refers.isNotNull(), line("WARC-Refers-To", refers)).otherwise(""),
        F.when(refers.isNotNull(), line("WARC-Profile", F.lit(REVISIT_PROFILE))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(END),
        http,
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archive ``pages`` (record_id, url, payload binary) as two tables below ``path``."""
    records = pages.select(
        F.col("record_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce("payload", F.lit("").cast("binary")).alias("payload"),
    )
    named = records.select(
        "record_id",
        "url",
        F.sha2("payload", 256).alias("address"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    # The first record of each payload. Equal addresses must agree in the other digest and length.
    firsts = written(
        named.groupBy("address")
        .agg(
            F.min("record_id").alias("first_id"),
            F.min("payload_digest").alias("low"),
            F.max("payload_digest").alias("high"),
        )
        .select(
            "address",
            F.when(F.col("low") == F.col("high"), F.col("first_id"))
            .otherwise(F.raise_error(F.lit("different payloads with one address")))
            .alias("first_id"),
        ),
        f"{path}/firsts",
    )
    big = F.col("payload_bytes") >= min_bytes
    again = big & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    refers = F.when(
        again, F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">"))
    )
    headers = named.join(firsts, "address").select("record_id", "address", _header(refers).alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    # The first record of each payload brings the bytes, once even if its row is repeated: what is
    # joined on both keys is already dealt by them.
    number = F.coalesce("record_id", F.lit(-(1 << 63)))
    first_number = F.coalesce("first_id", F.lit(-(1 << 63)))
    stored = (
        records.select(F.sha2("payload", 256).alias("address"), number.alias("number"), "payload")
        .join(firsts.select("address", first_number.alias("number")), ["address", "number"], "left_semi")
        .dropDuplicates(["address", "number"])
        .select("address", "payload")
    )
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive: its ``header`` and ``payload`` bytes and the whole ``record``.

    ``type``, ``id``, ``digest`` and ``refers_to`` are read from the header, ``payload_bytes`` is the length of the
    full payload also for revisits, whose record has no payload of its own. Columns not
    asked for are not moved: without ``payload`` and ``record`` the join carries digests only.
    """
    headers = spark.read.schema("record_id bigint, address string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    verified = payloads.select(
        F.when(F.sha2("payload", 256) == F.col("address"), F.col("address"))
        .otherwise(F.raise_error(F.lit("a stored payload does not have its address")))
        .alias("address"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("stored_digest"),
        "payload",
    ).dropDuplicates(["address"])
    text = F.decode("header", "UTF-8")

    def field(name: str) -> Column:
        found = F.regexp_extract(text, rf"(?m)^{name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    def page(name: str) -> Column:
        return F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1).try_cast("long")

    met = headers.join(verified, "address")
    digest = F.substring(field("WARC-Payload-Digest"), 6, 32)
    tail = F.lit(END + END).cast("binary")
    whole = F.when(field("WARC-Type") == "response", F.concat("header", "payload", tail)).otherwise(
        F.concat("header", tail)
    )
    return met.select(
        page("WARC-Record-ID").alias("id"),
        field("WARC-Type").alias("type"),
        field("WARC-Target-URI").alias("url"),
        page("WARC-Refers-To").alias("refers_to"),
        F.when(digest == F.col("stored_digest"), digest)
        .otherwise(F.raise_error(F.lit("a header names another payload")))
        .alias("digest"),
        "payload_bytes",
        "header",
        "payload",
        whole.alias("record"),
    )
