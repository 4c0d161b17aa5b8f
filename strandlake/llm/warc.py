"""WARC records and the resolution of not-modified revisits.

A crawler that asks again for a page with a validator (entity tag or modification
date) may be told that it has not changed; the archive then holds a revisit record
with headers only.  Its content is that of the latest earlier full response for the
same canonical URL whose validators agree: an as-of join by URL and time.

The as-of join runs in two steps so that no URL's history has to pass through one
task: histories are cut into ``bucket`` seconds of time; each (URL, bucket) keeps its
last full response of each set of validators by a map-side maximum, a window over
these summaries carries the last one forward, and only within a bucket are records
themselves ordered.

Of the revisit's headers those that a 304 may update replace the stored ones; headers
that describe the stored body stay (RFC 9111, section 3.2).
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Headers of a stored response that a not-modified answer leaves alone.
KEPT_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
#: Query parameters that only track where a visitor came from.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref|sessionid|sid)="
BATCH = 8 << 20
#: Columns of a table of records; ``profile`` may be missing.
RECORD = "record_id string, type string, url string, time timestamp, status int, headers map<string,string>, body binary, profile string"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, https for http, no ``www.``, default port,
    fragment, trailing slash, index or tracking parameter; parameters in order."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_extract(u, r"^[A-Za-z]+://(?:[^@/?]*@)?([^?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/]*(/.*)?$", 1), r"/(index\.html?)?$", ""), r"/{2,}", "/")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    out = F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", out).otherwise(F.trim(url))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzipped, one file to a task.

    ``headers`` are the HTTP headers in lower case; records that are no HTTP messages
    have none.  ``profile`` is a revisit's.  A file is decompressed as it is read and leaves
    the task in batches of about ``BATCH`` bytes.  A record cut off by the end of the file, or
    by broken compression, is left out."""
    kinds = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("time", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("profile", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = pa.BufferReader(content.as_buffer()) if content.is_valid else io.BytesIO()
                packed = data.read(2) == b"\x1f\x8b"
                data.seek(0)
                held, size = [], 0
                for row in records(io.BufferedReader(gzip.GzipFile(fileobj=data) if packed else data)):
                    held.append(row)
                    size += len(row["body"])
                    if size > BATCH:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, kinds)

    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInArrow(parse, RECORD.replace("timestamp", "string"))
    return out.withColumn("time", F.to_timestamp("time"))


def headers_of(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.decode("latin-1").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def records(stream: io.BufferedIOBase) -> Iterator[dict]:
    try:
        yield from whole_records(stream)
    except (EOFError, zlib.error, gzip.BadGzipFile):  # what came before is whole
        return


def whole_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        block = b""
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            block += line.rstrip(b"\r\n") + b"\r\n"
        head = headers_of(block)
        size = int(head.get("content-length", "0"))
        body = stream.read(size)
        if len(body) < size:
            return
        status, http = None, {}
        if body.startswith(b"HTTP/"):
            top, _, body = body.partition(b"\r\n\r\n")
            first, _, lines = top.partition(b"\r\n")
            parts = first.split()
            status, http = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None, headers_of(lines)
        yield {"record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "url": head.get("warc-target-uri"), "time": head.get("warc-date"), "status": status, "headers": list(http.items()), "body": body, "profile": head.get("warc-profile")}


def resolve_revisits(df: DataFrame, bucket: int = 600) -> DataFrame:
    """The revisits of a table of records (see RECORD; more columns may be there).

    One row for each not-modified revisit (status 304 or such a profile; revisits of an
    identical payload hold a response of their own): ``record_id``, ``canonical``, ``time``, ``source_id`` (null if
    nothing fits), ``status``, ``headers`` (merged) of the resolved response.

    A revisit fits a full response (type response, status 200) of its canonical URL
    that is earlier and agrees in every validator that the revisit carries (``etag``
    without its weakness mark, ``last-modified``); a revisit without a validator fits
    any.  Of several the latest is taken, of equally late ones the largest record_id.
    Null urls or times fit nothing; null headers are none; repeated rows are resolved
    each; an empty table gives no rows.  Other columns are not read."""
    etag = F.regexp_replace(F.element_at("headers", "etag"), "^W/", "")
    df = df.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    rows = df.select(
        (F.col("profile") if "profile" in df.columns else F.lit(None).cast("string")).alias("_profile"),
        "record_id", "type", "time", "status", "headers", canonical_url(F.col("url")).alias("canonical"), etag.alias("_etag"), F.element_at("headers", "last-modified").alias("_modified"),
        F.floor(F.unix_micros("time") / (bucket * 1_000_000)).alias("_bucket"),
    )
    full = rows.filter((F.col("type") == "response") & (F.col("status") == 200) & F.col("canonical").isNotNull() & F.col("time").isNotNull())
    asks = rows.filter((F.col("type") == "revisit") & ((F.col("status") == 304) | F.col("_profile").contains("not-modified"))).drop("_profile")
    # each response answers to the four sets of validators a revisit may carry
    sets = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.when(F.lit(bool(i & 1)), F.col("_etag")).alias("e"), F.when(F.lit(bool(i & 2)), F.col("_modified")).alias("m")) for i in range(4))))
    offers = full.select("canonical", "_bucket", "time", "record_id", "headers", sets.alias("v")).filter(
        ((F.col("v.kind").bitwiseAND(1) == 0) | F.col("v.e").isNotNull()) & ((F.col("v.kind").bitwiseAND(2) == 0) | F.col("v.m").isNotNull())
    )
    kind = F.when(F.col("_etag").isNotNull(), 1).otherwise(0) + F.when(F.col("_modified").isNotNull(), 2).otherwise(0)
    asked = asks.withColumn("v", F.struct(kind.alias("kind"), F.col("_etag").alias("e"), F.col("_modified").alias("m")))

    def key(df: DataFrame) -> DataFrame:
        return df.withColumn("_k", F.concat_ws("\x00", "canonical", F.col("v.kind").cast("string"), F.coalesce("v.e", F.lit("\x01")), F.coalesce("v.m", F.lit("\x01"))))

    offers, asked = key(offers), key(asked)
    latest = F.max(F.struct("time", "record_id"))
    summary = offers.groupBy("_k", "_bucket").agg(latest.alias("_last"))
    wanted = asked.filter(F.col("canonical").isNotNull() & F.col("time").isNotNull()).select("_k", "_bucket").distinct()
    marks = summary.select("_k", "_bucket", "_last").unionByName(wanted.select("_k", "_bucket", F.lit(None).cast(summary.schema["_last"].dataType).alias("_last")))
    marks = marks.groupBy("_k", "_bucket").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("_k", "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    inside = offers.select("_k", "_bucket", "time", F.struct("time", "record_id").alias("_offer"), F.lit(0).alias("_ask"), F.lit(None).cast("string").alias("_of"))
    inside = inside.unionByName(asked.select("_k", "_bucket", "time", F.lit(None).cast(summary.schema["_last"].dataType).alias("_offer"), F.lit(1).alias("_ask"), F.col("record_id").alias("_of")))
    # of one moment the requests come first: an offer must be earlier
    before = Window.partitionBy("_k", "_bucket").orderBy("time", F.desc("_ask"), F.col("_offer.record_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = inside.withColumn("_near", F.last("_offer", ignorenulls=True).over(before)).filter("_ask = 1").select("_k", "_bucket", "time", "_of", "_near")
    near = near.dropDuplicates(["_k", "_bucket", "time", "_of"]).join(carried, ["_k", "_bucket"], "left").select("_k", "time", "_of", F.coalesce("_near", "_carried").alias("_hit"))
    asked = asked.join(near.withColumnsRenamed({"_k": "_kk", "time": "_tt"}), (F.col("_k") == F.col("_kk")) & F.col("time").eqNullSafe(F.col("_tt")) & F.col("record_id").eqNullSafe(F.col("_of")), "left")
    stored = full.groupBy("canonical", "time", "record_id").agg(F.min(F.to_json("headers")).alias("_stored")).withColumnsRenamed({"canonical": "_c", "time": "_t", "record_id": "_r"})
    joined = asked.join(stored, (F.col("canonical") == F.col("_c")) & (F.col("_hit.time") == F.col("_t")) & (F.col("_hit.record_id") == F.col("_r")), "left")
    old = F.from_json("_stored", "map<string,string>")
    news = F.map_filter("headers", lambda k, _: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(news), k)), news)
    return joined.select(
        "record_id", "canonical", "time", F.col("_hit.record_id").alias("source_id"), F.when(F.col("_hit").isNotNull(), 200).alias("status"),
        F.when(F.col("_hit").isNotNull(), F.map_from_entries(F.array_sort(F.map_entries(merged)))).alias("headers"),
    )
