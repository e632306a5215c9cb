"""WARC: archives of web pages are written, read back and reassembled from their segments.

Writing. A page becomes one logical record, `response` with an HTTP head and the page as its body, or
`revisit` where an equal payload stands under a smaller page_id. A block of over `segment_chars`
characters is split into a first record and `continuation` records (WARC-Segment-Number,
WARC-Segment-Origin-ID, WARC-Segment-Total-Length on the last), which may land in any file. Bodies of
over `chunk_chars` characters are framed by chunked transfer coding. Records are text rows ended by the
two line ends that end a WARC record, so Spark's own writer makes valid gzipped archives.

Reading. Files are parsed by Content-Length, never by looking for record starts. Whole records go
straight on; segments are grouped by origin identifier (a group is one record, so no group grows with
the corpus), ordered by number, and their total length is verified. Chunked framing is decoded and the
payload's SHA-256 is compared with the recorded digest.

Defined cases: null html is an empty payload; a null url writes no WARC-Target-URI; line ends in a url
are dropped; a null page_id is always a response and is never referred to; repeated page_ids with one
payload are all responses if theirs is the smallest; an empty table writes and returns no record. Other
columns of the input are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import binary, in_slices, shared_dir, stored, table

SMALLEST_REVISIT = 100
END = "\r\n\r\n"
RECORDS = "origin string, number int, total long, page_id long, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, block binary"
PAYLOADS = "page_id long, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def with_record_types(pages: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes and refers_to (null for a response).

    Digests are grouped without the pages themselves; the result is joined on (page_id, digest), which
    no hot payload can overload. The join on the digest moves ids only and is one that adaptive execution can split.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumns({"payload_digest": F.sha2("html", 256), "payload_bytes": F.octet_length("html").cast("long")})
    ids = slim.where(F.col("payload_bytes") >= smallest).select("page_id", "payload_digest")
    firsts = ids.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    later = ids.join(firsts, "payload_digest").where("page_id > refers_to").distinct()
    return slim.join(later, ["page_id", "payload_digest"], "left")


def _pieces(text: Column, size: int) -> Column:
    last = F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def write_archive(typed: DataFrame, path: str, *, segment_chars: int = 65536, chunk_chars: int = 16384, records_a_file: int = 2048, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes rows of with_record_types() as gzipped WARC files under path."""
    rid = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("row").cast("string"), F.lit(">"))
    chunked = F.length("html") > chunk_chars
    framed = F.concat(F.array_join(F.transform(_pieces(F.col("html"), chunk_chars), lambda p: F.concat(F.lower(F.hex(F.octet_length(p))), F.lit("\r\n"), p)), "\r\n"), F.lit("\r\n0\r\n\r\n"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.when(chunked, F.lit("Transfer-Encoding: chunked\r\n")).otherwise(F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n"))), F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, head).when(chunked, F.concat(head, framed)).otherwise(F.concat(head, "html"))
    url = F.regexp_replace("url", r"[\r\n]", "")
    common = F.concat(
        F.when(url.isNull(), F.lit("")).otherwise(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))),
        F.lit(f"WARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:x-page:"), F.col("refers_to").cast("string"), F.lit(">\r\n"))).otherwise(""),
    )
    rows = (
        typed.withColumn("row", F.monotonically_increasing_id())
        .select(rid.alias("rid"), revisit.alias("revisit"), common.alias("common"), block.alias("block"))
        .select("*", F.octet_length("block").alias("total"), F.posexplode(_pieces(F.col("block"), segment_chars)).alias("i", "piece"), F.ceil(F.length("block") / segment_chars).alias("n"))
    )
    first, last = F.col("i") == 0, F.col("i") == F.col("n") - 1
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), F.when(first, F.col("rid")).otherwise(F.concat(F.substring_index("rid", ">", 1), F.lit(":"), (F.col("i") + 1).cast("string"), F.lit(">"))),
        F.lit("\r\n"), F.when(first, F.col("common")).otherwise(F.concat(F.lit("WARC-Segment-Origin-ID: "), F.col("rid"), F.lit(f"\r\nWARC-Date: {date}\r\n"))),
        F.when(F.col("n") > 1, F.concat(F.lit("WARC-Segment-Number: "), (F.col("i") + 1).cast("string"), F.lit("\r\n"))).otherwise(""),
        F.when((F.col("n") > 1) & last, F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("total").cast("string"), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Length: "), F.octet_length("piece").cast("string"), F.lit(END), F.col("piece"),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


def _page_number(uri: str) -> int | None:
    number = uri.strip("<>").split(":")[2] if uri else "null"
    return None if number == "null" else int(number)


def parse_archive(content: bytes) -> Iterator[dict]:
    """The records of one gzipped WARC file, read by Content-Length."""
    with io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 16) as stream:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
            head = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode().partition(":")
                head[name.strip().lower()] = value.strip()
            size = int(head["content-length"])
            block = stream.read(size)
            if len(block) != size:
                raise ValueError(f"record {head.get('warc-record-id')} ends early")
            yield head | {"block": block}


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if body[end + 2 + size : end + 4 + size] != b"\r\n" or len(out[-1]) != size:
            raise ValueError("a chunk is not as long as it says")
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _checked(block: bytes, digest: str, page: int | None) -> bytes:
    data = payload_of(block)
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"the payload of page {page} does not have the digest that its record states")
    return data


def _parsed(with_payload: bool):
    """Whole records decoded and checked; segments with their block."""
    schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, rows = 0, []
                for x in parse_archive(content.as_py()):
                    own, number = x["warc-type"] != "continuation", int(x.get("warc-segment-number", 0))
                    row = {"number": number, "url": x.get("warc-target-uri"), "refers_to": x.get("warc-refers-to")}
                    if own:
                        row |= {"page_id": _page_number(x["warc-record-id"]), "record_type": x["warc-type"], "payload_digest": x["warc-payload-digest"].removeprefix("sha256:")}
                    if number:
                        row |= {"origin": x["warc-record-id"] if own else x["warc-segment-origin-id"], "total": int(x["warc-segment-total-length"]) if "warc-segment-total-length" in x else None, "block": x["block"]}
                    elif x["warc-type"] == "response":
                        data = _checked(x["block"], row["payload_digest"], row["page_id"])
                        row |= {"payload_bytes": len(data), "payload": data if with_payload else None}
                    rows.append(row)
                    held += len(x["block"]) if number or with_payload else 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        held, rows = 0, []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _decoded(with_payload: bool):
    """The payloads of reassembled records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 64):
            data = [_checked(b, d, p) for b, d, p in zip(binary(batch.column(5)), batch.column(4).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            columns = [*(batch.column(k) for k in range(4)), pa.array(map(len, data), pa.int64()), batch.column(4), pa.array(data if with_payload else [None] * len(data), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return run


def read_archive(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row a logical record: page_id, url, record_type, refers_to (a page_id), payload_bytes, payload_digest and payload.

    A revisit has, as in the archive, no payload of its own and no length; with_lengths() fills that in. Files are
    parsed once: what is not payload is stored and read by what follows; with payloads they are parsed twice.
    """
    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed(with_payload), RECORDS)
    records = records if with_payload else stored(records)
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    parts = (
        records.where("number > 0")
        .groupBy("origin")
        .agg(F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), *(F.max(c).alias(c) for c in ("page_id", "url", "record_type", "refers_to", "payload_digest")))
        .withColumn("block", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["block"])))
    )
    sound = (F.octet_length("block") == F.col("total")) & (F.element_at("parts", -1)["number"] == F.size("parts")) & F.col("record_type").isNotNull()
    joined = parts.withColumn("block", F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments are missing of "), F.col("origin")))))
    whole = joined.select("page_id", "url", "record_type", "refers_to", "payload_digest", "block").mapInArrow(_decoded(with_payload), PAYLOADS)
    rows = records.where("number = 0").select(names).unionByName(whole.select(names))
    return rows.withColumn("refers_to", F.regexp_extract("refers_to", r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long"))


def with_lengths(rows: DataFrame) -> DataFrame:
    """Fills in the payload length of revisits by their digest, which a response of the same archive states."""
    lengths = rows.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("known"))
    later = rows.where("record_type = 'revisit'").join(lengths, "payload_digest").withColumn("payload_bytes", F.col("known")).select(rows.columns)
    return rows.where("record_type = 'response'").unionByName(later)


def round_trip(pages: DataFrame, path: str | None = None, *, with_payload: bool = False) -> DataFrame:
    """Writes pages to archives under path (by default a fresh folder in the shared one) and reads them back."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(with_record_types(pages), path)
    return read_archive(spark, path, with_payload=with_payload)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(table(spark, sf_dir, "pages"))
    return with_lengths(rows).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc": op10_warc}
ORACLE_SQL = {
    "op10_warc": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM f""",
}
