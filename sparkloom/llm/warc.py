"""WARC transaction assembly (operator 4): write captures as WARC 1.1 records, read archives, join their records.

A capture is a request, a response (or a revisit of an earlier equal payload) and a metadata record; request and
metadata name the response in WARC-Concurrent-To. Records are built by SQL functions and written by Spark's text
writer with the record's end as line separator, so that the files are plain concatenated records, gzipped as a whole.
Archives are read through Spark too, line by line, so any store that Spark reaches will do: a task walks a file once and
holds one record at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import join_hot, materialise, new_path

#: Payloads below this many bytes are always written whole.
LEAST_REVISIT_BYTES = 100
CRLF = "\r\n"
RECORD = "record_id string, type string, concurrent_to string, target_uri string, refers_to string, digest string, fields string, http_head string, payload_bytes long, payload_sha256 string"


def _header(kind: str, record_id: Column, uri: Column, extra: list[Column], content_type: str, length: Column, date: str) -> Column:
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(f"{CRLF}WARC-Record-ID: <"), record_id, F.lit(f">{CRLF}WARC-Date: {date}{CRLF}")]
    lines += [F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit(CRLF)), F.lit("")), *extra]
    return F.concat(*lines, F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF + CRLF))


def plan_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key, digest, refers_to): the captures that revisit an equal payload of the smallest id; the text stays where it is."""
    slim = _keyed(pages, id_col, url_col, html_col).where(F.col("_bytes") >= LEAST_REVISIT_BYTES).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "_key", "_digest")
    first = slim.groupBy("_digest").agg(F.min(F.struct("id", "_key")).alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("last > first.id")
    # One payload may be that of a third of all pages.
    return join_hot(slim, first, "_digest", "n").where("id > first.id").select("_key", F.col("first._key").alias("_refers")).distinct()


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    digest = F.sha2(payload.cast("binary"), 256)
    mark = F.substring(F.sha2(F.concat(F.coalesce(F.col(url_col).cast("string"), F.lit("")).cast("binary"), digest.cast("binary")), 256), 1, 24)
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("-"), mark)
    return pages.select(id_col, url_col, payload.alias("_payload"), digest.alias("_digest"), F.octet_length(payload).cast("long").alias("_bytes"), key.alias("_key"))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", rows_per_file: int = 20_000) -> None:
    """Writes three records for each row. Null html is an empty payload; a null url leaves out WARC-Target-URI and the Host;
    line ends and spaces in a url are percent-encoded; a null id is written as the word null. Rows equal in id, url and html give equal
    records, which `assemble` counts as copies."""
    revisits = materialise(plan_revisits(pages, id_col=id_col, url_col=url_col, html_col=html_col), "warc-revisits")
    rows = _keyed(pages, id_col, url_col, html_col).join(revisits, "_key", "left")
    urn = lambda kind, key="_key": F.concat(F.lit(f"urn:capture:{kind}:"), F.col(key))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(url_col).cast("string"), "\r", "%0D"), "\n", "%0A"), " ", "%20")
    is_revisit = F.col("_refers").isNotNull()
    target = F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    host = F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.coalesce(F.when(target == "", "/").otherwise(target), F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF + CRLF))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF + CRLF))
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f"{CRLF}payload-bytes: "), F.col("_bytes").cast("string"), F.lit(CRLF))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("_digest"), F.lit(CRLF))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: <"), urn("response"), F.lit(f">{CRLF}"))
    refers = F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: <"), urn("response", "_refers"), F.lit(f">{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"))).otherwise("")
    body = F.when(is_revisit, "").otherwise(F.col("_payload"))
    answer = F.concat(_header(F.when(is_revisit, "revisit").otherwise("response"), urn("response"), uri, [digest, refers], "application/http;msgtype=response", F.octet_length(head) + F.octet_length(body), date), head, body)
    request = F.concat(_header("request", urn("request"), uri, [concurrent], "application/http;msgtype=request", F.octet_length(ask), date), ask)
    metadata = F.concat(_header("metadata", urn("metadata"), uri, [concurrent], "application/warc-fields", F.octet_length(about), date), about)
    rows.select(F.explode(F.array(request, answer, metadata)).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * rows_per_file).text(path)


def parse_records(lines: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record; `lines` are (file, line without its CRLF) in file order."""
    file, fields, need, got = None, None, -1, []
    have = 0
    for name, line in lines:
        if name != file:
            if fields is not None:
                raise ValueError(f"{file} ends inside a record")
            file = name
        if need >= 0:
            got.append(line)
            have += len(line) + 2
            if have >= need + 2:
                block = b"\r\n".join(got)
                if len(block) != need:
                    raise ValueError(f"{file}: a block doesn't end where Content-Length says")
                yield fields, block
                fields, need, got, have = None, -1, [], 0
        elif fields is None:
            if line.startswith(b"WARC/"):
                fields = {}
            elif line:
                raise ValueError(f"{file}: a record must begin with its version")
        elif line:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        else:
            need = int(fields["content-length"])
    if fields is not None:
        raise ValueError(f"{file} ends inside a record")


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """A row for each record under `path`. An HTTP block is split into its head and its payload, whose length and
    SHA-256 are of the bytes that are there; `with_payload` keeps these bytes too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (f.split() for f in RECORD.split(", "))] + [("payload", pa.binary())] * with_payload)
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        bare = lambda x: x.strip("<>") if x else None
        lines = ((f, v) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for fields, block in parse_records(lines):
            row = {"record_id": bare(fields.get("warc-record-id")), "type": fields.get("warc-type"), "concurrent_to": bare(fields.get("warc-concurrent-to")), "target_uri": fields.get("warc-target-uri"), "refers_to": bare(fields.get("warc-refers-to")), "digest": fields.get("warc-payload-digest")}
            if fields.get("content-type", "").startswith("application/http"):
                head, _, payload = block.partition(b"\r\n\r\n")
                row |= {"http_head": head.decode("utf-8", "replace"), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest()}
                if with_payload:
                    row["payload"] = payload
                    held += len(payload)
            else:
                row["fields"] = block.decode("utf-8", "replace")
            rows.append(row)
            if len(rows) >= 2_000 or held > 16_000_000:
                yield batch()
                rows, held = [], 0
        yield batch()

    lines = spark.read.option("lineSep", CRLF).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(run, RECORD + (", payload binary" if with_payload else ""))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture_id, copies, request, response, metadata), missing parts null.

    Records meet on the identifier that request and metadata name as concurrent to, and the response as its own:
    one shuffle instead of two joins. Equal records of repeated rows fall together and are counted.
    """
    key = F.coalesce("concurrent_to", "record_id")
    part = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), F.struct(*[c for c in records.columns if c != "concurrent_to"])))
    return records.where(F.col("type").isin("request", "response", "revisit", "metadata")).groupBy(key.alias("capture_id")).agg(F.sum(F.col("type").isin("response", "revisit").cast("long")).alias("copies"), part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata"))


def archive_digests(pages: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """Writes the pages, reads them back and gives a row for each: id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; a null id stays null and is never revisited; rows that repeat one are each given; rows that share an id
    but not url or html are captures of their own, and of these only those of a smaller id are revisited. A payload of any length is
    written whole; other columns are not read; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, id_col=id_col)
    whole = assemble(read_archives(spark, path, with_payload=False))
    kind = pages.schema[id_col].dataType.simpleString()
    is_revisit = F.col("response.type") == "revisit"
    stated = lambda name: F.regexp_extract("metadata.fields", rf"(?m)^{name}: (.*?)\r?$", 1)
    return whole.select(
        F.when(stated("page-id") != "null", stated("page-id")).cast(kind).alias(id_col),
        F.when(is_revisit, stated("payload-bytes").cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(is_revisit, F.substring_index("response.digest", ":", -1)).otherwise(F.col("response.payload_sha256")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(is_revisit, F.regexp_extract("response.refers_to", r"^urn:capture:response:(.*)-[0-9a-f]+$", 1)).cast(kind).alias("refers_to"),
        F.expr("explode(array_repeat(0, cast(copies as int)))").alias("_copy"),
    ).drop("_copy")
