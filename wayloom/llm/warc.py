"""WARC archives: write captures, read them back, assemble transactions.

Each capture is three records: a request, a response (or, where a larger page
id has the same payload, a revisit of it) and metadata. Request and metadata
name their response or revisit in ``WARC-Concurrent-To``; assembly joins the
three through it and yields one nested row per capture.

Records are composed in SQL functions; each becomes a gzip member of its own.
Spark's text sink writes the members, so archives go to any file system Spark
writes to. Files are rolled by bytes. The parser relies on ``Content-Length``
alone, never on what a payload contains, and holds one record at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import fresh
from ..shipping import ship
from .common import hot_keys, materialize, salted_join

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: A file takes captures up to this many bytes before compression, and always one.
FILE_BYTES = 32_000_000
_END = b"\r\n\r\n"
_PIECE = 1 << 20


def _urn(kind: str, capture: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + "|"), capture).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """One record up to its block; null headers are left out."""
    lines = [F.lit(VERSION)]
    for name, value in headers:
        if value is not None:
            lines.append(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _numbered(rows: DataFrame, narrow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``seq``, which tells rows of equal id and payload apart, and is null where there is one.

    Such rows are numbered once and written, so that every reader of the numbers sees the same.
    """
    pairs = materialize(narrow.groupBy("capture").agg(F.count("*").alias("n")).where("n > 1"), "warc-repeats")
    nothing = F.lit(None).cast("long")
    if pairs.isEmpty():
        return rows.withColumn("seq", nothing), narrow.withColumn("seq", nothing)
    hot = hot_keys(pairs, ["capture"], "n", narrow.count())
    marked = rows.withColumn("seq", F.monotonically_increasing_id())
    repeated = materialize(salted_join(marked, pairs.select("capture"), ["capture"], hot, "left_semi", ["seq"]), "warc-numbered")
    single = salted_join(marked, pairs.select("capture"), ["capture"], hot, "left_anti", ["seq"]).withColumn("seq", nothing)
    alone = narrow.join(pairs.select("capture"), "capture", "left_anti").withColumn("seq", nothing)
    return single.unionByName(repeated), alone.unionByName(repeated.select("capture", "id", "digest", F.octet_length("body").alias("bytes"), "seq"))


def write_warc(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, revisit_bytes: int = REVISIT_BYTES, date: str = DATE, file_bytes: int = FILE_BYTES
) -> None:
    """Write three records per row of ``df`` under ``path``, a gzip member each, in files of about ``file_bytes`` before compression.

    A null html is an empty payload; a null url leaves out the target. White
    space and control characters of a url become ``%20``. Of equal payloads of
    at least ``revisit_bytes`` bytes the row with the largest id (null ids
    last) becomes the response; of rows that repeat both id and payload one
    does. A single page may be as long as a string can be in Spark (2 GB);
    its file then is as large as that. An empty table writes no record.
    """
    ship(df.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-"))
    rows = df.select(
        F.col(id_col).alias("id"),
        key.alias("name"),
        F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("body"),
    ).withColumn("digest", F.sha1(F.col("body").cast("binary")))
    rows = rows.withColumn("capture", F.concat_ws("|", "name", "digest")).drop("name")
    narrow = materialize(rows.select("capture", "id", "digest", F.octet_length("body").alias("bytes")), "warc-rows")
    rows, narrow = _numbered(rows, narrow)
    full_name = F.concat_ws("|", "capture", F.col("seq").cast("string"))
    groups = (
        narrow.where(F.col("bytes") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(F.struct("id", "seq", full_name.alias("capture")))["capture"].alias("g_capture"))
        .where("n > 1")
    )
    groups = materialize(groups, "warc-groups")
    rows = salted_join(rows.withColumn("capture", full_name), groups.drop("n"), ["digest"], hot_keys(groups, ["digest"], "n", narrow.count()), "left", ["capture"])
    revisit = F.col("g_capture").isNotNull() & (F.col("g_capture") != F.col("capture"))
    main, request, metadata = (_urn(kind, F.col("capture")) for kind in ("response", "request", "metadata"))
    target = F.concat(F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    dated = ("WARC-Date", date)
    response_record = _record(
        [("WARC-Type", "response"), ("WARC-Record-ID", main), dated, ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")],
        F.concat(http, F.col("body")),
    )
    revisit_record = _record(
        [("WARC-Type", "revisit"), ("WARC-Record-ID", main), dated, ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", _urn("response", F.col("g_capture"))), ("WARC-Profile", PROFILE), ("Content-Type", "application/http; msgtype=response")],
        http,
    )
    request_record = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", request), dated, ("WARC-Target-URI", target), ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.coalesce(F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*(/[^#]*)", 1), F.lit("")), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata_record = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", metadata), dated, ("WARC-Target-URI", target), ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("captureKey: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, held, out, size = 0, 0, [], 0
        for batch in batches:
            for parts in zip(batch["request"], batch["main"], batch["metadata"]):
                records = [part.encode("utf-8", "surrogatepass") + _END for part in parts]
                length = sum(map(len, records))
                if held and held + length > file_bytes:
                    file, held = file + 1, 0
                held += length
                members = b"".join(map(_member, records))
                if members[-1]:  # the top byte of a length of 16 MB or more: an empty member ends with 0
                    members += _member(b"")
                out.append((file, members[:-1]))
                size += len(members)
                if size > 8_000_000:
                    yield pd.DataFrame(out, columns=["file", "members"])
                    out, size = [], 0
        yield pd.DataFrame(out, columns=["file", "members"])

    texts = rows.select(request_record.alias("request"), F.when(revisit, revisit_record).otherwise(response_record).alias("main"), metadata_record.alias("metadata"))
    packed = texts.mapInPandas(pack, "file int, members binary")
    # The sink ends each row with the last byte of its last member, which is 0.
    packed.select("file", F.col("members").cast("string").alias("value")).write.partitionBy("file").option("lineSep", "\0").text(path)


def unpacked(data: bytes) -> Iterator[bytes]:
    """Content of an archive in pieces: gzip, of one member or of many, or plain."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + _PIECE] for at in range(0, len(data), _PIECE))
        return
    view, at, unpacker = memoryview(data), 0, zlib.decompressobj(31)
    while at < len(data):
        step = view[at : at + _PIECE]
        at += len(step)
        while step:
            piece = unpacker.decompress(step, _PIECE)
            if piece:
                yield piece
            if unpacker.eof:
                step, unpacker = unpacker.unused_data, zlib.decompressobj(31)
            else:
                step = unpacker.unconsumed_tail
    if rest := unpacker.flush():
        yield rest


def parse_records(pieces: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, given whole or in pieces."""
    pieces, buffer, done = iter([pieces] if isinstance(pieces, bytes) else pieces), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            buffer.extend(piece)
        return piece is not None

    while True:
        while (end := buffer.find(_END)) < 0 and more():
            pass
        if end < 0:
            if buffer:
                raise ValueError(f"no record at byte {done}")
            return
        lines = buffer[:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {done}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        while len(buffer) < stop + 4 and more():
            pass
        if buffer[stop : stop + 4] != _END:
            raise ValueError(f"the record at byte {done} doesn't end where its length says")
        yield headers, bytes(buffer[start:stop])
        del buffer[: stop + 4]
        done += stop + 4


_FIELDS = ("warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest", "content-type")


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row per record: its headers, payload_bytes and payload_sha1 as found, and the payload itself if asked for.

    The payload of a response is what follows its HTTP header, that of other
    records their block; a revisit has none of its own. A task holds one
    compressed file (``write_warc`` bounds its size) and one record at a time.
    """
    ship(spark)
    columns = [f.removeprefix("warc-").replace("-", "_") for f in _FIELDS]
    schema = ", ".join(f"{c} string" for c in columns) + ", payload_bytes long, payload_sha1 string" + (", payload binary" if payloads else ", fields string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*columns, "payload_bytes", "payload_sha1", "payload" if payloads else "fields"]
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for headers, block in parse_records(unpacked(content)):
                    kind = headers.get("warc-type")
                    body = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit") else block
                    last = body if payloads else block.decode("utf-8", "replace") if kind == "metadata" else None
                    rows.append([*(headers.get(f) for f in _FIELDS), len(body), hashlib.sha1(body).hexdigest(), last])
                    held += len(body) if payloads else 300
                    if held > 8_000_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("content").mapInPandas(run, schema)


def _referred(revisits: DataFrame) -> DataFrame:
    """Responses with too many revisits for one task."""
    counts = materialize(revisits.where("refers_to IS NOT NULL").groupBy("refers_to").agg(F.count("*").alias("n")), "warc-referred")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return hot_keys(counts, ["refers_to"], "n", total)


def assemble(records: DataFrame, key_type: str = "long") -> DataFrame:
    """One nested row per capture: key, url, request, response, metadata.

    ``response`` has the record's own type, and payload figures (and payload)
    of the full payload: those of a revisit are its referred response's, which
    must agree with the digest that the revisit states. A response or revisit
    that lacks its request or metadata keeps null there.
    """
    payload = "payload" if "payload" in records.columns else None
    main = records.where(F.col("type").isin("response", "revisit"))
    full = records.where(F.col("type") == "response").select(
        F.col("record_id").alias("f_id"), F.col("payload_bytes").alias("f_bytes"), F.col("payload_sha1").alias("f_sha1"), *([F.col(payload).alias("f_payload")] if payload else [])
    )
    notes = F.decode("payload", "UTF-8") if payload else F.col("fields")
    request = records.where(F.col("type") == "request").select(F.col("concurrent_to").alias("q_to"), F.struct("record_id", "date", "payload_bytes").alias("request"))
    metadata = records.where(F.col("type") == "metadata").select(
        F.col("concurrent_to").alias("m_to"), F.struct(F.col("record_id"), notes.alias("fields")).alias("metadata")
    )
    together = main.join(request, F.col("record_id") == F.col("q_to"), "left").join(metadata, F.col("record_id") == F.col("m_to"), "left")
    # Only revisits refer to anything; one response may have very many.
    hot = _referred(records.where(F.col("type") == "revisit"))
    revisits = salted_join(together.where("type = 'revisit'"), full.withColumnRenamed("f_id", "refers_to"), ["refers_to"], hot, "left", ["record_id"], few=0)
    joined = together.where("type = 'response'").unionByName(revisits, allowMissingColumns=True)
    is_revisit = F.col("type") == "revisit"
    stated = F.regexp_extract("payload_digest", "^sha1:(.*)$", 1)
    found = F.when(is_revisit, F.col("f_sha1")).otherwise(F.col("payload_sha1"))
    response = F.struct(
        F.col("record_id"),
        F.col("type"),
        F.col("date"),
        F.col("refers_to"),
        F.when(is_revisit, F.col("f_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        found.alias("payload_digest"),
        found.eqNullSafe(stated).alias("digest_agrees"),
        *([F.when(is_revisit, F.col("f_payload")).otherwise(F.col(payload)).alias("payload")] if payload else []),
    )
    key = F.nullif(F.regexp_extract("metadata.fields", r"(?m)^captureKey: ([^\r\n]*)", 1), F.lit("")).cast(key_type)
    return joined.select(key.alias("key"), F.col("target_uri").alias("url"), "request", response.alias("response"), "metadata")


def roundtrip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Write ``df`` as archives in the shared folder, read them back, and give one row per capture.

    Columns: id, payload_bytes, payload_digest, record_type, refers_to (the
    id of the response that a revisit refers to). Null and repeated rows are
    captures of their own (see ``write_warc``). An empty table gives an empty
    result.
    """
    spark = df.sparkSession
    path = fresh(spark, "warc")
    write_warc(df, path, id_col, url_col, html_col, **options)
    records = materialize(read_warc(spark, path, payloads=False), "warc-records")
    found = assemble(records, dict(df.dtypes)[id_col]).select("key", "response.*")
    captures = materialize(found.select("key", "record_id", "type", "refers_to", "payload_bytes", "payload_digest"), "warc-captures")
    answers = captures.where("type = 'response'")
    again = captures.where("type = 'revisit'")
    keys = answers.select(F.col("record_id").alias("refers_to"), F.col("key").alias("r_key"))
    resolved = salted_join(again, keys, ["refers_to"], _referred(again), "left", ["record_id"])
    return answers.unionByName(resolved, allowMissingColumns=True).select(
        F.col("key").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("r_key").alias("refers_to")
    )
