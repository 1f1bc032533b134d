"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME_BYTES``, frames into bundles,
and a bundle ends with a footer: a skippable frame with every frame's compressed and raw
size (the public seekable format), so that one record is read by decompressing one frame.
The index maps record ids to (bundle, frame, offset in the frame, length).

A record whose payload equals an earlier one's is written as a revisit without payload. Which
record is the response is found by digest before anything is written: the one of smallest
id, among payloads of at least ``least`` bytes.

Bundles are dealt by a hash of the record id into as many as the payload bytes need, so a bundle is
bounded unless one record is larger; copies of one payload are revisits and do not gather anywhere.
A task streams the frames of its bundles and renames each file when it ends, so a retried task
leaves one whole bundle.

Defined cases: null payloads are empty; a null id is written as a record of its own that
refers to nothing and is never referred to; repeated rows are records of their own: rows of the
smallest id of a payload are all responses, as a revisit refers to another id. No rows give no bundles.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm.graph import small_enough
from flowmill.sources.bytesink import ByteFiles

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20  # of payloads
BROADCAST_ROWS = 200_000  # digests
NO_ID = "none"
INDEX = "record_id string, bundle bigint, frame int, offset bigint, length bigint"
READ = ("record_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string,"
        " url string, payload binary")


def planned(records: DataFrame, *, id_col: str, payload_col: str, url_col: str | None, least: int) -> DataFrame:
    """(id, url, payload, digest, bytes, response): ``response`` is the id it repeats, else null."""
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = records.select(
        F.col(id_col).cast("bigint").alias("id"), url.alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    large = rows.filter((F.col("bytes") >= least) & F.col("id").isNotNull()).select("digest", "id")
    # Only digests met twice matter: what is joined is small unless most records are copies.
    twice = large.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(small_enough(twice.drop("n"), BROADCAST_ROWS), "digest", "left").withColumn(
        "response", F.when((F.col("id") != F.col("first")) & (F.col("bytes") >= least), F.col("first"))).drop("first")


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}"]
    if url is not None:
        # A header value is one line.
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    body = b"" if refers_to is not None else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame behind the data frames; sizes are (compressed, raw)."""
    entries = b"".join(struct.pack("<II", *x) for x in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def frames_of(bundle: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, raw size) of each frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    at, found, place = len(bundle) - 9 - count * width, [], 0
    for i in range(count):
        packed, raw = struct.unpack_from("<II", bundle, at + i * width)
        found.append((place, packed, raw))
        place += packed
    return found


def records_of(frame: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of each record of a raw frame."""
    at = 0
    while at < len(frame):
        cut = frame.index(b"\r\n\r\n", at)
        lines = frame[at:cut].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        body = frame[cut + 4 : cut + 4 + size]
        end = cut + 8 + size
        yield at, end - at, headers, body
        at = end


def _framed(batches):
    """Rows sorted by bundle -> (file, head, data): the frames of each bundle, then its seek table."""
    packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
    current, sizes, frame = None, [], bytearray()

    def row(data: bytes):
        return pa.RecordBatch.from_arrays(
            [pa.array([bundle_name(current)]), pa.array([b""], type=pa.binary()), pa.array([data], type=pa.binary())],
            names=["file", "head", "data"])

    def closed_frame():
        packed = packer.compress(bytes(frame))
        sizes.append((len(packed), len(frame)))
        frame.clear()
        return row(packed)

    for batch in batches:
        columns = [batch.column(n) for n in ("bundle", "id", "url", "payload", "digest", "bytes", "response")]
        for bundle, ident, url, payload, digest, size, response in zip(*columns):
            if bundle.as_py() != current:
                if current is not None:
                    if frame:
                        yield closed_frame()
                    yield row(seek_table(sizes))
                    sizes.clear()
                current = bundle.as_py()
            known, first = ident.as_py(), response.as_py()
            frame += record_bytes(
                NO_ID if known is None else str(known), url.as_py(), payload.as_buffer(), digest.as_py(), size.as_py(),
                None if first is None else str(first))
            if len(frame) >= FRAME_BYTES:
                yield closed_frame()
    if current is not None:
        if frame:
            yield closed_frame()
        yield row(seek_table(sizes))


def write_bundles(
    records: DataFrame, path: str, *, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url",
    least: int = 100, bundle_bytes: int = BUNDLE_BYTES,
) -> None:
    """Write the bundles as files ``bundle-<number>.warc.zst`` below ``path``."""
    spark = records.sparkSession
    spark.dataSource.register(ByteFiles)
    rows = planned(records, id_col=id_col, payload_col=payload_col, url_col=url_col, least=least)
    stored = records.select(F.sum(F.octet_length(F.col(payload_col).cast("binary")).cast("bigint"))).first()[0] or 0
    bundles = max(1, -(-stored // bundle_bytes))
    tasks = max(bundles, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("bundle", F.pmod(F.xxhash64("id", "digest"), F.lit(bundles)))
    dealt = dealt.repartition(tasks, "bundle").sortWithinPartitions("bundle", "id", "digest")
    dealt.select("bundle", "id", "url", F.when(F.col("response").isNull(), F.col("payload")).otherwise(
        F.lit(b"")).alias("payload"), "digest", "bytes", "response").mapInArrow(
            _framed, "file string, head binary, data binary").write.format("byte_files").mode("append").save(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, bundle, frame, offset, length): where each record is."""

    def run(batches):
        for batch in batches:
            for bundle, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = content.as_buffer()
                rows = []
                for number, (place, packed, _) in enumerate(frames_of(content.to_pybytes())):
                    raw = zstandard.ZstdDecompressor().decompress(content[place : place + packed])
                    for offset, length, headers, _ in records_of(raw):
                        rows.append((_name(headers["WARC-Record-ID"]), bundle, number, offset, length))
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)],
                    names=["record_id", "bundle", "frame", "offset", "length"])

    return _contents(spark, path).mapInArrow(run, INDEX)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, content) of every bundle."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "bundle-*.warc.zst").load(path)
    return files.select(F.regexp_extract("path", r"bundle-(\d+)\.warc", 1).cast("bigint").alias("bundle"), "content")


def bundle_name(number: int) -> str:
    return f"bundle-{number:08d}.warc.zst"


def _name(urn: str) -> str:
    return urn.removeprefix("<urn:page:").removesuffix(">")


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: only its frame is decompressed."""
    place, packed, _ = frames_of(bundle)[frame]
    raw = zstandard.ZstdDecompressor().decompress(bundle[place : place + packed])
    _, _, headers, body = next(records_of(raw[offset : offset + length]))
    return headers, body


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Every record, its payload checked against its digest; a revisit has no payload of its own."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for content in batch.column(1):
                bundle = content.as_buffer().to_pybytes()
                for place, packed, _ in frames_of(bundle):
                    rows = []
                    for _, _, headers, body in records_of(unpack.decompress(bundle[place : place + packed])):
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        kind = headers["WARC-Type"]
                        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                        refers = headers.get("WARC-Refers-To")
                        rows.append((
                            _name(headers["WARC-Record-ID"]), int(headers["WARC-Payload-Length"]), digest, kind,
                            refers and _name(refers), headers.get("WARC-Target-URI"), body if kind == "response" else None))
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, type=k) for x, k in zip(zip(*rows), kinds)],
                        names=["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return _contents(spark, path).mapInArrow(run, READ)
