"""Capture files: listing, reading in parallel splits, and export per flow."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmill.functions.arrays import hex_fixed
from flowmill.session import save_and_reload
from flowmill.sources.bytesink import write_files
from flowmill.sources.files import path_part, resolve

# File layout. Magic -> (byte order, ticks per second).
MAGIC = {
    b"\xa1\xb2\xc3\xd4": (">", 10**6),
    b"\xd4\xc3\xb2\xa1": ("<", 10**6),
    b"\xa1\xb2\x3c\x4d": (">", 10**9),
    b"\x4d\x3c\xb2\xa1": ("<", 10**9),
}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
FILE_HEADER, RECORD_HEADER = 24, 16
MAX_FRAME = 262144
# A proposed split start must be followed by so many records, within so many bytes.
LINKS, LOOK_AHEAD = 8, 1 << 20

SPLIT_BYTES, TASK_BYTES = 128 << 20, 64 << 20
SUFFIXES = (".pcap", ".pcapng")
LISTING_TASKS, LISTED_ROWS = 1024, 10000
LISTED_SCHEMA = "path string, length bigint, folder boolean"
_LISTED_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())])


def capture_listing(spark: SparkSession, root: str) -> DataFrame:
    """Capture files under ``root``: path, label, stem, length.

    The label is the directory relative to the root, ``unlabeled`` at the root. Hidden and empty files are
    left out. Directories are listed by tasks, a level at a time, and the listing is stored: an export has a file for
    each flow, too many for the driver to hold.
    """
    # Compared without scheme and host, which a listing may complete.
    base = path_part(root).rstrip("/") + "/"
    found = save_and_reload(_listed(_roots(spark, root)), "listing")
    files = found.filter(~F.col("folder"))
    while (folders := found.filter("folder").count()) > 0:
        found = save_and_reload(_listed(found.filter("folder").repartition(min(folders, LISTING_TASKS))), "listing")
        files = files.unionAll(found.filter(~F.col("folder")))
    plain = F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:(//[^/]*)?/*", "/")
    inner = F.substring(plain, F.instr(plain, base) + len(base), F.length(plain))
    label = F.regexp_extract(inner, r"^(.*)/[^/]*$", 1)
    return files.select(
        "path",
        F.when(label == "", "unlabeled").otherwise(label).alias("label"),
        F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"),
        "length",
    )


def _roots(spark: SparkSession, root: str) -> DataFrame:
    """What ``root`` names, as Spark completes and expands it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.globStatus(store.makeQualified(folder))
    if not found:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {root}.")
    return spark.createDataFrame([(f.getPath().toString(), f.getLen(), f.isDirectory()) for f in found], LISTED_SCHEMA)


def _listed(folders: DataFrame) -> DataFrame:
    return folders.mapInArrow(_list, LISTED_SCHEMA)


def _list(batches):
    """Captures and folders directly below each folder; a file stands for itself."""
    for batch in batches:
        for row in batch.to_pylist():
            filesystem, name = resolve(row["path"])
            scheme = row["path"].removesuffix(name)
            seek = fs.FileSelector(name) if row["folder"] else [name]
            found = [
                (scheme + f.path, None if f.type == fs.FileType.Directory else f.size, f.type == fs.FileType.Directory)
                for f in filesystem.get_file_info(seek) if _listable(f)]
            for at in range(0, len(found), LISTED_ROWS):
                columns = zip(*found[at:at + LISTED_ROWS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _LISTED_ARROW)], schema=_LISTED_ARROW)


def _listable(info) -> bool:
    """Names that Spark reads: not hidden, not being written."""
    name = info.base_name
    if name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"):
        return False
    return info.type == fs.FileType.Directory or (info.size > 0 and name.lower().endswith(SUFFIXES))


class _Capture:
    """One open capture; positions are byte offsets."""

    def __init__(self, path: str):
        filesystem, name = resolve(path)
        self.file = filesystem.open_input_file(name)
        self.size = self.file.size()
        head = self.file.read_at(FILE_HEADER, 0) if self.size >= FILE_HEADER else b""
        self.ng = head[:4] == PCAPNG_MAGIC
        self.order, self.ticks = MAGIC.get(head[:4], (None, 0))
        if self.order:
            self.record = struct.Struct(self.order + "IIII")
            self.linktype = struct.unpack(self.order + "I", head[20:24])[0] & 0x0FFFFFFF

    def header(self, window, at):
        """Record header at a position of a window, or None if it cannot be one."""
        sec, frac, cap, orig = self.record.unpack_from(window, at)
        if frac >= self.ticks or cap > MAX_FRAME or orig > MAX_FRAME or cap > orig:
            return None
        return sec, frac, cap, orig

    def chain(self, start, stop):
        """Yield (position, sec, frac, orig, frame) of records that start before ``stop``."""
        window, base, block = b"", start, 4 << 20
        pos = start
        while pos < stop:
            if pos + RECORD_HEADER > base + len(window):
                window, base = self.file.read_at(min(block, self.size - pos), pos), pos
                if len(window) < RECORD_HEADER:
                    return
            sec, frac, cap, orig = self.record.unpack_from(window, pos - base)
            end = pos + RECORD_HEADER + cap
            if end > base + len(window):
                if end > self.size:
                    return
                window = self.file.read_at(min(max(block, end - pos), self.size - pos), pos)
                base = pos
            at = pos - base + RECORD_HEADER
            yield pos, sec, frac, orig, window[at:at + cap]
            pos = end

    def find_start(self, low, stop):
        """First position from ``low`` from where plausible records reach past ``stop``.

        Returns (start, end): ``end`` is where the chain leaves the split. It is
        only a proposal; see :func:`capture_ranges`.
        """
        window = self.file.read_at(min(stop + LOOK_AHEAD, self.size) - low, low)
        for offset in range(min(len(window), stop - low)):
            end = self._chain_end(window, offset, stop - low)
            if end >= 0 and low + end <= self.size:
                return low + offset, low + end
        return -1, -1

    def _chain_end(self, window, pos, stop):
        """Where a chain from ``pos`` first reaches ``stop``; -1 when it breaks before
        it has passed that and has ``LINKS`` records or the window is used up."""
        links, end = 0, -1
        while pos + RECORD_HEADER <= len(window):
            if end < 0 and pos >= stop:
                end = pos
            if end >= 0 and links >= LINKS:
                return end
            head = self.header(window, pos)
            if head is None:
                return -1
            pos += RECORD_HEADER + head[2]
            links += 1
        return end if end >= 0 else pos if links else -1


def _propose(batches):
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            row["start"], row["end"] = -1, -1
            capture = _Capture(row["path"])
            if capture.order:
                low = FILE_HEADER if row["part"] == 0 else row["low"]
                if row["part"] == 0:
                    end = low
                    for pos, _, _, _, frame in capture.chain(low, row["stop"]):
                        end = pos + RECORD_HEADER + len(frame)
                    row["start"], row["end"] = low, end
                else:
                    row["start"], row["end"] = capture.find_start(low, row["stop"])
        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(
            path=pa.string(), label=pa.string(), stem=pa.string(), part=pa.int32(),
            low=pa.int64(), stop=pa.int64(), start=pa.int64(), end=pa.int64()))


def _arrow(**fields):
    return pa.schema(list(fields.items()))


def capture_ranges(listing: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Byte ranges to read: whole records, each record in exactly one range.

    A capture has no sync marker. For a file longer than a split, each split
    proposes where its first record starts and where its chain of records ends.
    Split 0 starts after the file header; splits that start where the one
    before them ended are proven by induction. In a file where one does not, records are
    followed from the last proven boundary to the next start they meet, and that stretch
    is a range of its own.
    """
    short = listing.filter(F.col("length") <= split_bytes).select(
        "path", "label", "stem", F.lit(FILE_HEADER).cast("bigint").alias("start"),
        F.col("length").alias("end"),
    )
    parts = F.ceil(F.col("length") / split_bytes).cast("int")
    splits = save_and_reload(
        listing.filter(F.col("length") > split_bytes)
        .select("path", "label", "stem", "length", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        .select(
            "path", "label", "stem", "part",
            (F.col("part").cast("bigint") * split_bytes).alias("low"),
            F.least("length", (F.col("part") + 1).cast("bigint") * split_bytes).alias("stop"),
        ),
        "splits",
    )
    proposed = splits.repartition(_tasks(splits, F.col("stop") - F.col("low"))).mapInArrow(
        _propose,
        "path string, label string, stem string, part int, low bigint, stop bigint,"
        " start bigint, end bigint",
    )
    long = save_and_reload(proposed, "proposals")
    ordered = Window.partitionBy("path").orderBy("part")
    wrong = (F.col("start") < 0) | (
        F.coalesce(F.lag("end").over(ordered), F.lit(FILE_HEADER)) != F.col("start")
    )
    checked = long.withColumn("_wrong", wrong).withColumn(
        "_any", F.max("_wrong").over(Window.partitionBy("path")))
    proven = checked.filter(~F.col("_any")).select("path", "label", "stem", "start", "end")
    # A row for each split of a file, so some thousands for a file of a terabyte.
    broken = checked.filter("_any").groupBy("path", "label", "stem").agg(
        F.sort_array(F.collect_list(F.struct("part", "start", "end", "stop"))).alias("splits"))
    walked = broken.mapInArrow(
        _walk, "path string, label string, stem string, start bigint, end bigint")
    return short.unionByName(proven).unionByName(walked)


def _walk(batches):
    """Ranges of files with a split that does not follow: only what is not proven is walked.

    From a proven record boundary the records are followed until one ends where a
    split proposes to start; from there on that split's own chain holds.
    """
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            capture, splits = _Capture(row["path"]), row["splits"]
            ends = {s["start"]: s["end"] for s in splits if s["start"] >= 0}
            pos, length = FILE_HEADER, splits[-1]["stop"]
            while pos < length:
                start = pos
                if capture.order and ends.get(pos, -1) > pos:
                    pos = ends[pos]
                elif capture.order:
                    for at, _, _, _, frame in capture.chain(pos, length):
                        pos = at + RECORD_HEADER + len(frame)
                        if ends.get(pos, -1) > pos:
                            break
                    else:
                        pos = length
                else:
                    pos = length
                found.append((row["path"], row["label"], row["stem"], start, pos))
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in found], type=k) for i, k in enumerate(kinds)],
            names=["path", "label", "stem", "start", "end"])


PACKET_SCHEMA = (
    "capture string, label string, stem string, seq bigint, ts_us bigint, t double,"
    " linktype int, origlen bigint, frame binary"
)
_PACKET_ARROW = _arrow(
    capture=pa.string(), label=pa.string(), stem=pa.string(), seq=pa.int64(), ts_us=pa.int64(),
    t=pa.float64(), linktype=pa.int32(), origlen=pa.int64(), frame=pa.binary())


def _pcapng(capture):
    """(position, ticks since epoch, ticks per second, linktype, orig, frame) of packet blocks."""
    order, links, pos = "<", [], 0
    window, begin = b"", 0

    def read(n, at):
        """From a window read ahead, so that a block is no remote read of its own."""
        nonlocal window, begin
        if at < begin or at + n > begin + len(window):
            window, begin = capture.file.read_at(min(max(n, 1 << 20), capture.size - at), at), at
        return window[at - begin : at - begin + n]

    while pos + 12 <= capture.size:
        kind = read(4, pos)
        if kind == PCAPNG_MAGIC:
            order = "<" if read(4, pos + 8) == b"\x4d\x3c\x2b\x1a" else ">"
            links = []
        size = struct.unpack(order + "I", read(4, pos + 4))[0]
        if size < 12 or pos + size > capture.size:
            return
        block = struct.unpack(order + "I", kind)[0]
        if block in (1, 3, 6):
            body = read(size - 12, pos + 8)
            if block == 1:
                links.append((*struct.unpack_from(order + "HxxI", body), _ticks(order, body)))
            elif block == 6:
                face, high, low, cap, orig = struct.unpack_from(order + "IIIII", body)
                linktype, _, ticks = links[face]
                yield pos, (high << 32) | low, ticks, linktype, orig, body[20:20 + cap]
            elif links:
                orig = struct.unpack_from(order + "I", body)[0]
                linktype, snap, ticks = links[0]
                cap = min(orig, snap or orig, len(body) - 4)
                yield pos, 0, ticks, linktype, orig, body[4:4 + cap]
        pos += size


def _ticks(order, body):
    """Clock resolution option of an interface block; microseconds by default."""
    at = 8
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        if code == 9:
            value = body[at + 4]
            return 2 ** (value & 0x7F) if value & 0x80 else 10**value
        at += 4 + (size + 3) // 4 * 4
    return 10**6


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            capture = _Capture(row["path"])
            if capture.ng:
                records = _pcapng(capture)
            elif capture.order:
                ticks, link = capture.ticks, capture.linktype
                records = (
                    (pos, sec * ticks + frac, ticks, link, orig, frame)
                    for pos, sec, frac, orig, frame in capture.chain(row["start"], row["end"])
                )
            else:
                continue
            columns, held = [[] for _ in range(6)], 0
            for pos, clock, ticks, link, orig, frame in _until_damaged(records):
                values = (pos, clock * 10**6 // ticks, clock / ticks, link, orig, frame)
                for column, value in zip(columns, values):
                    column.append(value)
                held += len(frame) + 48
                if held > 8 << 20:
                    yield _packet_batch(row, columns)
                    columns, held = [[] for _ in range(6)], 0
            if columns[0]:
                yield _packet_batch(row, columns)


def _until_damaged(records):
    """Records up to the first that cannot be read; a damaged file does not fail the job."""
    try:
        yield from records
    except (struct.error, IndexError, ValueError, OverflowError):
        return


def _packet_batch(row, columns):
    n = len(columns[0])
    same = [[row["path"]] * n, [row["label"]] * n, [row["stem"]] * n]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(same + columns, _PACKET_ARROW)], schema=_PACKET_ARROW
    )


def read_captures(spark: SparkSession, root: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Packets of all captures under ``root``.

    ``seq`` is the record's byte offset: it orders a capture's packets and needs
    no counting pass. Spark estimates the packets by the list of ranges, some KB, and would broadcast them,
    so a join of them is marked to be a sort-merge one.
    """
    ranges = save_and_reload(capture_ranges(capture_listing(spark, root), split_bytes), "ranges")
    packets = ranges.repartition(_tasks(ranges, F.col("end") - F.col("start"))).mapInArrow(_read, PACKET_SCHEMA)
    return packets.hint("merge")


def _tasks(pieces: DataFrame, size) -> int:
    """How many tasks read pieces of files: rows of a few bytes that stand for up to a split each.

    One for each piece, or for many small ones as many as their bytes and the cluster ask for.
    """
    n, total = pieces.agg(F.count(F.lit(1)), F.sum(size)).first()
    return max(1, min(n, max(4 * pieces.sparkSession.sparkContext.defaultParallelism, (total or 0) // TASK_BYTES)))


def _record_bytes(ts_us, caplen, origlen, frame):
    return F.concat(
        F.unhex(F.concat(
            hex_fixed(F.floor(ts_us / 1000000), 8), hex_fixed(F.pmod(ts_us, F.lit(1000000)), 8),
            hex_fixed(caplen, 8), hex_fixed(origlen, 8),
        )),
        frame,
    )


def write_captures(packets: DataFrame, path: str, file: str = "file") -> None:
    """One capture file per value of ``file``, packets in ``seq`` order.

    Needs columns seq, ts_us, linktype, origlen and frame. Each file is one
    byte stream and so one task's work, held in constant memory.
    """
    header = F.unhex(F.concat(
        F.lit("a1b2c3d4" "00020004" "00000000" "00000000" "00040000"), hex_fixed(F.col("linktype"), 8)
    ))
    record = _record_bytes(
        F.col("ts_us"), F.octet_length("frame"), F.col("origlen"), F.col("frame")
    )
    write_files(packets, path, F.col(file), record, ["seq"], header)


def write_flow_captures(flows: DataFrame, path: str) -> None:
    """One capture per kept flow, ``label/TCP_ip_port_ip_port.pcap``, all its packets.

    ``flows`` is :func:`flowmill.operators.flows.assemble_flows` output that kept
    the ``frame``. Equal five-tuples of two captures stay apart: the capture's
    name is part of the directory.
    """
    from flowmill.operators.packets import flow_name

    name = flow_name(
        F.col("proto"), F.col("cli_ip"), F.col("cli_port"), F.col("srv_ip"), F.col("srv_port")
    )
    named = flows.withColumn("file", F.concat_ws("/", "label", F.col("stem"), name))
    write_captures(named, path)
