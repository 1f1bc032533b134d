"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

A bin is filled greedily, always with the longest piece that still fits; then its smallest
piece is replaced by two unpacked pieces if the two fill the expanded gap more tightly.
Only the number of pieces of each length matters for that, so the bins are planned on the
histogram of lengths (at most ``capacity`` rows, whatever the number of documents): equal bins
follow each other until a length runs short, so they are planned as one pattern with a
count. Pieces are then ranked within their length and take the places of their rank, a
lookup in the table of patterns; no piece and no bin passes through the driver.

Defined cases: null or empty text: only the end token. A text of any length is cut
into whole sequences and a rest. Repeated rows and null ids are packed like any other. No
documents give no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.functions.ranking import with_rank
from flowmill.llm.tokens import WordIds, bpe_words
from flowmill.llm.words import slices
from flowmill.session import save_and_reload

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_kept: dict[str, WordIds] = {}


def _ids(path: str) -> WordIds:
    """One table of words for each Python worker, used by all its tasks."""
    if path not in _kept:
        _kept[path] = WordIds(bpe_words(path), lower=True)
    return _kept[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents' ids and the end id, cut at the capacity."""

    def run(batches):
        words = _ids(tokenizer)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for part in slices(batch.column(1)):
                ids, bounds = words.texts(part)
                for i in range(part.rows):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], end_id).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        cut = own[at : at + capacity]
                        rows.append(part.first + i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, type=pa.int64())), pa.array(piece, type=pa.int32()),
                pa.array(start, type=pa.int64()), pa.array(length, type=pa.int64()), pa.array(crc, type=pa.int64()),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    wide = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return wide.mapInArrow(run, PIECES)


def _two_tightest(available: list[int], left: dict[int, int], gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum within the gap."""
    short = np.array(available[: bisect_right(available, gap - 1)], dtype=np.int64)
    if not len(short):
        return None
    partner = np.searchsorted(short, gap - short, side="right") - 1
    ok = (partner >= 0) & (short[partner] <= short)
    best = None
    sums = np.where(ok, short + short[partner], -1)
    for i in np.argsort(-sums, kind="stable")[:64]:
        if sums[i] < 0 or best is not None and sums[i] <= best[0] + best[1]:
            break
        a, b = int(short[i]), int(short[partner[i]])
        if a == b and left[a] < 2:
            if partner[i] == 0:
                continue
            b = int(short[partner[i] - 1])
        if best is None or a + b > best[0] + best[1]:
            best = a, b
    return best


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of equal bins, [(length, pieces of this length in the bin)])]."""
    left = {int(k): int(v) for k, v in counts.items() if v > 0}
    available = sorted(left)
    patterns = []

    def take(length: int, n: int = 1):
        left[length] -= n
        if not left[length]:
            available.remove(length)

    def put_back(length: int):
        left[length] += 1
        if left[length] == 1:
            available.insert(bisect_right(available, length), length)

    while available:
        gap, filled = capacity, []
        while available and (at := bisect_right(available, gap)):
            length = available[at - 1]
            n = min(left[length], gap // length)
            filled += [length] * n
            take(length, n)
            gap -= n * length
        if gap and len(filled) > 1:
            smallest = filled[-1]
            two = _two_tightest(available, left, gap + smallest)
            if two and sum(two) > smallest:
                filled.pop()
                for length in two:
                    take(length)
                    filled.append(length)
                put_back(smallest)
        uses = {}
        for length in filled:
            uses[length] = uses.get(length, 0) + 1
        more = min(left[length] // n for length, n in uses.items())
        for length, n in uses.items():
            if more:
                take(length, n * more)
        patterns.append((1 + more, sorted(uses.items(), reverse=True)))
    return patterns


def _places(patterns) -> dict[str, np.ndarray]:
    """For each pattern and length: from which rank on, pieces a bin, first sequence, offset in it."""
    rows, used, sequence = [], {}, 0
    for bins, uses in patterns:
        offset = 0
        for length, n in uses:
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + bins * n
            offset += length * n
        sequence += bins
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T.copy()))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pieces with their sequence_id and offset; every piece's length is 1 to ``capacity``."""
    spark = pieces.sparkSession
    pieces = save_and_reload(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan_bins(counts, capacity)))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranked = with_rank(
        pieces.withColumn("_order", order), ["length"],
        [F.col("_order"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")],
        F.shiftright("_order", 52), rank="_rank")

    def run(batches):
        at = places.value
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "_rank"))
            # Rows of the table are sorted by (length, rank); both fit one integer.
            row = np.searchsorted((at["length"] << 48) + at["rank"], (length << 48) + rank, side="right") - 1
            own = rank - at["rank"][row]
            sequence = at["sequence"][row] + own // at["each"][row]
            offset = at["offset"][row] + own % at["each"][row] * length
            kept = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    wanted = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    return wanted.mapInArrow(run, PIECES + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity)
