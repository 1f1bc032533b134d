"""Text corpora: one record per flow, opened by a ``||`` line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmill.functions.arrays import joined
from flowmill.sources.bytesink import write_files
from flowmill.sources.lines import record_lines

SEPARATOR = "||"


def raw_record(sequences: DataFrame) -> DataFrame:
    """Per flow: ``||``, protocol number, one ``direction hex hex ...`` line per packet."""
    lines = F.transform(
        "packets", lambda p: F.concat(p["direction"].cast("string"), F.lit(" "), F.array_join(p["tokens"], " "))
    )
    value = F.concat_ws("\n", F.lit(SEPARATOR), F.col("proto").cast("string"), F.array_join(lines, "\n"))
    return sequences.select("flow_key", value.alias("value"))


def write_raw_corpus(sequences: DataFrame, path: str) -> None:
    raw_record(sequences).select("value").write.text(path)


def size_fragments(chunks: DataFrame) -> DataFrame:
    """Pieces of the size corpus whose concatenation in (flow, line, part) order is the text.

    A record has one line of size tokens and one of IAT tokens per flow, however
    long; pieces keep every row bounded.
    """
    first = F.col("part") == 0
    head = F.when(
        first, F.concat(F.lit(SEPARATOR + "\n"), F.col("proto").cast("string"), F.lit("\n"))
    ).otherwise(F.lit(" "))
    sizes = F.concat(head, joined(F.col("size_tokens")))
    iats = F.concat(F.when(first, F.lit("\n")).otherwise(F.lit(" ")), joined(F.col("iat_tokens")))

    def piece(line, value):
        return F.struct(F.lit(line).alias("line"), value.alias("value"))

    # The first chunk also brings the end of the record, which sorts last.
    pieces = F.when(
        first, F.array(piece(0, sizes), piece(1, iats), piece(2, F.lit("\n")))
    ).otherwise(F.array(piece(0, sizes), piece(1, iats)))
    return chunks.select("flow_key", "part", F.inline_outer(pieces)).select(
        "flow_key", "part", "line", "value"
    )


def write_size_corpus(chunks: DataFrame, path: str, files: int | None = None) -> None:
    """Write the size corpus as ``files`` text files, each flow whole in one of them.

    By default as many as the session has shuffle partitions, at least 64.
    """
    files = files or max(64, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = size_fragments(chunks)
    name = F.concat(F.lit("part-"), F.lpad(F.pmod(F.xxhash64("flow_key"), F.lit(files)).cast("string"), 5, "0"), F.lit(".txt"))
    write_files(
        pieces, path, name, F.encode("value", "UTF-8"), ["flow_key", "line", "part"]
    )


def _protocol_code(value, strict: bool):
    number = value.cast("int") if strict else value.try_cast("int")
    return F.coalesce(F.when(number == 6, 0).when(number.isNotNull(), 1), F.lit(0))


def _packets(lines: DataFrame) -> DataFrame:
    """(record, at, direction, tokens) of the packet lines; a bad direction counts as +1."""
    value = F.col("value")
    rows = lines.filter((F.col("at") > 1) & (F.instr(value, " ") > 0)).select(
        "record", "at", F.coalesce(F.substring_index(value, " ", 1).try_cast("int"), F.lit(1)).alias("direction"),
        F.filter(F.split(F.substring(value, F.instr(value, " ") + 1, F.length(value)), r"\s+"), lambda t: t != "").alias("tokens"))
    return rows.filter(F.size("tokens") > 0)


def read_raw_packets(spark: SparkSession, path: str) -> DataFrame:
    """(record, at, direction, tokens): a row for each packet line, so a flow may be of any length.

    record is the flow's ordinal in the corpus, at the line's place in its record.
    """
    return _packets(record_lines(spark, path, SEPARATOR))


def raw_flows(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(record, protocol, packets): every record that has a line, packets in order, maybe none."""
    lines = record_lines(spark, path, SEPARATOR)
    heads = lines.filter("at = 1").select("record", _protocol_code(F.col("value"), strict).alias("protocol"))
    listed = F.sort_array(F.collect_list(F.struct("at", "direction", "tokens")))
    packets = _packets(lines).groupBy("record").agg(
        F.transform(listed, lambda p: F.struct(p["direction"].alias("direction"), p["tokens"].alias("tokens"))).alias("packets"))
    none = F.array().cast("array<struct<direction:int,tokens:array<string>>>")
    return heads.join(packets, "record", "left").withColumn("packets", F.coalesce("packets", none))


def read_raw_corpus(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Parse the raw corpus: protocol code and packets (direction, tokens), a row per flow.

    A bad protocol number counts as 0 (``strict`` raises instead), a bad
    direction as +1; packet lines without a token are skipped and flows without
    packets are dropped. Flows too long for a row: :func:`read_raw_packets`.
    """
    return raw_flows(spark, path, strict).filter(F.size("packets") > 0).select("protocol", "packets")


def _numbers(line):
    """Token numbers of a line; what is no number is null, which encodes as [UNK]."""
    tokens = F.filter(F.split(line, r"\s+"), lambda x: x != "")
    return F.transform(tokens, lambda x: x.try_cast("int"))


def _sized(lines: DataFrame) -> DataFrame:
    """(record, protocol, size_tokens, iat_tokens) from the lines at places 1, 2 and 3 of each record."""
    at = lambda place: F.max(F.when(F.col("at") == place, F.col("value")))
    rows = lines.filter("at between 1 and 3").groupBy("record").agg(
        at(1).alias("head"), at(2).alias("sizes"), at(3).alias("iats")).filter("head is not null")
    return rows.select("record", _protocol_code(F.col("head"), False).alias("protocol"),
                       _numbers(F.coalesce("sizes", F.lit(""))).alias("size_tokens"),
                       _numbers(F.coalesce("iats", F.lit(""))).alias("iat_tokens"))


def size_flows(spark: SparkSession, path: str) -> DataFrame:
    """(record, protocol, size_tokens, iat_tokens) by place: the two lines after the protocol's.

    A missing or blank line gives no tokens, and without sizes there are no IATs either.
    """
    rows = _sized(record_lines(spark, path, SEPARATOR))
    none = F.array().cast("array<int>")
    return rows.withColumn("iat_tokens", F.when(F.size("size_tokens") > 0, F.col("iat_tokens")).otherwise(none))


def read_size_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Parse the size corpus: protocol code, size tokens, IAT tokens, from the first two
    lines after the protocol's that are not blank; both are needed.

    A token that is no number is null, which encodes as [UNK].
    """
    lines = record_lines(spark, path, SEPARATOR)
    # Spark keeps two rows a record before it shuffles, so further lines are never gathered.
    nth = F.row_number().over(Window.partitionBy("record").orderBy("at"))
    body = lines.filter("at > 1 and value <> ''").withColumn("nth", nth).filter("nth <= 2")
    body = body.select("record", (F.col("nth") + 1).cast("bigint").alias("at"), "value")
    rows = _sized(lines.filter("at = 1").unionByName(body))
    return rows.filter((F.size("size_tokens") > 0) & (F.size("iat_tokens") > 0)).select("protocol", "size_tokens", "iat_tokens")


def corpus_counts(spark: SparkSession, path: str) -> DataFrame:
    """Flows (``||`` lines, padded or not) and lines of a corpus."""
    lines = spark.read.text(path)
    return lines.agg(
        F.count(F.when(F.col("value").rlike(r"(?U)^\s*\|\|\s*$"), 1)).alias("flows"),
        F.count(F.lit(1)).alias("lines"),
    )
