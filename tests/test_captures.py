"""Capture files made by hand: every link type, odd frames, formats and splits."""

import struct

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from flowmill.operators import flows as fl
from flowmill.operators import packets as pkt
from flowmill.sources import captures as cap
from flowmill.sources.files import path_part

PAY = b"hello world"


def ipv4(payload=PAY, proto=6, sport=1234, dport=80, src="10.0.0.1", dst="10.0.0.2", ihl=5, offset=5, version=4, total=None):
    if proto == 6:
        l4 = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, offset << 4, 0x18, 65535, 0, 0) + bytes((offset - 5) * 4)
    else:
        l4 = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0)
    size = ihl * 4 + len(l4) + len(payload) if total is None else total
    head = struct.pack(">BBHHHBBH", version << 4 | ihl, 0, size, 0, 0, 64, proto, 0)
    head += bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + bytes((ihl - 5) * 4)
    return head + l4 + payload


ETH = bytes(12) + b"\x08\x00"
SLL = bytes(14) + b"\x08\x00"


def decode(spark, frames, linktype, **options):
    rows = [(i, linktype, f) for i, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "seq bigint, linktype int, frame binary")
    return {r.seq: r for r in pkt.decode_packets(df, **options).collect()}


@pytest.mark.parametrize("linktype, link", [(1, ETH), (12, b""), (101, b""), (228, b""), (113, SLL)])
def test_link_types(spark, linktype, link):
    got = decode(spark, [link + ipv4(), link + ipv4(proto=17)], linktype)
    assert (got[0].proto, got[0].src_ip, got[0].src_port, got[0].dst_ip, got[0].dst_port) == (6, "10.0.0.1", 1234, "10.0.0.2", 80)
    assert bytes(got[0].payload) == PAY and got[1].proto == 17 and bytes(got[1].payload) == PAY


def test_rejected_frames(spark):
    frames = [
        ETH[:13],  # shorter than the link header
        bytes(12) + b"\x81\x00\x00\x01\x08\x00" + ipv4(),  # VLAN tag
        bytes(12) + b"\x86\xdd" + bytes(60),  # IPv6 by link type
        ETH + ipv4(version=6),  # IPv6 by header
        ETH + ipv4(proto=1),  # ICMP
        ETH + ipv4()[:19],  # cut in the IP header
        ETH + ipv4()[:39],  # cut in the TCP header
        ETH + ipv4(proto=17)[:27],  # cut in the UDP header
    ]
    assert decode(spark, frames, 1) == {}
    assert decode(spark, [ETH + ipv4()], 105) == {}


def test_header_options_and_padding(spark):
    got = decode(spark, [
        ETH + ipv4(ihl=8, offset=7),
        ETH + ipv4(payload=b"") + bytes(6),  # link padding is not payload
        ETH + ipv4(payload=PAY)[:45],  # snapped: the flag stays, the bytes are cut
        ETH + ipv4(total=0),
    ], 1)
    assert bytes(got[0].payload) == PAY and got[0].len == len(PAY)
    assert got[1].len == 0 and got[1].declared_len == 0 and bytes(got[1].payload) == b""
    assert got[2].declared_len == len(PAY) and got[2].len == 5 and bytes(got[2].payload) == PAY[:5]
    assert got[3].len == 0 and got[3].declared_len < 0


def test_udp_dns_is_dropped_and_tcp_dns_kept(spark):
    frames = [ETH + ipv4(proto=17, dport=53), ETH + ipv4(proto=17, sport=53), ETH + ipv4(dport=53), ETH + ipv4(proto=17)]
    rows = [(i, 1, f) for i, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "seq bigint, linktype int, frame binary")
    assert {r.seq for r in pkt.drop_udp_dns(pkt.decode_packets(df)).collect()} == {2, 3}


def pcap(records, order=">", nano=False, linktype=1):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 262144, linktype)
    for sec, frac, frame, *orig in records:
        out += struct.pack(order + "IIII", sec, frac, len(frame), orig[0] if orig else len(frame)) + frame
    return out


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("nano", [False, True])
def test_formats(spark, tmp_path, order, nano):
    scale = 1000 if nano else 1
    records = [(100 + i, 250000 * scale, ETH + ipv4(payload=bytes([i]))) for i in range(5)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pcap").write_bytes(pcap(records, order, nano))
    rows = sorted(cap.read_captures(spark, str(tmp_path)).collect(), key=lambda r: r.seq)
    assert [r.t for r in rows] == [100.25 + i for i in range(5)]
    assert [r.ts_us for r in rows] == [(100 + i) * 10**6 + 250000 for i in range(5)]
    assert [bytes(r.frame) for r in rows] == [f for _, _, f in records]
    assert {(r.label, r.stem, r.linktype) for r in rows} == {("a", "x", 1)}


def block(kind, body):
    size = 12 + len(body)
    return struct.pack("<II", kind, size) + body + struct.pack("<I", size)


def test_pcapng(spark, tmp_path):
    frame = ETH + ipv4(payload=b"abc")
    padded = frame + bytes(-len(frame) % 4)
    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    data += block(1, struct.pack("<HHI", 1, 0, 65535))
    data += block(1, struct.pack("<HHI", 101, 0, 65535) + struct.pack("<HHB3xHH", 9, 1, 9, 0, 0))
    data += block(6, struct.pack("<IIIII", 0, 0, 5_000_000, len(frame), len(frame)) + padded)
    data += block(5, bytes(12))
    raw = ipv4(payload=b"xy")
    data += block(6, struct.pack("<IIIII", 1, 1, 0, len(raw), len(raw)) + raw + bytes(-len(raw) % 4))
    (tmp_path / "n.pcapng").write_bytes(data)
    rows = sorted(cap.read_captures(spark, str(tmp_path)).collect(), key=lambda r: r.seq)
    assert [(r.linktype, r.ts_us, bytes(r.frame)) for r in rows] == [
        (1, 5_000_000, frame), (101, (1 << 32) // 1000, raw)
    ]
    assert rows[0].label == "unlabeled"


def many(n=400, tempting=True):
    # Payloads that look like record headers, to tempt the search for a start.
    fake = struct.pack(">IIII", 100, 5, 40, 40) if tempting else b"\xff" * 16
    return [(1000 + i, i, ETH + ipv4(payload=fake * (i % 7) + bytes([i % 251]) * (i % 90))) for i in range(n)]


@pytest.mark.parametrize("split", [600, 1000, 4096, 20000, 1 << 20])
def test_splits_read_every_record_once(spark, tmp_path, split):
    records = many()
    (tmp_path / "x.pcap").write_bytes(pcap(records))
    rows = sorted(cap.read_captures(spark, str(tmp_path), split).collect(), key=lambda r: r.seq)
    assert [bytes(r.frame) for r in rows] == [f for _, _, f in records]


@pytest.mark.parametrize("tempting", [True, False])
def test_one_odd_record_does_not_join_all_splits(spark, tmp_path, tempting):
    # Captured length above the original one breaks the chain test of a split.
    plain = many(tempting=tempting)
    records = [(s, f, frame, 10) if i == 250 else (s, f, frame) for i, (s, f, frame) in enumerate(plain)]
    (tmp_path / "x.pcap").write_bytes(pcap(records))
    listing = cap.capture_listing(spark, str(tmp_path))
    ranges = sorted(map(tuple, cap.capture_ranges(listing, 4096).select("start", "end").collect()))
    assert len(ranges) > 5 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    rows = sorted(cap.read_captures(spark, str(tmp_path), 4096).collect(), key=lambda r: r.seq)
    assert [bytes(r.frame) for r in rows] == [f for _, _, f, *_ in records]


def test_many_files_are_read_by_many_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.pcap").write_bytes(pcap(many(3)))
    rows = cap.read_captures(spark, str(tmp_path)).select("capture", F.spark_partition_id().alias("p"))
    assert rows.count() == 120 and rows.select("p").distinct().count() >= 20


def test_damaged_files_do_not_fail_the_others(spark, tmp_path):
    (tmp_path / "good.pcap").write_bytes(pcap(many(9)))
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    head = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    (tmp_path / "face.pcapng").write_bytes(head + block(6, struct.pack("<IIIII", 3, 0, 0, 0, 0)))
    (tmp_path / "cut.pcapng").write_bytes(head + block(6, b"\0\0"))
    (tmp_path / "cut.pcap").write_bytes(pcap(many(2))[:30])
    got = cap.read_captures(spark, str(tmp_path)).groupBy("stem").count().collect()
    assert [tuple(r) for r in got] == [("good", 9)]


def test_proven_splits_are_many(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(pcap(many(tempting=False)))
    assert cap.capture_ranges(cap.capture_listing(spark, str(tmp_path)), 4096).count() > 5


def test_many_small_splits_are_dealt_to_few_tasks(spark, tmp_path):
    records = many(tempting=False)
    (tmp_path / "x.pcap").write_bytes(pcap(records))
    read = cap.read_captures(spark, str(tmp_path), 512)
    assert cap.capture_ranges(cap.capture_listing(spark, str(tmp_path)), 512).count() > 40
    assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert [bytes(r.frame) for r in sorted(read.collect(), key=lambda r: r.seq)] == [f for _, _, f, *_ in records]


def test_truncated_tail_is_ignored(spark, tmp_path):
    data = pcap(many(20))
    (tmp_path / "x.pcap").write_bytes(data[:-3])
    assert cap.read_captures(spark, str(tmp_path)).count() == 19


def test_listing(spark, tmp_path):
    for name in ("a/x.pcap", "a/b/y.PCAPNG", "z.Pcap", "a/no.txt", "a/pcap"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"1234")
    rows = {(r.label, r.stem, r.length) for r in cap.capture_listing(spark, str(tmp_path)).collect()}
    assert rows == {("a", "x", 4), ("a/b", "y", 4), ("unlabeled", "z", 4)}


def test_listing_is_not_held_by_the_driver(spark, tmp_path):
    for name in ("a/x.pcap", "a/_y.pcap", "a/.z.pcap", "_b/x.pcap", ".c/x.pcap", "_d=1/x.pcap", "e/f/g/x.pcap"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"1234")
    (tmp_path / "a" / "empty.pcap").write_bytes(b"")
    listing = cap.capture_listing(spark, str(tmp_path))
    # Read as a stored table: the files are no input files of the plan, which the driver would hold.
    assert not [f for f in listing.inputFiles() if f.endswith(".pcap")]
    rows = {(r.path, r.label, r.stem) for r in listing.collect()}
    assert rows == {(f"file:{tmp_path}/{d}/x.pcap", d, "x") for d in ("a", "_d=1", "e/f/g")}
    assert cap.capture_listing(spark, str(tmp_path / "e" / "f")).first().label == "g"
    with pytest.raises(AnalysisException):
        cap.capture_listing(spark, str(tmp_path / "none"))


def test_odd_file_names(spark, tmp_path):
    root = tmp_path / "in put"
    (root / "a #b").mkdir(parents=True)
    (root / "a #b" / "c%20d e.pcap").write_bytes(pcap(many(3)))
    rows = cap.read_captures(spark, str(root)).collect()
    assert {(r.label, r.stem) for r in rows} == {("a #b", "c%20d e")} and len(rows) == 3
    rows = cap.read_captures(spark, f"file://{root}/").collect()
    assert {(r.label, r.stem) for r in rows} == {("a #b", "c%20d e")}


@pytest.mark.parametrize("path, local", [
    ("/a/b", "/a/b"), ("file:/a/b", "/a/b"), ("file:///a/b", "/a/b"), ("a/b", "a/b"),
    ("hdfs://host:8020/a/b", "/a/b"), ("hdfs:///a/b", "/a/b"), ("s3a://bucket/a", "/a"),
])
def test_paths_without_scheme_and_host(path, local):
    assert path_part(path) == local


def test_flow_export_round_trip(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "web").mkdir(parents=True)
    up, down = dict(sport=1000, dport=80), dict(sport=80, dport=1000, src="10.0.0.2", dst="10.0.0.1")
    frames = [ETH + ipv4(payload=b"" if i == 0 else bytes([i]), **(up if i % 2 == 0 else down)) for i in range(7)]
    frames.insert(3, ETH + ipv4(proto=17, sport=7, dport=9))  # too short a flow
    (src / "web" / "c.pcap").write_bytes(pcap([(10 + i, 0, f) for i, f in enumerate(frames)], "<"))
    packets = cap.read_captures(spark, str(src))
    flows = fl.assemble_flows(pkt.decode_packets(packets, keep_payload=False, keep_frame=True))
    cap.write_flow_captures(flows, str(out))
    files = [p for p in out.rglob("*.pcap")]
    assert [str(p.relative_to(out)) for p in files] == ["web/c/TCP_10.0.0.1_1000_10.0.0.2_80.pcap"]
    back = sorted(cap.read_captures(spark, str(out)).collect(), key=lambda r: r.seq)
    assert [bytes(r.frame) for r in back] == frames[:3] + frames[4:]
    names = spark.createDataFrame([(files[0].name,)], "file_name string")
    assert pkt.parse_flow_name(names).first().cli_port == 1000


def test_packets_of_captures_are_not_broadcast(spark, tmp_path):
    # The list of files is small, so Spark takes the packets for small too; the driver would hold all frames.
    (tmp_path / "x.pcap").write_bytes(pcap(many()))
    decoded = pkt.decode_packets(cap.read_captures(spark, str(tmp_path)), keep_payload=False, keep_frame=True)
    flows = fl.assemble_flows(decoded)
    assert len(flows.collect()) == 400
    plan = flows._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("name, ok", [
    ("TCP_1.2.3.4_5_6.7.8.9_10.pcap", True), ("udp_1.2.3.4_5_6.7.8.9_10.pcapng", True),
    ("tcp_1.2.3.4_5_6.7.8.9_10_extra.pcap", True), ("icmp_1.2.3.4_5_6.7.8.9_10.pcap", False),
    ("TCP_1.2.3.4_x_6.7.8.9_10.pcap", False), ("TCP_1.2.3.4_5_6.7.8.9.pcap", False),
])
def test_flow_names(spark, name, ok):
    df = spark.createDataFrame([(name,)], "file_name string")
    assert (pkt.parse_flow_name(df).count() == 1) == ok
