"""Flow assembly and sequences against a sequential model, at any chunking."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowmill.functions.ranking import with_rank
from flowmill.operators import flows as fl
from flowmill.operators import packets as pkt


def make(n=1500, seed=1):
    """Random packets; one conversation holds a third of them."""
    rng = random.Random(seed)
    rows, t = [], 1000.0
    for seq in range(n):
        t += rng.choice([0.0, -0.5, 1e-7, 0.003, 1.0, 700.0])
        hot = rng.random() < 0.33
        a = ("10.0.0.1", 5000) if hot else (f"10.0.0.{rng.randrange(2, 30)}", 5000 + rng.randrange(3))
        b = ("192.168.0.9", 443) if hot else ("192.168.0.9", rng.choice([443, 53]))
        src, dst = (a, b) if rng.random() < 0.5 else (b, a)
        proto = 6 if hot else rng.choice([6, 17])
        payload = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 70, 200])))
        if rng.random() < 0.02:
            payload = payload * 100
        rows.append((rng.randrange(2), seq, t, proto, *src, *dst, len(payload), payload))
    return rows


SCHEMA = (
    "capture int, seq bigint, t double, proto int, src_ip string, src_port int,"
    " dst_ip string, dst_port int, len int, payload binary"
)


def model(rows):
    """One pass in file order, as a plain program would do it."""
    flows = {}
    for cap, seq, t, proto, sip, sport, dip, dport, length, payload in sorted(rows, key=lambda r: r[1]):
        if proto == 17 and 53 in (sport, dport):
            continue
        key, back = (cap, proto, sip, sport, dip, dport), (cap, proto, dip, dport, sip, sport)
        name = back if key not in flows and back in flows else key
        flows.setdefault(name, []).append((seq, t, 1 if (sip, sport) == name[2:4] else -1, length, payload))
    out = {}
    for name, packets in flows.items():
        paid = [p for p in packets if p[3] > 0]
        if len(paid) < 5:
            continue
        iats, before = [], None
        for _, t, *_ in paid:
            gap = max(t - before, 1e-6) if before is not None else 1e-6
            iats.append(min(max(int(1000 / (1 + math.exp(-math.log10(gap)))), 0), 999))
            before = t
        out[name] = (
            len(packets), [p[0] for p in packets],
            [min(p[3], 1500) * p[2] + 1500 for p in paid], iats,
            [(p[2], p[4][:64].hex()) for p in paid[:8]],
        )
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = make()
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("chunk, parts", [(1 << 20, 3), (64, 7), (5, 2), (1, 4)])
def test_flows_equal_a_sequential_model(data, chunk, parts):
    rows, df = data
    expected = model(rows)
    packets = pkt.drop_udp_dns(df.repartition(parts))
    flows = fl.assemble_flows(fl.slim(packets), chunk=chunk)
    seen = {}
    for r in flows.collect():
        name = (r.capture, r.proto, r.cli_ip, r.cli_port, r.srv_ip, r.srv_port)
        seen.setdefault(name, []).append(r.seq)
        assert r.n_packets == expected[name][0]
    assert {k: sorted(v) for k, v in seen.items()} == {k: v[1] for k, v in expected.items()}
    tokens = fl.flow_tokens(flows)
    got = {}
    for r in fl.flow_sequences(tokens, 100000).collect():
        name = (r.capture, r.proto, r.cli_ip, r.cli_port, r.srv_ip, r.srv_port)
        got[name] = (list(r.size_tokens), list(r.iat_tokens), [(p.direction, "".join(p.tokens)) for p in r.packets])
    assert got == {k: v[2:] for k, v in expected.items()}


def test_head_of_flows_equals_the_start_of_whole_flows(data):
    _, df = data
    flows = fl.assemble_flows(fl.slim(pkt.drop_udp_dns(df)), chunk=50)
    head = fl.flow_tokens(flows, max_packets=12).select("seq", "rank", "size_token", "iat_token")
    whole = fl.flow_tokens(flows).filter("rank < 12").select("seq", "rank", "size_token", "iat_token")
    assert sorted(head.collect()) == sorted(whole.collect())


def test_size_chunks_hold_the_whole_sequence(data):
    rows, df = data
    tokens = fl.flow_tokens(fl.assemble_flows(fl.slim(pkt.drop_udp_dns(df)), chunk=50))
    parts = fl.size_chunks(tokens, per_chunk=7).collect()
    assert max(len(p.size_tokens) for p in parts) == 7
    whole = {}
    for p in sorted(parts, key=lambda p: (p.flow_key, p.part)):
        whole.setdefault(p.flow_key, []).extend(p.size_tokens)
    assert sorted(whole.values()) == sorted(v[2] for v in model(rows).values())


def test_flow_table_equals_assembled(data):
    _, df = data
    packets = pkt.drop_udp_dns(df)
    names = fl.flow_table(packets).filter("n_payload >= 5")
    columns = ["flow_key", "cli_ip", "cli_port", "srv_ip", "srv_port", "n_packets", "n_payload"]
    flows = fl.assemble_flows(packets, chunk=10).select(*columns).distinct()
    assert sorted(names.select(*columns).collect()) == sorted(flows.collect())


@pytest.mark.parametrize("keep", [None, 40])
def test_ranks(spark, keep):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 5}", rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    ranked = with_rank(
        df, ["k"], [F.col("x")], F.floor(F.col("x") * 50), total="n",
        keep=None if keep is None else F.col("rank") < keep,
    )
    got = {(r.k, r.x): (r.rank, r.n) for r in ranked.collect()}
    expected = {}
    for k in {k for k, _ in rows}:
        mine = sorted(x for key, x in rows if key == k)
        for i, x in enumerate(mine):
            if keep is None or i < keep:
                expected[k, x] = (i, len(mine))
    assert got == expected


def test_ranks_with_null_and_without_groups(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "k string, x int")
    grouped = with_rank(df, ["k"], [F.col("x")], F.col("x"))
    assert {(r.k, r.x, r.rank) for r in grouped.collect()} == {(None, 1, 0), (None, 2, 1), ("a", 3, 0)}
    overall = with_rank(df, [], [F.col("x")], F.floor(F.col("x") / 2))
    assert {(r.x, r.rank) for r in overall.collect()} == {(1, 0), (2, 1), (3, 2)}


def test_snapped_captures_keep_their_flows(spark):
    rows = [("c", i, float(i), 6, "10.0.0.1", 1, "10.0.0.2", 2, 0, 100 if i else 0) for i in range(6)]
    df = spark.createDataFrame(
        rows, "capture string, seq long, t double, proto int, src_ip string, src_port int, dst_ip string, dst_port int, len int, declared_len int")
    kept = fl.assemble_flows(df)
    assert kept.count() == 6 and kept.select("n_payload").distinct().first()[0] == 5
    assert fl.flow_table(df).first().n_payload == 5
    assert fl.assemble_flows(df.drop("declared_len")).count() == 0
