"""Encoding, masking and entropy: invariants and brute force."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from flowmill.operators import batches as ba
from flowmill.operators import encode as en
from flowmill.operators import entropy
from flowmill.operators import masking as ma


def u(*parts):
    digest = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return int(digest[:8], 16) / 2**32


def key(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def sequences(n=25, length=64, vocab=261, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = [rng.choice([1, *range(5, 5 + (3 if i % 3 else vocab - 5))]) for _ in range(rng.randrange(0, length - 1))]
        body = body[: length - 2]
        out.append((f"f{i}", 0, [2, *body, 3] + [0] * (length - 2 - len(body))))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    data = sequences()
    return data, spark.createDataFrame(data, "flow_key string, dup int, src array<int>").repartition(3)


def new_id(token, draw, other, vocab):
    if draw < 0.8:
        return 4
    if draw < 0.9:
        r = int(other * (vocab - 4))
        return 1 if r == 0 else r + 4
    return token


def test_token_masking(rows):
    data, df = rows
    got = {r.flow_key: r for r in ma.mask_raw(df).collect()}
    for name, dup, seq in data:
        used = len([x for x in seq if x])
        can = sorted((i for i, x in enumerate(seq) if x not in (0, 2, 3)), key=lambda i: key(7, "mask", name, dup, i))
        plan = sorted(can[: max(1, round(used * 0.15))])
        masked = list(seq)
        for i in plan:
            masked[i] = new_id(seq[i], u(7, "draw", name, dup, i), u(7, "token", name, dup, i), 261)
        r = got[name]
        assert [(t.pos, t.token) for t in r.tgt] == [(i, seq[i]) for i in plan]
        assert list(r.src_masked) == masked


def test_span_masking(rows):
    data, df = rows
    weights = [0.2 * 0.8 ** (k - 1) for k in range(1, 11)]
    bounds = [sum(weights[:k]) / sum(weights) for k in range(1, 10)]
    got = {r.flow_key: r for r in ma.mask_raw(df, spans=True).collect()}
    long_spans = 0
    for name, dup, seq in data:
        used = len([x for x in seq if x])
        spans, free = [], 0
        for i in range(used):
            if seq[i] in (0, 2, 3) or i < free:
                continue
            n = 1 + sum(u(7, "span", name, dup, i) >= b for b in bounds)
            free = i + n
            spans.append((i, min(n, used - i)))
        spans.sort(key=lambda s: key(7, "mask", name, dup, s[0]))
        most, targets, masked = max(1, round(used * 0.15)), [], list(seq)
        for start, n in spans:
            if len(targets) + n > most:
                continue
            long_spans += n > 1
            for i in range(start, start + n):
                targets.append((i, seq[i]))
                masked[i] = new_id(seq[i], u(7, "draw", name, dup, start), u(7, "token", name, dup, i), 261)
        r = got[name]
        assert [(t.pos, t.token) for t in r.tgt] == sorted(targets)
        assert list(r.src_masked) == masked
    assert long_spans > 5


def test_masks_do_not_depend_on_partitions_and_differ_by_epoch(spark):
    data = [(f"f{i}", [2, *range(10, 60), 3] + [0] * 4, [2, *range(110, 160), 3] + [0] * 4) for i in range(20)]
    df = spark.createDataFrame(data, "flow_key string, src_size array<int>, src_iat array<int>")
    one = sorted(ma.dynamic_masking(df.repartition(1), 0).collect())
    assert one == sorted(ma.dynamic_masking(df.repartition(7), 0).collect())
    assert one != sorted(ma.dynamic_masking(df, 1).collect())
    for r in one:
        pos = [t.pos for t in r.tgt_size]
        assert pos == sorted(pos) == [t.pos for t in r.tgt_iat] and len(pos) == round(52 * 0.15)
        for i in range(56):
            if i not in pos:
                assert r.size_masked[i] == r.src_size[i] and r.iat_masked[i] == r.src_iat[i]
    spans = ma.dynamic_masking(df, 0, spans=True).first()
    assert [t.pos for t in spans.tgt_size] == [t.pos for t in spans.tgt_iat]


def test_dense_targets(spark):
    df = spark.createDataFrame([(1, [(0, 9), (3, 8), (7, 7)]), (2, [])], "k int, t array<struct<pos:int,token:int>>")
    got = {r.k: list(r.d) for r in df.select("k", ma.dense_targets(F.col("t"), 8).alias("d")).collect()}
    assert got == {1: [9, 0, 0, 8, 0, 0, 0, 7], 2: [0] * 8}


def test_encoding_limits(spark):
    packets = [(1 if i % 2 else -1, ["ff"] * 64) for i in range(10)]
    df = spark.createDataFrame(
        [("a", packets, list(range(300)), list(range(290))), ("b", [], [], [])],
        "flow_key string, packets array<struct<direction:int,tokens:array<string>>>,"
        " size_tokens array<int>, iat_tokens array<int>",
    )
    rows = {r.flow_key: r for r in en.paired_instance(df).collect()}
    a, b = rows["a"], rows["b"]
    assert list(a.src) == [2] + [260] * 510 + [3]
    assert a.packet_ids[1] == 0 and a.packet_ids[510] == 7 and a.packet_ids[511] == 8
    assert a.directions[0] == 1 and a.directions[1] == 0 and a.directions[65] == 2
    assert list(a.src_size) == [2, *range(5, 259), 3] and list(a.src_iat) == list(a.src_size)
    assert list(b.src) == [2, 3] + [0] * 510 and list(b.src_size) == [2, 3] + [0] * 254
    assert {len(x) for x in (a.src, a.packet_ids, a.directions, b.packet_ids, b.directions)} == {512}


def test_entropy(rows):
    data, df = rows
    got = {r.flow_key: r for r in df.select(
        "flow_key", entropy.flow_reliability(F.col("src"), 261).alias("flow"),
        entropy.local_reliability(F.col("src")).alias("local"),
    ).collect()}
    for name, _, seq in data:
        seen = [x for x in seq if x]
        h = -sum(p * math.log(p + 1e-10) for p in (seen.count(x) / len(seen) for x in set(seen)))
        assert got[name].flow == pytest.approx(min(max(1 - h / math.log(min(len(seen), 261)), 0), 1), abs=1e-9)
        for i, x in enumerate(seq):
            w = [y for y in seq[max(0, i - 8):i + 9] if y]
            if x == 0:
                expected = 0
            elif len(w) <= 1:
                expected = 1
            else:
                h = math.log(len(w)) - sum(math.log(w.count(y)) for y in w) / len(w)
                expected = min(max(1 - h / math.log(len(w)), 0), 1)
            assert got[name].local[i] == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("epoch", [0, 1, 2])
def test_shards_and_batches(spark, epoch):
    df = spark.range(103).withColumnRenamed("id", "flow_key")
    rows = ba.batch_id(ba.round_robin_shard(ba.shuffle(df, ["flow_key"], 7, epoch), 4, epoch), 10, 4, epoch).collect()
    rows.sort(key=lambda r: r.ordinal)
    assert [r.ordinal for r in rows] == list(range(103))
    assert [r.shard for r in rows] == [(epoch * 103 + i) % 4 for i in range(103)]
    for s in range(4):
        batches = [r.batch_id for r in rows if r.shard == s]
        assert batches == [i // 10 for i in range(len(batches))]
