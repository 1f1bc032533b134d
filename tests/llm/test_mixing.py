"""Targets against step-by-step resharing, rounding against its expectation."""

import re

import pytest
from pyspark.sql import functions as F

from flowmill.llm.mixing import mix_sources, word_count


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((k for k in sizes if k is not None), key=lambda x: x.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def mixed(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    return mix_sources(df.withColumn("size", word_count(F.col("text"))), **kw)


def test_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i * 37 % 200), f"s{i % 5}" if i % 7 else None, "x") for i in range(3000)]
    rows += [(9000 + i, "big " * 50, "hot", "x") for i in range(3000)]
    rows += [(20001, None, "s1", "x"), (20002, "", "empty", "x"), (None, "one two", "s2", "x"), (5, "w w", "s0", "x"), (5, "w w", "s0", "x")]
    got = mixed(spark, rows).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = reshared(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s, t in taken.items():
        assert abs(t - want[s]) <= 400 + 0.01 * want[s]
    again = mixed(spark, rows[::-1]).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_each_document_has_its_chance(spark):
    rows = [(i, "a b c", "s", "x") for i in range(640)] + [(1000 + i, "a b c", "t", "x") for i in range(300)]
    total = {}
    for seed in range(6):
        for r in mixed(spark, rows, weights=(1, 2), share=1.0, seed=seed).collect():
            total[r.doc_id] = total.get(r.doc_id, 0) + r.copies
    own = [v for k, v in total.items() if k < 1000]
    # Both sources are fractional; no part of a source is always or never taken.
    for low in range(0, 640, 160):
        part = own[low : low + 160]
        assert abs(sum(part) / 160 / 6 - sum(own) / 640 / 6) < 0.15


def test_empty_and_single(spark):
    assert mixed(spark, []).count() == 0
    one = mixed(spark, [(1, "a b", "s", "x")]).collect()[0]
    assert one.target == 3.0 and one.copies in (1, 2)
    nothing = mixed(spark, [(1, None, None, "x"), (2, "", "b", "x")]).collect()
    assert [r.target for r in nothing] == [0.0, 0.0]
