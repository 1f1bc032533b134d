"""The join against brute force over all pairs, on copies, near copies and odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from flowmill.llm import ngram_jaccard as nj
from flowmill.llm.graph import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORDS.findall((text or "").translate(LOWER))
    if len(w) >= width:
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)] if w else [])


def brute(rows, width, percent):
    """(size, component) for each row; ids are nodes."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows]
    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if s and t and a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def fixture(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, ident = [], 0
    passage = rng.choices(vocabulary, k=60)
    for group in range(16):
        base = rng.choices(vocabulary, k=rng.choice([3, 9, 10, 12, 20, 40, 150]))
        if group % 3 == 0:
            base = passage + base
        for _ in range(rng.choice([1, 2, 3, 8])):
            words = edited(rng, base, rng.choice([0.001, 0.005, 0.01, 0.03])) if rng.random() < 0.7 else base
            ident += rng.randrange(1, 4)
            rows.append((ident, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    big = rng.choices(vocabulary, k=120)  # a group of near copies larger than a stripe
    for _ in range(60):
        ident += 1
        rows.append((ident, " ".join(edited(rng, big, 0.012))))
    return rows


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_against_brute_force(spark, monkeypatch, width, percent):
    monkeypatch.setattr(nj, "STRIPE", 16)
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nj.shingle_components(df, width=width, percent=percent).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, width, percent)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a\nB"), (6, "a b c"), (7, "a b c"), (7, "a b c"),
            (None, "a b c"), (9, "x"), (10, "X"), (11, "one two three four"), (7, "one two three four")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, size int, class string")
    got = nj.shingle_components(df).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 3, 90)
    none = nj.shingle_components(df.limit(0))
    assert none.columns == ["doc_id", "n_shingles", "component_id"] and none.count() == 0


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 60)])
def test_linked_sets_share_a_key(width, percent):
    rule, rng = nj.Rule(width, percent), np.random.default_rng(3)
    for size in [2, 5, 9, 10, 11, 19, 20, 37, 64, 100, 333, 2000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
            drop, add = rng.integers(0, 1 + size // 3, 2)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            overlap = len(np.intersect1d(a, b))
            if len(a) and len(b) and rule.linked(overlap, len(a), len(b)) and len(a) + len(b) > 2 * overlap:
                assert np.intersect1d(nj.keys_of(a, rule), nj.keys_of(b, rule)).size


def test_tree_finds_what_a_scan_finds():
    rule, rng = nj.Rule(3, 90), np.random.default_rng(5)
    base = rng.poisson(3, (12, nj.GROUPS))
    points = np.maximum(base[rng.integers(0, 12, 300)] + rng.integers(-1, 2, (300, nj.GROUPS)) * (rng.random((300, nj.GROUPS)) < 0.1), 0)
    points = points.astype(np.int32)
    sizes = points.sum(1)
    q, e, _ = nj.Tree(points, sizes).search(points, sizes, rule)
    bound = np.minimum(points[:, None], points[None]).sum(2)
    could = rule.linked(np.minimum(bound, np.minimum(sizes[:, None], sizes[None])), sizes[:, None], sizes[None])
    assert set(zip(*np.nonzero(could))) <= set(zip(q.tolist(), e.tolist()))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 3), (3, 2), (20, 3)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 161)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_long_sets(documents, spark):
    """Sets of 3,000 to 20,000 shingles, near copies around the threshold, against brute force."""
    rng = np.random.default_rng(12)
    texts = []
    for n in (3000, 3200, 8000, 20_000):
        base = [f"w{x}" for x in rng.integers(0, 50_000, n)]
        texts.append(base)
        for share in (0.01, 0.03, 0.06):
            copy = list(base)
            for at in rng.choice(n, int(n * share), replace=False):
                copy[at] = f"x{rng.integers(1 << 30)}"
            texts.append(copy)
        texts.append([f"w{x}" for x in rng.integers(0, 50_000, n)])  # unrelated, of the same size
    texts.append(["a"] * 70_000)
    rows = [(i * 3, " ".join(t)) for i, t in enumerate(texts)]
    for width, percent in ((5, 80), (3, 90)):
        sets = [{tuple(t[i : i + width]) for i in range(len(t) - width + 1)} for t in texts]
        root = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    old, new = max(root[i], root[j]), min(root[i], root[j])
                    root = [new if r == old else r for r in root]
        got = nj.shingle_components(documents(rows), width=width, percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {
            i * 3: (len(s), root[i] * 3) for i, s in enumerate(sets)}
        assert len(set(root)) < len(root)


def test_last_rounds_list_few_pairs_that_cannot_link(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(60):
        own = list(base)
        for at in rng.sample(range(300), 3 if i % 10 == 0 else 16):
            own[at] = f"x{i}y{at}"
        texts.append(" ".join(own))
    rule = nj.Rule(5, 80)
    sets = list(nj.shingle_sets(pa.array(texts), 5))
    linked = {(i, j) for i in range(60) for j in range(i + 1, 60)
              if rule.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}

    def listed(finer):
        ids = pa.array(range(60), type=pa.int64())
        batch = pa.RecordBatch.from_arrays(
            [pa.array([7] * 60), pa.array([-1] * 60), ids, ids, pa.array([len(s) for s in sets]),
             pa.array([nj._packed(s, finer) for s in sets], type=pa.binary())],
            names=["stripe", "side", "class", "comp", "size", "counts"])
        out = list(nj._stripe_pairs(rule, None, finer)(iter([batch])))
        return {p for b in out for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}

    coarse, fine = listed(1), listed(nj.FINE)
    assert linked and linked <= fine <= coarse
    assert 4 * (len(fine) - len(linked)) < len(coarse) - len(linked)
    rows = spark.range(770).selectExpr("1 as block", "770 as members", "id as class")
    assert nj._crossed(rows).count() == 770
