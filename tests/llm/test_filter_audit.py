"""The Gray-code audit against filters applied one after the other."""

import re
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from flowmill.llm.filter_audit import failure_cells, gray_walk, interaction_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _fails(docs):
    """Failing filters of each row, from the words of the contract."""
    found = []
    for doc_id, text, _ in docs:
        text = text or ""
        words = WORD.findall(text)
        bad = set()
        if len(words) < 100:
            bad.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            bad.add("C")
        if re.search(r"[#$%&*|]", text):
            bad.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs):
            bad.add("E")
        found.append(bad)
    return found


def _brute(docs, labels):
    fails = _fails(docs)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {p or "" for _, _, p in docs}:
        rows = [(d[0], f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                failing = [r for r in rows if name in r[1]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(r[1] == {name} for r in rows),
                    sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for key, row in out.items():
            if key[0] == part:
                row.append(shapley[key[1][key[2] - 1]])
    return out


def _audit(spark, docs, labels, extra=""):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    if extra:
        for name in extra.split():
            import pyspark.sql.functions as F

            frame = frame.withColumn(name, F.lit(7))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = interaction_audit(failure_cells(frame, marks)).collect()
    assert len({(r[0], r[1], r[2]) for r in rows}) == len(rows)
    return {tuple(r[:3]): list(r[3:]) for r in rows}


def test_audit_equals_sequential_filters(spark):
    rng = np.random.default_rng(3)
    docs = []
    for i in range(120):
        n = int(rng.choice([0, 5, 99, 100, 101, 150]))
        words = [f"w{x}" for x in rng.integers(0, int(rng.choice([30, 10_000])), n)]
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words.append("a#b")
        docs.append((i * 7, " \t\n"[int(rng.integers(3))].join(words), ["en", "de", None, ""][i % 4]))
    docs += [(1000 + i, docs[i % 9][1], ["en", "xx"][i % 2]) for i in range(40)]
    labels = [(d[0], int(rng.integers(2)), int(rng.integers(2))) for d in docs[::2]]
    assert _audit(spark, docs, labels) == _brute(docs, labels)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(200_000))
    docs = [(None, None, None), (None, "a", "en"), (1, "a", "en"), (1, "a", "en"), (2, "a", "en"), (0, "", "en"),
            (3, None, "de"), (4, long, "de"), (5, long, "en"), (6, "Ä" * 10 + "A", "en"), (7, "\x0b\x0c", None)]
    labels = [(1, 1, None), (1, 0, 1), (2, None, None), (None, 1, 1)]
    assert _audit(spark, docs, labels, "id part mask n quality toxic digest least") == _brute(docs, labels)


def test_no_documents(spark):
    assert _audit(spark, [], []) == {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 31), st.integers(0, 9)), max_size=40))
def test_states_of_the_walk(cells):
    masks = np.array([m for m, _ in cells], dtype=np.int64)
    counts = np.array([[n, 2 * n] for _, n in cells], dtype=np.int64).reshape(-1, 2)
    states = gray_walk(masks, counts, 5)
    for subset in range(32):
        alive = (masks & subset) == 0
        assert states[subset].tolist() == counts[alive].sum(axis=0).tolist()
