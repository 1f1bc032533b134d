"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pyspark.sql.functions as F

from flowmill.llm.spelling import corpus_words, near_words, spelling_groups

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _groups(words):
    near = {w: [v for v in words if _one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def _spark(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    rows = spelling_groups(corpus_words(frame)).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def test_texts_against_brute_force(spark):
    rng = np.random.default_rng(5)
    roots = ["".join(rng.choice(list("abcéÿ÷z"), int(rng.integers(6, 9)))) for _ in range(25)]
    docs = []
    for i in range(400):
        words = []
        for r in rng.choice(roots[: 1 + i % 25], 30):
            r = str(r)
            if rng.random() < 0.25:
                at = int(rng.integers(len(r)))
                r = [r[:at] + r[at + 1 :], r[:at] + "b" + r[at:], r[:at] + "ö" + r[at + 1 :]][int(rng.integers(3))]
            words.append(r.upper() if rng.random() < 0.1 and r.isascii() else r)
        docs.append((i * 1000, ["-", " ", "\n1"][i % 3].join(words)))
    docs += [(9000 + i, " ".join([w] * n)) for i, (w, n) in enumerate([("kkkkllll", 400), ("kkkklllm", 60), ("kkkkllmm", 8)])]
    docs += [(None, " ".join(roots)), (0, docs[0][1]), (0, docs[0][1]), (5, None), (6, ""), (7, "日本語" + "Ä" * 9)]
    expected = _groups(_words(docs))
    assert any(r[1] for r in expected) and any(r[2] not in (r[0], r[1]) for r in expected)
    assert _spark(spark, docs) == expected


def test_no_words(spark):
    assert _spark(spark, []) == set()
    assert _spark(spark, [(1, "short x y"), (2, None)]) == set()


def test_a_run_of_a_hundred_thousand_letters(spark):
    run = "ab" * 50_000
    found = _spark(spark, [(i, run) for i in range(30)] + [(100 + i, run[:-1]) for i in range(5)])
    assert {len(r[0]): (len(r[2]), r[3], r[4]) for r in found} == _long(run)


def _long(run):
    count = _words([(i, run) for i in range(30)] + [(100 + i, run[:-1]) for i in range(5)])
    n = {len(w): k for w, k in count.items()}
    assert len(n) == 2 and len(count) == 2
    return {len(run): (len(run), n[len(run)], 1), len(run) - 1: (len(run), n[len(run) - 1], 1)}


def test_links_of_a_crowded_reduced_alphabet(spark):
    """With one symbol every word of a length shares a reduced word; nothing is lost."""
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abx"), int(rng.integers(6, 9)))) for _ in range(300)})
    frame = spark.createDataFrame([(i, w, 5 + i) for i, w in enumerate(words)], "id bigint, word string, n bigint")
    expected = {(a, b) for a in words for b in words if _one_edit(a, b)}
    for symbols in (1, 2, 6):
        rows = near_words(frame, symbols).collect()
        assert {(r.word, r.b) for r in rows} == expected and len(rows) == len(expected)
