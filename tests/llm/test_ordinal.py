"""Held-out accuracy, ordered thresholds, odd rows."""

import random

import numpy as np

from flowmill.llm import ordinal


def rows(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(20, 200))
        grade = rng.choice([0, 1, 2, 2])
        if grade == 0:
            text = [w + rng.choice(["###", "%%%", "&&&"]) for w in text]
        if grade == 1:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["nasty", "vile.", "Nastier", "vileness"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(grade > 0), int(grade == 1)))
    return docs, labels


def test_held_out(spark, documents):
    docs, labels = rows(1600, 1)
    grades = ordinal.label_grades(spark.createDataFrame(labels[:1200], "doc_id long, quality int, toxic int"))
    model = ordinal.fit_grades(documents(docs), grades, n_grades=3, accept_grade=2)
    assert np.all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r for r in ordinal.grade_documents(documents(docs), model, accept_grade=2).collect()}
    wrong = sum(got[i].accepted != (q == 1 and t == 0) for i, q, t in labels[1200:])
    assert wrong <= 8
    mean = [np.mean([got[i].expected_grade for i, q, t in labels[1200:] if q * (2 - t) == g]) for g in (0, 1, 2)]
    assert mean[0] < mean[1] < mean[2]


def test_odd_rows(spark, documents):
    df = documents([(1, None), (2, ""), (None, "x"), (4, "same"), (4, "same"), (5, "long " * 50_000)])
    df = df.withColumnRenamed("source", "accepted")
    few = ordinal.label_grades(spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, None, 0), (77, 0, 1)], "doc_id long, quality int, toxic int"))
    model = ordinal.fit_grades(df, few, n_grades=3, accept_grade=2)  # one grade only: nothing is learnt
    got = ordinal.grade_documents(df, model, accept_grade=2)
    assert got.columns == ["doc_id", "text", "lang", "n_chars", "expected_grade", "tail_probability", "accepted"]
    assert [r.accepted for r in got.collect()] == [True] * 6
    assert ordinal.grade_documents(df.limit(0), model, accept_grade=2).count() == 0
    assert ordinal.fit_grades(df.limit(0), few, n_grades=3, accept_grade=2).accept == 0.0
