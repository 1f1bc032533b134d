"""Fingerprints against a plain model of the same definition, neighbours against slices."""

import random

from pyspark.sql import functions as F

from flowmill.llm.order_minhash import ENTRIES, likeness, next_ids, with_fingerprint, with_neighbours


def test_neighbours(spark, documents):
    rng = random.Random(1)
    words = ["the", "of", "été", "größe", "𝒳y", "river", "stone"] + [f"w{i}" for i in range(400)]
    rows = [(i * 5 - 20, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(120)]
    rows += [(1001, None), (1003, ""), (1005, "solo")]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in with_neighbours(documents(rows)).select(
        "doc_id", "n_chars", "edited", likeness(F.col("entries"), F.col("next_entries")).alias("near"), "entries").collect()}
    order = sorted(rows)
    for at, (ident, text) in enumerate(order):
        text, following = text or "", order[(at + 1) % len(order)][1] or ""
        cut = len(text) // 4
        assert got[ident].n_chars == len(text)
        assert got[ident].edited == text[: len(text) - cut] + following[:cut]
        assert len(got[ident].entries) == ENTRIES and 0 <= got[ident].near <= 1


def test_odd_ids(spark, documents):
    one = with_neighbours(documents([(5, "a b c d e f g h")])).collect()
    assert [r.edited for r in one] == ["a b c d e f " + "a b"]
    rows = [(1, "aaaa bbbb"), (1, "aaaa bbbb"), (2, "cccc dddd"), (None, "eeee ffff"), (None, None)]
    got = with_neighbours(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.edited) for r in got) == sorted([
        ("1", "aaaa bbcc"), ("1", "aaaa bbcc"), ("2", "cccc ddaa"), ("None", "eeee ff"), ("None", "")])
    assert with_neighbours(documents([])).count() == 0
    ids = spark.createDataFrame([(i,) for i in (3, 9, 27, -4)], "id long")
    assert dict(map(tuple, next_ids(ids).collect())) == {-4: 3, 3: 9, 9: 27, 27: -4}


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.e for r in with_fingerprint(df, "t", "e").orderBy("i").collect()]


def share(a, b):
    return sum(x == y for x, y in zip(a, b)) / len(a)


def test_likeness_follows_edits_order_and_repeats(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    moved = words[150:] + words[:150]
    blocks = [words[i : i + 6] for i in range(0, 300, 6)]
    rng.shuffle(blocks)
    shuffled = [w for b in blocks for w in b]
    changed = [w if rng.random() > 0.05 else w + "x" for w in words]
    other = [f"v{i}" for i in range(300)]
    same, again, near, far, scrambled, half, thrice, twice = prints(spark, [" ".join(x) for x in (
        words, words, changed, other, shuffled, moved, ["a", "b"] * 30, ["a", "b"] * 20)])
    assert same == again and share(same, far) == 0
    assert share(same, near) > 0.35
    # All but a few 2-mers of the shuffled text are the same; only their order differs.
    assert 0.2 < share(same, scrambled) < share(same, near)
    assert share(same, half) < 0.9
    assert 0 < share(thrice, twice) < 1


def test_short_texts(spark):
    null, empty, one, other, pair = prints(spark, [None, "", "x", "y", "x y"])
    assert null == empty == [0] * ENTRIES
    assert len(set(one)) == 1 and one != other != pair
