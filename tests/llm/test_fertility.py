"""Counts against plain Python, bands against quartiles of the rows."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from flowmill.llm import fertility

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, model):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if twice[w] > 1:
            marked.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    ids = [i for w in words for i in model.encode(w)]
    counts = Counter(ids)
    entropy = -sum(c / len(ids) * np.log2(c / len(ids)) for c in counts.values()) if ids else 0.0
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(marked), len(ids), sum(model.is_byte(i) for i in ids), round(float(entropy), 9))


def test_counts(spark, documents):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "a\na\n\nb\na", "a b c d e f a b c d e", "x " * 30, "#*$%&|<> é ñ 𝒳 ☃", "a\r\nb\ra\n",
             "same line here\n" * 4, "\nend\n", "word " * 20_000]
    texts += ["\n".join(" ".join(rng.choices(["ab", "cd", "é", "x#", "42"], k=rng.randrange(0, 9))) for _ in range(12)) for _ in range(60)]
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = fertility.measured(documents(list(enumerate(texts))), PATH, keep=["doc_id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (*r[1:8], round(r.entropy, 9)) == plain(texts[r.doc_id], model)
    assert fertility.measured(documents([]), PATH).count() == 0


def test_verdicts(spark, documents):
    rng = random.Random(6)
    words = "the river stone house light water green walk over under little people".split()
    rows = [(i, " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(60)), "en" if i % 3 else None, "s") for i in range(400)]
    bad = [(1000, "☃☂☁☀ " * 6 + " ".join(chr(0x2500 + i) * 4 for i in range(60)), "en", "s"), (1001, "one two", "en", "s"),
           (1002, None, "en", "s"), (1003, "a b c d e " * 9, "xx", "s")]
    counts = fertility.measured(documents(rows + bad), PATH, keep=["doc_id", "lang"])
    got = {r.doc_id: r for r in fertility.judged(counts, least_docs=50).collect()}
    assert all(got[i].kept for i in range(400))
    assert not got[1000].base_failed and not got[1000].kept
    assert all(got[i].base_failed and not got[i].kept for i in (1001, 1002, 1003))
    assert fertility.judged(fertility.measured(documents([]), PATH, keep=["lang"])).count() == 0


def test_marked_up_words_are_rejected(spark, documents):
    rng = random.Random(7)
    words = "the river stone house light water green walk over under little people".split()
    text = lambda n, marks: "".join(rng.choice(words) + str(rng.randrange(900)) + rng.choice(marks) for _ in range(n))
    rows = [(i, text(rng.randrange(40, 1500), [" "]), "en", "s") for i in range(600)]
    rows += [(1000 + i, text(rng.randrange(200, 900), [" ", " | "]), "en", "s") for i in range(40)]
    got = fertility.judged(fertility.measured(documents(rows), PATH, keep=["doc_id", "lang"])).collect()
    assert not any(r.base_failed for r in got)
    assert sum(not r.kept for r in got if r.doc_id >= 1000) >= 36
    assert sum(not r.kept for r in got if r.doc_id < 1000) <= 6


def test_small_language_in_another_script(spark, documents):
    """Its documents are kept at any number, and verdicts do not turn where there is one more."""
    rng = random.Random(8)
    latin = "the river stone house light water green walk over under little people".split()
    other = "ποτάμι πέτρα σπίτι φως νερό πράσινο δρόμος κάτω μικρός άνθρωπος թագավոր գետ".split()
    text = lambda words: " ".join(rng.choice(words) + str(rng.randrange(900)) for _ in range(rng.randrange(40, 400)))
    rows = [(i, text(latin), "en", "s") for i in range(1500)] + [(9000, text(other), "zz", "s")]
    few = [(2000 + i, text(other), "el", "s") for i in range(200)]
    counts = fertility.measured(documents(rows + few), PATH, keep=["doc_id", "lang"]).toPandas()
    kept = {}
    for n in (3, 40, 199, 200):
        some = spark.createDataFrame(counts[(counts.doc_id < 2000 + n) | (counts.doc_id == 9000)])
        kept[n] = {r.doc_id for r in fertility.judged(some).filter("kept").collect()}
        assert 9000 in kept[n]
        assert sum(2000 <= i < 9000 for i in kept[n]) >= 0.97 * n
    assert kept[199] == kept[200] - {2199}
