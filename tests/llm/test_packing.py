"""Token ids against the library, bins against their bounds, rows gapless and whole."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowmill.llm import tokens
from flowmill.llm.packing import pack_documents, plan_bins
from flowmill.llm.words import slices

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "   ", "a<|endoftext|>b <|ENDOFTEXT|> x", "It's ÀÉ İx q z é a", "Tab\tand\nline  two", "<|startoftext|> a<| b |>"]


def check(rows, got, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for ident, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want[ident, piece, at, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), sum(r.length for r in got)


def test_documents(spark, documents):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta,", "xyzzy", "42", "ñandú"]) for _ in range(rng.randrange(1, 90)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(5000, "long " * 1000), (None, "no id"), (7, "again"), (7, "again")]
    got = pack_documents(documents(rows).withColumn("length", F.lit(5)).withColumn("piece", F.lit("x")), PATH, capacity=128).collect()
    bins, tokens = check(rows, got, 128)
    assert bins <= 1.02 * tokens / 128 + 2
    assert pack_documents(documents([]), PATH).count() == 0


def test_plan_is_whole_and_tight():
    rng = random.Random(4)
    for _ in range(40):
        capacity = rng.choice([7, 64, 4096])
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 50) for _ in range(rng.randrange(1, 60))}
        got, bins = Counter(), 0
        for n, uses in plan_bins(counts, capacity):
            assert n >= 1 and sum(a * b for a, b in uses) <= capacity
            bins += n
            for length, each in uses:
                got[length] += n * each
        assert got == Counter(counts)
        large = sum(v for k, v in counts.items() if 2 * k > capacity)
        assert bins <= 1.23 * max(large, sum(k * v for k, v in counts.items()) / capacity) + 2
    assert plan_bins({}, 10) == []


def test_two_documents_replace_the_smallest():
    # Greedy 6 + 3 leaves a gap of 1; 2 + 2 in place of 3 fills it.
    assert plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [(6, 1), (2, 2)])


def test_frequent_words_stay_known(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 60)
    asked = Counter()

    def encode(words):
        asked.update(words)
        found = [[len(w), *w.encode()] for w in words]
        return np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found])

    known = tokens.WordIds(encode)
    frequent = [f"often{i}" for i in range(20)]
    for turn in range(12):
        texts = [" ".join([*frequent, *(f"rare{turn}x{i}" for i in range(30))]), "", "often3 often3"]
        for part in slices(pa.array(texts)):
            ids, bounds = known.texts(part)
            for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
                assert ids[a:b].tolist() == [i for w in text.split() for i in (len(w), *w.encode())]
    assert max(asked.values()) == 1 and len(known.starts) <= 110
    monkeypatch.setattr(tokens, "MAX_IDS", 10)
    for part in slices(pa.array(["long" * 50 + " often3"])):
        assert known.texts(part)[0].tolist()[:1] == [200]
