"""Splits, evaluation, corpora, text and vocabularies on small cases."""

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowmill.functions.ranking import running_before, with_rank
from flowmill.functions.rng import uniform
from flowmill.operators import contrastive as co
from flowmill.operators import encode as en
from flowmill.operators import evaluate as ev
from flowmill.operators import masking as ma
from flowmill.operators import pairing
from flowmill.operators import splits as sp
from flowmill.operators import text as tx
from flowmill.plans import encode_plans, text_plans
from flowmill.session import shared_folder
from flowmill.sources import corpus, tables
from flowmill.sources.lines import numbered_lines, record_lines


def samples(spark, sizes):
    rows = [(f"{k}-{i}", k) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "flow_key string, label_name string").repartition(4)


def test_split_is_complete_and_disjoint(spark):
    df = samples(spark, {"a": 700, "b": 37, "c": 10})
    rows = sp.stratified_split(df).collect()
    assert len({r.flow_key for r in rows}) == len(rows) == 500 + 37 + 10
    count = lambda k, s: sum(r.label_name == k and r.split == s for r in rows)
    for k, n in (("a", 500), ("b", 37), ("c", 10)):
        train, val = int(n * 0.8), int(n * 0.1)
        assert [count(k, s) for s in ("train", "val", "test")] == [train, val, n - train - val]
    assert sorted(rows) == sorted(sp.stratified_split(df.repartition(1)).collect())


def test_rare_labels_are_dropped_before_ids_are_given(spark):
    df = samples(spark, {"c": 10, "b": 9, "a": 11, "d": 300})
    counts = sp.label_counts(df)
    assert {(r.label_name, r.n) for r in counts.collect()} == {("a", 11), ("c", 10), ("d", 300)}
    assert {(r.label_name, r.label) for r in sp.label_ids(counts).collect()} == {("a", 0), ("c", 1), ("d", 2)}


@pytest.mark.parametrize("ratio", [0.001, 0.05, 0.5, 1.0])
def test_few_shot(spark, ratio):
    sizes = {"a": 211, "b": 19, "c": 1}
    df = samples(spark, sizes)
    got = {r.label_name: r["count"] for r in sp.few_shot(df, ratio).groupBy("label_name").count().collect()}
    assert got == {k: min(n, max(1, int(n * ratio))) for k, n in sizes.items()}


@pytest.mark.parametrize("rows, text", [
    ([], "empty"), ([("a", 0), ("b", 2)], "from 0 to 1"), ([("a", 0), ("b", 0)], "unique"),
    ([("a", 1), ("b", 2)], "from 0"), ([(None, 0)], "names"), ([("a", 0), ("a", 1)], "names"),
])
def test_bad_label_maps(spark, rows, text):
    with pytest.raises(ValueError, match=text):
        sp.check_label_map(spark.createDataFrame(rows, "label_name string, label int"))


def test_external_test_errors(spark):
    labels = spark.createDataFrame([("a", 0)], "label_name string, label int")
    known, unknown = samples(spark, {"a": 3}), samples(spark, {"a": 3, "z": 2})
    none = known.limit(0)
    assert sp.external_test(known, known, labels).count() == 3
    for args, text in (((unknown, known), "absent"), ((none, none), "no captures"), ((known, none), "processed")):
        with pytest.raises(ValueError, match=text):
            sp.external_test(*args, labels)


def test_metrics_by_hand(spark):
    truth = [0, 0, 0, 1, 1, 2]
    guess = [0, 0, 1, 1, 3, 0]
    df = spark.createDataFrame(list(zip(truth, guess)), "y_true int, y_pred int")
    m = ev.overall_metrics(ev.confusion_matrix(df)).first()
    p, r = [2 / 3, 1 / 2, 0, 0], [2 / 3, 1 / 2, 0, 0]
    assert (m.correct, m.total, m.accuracy) == (3, 6, 0.5)
    assert m.macro_precision == pytest.approx(sum(p) / 4) and m.macro_recall == pytest.approx(sum(r) / 4)
    assert m.micro_f1 == m.micro_precision == m.micro_recall == 0.5
    assert m.weighted_recall == pytest.approx((2 / 3 * 3 + 1 / 2 * 2) / 6)
    rows = ev.per_class_metrics(ev.confusion_matrix(df)).collect()
    assert [r.label for r in rows] == [2, 1, 0] and rows[0].support == 1
    assert len(ev.per_class_metrics(ev.confusion_matrix(df), keep_unsupported=True).collect()) == 4


def test_errors_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1, 0.75), (2, 1, 1, 0.9), (3, 5, 0, 0.25)], "sample_id bigint, y_true int, y_pred int, confidence double")
    names = spark.createDataFrame([(0, "zero"), (1, "one")], "label int, label_name string")
    errors = ev.misclassified(df, names)
    assert [r.sample_index for r in ev.misclassified_topk(errors, 1).collect()] == [3]
    assert [r.sample_index for r in ev.misclassified_topk(errors, 0).collect()] == [3, 1]
    assert tables.write_errors_csv(errors, str(tmp_path / "e"))
    lines = sorted(line for f in (tmp_path / "e").glob("*.csv") for line in f.read_text().splitlines())
    assert "1,0,zero,1,one,0.750000" in lines and "3,5,5,0,zero,0.250000" in lines
    assert ",".join(tables.ERROR_COLUMNS) in lines
    assert not tables.write_errors_csv(errors.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_argmax_takes_the_first_maximum(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([900.0, -900.0, 0.0],)], "logits array<double>")
    assert [(r.y_pred, round(r.confidence, 4)) for r in ev.predict_argmax(df).collect()] == [(1, 0.4683), (0, 1.0)]


RAW = """||
6
1 45 00
-1 ff

nospace
x 0a 0b
||
oops
1 01
||
17
||
17
-1 02
"""


def test_read_raw_corpus(spark, tmp_path):
    (tmp_path / "raw.txt").write_text(RAW)
    rows = sorted((r.protocol, [(p.direction, list(p.tokens)) for p in r.packets]) for r in corpus.read_raw_corpus(spark, str(tmp_path / "raw.txt")).collect())
    assert rows == [
        (0, [(1, ["01"])]),
        (0, [(1, ["45", "00"]), (-1, ["ff"]), (1, ["0a", "0b"])]),
        (1, [(-1, ["02"])]),
    ]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        corpus.read_raw_corpus(spark, str(tmp_path / "raw.txt"), strict=True).collect()
    counts = corpus.corpus_counts(spark, str(tmp_path / "raw.txt")).first()
    assert (counts.flows, counts.lines) == (4, RAW.count("\n"))


def test_read_size_corpus(spark, tmp_path):
    (tmp_path / "size.txt").write_text("||\n6\n1600 1400 \n\n2 500\n||\n17\n1501\n||\nx\n1 2\n3 4\n")
    rows = sorted((r.protocol, list(r.size_tokens), list(r.iat_tokens)) for r in corpus.read_size_corpus(spark, str(tmp_path / "size.txt")).collect())
    assert rows == [(0, [1, 2], [3, 4]), (0, [1600, 1400], [2, 500])]


@pytest.fixture
def small_splits(spark):
    """Files are read in pieces of a few hundred bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "500")
    yield
    spark.conf.set(name, before)


def test_foreign_corpora_pair_by_ordinal(spark, tmp_path, small_splits):
    n = 300
    (tmp_path / "raw.txt").write_text("junk\n" + "".join(f" || \r\n6\r\n1 {i % 256:02x} a||b\r\n\r\n" for i in range(n)), newline="")
    (tmp_path / "size.txt").write_text("".join(f"||\n{6 if i else 17}\n{1500 + i}\n{'' if i % 50 == 3 else 7}\n" for i in range(n - 5)))
    paths = str(tmp_path / "raw.txt"), str(tmp_path / "size.txt")
    rows = pairing.pair_corpora(spark, *paths).orderBy("record").collect()
    assert [r.record for r in rows] == [i for i in range(n - 5) if i % 50 != 3]
    for r in rows:
        assert [(p.direction, p.tokens) for p in r.packets] == [(1, [f"{r.record % 256:02x}", "a||b"])]
        assert (r.protocol, r.size_protocol) == (0, int(r.record == 0))
        assert (r.size_tokens, r.iat_tokens) == ([1500 + r.record], [7])
    assert tuple(pairing.pairing_audit(spark, *paths).first()) == (n, n - 5, n - 5, 1, 6)


def test_records_over_many_splits(spark, tmp_path, small_splits):
    """Records longer than a split, several files, a separator as the last line: against a plain reader."""
    rng = np.random.default_rng(4)
    files = []
    for name in ("a.txt", "b.txt", "c.txt"):
        lines = []
        for _ in range(12):
            lines += ["||"] * int(rng.integers(1, 3)) + [f"{i} " + "x" * int(rng.integers(30)) for i in range(int(rng.choice([0, 1, 5, 200])))]
        files.append(["early", *lines] if name == "a.txt" else lines)
        (tmp_path / name).write_text("\n".join(files[-1]) + "\n")
    expected, record, at = [], -1, 0
    for line in sum(files, []):
        record, at = (record + 1, 0) if line == "||" else (record, at + 1)
        if record >= 0:
            expected.append((record, at, line.strip()))
    got = sorted(tuple(r) for r in record_lines(spark, str(tmp_path), "||").select("record", "at", "value").collect())
    assert got == expected
    numbered = sorted(tuple(r) for r in numbered_lines(spark, str(tmp_path)).collect())
    assert numbered == list(enumerate(sum(files, [])))


def test_a_record_of_many_packets_is_read_in_rows(spark, tmp_path, small_splits):
    n = 3000
    (tmp_path / "raw.txt").write_text("||\n6\n" + "".join(f"{1 - 2 * (i % 2)} {i:x} 00\n" for i in range(n)) + "||\n17\n1 ff\n")
    packets = corpus.read_raw_packets(spark, str(tmp_path / "raw.txt"))
    rows = [tuple(r) for r in packets.orderBy("record", "at").collect()]
    assert rows == [(0, i + 2, 1 - 2 * (i % 2), [f"{i:x}", "00"]) for i in range(n)] + [(1, 2, 1, ["ff"])]
    plan = packets._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # nothing gathers a record


def test_running_totals_equal_a_plain_scan(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(rng.integers(-5, 6)), None if rng.random() < 0.5 else int(rng.integers(1000))) for k in rng.permutation(500)]
    frame = spark.createDataFrame(rows, "k int, n int, m int").repartition(7)
    got = running_before(frame, ["k"], {"before": "n"}, {"top": F.col("m") + F.col("before") * 0})
    total, top = 0, None
    for r, (k, n, m) in zip(got.orderBy("k").collect(), sorted(rows)):
        assert (r.k, r.before, r.top) == (k, total, top)
        total += n
        top = m if top is None else top if m is None else max(top, m)
    assert running_before(frame.limit(0), ["k"], {"before": "n"}).collect() == []


def test_vocabulary_written_by_many_tasks(spark, tmp_path, small_splits):
    rows = [(f"t{i % 900}", i) for i in range(1000)]
    tables.write_vocab(spark.createDataFrame(rows, "token string, id bigint").repartition(5), str(tmp_path / "v"))
    assert len([f for f in os.listdir(tmp_path / "v") if f.startswith("part-")]) > 1
    got = {r.token: r.id for r in tables.read_vocab(spark, str(tmp_path / "v")).collect()}
    assert got == dict(rows)


def test_vocab_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("[PAD]\n[UNK] 5\nab\ncd\nab\n")
    vocab = {r.token: r.id for r in tables.read_vocab(spark, str(tmp_path / "v.txt")).collect()}
    assert vocab == {"[PAD]": 0, "[UNK]": 1, "ab": 4, "cd": 3}


ODD = [
    "Été naïve coöp\tTab\nline\r x​y\u0000z�",
    "中文abc字 𠀀x é ﬁ ≠ ;", "a.b,c!d—e¿f$g^h`i|j~k", "", "   ", "x" * 201 + " ok", "İstanbul ΑΣ ß",
    "line sep\u0085next",
]


def clean_model(text):
    out = []
    for c in text:
        if c in "\t\n\r" or unicodedata.category(c) == "Zs":
            out.append(" ")
        elif c != "�" and unicodedata.category(c) not in ("Cc", "Cf"):
            out.append(c)
    return "".join(out)


def test_odd_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "k int, text string").repartition(2)
    got = {r.k: r for r in df.select("k", tx.clean_text(F.col("text")).alias("c"), tx.basic_tokens(F.col("text")).alias("b")).collect()}
    for i, text in enumerate(ODD):
        assert got[i].c == clean_model(text)
    assert list(got[0].b) == ["ete", "naive", "coop", "tab", "line", "xyz"]
    assert list(got[1].b) == ["中", "文", "abc", "字", "𠀀", "x", "e", "ﬁ", "=", ";"]
    assert list(got[2].b) == ["a", ".", "b", ",", "c", "!", "d", "—", "e", "¿", "f", "$", "g", "^", "h", "`", "i", "|", "j", "~", "k"]
    assert list(got[3].b) == list(got[4].b) == []
    assert list(got[6].b) == ["istanbul", "ας", "ß"]
    assert list(got[7].b) == ["line", "sepnext"]


def test_wordpiece(spark):
    vocab = spark.createDataFrame(
        [(t, i) for i, t in enumerate("[PAD] [UNK] un ##aff ##able ##a runn ##ing , x".split())], "token string, id int"
    )
    lookup = tx.vocab_lookup(vocab)
    df = spark.createDataFrame([(0, "Unaffable, running unaffx " + "x" * 201), (1, "")], "k int, text string")
    encoded = tx.encode_documents(df, lookup)
    ids = {r.k: list(r.ids) for r in encoded.collect()}
    assert ids == {0: [2, 3, 4, 8, 6, 7, 1, 1], 1: []}
    more = encoded.select("k", "ids").union(spark.createDataFrame([(2, [3, 99])], "k int, ids array<int>"))
    back = {r.k: r.tokens for r in tx.decode_ids(more, vocab, "k").collect()}
    assert back == {0: "un ##aff ##able , runn ##ing [UNK] [UNK]".split(), 1: [], 2: ["##aff", None]}


@pytest.mark.parametrize("most_bytes", [tx.MAX_VOCAB_BYTES, 10])
def test_ids_and_back(spark, most_bytes):
    vocab = spark.createDataFrame([("a", 5), ("b", 6), ("b", 9), ("c", 7), ("z", 7)], "token string, id int")
    lists = [["a", "x", "b"], ["c", None, "a", "a"], [], None, ["x"], ["b"] * 50]
    rows = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(lists)], "k int, tokens array<string>, id int").repartition(3)
    table = {"a": 5, "b": 9, "c": 7, "z": 7}
    for skip in (True, False):
        got = tx.token_to_id(rows, vocab, "k", skip_unknown=skip, most_bytes=most_bytes).collect()
        want = [(i // 2, [table.get(w, 1) for w in t or [] if w in table or not skip]) for i, t in enumerate(lists)]
        assert sorted((r.k, list(r.ids)) for r in got) == sorted(want)
    ids = [[5, 99, 7], [None, 9], [], None]
    coded = spark.createDataFrame(list(enumerate(ids)), "k int, ids array<int>")
    back = {r.k: list(r.tokens) for r in tx.decode_ids(coded, vocab, "k", most_bytes=most_bytes).collect()}
    assert back == {0: ["a", None, "c"], 1: [None, "b"], 2: [], 3: []}


def test_lookup_has_no_shuffle(spark):
    vocab = spark.createDataFrame([("a", 5)], "token string, id int")
    rows = spark.createDataFrame([(1, ["a"])], "k int, tokens array<string>")
    plan = tx.token_to_id(rows, vocab, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_vocabulary_order(spark):
    docs = spark.createDataFrame([(0, ["b", "a", "b"]), (1, ["c", "a", "d", "[UNK]"])], "doc_id bigint, tokens array<string>")
    vocab = tx.word_count_vocab(tx.token_counts(docs, "doc_id"), 1).collect()
    order = [r.token for r in sorted(vocab, key=lambda r: r.id)]
    assert order == [*tx.RESERVED_TOKENS, "b", "a", "c", "d"] and [r.id for r in sorted(vocab, key=lambda r: r.id)] == list(range(9))
    assert tx.word_count_vocab(tx.token_counts(docs, "doc_id"), 2).count() == 7


def test_corpus_counts_equal_counts_of_tokens(spark):
    texts = ["B-a b, a-b!", "c: a-a é É", "!!! b"] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    tokens = docs.select("doc_id", tx.basic_tokens(F.col("text")).alias("tokens"))
    slow = tx.word_count_vocab(tx.token_counts(tokens, "doc_id")).collect()
    fast = tx.word_count_vocab(tx.corpus_token_counts(docs, "doc_id")).collect()
    assert sorted(map(tuple, slow)) == sorted(map(tuple, fast))


def test_hard_negatives(spark):
    rows = [(i, i // 4, [1.0, i / 10], [i / 5, 1.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "id bigint, batch_id bigint, raw array<double>, size array<double>")
    unit = df.withColumns({c: co.normalize(F.col(c)) for c in ("raw", "size")})
    negatives = co.hard_negative_sampling(co.batch_similarity(unit)).collect()
    for r in negatives[:]:
        if r.id == 8:  # alone in its batch: nothing to draw
            assert r.neg_size is None and r.neg_raw is None
        else:
            assert r.neg_size != r.id and r.neg_size // 4 == r.id // 4 == r.neg_raw // 4
    pairs = co.matching_pairs(spark.createDataFrame(negatives, "batch_id bigint, id bigint, neg_size bigint, neg_raw bigint"))
    assert pairs.filter("match = 1").count() == 9 and pairs.filter("match = 0").count() == 16


def test_soft_labels(spark):
    row = spark.range(1).select(co.gaussian_soft_labels(F.lit(50), 100).alias("w")).first()
    assert sum(row.w) == pytest.approx(1) and row.w[:5] == [0.0] * 5 and max(row.w) == row.w[50]


def test_uniform_draws(spark):
    rows = spark.range(4000).select(uniform(1, "x", F.col("id")).alias("u")).collect()
    values = [r.u for r in rows]
    assert 0 <= min(values) and max(values) < 1 and abs(sum(values) / 4000 - 0.5) < 0.02


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_large_and_text_ids_keep_their_order(spark):
    for ids, kind in (([1 << 40, 0, 5], "bigint"), (["b", "a", "c"], "string")):
        docs = spark.createDataFrame([(ids[0], ["x", "y"]), (ids[1], ["y", "z", "x"]), (ids[2], ["w"])], f"i {kind}, tokens array<string>")
        vocab = tx.word_count_vocab(tx.token_counts(docs, "i"))
        order = [r.token for r in vocab.orderBy("id").collect() if r.n > 0]
        assert order == ["y", "x", "z", "w"]


def test_all_unknown_labels_are_named(spark):
    labels = spark.createDataFrame([("a", 0)], "label_name string, label int")
    rows = spark.createDataFrame([(f"k{i}", f"u{i:02d}") for i in range(25)], "flow_key string, label_name string")
    with pytest.raises(ValueError, match="u00.*u24"):
        sp.external_test(rows, rows, labels)


def test_corpora_with_crlf_padding_and_odd_tokens(spark, tmp_path):
    raw = tmp_path / "raw.txt"
    raw.write_bytes(b"early\n||\r\n6\r\n1 45 zz 4500\r\n-1 0a\r\n||\r\n17\n1 ff\n  || \n6\n1 00\n")  # no record before the first ||
    flows = corpus.read_raw_corpus(spark, str(raw))
    assert corpus.corpus_counts(spark, str(raw)).first().flows == flows.count() == 3
    ids = [list(r.ids) for r in flows.select(en.raw_ids(F.col("packets")).alias("ids")).collect()]
    assert sorted(ids) == [[5], [5 + 0x45, 1, 1, 15], [260]]
    size = tmp_path / "size.txt"
    size.write_bytes(b"||\r\n6\r\n10 x -3\r\n0 5 bad\r\n||\r\n17\n7\n0\n||\n")
    rows = corpus.read_size_corpus(spark, str(size))
    found = sorted(rows.collect(), key=lambda r: r.protocol)
    assert [(r.protocol, list(r.size_tokens), list(r.iat_tokens)) for r in found] == [
        (0, [10, None, -3], [0, 5, None]), (1, [7], [0])]
    framed = en.encode_size_iat(rows, 6).collect()
    assert framed[0].src_size[2] == framed[0].src_iat[3] == 1


def test_batches_of_two_shards_stay_apart(spark):
    rows = [(s, 0, 10 * s + i, [1.0, float(i)], [1.0, 0.0]) for s in (0, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "shard int, batch_id int, id int, raw array<double>, size array<double>")
    got = co.batch_similarity(df)
    assert {(r.shard, tuple(r.ids)) for r in got.collect()} == {(0, (0, 1, 2)), (1, (10, 11, 12))}
    assert co.infonce_loss(got).count() == 2


def test_errors_are_written_most_confident_first(spark, tmp_path):
    rows = [(i, 0, "a", 1, "b", (i * 37 % 50) / 50) for i in range(50)]
    names = "sample_index int, true_label_id int, true_label_name string, pred_label_id int, pred_label_name string, confidence double"
    assert tables.write_errors_csv(spark.createDataFrame(rows, names).repartition(5), str(tmp_path / "e"))
    found = []
    for f in sorted((tmp_path / "e").glob("part-*.csv")):
        found += [float(x.split(",")[-1]) for x in f.read_text().splitlines()[1:]]
    assert found == sorted(found) and len(found) == 50


def test_pieces_do_not_hang_on_the_vocabulary_being_broadcast(spark):
    """Bound set to nothing: the joins give what the broadcast gives."""
    rng = np.random.default_rng(8)
    letters = list("abcé字")
    pieces = {"[UNK]": 7} | {p: 10 + i for i, p in enumerate(sorted(
        {("" if rng.random() < 0.4 else "##") + "".join(rng.choice(letters, int(rng.integers(1, 4)))) for _ in range(120)}))}
    vocab = spark.createDataFrame(list(pieces.items()), "token string, id int")
    words = sorted({"".join(rng.choice(letters, int(rng.integers(1, 9)))) for _ in range(300)}) + ["a" * 200, "a" * 201, "zz"]
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    near, far = ({r.token: (r.pieces, r.ids) for r in tx.split_tokens(tokens, vocab, most).collect()} for most in (1 << 30, 0))
    assert near == far and len(near) == len(words)
    assert any(len(p) > 2 for p, _ in near.values()) and near["zz"] == (["[UNK]"], [7])
    texts = [(i, " ".join(rng.choice(words, int(rng.integers(0, 40)))) + " A-b, É!") for i in range(50)] + [(60, ""), (61, None), (0, "abc a")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    near, far = (sorted((r.doc_id, r.text or "", r.ids) for r in tx.encode_documents(docs, vocab, most_bytes=most).collect())
                 for most in (1 << 30, 0))
    assert far == near and tx.vocab_lookup(vocab, 10) is None


def test_labels_without_a_test_flow_are_named(spark):
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "label_name string, label int")
    rows = spark.createDataFrame([("k", "b"), ("l", "b")], "flow_key string, label_name string")
    with pytest.warns(UserWarning, match=r"\['a', 'c'\]"):
        found = sp.external_test(rows, rows, labels)
    assert sorted((r.flow_key, r.label) for r in found.collect()) == [("k", 1), ("l", 1)]
    with pytest.raises(ValueError, match="no captures"):
        sp.external_test(rows.limit(0), rows, labels)


def test_split_without_a_cap_takes_all(spark):
    df = samples(spark, {"a": 700, "b": 37})
    rows = sp.stratified_split(df, cap=None).collect()
    assert len(rows) == 737 and sum(r.label_name == "a" and r.split == "train" for r in rows) == 560


def test_batches_of_words_are_worked_off_in_slices(spark, monkeypatch):
    texts = [None, [], ["ä", None, "b"], ["c"] * 9, ["d", "e"], [None], ["f"] * 5, ["b" * 300, "g"]]
    arrays = pa.array(texts, pa.list_(pa.string()))
    monkeypatch.setattr(tx, "SLICE_WORDS", 4)
    cuts = list(tx._slices(arrays))
    sizes = [sum(len(t or []) for t in texts[first:first + n]) for first, n in cuts]
    # No slice holds more words than allowed, unless it is one row; together they are the batch.
    assert [r for first, n in cuts for r in range(first, first + n)] == list(range(len(texts)))
    assert all(n == 1 or size <= 4 for (_, n), size in zip(cuts, sizes)) and len(cuts) > 3
    twice = lambda w: [] if w is None else [w, w]
    got = [x for first, n in cuts for x in tx._replaced(arrays.slice(first, n), twice, twice, pa.string()).to_pylist()]
    assert got == [[w for w in t or [] if w is not None for _ in (0, 1)] for t in texts]


def test_rows_keep_their_place_over_slices(spark):
    # More words than a slice holds, in one batch.
    rows = spark.range(0, 3000, 1, 1).withColumn("text", F.concat_ws(" ", F.col("id"), F.repeat(F.lit("É x "), 200 + F.col("id").cast("int") % 7)))
    got = rows.select("id", tx.lower_strip_accents(F.col("text")).alias("t")).select(
        "id", F.col("t")[0].alias("head"), F.size("t").alias("n"), F.col("t")[1].alias("e")).collect()
    assert len(got) == 3000 and all((r.head, r.n, r.e) == (str(r.id), 1 + 2 * (200 + r.id % 7), "e") for r in got)


def test_total_of_ranks_needs_no_pairwise_join(spark):
    rows = spark.range(100).withColumn("b", F.col("id") % 7)
    ranked = with_rank(rows, [], [F.col("id")], F.shiftright("id", 3), total="total")
    plan = ranked._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert sorted((r.rank, r.id, r.total) for r in ranked.collect()) == [(i, i, 100) for i in range(100)]


@pytest.mark.parametrize("residues", [4, tx.RESIDUES])
def test_joined_pieces_drop_what_is_no_entry_where_it_is_made(spark, monkeypatch, residues):
    monkeypatch.setattr(tx, "RESIDUES", residues)
    entries = {"[UNK]": 1, "a": 5, "ab": 6, "abc": 7, "##c": -3, "##cd": 2**31 - 1, "##d": 10, "##": 11, "é": -(2**31), "##üb": 0}
    words = ["a", "abcd", "abcdd", "abx", "x", "##cd", "éüb", "éü", "ab" * 100, "ab" + "c" * 198, "a" + "c" * 200]
    vocab = spark.createDataFrame([*entries.items(), ("a", 4)], "token string, id bigint")
    tokens = spark.createDataFrame([(w,) for w in words] + [("a",)], "token string").repartition(3)
    joined = tx.joined_pieces(tokens, vocab)
    got = joined.collect()
    assert len(got) == len(words) + 1
    names, ids = tx._Pieces({t: t for t in entries}, "[UNK]"), tx._Pieces(entries, 1)
    for r in got:
        assert (r.pieces, r.ids) == (names(r.token), ids(r.token))
    assert "LeftSemi" in joined._jdf.queryExecution().optimizedPlan().toString()
    empty = tx.joined_pieces(tokens, vocab.limit(0)).collect()
    assert len(empty) == len(got) and all((r.pieces, r.ids) == (["[UNK]"], [1]) for r in empty)


@pytest.mark.parametrize("name", ["wordpiece", "wordpiece_joined"])
def test_corpus_is_counted_once_for_pieces(spark, monkeypatch, name):
    calls = []
    counts = text_plans.counts
    monkeypatch.setattr(text_plans, "counts", lambda *a: calls.append(a) or counts(*a))
    assert getattr(text_plans, name)(spark, "/root/testdata/sf0.001").columns == ["token", "pieces"]
    assert len(calls) == 1


def test_variants_share_the_text_of_their_flow(spark):
    plan = encode_plans.clean_and_masked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate explode")
    assert below and above.count("array_join(") == len(ma.CLEAN_AND_MASKED) - len(encode_plans.PAIRED)
