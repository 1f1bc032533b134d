"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
# The smallest tables leave no sample to test on, which external_test must reject, and no class that is capped.
LARGER = dict.fromkeys((
    "external_test label_counts label_ids attach_label_id cap_per_class stratified_split union_parts split_with_test_dir"
    " unseen_test_labels label_difference few_shot few_shot_report split_report files_per_label").split(), "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: float(v) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark):
    folder = LARGER.get(name, SF)
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
    else:
        result = duck(folder).execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(df.columns) == sorted(names)
        assert canonical(rows, df.columns) == canonical(result.fetchall(), names)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert {"flow_key", "packets", "size_tokens", "iat_tokens"} <= set(df.columns)


NO_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", [
    "flow_sequences", "stratified_split", "clean_and_masked", "encode_documents",
    "hard_negative_sampling", "overall_metrics", "word_count_vocab",
])
def test_plans_have_no_pairwise_joins(name, spark):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in NO_PAIRS)
