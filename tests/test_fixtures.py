"""The packet view: no document is lost, whatever the ids."""

import duckdb
import pytest
from pyspark.sql import functions as F

from flowmill import fixtures
from flowmill.functions import ranking
from flowmill.plans import dataset_plans, oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("factor, most_events", [(1, None), (1_000_003, None), (-7, None), (5, 60)])
def test_every_byte_is_carried_once(spark, tmp_path, factor, most_events):
    con = duckdb.connect()
    con.sql(f"copy (select * replace (doc_id * {factor} as doc_id) from '{SF}/documents.parquet') to '{tmp_path}/documents.parquet'")
    con.sql(f"""copy (select * replace (event_id * {factor} + 3 as event_id) from '{SF}/events.parquet'
                order by event_id limit {most_events or 1 << 40}) to '{tmp_path}/events.parquet'""")
    for name in ("documents", "events"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    rows = fixtures.packets(spark, str(tmp_path)).select("seq", "label", F.lower(F.hex("payload")).alias("payload")).collect()
    expected = con.sql(oracle.sql("select seq, label, lower(payload_hex) from packets", "packets")).fetchall()
    assert sorted(map(tuple, rows)) == sorted(expected) and len(rows) == con.sql("select count(*) from events").fetchall()[0][0]
    n_bytes = con.sql("select sum(octet_length(encode(text))) from documents").fetchall()[0][0]
    assert sum(len(r.payload) // 2 for r in rows) == n_bytes


def small_tables(spark, folder, texts, n_events, user=lambda i: i % 2):
    rows = [(i, f"2024-01-{1 + i % 30:02d} 10:00:{i % 60:02d}", user(i), ("click", "view")[i % 3 > 0], '{"k": %d}' % (i % 4)) for i in range(n_events)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_lengths_and_heads_meet_events_without_the_payload(spark, tmp_path):
    folder = small_tables(spark, tmp_path, ["ab" * 500, None, "ü" * 90], 30)
    whole = {r.seq: (r.len, bytes(r.payload)) for r in fixtures.packets(spark, folder).collect()}
    assert sum(n for n, _ in whole.values()) == 1180 and all(n == len(p) for n, p in whole.values())
    sizes = fixtures.packets(spark, folder).select("seq", "len")
    # Before, the payload moved to the join and its length was taken behind it.
    assert "AS payload#" not in sizes._jdf.queryExecution().optimizedPlan().toString()
    assert {r.seq: r.len for r in sizes.collect()} == {s: n for s, (n, _) in whole.items()}
    heads = fixtures.packets(spark, folder, 16).collect()
    assert {r.seq: (r.len, bytes(r.payload)) for r in heads} == {s: (n, p[:16]) for s, (n, p) in whole.items()}


def test_reports_find_flows_once(spark, tmp_path, monkeypatch):
    # Two users, 240 packets a day cycle: every label has flows in every capture.
    folder = small_tables(spark, tmp_path, ["x" * 9000], 1200)
    calls, packets = [], fixtures.packets
    monkeypatch.setattr(fixtures, "packets", lambda *a, **k: calls.append(1) or packets(*a, **k))
    monkeypatch.setattr(dataset_plans, "MIN", 1)
    got = dataset_plans.external_test(spark, folder).collect()
    assert got and len(calls) == 1 and len({r.flow_key for r in got}) == len(got)
    report = dataset_plans.few_shot_report(spark, folder)
    assert "Generate" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert report.first().before >= len(got)


def test_classifier_stores_no_token_lists(spark, tmp_path, monkeypatch):
    folder = small_tables(spark, tmp_path, ["x" * 90000], 6000, lambda i: i // 120 % 25)
    stored, save = [], ranking.save_and_reload
    monkeypatch.setattr(ranking, "save_and_reload", lambda df, purpose: stored.append(df.columns) or save(df, purpose))
    row = dataset_plans.baseline_flow_classifier(spark, folder).first()
    # Before, ranks were found over rows with all token lists of a flow.
    assert stored and not any("src" in columns for columns in stored)
    assert row.total > 0
