"""Labelled samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.operators import encode as en
from flowmill.operators import evaluate as ev
from flowmill.operators import flows as fl
from flowmill.operators import model
from flowmill.operators import splits as sp
from flowmill.plans.flow_plans import sequences
from flowmill.plans.oracle import define
from flowmill.plans.packet_plans import kept
from flowmill.plans.registry import query
from flowmill.session import save_and_reload, shared_folder
from flowmill.sources import tables

MIN, CAP = sp.MIN_PER_CLASS, 500

define("scanned", "select flow_key, label as label_name, capture, n_payload from flow_list", "flow_list")
define("samples", "select * from scanned where n_payload >= 5", "scanned")
define("counts", f"select label_name, cast(count(*) as bigint) n from samples group by 1 having count(*) >= {MIN}", "samples")
define("label_map", "select label_name, cast(row_number() over (order by label_name) - 1 as int) as label from counts", "counts")
define("sampled", f"""
  select * from (select *, row_number() over (partition by label_name
                   order by md5(concat_ws('|', 42, 'sample', flow_key))) - 1 as rank,
                 count(*) over (partition by label_name) total from samples)
  where rank < {CAP}
""", "samples")
define("split_rows", f"""
  select flow_key, label_name, case when rank < floor(least(total, {CAP}) * 0.8e0) then 'train'
           when rank < floor(least(total, {CAP}) * 0.8e0) + floor(least(total, {CAP}) * 0.1e0) then 'val'
           else 'test' end split
  from sampled
""", "sampled")


def scanned(spark, sf_dir):
    flows = fl.flow_table(kept(spark, sf_dir))
    return flows.select("flow_key", F.col("label").alias("label_name"), "capture", "n_payload")


def samples(spark, sf_dir):
    return scanned(spark, sf_dir).filter(F.col("n_payload") >= 5)


@query("label_counts", "select * from counts", "counts")
def label_counts(spark, sf_dir):
    return sp.label_counts(samples(spark, sf_dir), MIN)


@query("label_ids", "select * from label_map", "label_map")
def label_ids(spark, sf_dir):
    return sp.label_ids(label_counts(spark, sf_dir))


@query("label_map_io", "select * from label_map", "label_map")
def label_map_io(spark, sf_dir):
    path = shared_folder(spark, "labels")
    tables.write_label_map(label_ids(spark, sf_dir), path)
    return tables.read_label_map(spark, path)


@query("attach_label_id", """
  select flow_key, label_name, m.label from samples join label_map m using (label_name)
""", "samples", "label_map")
def attach_label_id(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return sp.attach_label_id(rows, label_ids(spark, sf_dir)).select("flow_key", "label_name", "label")


@query("cap_per_class", "select flow_key, label_name from sampled", "sampled")
def cap_per_class(spark, sf_dir):
    return sp.cap_per_class(samples(spark, sf_dir), CAP).select("flow_key", "label_name")


@query("stratified_split", "select flow_key, label_name, split from split_rows", "split_rows")
def stratified_split(spark, sf_dir):
    return sp.stratified_split(samples(spark, sf_dir), cap=CAP).select("flow_key", "label_name", "split")


@query("union_parts", """
  select split, label_name, cast(count(*) as bigint) n from split_rows group by all
""", "split_rows")
def union_parts(spark, sf_dir):
    rows = stratified_split(spark, sf_dir)
    parts = [rows.filter(F.col("split") == s) for s in ("train", "val", "test")]
    return sp.union_parts(*parts).groupBy("split", "label_name").agg(F.count(F.lit(1)).alias("n"))


define("fit_part", "select * from samples where capture < 2 and label_name <> 'svc3'", "samples")
define("held_part", "select * from samples where capture = 2", "samples")
define("fit_map", """
  select label_name, cast(row_number() over (order by label_name) - 1 as int) as label
  from fit_part group by label_name having count(*) >= 10
""", "fit_part")


def fit_and_held(spark, sf_dir):
    rows = samples(spark, sf_dir)
    fit = rows.filter((F.col("capture") < 2) & (F.col("label_name") != "svc3"))
    return fit, rows.filter(F.col("capture") == 2)


@query("split_with_test_dir", f"""
  select flow_key, label, case when rank < floor(least(total, {CAP}) * (0.8e0 / (0.8e0 + 0.1e0)))
                               then 'train' else 'val' end split
  from (select *, row_number() over (partition by label_name order by md5(concat_ws('|', 42, 'sample', flow_key))) - 1 as rank,
               count(*) over (partition by label_name) total
        from fit_part join fit_map using (label_name))
  where rank < {CAP}
  union all
  select flow_key, label, 'test' from held_part join fit_map using (label_name)
""", "fit_part", "held_part", "fit_map")
def split_with_test_dir(spark, sf_dir):
    fit, held = fit_and_held(spark, sf_dir)
    return sp.split_with_test(fit, held, cap=CAP).select("flow_key", "label", "split")


@query("unseen_test_labels", """
  select label_name, cast(count(*) as bigint) n from held_part
  where label_name not in (select label_name from fit_map) group by 1
""", "held_part", "fit_map")
def unseen_test_labels(spark, sf_dir):
    fit, held = fit_and_held(spark, sf_dir)
    return sp.unseen_labels(held, sp.label_ids(sp.label_counts(fit)))


@query("label_difference", """
  select 'unknown' side, label_name from (select label_name from held_part except select label_name from fit_part)
  union all
  select 'missing', label_name from (select label_name from fit_part except select label_name from held_part)
""", "held_part", "fit_part")
def label_difference(spark, sf_dir):
    fit, held = fit_and_held(spark, sf_dir)
    unknown = sp.label_difference(held, fit).withColumn("side", F.lit("unknown"))
    return unknown.unionByName(sp.label_difference(fit, held).withColumn("side", F.lit("missing")))


@query("external_test", """
  select flow_key, label_name, m.label from held_part join label_map m using (label_name)
""", "held_part", "label_map")
def external_test(spark, sf_dir):
    # Flows are found once: the map, the labels seen and the test set are all read from the stored table.
    flows = save_and_reload(scanned(spark, sf_dir), "flows")
    rows = flows.filter(F.col("n_payload") >= 5)
    path = shared_folder(spark, "labels")
    tables.write_label_map(sp.label_ids(sp.label_counts(rows, MIN)), path)
    held, seen = (part.filter(F.col("capture") == 2) for part in (rows, flows))
    return sp.external_test(seen, held, tables.read_label_map(spark, path)).select("flow_key", "label_name", "label")


@query("extraction_report", """
  select label_name, cast(count(*) as bigint) scanned, cast(count(*) filter (n_payload > 0) as bigint) processed,
         cast(count(*) filter (n_payload = 0) as bigint) failed
  from scanned group by 1
""", "scanned")
def extraction_report(spark, sf_dir):
    rows = scanned(spark, sf_dir)
    return sp.extraction_report(rows, rows.filter(F.col("n_payload") > 0))


define("few", """
  select * from (select *, row_number() over (partition by label_name order by md5(concat_ws('|', 42, 'few', flow_key))) - 1 as rank,
                        count(*) over (partition by label_name) total from samples)
  where rank < least(total, greatest(1, floor(total * 0.1e0)))
""", "samples")


@query("few_shot", "select flow_key, label_name from few", "few")
def few_shot(spark, sf_dir):
    return sp.few_shot(samples(spark, sf_dir), 0.1).select("flow_key", "label_name")


@query("few_shot_report", """
  select cast(b as bigint) as before, cast(a as bigint) as after, round(a / greatest(b, 1) * 100, 1) percent
  from (select (select count(*) from samples) b, (select count(*) from few) a)
""", "samples", "few")
def few_shot_report(spark, sf_dir):
    rows = save_and_reload(samples(spark, sf_dir), "samples")
    return sp.few_shot_report(rows, sp.few_shot(rows, 0.1))


@query("baseline_flow_classifier")
def baseline_flow_classifier(spark, sf_dir):
    encoded = en.paired_instance(sequences(spark, sf_dir)).withColumnRenamed("label", "label_name")
    # Stored once and without the token lists, which are many times as long as their histograms.
    rows = save_and_reload(model.features(encoded).select("flow_key", "label_name", "features"), "histograms")
    labels = sp.label_ids(sp.label_counts(rows))
    ready = sp.stratified_split(sp.attach_label_id(rows, labels))
    stored = save_and_reload(ready.select("flow_key", "features", "label", "split"), "features")
    _, predictions = model.baseline_flow_classifier(stored)
    return ev.overall_metrics(ev.confusion_matrix(predictions))
