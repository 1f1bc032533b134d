"""Predictions, metrics and in-batch contrastive tables over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill import fixtures as fx
from flowmill.operators import batches as ba
from flowmill.operators import contrastive as co
from flowmill.operators import evaluate as ev
from flowmill.operators import model
from flowmill.plans.oracle import define
from flowmill.plans.registry import query
from flowmill.session import shared_folder
from flowmill.sources import tables

# Scores of 64 classes: the dimensions of a vector.
define("logit_rows", """
  select vec_id sample_id, cast(label as int) y_true,
         list_transform(embedding, lambda x: cast(x as double) * 20e0) logits
  from embeddings
""")
define("predictions", """
  select sample_id, y_true, cast(list_position(logits, list_max(logits)) - 1 as int) y_pred,
         1e0 / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))) confidence
  from logit_rows
""", "logit_rows")
# Names for even ids only, so that unknown ids occur.
define("names", "select unnest([0, 2, 4, 6, 8]) as label, 'class ' || unnest([0, 2, 4, 6, 8]) label_name")
define("class_sums", """
  select label, sum(tp) tp, sum(actual) actual, sum(predicted) predicted from (
    select y_true as label, cast(y_true = y_pred as int) tp, 1 actual, 0 predicted from predictions
    union all select y_pred, 0, 0, 1 from predictions)
  group by label
""", "predictions")


def predictions(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("label").cast("int").alias("y_true"),
        F.transform("embedding", lambda x: x.cast("double") * 20.0).alias("logits"),
    )
    return ev.predict_argmax(rows)


def names(spark, sf_dir):
    """The even classes that occur, so that odd ids have no name."""
    ids = fx.table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label")).distinct()
    return ids.filter(F.col("label").bitwiseAND(F.lit(1)) == 0).select(
        "label", F.concat(F.lit("class "), F.col("label").cast("string")).alias("label_name")
    )


@query("predict_argmax", "select sample_id, y_true, y_pred, round(confidence, 6) confidence from predictions", "predictions")
def predict_argmax(spark, sf_dir):
    return predictions(spark, sf_dir).select("sample_id", "y_true", "y_pred", F.round("confidence", 6).alias("confidence"))


@query("confusion_matrix", "select y_true, y_pred, cast(count(*) as bigint) n from predictions group by all", "predictions")
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(predictions(spark, sf_dir))


OVERALL = [
    f"{kind}_{score}" for kind in ("macro", "micro", "weighted") for score in ("precision", "recall", "f1")
]


define("class_scores", """
  select *, coalesce(tp / nullif(predicted, 0), 0) p, coalesce(tp / nullif(actual, 0), 0) r,
         coalesce(2 * tp / nullif(predicted + actual, 0), 0) f
  from class_sums
""", "class_sums")


@query("overall_metrics", """
  select cast(sum(tp) as bigint) correct, cast(sum(actual) as bigint) total, round(sum(tp) / sum(actual), 6) accuracy,
         round(avg(p), 6) macro_precision, round(avg(r), 6) macro_recall, round(avg(f), 6) macro_f1,
         round(sum(tp) / sum(predicted), 6) micro_precision, round(sum(tp) / sum(actual), 6) micro_recall,
         round(2 * sum(tp) / (sum(predicted) + sum(actual)), 6) micro_f1,
         round(sum(p * actual) / sum(actual), 6) weighted_precision, round(sum(r * actual) / sum(actual), 6) weighted_recall,
         round(sum(f * actual) / sum(actual), 6) weighted_f1
  from class_scores
""", "class_scores")
def overall_metrics(spark, sf_dir):
    row = ev.overall_metrics(ev.confusion_matrix(predictions(spark, sf_dir)))
    return row.select("correct", "total", *[F.round(c, 6).alias(c) for c in ("accuracy", *OVERALL)])


@query("per_class_metrics", """
  select coalesce(n.label_name, cast(c.label as varchar)) label_name, round(p, 6) as precision, round(r, 6) recall,
         round(2 * p * r / (p + r + 1e-9), 6) f1, cast(actual as bigint) support
  from (select *, tp / (predicted + 1e-9) p, tp / (actual + 1e-9) r from class_sums where actual > 0) c
  left join names n on n.label = c.label
""", "class_sums", "names")
def per_class_metrics(spark, sf_dir):
    rows = ev.per_class_metrics(ev.confusion_matrix(predictions(spark, sf_dir)), names(spark, sf_dir))
    return rows.select("label_name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


define("errors", """
  select sample_id sample_index, y_true true_label_id, coalesce(a.label_name, cast(y_true as varchar)) true_label_name,
         y_pred pred_label_id, coalesce(b.label_name, cast(y_pred as varchar)) pred_label_name, confidence
  from predictions left join names a on a.label = y_true left join names b on b.label = y_pred
  where y_true <> y_pred
""", "predictions", "names")


def errors(spark, sf_dir):
    return ev.misclassified(predictions(spark, sf_dir), names(spark, sf_dir))


@query("id_to_label", """
  select sample_id, coalesce(label_name, cast(y_pred as varchar)) label_name
  from predictions left join names on label = y_pred
""", "predictions", "names")
def id_to_label(spark, sf_dir):
    rows = ev.id_to_label(predictions(spark, sf_dir), names(spark, sf_dir), "y_pred", "label_name")
    return rows.select("sample_id", "label_name")


@query("misclassified_topk", """
  select * replace (round(confidence, 6) as confidence) from errors order by errors.confidence, sample_index limit 20
""", "errors")
def misclassified_topk(spark, sf_dir):
    top = ev.misclassified_topk(errors(spark, sf_dir), 20)
    return top.withColumn("confidence", F.round("confidence", 6))


@query("errors_csv", """
  select cast(sample_index as varchar) sample_index, cast(true_label_id as varchar) true_label_id, true_label_name,
         cast(pred_label_id as varchar) pred_label_id, pred_label_name, printf('%.6f', confidence) confidence
  from errors
""", "errors")
def errors_csv(spark, sf_dir):
    path = shared_folder(spark, "errors")
    tables.write_errors_csv(errors(spark, sf_dir), path)
    return spark.read.option("header", True).csv(path)


BATCH = 32
define("unit", """
  select vec_id as id, cast((row_number() over (order by md5(concat_ws('|', 7, 'shuffle', 0, vec_id))) - 1) // 32 as bigint) batch_id,
         list_transform(r, lambda x: x / greatest(sqrt(list_sum(list_transform(r, lambda y: y * y))), 1e-12)) as raw,
         list_transform(s, lambda x: x / greatest(sqrt(list_sum(list_transform(s, lambda y: y * y))), 1e-12)) as size
  from (select vec_id, list_transform(embedding[1:32], lambda x: cast(x as double)) r,
               list_transform(embedding[33:64], lambda x: cast(x as double)) s from embeddings)
""")
define("sims", """
  select a.batch_id, a.id, b.id as other, list_dot_product(a.raw, b.size) / 0.07e0 rs,
         list_dot_product(a.size, b.raw) / 0.07e0 sr
  from unit a join unit b using (batch_id)
""", "unit")


def units(spark, sf_dir):
    half = lambda at: F.transform(F.slice("embedding", at, 32), lambda x: x.cast("double"))
    # Batches of a shuffled epoch: never more than BATCH members.
    rows = ba.shuffle(fx.table(spark, sf_dir, "embeddings"), ["vec_id"])
    return ba.batch_id(ba.round_robin_shard(rows, 1), BATCH, 1).select(
        F.col("vec_id").alias("id"), "batch_id",
        co.normalize(half(1)).alias("raw"), co.normalize(half(33)).alias("size"),
    )


def sims(spark, sf_dir):
    return co.batch_similarity(units(spark, sf_dir))


def rounded(column):
    return F.array_join(F.transform(column, lambda x: F.format_string("%.4f", x + 0.0)), " ")


@query("normalize_embeddings", """
  select id, round(list_sum(list_transform(raw, lambda x: x * x)), 6) raw_norm, round(raw[1], 6) raw_first,
         round(size[32], 6) size_last
  from unit
""", "unit")
def normalize_embeddings(spark, sf_dir):
    return units(spark, sf_dir).select(
        "id", F.round(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x), 6).alias("raw_norm"),
        F.round(F.col("raw")[0], 6).alias("raw_first"), F.round(F.col("size")[31], 6).alias("size_last"),
    )


@query("batch_similarity", """
  select batch_id, id, round(sum(rs), 5) raw_to_size_sum, round(max(rs), 5) raw_to_size_max,
         round(min(sr), 5) size_to_raw_min, cast(count(*) as int) members,
         round(max(rs) filter (other = id), 5) own
  from sims group by all
""", "sims")
def batch_similarity(spark, sf_dir):
    total = F.aggregate("raw_to_size", F.lit(0.0), lambda s, x: s + x)
    return sims(spark, sf_dir).select(
        "batch_id", "id", F.round(total, 5).alias("raw_to_size_sum"),
        F.round(F.array_max("raw_to_size"), 5).alias("raw_to_size_max"),
        F.round(F.array_min("size_to_raw"), 5).alias("size_to_raw_min"),
        F.size("ids").alias("members"),
        F.round(F.element_at("raw_to_size", F.col("place")), 5).alias("own"),
    )


@query("infonce_loss", """
  select batch_id, round((avg(lr - own_r) + avg(ls - own_s)) / 2, 6) loss
  from (select batch_id, id, max(rs) + ln(sum(exp(rs - m_r))) lr, max(sr) + ln(sum(exp(sr - m_s))) ls,
               max(rs) filter (other = id) own_r, max(sr) filter (other = id) own_s
        from (select *, max(rs) over w m_r, max(sr) over w m_s from sims window w as (partition by batch_id, id))
        group by batch_id, id)
  group by batch_id
""", "sims")
def infonce_loss(spark, sf_dir):
    return co.infonce_loss(sims(spark, sf_dir)).select("batch_id", F.round("loss", 6).alias("loss"))


def gumbel_sql(purpose):
    return (
        f"-ln(-ln((('0x' || substr(md5(concat_ws('|', 7, '{purpose}', id, other)), 1, 8))::ubigint + 0.5e0)"
        " / 4294967296e0))"
    )


define("negatives", f"""
  select batch_id, id, arg_max(other, rs + {gumbel_sql('size')}) neg_size,
         arg_max(other, sr + {gumbel_sql('raw')}) neg_raw
  from sims where other <> id group by batch_id, id
""", "sims")


@query("hard_negative_sampling", "select * from negatives", "negatives")
def hard_negative_sampling(spark, sf_dir):
    return co.hard_negative_sampling(sims(spark, sf_dir))


@query("matching_pairs", """
  select batch_id, id raw_id, id size_id, 1 as match from negatives
  union all select batch_id, id, neg_size, 0 from negatives
  union all select batch_id, neg_raw, id, 0 from negatives
""", "negatives")
def matching_pairs(spark, sf_dir):
    return co.matching_pairs(hard_negative_sampling(spark, sf_dir))


@query("gaussian_soft_labels", """
  select batch_id, round(avg(loss), 6) loss, round(max(peak), 6) peak
  from (select batch_id, id, -sum(w / total * (z - lse)) loss, max(w / total) peak
        from (select *, sum(w) over (partition by id) total,
                     max(z) over (partition by id) + ln(sum(exp(z - zm)) over (partition by id)) lse
              from (select *, max(z) over (partition by id) zm,
                           case when k >= 5 then exp(-cast((k - t) * (k - t) as double) / 200e0) else 0 end w
                    from (select vec_id as id, cast(vec_id // 32 as bigint) batch_id, 5 + 5 * label t,
                                 unnest(range(0, 64)) k, cast(unnest(embedding) as double) z from embeddings)))
        group by batch_id, id)
  group by batch_id
""")
def gaussian_soft_labels(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {BATCH}").alias("batch_id"), (5 + 5 * F.col("label")).alias("target"),
        F.transform("embedding", lambda x: x.cast("double")).alias("logits"),
    )
    target = F.col("target")
    return (
        rows.withColumns({
            "loss": co.soft_label_loss(F.col("logits"), target, 64),
            "peak": F.array_max(co.gaussian_soft_labels(target, 64)),
        })
        .groupBy("batch_id")
        .agg(F.round(F.avg("loss"), 6).alias("loss"), F.round(F.max("peak"), 6).alias("peak"))
    )


def load_scorer():
    """A stand-in model: ten fixed linear scores of a vector."""
    import numpy as np

    weights = np.cos(np.outer(np.arange(1, 65), np.arange(1, 11)).astype("float64"))
    return lambda batch: batch.astype("float64") @ weights


@query("score_batches", """
  select vec_id, cast(k - 1 as int) as class, round(sum(z * cos(cast(j * k as double))), 5) logit
  from (select vec_id, unnest(range(1, 65)) j, cast(unnest(embedding) as double) z from embeddings), range(1, 11) t(k)
  group by vec_id, k
""")
def score_batches(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")
    )
    scored = model.score_batches(rows, load_scorer, "x", 64)
    return scored.select("vec_id", F.posexplode("logits").alias("class", "l")).select(
        "vec_id", "class", F.round("l", 5).alias("logit")
    )
