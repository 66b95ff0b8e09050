"""Evaluation queries: G*, C10, E14, H1-H4."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuelake.catalog.registry import query, rounded
from cuelake.fixtures import Inputs
from cuelake.functions.math import sigmoid
from cuelake.operators import evaluate as E, mldata as M, windows as W
from cuelake.plans.ordered import INDEX_CHUNK, chunk_of
from cuelake.session import new_shared_path
from cuelake.sources.files import write_named_files
from cuelake.sources.logs import eval_curve, read_eval_report, read_logs, read_run_logs, read_trials, write_error_videos, write_report


@query("error_types", "predictions", """
    SELECT video_id, window_idx, label, prob, CAST(prob >= 0.5 AS INT) AS pred,
      CASE WHEN label = 1 AND prob < 0.5 THEN 'FN' WHEN label = 0 AND prob >= 0.5 THEN 'FP' WHEN label = 1 THEN 'TP' ELSE 'TN' END
      AS error_type FROM predictions""")
def _types(d: Inputs):
    return rounded(typed(d))


def typed(d: Inputs):
    return E.error_types(d.predictions())


TYPED = """, typed AS (SELECT *, CASE WHEN label = 1 AND prob < 0.5 THEN 'FN' WHEN label = 0 AND prob >= 0.5 THEN 'FP'
    WHEN label = 1 THEN 'TP' ELSE 'TN' END AS error_type FROM predictions)
"""


def confusion_sql(cond: str, source: str = "predictions") -> str:
    return f"""(SELECT *, round(pr, 6) AS "precision", round(re, 6) AS recall,
      round(2 * pr * re / greatest(pr + re, 1e-9::DOUBLE), 6) AS f1, round((tp + tn) / greatest(tp + fp + fn + tn, 1)::DOUBLE, 6) AS accuracy
      FROM (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS pr, tp / greatest(tp + fn, 1)::DOUBLE AS re FROM (
        SELECT count_if({cond} AND label = 1)::BIGINT AS tp, count_if({cond} AND label = 0)::BIGINT AS fp,
          count_if(NOT {cond} AND label = 1)::BIGINT AS fn, count_if(NOT {cond} AND label = 0)::BIGINT AS tn FROM {source})))"""


@query("confusion", "predictions", f"""
    SELECT tp, fp, fn, tn, "precision", recall, f1, accuracy FROM {confusion_sql('prob > 0.5')}""")
def _confusion(d: Inputs):
    return rounded(E.confusion(d.predictions()))


CURVE = """, th AS (SELECT round(i / 20.0::DOUBLE, 2) AS threshold FROM (SELECT unnest(range(1, 19)) AS i)),
    c0 AS (SELECT threshold, count_if(prob > threshold AND label = 1)::BIGINT AS tp, count_if(prob > threshold AND label = 0)::BIGINT AS fp,
      count_if(prob <= threshold AND label = 1)::BIGINT AS fn, count_if(prob <= threshold AND label = 0)::BIGINT AS tn
      FROM predictions, th GROUP BY 1),
    c1 AS (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS pr, tp / greatest(tp + fn, 1)::DOUBLE AS re FROM c0),
    curve AS (SELECT threshold, tp, fp, fn, tn, round(2 * pr * re / greatest(pr + re, 1e-9::DOUBLE), 4) AS f1,
      round(pr, 4) AS "precision", round(re, 4) AS recall FROM c1)
"""


@query("threshold_curve", "predictions", CURVE + "SELECT * FROM curve")
def _curve(d: Inputs):
    return E.threshold_curve(d.predictions())


@query("best_threshold", "predictions", CURVE + """
    SELECT threshold, f1, "precision", recall FROM curve ORDER BY f1 DESC, threshold LIMIT 1""")
def _best(d: Inputs):
    return E.best_threshold(E.threshold_curve(d.predictions()))


@query("prob_stats", "predictions", """
    SELECT round(avg(CASE WHEN label = 1 THEN prob END), 6) AS mean_prob_pos, round(avg(CASE WHEN label = 0 THEN prob END), 6)
      AS mean_prob_neg, max(CASE WHEN label = 1 THEN prob END) AS max_prob_pos FROM predictions""")
def _stats(d: Inputs):
    return rounded(E.prob_stats(d.predictions()))


@query("error_score_hist", "predictions", TYPED + """
    SELECT error_type, CAST(b AS INT) AS bin, round(b * 0.1::DOUBLE, 6) AS bin_lo, count(prob) AS n
    FROM (SELECT DISTINCT error_type FROM typed) t CROSS JOIN (SELECT unnest(range(0, 10)) AS b)
      LEFT JOIN typed USING (error_type) WHERE false GROUP BY ALL
    UNION ALL
    SELECT t.error_type, CAST(b AS INT), round(b * 0.1::DOUBLE, 6), count(x.prob)
    FROM (SELECT DISTINCT error_type FROM typed) t CROSS JOIN (SELECT unnest(range(0, 10)) AS b)
      LEFT JOIN typed x ON x.error_type = t.error_type AND least(CAST(floor(x.prob / 0.1::DOUBLE) AS INT), 9) = b GROUP BY ALL""")
def _score_hist(d: Inputs):
    return E.error_score_hist(typed(d))


@query("position_buckets", "predictions", TYPED + """
    , p AS (SELECT error_type, least(CAST(floor(window_idx / greatest(max(window_idx) OVER (PARTITION BY video_id), 1)::DOUBLE * 5) AS INT), 4)
      AS bucket FROM typed)
    SELECT t.error_type, CAST(b AS INT) AS bucket, count(p.bucket) AS n, round(count(p.bucket) * 100.0::DOUBLE / any_value(t.total), 6) AS pct
    FROM (SELECT error_type, count(*) AS total FROM p GROUP BY 1) t CROSS JOIN (SELECT unnest(range(0, 5)) AS b)
      LEFT JOIN p ON p.error_type = t.error_type AND p.bucket = b GROUP BY ALL""")
def _positions(d: Inputs):
    return rounded(E.position_buckets(W.window_position(typed(d))))


@query("top_error_videos", "predictions", TYPED + """
    SELECT video_id, count_if(error_type = 'FP')::BIGINT AS n_errors, count(*) AS n_windows,
      round(count_if(error_type = 'FP') / count(*)::DOUBLE, 6) AS error_rate
    FROM typed GROUP BY 1 HAVING count_if(error_type = 'FP') > 0 ORDER BY n_errors DESC, video_id LIMIT 15""")
def _top(d: Inputs):
    return rounded(E.top_error_videos(typed(d), "FP"))


@query("video_error_rates", "predictions", TYPED + """
    SELECT video_id, count_if(error_type = 'FN')::BIGINT AS n_errors, count(*) AS n_windows,
      round(CAST(sum(CASE WHEN error_type = 'FN' THEN CAST(prob AS DECIMAL(18,12)) END) AS DOUBLE) / count_if(error_type = 'FN'), 12) AS mean_prob,
      round(count_if(error_type = 'FN') / count(*)::DOUBLE, 12) AS error_rate
    FROM typed GROUP BY 1 HAVING count_if(error_type = 'FN') > 0""")
def _rates(d: Inputs):
    return rounded(E.video_error_rates(typed(d), "FN"), 12)


@query("confidence_of_errors", "predictions", TYPED + """
    SELECT round(CAST(sum(CASE WHEN error_type = 'FP' THEN CAST(prob AS DECIMAL(18,12)) END) AS DOUBLE) / count_if(error_type = 'FP'), 12) AS fp_mean_prob,
      round(CAST(sum(CASE WHEN error_type = 'FN' THEN CAST(prob AS DECIMAL(18,12)) END) AS DOUBLE) / count_if(error_type = 'FN'), 12) AS fn_mean_prob,
      count_if(error_type = 'FP' AND prob > 0.8)::BIGINT AS confident_fp, count_if(error_type = 'FN' AND prob < 0.2)::BIGINT AS hopeless_fn
    FROM typed""")
def _confidence(d: Inputs):
    return rounded(E.confidence_of_errors(typed(d)), 12)


@query("threshold_sensitivity", "predictions", """
    , c AS (SELECT t AS threshold, count_if(prob >= t AND label = 1)::BIGINT AS tp, count_if(prob >= t AND label = 0)::BIGINT AS fp,
      count_if(prob < t AND label = 1)::BIGINT AS fn FROM predictions, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]::DOUBLE[]) AS t) GROUP BY 1),
    s AS (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS pr, tp / greatest(tp + fn, 1)::DOUBLE AS re FROM c)
    SELECT threshold, round(pr, 6) AS "precision", round(re, 6) AS recall, round(2 * pr * re / greatest(pr + re, 1e-9::DOUBLE), 6) AS f1,
      fp, fn FROM s""")
def _sensitivity(d: Inputs):
    return rounded(E.threshold_sensitivity(d.predictions()))


def with_logits(d: Inputs):
    return M.attach_teacher_logit(d.predictions(), d.teacher_logits())


LOGITS = """, wl AS (SELECT p.*, coalesce(l.logit, CASE WHEN label <> 0 THEN 10.0::DOUBLE ELSE -10.0::DOUBLE END) AS logit
    FROM predictions p LEFT JOIN teacher_logits l USING (video_id, window_idx))
"""


@query("attach_teacher_logit", "predictions teacher_logits", LOGITS + """
    SELECT video_id, window_idx, label, round(logit, 6) AS teacher_logit FROM wl""")
def _teacher(d: Inputs):
    return rounded(with_logits(d).select("video_id", "window_idx", "label", "teacher_logit"))


LOGIT_STATS = """count(*) AS n, round(avg(logit), 6) AS mean, round(stddev_pop(logit), 6) AS std, round(min(logit), 6) AS min,
    round(max(logit), 6) AS max, round(avg(1 / (1 + exp(-logit))), 6) AS mean_prob,
    round(avg(CASE WHEN 1 / (1 + exp(-logit)) > 0.5 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS pct_over_50,
    round(avg(CASE WHEN 1 / (1 + exp(-logit)) > 0.6 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS pct_over_60"""


@query("logit_distribution", "predictions teacher_logits", LOGITS + f"""
    SELECT 'all' AS part, {LOGIT_STATS} FROM wl
    UNION ALL SELECT CASE WHEN label = 1 THEN 'pos' ELSE 'neg' END, {LOGIT_STATS} FROM wl GROUP BY label""")
def _logits(d: Inputs):
    return rounded(E.logit_distribution(with_logits(d).withColumnRenamed("teacher_logit", "logit")))


@query("logit_separation", "predictions teacher_logits", LOGITS + """
    SELECT gap, CASE WHEN gap < 1 THEN 'weak' WHEN gap < 2 THEN 'moderate' ELSE 'good' END AS separation
    FROM (SELECT round(avg(CASE WHEN label = 1 THEN logit END) - avg(CASE WHEN label = 0 THEN logit END), 6) AS gap FROM wl)""")
def _separation(d: Inputs):
    return rounded(E.logit_separation(with_logits(d).withColumnRenamed("teacher_logit", "logit")))


@query("errors_export", "predictions", TYPED + """
    SELECT video_id, window_idx, label, prob, CAST(prob >= 0.5 AS INT) AS pred, error_type FROM typed""")
def _export(d: Inputs):
    return E.errors_export(typed(d))


SOFT = "ln(1 + exp(-abs(x)))"
BCE = f"(greatest(x, 0) - x * y + {SOFT})"


@query("loss_report", "predictions teacher_logits", LOGITS + f"""
    , r AS (SELECT ln(p / (1 - p)) AS x, label::DOUBLE AS y, logit AS t, CASE WHEN label = 1 THEN (window_idx % 10 + 1) / 10.0::DOUBLE
        ELSE 1.0::DOUBLE END AS w FROM (SELECT *, least(greatest(prob, 0.01::DOUBLE), 0.99::DOUBLE) AS p FROM wl)),
    q AS (SELECT *, 1 / (1 + exp(-t / 4.0)) AS q, 1 / (1 + exp(-x / 4.0)) AS s FROM r)
    SELECT count(*) AS n, round(avg({BCE}), 6) AS bce,
      round(avg(((1 - y) * x + (1 + 14 * y) * ({SOFT} + greatest(-x, 0))) * w), 6) AS weighted_bce,
      round(avg((y * 0.25 + (1 - y) * 0.75) * pow(1 - exp(-{BCE}), 2) * {BCE}), 6) AS focal,
      round(16.0::DOUBLE * 0.7 * avg(w * (q * (ln(q + 1e-7) - ln(s + 1e-7)) + (1 - q) * (ln(1 - q + 1e-7) - ln(1 - s + 1e-7))))
        + 0.3 * avg({BCE} * w), 6) AS kd FROM q""")
def _loss(d: Inputs):
    p = F.least(F.greatest(F.col("prob"), F.lit(0.01)), F.lit(0.99))
    rows = with_logits(d).withColumn("logit", F.ln(p / (1 - p))).withColumn(
        "weight", F.when(F.col("label") == 1, (F.col("window_idx") % 10 + 1) / 10.0).otherwise(1.0)
    )
    return rounded(E.loss_report(rows))


@query("model_eval_report", "predictions", CURVE + f"""
    , b AS (SELECT threshold, f1, "precision" AS p, recall FROM curve ORDER BY f1 DESC, threshold LIMIT 1)
    SELECT 'test' AS phase, c.tp, c.fp, c.fn, c.tn, c."precision", c.recall, c.f1, c.accuracy,
      b.threshold AS best_threshold, b.f1 AS best_f1, b.p AS best_precision, b.recall AS best_recall,
      (SELECT count(*) FROM curve) AS n_curve, (SELECT count(DISTINCT video_id) FROM predictions) AS n_test_videos
    FROM {confusion_sql('prob > 0.5')} c, b""")
def _report(d: Inputs):
    report = E.model_eval_report(d.predictions(), "test")
    return rounded(report.withColumn("n_curve", F.size("curve").cast("bigint")).select(
        "phase", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy", "best_threshold",
        "best_f1", "best_precision", "best_recall", "n_curve", "n_test_videos",
    ))


@query("early_stop_replay", "epoch_log", """
    , a AS (SELECT *, max(val_f1) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM epoch_log),
    b AS (SELECT *, val_f1 > coalesce(best, -1) AS imp FROM a),
    c AS (SELECT *, epoch - max(CASE WHEN imp THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stale FROM b),
    s AS (SELECT run_id, min(CASE WHEN stale >= 10 THEN epoch END) AS stop, max(epoch) AS last FROM c GROUP BY 1)
    SELECT run_id, max(CASE WHEN imp THEN epoch END) AS best_epoch, max(CASE WHEN imp THEN val_f1 END) AS best_f1,
      any_value(coalesce(stop, last)) AS ran_epochs, bool_or(stop IS NOT NULL) AS stopped_early
    FROM c JOIN s USING (run_id) WHERE stop IS NULL OR epoch <= stop GROUP BY 1""")
def _early(d: Inputs):
    return E.early_stop_replay(d.epoch_log())


@query("trial_leaderboard", "trials", """
    SELECT count_if(state = 'COMPLETE')::BIGINT AS n_complete, count_if(state = 'PRUNED')::BIGINT AS n_pruned,
      count_if(state = 'FAIL')::BIGINT AS n_failed,
      (SELECT trial FROM trials WHERE state = 'COMPLETE' ORDER BY val_f1 DESC, trial LIMIT 1) AS best_trial,
      max(CASE WHEN state = 'COMPLETE' THEN val_f1 END) AS best_f1 FROM trials""")
def _leader(d: Inputs):
    return E.trial_leaderboard(d.trials())


@query("new_best_trials", "trials", """
    SELECT trial, val_f1 FROM (SELECT *, max(val_f1) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
      FROM trials WHERE state = 'COMPLETE') WHERE val_f1 > coalesce(best, -1)""")
def _new_best(d: Inputs):
    return E.new_best_trials(d.trials())


# -- logs and reports through files ------------------------------------------------------


@query("read_run_logs", "epoch_log", "SELECT 'run-' || CAST(run_id AS VARCHAR) AS phase, epoch, val_f1 FROM epoch_log")
def _run_logs(d: Inputs):
    path = new_shared_path(d.spark, "run-logs")
    # A log per run and block of epochs: no list grows with the run.
    logs = d.epoch_log().groupBy(
        F.concat(F.lit("run-"), F.col("run_id").cast("string")).alias("phase"),
        chunk_of(F.col("epoch"), INDEX_CHUNK).alias("block"),
    ).agg(F.collect_list(F.struct("epoch", "val_f1")).alias("epochs"))
    logs.write.json(path)
    return read_run_logs(d.spark, path, multi_line=False).select("phase", "epoch", "val_f1")


@query("read_trials", "trials", "SELECT CAST(trial AS INT) AS trial, state, val_f1, round(trial % 7 / 10.0::DOUBLE, 6) AS lr FROM trials")
def _trials(d: Inputs):
    path = new_shared_path(d.spark, "trials")
    params = F.create_map(F.lit("lr"), F.col("trial") % 7 / 10.0)
    d.trials().withColumn("params", params).write.json(path)
    back = read_trials(d.spark, path, multi_line=False)
    return rounded(back.select("trial", "state", "val_f1", F.col("params")["lr"].alias("lr")))


#: A report per group of videos and threshold: counts of each outcome.
OUTCOMES = """, g AS (SELECT video_id, label, prob, CAST(substr(video_id, 2) AS BIGINT) % 8 AS grp FROM predictions),
    o AS (SELECT grp, t, CAST(sum(CASE WHEN prob >= t / 10.0::DOUBLE AND label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
      CAST(sum(CASE WHEN prob >= t / 10.0::DOUBLE THEN 1 ELSE 0 END) AS DOUBLE) AS flagged, CAST(sum(label) AS DOUBLE) AS pos
      FROM g, (SELECT unnest(range(1, 10)) AS t) GROUP BY 1, 2),
    m AS (SELECT grp, t, round(coalesce(tp / nullif(flagged, 0), 0), 6) AS p, round(coalesce(tp / nullif(pos, 0), 0), 6) AS r FROM o)"""


def eval_logs(d: Inputs):
    """Reports of eight groups in files of several shapes, beside other logs: no curve in group 6, text for a number in group 7."""
    rows = d.predictions().withColumn("grp", F.substring("video_id", 2, 18).cast("bigint") % 8)
    point = rows.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(9)))).groupBy("grp", "t").agg(
        F.sum(((F.col("prob") >= F.col("t") / 10.0) & (F.col("label") == 1)).cast("double")).alias("tp"),
        F.sum((F.col("prob") >= F.col("t") / 10.0).cast("double")).alias("flagged"), F.sum("label").cast("double").alias("pos"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    scored = point.select("grp", "t", share("tp", "flagged").alias("precision"), share("tp", "pos").alias("recall"))
    curves = scored.groupBy("grp").agg(
        F.array_sort(F.collect_list(F.struct((F.col("t") / 10.0).alias("threshold"), "precision", "recall"))).alias("threshold_curve"),
        F.max(F.when(F.col("t") == 5, F.struct("precision", "recall"))).alias("metrics_at_0.50"))
    tests = rows.groupBy("grp").agg(F.countDistinct("video_id").alias("n_test_videos"), F.round(F.avg("prob"), 6).alias("test_loss"))
    whole = curves.join(tests, "grp").withColumn("phase", F.lit("teacher"))
    names = ["phase", "n_test_videos", "metrics_at_0.50", "threshold_curve"]
    usual = F.to_json(F.struct(*[f"`{n}`" for n in names], "test_loss"))
    bare = F.to_json(F.struct(*[f"`{n}`" for n in names[:3]], "test_loss", F.array().cast("array<int>").alias("threshold_curve")))
    text = F.to_json(F.struct(*[f"`{n}`" for n in names], F.lit("n/a").alias("test_loss")))
    grp = F.col("grp")
    reports = whole.select(F.format_string("eval-%d.json", "grp").alias("name"), F.when(grp == 6, bare).when(grp == 7, text).otherwise(usual).alias("content"))
    others = d.epoch_log().select("run_id").distinct().select(
        F.format_string("run-%s.json", F.col("run_id").cast("string")).alias("name"), F.lit('{"phase": "x", "epochs": [{"epoch": 1}]}').alias("content"))
    broken = d.spark.createDataFrame([("trials.json", '[{"trial": 1}]'), ("cut.json", '{"phase": "tea')], "name STRING, content STRING")
    path = new_shared_path(d.spark, "logs")
    write_named_files(reports.unionByName(others).unionByName(broken), path)
    return read_logs(d.spark, path)


@query("read_eval_report", "predictions", OUTCOMES + """
    , s AS (SELECT grp, count(DISTINCT video_id) AS n, round(avg(prob), 6) AS loss FROM g GROUP BY 1)
    SELECT 'eval-' || s.grp AS log_id, 'teacher' AS phase, n AS n_test_videos, CASE WHEN s.grp <> 7 THEN loss END AS test_loss, m.p AS precision, m.r AS recall
    FROM s JOIN m ON m.grp = s.grp AND t = 5""")
def _eval_report(d: Inputs):
    return read_eval_report(eval_logs(d)).select("log_id", "phase", "n_test_videos", "test_loss", "precision", "recall")


@query("eval_curve", "predictions", OUTCOMES + """
    SELECT 'eval-' || grp AS log_id, CAST(t - 1 AS INT) AS point, t / 10.0::DOUBLE AS threshold, p AS precision, r AS recall FROM m WHERE grp <> 6""")
def _eval_curve(d: Inputs):
    return eval_curve(read_eval_report(eval_logs(d))).select("log_id", "point", "threshold", "precision", "recall")


@query("read_logs", "epoch_log predictions", """
    SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'epochs' AS kind, CAST(run_id AS VARCHAR) AS id FROM epoch_log
      UNION ALL SELECT DISTINCT 'eval', CAST(CAST(substr(video_id, 2) AS BIGINT) % 8 AS VARCHAR) FROM predictions
      UNION ALL SELECT 'trials', '' UNION ALL SELECT 'broken', '') GROUP BY 1""")
def _logs(d: Inputs):
    return eval_logs(d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("write_report", "predictions", TYPED + """
    SELECT error_type, count(*) AS n, round(avg(prob), 6) AS mean_prob FROM typed GROUP BY 1""")
def _write_report(d: Inputs):
    path = new_shared_path(d.spark, "errors")
    write_report(typed(d), path, "csv")
    back = d.spark.read.csv(path, header=True)
    return rounded(back.groupBy("error_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("prob").cast("double")).alias("mean_prob")
    ))


@query("error_video_reports", "predictions", TYPED + "".join(f"""
    {join}SELECT '{kind}' AS kind, video_id, count_if(error_type = '{kind}')::BIGINT AS n_errors, count(*) AS n_windows,
      round(CAST(sum(CASE WHEN error_type = '{kind}' THEN CAST(prob AS DECIMAL(18,12)) END) AS DOUBLE) / count_if(error_type = '{kind}'), 12) AS mean_prob
    FROM typed GROUP BY video_id HAVING count_if(error_type = '{kind}') > 0""" for join, kind in (("", "FP"), ("UNION ALL ", "FN"))))
def _error_videos(d: Inputs):
    path = new_shared_path(d.spark, "error-videos")
    write_error_videos(E.video_error_rates(typed(d), "FP"), E.video_error_rates(typed(d), "FN"), path)
    schema = "video_id STRING, n_errors LONG, n_windows LONG, mean_prob DOUBLE, error_rate DOUBLE"
    both = [d.spark.read.csv(f"{path}/{kind.lower()}_videos", schema=schema, header=True).withColumn("kind", F.lit(kind)) for kind in ("FP", "FN")]
    return rounded(both[0].union(both[1]).select("kind", "video_id", "n_errors", "n_windows", "mean_prob"), 12)


# -- training data -------------------------------------------------------------------


@query("split_by_video", "predictions", """
    SELECT video_id, window_idx, CASE WHEN dr < printf('%08x', CAST(floor(0.70::DOUBLE * 4294967296) AS BIGINT)) THEN 'train'
      WHEN dr < printf('%08x', CAST(floor((0.70::DOUBLE + 0.15::DOUBLE) * 4294967296) AS BIGINT)) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, substr(md5('42' || video_id), 1, 8) AS dr FROM predictions)""")
def _split(d: Inputs):
    return M.split_by_video(d.labelled_windows()).select("video_id", "window_idx", "split")


@query("class_balance_weights", "predictions", """
    SELECT video_id, window_idx, label, round(1.0::DOUBLE / count(*) OVER (PARTITION BY label = 1), 8) AS balance_weight FROM predictions""")
def _balance(d: Inputs):
    return rounded(M.class_balance_weights(d.labelled_windows()), 8)


# A user's day is the video here: some have a positive window, some have none.
@query("class_balance_videos", "", """
    SELECT *, round(1.0::DOUBLE / count(*) OVER (PARTITION BY has_segment), 6) AS balance_weight
    FROM (SELECT concat('u', CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS video_id,
        count_if(event_type = 'purchase') > 0 AS has_segment FROM events GROUP BY 1)""")
def _balance_videos(d: Inputs):
    days = d.table("events").select(
        F.expr("concat('u', CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING))").alias("video_id"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
    )
    return rounded(M.class_balance_weights(days, "video"))


@query("balanced_resample", "predictions", """
    , c AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY label = 1) AS w FROM predictions),
    t AS (SELECT count(*) AS n, CAST(sum(CAST(w AS DECIMAL(38,20))) AS DOUBLE) AS s FROM c),
    r AS (SELECT video_id, window_idx, label, w / s * n AS rate,
        (CAST('0x' || substr(md5('42-' || video_id || '-' || CAST(window_idx AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS u FROM c, t),
    k AS (SELECT video_id, window_idx, any_value(label) AS label, count_if(cum < u) AS copies
      FROM (SELECT *, sum(exp(-rate + j * ln(rate) - lgamma(j + 1))) OVER (PARTITION BY video_id, window_idx ORDER BY j) AS cum
        FROM (SELECT *, unnest(range(0, 40)) AS j FROM r)) GROUP BY 1, 2)
    SELECT label, CAST(sum(copies) AS BIGINT) AS "count" FROM k GROUP BY 1""")
def _resample(d: Inputs):
    return M.balanced_resample(M.class_balance_weights(d.labelled_windows())).groupBy("label").count()


@query("assemble_sequences", "predictions", """
    , l AS (SELECT video_id, count(*) AS length FROM predictions GROUP BY 1),
    b AS (SELECT *, (row_number() OVER (ORDER BY md5('42' || video_id), video_id) - 1) // 16 AS batch FROM l),
    p AS (SELECT *, max(length) OVER (PARTITION BY batch) AS pad_to FROM b),
    a AS (SELECT video_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY window_idx) AS ls FROM predictions GROUP BY 1)
    SELECT batch, video_id, CAST(0 AS BIGINT) AS block, length, pad_to, ls || repeat(',-1', CAST(pad_to - length AS INT)) AS labels,
      round(length * 0.5::DOUBLE, 6) AS weight_sum FROM p JOIN a USING (video_id)""")
def _sequences(d: Inputs):
    windows = d.labelled_windows().withColumn("vote_weight", F.lit(0.5))
    out = M.assemble_sequences(windows, 16)
    return rounded(out.select(
        "batch", "video_id", "block", "length", "pad_to",
        F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"),
        F.aggregate("weights", F.lit(0.0), lambda a, b: a + b).alias("weight_sum"),
    ))


CTX = ", ".join(
    f"coalesce(round(lag(tp, {k}) OVER w, 6), 0.5::DOUBLE) AS c{k}" for k in range(1, 11)
)


@query("context_features", "predictions teacher_logits", f"""
    , t AS (SELECT p.video_id, p.window_idx, 1 / (1 + exp(-l.logit)) AS tp FROM predictions p LEFT JOIN teacher_logits l USING (video_id, window_idx))
    SELECT video_id, window_idx, {CTX} FROM t WINDOW w AS (PARTITION BY video_id ORDER BY window_idx)""")
def _context(d: Inputs):
    joined = d.labelled_windows().join(d.teacher_logits(), ["video_id", "window_idx"], "left")
    probs = joined.withColumn("teacher_prob", sigmoid(F.col("logit"))).drop("logit")
    out = M.context_features(probs)
    return rounded(out.select("video_id", "window_idx", *[F.get("context", F.lit(k)).alias(f"c{k + 1}") for k in range(10)]))


@query("exclude_label_after_context", "predictions teacher_logits", f"""
    , n AS (SELECT *, label = 1 AND coalesce(lag(label) OVER v, 0) <> 1 AND coalesce(lead(label) OVER v, 0) <> 1 AS lonely
        FROM predictions WINDOW v AS (PARTITION BY video_id ORDER BY window_idx)),
    t AS (SELECT p.video_id, p.window_idx, p.lonely, 1 / (1 + exp(-l.logit)) AS tp FROM n p LEFT JOIN teacher_logits l USING (video_id, window_idx)),
    c AS (SELECT video_id, window_idx, lonely, {CTX} FROM t WINDOW w AS (PARTITION BY video_id ORDER BY window_idx))
    SELECT video_id, window_idx, c1, c2, c3 FROM c WHERE NOT lonely""")
def _exclude_after(d: Inputs):
    consistent = W.temporal_consistency(d.labelled_windows())
    joined = consistent.join(d.teacher_logits(), ["video_id", "window_idx"], "left")
    out = M.context_features(joined.withColumn("teacher_prob", sigmoid(F.col("logit"))).drop("logit"))
    kept = out.filter("label <> -1")
    return rounded(kept.select("video_id", "window_idx", *[F.get("context", F.lit(k)).alias(f"c{k + 1}") for k in range(3)]))


# -- models ------------------------------------------------------------------------------

FEATURES = ["text_emb", "audio_emb"]


def _features(d: Inputs):
    return d.window_features().withColumn("vote_weight", F.when(F.col("label") == 1, 0.8).otherwise(1.0))


@query("train_window_classifier")
def _train(d: Inputs):
    data = M.split_by_video(_features(d))
    model = M.train_window_classifier(data.filter("split = 'train'"), FEATURES)
    return E.threshold_curve(M.apply_classifier(model, data.filter("split <> 'train'"), FEATURES))


#: Two features of the windows, few enough for SQL to fit the model itself.
PAIR = ["pair"]


def _pairs(d: Inputs) -> DataFrame:
    return _features(d).withColumn("pair", F.array(F.get("text_emb", F.lit(0)), F.get("audio_emb", F.lit(1))))


def sql_logistic(rows: str, reg: float = 0.01, steps: int = 500) -> str:
    """Coefficients of the weighted, penalised logistic model over ``rows`` (y, w, x0, x1): gradient descent on standardised features."""
    score = "1 / (1 + exp(-(g.b + g.t0 * z0 + g.t1 * z1)))"
    return f"""
    , t AS MATERIALIZED ({rows}),
    m AS (SELECT sum(w) AS sw, sum(w * w) AS sw2, sum(w * x0) / sum(w) AS m0, sum(w * x1) / sum(w) AS m1 FROM t),
    v AS MATERIALIZED (SELECT any_value(m0) AS m0, any_value(m1) AS m1, any_value(sw) AS sw, sqrt(sum(w * (x0 - m0) ** 2) / any_value(sw - sw2 / sw)) AS s0,
      sqrt(sum(w * (x1 - m1) ** 2) / any_value(sw - sw2 / sw)) AS s1 FROM t, m),
    z AS MATERIALIZED (SELECT y, w / sw AS w, (x0 - m0) / s0 AS z0, (x1 - m1) / s1 AS z1 FROM t, v),
    g(k, b, t0, t1) AS (
      SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
      UNION ALL SELECT k + 1, b - sum(w * ({score} - y)), t0 - (sum(w * ({score} - y) * z0) + {reg} * t0), t1 - (sum(w * ({score} - y) * z1) + {reg} * t1)
      FROM g, z WHERE k < {steps} GROUP BY k, b, t0, t1),
    f AS (SELECT t0 / s0 AS c0, t1 / s1 AS c1, b - t0 * m0 / s0 - t1 * m1 / s1 AS c FROM g, v WHERE k = {steps})
    SELECT 'x0' AS term, round(c0, 3) AS value FROM f UNION ALL SELECT 'x1', round(c1, 3) FROM f UNION ALL SELECT 'intercept', round(c, 3) FROM f"""


@query("train_coefficients", "window_features", sql_logistic("""
    SELECT label AS y, CASE WHEN label = 1 THEN 0.8 ELSE 1.0 END * n / (2.0 * (CASE WHEN label = 1 THEN pos ELSE n - pos END)) AS w, text_emb[1] AS x0, audio_emb[2] AS x1
    FROM window_features, (SELECT count(*)::DOUBLE AS n, sum(label)::DOUBLE AS pos FROM window_features) WHERE label >= 0"""), recursive=True)
def _train_coefficients(d: Inputs):
    data = _pairs(d)
    return rounded(M.coefficients(M.train_window_classifier(data, PAIR, max_iter=300, tol=1e-12), data), 3)


@query("distill_coefficients", "window_features", sql_logistic("""
    SELECT y, u * CASE WHEN y = 1 THEN q ELSE 1 - q END AS w, x0, x1
    FROM (SELECT CASE WHEN label = 1 THEN 0.8 ELSE 1.0 END AS u, text_emb[1] AS x0, audio_emb[2] AS x1,
      0.7 / (1 + exp(-(CASE WHEN label = 1 THEN 2.0 ELSE -2.0 END + text_emb[1]) / 4.0)) + 0.3 * label AS q FROM window_features), (SELECT unnest([0, 1]) AS y)"""), recursive=True)
def _distill_coefficients(d: Inputs):
    data = _pairs(d).withColumn("teacher_logit", F.when(F.col("label") == 1, 2.0).otherwise(-2.0) + F.col("text_emb")[0])
    return rounded(M.coefficients(M.distill(data, PAIR, max_iter=300, tol=1e-12), data), 3)


@query("tune_window_classifier")
def _tune(d: Inputs):
    return E.trial_leaderboard(M.tune_window_classifier(_features(d), FEATURES, [(0.01, 0.0), (0.1, 0.5)]))


@query("distill")
def _distill(d: Inputs):
    data = M.split_by_video(_features(d)).withColumn(
        "teacher_logit", F.when(F.col("label") == 1, 2.0).otherwise(-2.0) + F.col("text_emb")[0]
    )
    model = M.distill(data.filter("split = 'train'"), FEATURES)
    return E.threshold_curve(M.apply_classifier(model, data.filter("split <> 'train'"), FEATURES))


@query("score_windows", "cues", r"""
    , w AS (SELECT video_id, cue_idx, unnest(string_split_regex(CASE WHEN regexp_matches(text, '[^\s\p{Z}]') THEN lower(text) ELSE '[unk]' END,
        '[\s\p{Z}]+')) AS word FROM cues),
    h AS (SELECT video_id, cue_idx, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h FROM w WHERE word <> ''),
    s AS (SELECT video_id, cue_idx, h % 64 AS slot, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS INT) AS n FROM h GROUP BY ALL),
    g AS (SELECT c.video_id, c.cue_idx, k, coalesce(s.n, 0) AS n FROM cues c CROSS JOIN (SELECT unnest(range(0, 64)) AS k)
      LEFT JOIN s ON s.video_id = c.video_id AND s.cue_idx = c.cue_idx AND s.slot = k)
    SELECT video_id, cue_idx AS window_idx, string_agg(CAST(n AS VARCHAR), ',' ORDER BY k) AS text_emb FROM g GROUP BY 1, 2""")
def _score(d: Inputs):
    cues = d.cues().select("video_id", F.col("cue_idx").alias("window_idx"), "text")
    scored = M.score_windows(cues, M.hashing_encoder(64), 64).filter("text_emb_error IS NULL")
    return scored.select("video_id", "window_idx", F.array_join(F.transform("text_emb", lambda x: x.cast("int").cast("string")), ",").alias("text_emb"))
