"""Prediction metrics, error analysis and log replays (G operators)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cuelake import vocab
from cuelake.functions.math import (
    focal_loss, logistic_loss, ratio, sigmoid, soft_target_divergence,
)
from cuelake.functions.text import keyword_score
from cuelake.operators.audit import histogram
from cuelake.operators.intervals import gt_coverage, segment_metrics
from cuelake.plans.onerow import with_one_row
from cuelake.plans.ordered import INDEX_CHUNK, Scan, carry_scan, chunk_of

CURVE = [round(i / 20, 2) for i in range(1, 19)]
SENSITIVITY = [0.3, 0.4, 0.5, 0.6, 0.7]


def _known(df: DataFrame, ignored_as_tn: bool) -> DataFrame:
    """Drop ignored labels, or (compatibility) count them as negatives."""
    if ignored_as_tn:
        return df
    return df.filter(F.col("label") >= 0)


def _predicted(threshold: float, strict: bool) -> Column:
    prob = F.col("prob")
    return prob > threshold if strict else prob >= threshold


def error_types(df: DataFrame, threshold: float = 0.5, strict: bool = False,
                ignored_as_tn: bool = False) -> DataFrame:
    hit = _predicted(threshold, strict)
    positive = F.col("label") == 1
    kind = (
        F.when(positive & ~hit, "FN").when((F.col("label") == 0) & hit, "FP")
        .when(positive, "TP").otherwise("TN")
    )
    return _known(df, ignored_as_tn).withColumn("pred", hit.cast("int")).withColumn("error_type", kind)


def _cells(threshold: float, strict: bool) -> dict[str, Column]:
    hit = _predicted(threshold, strict)
    pos, neg = F.col("label") == 1, F.col("label") == 0
    return {
        "tp": F.count_if(hit & pos), "fp": F.count_if(hit & neg),
        "fn": F.count_if(~hit & pos), "tn": F.count_if(~hit & neg),
    }


def _scores(tp: Column, fp: Column, fn: Column, tn: Column, eps: float = 1e-9) -> dict[str, Column]:
    p = tp / F.greatest(tp + fp, F.lit(1))
    r = tp / F.greatest(tp + fn, F.lit(1))
    return {
        "precision": p, "recall": r,
        "f1": F.lit(2.0) * p * r / F.greatest(p + r, F.lit(eps)),
        "accuracy": (tp + tn) / F.greatest(tp + fp + fn + tn, F.lit(1)),
    }


def confusion(df: DataFrame, threshold: float = 0.5, strict: bool = True, eps: float = 1e-9) -> DataFrame:
    cells = _known(df, False).agg(*[c.alias(n) for n, c in _cells(threshold, strict).items()])
    scores = _scores(*[F.col(n) for n in ("tp", "fp", "fn", "tn")], eps=eps)
    return cells.select("*", *[c.alias(n) for n, c in scores.items()])


def threshold_curve(
    df: DataFrame, thresholds: Sequence[float] = tuple(CURVE), strict: bool = True,
    digits: int | None = 4,
) -> DataFrame:
    """Metrics at every threshold, from one pass over the data.

    Rows first collapse to (step, label) counts, step being how many thresholds the
    probability passes; the running totals then work on a handful of rows.
    """
    passes = F.lit(0)
    for t in thresholds:
        passes = passes + _predicted(t, strict).cast("int")
    counts = _known(df, False).groupBy(passes.alias("step"), "label").agg(F.count(F.lit(1)).alias("n"))
    aggs = []
    for i, t in enumerate(sorted(thresholds)):
        hit, pos = F.col("step") > i, F.col("label") == 1
        zero = F.lit(0)

        def total(cond: Column) -> Column:
            return F.coalesce(F.sum(F.when(cond, F.col("n"))), zero)

        aggs.append(F.struct(
            F.lit(t).alias("threshold"), total(hit & pos).alias("tp"), total(hit & ~pos).alias("fp"),
            total(~hit & pos).alias("fn"), total(~hit & ~pos).alias("tn"),
        ).alias(f"_t{i}"))
    names = [f"_t{i}" for i in range(len(aggs))]
    rows = counts.agg(*aggs).select(F.explode(F.array(*names)).alias("r")).select("r.*")
    scores = _scores(*[F.col(n) for n in ("tp", "fp", "fn", "tn")])
    shown = [
        (F.round(scores[n], digits) if digits is not None else scores[n]).alias(n)
        for n in ("f1", "precision", "recall")
    ]
    return rows.select("threshold", "tp", "fp", "fn", "tn", *shown)


def best_threshold(curve: DataFrame) -> DataFrame:
    """The row with the highest F1, the lowest threshold on a tie."""
    best = curve.agg(
        F.max_by(
            F.struct("threshold", "f1", "precision", "recall"),
            F.struct(F.col("f1"), -F.col("threshold")),
        ).alias("b")
    )
    return best.select("b.*")


def threshold_sensitivity(df: DataFrame) -> DataFrame:
    return threshold_curve(df, SENSITIVITY, strict=False, digits=None).select(
        "threshold", "precision", "recall", "f1", "fp", "fn"
    )


def prob_stats(df: DataFrame) -> DataFrame:
    pos, neg = F.col("label") == 1, F.col("label") == 0
    zero = F.lit(0.0)
    return df.agg(
        F.coalesce(F.avg(F.when(pos, F.col("prob"))), zero).alias("mean_prob_pos"),
        F.coalesce(F.avg(F.when(neg, F.col("prob"))), zero).alias("mean_prob_neg"),
        F.coalesce(F.max(F.when(pos, F.col("prob"))), zero).alias("max_prob_pos"),
    )


def error_score_hist(typed: DataFrame, bins: int = 10) -> DataFrame:
    return histogram(typed, "prob", bins, 0.0, 1.0, by=["error_type"])


def error_keyword_signal(typed: DataFrame) -> DataFrame:
    """Keyword averages per error type, and counts of the two suspicious cases."""
    zero_kw = (F.col("error_type") == "FP") & (F.col("n_keywords") == 0)
    strong = (F.col("error_type") == "FN") & (F.col("keyword_score") >= 3.0)
    return typed.filter("error_type <> 'TN'").groupBy("error_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("keyword_score").alias("mean_score"),
        F.avg("n_keywords").alias("mean_keywords"),
        F.count_if(zero_kw | strong).alias("n_suspicious"),
    ).withColumn("suspicious_share", F.col("n_suspicious") / F.greatest("n", F.lit(1)))


def position_buckets(typed: DataFrame, buckets: int = 5) -> DataFrame:
    bucket = F.least(F.floor(F.col("position") * buckets).cast("int"), F.lit(buckets - 1))
    counts = typed.groupBy("error_type", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("error_type").agg(F.sum("n").alias("_total"))
    frame = total.select(
        "error_type", "_total", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    )
    return frame.join(counts, ["error_type", "bucket"], "left").select(
        "error_type", "bucket", F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) * 100.0 / F.col("_total")).alias("pct"),
    )


def exact_mean(value: Column, wanted: Column) -> Column:
    """Mean of ``value`` over the wanted rows: an exact sum, divided once, so that row order does not matter."""
    return F.sum(F.when(wanted, value.cast("decimal(18,12)"))).cast("double") / F.count_if(wanted & value.isNotNull())


def video_error_rates(typed: DataFrame, error_type: str) -> DataFrame:
    wrong = F.col("error_type") == error_type
    return (
        typed.groupBy("video_id").agg(
            F.count_if(wrong).alias("n_errors"), F.count(F.lit(1)).alias("n_windows"),
            exact_mean(F.col("prob"), wrong).alias("mean_prob"),
        )
        .filter("n_errors > 0")
        .withColumn("error_rate", F.col("n_errors") / F.col("n_windows"))
    )


def top_error_videos(typed: DataFrame, error_type: str, n: int = 15) -> DataFrame:
    return (
        video_error_rates(typed, error_type)
        .select("video_id", "n_errors", "n_windows", "error_rate")
        .orderBy(F.desc("n_errors"), "video_id").limit(n)
    )


def confidence_of_errors(typed: DataFrame) -> DataFrame:
    fp, fn = F.col("error_type") == "FP", F.col("error_type") == "FN"
    return typed.agg(
        exact_mean(F.col("prob"), fp).alias("fp_mean_prob"),
        exact_mean(F.col("prob"), fn).alias("fn_mean_prob"),
        F.count_if(fp & (F.col("prob") > 0.8)).alias("confident_fp"),
        F.count_if(fn & (F.col("prob") < 0.2)).alias("hopeless_fn"),
    )


def keyword_baseline(
    windows: DataFrame, vector: str = "keyword_vec", dims: int = 64, cut: float = 2.0
) -> DataFrame:
    """Confusion of "weighted keyword sum >= cut" over the first ``dims`` dimensions."""
    score = keyword_score(F.col(vector), dims // vocab.GROUP_SIZE)
    return confusion(windows.withColumn("prob", score), cut, strict=False, eps=1e-7)


def logit_distribution(df: DataFrame) -> DataFrame:
    """Logit statistics for all windows and for each class."""
    x = F.col("logit")
    p = sigmoid(x)
    stats = [
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(p).alias("mean_prob"),
        (F.avg((p > 0.5).cast("double")) * 100).alias("pct_over_50"),
        (F.avg((p > 0.6).cast("double")) * 100).alias("pct_over_60"),
    ]
    known = df.filter("label IN (0, 1)")
    grouped = known.cube("label").agg(F.grouping("label").alias("_g"), *stats)
    return grouped.select(
        F.when(F.col("_g") == 1, "all").when(F.col("label") == 1, "pos").otherwise("neg").alias("part"),
        "n", "mean", "std", "min", "max", "mean_prob", "pct_over_50", "pct_over_60",
    )


def logit_separation(df: DataFrame) -> DataFrame:
    gap = df.agg(
        (F.avg(F.when(F.col("label") == 1, F.col("logit")))
         - F.avg(F.when(F.col("label") == 0, F.col("logit")))).alias("gap")
    )
    return gap.withColumn(
        "separation", F.when(F.col("gap") < 1, "weak").when(F.col("gap") < 2, "moderate").otherwise("good")
    )


def errors_export(typed: DataFrame, tn_share: float = 1.0, seed: str = "42") -> DataFrame:
    """All FP, FN and TP rows, and all true negatives or a reproducible share of them by hash."""
    if tn_share >= 1.0:
        return typed
    key = F.md5(F.concat_ws("-", F.lit(seed), F.col("video_id"), F.col("window_idx").cast("string")))
    limit = f"{int(tn_share * 2**32):08x}"
    return typed.filter((F.col("error_type") != "TN") | (F.substring(key, 1, 8) < limit))


def loss_report(
    df: DataFrame, pos_weight: float = 15.0, alpha: float = 0.25, gamma: float = 2.0,
    temperature: float = 4.0, kd_alpha: float = 0.7,
) -> DataFrame:
    """Mean losses of ``logit`` against ``label``, ``teacher_logit`` and ``weight``.

    Weighted means divide by the row count, not by the weight sum.
    """
    x, y = F.col("logit"), F.col("label").cast("double")
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    hard = F.avg(logistic_loss(x, y) * w)
    soft = F.avg(soft_target_divergence(x, F.col("teacher_logit"), temperature) * w)
    return df.filter("label >= 0").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(logistic_loss(x, y)).alias("bce"),
        F.avg(logistic_loss(x, y, pos_weight) * w).alias("weighted_bce"),
        F.avg(focal_loss(x, y, alpha, gamma)).alias("focal"),
        (F.lit(temperature**2) * soft * F.lit(kd_alpha) + F.lit(1 - kd_alpha) * hard).alias("kd"),
    )


def model_eval_report(df: DataFrame, phase: str) -> DataFrame:
    """One row: metrics at 0.50, best threshold with its metrics, the curve as array.

    One pass collapses the rows to a few (step, label) counts, from which everything but the
    number of videos follows.
    """
    known = _known(df, False)
    passes = F.lit(0)
    for t in CURVE:
        passes = passes + _predicted(t, True).cast("int")
    counts = known.groupBy(passes.alias("step"), "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("prob").alias("s"), F.max("prob").alias("m"))
    pos, neg = F.col("label") == 1, F.col("label") == 0

    def total(cond: Column, value: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0))

    def cells(i: int) -> Column:
        hit = F.col("step") > i
        return F.struct(total(hit & pos).alias("tp"), total(hit & neg).alias("fp"),
                        total(~hit & pos).alias("fn"), total(~hit & neg).alias("tn"))

    summed = counts.agg(
        *[cells(i).alias(f"_t{i}") for i in range(len(CURVE))], total(pos, "s").alias("_sp"), total(neg, "s").alias("_sn"),
        total(pos).alias("_np"), total(neg).alias("_nn"), F.coalesce(F.max(F.when(pos, F.col("m"))), F.lit(0.0)).alias("max_prob_pos"))

    def point(i: int, t: float) -> Column:
        c = F.col(f"_t{i}")
        got = _scores(c["tp"], c["fp"], c["fn"], c["tn"])
        return F.struct(F.lit(t).alias("threshold"), *[F.round(got[n], 4).alias(n) for n in ("f1", "precision", "recall")])

    curve = F.array(*[point(i, t) for i, t in enumerate(CURVE)])
    mean = lambda s, n: F.coalesce(F.col(s) / F.nullif(F.col(n), F.lit(0)), F.lit(0.0))
    half = F.col(f"_t{CURVE.index(0.5)}")
    scores = _scores(*[half[n] for n in ("tp", "fp", "fn", "tn")])
    out = summed.select(
        *[half[n].alias(n) for n in ("tp", "fp", "fn", "tn")], *[c.alias(n) for n, c in scores.items()],
        mean("_sp", "_np").alias("mean_prob_pos"), mean("_sn", "_nn").alias("mean_prob_neg"), "max_prob_pos", curve.alias("curve"))
    # The highest F1, the lowest threshold on a tie.
    best = F.array_max(F.transform("curve", lambda r: F.struct(
        r["f1"].alias("f1"), (-r["threshold"]).alias("below"), r["precision"].alias("precision"), r["recall"].alias("recall"))))
    out = out.withColumn("_b", best).select(
        *[c for c in out.columns if c != "curve"], (-F.col("_b.below")).alias("best_threshold"), F.col("_b.f1").alias("best_f1"),
        F.col("_b.precision").alias("best_precision"), F.col("_b.recall").alias("best_recall"), "curve")
    videos = known.agg(F.count_distinct("video_id").alias("n_test_videos"))
    return with_one_row(out, videos).withColumn("phase", F.lit(phase))


def early_stop_replay(log: DataFrame, patience: int = 10) -> DataFrame:
    """Best epoch and the epoch at which training stops, per run, from the epoch log."""
    chunk = chunk_of(F.col("epoch"), INDEX_CHUNK)
    run, order = ["run_id"], ["epoch"]
    seen = carry_scan(log, run, order, chunk, [Scan("_best", "max_before", F.col("val_f1"))])
    # Nothing has been seen before the first epoch, so it always improves.
    improved = F.col("val_f1") > F.coalesce(F.col("_best"), F.lit(-1.0))
    marked = carry_scan(
        seen.withColumn("_imp", improved), run, order, chunk,
        [Scan("_last", "last", F.when(F.col("_imp"), F.col("epoch")))],
    )
    stale = F.col("epoch") - F.coalesce(F.col("_last"), F.lit(0))
    stopped = marked.withColumn("_stale", stale)
    stop = stopped.groupBy("run_id").agg(
        F.min(F.when(F.col("_stale") >= patience, F.col("epoch"))).alias("stop_epoch"),
        F.max("epoch").alias("last_epoch"),
    )
    reached = stopped.join(stop, "run_id").filter(
        F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch"))
    )
    return reached.groupBy("run_id").agg(
        F.max(F.when(F.col("_imp"), F.col("epoch"))).alias("best_epoch"),
        F.max(F.when(F.col("_imp"), F.col("val_f1"))).alias("best_f1"),
        F.coalesce(F.first("stop_epoch"), F.first("last_epoch")).alias("ran_epochs"),
        F.first("stop_epoch").isNotNull().alias("stopped_early"),
    )


def trial_leaderboard(trials: DataFrame) -> DataFrame:
    done = F.col("state") == "COMPLETE"
    return trials.agg(
        F.count_if(done).alias("n_complete"),
        F.count_if(F.col("state") == "PRUNED").alias("n_pruned"),
        F.count_if(F.col("state") == "FAIL").alias("n_failed"),
        F.max_by(F.when(done, F.col("trial")), F.when(done, F.struct(F.col("val_f1"), -F.col("trial"))))
        .alias("best_trial"),
        F.max(F.when(done, F.col("val_f1"))).alias("best_f1"),
    )


def new_best_trials(trials: DataFrame) -> DataFrame:
    """Completed trials that beat every completed one before them."""
    done = trials.filter("state = 'COMPLETE'").withColumn("_all", F.lit(1))
    seen = carry_scan(
        done, ["_all"], ["trial"], chunk_of(F.col("trial"), INDEX_CHUNK),
        [Scan("_best", "max_before", F.col("val_f1"))],
    )
    return seen.filter(
        F.col("val_f1") > F.coalesce(F.col("_best"), F.lit(-1.0))
    ).select("trial", "val_f1")


def detection_summary(
    status: DataFrame, det: DataFrame, gt: DataFrame
) -> DataFrame:
    """Counts by status, macro averages over scored videos, segment-level coverage, flags."""

    in_scope = status.filter("status = 'with_segments'").select("video_id")
    gt_in = gt.join(in_scope, "video_id", "left_semi")
    det_in = det.join(in_scope, "video_id", "left_semi")
    metrics = segment_metrics(det_in, gt_in, in_scope)
    averages = metrics.agg(
        F.avg("precision").alias("avg_precision"), F.avg("recall").alias("avg_recall"),
        F.avg("iou").alias("avg_iou"),
        F.coalesce(F.sum("n_gt"), F.lit(0)).alias("n_gt"),
        F.coalesce(F.sum(F.when(F.col("n_gt") == 0, F.col("n_det"))), F.lit(0)).alias("n_false_pos"),
    )
    covered = gt_coverage(gt_in, det_in).agg(F.count_if("covered").alias("n_covered"))
    counts = status.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("status") == "error").alias("n_errors"),
        F.count_if(F.col("status") == "no_captions").alias("n_no_captions"),
        F.count_if(F.col("status") == "true_negative").alias("n_true_negative"),
        F.count_if(F.col("status") == "with_segments").alias("n_with_segments"),
    )

    out = with_one_row(counts, averages, covered)
    p, r = F.col("avg_precision"), F.col("avg_recall")

    def level(x: Column) -> Column:
        return F.when(x < 0.3, "low").when(x < 0.5, "moderate").otherwise("ok")

    return out.select(
        "*",
        (ratio(F.col("n_covered"), F.col("n_gt")) * 100).alias("covered_pct"),
        level(r).alias("recall_level"), level(p).alias("precision_level"),
        (F.col("avg_iou") >= 0.4).alias("decent_iou"),
    )
