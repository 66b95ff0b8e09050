"""JSON run logs (A4) and reports (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RUN_LOG_SCHEMA = """
  phase STRING, best_epoch INT, best_val_f1 DOUBLE,
  epochs ARRAY<STRUCT<epoch: INT, train_loss: DOUBLE, val_loss: DOUBLE, val_f1: DOUBLE,
                      val_precision: DOUBLE, val_recall: DOUBLE>>
"""
TRIALS_SCHEMA = "trial INT, state STRING, val_f1 DOUBLE, params MAP<STRING,DOUBLE>"


def read_run_logs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per (run, epoch); the run is named by its file.

    ``multi_line=False`` reads many logs per file, one per line, which splits better.
    """
    raw = spark.read.json(path, schema=RUN_LOG_SCHEMA, multiLine=multi_line)
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return raw.select(
        F.regexp_replace(run, r"\.json$", "").alias("run_id"), "phase",
        F.explode("epochs").alias("e"),
    ).select("run_id", "phase", "e.*")


def read_trials(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.json(path, schema=TRIALS_SCHEMA, multiLine=multi_line)


#: Reports name their parts by phase: fields of the test part are prefixed in one and plain in the other.
METRICS = ("precision", "recall", "f1")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, kind, log): JSON files of any shape as Variant values, told apart by what they hold.

    ``epochs`` for a training log, ``trials`` for a list of trials, ``eval`` for an evaluation report; files that are not JSON
    have kind ``broken`` and no value, other ones kind ``other``.
    """
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    held = spark.read.text(path, wholetext=True).select(name.alias("log_id"), F.try_parse_json("value").alias("log"))
    has = lambda place: F.try_variant_get("log", place, "variant").isNotNull()
    kind = (
        F.when(F.col("log").isNull(), "broken").when(has("$.epochs"), "epochs").when(has("$.threshold_curve"), "eval")
        .when(has("$[0].trial"), "trials").otherwise("other")
    )
    return held.select("log_id", kind.alias("kind"), "log")


def read_eval_report(logs: DataFrame) -> DataFrame:
    """The evaluation reports among :func:`read_logs`: loss, metrics at 0.50, best threshold and the curve.

    A part that a report lacks, or that has another type, is null; the curve's points keep their order.
    """
    def number(place: str):
        return F.try_variant_get("log", place, "double")

    point = "ARRAY<STRUCT<threshold: DOUBLE, precision: DOUBLE, recall: DOUBLE, f1: DOUBLE>>"
    return logs.filter("kind = 'eval'").select(
        "log_id", F.try_variant_get("log", "$.phase", "string").alias("phase"),
        F.try_variant_get("log", "$.n_test_videos", "bigint").alias("n_test_videos"), number("$.test_loss").alias("test_loss"),
        *[number(f"$['metrics_at_0.50'].{m}").alias(m) for m in METRICS],
        number("$.best_threshold").alias("best_threshold"), number("$.best_threshold_f1").alias("best_f1"),
        F.try_variant_get("log", "$.threshold_curve", point).alias("curve"),
    )


def eval_curve(reports: DataFrame) -> DataFrame:
    """One row per point of each report's threshold curve."""
    return reports.select("log_id", F.posexplode("curve").alias("point", "p")).select("log_id", "point", "p.*")


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """JSON lines or headed CSV, one file per task (no single-task funnel)."""
    if fmt == "json":
        df.write.mode(mode).json(path)
    elif fmt == "csv":
        df.write.mode(mode).csv(path, header=True)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def summary_json(summary: DataFrame) -> DataFrame:
    """A one-row summary as one JSON text."""
    return summary.select(F.to_json(F.struct("*")).alias("report"))


def write_detection_report(summary: DataFrame, videos: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON report of a benchmark: the one-row ``summary`` and the per-video rows, each in its own folder."""
    write_report(summary, f"{path}/summary", "json", mode)
    write_report(videos, f"{path}/videos", "json", mode)


def write_error_videos(false_pos: DataFrame, false_neg: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headed CSVs of the videos with false positives and with false negatives."""
    write_report(false_pos, f"{path}/fp_videos", "csv", mode)
    write_report(false_neg, f"{path}/fn_videos", "csv", mode)
