"""Caption files of several formats, one file per video (A2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuelake.functions.let import bound
from cuelake.operators.text import JSON3_SCHEMA, XML_SCHEMA, json3_cues, vtt_cues, xml_cues
from cuelake.sources.files import read_named_files


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, ext, payload): the id is the file name up to its first dot."""
    parts = F.split("name", r"\.")
    return read_named_files(spark, path).select(
        F.element_at(parts, 1).alias("video_id"),
        F.lower(F.element_at(parts, -1)).alias("ext"),
        F.col("content").alias("payload"),
    )


JSON_EXT = ("json3", "srv3")
BOM = "\ufeff"


def _with_index(cues: Column) -> Column:
    return F.transform(cues, lambda c, i: F.struct(i.cast("int").alias("cue_idx"), *[c[f].alias(f) for f in ("start_ms", "dur_ms", "text")]))


def _found(kind: str, cues: Column) -> Column:
    return F.struct(F.lit(kind).alias("format"), cues.alias("cues"))


def parsed_payloads(payloads: DataFrame, variant: str = "bench") -> DataFrame:
    """(video_id, ext, format, reason, cues) per payload: what read it, or why nothing did.

    ``vtt`` and ``json3``/``srv3`` files go by their extension.  Any other is tried as XML, and as JSON where
    that gives no cue, whatever its first character is.  ``reason`` is null where there are cues; else ``empty``,
    ``corrupt`` (no format could read the payload) or ``no cues`` (one could, and found none).
    """
    text = F.regexp_replace("payload", f"^{BOM}", "")
    read = payloads.withColumn("_text", text)
    payload, blank = F.col("_text"), ~F.coalesce(F.col("_text").rlike(r"\S"), F.lit(False))
    by_json = _found("json", json3_cues(payload))
    by_xml = bound(xml_cues(payload), lambda cues: F.when(F.size(cues) > 0, _found("xml", cues)).otherwise(by_json))
    found = (
        F.when(F.col("ext") == "vtt", _found("vtt", _with_index(vtt_cues(payload, variant))))
        .when(F.col("ext").isin(*JSON_EXT), by_json).otherwise(by_xml)
    )
    corrupt = "_corrupt_record"
    as_xml = payload.rlike(r"^\s*<") & F.from_xml(payload, f"{XML_SCHEMA}, {corrupt} STRING", {"rowTag": "transcript"})[corrupt].isNull()
    as_json = payload.rlike(r"^\s*[\[{]") & F.from_json(payload, f"{JSON3_SCHEMA}, {corrupt} STRING")[corrupt].isNull()
    readable = F.when(F.col("ext") == "vtt", payload.rlike(r"^\s*WEBVTT")).when(F.col("ext").isin(*JSON_EXT), as_json).otherwise(as_xml | as_json)
    # A generator binds the parse once; a plain projection would be copied into each use.
    chosen = read.withColumn("_p", F.explode(F.array(found)))
    reason = (
        F.when(F.size("_p.cues") > 0, None).when(blank, "empty")
        .when(F.coalesce(readable, F.lit(False)), "no cues").otherwise("corrupt")
    )
    cues = F.coalesce(F.col("_p.cues"), F.array().cast("array<struct<cue_idx:int,start_ms:bigint,dur_ms:bigint,text:string>>"))
    return chosen.select("video_id", "ext", F.when(F.size(cues) > 0, F.col("_p.format")).alias("format"), reason.alias("reason"), cues.alias("cues"))


def parse_payloads(payloads: DataFrame, variant: str = "bench") -> DataFrame:
    """The cues of all payloads, each read as :func:`parsed_payloads` says."""
    return parsed_payloads(payloads, variant).select("video_id", F.explode("cues").alias("c")).select("video_id", "c.*")


def read_captions(spark: SparkSession, path: str, variant: str = "bench") -> DataFrame:
    return parse_payloads(read_payloads(spark, path), variant)


def caption_failures(spark: SparkSession, path: str, variant: str = "bench") -> DataFrame:
    """(video_id, ext, reason) of the files that gave no cue."""
    return parsed_payloads(read_payloads(spark, path), variant).filter("reason IS NOT NULL").select("video_id", "ext", "reason")
