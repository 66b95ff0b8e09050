"""Sources, cleaning rules and set maintenance: A1, A3, A6, A7, B*, C9, C12, F14, I*."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.catalog.registry import flat_vector, query, rounded
from cuelake.fixtures import Inputs
from cuelake.operators import audit, cleaning, intervals, maintain
from cuelake.session import new_shared_path
from cuelake.sources.segments import read_segments_csv, segments_from_api_json
from cuelake.sources.store import (
    normalize_features, read_feature_store, read_planned_shards, shard_manifest, shard_plan, write_feature_store,
    write_planned_shards, write_sharded,
)

NOW = "2024-01-20 00:00:00"


#: Titles with quotes, commas and line breaks stand in for a category.
TITLED = """, t AS (SELECT *, CASE CAST(startTime AS INT) % 5 WHEN 0 THEN 'a "quoted" ' || category WHEN 1 THEN category || E',\\n"two" lines\\n'
      WHEN 2 THEN '"' WHEN 3 THEN E'x\\ny' ELSE category END AS title FROM segments_raw)"""


@query("read_segments_csv", "segments_raw", TITLED + """
    SELECT title, "hidden", actionType, startTime, count(*) AS n, CAST(sum(CAST(votes AS BIGINT)) AS BIGINT) AS votes, CAST(count(*) AS BIGINT) AS n_absent
    FROM t GROUP BY 1, 2, 3, 4""")
def _read_csv(d: Inputs):
    path = new_shared_path(d.spark, "segments-csv")
    kind = F.col("startTime").cast("int") % 5
    title = (
        F.when(kind == 0, F.concat(F.lit('a "quoted" '), "category")).when(kind == 1, F.concat("category", F.lit(',\n"two" lines\n')))
        .when(kind == 2, '"').when(kind == 3, "x\ny").otherwise(F.col("category"))
    )
    # As the library writes it: fields with special characters in quotes, those doubled.
    d.segments_raw().withColumn("category", title).write.csv(
        path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = read_segments_csv(d.spark, path)
    return rows.groupBy(F.col("category").alias("title"), "hidden", F.coalesce("actionType", F.lit("")).alias("actionType"), "startTime").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("votes").cast("bigint")).alias("votes"),
        F.sum(F.when(F.col("shadowHidden").isNull() & F.col("service").isNull(), 1).otherwise(0)).alias("n_absent"),
    )


@query("segments_from_api_json", "segments_raw", """
    SELECT videoID AS video_id, CAST(startTime AS BIGINT) * 1000 AS start_ms, CAST(endTime AS BIGINT) * 1000 AS end_ms
    FROM segments_raw WHERE category = 'sponsor' AND actionType = 'skip'""")
def _api_json(d: Inputs):
    raw = d.segments_raw()
    item = F.struct(
        F.array(F.col("startTime").cast("double"), F.col("endTime").cast("double")).alias("segment"),
        "category", "actionType",
    )
    # A payload per (video, thousandth of parts) keeps the rendered lists short.
    payloads = raw.groupBy(
        F.col("videoID").alias("video_id"), (F.col("startTime").cast("int") % 10).alias("part")
    ).agg(F.to_json(F.collect_list(item)).alias("payload"))
    return segments_from_api_json(payloads)


@query("feature_store", "window_features", """
    SELECT video_id, window_idx, label,
      rpad(array_to_string(keyword_vec, ''), 128, '0') AS keyword_vec,
      mfcc_mean IS NULL AS mfcc_zero, round(list_sum(text_emb), 6) AS text_sum, round(text_emb[1], 6) AS text_first, round(text_emb[32], 6) AS text_last,
      round(list_sum(audio_emb), 6) AS audio_sum, round(audio_emb[1], 6) AS audio_first, round(audio_emb[32], 6) AS audio_last
    FROM window_features""")
def _feature_store(d: Inputs):
    path = new_shared_path(d.spark, "features")
    features = d.window_features()
    # Two generations of files: the older one lacks the audio column.
    write_feature_store(features.filter("mfcc_mean IS NULL").drop("mfcc_mean"), path)
    write_feature_store(features.filter("mfcc_mean IS NOT NULL"), path)
    back = read_feature_store(d.spark, path)
    vectors = [c for kind in ("text", "audio") for c in (
        F.aggregate(f"{kind}_emb", F.lit(0.0), lambda acc, x: acc + x).alias(f"{kind}_sum"),
        F.get(f"{kind}_emb", F.lit(0)).alias(f"{kind}_first"), F.get(f"{kind}_emb", F.lit(31)).alias(f"{kind}_last"))]
    return rounded(flat_vector(back, "keyword_vec").select(
        "video_id", "window_idx", "label", "keyword_vec",
        cleaning.all_zero(F.col("mfcc_mean")).alias("mfcc_zero"), *vectors,
    ))


@query("pad_keyword_vector", "window_features", """
    SELECT video_id, window_idx, rpad(array_to_string(keyword_vec, ''), 128, '0') AS keyword_vec
    FROM window_features""")
def _pad(d: Inputs):
    return flat_vector(normalize_features(d.window_features()), "keyword_vec").select(
        "video_id", "window_idx", "keyword_vec"
    )


@query("shard_plan", "", """
    SELECT name, shard, CASE WHEN shard = 0 THEN 'pages' ELSE 'pages-s' || CAST(shard AS VARCHAR) END AS shard_name
    FROM (SELECT name, (row_number() OVER (ORDER BY name) - 1) // 100 AS shard
          FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.npz' AS name FROM documents))""")
def _shards(d: Inputs):
    names = d.table("documents").select(
        F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".npz")).alias("name")
    )
    return shard_plan(names, "pages")


SHARDED = """, k AS (SELECT concat(source, '/', CAST(doc_id AS VARCHAR)) AS name, text FROM documents),
    r AS (SELECT name, text, (dense_rank() OVER (ORDER BY encode(name)) - 1) // 100 AS nth FROM k),
    s AS (SELECT *, CASE WHEN nth = 0 THEN 'texts' ELSE 'texts-s' || nth END AS shard FROM r)"""


@query("planned_shards", "", SHARDED + """
    SELECT shard, count(DISTINCT name) AS n_keys, count(*) AS n_rows, min(name) AS first_key, max(name) AS last_key,
      CAST(sum(length(text)) AS BIGINT) AS n_chars FROM s GROUP BY 1""")
def _planned_shards(d: Inputs):
    """What the folders hold, next to what the manifest says."""
    path = new_shared_path(d.spark, "planned")
    named = d.table("documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"), "text")
    write_planned_shards(named, "name", path, "texts")
    held = read_planned_shards(d.spark, path).groupBy("shard").agg(F.sum(F.length("text")).alias("n_chars"))
    return shard_manifest(d.spark, path).join(held, "shard").select("shard", "n_keys", "n_rows", "first_key", "last_key", "n_chars")


@query("write_sharded", "", "SELECT * FROM documents")
def _write_sharded(d: Inputs):
    path = new_shared_path(d.spark, "shards")
    write_sharded(d.table("documents"), "doc_id", path)
    return d.spark.read.parquet(path)


# -- rule sets -------------------------------------------------------------------


@query("clean_segments", "segments", "SELECT video_id, start_ms, end_ms, votes FROM segments")
def _clean(d: Inputs):
    return cleaning.clean_segments(d.segments_raw())


@query("clean_segments_bench", "segments_long_ids", """
    SELECT videoID AS video_id, CAST(startTime AS BIGINT) * 1000 AS start_ms, CAST(endTime AS BIGINT) * 1000 AS end_ms,
      CAST(trunc(try_cast(votes AS DOUBLE)) AS INT) AS votes
    FROM segments_long_ids
    WHERE category = 'sponsor' AND "hidden" <> '1' AND shadowHidden <> '1' AND try_cast(votes AS DOUBLE) >= 1
      AND try_cast(videoDuration AS DOUBLE) >= 60 AND service IN ('', 'YouTube') AND length(videoID) = 11""")
def _clean_bench(d: Inputs):
    return cleaning.clean_segments_bench(d.segments_long_ids())


AUDIT = """, audit AS (SELECT r.videoID AS video_id, CAST(r.startTime AS BIGINT) * 1000 AS start_ms,
      CAST(r.endTime AS BIGINT) * 1000 AS end_ms, CAST(r.votes AS INT) AS votes,
      (CAST(r.endTime AS BIGINT) - CAST(r.startTime AS BIGINT)) * 1000 AS dur_ms, c.video_id IS NOT NULL AS in_cache
    FROM segments_raw r LEFT JOIN cache c ON c.video_id = r.videoID
    WHERE category = 'sponsor' AND "hidden" IN ('0', '') AND CAST(endTime AS BIGINT) > CAST(startTime AS BIGINT))
"""


def audited(d: Inputs):
    return cleaning.clean_segments_audit(d.segments_raw(), d.cache())


@query("clean_segments_audit", "segments_raw cache", AUDIT + "SELECT * FROM audit")
def _clean_audit(d: Inputs):
    return audited(d)


@query("videos_with_confident_segment", "segments", """
    SELECT video_id, start_ms, end_ms, votes FROM segments
    WHERE video_id IN (SELECT video_id FROM segments GROUP BY 1 HAVING max(votes) >= 19)""")
def _confident(d: Inputs):
    return cleaning.videos_with_confident_segment(cleaning.clean_segments(d.segments_raw()), 19)


@query("detection_status", "cache gt_raw det_raw", """
    SELECT c.video_id, CASE WHEN c.zero_audio THEN 'error' WHEN NOT c.has_votes THEN 'no_captions'
      WHEN s.video_id IS NULL THEN 'true_negative' ELSE 'with_segments' END AS status
    FROM cache c LEFT JOIN (SELECT video_id FROM gt_raw UNION SELECT video_id FROM det_raw) s USING (video_id)""")
def _status(d: Inputs):
    cache = d.cache()
    both = d.gt_raw().select("video_id").union(d.det_raw().select("video_id"))
    return cleaning.detection_status(
        cache, cache.filter("has_votes"), both, errors=cache.filter("zero_audio")
    )


SILENT = """(SELECT video_id FROM window_features GROUP BY video_id
    HAVING bool_and(len(list_filter(audio_emb, lambda x: x <> 0)) = 0))"""


@query("drop_zero_audio", "window_features", f"""
    SELECT video_id, window_idx, label FROM window_features WHERE video_id NOT IN {SILENT}""")
def _drop_silent(d: Inputs):
    return cleaning.drop_zero_audio(d.window_features()).select("video_id", "window_idx", "label")


# -- joins on ids and set maintenance ----------------------------------------------


@query("attach_segments", "cache segments", """
    SELECT c.video_id, s.start_ms, s.end_ms, s.votes, s.video_id IS NULL AS missing_from_csv
    FROM cache c LEFT JOIN segments s USING (video_id)""")
def _attach(d: Inputs):
    return intervals.attach_segments(d.cache(), cleaning.clean_segments(d.segments_raw()))


@query("semi_join_cached", "cache segments", """
    SELECT video_id, start_ms, end_ms, votes FROM segments WHERE video_id IN (SELECT video_id FROM cache)""")
def _semi(d: Inputs):
    return cleaning.clean_segments(d.segments_raw()).join(d.cache(), "video_id", "left_semi")


@query("anti_join_cached", "cache segments", """
    SELECT video_id, start_ms, end_ms, votes FROM segments WHERE video_id NOT IN (SELECT video_id FROM cache)""")
def _anti(d: Inputs):
    return cleaning.clean_segments(d.segments_raw()).join(d.cache(), "video_id", "left_anti")


@query("sample_videos", "segments", """
    SELECT video_id FROM (SELECT DISTINCT video_id FROM segments) ORDER BY md5('42' || video_id) LIMIT 50""")
def _sample(d: Inputs):
    return audit.sample_videos(cleaning.clean_segments(d.segments_raw()), 50)


ELIGIBLE = "(SELECT video_id FROM segments GROUP BY 1 HAVING max(votes) >= 18)"
SKIP = "(SELECT DISTINCT video_id FROM det_raw WHERE end_ms - start_ms = 27000)"


def _skip(d: Inputs):
    return d.det_raw().filter("end_ms - start_ms = 27000").select("video_id").distinct()


def _select_work(d: Inputs, mode: str, n: int | None):
    segs = cleaning.clean_segments(d.segments_raw())
    return maintain.select_work(segs, d.cache(), _skip(d), n, 18, mode)


@query("select_work", "segments cache det_raw", f"""
    SELECT video_id FROM {ELIGIBLE} WHERE video_id NOT IN (SELECT video_id FROM cache) AND video_id NOT IN {SKIP}
    ORDER BY md5('42' || video_id) LIMIT 100""")
def _work(d: Inputs):
    return _select_work(d, "default", 100)


@query("select_work_force", "segments cache det_raw", f"""
    SELECT video_id FROM {ELIGIBLE} WHERE video_id NOT IN {SKIP}""")
def _work_force(d: Inputs):
    return _select_work(d, "force", None)


@query("select_work_zero_audio", "segments cache det_raw", f"""
    SELECT video_id FROM {ELIGIBLE} WHERE video_id NOT IN (SELECT video_id FROM cache WHERE NOT zero_audio)
      AND video_id NOT IN {SKIP}""")
def _work_silent(d: Inputs):
    return _select_work(d, "force_zero_audio", None)


@query("work_counters", "segments cache det_raw", f"""
    SELECT count(*) AS n_eligible, count_if(c)::BIGINT AS n_cached, count_if(s)::BIGINT AS n_skipped,
      count_if(NOT c AND NOT s)::BIGINT AS n_todo
    FROM (SELECT video_id IN (SELECT video_id FROM cache) AS c, video_id IN {SKIP} AS s
          FROM (SELECT DISTINCT video_id FROM segments))""")
def _work_counters(d: Inputs):
    return maintain.work_counters(cleaning.clean_segments(d.segments_raw()), d.cache(), _skip(d))


@query("backfill_counters", "segments cache", """
    SELECT count_if(NOT has_votes)::BIGINT AS updated, count_if(has_votes)::BIGINT AS already_done,
      count_if(NOT has_votes AND video_id NOT IN (SELECT video_id FROM segments))::BIGINT AS missing_from_csv
    FROM cache""")
def _backfill_counters(d: Inputs):
    segs = cleaning.clean_segments(d.segments_raw())
    return maintain.backfill_counters(maintain.backfill_status(d.cache(), segs))


@query("backfill_votes", "segments cache", """
    SELECT s.video_id, s.start_ms, s.end_ms, CASE WHEN c.has_votes THEN s.votes + 100 ELSE s.votes END AS votes
    FROM segments s JOIN cache c USING (video_id)""")
def _backfill(d: Inputs):
    segs = cleaning.clean_segments(d.segments_raw())
    stored = segs.withColumn("votes", F.col("votes") + 100)
    return maintain.backfill_votes(d.cache(), stored, segs)


@query("merge_cache", "segments cache", """
    SELECT video_id, 'old' AS origin FROM cache
    UNION ALL SELECT DISTINCT video_id, 'new' FROM segments WHERE video_id NOT IN (SELECT video_id FROM cache)""")
def _merge_cache(d: Inputs):
    new = cleaning.clean_segments(d.segments_raw()).select("video_id").distinct()
    return maintain.merge_cache(
        d.cache().select("video_id", F.lit("old").alias("origin")), new.withColumn("origin", F.lit("new"))
    )


@query("merge_report", "segments cache", """
    SELECT count_if(NOT old)::BIGINT AS added, count(*) AS total FROM (
      SELECT video_id, bool_or(old) AS old FROM (SELECT video_id, true AS old FROM cache
        UNION ALL SELECT video_id, false FROM segments) GROUP BY 1)""")
def _merge_report(d: Inputs):
    return maintain.merge_report(d.cache(), cleaning.clean_segments(d.segments_raw()))


OUTCOMES = "CASE status WHEN 'complete' THEN 'ok' WHEN 'failed' THEN 'none' ELSE 'blocked' END"


def _attempts(d: Inputs):
    # One video per job id, so that many videos have few attempts.
    return d.job_events().select(
        F.col("job_id").alias("video_id"), F.col("ts"), F.expr(OUTCOMES).alias("outcome")
    )


REMEMBERED = f"""(SELECT video_id, max_by(outcome, ts) AS outcome FROM (
    SELECT job_id AS video_id, ts, {OUTCOMES} AS outcome FROM job_events) WHERE outcome <> 'blocked' GROUP BY 1)"""


@query("negative_cache", "job_events", f"SELECT video_id, outcome FROM {REMEMBERED}")
def _negative(d: Inputs):
    return maintain.negative_cache(_attempts(d))


@query("caption_todo", "job_events", f"""
    SELECT DISTINCT job_id AS video_id FROM job_events WHERE job_id NOT IN (SELECT video_id FROM {REMEMBERED})""")
def _todo(d: Inputs):
    return maintain.caption_todo(_attempts(d), _attempts(d))


@query("caption_retry", "job_events", f"""
    SELECT DISTINCT job_id AS video_id FROM job_events
    WHERE job_id NOT IN (SELECT video_id FROM {REMEMBERED} WHERE outcome <> 'none')""")
def _retry(d: Inputs):
    return maintain.caption_todo(_attempts(d), _attempts(d), retry_failed=True)


LATEST = "(SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY updated_at DESC, event_id DESC) AS rn FROM prediction_log)"


@query("lookup_predictions", "prediction_log", f"""
    SELECT video_id, event_id, round(score, 6) AS score FROM {LATEST}
    WHERE rn = 1 AND (expires_at IS NULL OR expires_at >= TIMESTAMP '2024-02-06 00:00:00')""")
def _lookup(d: Inputs):
    now = F.lit("2024-02-06 00:00:00").cast("timestamp")
    return maintain.lookup_predictions(d.prediction_log(), now).select(
        "video_id", "event_id", F.round("score", 6).alias("score")
    )


@query("lookup_predictions_memory", "prediction_log", f"""
    SELECT video_id, event_id FROM {LATEST} WHERE rn = 1 AND expires_at > TIMESTAMP '2024-02-06 00:00:00'""")
def _lookup_memory(d: Inputs):
    now = F.lit("2024-02-06 00:00:00").cast("timestamp")
    return maintain.lookup_predictions(d.prediction_log(), now, memory=True).select("video_id", "event_id")


@query("job_status", "job_events", """
    SELECT job_id, video_id, status, error, right(error, 500) AS error_tail FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM job_events)
    WHERE rn = 1""")
def _jobs(d: Inputs):
    return maintain.job_status(d.job_events())


@query("job_answers", "job_events", """
    SELECT r.job_id, coalesce(s.status, 'not_found') AS status
    FROM (SELECT DISTINCT 'j' || CAST(user_id AS VARCHAR) || '-' || CAST(user_id % 9 AS VARCHAR) AS job_id FROM events) r
    LEFT JOIN (SELECT job_id, max_by(status, ts) AS status FROM job_events GROUP BY 1) s USING (job_id)""")
def _answers(d: Inputs):
    asked = d.table("events").select(
        F.expr("concat('j', CAST(user_id AS STRING), '-', CAST(user_id % 9 AS STRING))").alias("job_id")
    ).distinct()
    return maintain.job_answers(asked, maintain.job_status(d.job_events()))


@query("missing_feature_work", "window_features", """
    SELECT video_id, count_if(mfcc_mean IS NULL)::BIGINT AS n_missing, count(*) AS n_windows,
      CASE WHEN count_if(mfcc_mean IS NULL) > 0 THEN 'todo' ELSE 'skip' END AS action
    FROM window_features GROUP BY video_id""")
def _missing(d: Inputs):
    return maintain.missing_feature_work(d.window_features(), "mfcc_mean")


@query("skip_id_union", "cache det_raw", f"""
    SELECT video_id FROM {SKIP} UNION SELECT video_id FROM cache""")
def _skip_union(d: Inputs):
    return maintain.skip_id_union(_skip(d), d.cache())


@query("skip_id_overlap", "cache det_raw", f"""
    SELECT (SELECT count(*) FROM (SELECT video_id FROM {SKIP} INTERSECT SELECT video_id FROM cache)) AS n_both,
      (SELECT count(*) FROM (SELECT video_id FROM {SKIP} UNION SELECT video_id FROM cache)) AS n_either""")
def _skip_overlap(d: Inputs):
    return maintain.skip_id_overlap(_skip(d), d.cache())
