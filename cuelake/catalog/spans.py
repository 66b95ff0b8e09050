"""Windows, labels, intervals and audits: C*, E*, F*, G1, F12."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.catalog.cleaning import AUDIT, audited
from cuelake.catalog.registry import query, rounded
from cuelake.fixtures import Inputs
from cuelake.operators import audit, cleaning, evaluate, intervals, windows as W

OV = "greatest(0, least(w.t_end_ms, s.end_ms) - greatest(w.t_start_ms, s.start_ms))"


def grid(d: Inputs):
    return W.grid_windows(d.videos())


def labelled(d: Inputs):
    return intervals.label_windows(grid(d), d.cue_segments())


@query("grid_windows", "windows", "SELECT * FROM windows")
def _grid(d: Inputs):
    return grid(d)


@query("duration_windows", "videos", """
    SELECT video_id, CAST(i AS INT) AS window_idx, CAST(i * 5000 AS BIGINT) AS t_start_ms,
      CAST(i * 5000 + 5000 AS BIGINT) AS t_end_ms, '' AS text
    FROM (SELECT video_id, unnest(range(0, greatest(1, dur_ms // 5000))) AS i FROM videos)""")
def _duration(d: Inputs):
    return W.duration_windows(d.videos())


@query("video_duration_from_cues", "cues segments", """
    SELECT v.video_id, CAST(coalesce(max(c.start_ms + c.dur_ms), 0) + 5000 AS BIGINT) AS dur_ms
    FROM (SELECT DISTINCT video_id FROM cues UNION SELECT DISTINCT video_id FROM segments) v
    LEFT JOIN cues c USING (video_id) GROUP BY 1 HAVING coalesce(max(c.start_ms + c.dur_ms), 0) + 5000 >= 60000""")
def _cue_duration(d: Inputs):
    segs = cleaning.clean_segments(d.segments_raw())
    ids = d.cues().select("video_id").union(segs.select("video_id")).distinct()
    return W.video_duration_from_cues(ids, d.cues())


@query("label_windows", "labelled_cue_windows", "SELECT * FROM labelled_cue_windows")
def _label(d: Inputs):
    return labelled(d)


@query("relabel", "labelled_cue_windows cue_segments", f"""
    SELECT w.video_id, w.window_idx, CAST(CASE WHEN length(w.video_id) % 2 = 0 THEN coalesce(max(CASE WHEN
        s.votes >= 8 AND 2 * {OV} >= w.t_end_ms - w.t_start_ms THEN 1 ELSE 0 END), 0) ELSE any_value(w.label) END AS INT) AS label
    FROM labelled_cue_windows w LEFT JOIN cue_segments s USING (video_id) GROUP BY w.video_id, w.window_idx""")
def _relabel(d: Inputs):
    stored = labelled(d).withColumn("has_votes", F.length("video_id") % 2 == 0)
    return intervals.relabel(stored, d.cue_segments(), 8).select("video_id", "window_idx", "label")


@query("vote_weights", "labelled_cue_windows cue_segments", f"""
    SELECT w.video_id, w.window_idx, any_value(w.label) AS label, CASE WHEN any_value(w.label) = 1 THEN round(least(1.0::DOUBLE,
        coalesce(max(CASE WHEN 2 * {OV} >= w.t_end_ms - w.t_start_ms THEN greatest(s.votes, 0) END), 0) / 10.0::DOUBLE), 6)
        ELSE 1.0::DOUBLE END AS vote_weight
    FROM labelled_cue_windows w LEFT JOIN cue_segments s USING (video_id) GROUP BY w.video_id, w.window_idx""")
def _weights(d: Inputs):
    out = intervals.vote_weights(labelled(d), d.cue_segments())
    return rounded(out.select("video_id", "window_idx", "label", "vote_weight"))


CUES_IN = """coalesce((SELECT string_agg(c.text, ' ' ORDER BY c.cue_idx) FROM cues c WHERE c.video_id = w.video_id
    AND c.start_ms + c.dur_ms > w.t_start_ms AND c.start_ms < w.t_end_ms), '')"""


@query("cues_in_window", "windows cues", """
    SELECT w.video_id, w.window_idx, any_value(w.t_start_ms) AS t_start_ms, any_value(w.t_end_ms) AS t_end_ms,
      coalesce(string_agg(c.text, ' ' ORDER BY c.cue_idx), '') AS text
    FROM windows w LEFT JOIN cues c ON c.video_id = w.video_id AND c.start_ms + c.dur_ms > w.t_start_ms
      AND c.start_ms < w.t_end_ms GROUP BY w.video_id, w.window_idx""")
def _cues_in_window(d: Inputs):
    return intervals.cues_in_window(grid(d), d.cues())


@query("active_cues", "cue_ticks cues", """
    SELECT t.video_id, t.tick_id, t.t_ms, c.cue_idx FROM cue_ticks t JOIN cues c ON c.video_id = t.video_id
      AND c.start_ms <= t.t_ms + 5000 AND c.start_ms + c.dur_ms >= t.t_ms""")
def _active(d: Inputs):
    return intervals.active_cues(d.cue_ticks(), d.cues()).select("video_id", "tick_id", "t_ms", "cue_idx")


@query("point_in_segments", "playback gt_raw", """
    SELECT t.video_id, t.tick_id, t.t_ms, count(s.start_ms) > 0 AS in_segment,
      min_by(s.start_ms, s.start_ms * 10000000 + s.end_ms) AS seg_start_ms,
      min_by(s.end_ms, s.start_ms * 10000000 + s.end_ms) AS seg_end_ms
    FROM playback t LEFT JOIN gt_raw s ON s.video_id = t.video_id AND t.t_ms BETWEEN s.start_ms AND s.end_ms
    GROUP BY 1, 2, 3""")
def _points(d: Inputs):
    ticks = d.playback().select("video_id", "tick_id", "t_ms")
    out = intervals.point_in_segments(ticks, d.gt_raw())
    return out.select("video_id", "tick_id", "t_ms", "in_segment", "seg_start_ms", "seg_end_ms")


SWEEP = """, ev AS (SELECT video_id, t, sum(g) AS g, sum(d) AS d FROM (
      SELECT video_id, start_ms AS t, 1 AS g, 0 AS d FROM gt_raw UNION ALL SELECT video_id, end_ms, -1, 0 FROM gt_raw
      UNION ALL SELECT video_id, start_ms, 0, 1 FROM det_raw UNION ALL SELECT video_id, end_ms, 0, -1 FROM det_raw)
      GROUP BY 1, 2),
    sw AS (SELECT video_id, lead(t) OVER w - t AS len, sum(g) OVER w AS g, sum(d) OVER w AS d FROM ev
      WINDOW w AS (PARTITION BY video_id ORDER BY t)),
    inter AS (SELECT video_id, CAST(coalesce(sum(CASE WHEN g > 0 AND d > 0 THEN len END), 0) AS BIGINT) AS inter_ms
      FROM sw GROUP BY 1)
"""


@query("interval_intersection", "gt_raw det_raw", SWEEP + "SELECT video_id, inter_ms FROM inter")
def _intersection(d: Inputs):
    return intervals.interval_intersection(d.gt_raw(), d.det_raw())


@query("gt_coverage", "gt_raw det_raw", """
    , g AS (SELECT *, row_number() OVER () AS rid FROM gt_raw)
    SELECT any_value(g.video_id) AS video_id, any_value(g.start_ms) AS start_ms, any_value(g.end_ms) AS end_ms,
      any_value(g.votes) AS votes,
      CAST(coalesce(sum(CASE WHEN d.start_ms IS NOT NULL THEN least(g.end_ms, d.end_ms) - greatest(g.start_ms, d.start_ms) END), 0) AS BIGINT) AS overlap_ms,
      round(coalesce(sum(CASE WHEN d.start_ms IS NOT NULL THEN least(g.end_ms, d.end_ms) - greatest(g.start_ms, d.start_ms) END), 0)
        / CAST(any_value(g.end_ms - g.start_ms) AS DOUBLE), 6) AS coverage,
      2 * coalesce(sum(CASE WHEN d.start_ms IS NOT NULL THEN least(g.end_ms, d.end_ms) - greatest(g.start_ms, d.start_ms) END), 0)
        >= any_value(g.end_ms - g.start_ms) AS covered
    FROM g LEFT JOIN det_raw d ON d.video_id = g.video_id AND d.end_ms > g.start_ms AND d.start_ms < g.end_ms
    GROUP BY rid""")
def _coverage(d: Inputs):
    out = intervals.gt_coverage(d.gt_raw(), d.det_raw())
    return rounded(out.withColumn("overlap_ms", F.col("overlap_ms").cast("bigint")))


METRICS = """, tot AS (SELECT video_id, CAST(sum(gt) AS BIGINT) AS gt_ms, CAST(sum(det) AS BIGINT) AS det_ms,
      CAST(sum(ng) AS BIGINT) AS n_gt, CAST(sum(nd) AS BIGINT) AS n_det FROM (
        SELECT video_id, end_ms - start_ms AS gt, 0 AS det, 1 AS ng, 0 AS nd FROM gt_raw
        UNION ALL SELECT video_id, 0, end_ms - start_ms, 0, 1 FROM det_raw) GROUP BY 1),
    met AS (SELECT video_id, n_gt, n_det, gt_ms, det_ms, coalesce(inter_ms, 0) AS inter_ms,
      CASE WHEN n_det = 0 THEN 1.0 WHEN n_gt = 0 THEN 0.0 WHEN det_ms > 0 THEN inter_ms / det_ms::DOUBLE ELSE 0 END AS p,
      CASE WHEN n_gt = 0 THEN 1.0 WHEN n_det = 0 THEN 0.0 WHEN gt_ms > 0 THEN inter_ms / gt_ms::DOUBLE ELSE 0 END AS r,
      CASE WHEN n_gt = 0 OR n_det = 0 THEN 0.0 ELSE inter_ms / (gt_ms + det_ms - inter_ms)::DOUBLE END AS iou
      FROM tot LEFT JOIN inter USING (video_id))
"""


@query("segment_metrics", "gt_raw det_raw", SWEEP.rstrip() + METRICS + """
    SELECT video_id, n_gt, n_det, gt_ms, det_ms, inter_ms, round(CAST(p AS DOUBLE), 6) AS "precision",
      round(CAST(r AS DOUBLE), 6) AS recall, round(CAST(iou AS DOUBLE), 6) AS iou, false AS true_negative FROM met""")
def _metrics(d: Inputs):
    return rounded(intervals.segment_metrics(d.det_raw(), d.gt_raw()))


MERGED = """, o AS (SELECT *, max(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, votes
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
    n AS (SELECT *, sum(CASE WHEN start_ms - reach <= 2000 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id
        ORDER BY start_ms, end_ms, votes ROWS UNBOUNDED PRECEDING) AS grp FROM o)
    SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(votes) AS votes FROM n GROUP BY video_id, grp"""


@query("merge_intervals", "gt_raw", MERGED.format(src="gt_raw"))
def _merge(d: Inputs):
    return intervals.merge_intervals(d.gt_raw())


# -- runs and audits -------------------------------------------------------------

RUNS = """, runs AS (SELECT video_id, CAST(min(window_idx) AS BIGINT) AS start_idx, CAST(max(window_idx) AS BIGINT) AS end_idx,
      CAST(count(*) AS BIGINT) AS length FROM (
        SELECT video_id, window_idx, window_idx - row_number() OVER (PARTITION BY video_id ORDER BY window_idx) AS g
        FROM predictions WHERE label = 1) GROUP BY video_id, g)
"""
PER_VIDEO = """, pv AS (SELECT video_id, count(*) AS n, count_if(label = 1)::BIGINT AS pos,
      count_if(label = 1) / count(*)::DOUBLE AS rate FROM predictions GROUP BY 1)
"""


@query("label_runs", "predictions", RUNS + "SELECT * FROM runs")
def _runs(d: Inputs):
    return W.label_runs(d.labelled_windows())


@query("temporal_consistency", "predictions", """
    SELECT video_id, window_idx, CAST(CASE WHEN label = 1 AND coalesce(p, 0) <> 1 AND coalesce(n, 0) <> 1 AND cnt > 1
      THEN -1 ELSE label END AS INT) AS label
    FROM (SELECT *, lag(label) OVER w AS p, lead(label) OVER w AS n, count(*) OVER (PARTITION BY video_id) AS cnt
          FROM predictions WINDOW w AS (PARTITION BY video_id ORDER BY window_idx))""")
def _consistency(d: Inputs):
    return W.temporal_consistency(d.labelled_windows())


@query("exclude_label", "predictions", """
    SELECT video_id, window_idx, label FROM (SELECT *, lag(label) OVER w AS p, lead(label) OVER w AS n
          FROM predictions WINDOW w AS (PARTITION BY video_id ORDER BY window_idx))
    WHERE NOT (label = 1 AND coalesce(p, 0) <> 1 AND coalesce(n, 0) <> 1)""")
def _exclude(d: Inputs):
    return cleaning.exclude_label(W.temporal_consistency(d.labelled_windows()))


@query("window_position", "predictions", """
    SELECT video_id, window_idx, round(window_idx / greatest(max(window_idx) OVER (PARTITION BY video_id), 1)::DOUBLE, 6)
      AS position FROM predictions""")
def _position(d: Inputs):
    return rounded(W.window_position(d.labelled_windows()).select("video_id", "window_idx", "position"))


@query("dataset_overview", "predictions", PER_VIDEO + """
    SELECT count(*) AS n_videos, CAST(sum(n) AS BIGINT) AS n_windows, CAST(sum(pos) AS BIGINT) AS n_positive,
      CAST(sum(n) - sum(pos) AS BIGINT) AS n_negative, round(sum(pos) / sum(n)::DOUBLE, 6) AS base_rate,
      round((sum(n) - sum(pos)) / sum(pos)::DOUBLE, 6) AS imbalance FROM pv""")
def _overview(d: Inputs):
    return rounded(audit.dataset_overview(d.labelled_windows()))


RUN_STATS = """(SELECT count(*) AS n_runs, round(avg(length * 5.0::DOUBLE), 6) AS mean_sec,
      median(length * 5.0::DOUBLE) AS median_sec, count_if(length = 1)::BIGINT AS n_short_runs FROM runs)"""
BOUNDARY = """(SELECT CAST(sum(least(length, 2)) AS BIGINT) AS n_boundary, CAST(sum(length) AS BIGINT) AS n_positive,
      round(sum(least(length, 2)) / sum(length)::DOUBLE, 6) AS boundary_share FROM runs)"""


@query("run_stats", "predictions", RUNS + f"SELECT * FROM {RUN_STATS}")
def _run_stats(d: Inputs):
    return rounded(audit.run_stats(d.labelled_windows()))


@query("boundary_windows", "predictions", RUNS + f"""
    SELECT *, CASE WHEN boundary_share > 0.35 THEN 'HIGH' WHEN boundary_share > 0.2 THEN 'Moderate' ELSE 'Low' END AS noise
    FROM {BOUNDARY}""")
def _boundary(d: Inputs):
    return rounded(audit.boundary_windows(d.labelled_windows()))


PROFILE = """(SELECT count(*) AS n_videos, count_if(pos = 0)::BIGINT AS n_zero, count_if(rate > 0.4)::BIGINT AS n_over_labelled,
      count_if(pos BETWEEN 1 AND 2)::BIGINT AS n_sparse, round(avg(rate), 6) AS mean_rate FROM pv)"""


@query("positive_rate_profile", "predictions", PER_VIDEO + f"SELECT * FROM {PROFILE}")
def _profile(d: Inputs):
    return rounded(audit.positive_rate_profile(d.labelled_windows()))


@query("over_labelled_videos", "predictions", PER_VIDEO + """
    SELECT video_id, n AS n_windows, pos AS n_positive, round(rate, 6) AS rate FROM pv WHERE rate > 0.4
    ORDER BY pos / n::DOUBLE DESC, video_id LIMIT 20""")
def _over(d: Inputs):
    return rounded(audit.over_labelled_videos(d.labelled_windows()))


@query("histogram_rate", "predictions", PER_VIDEO + """
    SELECT CAST(b AS INT) AS bin, round(b * 0.1::DOUBLE, 6) AS bin_lo, count(pv.rate) AS n
    FROM (SELECT unnest(range(0, 10)) AS b) LEFT JOIN pv ON least(CAST(floor((rate - 0.0::DOUBLE) / 0.1::DOUBLE) AS INT), 9) = b
    GROUP BY b""")
def _hist_rate(d: Inputs):
    return audit.histogram(audit.per_video_counts(d.labelled_windows()), "rate", 10, 0.0, 1.0)


@query("histogram_run_length", "predictions", RUNS + """
    , h AS (SELECT least(max(length * 5.0::DOUBLE), 300.0) / 12 AS w FROM runs)
    SELECT CAST(b AS INT) AS bin, round(b * any_value(w), 6) AS bin_lo, count(length) AS n
    FROM (SELECT unnest(range(0, 12)) AS b) CROSS JOIN h LEFT JOIN runs ON least(CAST(floor(length * 5.0::DOUBLE / w) AS INT), 11) = b
    GROUP BY b""")
def _hist_runs(d: Inputs):
    seconds = W.label_runs(d.labelled_windows()).select((F.col("length") * 5.0).alias("sec"))
    return audit.histogram_to_max(seconds, "sec", 12, 300.0)


@query("histogram_duration", "segments_raw cache", AUDIT + """
    , h AS (SELECT least(max(dur_ms / 1000.0::DOUBLE), 600.0) / 12 AS w FROM audit WHERE in_cache)
    SELECT CAST(b AS INT) AS bin, round(b * any_value(w), 6) AS bin_lo, count(dur_ms) AS n
    FROM (SELECT unnest(range(0, 12)) AS b) CROSS JOIN h
      LEFT JOIN audit ON in_cache AND least(CAST(floor(dur_ms / 1000.0::DOUBLE / w) AS INT), 11) = b
    GROUP BY b""")
def _hist_duration(d: Inputs):
    rows = audited(d).filter("in_cache").select((F.col("dur_ms") / 1000.0).alias("sec"))
    return audit.histogram_to_max(rows, "sec", 12, 600.0)


@query("vote_buckets", "segments_raw cache", AUDIT + """
    SELECT count_if(votes BETWEEN 3 AND 5)::BIGINT AS v3_5, count_if(votes BETWEEN 6 AND 10)::BIGINT AS v6_10,
      count_if(votes BETWEEN 11 AND 20)::BIGINT AS v11_20, count_if(votes BETWEEN 21 AND 50)::BIGINT AS v21_50,
      count_if(votes > 50)::BIGINT AS v51_up FROM audit WHERE in_cache""")
def _buckets(d: Inputs):
    return audit.vote_buckets(audited(d))


@query("vote_threshold_sim", "segments_raw cache", AUDIT + """
    , t AS (SELECT unnest([3, 5, 8, 10, 15, 20]) AS min_votes),
    x AS (SELECT CAST(min_votes AS INT) AS min_votes, count_if(votes >= min_votes)::BIGINT AS segments,
        count(DISTINCT CASE WHEN votes >= min_votes THEN video_id END) AS videos,
        count_if(votes >= min_votes) * 100.0::DOUBLE / count(*) AS seg_pct,
        count(DISTINCT CASE WHEN votes >= min_votes THEN video_id END) * 100.0::DOUBLE / (SELECT count(*) FROM cache) AS vid_pct
      FROM audit, t WHERE in_cache GROUP BY min_votes)
    SELECT min_votes, segments, videos, round(seg_pct, 6) AS seg_pct, round(vid_pct, 6) AS vid_pct,
      CASE WHEN min_votes = 3 THEN 'current' WHEN seg_pct >= 70 AND vid_pct >= 70 THEN 'safe to use'
        WHEN seg_pct >= 50 THEN 'worth trying' ELSE 'too aggressive' END AS recommendation FROM x""")
def _threshold_sim(d: Inputs):
    return rounded(audit.vote_threshold_sim(audited(d), d.cache()))


VOTE_STATS = """(SELECT count(*) AS total_segments, count_if(in_cache)::BIGINT AS cached_segments,
      round(avg(CASE WHEN in_cache THEN votes END), 6) AS mean_votes,
      CAST(median(CASE WHEN in_cache THEN votes END) AS DOUBLE) AS median_votes,
      round(count_if(in_cache AND votes < 8) * 100.0::DOUBLE / count_if(in_cache), 6) AS pct_low_votes FROM audit)"""


@query("vote_stats", "segments_raw cache", AUDIT + f"SELECT * FROM {VOTE_STATS}")
def _vote_stats(d: Inputs):
    return rounded(audit.vote_stats(audited(d)))


@query("audit_recommendations", "segments_raw cache predictions", AUDIT.rstrip() + RUNS.rstrip() + PER_VIDEO + f"""
    , f AS (SELECT * FROM {RUN_STATS} r, {BOUNDARY} b, {PROFILE} p, {VOTE_STATS} v),
    flags AS (SELECT unnest(list_filter([CASE WHEN boundary_share > 0.35 THEN 'boundary_noise' END,
      CASE WHEN n_short_runs / n_runs::DOUBLE > 0.15 THEN 'short_runs' END,
      CASE WHEN n_over_labelled / n_videos::DOUBLE > 0.05 THEN 'over_labelled' END,
      CASE WHEN pct_low_votes > 40 THEN 'low_votes_significant' WHEN pct_low_votes > 20 THEN 'low_votes_moderate' END],
      lambda x: x IS NOT NULL)) AS flag FROM f)
    SELECT flag FROM flags UNION ALL SELECT 'none' WHERE NOT EXISTS (SELECT 1 FROM flags)""")
def _recommend(d: Inputs):
    return audit.audit_recommendations(audit.label_audit(d.labelled_windows(), audited(d)))


ZERO = "len(list_filter({}, lambda x: x <> 0)) = 0"


@query("embedding_audit", "window_features", f"""
    , pv AS (SELECT video_id, count(*) AS n, count_if({ZERO.format('audio_emb')}) AS za, bool_and({ZERO.format('text_emb')}) AS zt
      FROM window_features GROUP BY 1),
    c AS (SELECT count(*) AS n_videos, CAST(sum(n) AS BIGINT) AS n_windows, count_if(za = n)::BIGINT AS zero_audio_videos,
      count_if(za > 0 AND za < n)::BIGINT AS partial_audio_videos, CAST(sum(za) AS BIGINT) AS zero_audio_windows,
      count_if(zt)::BIGINT AS zero_text_videos FROM pv)
    SELECT *, round(zero_audio_videos * 100.0::DOUBLE / n_videos, 6) AS zero_audio_pct,
      round(partial_audio_videos * 100.0::DOUBLE / n_videos, 6) AS partial_audio_pct,
      round(zero_audio_windows * 100.0::DOUBLE / n_windows, 6) AS zero_window_pct,
      round(zero_text_videos * 100.0::DOUBLE / n_videos, 6) AS zero_text_pct FROM c""")
def _embedding_audit(d: Inputs):
    return rounded(audit.embedding_audit(d.window_features()))


@query("constant_embedding_videos", "window_features", """
    , f AS (SELECT video_id, min_by(text_emb, window_idx) AS first FROM window_features GROUP BY 1)
    SELECT video_id, count(*) AS n_windows FROM window_features JOIN f USING (video_id) GROUP BY 1
    HAVING bool_and(len(list_filter(list_zip(text_emb, first),
      lambda x: abs(x[1] - x[2]) > 1e-8::DOUBLE + 1e-5::DOUBLE * abs(x[2]))) = 0)""")
def _constant(d: Inputs):
    return audit.constant_embedding_videos(d.window_features())


@query("class_counts", "predictions", """
    SELECT count_if(label = 1)::BIGINT AS n_pos, count_if(label = 0)::BIGINT AS n_neg,
      round(count_if(label = 0) / count_if(label = 1)::DOUBLE, 6) AS ratio FROM predictions""")
def _classes(d: Inputs):
    return rounded(audit.class_counts(d.labelled_windows()))


@query("flagged_videos", "predictions", "SELECT video_id, bool_or(label = 1) AS has_segment FROM predictions GROUP BY 1")
def _flagged(d: Inputs):
    return audit.flagged_videos(d.labelled_windows())


# -- evaluation flow ----------------------------------------------------------------


@query("detection_summary", "gt_raw det_raw cache", SWEEP.rstrip() + METRICS + """
    , cov AS (SELECT g.video_id, g.rid, 2 * coalesce(sum(CASE WHEN d.start_ms IS NOT NULL THEN least(g.end_ms, d.end_ms) - greatest(g.start_ms, d.start_ms) END), 0)
        >= any_value(g.end_ms - g.start_ms) AS covered
      FROM (SELECT *, row_number() OVER () AS rid FROM gt_raw) g LEFT JOIN det_raw d ON d.video_id = g.video_id
        AND d.end_ms > g.start_ms AND d.start_ms < g.end_ms GROUP BY 1, 2),
    st AS (SELECT c.video_id, CASE WHEN zero_audio THEN 'error' WHEN NOT has_votes THEN 'no_captions'
        WHEN t.video_id IS NULL THEN 'true_negative' ELSE 'with_segments' END AS status
      FROM cache c LEFT JOIN tot t USING (video_id)),
    m AS (SELECT met.* FROM met JOIN st USING (video_id) WHERE status = 'with_segments'),
    a AS (SELECT avg(p) AS p, avg(r) AS r, avg(iou) AS iou, sum(n_gt) AS n_gt,
        coalesce(sum(CASE WHEN n_gt = 0 THEN n_det END), 0) AS fp FROM m),
    k AS (SELECT count_if(covered) AS n FROM cov JOIN st USING (video_id) WHERE status = 'with_segments'),
    s AS (SELECT count(*) AS n_total, count_if(status = 'error')::BIGINT AS n_errors,
        count_if(status = 'no_captions')::BIGINT AS n_no_captions, count_if(status = 'true_negative')::BIGINT AS n_true_negative,
        count_if(status = 'with_segments')::BIGINT AS n_with_segments FROM st)
    SELECT s.*, round(CAST(p AS DOUBLE), 6) AS avg_precision, round(CAST(r AS DOUBLE), 6) AS avg_recall,
      round(CAST(iou AS DOUBLE), 6) AS avg_iou, CAST(n_gt AS BIGINT) AS n_gt, CAST(fp AS BIGINT) AS n_false_pos,
      CAST(k.n AS BIGINT) AS n_covered, round(k.n * 100.0::DOUBLE / n_gt, 6) AS covered_pct,
      CASE WHEN r < 0.3 THEN 'low' WHEN r < 0.5 THEN 'moderate' ELSE 'ok' END AS recall_level,
      CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.5 THEN 'moderate' ELSE 'ok' END AS precision_level,
      iou >= 0.4 AS decent_iou FROM s, a, k""")
def _summary(d: Inputs):
    cache = d.cache()
    both = d.gt_raw().select("video_id").union(d.det_raw().select("video_id"))
    status = cleaning.detection_status(cache, cache.filter("has_votes"), both, cache.filter("zero_audio"))
    return rounded(evaluate.detection_summary(status, d.det_raw(), d.gt_raw()))
