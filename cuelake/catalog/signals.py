"""Signal queries: H5-H16, E11, and the streaming operators S1-S9."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


from cuelake.catalog.registry import query, rounded
from cuelake.catalog.transcripts import (
    POOLED, pooled_vectors, sql_score_cue, sql_score_text,
)
from cuelake.fixtures import Inputs
from cuelake.operators import intervals, mldata as M, signal as S, windows as W
from cuelake.session import new_shared_path
from cuelake.streaming import online, states



DAY_US = 86_400_000_000


def wide(df: DataFrame, column: str, n: int, prefix: str) -> DataFrame:
    """The first n entries of an array as rounded columns."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, *[F.round(F.get(column, F.lit(i)), 6).alias(f"{prefix}{i}") for i in range(n)])


@query("frames_for_windows", "frame_windows frames", """
    SELECT w.video_id, w.window_idx, f.frame_idx FROM frame_windows w JOIN frames f ON f.video_id = w.video_id
      AND f.frame_idx >= w.t_start_ms // 1000 - 30 AND f.frame_idx < w.t_start_ms // 1000""")
def _frames(d: Inputs):
    return S.frames_for_windows(d.frame_windows(), d.frames()).select("video_id", "window_idx", "frame_idx")


@query("frame_buffer", "frame_windows frames", """
    , g AS (SELECT w.video_id, w.window_idx, w.t_start_ms // 1000 - 30 + k AS frame_idx, k FROM frame_windows w, (SELECT unnest(range(0, 30)) AS k))
    SELECT g.video_id, g.window_idx, CAST(g.k AS INT) AS k, round(coalesce(f.coeffs[1], 0), 6) AS c0,
      round(coalesce(list_sum(f.coeffs), 0), 6) AS total
    FROM g LEFT JOIN frames f ON f.video_id = g.video_id AND f.frame_idx = g.frame_idx""")
def _buffer(d: Inputs):
    rows = S.frame_buffer(d.frame_windows(), d.frames()).select(
        "video_id", "window_idx", F.posexplode("buffer").alias("k", "f")
    )
    total = F.aggregate("f", F.lit(0.0), lambda a, b: a + b)
    return rows.select("video_id", "window_idx", "k", F.round(F.get("f", F.lit(0)), 6).alias("c0"), F.round(total, 6).alias("total"))


@query("mean_pool", "frame_windows frames", """
    , h AS (SELECT w.video_id, w.window_idx, f.coeffs FROM frame_windows w LEFT JOIN frames f ON f.video_id = w.video_id
      AND f.frame_idx >= w.t_start_ms // 1000 - 30 AND f.frame_idx < w.t_start_ms // 1000)
    SELECT video_id, window_idx, """ + ", ".join(
        f"round(coalesce(sum(coeffs[{i + 1}]), 0) / 30, 6) AS m{i}" for i in range(13)) + " FROM h GROUP BY 1, 2")
def _pool(d: Inputs):
    buffered = S.frame_buffer(d.frame_windows(), d.frames())
    return wide(buffered.select("video_id", "window_idx", S.mean_pool(F.col("buffer")).alias("m")), "m", 13, "m")


@query("pad_trim", "frames", """
    SELECT video_id, frame_idx, round(v[1], 6) AS first, round(v[20], 6) AS last, CAST(len(v) AS INT) AS size
    FROM (SELECT video_id, frame_idx, CASE WHEN frame_idx % 2 = 0 THEN spectrum[45:64]
      ELSE list_concat(list_transform(range(0, 7), lambda x: 0.0::DOUBLE), coeffs) END AS v FROM frames)""")
def _pad_trim(d: Inputs):
    flat = F.when(F.col("frame_idx") % 2 == 0, F.col("spectrum")).otherwise(F.col("coeffs"))
    out = d.frames().withColumn("v", S.pad_trim(flat, 20))
    return out.select(
        "video_id", "frame_idx", F.round(F.get("v", F.lit(0)), 6).alias("first"),
        F.round(F.get("v", F.lit(19)), 6).alias("last"), F.size("v").alias("size"),
    )


def mfcc_sql(n_bins: int) -> str:
    bank = ", ".join(f"({m}, {k}, {w!r}::DOUBLE)" for m, k, w in S.mel_filterbank(n_bins))
    return f"""
    , bank(m, k, w) AS (VALUES {bank}),
    pw AS (SELECT video_id, frame_idx, k, pow(10.0::DOUBLE, spectrum[k + 1] / 10) AS p FROM frames, (SELECT unnest(range(0, {n_bins})) AS k)),
    en AS (SELECT video_id, frame_idx, m, sum(p * w) AS e FROM pw JOIN bank USING (k) GROUP BY 1, 2, 3),
    fr AS (SELECT video_id, frame_idx, m, ln(greatest(coalesce(e, 0), 1e-10::DOUBLE)) AS le
      FROM (SELECT video_id, frame_idx, m FROM frames, (SELECT unnest(range(0, {S.N_MEL})) AS m)) LEFT JOIN en USING (video_id, frame_idx, m)),
    dc AS (SELECT video_id, frame_idx, n, sum(le * cos(pi() * n * (2 * m + 1) / (2 * {S.N_MEL}))) AS c
      FROM fr, (SELECT unnest(range(0, 13)) AS n) GROUP BY 1, 2, 3)
    SELECT video_id, frame_idx, CAST(n AS INT) AS n, round(c, 6) + 0.0 AS c FROM dc"""


@query("mfcc_from_spectrum", "frames", mfcc_sql(64))
def _mfcc(d: Inputs):
    out = S.mfcc_from_spectrum(d.frames(), 64)
    return out.select("video_id", "frame_idx", F.posexplode("mfcc").alias("n", "c")).select(
        "video_id", "frame_idx", "n", (F.round("c", 6) + 0.0).alias("c")
    )


MEAN = "list_avg(list_transform(st.hist[1:greatest(1, len(st.hist) - 2)], lambda h: h[i]))"
DELTAS = f"""
    , st(video_id, frame_idx, delta, hist) AS (
      SELECT video_id, CAST(-1 AS INT), CAST(NULL AS DOUBLE[]), CAST([] AS DOUBLE[][]) FROM (SELECT DISTINCT video_id FROM frames)
      UNION ALL SELECT f.video_id, f.frame_idx, x.d, list_append(st.hist, x.d)[greatest(1, len(st.hist) - 58):]
      FROM st JOIN frames f ON f.video_id = st.video_id AND f.frame_idx = st.frame_idx + 1,
        LATERAL (SELECT CASE WHEN len(st.hist) < 5 THEN f.coeffs ELSE list_transform(range(1, 14),
          lambda i: (f.coeffs[i] - {MEAN}) / (abs({MEAN}) + 1)) END AS d) x),
    ag AS (SELECT video_id, frame_idx, delta, len(hist) AS n,
        list_transform(range(1, 14), lambda i: list_avg(list_transform(hist[greatest(1, len(hist) - 4):], lambda h: h[i]))) AS a,
        list_transform(range(1, 14), lambda i: list_avg(list_transform(hist[1:len(hist) - 5], lambda h: h[i]))) AS b
      FROM st WHERE frame_idx >= 0)
    SELECT video_id, frame_idx, CASE WHEN n < 8 THEN 0.0::DOUBLE ELSE round((1 - greatest(-1, least(1, list_dot_product(a, b)
        / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))))) / 2, 6) END AS anomaly,
      {", ".join(f"round(delta[{i + 1}], 6) AS d{i}" for i in range(13))} FROM ag"""


@query("delta_mfcc", "frames", DELTAS, recursive=True)
def _delta(d: Inputs):
    return rounded(wide(S.delta_mfcc(d.frames()), "delta", 13, "d"))


RECENT = ", ".join(f"avg(coeffs[{i + 1}]) OVER r AS n{i}, avg(coeffs[{i + 1}]) OVER o AS b{i}" for i in range(13))
DOT = {a + b: " + ".join(f"{a}{i} * {b}{i}" for i in range(13)) for a, b in (("n", "n"), ("b", "b"), ("n", "b"))}


@query("anomaly_score", "frames", f"""
    , s AS (SELECT video_id, frame_idx, {RECENT}, count(*) OVER k AS known FROM frames
      WINDOW r AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
        o AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 59 PRECEDING AND 5 PRECEDING),
        k AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT video_id, frame_idx, CASE WHEN known < 8 THEN 0.0::DOUBLE ELSE round((1 - greatest(-1, least(1, ({DOT['nb']})
      / (sqrt({DOT['nn']}) * sqrt({DOT['bb']}))))) / 2, 6) END AS anomaly FROM s""")
def _anomaly(d: Inputs):
    return rounded(S.anomaly_score(d.frames(), "coeffs").select("video_id", "frame_idx", "anomaly"))


def pixels(d: Inputs):
    """Pixels made of consecutive spectrum values scaled to 0-255; the last one starts over."""
    v = lambda x: F.floor((F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) + 1) * 127.5)
    s = F.col("spectrum")
    return d.frames().select(
        "video_id", "frame_idx",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(21)), lambda i: F.struct(
            v(F.get(s, i * 3)).alias("r"), v(F.get(s, (i * 3 + 1) % 64)).alias("g"), v(F.get(s, (i * 3 + 2) % 64)).alias("b"),
        ))).alias("p"),
    ).select("video_id", "frame_idx", "p.*")


PIXEL = "CAST(least(floor(floor((least(greatest(spectrum[(k * 3 + {c} - 1) % 64 + 1], -1.0), 1.0) + 1) * 127.5) / 32), 7) AS INT)"


@query("color_histogram", "frames", f"""
    , px AS (SELECT video_id, frame_idx, c, CASE c WHEN 0 THEN {PIXEL.format(c=1)} WHEN 1 THEN {PIXEL.format(c=2)} ELSE {PIXEL.format(c=3)} END AS bin
      FROM frames, (SELECT unnest(range(0, 22)) AS k), (SELECT unnest(range(0, 3)) AS c))
    SELECT f.video_id, f.frame_idx, CAST(c * 8 + b AS INT) AS slot, round(count(px.bin) / 22.0::DOUBLE, 6) AS share
    FROM (SELECT video_id, frame_idx, c, b FROM frames, (SELECT unnest(range(0, 3)) AS c), (SELECT unnest(range(0, 8)) AS b)) f
    LEFT JOIN px ON px.video_id = f.video_id AND px.frame_idx = f.frame_idx AND px.c = f.c AND px.bin = f.b GROUP BY ALL""".replace("CAST(c * 8 + b", "CAST(f.c * 8 + f.b"))
def _color(d: Inputs):
    out = S.color_histogram(pixels(d))
    return out.select("video_id", "frame_idx", F.posexplode("hist").alias("slot", "share")).withColumn("share", F.round("share", 6))


@query("band_profile", "frames", """
    , b AS (SELECT video_id, frame_idx, list_sum(list_transform(spectrum[1:10], lambda x: (x + 4) * 32)) / 10 AS low,
      list_sum(list_transform(spectrum[11:64], lambda x: (x + 4) * 32)) / 54 AS high FROM frames)
    SELECT video_id, frame_idx, round(low, 6) AS low, round(high, 6) AS high,
      round(CASE WHEN low + high > 0 THEN low / (low + high) ELSE 0.5 END, 6) AS ratio FROM b""")
def _bands(d: Inputs):
    scaled = d.frames().withColumn("spectrum", F.transform("spectrum", lambda x: (x + 4) * 32))
    return rounded(S.band_profile(scaled).select("video_id", "frame_idx", "low", "high", "ratio"))


def samples(d: Inputs):
    """Half the grid spacing of ``av_windows``: about one sample in two seconds."""
    return d.av_windows().withColumn("time_ms", (F.col("win_idx") * 2000 + F.col("time_ms") % 1000).cast("bigint"))


@query("av_windows", "av_windows", """
    , s AS (SELECT video_id, win_idx, CAST(win_idx * 2000 + time_ms % 1000 AS BIGINT) AS t, hist, low, high, ratio FROM av_windows),
    n AS (SELECT s.*, (SELECT min(x.t) FROM s x WHERE x.video_id = s.video_id AND x.t >= s.t + 5000) AS nxt,
      min(t) OVER (PARTITION BY video_id) AS t0 FROM s),
    a(video_id, t, nxt, t0) AS (SELECT video_id, t, nxt, t0 FROM n WHERE t = t0
      UNION ALL SELECT n.video_id, n.t, n.nxt, n.t0 FROM a JOIN n ON n.video_id = a.video_id AND n.t = a.nxt)
    SELECT a.video_id, a.t AS time_ms, count(*) AS n_samples, round(avg(low), 6) AS low, round(avg(high), 6) AS high,
      round(avg(ratio), 6) AS ratio, round(avg(hist[1]), 6) AS h0, round(avg(hist[24]), 6) AS h23
    FROM a JOIN s ON s.video_id = a.video_id AND s.t <= a.nxt AND (s.t > a.t OR (s.t = a.t AND a.t = a.t0))
    GROUP BY a.video_id, a.t""", recursive=True)
def _av_windows(d: Inputs):
    out = S.av_windows(samples(d))
    return rounded(out.select(
        "video_id", "time_ms", "n_samples", "low", "high", "ratio",
        F.get("hist", F.lit(0)).alias("h0"), F.get("hist", F.lit(23)).alias("h23"),
    ))


def _upper(expr: str) -> str:
    return f"list_sort(list({expr}) OVER w)[CAST(floor(len(list({expr}) OVER w) / 2) AS INT) + 1]"


BASE = ", ".join(f"coalesce({_upper(f'hist[{i + 1}]')}, 0.0) AS b{i}" for i in range(24)) + (
    f", coalesce({_upper('low')}, 0.0) AS base_low, coalesce({_upper('high')}, 0.0) AS base_high, coalesce({_upper('ratio')}, 0.5) AS base_ratio"
)
BASELINE = f""", base AS (SELECT *, {BASE} FROM av_windows
    WINDOW w AS (PARTITION BY video_id ORDER BY win_idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
"""


@query("av_baseline", "av_windows", BASELINE + """
    SELECT video_id, win_idx, """ + ", ".join(f"round(b{i}, 6) AS b{i}" for i in range(24)) + """,
      round(base_low, 6) AS base_low, round(base_high, 6) AS base_high, round(base_ratio, 6) AS base_ratio FROM base""")
def _av_baseline(d: Inputs):
    out = S.av_baseline(d.av_windows()).select("video_id", "win_idx", "base_low", "base_high", "base_ratio", "base_hist")
    return rounded(wide(out, "base_hist", 24, "b"))


CHI = " + ".join(
    f"CASE WHEN hist[{i + 1}] + b{i} > 0 THEN pow(hist[{i + 1}] - b{i}, 2) / (hist[{i + 1}] + b{i}) ELSE 0 END" for i in range(24)
)
SCORED = BASELINE.rstrip() + f""",
    sc AS (SELECT *, least(({CHI}) / 2, 1.0) AS visual, least((abs(ratio - base_ratio) + abs(low + high - base_low - base_high)
      / greatest(low + high, base_low + base_high, 1.0)) / 2, 1.0) AS audio FROM base),
    fl AS (SELECT *, visual * 0.6 + audio * 0.4 AS combined FROM sc)
"""


@query("av_scores", "av_windows", SCORED + """
    SELECT video_id, win_idx, round(visual, 6) AS visual, round(audio, 6) AS audio, round(combined, 6) AS combined,
      combined >= 0.2 AND win_idx >= 6 AS flagged FROM fl""")
def _av_scores(d: Inputs):
    out = S.av_scores(S.av_baseline(d.av_windows()), threshold=0.2)
    return rounded(out.select("video_id", "win_idx", "visual", "audio", "combined", "flagged"))


@query("merge_flags", "av_windows", SCORED.rstrip() + """,
    k AS (SELECT video_id, time_ms, CASE WHEN time_ms - lag(time_ms) OVER w <= 15000 THEN 0 ELSE 1 END AS fresh FROM fl
      WHERE combined >= 0.2 AND win_idx >= 6 WINDOW w AS (PARTITION BY video_id ORDER BY time_ms)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY time_ms ROWS UNBOUNDED PRECEDING) AS grp FROM k)
    SELECT * FROM (SELECT video_id, CAST(greatest(0, min(time_ms) - 1000) AS BIGINT) AS start_ms, max(time_ms) + 7000 AS end_ms,
      count(*) AS n_windows, 'av-analysis' AS source FROM g GROUP BY video_id, grp) WHERE end_ms - start_ms >= 12000""")
def _flags(d: Inputs):
    scored = S.av_scores(S.av_baseline(d.av_windows()), threshold=0.2)
    return W.merge_flags(scored.filter("flagged"))


G = [f"list_sum(vec[{i * 16 + 1}:{i * 16 + 16}])" for i in range(8)]
RELU = "greatest({}, 0)"
HEUR = f"""(SELECT *, {RELU.format('0.8*g0+0.6*g4-0.5')} AS hi, {RELU.format('0.65*g1+0.5*g5-0.5')} AS hc, {RELU.format('0.65*g2+0.5*g6-0.5')} AS ho,
    {RELU.format('0.45*g3+0.35*g7-0.8')} AS hp, {RELU.format('0.7*lo+0.25*up+0.15*g0-0.8')} AS ha FROM gs)"""


@query("heuristic_score", "cues frames", POOLED.rstrip() + f""",
    au AS (SELECT CAST(replace(video_id, 'f', '') AS BIGINT) AS n, {", ".join(f"avg(coeffs[{i + 1}]) AS a{i}" for i in range(13))} FROM frames GROUP BY 1),
    gs AS (SELECT video_id, slot, {", ".join(f"CAST({g} AS DOUBLE) AS g{i}" for i, g in enumerate(G))},
      3 * (a0+a1+a2+a3+a4+a5) AS lo, 3 * (a6+a7+a8+a9+a10+a11+a12) AS up FROM pooled JOIN au ON n = slot % 10),
    z AS (SELECT *, {RELU.format('9.6*hi-0.3')} AS z1, {RELU.format('6.4*hc+6.4*ho-1.1')} AS z2, {RELU.format('4*ha-0.3')} AS z3,
      {RELU.format('2.8*ha+1.2*hp-1.5')} AS z4 FROM {HEUR})
    SELECT video_id, slot, round(1 / (1 + exp(-(8*z1+6.4*z2+3.6*z3+5.2*z4-1.6)::DOUBLE)), 6) AS score FROM z""")
def _heuristic(d: Inputs):
    means = d.frames().groupBy("video_id").agg(
        *[F.avg(F.get("coeffs", F.lit(i))).alias(f"a{i}") for i in range(13)]
    ).select(
        F.expr("CAST(replace(video_id, 'f', '') AS BIGINT)").alias("n"),
        F.array(*[F.col(f"a{i}") * 3 for i in range(13)]).alias("mfcc"),
    )
    joined = pooled_vectors(d).withColumn("n", F.col("slot") % 10).join(means, "n")
    return rounded(joined.select("video_id", "slot", M.heuristic_score(F.col("keyword_vec"), F.col("mfcc")).alias("score")))


@query("blended_score", "playback gt_raw", """
    SELECT t.video_id, t.tick_id, round(any_value(ml) * 0.75 + any_value(anomaly) * 0.25, 6) AS blended,
      CASE WHEN count(s.start_ms) > 0 THEN 0.68::DOUBLE ELSE 0.85::DOUBLE END AS enter_at
    FROM playback t LEFT JOIN gt_raw s ON s.video_id = t.video_id AND t.t_ms BETWEEN s.start_ms AND s.end_ms GROUP BY 1, 2""")
def _blended(d: Inputs):
    placed = intervals.point_in_segments(d.playback(), d.gt_raw())
    return rounded(M.blended_score(placed).select("video_id", "tick_id", "blended", "enter_at"))


# -- online operators ---------------------------------------------------------------------


class Streamed(Inputs):
    """The same stateless views over a file stream of several ordered micro-batches."""

    #: What a table is ordered by, and into how many slices and files a slice it is written.
    ORDER = {"events": "unix_micros(CAST(ts AS TIMESTAMP))", "embeddings": "vec_id", "documents": "doc_id"}
    SLICES = 3
    FILES = 4

    def table(self, name: str) -> DataFrame:
        """A stream over ordered slices of the table, one per micro-batch.

        Slices are written one after the other, so that the file source, which goes by file
        times, meets them in order; ``closing`` rows come last.
        """
        whole = super().table(name)
        place = F.expr(self.ORDER[name])
        closing = self.closing(name, whole)
        # Streams without state have no late rows: as many files as there are cores, so that none idles in a micro-batch.
        files = max(self.FILES, self.spark.sparkContext.defaultParallelism) if type(self).closing is Streamed.closing else self.FILES
        cuts = whole.agg(F.percentile_approx(place, [(i + 1) / self.SLICES for i in range(self.SLICES - 1)], 1000)).first()[0] or []
        edges = [None, *cuts, None]
        path = new_shared_path(self.spark, f"stream-{name}")
        for low, high in zip(edges, edges[1:]):
            part = whole if low is None else whole.filter(place > low)
            part = part if high is None else part.filter(place <= high)
            part.repartition(files).write.mode("append").parquet(path)
        if closing is not None:
            closing.coalesce(1).write.mode("append").parquet(path)
        return self.spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", files).parquet(path)

    def closing(self, name: str, whole: DataFrame) -> DataFrame | None:
        return None


def closed(d: Inputs) -> Closed:
    return Closed(d.spark, d.directory)


class Closed(Streamed):
    """Streams with a last row far behind all others, so that every window closes in append mode."""

    MARK = "closing"

    def closing(self, name: str, whole: DataFrame) -> DataFrame | None:
        if name == "events":
            row = whole.agg((F.max(F.col("ts")) + F.expr("INTERVAL '365' DAY")).alias("ts")).select(
                F.lit(-1).alias("event_id"), "ts", F.lit(-1).alias("user_id"), F.lit(self.MARK).alias("event_type"),
                F.lit(1e9).alias("value"), F.lit("").alias("props"))
        elif name == "embeddings":
            row = whole.agg((F.max("vec_id") + 50 * self.FAR).alias("vec_id"))
        else:
            return None
        return row.select(*[(F.col(f.name) if f.name in row.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole.schema])

    #: By how many videos the closing row of ``embeddings`` is behind the last.
    FAR = 100_000

    @staticmethod
    def own(results: DataFrame, videos: DataFrame) -> DataFrame:
        """Results without the closing row's video."""
        return results.join(videos.select("video_id").distinct(), "video_id", "left_semi")


def streamed(d: Inputs) -> Streamed:
    return Streamed(d.spark, d.directory)


def video_number():
    return F.expr("CAST(substr(video_id, 2) AS BIGINT)")


AV_BINS = 24


@query("stream_av_windows", "av_windows", f"""
    SELECT video_id, (win_idx * 2000 + time_ms % 1000) // 5000 * 5000 AS start_ms, count(*) AS n_samples, round(avg(low), 6) AS low,
      round(avg(high), 6) AS high, round(avg(ratio), 6) AS ratio, {", ".join(f"round(avg(hist[{i + 1}]), 6) AS h{i}" for i in range(AV_BINS))}
    FROM av_windows GROUP BY 1, 2""")
def _stream_av(d: Inputs):
    # One session per video; a video's session starts 100 s after that of the one before.
    started = F.timestamp_seconds(video_number() * 100)
    out = online.run_append(online.stream_av_windows(samples(closed(d)).withColumn("session_start", started)))
    return rounded(wide(Closed.own(out, d.av_windows()).drop("session_start"), "hist", AV_BINS, "h"))


@query("stream_score_windows", "ticks", """
    SELECT video_id, w AS start_s, max(score) AS max_score, count(*) AS n
    FROM (SELECT video_id, score, unnest([0, 5, 10, 15, 20]) AS o, epoch_us(ts) // 5000000 * 5 AS s FROM ticks), LATERAL (SELECT s - o AS w)
    GROUP BY 1, 2""")
def _stream_sliding(d: Inputs):
    out = online.run_append(online.stream_score_windows(closed(d).ticks())).filter("video_id <> 'u-1'")
    return out.select("video_id", F.unix_seconds("window_start").alias("start_s"), "max_score", "n")


@query("stream_delta_mfcc", "frames", DELTAS, recursive=True)
def _stream_delta(d: Inputs):
    frames = closed(d).frames().withColumn("captured_at", F.timestamp_seconds(86_400 + video_number() * 50 + F.col("frame_idx")))
    out = online.run_append(states.stream_delta_mfcc(frames))
    return rounded(wide(Closed.own(out, d.frames()), "delta", 13, "d"))


def armed(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("enter_at", F.when(F.col("event_id") % 3 == 0, 0.4).otherwise(0.5))


#: Ticks are sparse here: spans of ten days hold few dozen rows of a key, and no key is ever idle for good.
SPARSE = {"wait_ms": 10 * 86_400_000, "idle_ms": 3650 * 86_400_000}


def tick_day():
    return F.floor(F.unix_micros("ts") / DAY_US).cast("bigint")


COUNTER = """
    , o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ts, event_id) AS rn,
      CASE WHEN event_id % 3 = 0 THEN 0.4 ELSE 0.5 END AS enter_at FROM ticks),
    st(video_id, rn, event_id, c, inside) AS (
      SELECT video_id, 0::BIGINT, -1::BIGINT, 0, false FROM (SELECT DISTINCT video_id FROM ticks)
      UNION ALL SELECT o.video_id, o.rn, o.event_id, k.c,
        CASE WHEN NOT st.inside AND k.c >= 2 THEN true WHEN st.inside AND o.score < 0.5 AND k.c = 0 THEN false ELSE st.inside END
      FROM st JOIN o ON o.video_id = st.video_id AND o.rn = st.rn + 1,
        LATERAL (SELECT CASE WHEN o.score >= o.enter_at THEN least(st.c + 1, 10) ELSE greatest(0, st.c - 1) END AS c) k)
    SELECT video_id, event_id, CAST(c AS INT) AS consecutive, inside FROM st WHERE rn > 0"""


@query("hysteresis_segments", "ticks", COUNTER, recursive=True)
def _hysteresis(d: Inputs):
    # Ticks are sparse here: a chunk of ten days holds few dozen rows per video.
    chunk = F.floor(tick_day() / 10)
    out = states.hysteresis_segments(armed(d.ticks()), ["ts", "event_id"], chunk)
    return out.select("video_id", "event_id", "consecutive", "inside")


@query("stream_hysteresis", "ticks", COUNTER, recursive=True)
def _stream_hysteresis(d: Inputs):
    return online.run_append(states.stream_hysteresis(armed(closed(d).ticks()), **SPARSE)).drop("score")


TWO_LEVEL = """SELECT video_id, event_id, coalesce(last_value(CASE WHEN score >= 0.45 THEN 1 WHEN score < 0.315 THEN 0 END IGNORE NULLS)
      OVER (PARTITION BY video_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS inside FROM ticks"""


@query("hysteresis_two_level", "ticks", TWO_LEVEL)
def _two_level(d: Inputs):
    out = states.hysteresis_two_level(d.ticks(), ["ts", "event_id"], tick_day())
    return out.select("video_id", "event_id", "inside")


@query("stream_hysteresis_two_level", "ticks", TWO_LEVEL)
def _stream_two_level(d: Inputs):
    return online.run_append(states.stream_hysteresis_two_level(closed(d).ticks(), **SPARSE)).select(
        "video_id", "event_id", "inside"
    )


MEMBER = """, m AS (SELECT t.video_id, t.tick_id, t.t_ms, count(s.start_ms) > 0 AS in_segment FROM playback t LEFT JOIN gt_raw s
      ON s.video_id = t.video_id AND t.t_ms BETWEEN s.start_ms AND s.end_ms GROUP BY 1, 2, 3)
"""


@query("segment_transitions", "playback gt_raw", MEMBER + """
    SELECT video_id, tick_id, t_ms, CASE WHEN in_segment THEN 'enter' ELSE 'exit' END AS change FROM (SELECT *, coalesce(lag(in_segment)
      OVER (PARTITION BY video_id ORDER BY t_ms, tick_id), false) AS was FROM m) WHERE in_segment <> was""")
def _transitions(d: Inputs):
    chunk = F.floor(F.col("t_ms") / 600_000).cast("bigint")
    out = states.segment_transitions(d.playback(), d.gt_raw(), ["t_ms", "tick_id"], chunk)
    return out.select("video_id", "tick_id", "t_ms", "change")


@query("stream_segment_membership", "playback gt_raw", MEMBER + "SELECT video_id, tick_id, t_ms, in_segment FROM m")
def _membership(d: Inputs):
    ticks = streamed(d).playback().select("video_id", "tick_id", "t_ms")
    out = online.run_append(states.stream_segment_membership(ticks, d.gt_raw()))
    return out.select("video_id", "tick_id", "t_ms", "in_segment")


SINCE = """, g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY ts, event_id
      ROWS UNBOUNDED PRECEDING) AS grp FROM ticks)
    SELECT video_id, event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, grp ORDER BY ts, event_id
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS since_reset FROM g"""


@query("count_since_reset", "ticks", SINCE)
def _since(d: Inputs):
    kind = F.col("event_type")
    out = states.count_since_reset(d.ticks(), ["ts", "event_id"], tick_day(), kind == "click", kind == "error")
    return out.select("video_id", "event_id", "since_reset")


@query("stream_count_since_reset", "ticks", SINCE)
def _stream_since(d: Inputs):
    return online.run_append(states.stream_count_since_reset(closed(d).ticks(), "click", ["error"], **SPARSE))


@query("stream_cue_tagging", "doc_lines", f"""
    SELECT doc_id, rank AS line_idx, {sql_score_text('text')} AS context_points, {sql_score_cue('text')} AS cue_points FROM doc_lines""")
def _tagging(d: Inputs):
    lines = streamed(d).doc_lines().select("doc_id", F.posexplode("lines").alias("line_idx", "l")).select(
        "doc_id", F.col("line_idx").cast("bigint").alias("line_idx"), F.col("l.text").alias("text")
    )
    return online.run_append(online.stream_cue_tagging(lines)).select(
        "doc_id", "line_idx", F.col("context_points").cast("int").alias("context_points"), "cue_points"
    )


@query("stream_feature_upsert", "window_features", """
    SELECT video_id, window_idx, label, round(list_sum(text_emb), 6) AS text_sum, round(text_emb[1], 6) AS first, round(text_emb[len(text_emb)], 6) AS last
    FROM window_features""")
def _upsert(d: Inputs):
    store = new_shared_path(d.spark, "upsert")
    columns = ["video_id", "window_idx", "label", "text_emb"]
    # The same stream twice: the second run finds every video present.
    for _ in range(2):
        online.stream_feature_upsert(streamed(d).window_features().select(*columns), store)
    total = F.aggregate("text_emb", F.lit(0.0), lambda acc, x: acc + x)
    return rounded(online.read_store(d.spark, store).select(
        "video_id", "window_idx", "label", total.alias("text_sum"), F.element_at("text_emb", 1).alias("first"), F.element_at("text_emb", -1).alias("last")))


@query("session_segments", "ticks", """
    , h AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS fresh FROM ticks WHERE score >= 0.5
      WINDOW w AS (PARTITION BY video_id ORDER BY ts)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM h)
    SELECT video_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n_hits, max(score) AS max_score
    FROM g GROUP BY video_id, grp""")
def _sessions(d: Inputs):
    hits = closed(d).ticks().filter("score >= 0.5")
    out = online.run_append(online.session_segments(hits, "6 hours")).filter("video_id <> 'u-1'")
    return out.select(
        "video_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("last_ts").alias("last_us"), "n_hits", "max_score"
    )
