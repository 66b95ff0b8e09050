"""Input views over the supplied tables, once for Spark and once as DuckDB text.

Each view maps the supplied star-schema/text tables onto one of the shapes the
operators expect (cues, raw segments, predictions, frames, ...).  The Spark side
follows the same scaling rules as the operators: positions within a key come from
``ordered_index`` instead of one window over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cuelake.plans.ordered import ordered_index

# Phrases injected into ordinary lines so that the dictionaries have hits.
# (fixed values: residue -> phrase)
INJECTED = {
    5: "sponsored by acme corp",
    40: "use my code save for 20 percent off",
    57: "go to acme.com today",
    90: "sign up",
    121: "before we get into it",
    150: "anyway back to the video",
    177: "link is in the description",
    200: "thanks to acme for sponsoring",
    233: "this app is a premium plan",
    260: "free trial",
}


class Inputs:
    """Spark views over one directory of supplied tables."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    # -- transcripts ---------------------------------------------------------

    @staticmethod
    def _lines() -> Column:
        """Lines of a document with injected phrases, as (pos, text) structs."""
        doc = F.col("doc_id")
        residues = F.create_map(*[F.lit(x) for pair in INJECTED.items() for x in pair])

        def with_phrase(line: Column, pos: Column) -> Column:
            phrase = F.coalesce(
                F.try_element_at(residues, ((doc * 31 + pos * 17) % 293).cast("int")), F.lit("")
            )
            return F.struct(
                pos.cast("bigint").alias("pos"),
                F.trim(F.concat(line, F.lit(" "), phrase)).alias("text"),
            )

        lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.transform(lines, lambda s: with_phrase(s["x"], s["i"]))

    def doc_lines(self) -> DataFrame:
        """(doc_id, lines): see :meth:`_lines`."""
        return self.table("documents").select("doc_id", self._lines().alias("lines"))

    def cues(self) -> DataFrame:
        """Twenty documents make a video; the line rank within it is the cue index."""
        # Shuffle the documents first: the line work then runs in all tasks, and the
        # window below needs no further exchange.  At most twenty rows per group.
        docs = self.table("documents").select("doc_id", "text").withColumn("vid", F.expr("doc_id div 20")).repartition("vid")
        lines = docs.select("doc_id", "vid", self._lines().alias("lines"))
        along = Window.partitionBy("vid").orderBy("doc_id")
        placed = lines.withColumn("upto", F.sum(F.size("lines")).over(along))
        flat = placed.select(
            "doc_id",
            F.concat(F.lit("v"), F.col("vid").cast("string")).alias("video_id"),
            (F.col("upto") - F.size("lines")).alias("base"),
            F.posexplode("lines").alias("rank", "line"),
        )
        idx = F.col("base") + F.col("rank")
        return flat.select(
            "video_id",
            idx.cast("int").alias("cue_idx"),
            (idx * 4000 + F.floor(idx / 12) * 3000).cast("bigint").alias("start_ms"),
            (3000 + ((F.col("doc_id") * 7 + F.col("line.pos") * 13) % 5) * 200)
            .cast("bigint").alias("dur_ms"),
            F.col("line.text").alias("text"),
        )

    def videos(self, cues: DataFrame | None = None) -> DataFrame:
        """``cues``, where they are stored already, are not made again."""
        return (self.cues() if cues is None else cues).groupBy("video_id").agg(
            (F.max(F.col("start_ms") + F.col("dur_ms")) + 5000).alias("dur_ms")
        )

    def cue_segments(self, videos: DataFrame | None = None) -> DataFrame:
        return (self.videos() if videos is None else videos).select(
            "video_id", F.explode(F.expr("sequence(0, dur_ms div 90000)")).alias("k")
        ).select(
            "video_id",
            (F.col("k") * 90000).cast("bigint").alias("start_ms"),
            (F.col("k") * 90000 + 20000).cast("bigint").alias("end_ms"),
            ((F.col("k") * 5 + F.length("video_id")) % 13).cast("int").alias("votes"),
        )

    def crowd_raw(self) -> DataFrame:
        """Crowd-labelled rows for the cue videos (``vid...``) and for videos without captions (``nov...``).

        Some rows are of another category, hidden or voted down, some overlap, and a sixth of the
        videos has no row.
        """
        v = self.videos().select(F.expr("CAST(substr(video_id, 2) AS BIGINT)").alias("n"), "dur_ms")
        named = v.select(F.lit("vid").alias("kind"), "n", "dur_ms").union(
            v.filter("n % 4 = 1").select(F.lit("nov"), "n", "dur_ms"))
        k = F.explode(F.expr("sequence(0, dur_ms div 45000)")).alias("k")
        return named.filter("n % 6 <> 2").select("kind", "n", "dur_ms", k).selectExpr(
            "concat(kind, lpad(CAST(n AS STRING), 8, '0')) AS videoID",
            "CAST(k * 45 AS STRING) AS startTime",
            "CAST(k * 45 + 20 + (n + k) % 3 * 13 AS STRING) AS endTime",
            "CAST((k * 5 + n) % 7 - 1 AS STRING) AS votes",
            "CASE WHEN (k + n) % 5 = 0 THEN 'intro' ELSE 'sponsor' END AS category",
            "CASE WHEN (k + n) % 11 = 3 THEN '1' ELSE '0' END AS hidden",
            "CASE WHEN (k * 3 + n) % 17 = 3 THEN '1' ELSE '0' END AS shadowHidden",
            "'skip' AS actionType", "CAST(dur_ms div 1000 AS STRING) AS videoDuration",
            "CASE WHEN n % 2 = 0 THEN 'YouTube' ELSE '' END AS service",
        )

    # -- crowd intervals -----------------------------------------------------

    def segments_raw(self) -> DataFrame:
        return self._segments().drop("n")

    def _segments(self) -> DataFrame:
        li = self.table("lineitem")
        n = F.expr("l_orderkey div 8")
        s = F.col("l_partkey") % 600
        return li.select(
            n.alias("n"), F.concat(F.lit("o"), n.cast("string")).alias("videoID"),
            s.cast("string").alias("startTime"),
            (s + F.col("l_quantity").cast("int")).cast("string").alias("endTime"),
            (F.col("l_suppkey") % 23 - 2).cast("string").alias("votes"),
            F.when(F.col("l_returnflag") == "R", "intro").otherwise("sponsor").alias("category"),
            F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1), "1")
            .otherwise("0").alias("hidden"),
            F.when(F.col("l_linenumber") == 2, "mute")
            .when(F.col("l_linenumber") == 3, "").otherwise("skip").alias("actionType"),
            F.lit("640").alias("videoDuration"),
        )

    def segments_long_ids(self) -> DataFrame:
        """``segments_raw`` with 11-character ids, float votes, service and shadow flags."""
        raw, n = self._segments(), F.col("n")
        return raw.select(
            F.when(n % 50 == 7, F.col("videoID"))
            .otherwise(F.concat(F.lit("id"), F.lpad(n.cast("string"), 9, "0")))
            .alias("videoID"),
            "startTime", "endTime",
            F.when(n % 9 == 0, F.concat(F.col("votes"), F.lit(".7")))
            .when(n % 31 == 0, F.lit("many")).otherwise(F.col("votes")).alias("votes"),
            "category", "hidden",
            F.when(n % 17 == 0, "1").otherwise("0").alias("shadowHidden"),
            "actionType",
            F.when(n % 13 == 0, "45").otherwise("640").alias("videoDuration"),
            F.when(n % 5 == 0, "YouTube").when(n % 5 == 1, "PeerTube").otherwise("").alias("service"),
        )

    def gt_raw(self) -> DataFrame:
        """Truth from every line item; each ninth video's goes to the one before it, so some have none."""
        s = F.col("l_partkey") % 600
        return self.table("lineitem").select(
            F.expr("concat('o', CAST(l_orderkey div 8 - CASE WHEN l_orderkey div 8 % 9 = 4 THEN 1 ELSE 0 END AS STRING))")
            .alias("video_id"),
            (s * 1000).cast("bigint").alias("start_ms"),
            ((s + F.col("l_quantity")) * 1000).cast("bigint").alias("end_ms"),
            (F.col("l_suppkey") % 23 - 2).cast("int").alias("votes"),
        )

    def det_raw(self) -> DataFrame:
        """Detections from every line item; each twentieth video's go to the one before it."""
        s = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 11) % 600
        return self.table("lineitem").select(
            F.expr("concat('o', CAST(l_orderkey div 8 - CASE WHEN l_orderkey div 8 % 20 = 19 THEN 1 ELSE 0 END AS STRING))")
            .alias("video_id"),
            (s * 1000).cast("bigint").alias("start_ms"),
            ((s + 20 + F.col("l_linenumber")) * 1000).cast("bigint").alias("end_ms"),
        )

    def cache(self) -> DataFrame:
        """Cached videos: some without vote data, some silent, some absent from the CSV."""
        n = F.expr("o_orderkey div 6").alias("n")
        ids = self.table("orders").select(n).distinct().filter("n % 2 = 0")
        return ids.select(
            F.concat(F.lit("o"), F.col("n").cast("string")).alias("video_id"),
            (F.col("n") % 3 == 0).alias("has_votes"),
            (F.col("n") % 7 == 0).alias("zero_audio"),
        )

    # -- predictions and logs --------------------------------------------------

    def _indexed_events(self, name: str) -> DataFrame:
        ev = self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
        day = F.floor(F.unix_micros("ts") / 86_400_000_000).cast("bigint")
        return ordered_index(ev, ["user_id"], ["ts", "event_id"], day, name)

    def predictions(self) -> DataFrame:
        p = F.round(F.col("value") / (F.col("value") + 40.0), 4)
        return self._indexed_events("idx").select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"),
            F.col("idx").cast("int").alias("window_idx"),
            F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).alias("label"),
            p.alias("prob"),
        )

    def labelled_windows(self) -> DataFrame:
        """``predictions`` without the probability: stored window labels."""
        return self.predictions().select("video_id", "window_idx", "label")

    def teacher_logits(self) -> DataFrame:
        """Logits of the clamped probabilities; every seventh window has none."""
        p = F.least(F.greatest(F.col("prob"), F.lit(0.001)), F.lit(0.999))
        return self.predictions().filter("window_idx % 7 <> 3").select(
            "video_id", "window_idx", F.ln(p / (1 - p)).alias("logit")
        )

    def ticks(self) -> DataFrame:
        return self.table("events").select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"),
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "event_type",
            F.round(F.col("value") / (F.col("value") + 40.0), 4).alias("score"),
        )

    def playback(self) -> DataFrame:
        """Playback positions inside the videos of ``gt_raw``."""
        return self.table("events").select(
            F.concat(F.lit("o"), F.expr("CAST(event_id div 5 AS STRING)"))
            .alias("video_id"),
            F.col("event_id").alias("tick_id"),
            ((F.col("event_id") * 997) % 650000).cast("bigint").alias("t_ms"),
            F.round(F.col("value") / (F.col("value") + 40.0), 4).alias("ml"),
            F.round(F.expr("(event_id % 101) / 100.0D"), 2).alias("anomaly"),
        )

    def cue_ticks(self) -> DataFrame:
        """Playback positions inside the cue videos, one per half minute."""
        return self.videos().select(
            "video_id", F.explode(F.expr("sequence(0, dur_ms div 30000)")).alias("k")
        ).select(
            "video_id", F.col("k").cast("bigint").alias("tick_id"),
            (F.col("k") * 30000 + 777).cast("bigint").alias("t_ms"),
        )

    def job_events(self) -> DataFrame:
        return self.table("events").select(
            F.expr("concat('j', CAST(user_id AS STRING), '-', CAST(event_id % 7 AS STRING))")
            .alias("job_id"),
            F.expr("concat('v', CAST(user_id AS STRING))").alias("video_id"),
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            F.when(F.col("event_type") == "error", "failed")
            .when(F.col("event_type") == "purchase", "complete")
            .otherwise("pending").alias("status"),
            F.when(F.col("event_type") == "error", F.repeat(F.concat(F.col("props"), F.lit(" ")), 60))
            .alias("error"),
        )

    def prediction_log(self) -> DataFrame:
        return self.table("events").select(
            F.expr("concat('v', CAST(user_id AS STRING))").alias("video_id"),
            "event_id",
            F.col("ts").cast("timestamp").alias("updated_at"),
            F.expr(
                "CASE WHEN event_id % 11 = 0 THEN NULL"
                " ELSE CAST(ts AS TIMESTAMP) + INTERVAL '7' DAY END"
            ).alias("expires_at"),
            F.col("value").alias("score"),
        )

    def epoch_log(self) -> DataFrame:
        return self._indexed_events("idx").select(
            F.col("user_id").alias("run_id"),
            (F.col("idx") + 1).cast("int").alias("epoch"),
            F.round(F.col("value") / (F.col("value") + 40.0), 2).alias("val_f1"),
        )

    def trials(self) -> DataFrame:
        best = self.epoch_log().groupBy("run_id").agg(F.max("val_f1").alias("val_f1"))
        return best.select(
            F.col("run_id").alias("trial"),
            F.expr(
                "CASE WHEN run_id % 5 = 0 THEN 'PRUNED' WHEN run_id % 11 = 0 THEN 'FAIL'"
                " ELSE 'COMPLETE' END"
            ).alias("state"),
            F.expr("round(val_f1 - (run_id * 37 % 100) / 200.0D, 4)").alias("val_f1"),
        )

    # -- signals -----------------------------------------------------------------

    def frames(self) -> DataFrame:
        return self.table("embeddings").select(
            F.expr("concat('f', CAST(vec_id div 50 AS STRING))").alias("video_id"),
            F.expr("CAST(vec_id % 50 AS INT)").alias("frame_idx"),
            F.slice("embedding", 1, 13).cast("array<double>").alias("coeffs"),
            F.col("embedding").cast("array<double>").alias("spectrum"),
        )

    def frame_windows(self) -> DataFrame:
        """Analysis windows over the videos of ``frames`` (a frame a second, 5 s grid)."""
        return self.frames().groupBy("video_id").agg(F.max("frame_idx").alias("last")).select(
            "video_id", F.explode(F.expr("sequence(0, CAST(last div 5 AS INT))")).alias("window_idx")
        ).withColumn("t_start_ms", (F.col("window_idx") * 5000).cast("bigint"))

    def av_windows(self) -> DataFrame:
        """24-bin histograms (three unit-sum channels) with a low/high band profile."""
        e = "abs(CAST(embedding[{}] AS DOUBLE))"
        channel = [
            "(" + " + ".join(e.format(c * 8 + i) for i in range(8)) + ")" for c in range(3)
        ]
        hist = ", ".join(
            f"{e.format(i)} / {channel[i // 8]}" for i in range(24)
        )
        return self.table("embeddings").select(
            F.expr("concat('f', CAST(vec_id div 50 AS STRING))").alias("video_id"),
            F.expr("CAST(vec_id % 50 AS INT)").alias("win_idx"),
            F.expr("CAST((vec_id % 50) * 5000 + (vec_id % 3) * 100 AS BIGINT)").alias("time_ms"),
            F.expr(f"array({hist})").alias("hist"),
            F.expr(f"{e.format(24)} * 100").alias("low"),
            F.expr(f"{e.format(25)} * 100").alias("high"),
            F.expr(f"{e.format(24)} / ({e.format(24)} + {e.format(25)})").alias("ratio"),
        )

    def window_features(self) -> DataFrame:
        """Stored features: legacy short vectors, silent and constant videos included."""
        return self.table("embeddings").selectExpr(
            "concat('f', CAST(vec_id div 50 AS STRING)) AS video_id",
            "CAST(vec_id % 50 AS INT) AS window_idx",
            "CASE WHEN label < 3 THEN 1 ELSE 0 END AS label",
            "CASE WHEN (vec_id div 50) % 5 = 2 THEN transform(slice(embedding, 1, 32), x -> 0.0D)"
            " WHEN (vec_id div 50) % 4 = 1 THEN transform(slice(embedding, 1, 32), x -> 0.5D)"
            " ELSE transform(slice(embedding, 1, 32), x -> CAST(x AS DOUBLE)) END AS text_emb",
            "CASE WHEN (vec_id div 50) % 10 = 3 OR vec_id % 17 = 0"
            " THEN transform(slice(embedding, 33, 32), x -> 0.0D)"
            " ELSE transform(slice(embedding, 33, 32), x -> CAST(x AS DOUBLE)) END AS audio_emb",
            "transform(sequence(0, CASE WHEN vec_id % 2 = 0 THEN 63 ELSE 127 END),"
            " i -> CAST(CASE WHEN (vec_id * 7 + i * 13) % 11 = 0 THEN 1 ELSE 0 END AS TINYINT))"
            " AS keyword_vec",
            "CASE WHEN vec_id % 4 = 0 THEN NULL"
            " ELSE transform(slice(embedding, 1, 13), x -> CAST(x AS DOUBLE)) END AS mfcc_mean",
        )

    # -- pages -------------------------------------------------------------------

    def page_tracks(self) -> DataFrame:
        return self.table("pages").select(
            "page_id",
            F.expr(
                "concat(html, '<script>var p={\"captionTracks\": [{\"languageCode\":\"',"
                " CASE page_id % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'en-US' ELSE 'de' END,"
                " '\",\"baseUrl\":\"u1-', CAST(page_id AS STRING),"
                " '\"},{\"languageCode\":\"', CASE page_id % 4 WHEN 0 THEN 'es' ELSE 'en' END,"
                " '\",\"baseUrl\":\"u2-', CAST(page_id AS STRING), '\"}]}</script>')"
            ).alias("html"),
        )


_E = "abs(CAST(embedding[{}] AS DOUBLE))"  # DuckDB lists start at 1


def _duck_hist() -> str:
    channel = ["(" + " + ".join(_E.format(c * 8 + i + 1) for i in range(8)) + ")" for c in range(3)]
    return ", ".join(f"{_E.format(i + 1)} / {channel[i // 8]}" for i in range(24))


_PHRASE_CASE = "CASE (doc_id * 31 + pos * 17) % 293 " + " ".join(
    f"WHEN {r} THEN '{p}'" for r, p in INJECTED.items()
) + " ELSE '' END"

_INDEXED = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"

#: name -> (views it needs, DuckDB text)
DUCK: dict[str, tuple[list[str], str]] = {
    "doc_lines": ([], f"""
        SELECT doc_id, pos, trim(concat(line, ' ', {_PHRASE_CASE})) AS text,
          row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS rank
        FROM (SELECT doc_id, i - 1 AS pos, parts[i] AS line
              FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
                    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts
                          FROM documents)))"""),
    "cues": (["doc_lines"], """
        SELECT video_id, cue_idx, CAST(cue_idx * 4000 + (cue_idx // 12) * 3000 AS BIGINT) AS start_ms,
          CAST(3000 + ((doc_id * 7 + pos * 13) % 5) * 200 AS BIGINT) AS dur_ms, text
        FROM (SELECT doc_id, pos, text, concat('v', CAST(doc_id // 20 AS VARCHAR)) AS video_id,
                CAST(row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id, pos) - 1 AS INT) AS cue_idx
              FROM doc_lines)"""),
    "videos": (["cues"], """
        SELECT video_id, max(start_ms + dur_ms) + 5000 AS dur_ms FROM cues GROUP BY video_id"""),
    "cue_segments": (["videos"], """
        SELECT video_id, CAST(k * 90000 AS BIGINT) AS start_ms, CAST(k * 90000 + 20000 AS BIGINT) AS end_ms,
          CAST((k * 5 + length(video_id)) % 13 AS INT) AS votes
        FROM (SELECT video_id, unnest(range(0, dur_ms // 90000 + 1)) AS k FROM videos)"""),
    "crowd_raw": (["videos"], """
        SELECT kind || lpad(CAST(n AS VARCHAR), 8, '0') AS videoID, CAST(k * 45 AS VARCHAR) AS startTime,
          CAST(k * 45 + 20 + (n + k) % 3 * 13 AS VARCHAR) AS endTime, CAST((k * 5 + n) % 7 - 1 AS VARCHAR) AS votes,
          CASE WHEN (k + n) % 5 = 0 THEN 'intro' ELSE 'sponsor' END AS category,
          CASE WHEN (k + n) % 11 = 3 THEN '1' ELSE '0' END AS hidden,
          CASE WHEN (k * 3 + n) % 17 = 3 THEN '1' ELSE '0' END AS shadowHidden, 'skip' AS actionType,
          CAST(dur_ms // 1000 AS VARCHAR) AS videoDuration, CASE WHEN n % 2 = 0 THEN 'YouTube' ELSE '' END AS service
        FROM (SELECT kind, n, dur_ms, unnest(range(0, dur_ms // 45000 + 1)) AS k
              FROM (SELECT CAST(substr(video_id, 2) AS BIGINT) AS n, dur_ms, unnest(['vid', 'nov']) AS kind FROM videos)
              WHERE n % 6 <> 2 AND (kind = 'vid' OR n % 4 = 1))"""),
    "segments_raw": ([], """
        SELECT concat('o', CAST(l_orderkey // 8 AS VARCHAR)) AS videoID,
          CAST(l_partkey % 600 AS VARCHAR) AS startTime,
          CAST(l_partkey % 600 + CAST(l_quantity AS INT) AS VARCHAR) AS endTime,
          CAST(l_suppkey % 23 - 2 AS VARCHAR) AS votes,
          CASE WHEN l_returnflag = 'R' THEN 'intro' ELSE 'sponsor' END AS category,
          CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN '1' ELSE '0' END AS hidden,
          CASE WHEN l_linenumber = 2 THEN 'mute' WHEN l_linenumber = 3 THEN '' ELSE 'skip' END AS actionType,
          '640' AS videoDuration FROM lineitem"""),
    "segments_long_ids": (["segments_raw"], """
        SELECT CASE WHEN n % 50 = 7 THEN videoID ELSE 'id' || lpad(substr(videoID, 2), 9, '0') END AS videoID,
          startTime, endTime,
          CASE WHEN n % 9 = 0 THEN votes || '.7' WHEN n % 31 = 0 THEN 'many' ELSE votes END AS votes,
          category, hidden, CASE WHEN n % 17 = 0 THEN '1' ELSE '0' END AS shadowHidden, actionType,
          CASE WHEN n % 13 = 0 THEN '45' ELSE '640' END AS videoDuration,
          CASE WHEN n % 5 = 0 THEN 'YouTube' WHEN n % 5 = 1 THEN 'PeerTube' ELSE '' END AS service
        FROM (SELECT *, CAST(substr(videoID, 2) AS BIGINT) AS n FROM segments_raw)"""),
    "gt_raw": ([], """
        SELECT concat('o', CAST(l_orderkey // 8 - CASE WHEN l_orderkey // 8 % 9 = 4 THEN 1 ELSE 0 END AS VARCHAR)) AS video_id,
          CAST(l_partkey % 600 * 1000 AS BIGINT) AS start_ms,
          CAST((l_partkey % 600 + l_quantity) * 1000 AS BIGINT) AS end_ms,
          CAST(l_suppkey % 23 - 2 AS INT) AS votes FROM lineitem"""),
    "det_raw": ([], """
        SELECT concat('o', CAST(l_orderkey // 8 - CASE WHEN l_orderkey // 8 % 20 = 19 THEN 1 ELSE 0 END AS VARCHAR)) AS video_id,
          CAST(((l_partkey * 7 + l_suppkey * 11) % 600) * 1000 AS BIGINT) AS start_ms,
          CAST(((l_partkey * 7 + l_suppkey * 11) % 600 + 20 + l_linenumber) * 1000 AS BIGINT) AS end_ms
        FROM lineitem"""),
    "cache": ([], """
        SELECT 'o' || CAST(n AS VARCHAR) AS video_id, n % 3 = 0 AS has_votes, n % 7 = 0 AS zero_audio
        FROM (SELECT DISTINCT o_orderkey // 6 AS n FROM orders) WHERE n % 2 = 0"""),
    "predictions": ([], f"""
        SELECT concat('u', CAST(user_id AS VARCHAR)) AS video_id, CAST({_INDEXED} - 1 AS INT) AS window_idx,
          CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS label,
          round(value / (value + 40.0), 4) AS prob FROM events"""),
    "teacher_logits": (["predictions"], """
        SELECT video_id, window_idx, ln(p / (1 - p)) AS logit
        FROM (SELECT *, least(greatest(prob, 0.001::DOUBLE), 0.999::DOUBLE) AS p FROM predictions)
        WHERE window_idx % 7 <> 3"""),
    "ticks": ([], """
        SELECT concat('u', CAST(user_id AS VARCHAR)) AS video_id, event_id, ts, event_type,
          round(value / (value + 40.0), 4) AS score FROM events"""),
    "playback": ([], """
        SELECT concat('o', CAST(event_id // 5 AS VARCHAR)) AS video_id, event_id AS tick_id,
          CAST((event_id * 997) % 650000 AS BIGINT) AS t_ms, round(value / (value + 40.0), 4) AS ml,
          round((event_id % 101) / 100.0::DOUBLE, 2) AS anomaly FROM events"""),
    "cue_ticks": (["videos"], """
        SELECT video_id, k AS tick_id, CAST(k * 30000 + 777 AS BIGINT) AS t_ms
        FROM (SELECT video_id, unnest(range(0, dur_ms // 30000 + 1)) AS k FROM videos)"""),
    "job_events": ([], """
        SELECT concat('j', CAST(user_id AS VARCHAR), '-', CAST(event_id % 7 AS VARCHAR)) AS job_id,
          concat('v', CAST(user_id AS VARCHAR)) AS video_id, event_id, ts,
          CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'complete'
            ELSE 'pending' END AS status,
          CASE WHEN event_type = 'error' THEN repeat(props || ' ', 60) END AS error FROM events"""),
    "prediction_log": ([], """
        SELECT concat('v', CAST(user_id AS VARCHAR)) AS video_id, event_id, ts AS updated_at,
          CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts + INTERVAL 7 DAY END AS expires_at,
          value AS score FROM events"""),
    "epoch_log": ([], f"""
        SELECT user_id AS run_id, CAST({_INDEXED} AS INT) AS epoch,
          round(value / (value + 40.0), 2) AS val_f1 FROM events"""),
    "trials": (["epoch_log"], """
        SELECT run_id AS trial, CASE WHEN run_id % 5 = 0 THEN 'PRUNED' WHEN run_id % 11 = 0 THEN 'FAIL'
            ELSE 'COMPLETE' END AS state,
          round(max(val_f1) - (run_id * 37 % 100) / 200.0::DOUBLE, 4) AS val_f1
        FROM epoch_log GROUP BY run_id"""),
    "frames": ([], """
        SELECT concat('f', CAST(vec_id // 50 AS VARCHAR)) AS video_id, CAST(vec_id % 50 AS INT) AS frame_idx,
          CAST(embedding[1:13] AS DOUBLE[]) AS coeffs, CAST(embedding AS DOUBLE[]) AS spectrum
        FROM embeddings"""),
    "frame_windows": (["frames"], """
        SELECT video_id, CAST(w AS INT) AS window_idx, CAST(w * 5000 AS BIGINT) AS t_start_ms
        FROM (SELECT video_id, unnest(range(0, max(frame_idx) // 5 + 1)) AS w FROM frames GROUP BY video_id)"""),
    "av_windows": ([], f"""
        SELECT concat('f', CAST(vec_id // 50 AS VARCHAR)) AS video_id, CAST(vec_id % 50 AS INT) AS win_idx,
          CAST((vec_id % 50) * 5000 + (vec_id % 3) * 100 AS BIGINT) AS time_ms, [{_duck_hist()}] AS hist,
          {_E.format(25)} * 100 AS low, {_E.format(26)} * 100 AS high,
          {_E.format(25)} / ({_E.format(25)} + {_E.format(26)}) AS ratio FROM embeddings"""),
    "window_features": ([], """
        SELECT concat('f', CAST(vec_id // 50 AS VARCHAR)) AS video_id, CAST(vec_id % 50 AS INT) AS window_idx,
          CASE WHEN label < 3 THEN 1 ELSE 0 END AS label,
          CASE WHEN (vec_id // 50) % 5 = 2 THEN list_transform(embedding[1:32], lambda x: 0.0::DOUBLE)
            WHEN (vec_id // 50) % 4 = 1 THEN list_transform(embedding[1:32], lambda x: 0.5::DOUBLE)
            ELSE CAST(embedding[1:32] AS DOUBLE[]) END AS text_emb,
          CASE WHEN (vec_id // 50) % 10 = 3 OR vec_id % 17 = 0
            THEN list_transform(embedding[33:64], lambda x: 0.0::DOUBLE)
            ELSE CAST(embedding[33:64] AS DOUBLE[]) END AS audio_emb,
          list_transform(range(0, CASE WHEN vec_id % 2 = 0 THEN 64 ELSE 128 END),
            lambda i: CASE WHEN (vec_id * 7 + i * 13) % 11 = 0 THEN 1 ELSE 0 END) AS keyword_vec,
          CASE WHEN vec_id % 4 = 0 THEN NULL ELSE CAST(embedding[1:13] AS DOUBLE[]) END AS mfcc_mean
        FROM embeddings"""),
    "page_tracks": ([], """
        SELECT page_id, concat(html, '<script>var p={"captionTracks": [{"languageCode":"',
          CASE page_id % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'en-US' ELSE 'de' END, '","baseUrl":"u1-',
          CAST(page_id AS VARCHAR), '"},{"languageCode":"', CASE page_id % 4 WHEN 0 THEN 'es' ELSE 'en' END,
          '","baseUrl":"u2-', CAST(page_id AS VARCHAR), '"}]}</script>') AS html FROM pages"""),
    # grid windows over the cue videos
    "windows": (["videos"], """
        SELECT video_id, CAST(i AS INT) AS window_idx, CAST(i * 5000 AS BIGINT) AS t_start_ms,
          CAST(least(i * 5000 + 5000, dur_ms) AS BIGINT) AS t_end_ms
        FROM (SELECT video_id, dur_ms, unnest(range(0, greatest(1, dur_ms // 5000))) AS i FROM videos)"""),
    "segments": (["segments_raw"], """
        SELECT trim(videoID) AS video_id, CAST(round(try_cast(startTime AS DOUBLE) * 1000) AS BIGINT) AS start_ms,
          CAST(round(try_cast(endTime AS DOUBLE) * 1000) AS BIGINT) AS end_ms,
          coalesce(try_cast(votes AS INT), 0) AS votes
        FROM segments_raw
        WHERE category = 'sponsor' AND coalesce(try_cast(votes AS INT), 0) >= 1 AND hidden IN ('0', '')
          AND actionType IN ('skip', '') AND trim(videoID) <> ''
          AND try_cast(endTime AS DOUBLE) - try_cast(startTime AS DOUBLE) >= 1.0"""),
    "labelled_cue_windows": (["windows", "cue_segments"], """
        SELECT w.video_id, w.window_idx, w.t_start_ms, w.t_end_ms,
          CAST(coalesce(max(CASE WHEN t_end_ms > t_start_ms AND 2 * greatest(0, least(t_end_ms, s.end_ms)
            - greatest(t_start_ms, s.start_ms)) >= t_end_ms - t_start_ms THEN 1 ELSE 0 END), 0) AS INT) AS label
        FROM windows w LEFT JOIN cue_segments s ON s.video_id = w.video_id GROUP BY ALL"""),
}


def duck_sql(views: str, body: str, recursive: bool = False) -> str:
    """``WITH <views and what they need> <body>``; a body starting with ',' adds more views."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for dep in DUCK[name][0]:
                add(dep)
            done.append(name)

    for name in views.split():
        add(name)
    ctes = ",\n".join(f"{n} AS ({DUCK[n][1]})" for n in done)
    body = body.strip()
    if not ctes:
        return ("WITH RECURSIVE " if recursive else "WITH ") + body[1:] if body[0] == "," else body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ctes + "\n" + body
