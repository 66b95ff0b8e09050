"""Caption parsing, track choice and the context detector (D operators, E8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuelake import vocab
from cuelake.functions.let import bound
from cuelake.functions.text import (
    TokenFilter, any_match, clean_caption, found_in, keyword_vector, masks_to_vector, one_line, score_cue, score_text,
    strip_tags, vector_to_masks,
)
from cuelake.operators.windows import cluster_hits
from cuelake.plans.ordered import CHUNK, INDEX_CHUNK, TIME_CHUNK_MS, halo, own_rows
from cuelake.plans.spans import BUCKET, over_buckets
from cuelake.schema import to_ms
from cuelake.session import materialize


# ---------------------------------------------------------------------------
# captions -> cues
# ---------------------------------------------------------------------------


def _clock_ms(stamp: Column) -> Column:
    """HH:MM:SS.mmm, MM:SS.mmm or seconds; null where a part is not a number."""

    def seconds(parts: Column) -> Column:
        def part(i: int) -> Column:
            return F.get(parts, F.lit(i)).try_cast("double")

        return (
            F.when(F.size(parts) == 3, part(0) * 3600 + part(1) * 60 + part(2))
            .when(F.size(parts) == 2, part(0) * 60 + part(1))
            .when(F.size(parts) == 1, part(0))
        )

    return to_ms(bound(F.split(stamp, ":"), seconds))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


_STAMP = r"(?:\d+:){0,2}\d+(?:\.\d*)?"
#: A line that times a block of the ``bench`` variant.
_TIMING = (
    r"^[^\S\n]*" + _STAMP + r"(?:[^\S\n][^\n]*?)?-->[^\S\n]*" + _STAMP + r"(?:[^\S\n][^\n>]*)?$"
)


def _blocks_until_timing(lines: Column) -> Column:
    """A line with an arrow, then its lines up to a blank one or the next arrow."""
    kinds = F.transform(lines, lambda x, i: F.struct(
        i.alias("i"), F.contains(x, F.lit("-->")).alias("timing"), (~x.rlike(r"\S")).alias("blank")))
    stops = F.filter(kinds, lambda k: k["timing"] | k["blank"])

    def cut(s: Column) -> Column:
        blocks = F.transform(s, lambda k, n: F.struct(
            k["timing"].alias("timed"), F.get(lines, k["i"]).alias("timing"),
            F.slice(lines, k["i"] + 2, F.coalesce(F.get(s, n + 1)["i"], F.size(lines)) - k["i"] - 1).alias("body")))
        return F.filter(blocks, lambda x: x["timed"])

    return bound(stops, cut)


def _blocks_until_blank(lines: Column) -> Column:
    """Between blank lines: the first timing line and all lines after it."""
    kinds = F.transform(lines, lambda x, i: F.struct(i.alias("i"), (~x.rlike(r"\S")).alias("blank")))
    blanks = F.concat(F.array(F.lit(-1)), F.transform(F.filter(kinds, lambda k: k["blank"]), lambda k: k["i"]))

    def cut(b: Column) -> Column:
        parts = F.transform(b, lambda at, n: F.slice(
            lines, at + 2, F.coalesce(F.get(b, n + 1), F.size(lines)) - at - 1))

        def block(part: Column) -> Column:
            first = F.get(F.filter(F.transform(part, lambda x, i: F.when(x.rlike(_TIMING), i)), lambda i: i.isNotNull()), F.lit(0))
            return bound(first, lambda k: F.struct(
                k.isNotNull().alias("timed"), F.get(part, k).alias("timing"),
                F.slice(part, F.coalesce(k, F.lit(0)) + 2, F.size(part)).alias("body")))

        return F.filter(F.transform(parts, block), lambda x: x["timed"])

    return bound(blanks, cut)


def vtt_cues(payload: Column, variant: str = "pipeline") -> Column:
    """Cues of a WebVTT payload, as an array.

    ``pipeline``: tags stripped and entities undone on the joined text, cues need
    ``end > start`` and must differ from the kept cue before them.
    ``bench``: each line cleaned on its own, ``dur = max(end - start, 1 ms)``.
    """
    if variant not in ("pipeline", "bench"):
        raise ValueError(f"unknown variant {variant!r}")
    pipeline = variant == "pipeline"
    lines = F.split(F.regexp_replace(payload, r"\r\n?", "\n"), "\n")
    blocks = bound(lines, _blocks_until_timing if pipeline else _blocks_until_blank)

    def read(block: Column) -> Column:
        sides = F.split(block["timing"], "-->")

        def times(s: Column) -> Column:
            left, right = F.get(s, F.lit(0)), F.get(s, F.lit(1))
            first = _strip(left) if pipeline else F.regexp_extract(left, r"^\s*(\S+)", 1)
            last = F.regexp_extract(right, r"^\s*(\S+)", 1)
            ok = F.size(s) == 2
            return F.struct(
                F.when(ok, _clock_ms(first)).alias("start"), F.when(ok, _clock_ms(last)).alias("end")
            )

        lines = F.filter(F.transform(block["body"], _strip), lambda x: x != "")
        if pipeline:
            text = _strip(clean_caption(F.array_join(lines, " ")))
        else:
            cleaned = F.transform(lines, lambda x: _strip(strip_tags(x)))
            text = F.array_join(F.filter(cleaned, lambda x: x != ""), " ")
        return F.struct(bound(sides, times).alias("at"), text.alias("text"))

    def to_cue(block: Column) -> Column:
        start, dur = block["at"]["start"], block["at"]["end"] - block["at"]["start"]
        if not pipeline:
            dur = F.greatest(dur, F.when(dur.isNotNull(), F.lit(1)))
        return F.struct(
            start.alias("start_ms"), dur.cast("bigint").alias("dur_ms"), block["text"].alias("text")
        )

    def usable(cue: Column) -> Column:
        return (cue["text"] != "") & F.coalesce(cue["dur_ms"] > 0, F.lit(False))

    def without_repeats(cues: Column) -> Column:
        # Runs of equal text collapse to their first cue, so comparing with the
        # preceding candidate equals comparing with the preceding kept cue.
        return F.filter(
            cues, lambda c, i: (i == 0) | (F.get(cues, i - 1)["text"] != c["text"])
        )

    cues = F.filter(F.transform(F.transform(blocks, read), to_cue), usable)
    return bound(cues, without_repeats) if pipeline else cues


def cues_from_vtt(df: DataFrame, payload: str = "payload", variant: str = "pipeline") -> DataFrame:
    """WebVTT payload -> cues, entirely inside the row: no shuffle."""
    flat = df.select("video_id", F.posexplode(vtt_cues(F.col(payload), variant)).alias("cue_idx", "c"))
    return flat.select("video_id", "cue_idx", "c.start_ms", "c.dur_ms", "c.text")


XML_SCHEMA = "text ARRAY<STRUCT<_start: STRING, _dur: STRING, _VALUE: STRING>>"


def _exploded(df: DataFrame, cues: Column) -> DataFrame:
    return df.select("video_id", F.explode(cues).alias("c")).select("video_id", "c.*")


def xml_cues(payload: Column, strip: bool = False) -> Column:
    """Cues of a timed-text XML payload, as an array; ``cue_idx`` is the place among all its nodes.  Null where it is not XML."""
    parsed = F.from_xml(payload, XML_SCHEMA, {"rowTag": "transcript"})

    def cue(node: Column, at: Column) -> Column:
        raw = F.coalesce(node["_VALUE"], F.lit(""))
        return F.struct(
            at.cast("int").alias("cue_idx"),
            to_ms(F.coalesce(node["_start"], F.lit("0")).try_cast("double")).alias("start_ms"),
            to_ms(F.coalesce(node["_dur"], F.lit("2")).try_cast("double")).alias("dur_ms"),
            (F.trim(strip_tags(raw)) if strip else one_line(raw)).alias("text"),
        )

    return F.filter(
        F.transform(parsed["text"], cue), lambda c: (c["text"] != "") & c["start_ms"].isNotNull() & c["dur_ms"].isNotNull()
    )


def cues_from_xml(df: DataFrame, payload: str = "payload", strip: bool = False) -> DataFrame:
    """Timed-text XML -> cues; malformed payloads give none.  ``strip`` also drops tags."""
    return _exploded(df, xml_cues(F.col(payload), strip))


JSON3_SCHEMA = (
    "events ARRAY<STRUCT<tStartMs: DOUBLE, dDurationMs: DOUBLE, segs: ARRAY<STRUCT<utf8: STRING>>>>"
)


def json3_cues(payload: Column) -> Column:
    """Cues of a json3 payload, as an array: segments concatenated, blank ones dropped, default 2 s.  Null where it is not JSON."""
    parsed = F.from_json(payload, JSON3_SCHEMA)

    def cue(event: Column, at: Column) -> Column:
        pieces = F.transform(event["segs"], lambda s: F.coalesce(s["utf8"], F.lit("")))
        return F.struct(
            at.cast("int").alias("cue_idx"),
            F.round(F.coalesce(event["tStartMs"], F.lit(0.0))).cast("bigint").alias("start_ms"),
            F.round(F.coalesce(event["dDurationMs"], F.lit(2000.0))).cast("bigint").alias("dur_ms"),
            one_line(F.coalesce(F.array_join(pieces, ""), F.lit(""))).alias("text"),
        )

    return F.filter(F.transform(parsed["events"], cue), lambda c: c["text"] != "")


def cues_from_json3(df: DataFrame, payload: str = "payload") -> DataFrame:
    """json3 events -> cues."""
    return _exploded(df, json3_cues(F.col(payload)))


TRACK_SCHEMA = "ARRAY<STRUCT<languageCode: STRING, baseUrl: STRING>>"


def caption_track_from_html(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``track_url``: the first English track embedded in the page, else the first."""
    found = F.regexp_extract(F.col(html), r'"captionTracks":\s*(\[.*?\])', 1)
    tracks = F.from_json(found, TRACK_SCHEMA)
    english = F.get(F.filter(tracks, lambda t: t["languageCode"].startswith("en")), F.lit(0))
    return df.withColumn("track_url", F.coalesce(english, F.get(tracks, F.lit(0)))["baseUrl"])


def rank_caption_formats(candidates: DataFrame) -> DataFrame:
    """First parsable English candidate per video: vtt, json3, srv3, then the rest.

    ``candidates(video_id, pos, lang, ext, parsed, ...)``; ``pos`` keeps the order of
    equal formats.  ``min_by`` combines on the map side, no group is sorted.
    """
    rank = F.lit(vocab.FORMAT_RANK_OTHER)
    for ext, r in vocab.FORMAT_RANK.items():
        rank = F.when(F.col("ext") == ext, F.lit(r)).otherwise(rank)
    usable = candidates.filter(F.col("lang").startswith("en") & F.col("parsed"))
    fields = [c for c in candidates.columns if c != "video_id"]
    best = usable.groupBy("video_id").agg(
        F.min_by(F.struct(*fields), F.struct(rank.alias("r"), F.col("pos"))).alias("_best")
    )
    return best.select("video_id", *[F.col(f"_best.{c}").alias(c) for c in fields])


# ---------------------------------------------------------------------------
# vectors pooled over cues
# ---------------------------------------------------------------------------


def keyword_vector_pooled(
    tagged: DataFrame, keys: list[str], text: str = "text",
    patterns: list[str] = vocab.VOCAB_EXTENSION,
) -> DataFrame:
    """Per-dimension maximum over the cues of each group.

    Vectors travel as two bit masks and are pooled with ``bit_or``, so the shuffle
    carries 16 bytes per row and combines on the map side.
    """
    vectors = tagged.withColumn("_vec", keyword_vector(F.col(text), patterns))
    low, high = vector_to_masks(F.col("_vec"))
    masks = vectors.select(*keys, low.alias("_lo"), high.alias("_hi"))
    pooled = masks.groupBy(*keys).agg(F.bit_or("_lo").alias("_lo"), F.bit_or("_hi").alias("_hi"))
    return pooled.select(*keys, masks_to_vector(F.col("_lo"), F.col("_hi")).alias("keyword_vec"))


# ---------------------------------------------------------------------------
# context detector
# ---------------------------------------------------------------------------


def cue_breaks(cues: DataFrame, silence_ms: int = 1500, gate: TokenFilter | None = None) -> DataFrame:
    """Adds ``end_ms``, ``stop_back`` and ``stop_fwd``: natural breaks around each cue; ``_tokens``: the mask of a ``gate``.

    Neighbours are the cues with the adjacent ``cue_idx``.
    """
    # The phrase tests come before the exchange, which then carries texts only where they are asked for.
    w = Window.partitionBy("video_id", CHUNK).orderBy("cue_idx")
    no = F.lit(False)
    tests = {
        "opens": lambda t, low: any_match(t, low, vocab.INTRO_PHRASES),
        "returns": lambda t, low: any_match(t, low, vocab.RETURN_PHRASES),
    }
    if gate is not None:
        tests["tokens"] = lambda _, low: gate.bits(low)
    # Made by a generator: the optimizer would put a copy of the tests into each use of their results.
    ended = cues.withColumn("end_ms", F.col("start_ms") + F.col("dur_ms")).withColumn(
        "_found", F.explode(F.array(found_in(F.col("text"), **tests))))
    placed = own_rows(
        halo(ended, "cue_idx", INDEX_CHUNK, before=1, after=1)
        .withColumn("_prev_end", F.lag("end_ms").over(w))
        .withColumn("_next_start", F.lead("start_ms").over(w))
        .withColumn("_next_returns", F.lead("_found.returns").over(w))
    )
    silent_before = F.coalesce(F.col("start_ms") - F.col("_prev_end") > silence_ms, no)
    silent_after = F.coalesce(F.col("_next_start") - F.col("end_ms") > silence_ms, no)
    broken = (
        placed.withColumn("stop_back", silent_before | F.col("_found.opens"))
        .withColumn("stop_fwd", silent_after | F.coalesce(F.col("_next_returns"), no))
    )
    if gate is not None:
        broken = broken.withColumn("_tokens", F.col("_found.tokens"))
    return broken.drop("_found", "_prev_end", "_next_start", "_next_returns")


def context_score(
    cues: DataFrame, window_ms: int = 25_000, min_score: int = 3, walk_ms: int = 25_000,
    silence_ms: int = 1500,
) -> DataFrame:
    """Hits: cues whose surrounding text scores at least ``min_score``.

    ``back_ms`` is where a cluster that starts at the hit begins: the nearest cue at
    or before it, at most ``walk_ms`` back, that follows a break.
    """
    half = window_ms // 2
    reach = max(half, walk_ms)
    # The gate's literals, combined over the window, tell where it can match; only there are texts joined.
    gate = TokenFilter(vocab.GATE_PHRASES)
    spread = halo(cue_breaks(cues, silence_ms, gate), "start_ms", TIME_CHUNK_MS, before=reach, after=half)
    w = Window.partitionBy("video_id", CHUNK).orderBy("start_ms")
    near = w.rangeBetween(-half, half)
    stop = F.when(F.col("stop_back"), F.struct("cue_idx", "start_ms"))
    behind = F.max(stop).over(w.rangeBetween(-walk_ms, Window.currentRow))
    seen = spread.withColumn("_tokens", F.bit_or("_tokens").over(near)).withColumn("_stop", behind)
    marked = seen.withColumn("_may", gate.possible(F.col("_tokens")))
    wanted = marked.withColumn("_wanted", F.max("_may").over(near))
    around = F.collect_list(F.when(F.col("_wanted"), F.struct("cue_idx", "text"))).over(near)
    local = own_rows(wanted.withColumn("_around", around)).filter("_may")
    joined = F.array_join(F.transform(F.array_sort("_around"), lambda x: x["text"]), " ")
    # Scoring and filtering in one generator: a plain filter on the score would make
    # the optimizer score every text twice.
    good = F.filter(F.array(score_text(joined)), lambda s: s >= min_score)
    return local.withColumn("score", F.explode(good)).select(
        "video_id", "cue_idx", "start_ms", "end_ms", "score",
        F.coalesce(F.col("_stop.start_ms"), F.col("start_ms")).alias("back_ms"),
    )


def snap_boundaries(clusters: DataFrame, breaks: DataFrame, walk_ms: int = 25_000) -> DataFrame:
    """Cluster -> (start, end) at natural breaks.

    The end is that of the first cue, from the last hit on, after which a break
    follows, among the cues starting within ``walk_ms`` of the hit's end; if there
    is none, the last such cue.
    """
    width = 30_000
    reach = clusters.withColumn("_limit", F.col("end_ms") + walk_ms)
    spread = over_buckets(reach, F.col("last_start_ms"), F.col("_limit"), width).select(
        "video_id", BUCKET, F.col("start_ms").alias("_cluster"), "last_start_ms", "last_idx", "_limit"
    )
    cues = breaks.select(
        "video_id", F.col("cue_idx").alias("_idx"), F.col("start_ms").alias("_cs"),
        F.col("end_ms").alias("_ce"), "stop_fwd",
    ).withColumn(BUCKET, F.floor(F.col("_cs") / width).cast("bigint"))
    within = (F.col("_idx") >= F.col("last_idx")) & (F.col("_cs") <= F.col("_limit"))
    ends = (
        spread.join(cues, ["video_id", BUCKET]).filter(within)
        .groupBy("video_id", "_cluster")
        .agg(
            F.min(F.when(F.col("stop_fwd"), F.struct("_idx", "_ce"))).alias("_stop"),
            F.max(F.struct("_idx", "_ce")).alias("_last"),
        )
        .select("video_id", F.col("_cluster").alias("start_ms"),
                F.coalesce(F.col("_stop._ce"), F.col("_last._ce")).alias("_end"))
    )
    return clusters.join(ends, ["video_id", "start_ms"], "left").select(
        "video_id", F.col("back_ms").alias("start_ms"),
        F.coalesce("_end", "end_ms").alias("end_ms"), "score", "n_hits",
    )


def detect_segments(
    cues: DataFrame, gap_ms: int = 120_000, window_ms: int = 25_000, min_score: int = 3,
    min_len_ms: int = 45_000, walk_ms: int = 25_000, silence_ms: int = 1500,
) -> DataFrame:
    """Context hits -> clusters -> natural boundaries -> minimum length."""
    # Clusters read the hits twice; made twice, all texts would be shuffled and scored twice.
    hits = materialize(context_score(cues, window_ms, min_score, walk_ms, silence_ms), "hits")
    snapped = snap_boundaries(cluster_hits(hits, gap_ms), cue_breaks(cues, silence_ms), walk_ms)
    start = F.greatest(F.lit(0), F.col("start_ms"))
    missing = F.greatest(F.lit(0), F.lit(min_len_ms) - (F.col("end_ms") - start))
    half = F.floor(missing / 2).cast("bigint")
    return snapped.select(
        "video_id",
        F.greatest(F.lit(0), start - half).cast("bigint").alias("start_ms"),
        (F.col("end_ms") + (missing - half)).cast("bigint").alias("end_ms"),
        "score", "n_hits",
    )


def tag_cues(cues: DataFrame) -> DataFrame:
    """Stateless per-cue scores; usable on batch tables and on streams."""
    return cues.withColumn("context_points", score_text(F.col("text"))).withColumn(
        "cue_points", score_cue(F.col("text"))
    )
