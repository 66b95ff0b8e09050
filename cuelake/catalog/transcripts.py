"""Transcript queries: D*, E2, E3, E7-E11, A2 and the flagship detector benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake import vocab
from cuelake.catalog.registry import flat_vector, query, rounded, sql_text
from cuelake.catalog.spans import labelled
from cuelake.fixtures import Inputs
from cuelake.functions import text as X
from cuelake.operators import cleaning, evaluate, intervals, text as T, windows as W
from cuelake.session import materialize, new_shared_path
from cuelake.sources.captions import caption_failures, read_captions
from cuelake.sources.files import write_named_files
from cuelake.sources.logs import write_detection_report

# -- SQL pieces ------------------------------------------------------------------


def sql_folded(text: str, body: str) -> str:
    """``body`` over ``t``: the text, character by character, with Unicode word rules spelled out."""
    fold = r"""CASE WHEN unicode(c) < 128 THEN c WHEN c IN ('ſ', '\u212a') THEN CASE c WHEN 'ſ' THEN 's' ELSE 'k' END
        WHEN c IN ('İ', 'ı') THEN 'i' WHEN regexp_matches(c, '[\p{L}\p{N}]') THEN '_'
        WHEN regexp_matches(c, '\p{Z}') OR unicode(c) = 133 THEN ' ' ELSE c END""".replace(r"\u212a", "\u212a")
    whole = f"array_to_string(list_transform(string_split(x, ''), lambda c: {fold}), '')"
    inner = f"CASE WHEN regexp_matches(x, '[^\\x00-\\x7F]') THEN {whole} ELSE x END"
    return f"list_transform(list_transform([{text}], lambda x: {inner}), lambda t: {body})[1]"


def sql_any(text: str, patterns: list[str]) -> str:
    return sql_folded(text, f"regexp_matches(t, {sql_text('(?i)' + X.alternation(patterns))})")


def sql_count(text: str, patterns: list[str]) -> str:
    return f"len(regexp_extract_all({text}, {sql_text('(?i)' + X.alternation(patterns))}))"


def sql_score_text(text: str) -> str:
    gate = f"regexp_matches(t, {sql_text('(?i)' + X.alternation(vocab.GATE_PHRASES))})"
    return sql_folded(text, (
        f"CAST(CASE WHEN {gate} THEN 3 * {sql_count('t', vocab.STRONG_PHRASES)}"
        f" + {sql_count('t', vocab.WEAK_PHRASES)} ELSE 0 END AS INT)"
    ))


def sql_score_cue(text: str) -> str:
    one = "CASE WHEN regexp_matches(t, {}) THEN {} ELSE 0 END"
    parts = [one.format(sql_text("(?i)" + p), 3) for p in vocab.SIMPLE_STRONG_PHRASES]
    parts += [one.format(sql_text("(?i)" + p), 1) for p in vocab.SIMPLE_WEAK_PHRASES]
    return sql_folded(text, f"CAST({' + '.join(parts)} AS INT)")


def sql_vector(text: str, patterns: list[str]) -> str:
    dims = ", ".join(
        f"CASE WHEN regexp_matches(t, {sql_text('(?i)' + p)}) THEN 1 ELSE 0 END" for p in patterns
    )
    return sql_folded(text, f"[{dims}]")


def sql_weighted(vec: str, groups: int = 8) -> str:
    return " + ".join(
        f"list_sum({vec}[{g * 16 + 1}:{g * 16 + 16}]) * {vocab.GROUP_WEIGHTS[g]}::DOUBLE" for g in range(groups)
    )


CTX = f""", b AS (SELECT *, start_ms + dur_ms AS end_ms,
      coalesce(start_ms - lag(start_ms + dur_ms) OVER w > 1500, false) OR {sql_any('text', vocab.INTRO_PHRASES)} AS stop_back,
      coalesce(lead(start_ms) OVER w - (start_ms + dur_ms) > 1500, false)
        OR coalesce({sql_any('lead(text) OVER w', vocab.RETURN_PHRASES)}, false) AS stop_fwd
    FROM cues WINDOW w AS (PARTITION BY video_id ORDER BY cue_idx)),
  x AS (SELECT *, array_to_string(list_transform(list_sort(list(struct_pack(i := cue_idx, t := text)) OVER r), lambda s: s.t), ' ') AS ctx FROM cues
    WINDOW r AS (PARTITION BY video_id ORDER BY start_ms RANGE BETWEEN 12500 PRECEDING AND 12500 FOLLOWING)),
  h AS (SELECT x.video_id, x.cue_idx, x.start_ms, x.start_ms + x.dur_ms AS end_ms, {sql_score_text('ctx')} AS score FROM x)
"""
HITS = CTX.rstrip() + """,
  hits AS (SELECT h.*, coalesce((SELECT max_by(b.start_ms, b.cue_idx) FROM b WHERE b.video_id = h.video_id AND b.stop_back
      AND b.start_ms BETWEEN h.start_ms - 25000 AND h.start_ms), h.start_ms) AS back_ms FROM h WHERE score >= 3)
"""
CLUSTERS = HITS.rstrip() + """,
  c1 AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w <= 120000 THEN 0 ELSE 1 END AS fresh FROM hits
    WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, cue_idx)),
  c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY start_ms, cue_idx ROWS UNBOUNDED PRECEDING) AS grp FROM c1),
  clusters AS (SELECT video_id, min(start_ms) AS start_ms, max_by(end_ms, cue_idx) AS end_ms, count(*) AS n_hits,
    CAST(sum(score) AS BIGINT) AS score, min(cue_idx) AS first_idx, max(cue_idx) AS last_idx,
    max_by(start_ms, cue_idx) AS last_start_ms, min_by(back_ms, cue_idx) AS back_ms FROM c2 GROUP BY video_id, grp)
"""
SNAPPED = CLUSTERS.rstrip() + """,
  fw AS (SELECT c.*, b.cue_idx, b.end_ms AS ce, b.stop_fwd FROM clusters c JOIN b ON b.video_id = c.video_id
    AND b.cue_idx >= c.last_idx AND b.start_ms <= c.end_ms + 25000),
  snapped AS (SELECT video_id, any_value(back_ms) AS start_ms, coalesce(min_by(ce, cue_idx) FILTER (WHERE stop_fwd),
      max_by(ce, cue_idx)) AS end_ms, any_value(score) AS score, any_value(n_hits) AS n_hits
    FROM fw GROUP BY video_id, first_idx)
"""
DETECTED = SNAPPED.rstrip() + """,
  fl AS (SELECT *, greatest(0, 45000 - (end_ms - start_ms)) AS miss FROM snapped),
  detected AS (SELECT video_id, CAST(greatest(0, start_ms - miss // 2) AS BIGINT) AS start_ms,
    CAST(end_ms + (miss - miss // 2) AS BIGINT) AS end_ms, score, n_hits FROM fl)
"""

# -- caption payloads ---------------------------------------------------------------

# Rendered per document from its lines: cue i spans [4 i, 4 i + 3] seconds.


def _clock(ms):
    sec = F.floor(ms / 1000).cast("bigint")
    two = lambda n: F.lpad(n.cast("bigint").cast("string"), 2, "0")
    return F.concat(
        two(F.floor(sec / 3600)), F.lit(":"), two(F.floor(sec / 60) % 60), F.lit(":"), two(sec % 60),
        F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def doc_cues(d: Inputs):
    """One caption document per text document; cues live in the row as an array."""
    return d.doc_lines().select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("video_id"),
        F.transform(
            "lines",
            lambda x, i: F.struct(
                i.cast("bigint").alias("i"),
                F.replace(x["text"], F.lit("-->"), F.lit("->")).alias("text"),
            ),
        ).alias("cues"),
    )


def vtt_payloads(d: Inputs):
    def render(c):
        start = c["i"] * 4000
        end = F.when(c["i"] % 7 == 5, start).otherwise(start + 3000)
        body = (
            F.when(c["i"] % 5 == 1, F.concat(F.lit("<c>"), c["text"], F.lit("</c>\n<00:00:01.000>&amp; more")))
            .when(c["i"] % 5 == 2, F.lit("same line"))
            .when(c["i"] % 5 == 3, F.lit("same line"))
            .otherwise(c["text"])
        )
        return F.concat(
            _clock(start), F.lit(" --> "), _clock(end), F.lit(" align:start position:0%\n"), body, F.lit("\n\n")
        )

    return doc_cues(d).select(
        "video_id", F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(F.transform("cues", render), "")).alias("payload")
    )


def json3_payloads(d: Inputs):
    def event(c):
        half = F.floor(F.length(c["text"]) / 2).cast("int")
        return F.struct(
            (c["i"] * 4000).alias("tStartMs"),
            F.when(c["i"] % 3 != 0, F.lit(3000).cast("bigint")).alias("dDurationMs"),
            F.array(
                F.struct(F.substring(c["text"], F.lit(1), half).alias("utf8")),
                F.struct(F.substring(c["text"], half + 1, F.length(c["text"])).alias("utf8")),
            ).alias("segs"),
        )

    return doc_cues(d).select(
        "video_id", F.to_json(F.struct(F.transform("cues", event).alias("events"))).alias("payload")
    )


def xml_payloads(d: Inputs):
    def node(c):
        safe = c["text"]
        for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            safe = F.replace(safe, F.lit(raw), F.lit(ref))
        # Characters that XML 1.0 does not allow.
        safe = F.regexp_replace(safe, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
        dur = F.when(c["i"] % 3 == 0, F.lit("")).otherwise(F.lit(' dur="3.0"'))
        return F.concat(
            F.lit('<text start="'), (c["i"] * 4).cast("string"), F.lit('"'), dur, F.lit(">"), safe, F.lit("</text>")
        )

    return doc_cues(d).select(
        "video_id",
        F.concat(F.lit("<transcript>"), F.array_join(F.transform("cues", node), ""), F.lit("</transcript>")).alias("payload"),
    )


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
DOC_CUES = ", dc AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS video_id, rank AS i, replace(text, '-->', '->') AS text FROM doc_lines)"
DECODE = "{}"
for _entity, _char in vocab.ENTITIES:
    DECODE = f"replace({DECODE}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"
BODY = """, raw AS (SELECT video_id, i, i * 4000 AS start_ms, CASE WHEN i % 7 = 5 THEN 0 ELSE 3000 END AS dur,
    CASE WHEN i % 5 = 1 THEN '<c>' || text || '</c>{join}<00:00:01.000>&amp; more' WHEN i % 5 IN (2, 3) THEN 'same line'
      ELSE text END AS body FROM dc)"""
VTT_PIPELINE = DOC_CUES + BODY.format(join=" ") + f"""
  , t AS (SELECT video_id, i, start_ms, dur, {STRIP.format(DECODE.format("regexp_replace(body, '<[^>]+>', '', 'g')"))} AS text FROM raw),
  k AS (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY i) AS prev FROM t WHERE text <> '' AND dur > 0)
  SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 AS INT) AS cue_idx,
    CAST(start_ms AS BIGINT) AS start_ms, CAST(dur AS BIGINT) AS dur_ms, text FROM k WHERE prev IS NULL OR prev <> text"""
VTT_BENCH = DOC_CUES + BODY.format(join=" ") + f"""
  , t AS (SELECT video_id, i, start_ms, greatest(dur, 1) AS dur,
      {STRIP.format("regexp_replace(CASE WHEN i % 5 = 1 THEN '<c>' || text || '</c>' ELSE body END, '<[^>]+>', '', 'g')")}
      AS one, CASE WHEN i % 5 = 1 THEN '&amp; more' END AS two
    FROM (SELECT raw.*, dc.text FROM raw JOIN dc USING (video_id, i)))
  SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 AS INT) AS cue_idx,
    CAST(start_ms AS BIGINT) AS start_ms, CAST(dur AS BIGINT) AS dur_ms, text
  FROM (SELECT *, CASE WHEN two IS NULL THEN one WHEN one = '' THEN two ELSE one || ' ' || two END AS text FROM t)
  WHERE text <> ''"""


@query("cues_from_vtt", "doc_lines", VTT_PIPELINE)
def _vtt(d: Inputs):
    return T.cues_from_vtt(vtt_payloads(d))


@query("cues_from_vtt_bench", "doc_lines", VTT_BENCH)
def _vtt_bench(d: Inputs):
    return T.cues_from_vtt(vtt_payloads(d), variant="bench")


@query("cues_from_json3", "doc_lines", DOC_CUES + """
    SELECT video_id, CAST(i AS INT) AS cue_idx, CAST(i * 4000 AS BIGINT) AS start_ms,
      CAST(CASE WHEN i % 3 <> 0 THEN 3000 ELSE 2000 END AS BIGINT) AS dur_ms, trim(text) AS text FROM dc WHERE trim(text) <> ''""")
def _json3(d: Inputs):
    return T.cues_from_json3(json3_payloads(d))


@query("cues_from_xml", "doc_lines", DOC_CUES + r"""
    , c AS (SELECT video_id, i, trim(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS text FROM dc)
    SELECT video_id, CAST(i AS INT) AS cue_idx, CAST(i * 4000 AS BIGINT) AS start_ms,
      CAST(CASE WHEN i % 3 <> 0 THEN 3000 ELSE 2000 END AS BIGINT) AS dur_ms, text FROM c WHERE text <> ''""")
def _xml(d: Inputs):
    return T.cues_from_xml(xml_payloads(d))


#: Folders that the caption files of a run are dealt into.
FILE_FOLDERS = 1024


@query("read_captions", "doc_lines", DOC_CUES + r"""
    , n AS (SELECT *, CAST(substr(video_id, 2) AS BIGINT) % 4 AS kind FROM dc),
    c AS (SELECT video_id, kind, i, CASE WHEN kind = 0 THEN greatest(CASE WHEN i % 7 = 5 THEN 0 ELSE 3000 END, 1)
        WHEN i % 3 <> 0 THEN 3000 ELSE 2000 END AS dur,
      trim(CASE WHEN kind = 2 THEN regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') ELSE text END) AS text FROM n)
    SELECT video_id, count(*) AS n_cues, CAST(sum(dur) AS BIGINT) AS total_ms, CAST(max(i) * 4000 AS BIGINT) AS last_ms
    FROM c WHERE text <> '' OR (kind = 0 AND i % 5 IN (1, 2, 3)) GROUP BY 1""")
def _captions(d: Inputs):
    """Files of all formats, read by their names; those without a known extension hold XML, or JSON behind a mark or a blank line."""

    def part(payloads, kind: int, ext: str, before=F.lit("")):
        n = F.substring("video_id", 2, 18).cast("bigint") % 4
        return payloads.filter(n == kind).select(F.concat("video_id", F.lit(f".{ext}")).alias("name"), F.concat(before, "payload").alias("content"))

    odd = F.when(F.substring("video_id", 2, 18).cast("bigint") % 8 == 3, "\ufeff").otherwise("\n  ")
    files = (
        part(vtt_payloads(d), 0, "vtt").unionByName(part(json3_payloads(d), 1, "en.json3"))
        .unionByName(part(xml_payloads(d), 2, "en.xml")).unionByName(part(json3_payloads(d), 3, "ttml", odd))
    )
    path = new_shared_path(d.spark, "captions")
    write_named_files(files, path, folders=FILE_FOLDERS)
    return read_captions(d.spark, path).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_cues"), F.sum("dur_ms").alias("total_ms"), F.max("start_ms").alias("last_ms")
    )


@query("caption_failures", "", """, k AS (SELECT 'd' || doc_id AS video_id, doc_id % 6 AS kind FROM documents)
    SELECT video_id, CASE WHEN kind IN (3, 4) THEN 'vtt' ELSE 'ttml' END AS ext,
      CASE kind WHEN 0 THEN 'corrupt' WHEN 1 THEN 'empty' WHEN 2 THEN 'no cues' WHEN 3 THEN 'no cues' ELSE 'corrupt' END AS reason
    FROM k WHERE kind < 5""")
def _failures(d: Inputs):
    """Cut XML, nothing, an empty list of events, a header alone, prose as cues, and captions that are in order."""
    kind, size = F.col("doc_id") % 6, F.col("n_chars").cast("string")
    whole = F.concat(F.lit('<transcript><text start="1">'), size, F.lit("</text></transcript>"))
    content = (
        F.when(kind == 0, F.concat(F.lit('<transcript><text start="1">'), size)).when(kind == 1, " \n").when(kind == 2, '{"events": []}')
        .when(kind == 3, "WEBVTT\n\n").when(kind == 4, F.concat(F.lit("prose of "), size, F.lit(" characters"))).otherwise(whole)
    )
    name = F.concat(F.lit("d"), F.col("doc_id"), F.when(kind.isin(3, 4), ".vtt").otherwise(".ttml"))
    path = new_shared_path(d.spark, "captions")
    write_named_files(d.table("documents").select(name.alias("name"), content.alias("content")), path, folders=FILE_FOLDERS)
    return caption_failures(d.spark, path)


@query("caption_track_from_html", "page_tracks", r"""
    , t AS (SELECT page_id, regexp_extract(html, '"captionTracks":\s*(\[.*?\])', 1) AS js FROM page_tracks),
    u AS (SELECT page_id, from_json(js, '[{"languageCode":"VARCHAR","baseUrl":"VARCHAR"}]') AS tr FROM t)
    SELECT page_id, coalesce(list_filter(tr, lambda x: starts_with(x.languageCode, 'en'))[1], tr[1]).baseUrl AS track_url FROM u""")
def _track(d: Inputs):
    return T.caption_track_from_html(d.page_tracks()).select("page_id", "track_url")


@query("rank_caption_formats", "", """
    WITH c AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS video_id, event_id AS pos,
        CASE event_id % 4 WHEN 0 THEN 'fr' ELSE 'en' END AS lang,
        CASE event_id % 5 WHEN 0 THEN 'srv3' WHEN 1 THEN 'json3' WHEN 2 THEN 'ttml' WHEN 3 THEN 'vtt' ELSE 'xml' END AS ext,
        value > 100 AS parsed FROM events)
    SELECT video_id, pos, lang, ext, parsed FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY
        CASE ext WHEN 'vtt' THEN 0 WHEN 'json3' THEN 1 WHEN 'srv3' THEN 2 ELSE 99 END, pos) AS rn
      FROM c WHERE lang LIKE 'en%' AND parsed) WHERE rn = 1""")
def _formats(d: Inputs):
    c = d.table("events").selectExpr(
        "concat('u', CAST(user_id AS STRING)) AS video_id", "event_id AS pos",
        "CASE event_id % 4 WHEN 0 THEN 'fr' ELSE 'en' END AS lang",
        "CASE event_id % 5 WHEN 0 THEN 'srv3' WHEN 1 THEN 'json3' WHEN 2 THEN 'ttml' WHEN 3 THEN 'vtt' ELSE 'xml' END AS ext",
        "value > 100 AS parsed",
    )
    return T.rank_caption_formats(c)


# -- scoring and tagging ---------------------------------------------------------------


@query("keyword_vector", "cues", f"""
    SELECT video_id, cue_idx, array_to_string({sql_vector('text', vocab.VOCAB_PIPELINE)}, '') AS keyword_vec FROM cues""")
def _vector(d: Inputs):
    tagged = d.cues().withColumn("keyword_vec", X.keyword_vector(F.col("text")))
    return flat_vector(tagged, "keyword_vec").select("video_id", "cue_idx", "keyword_vec")


@query("keyword_vector_extension", "cues", f"""
    SELECT video_id, cue_idx, array_to_string({sql_vector('text', vocab.VOCAB_EXTENSION)}, '') AS keyword_vec FROM cues""")
def _vector_ext(d: Inputs):
    tagged = d.cues().withColumn("keyword_vec", X.keyword_vector(F.col("text"), vocab.VOCAB_EXTENSION))
    return flat_vector(tagged, "keyword_vec").select("video_id", "cue_idx", "keyword_vec")


POOLED = f""", v AS (SELECT video_id, start_ms // 30000 AS slot, {sql_vector('text', vocab.VOCAB_EXTENSION)} AS vec FROM cues),
    lg AS (SELECT video_id, slot, i, max(vec[i]) AS m FROM v, (SELECT unnest(range(1, 129)) AS i) GROUP BY ALL),
    pooled AS (SELECT video_id, slot, list(m ORDER BY i) AS vec FROM lg GROUP BY 1, 2)
"""


def pooled_vectors(d: Inputs):
    slots = d.cues().withColumn("slot", F.floor(F.col("start_ms") / 30000).cast("bigint"))
    return T.keyword_vector_pooled(slots, ["video_id", "slot"])


@query("keyword_vector_pooled", "cues", POOLED + "SELECT video_id, slot, array_to_string(vec, '') AS keyword_vec FROM pooled")
def _pooled(d: Inputs):
    return flat_vector(pooled_vectors(d), "keyword_vec")


@query("keyword_score", "cues", POOLED + f"""
    SELECT video_id, slot, round(CAST({sql_weighted('vec')} AS DOUBLE), 6) AS keyword_score, CAST(list_sum(vec) AS INT) AS n_keywords
    FROM pooled""")
def _keyword_score(d: Inputs):
    v = F.col("keyword_vec")
    return pooled_vectors(d).select(
        "video_id", "slot", F.round(X.keyword_score(v), 6).alias("keyword_score"), X.keyword_count(v).alias("n_keywords")
    )


@query("score_text", "cues", f"SELECT video_id, cue_idx, {sql_score_text('text')} AS score FROM cues")
def _score_text(d: Inputs):
    return d.cues().select("video_id", "cue_idx", X.score_text(F.col("text")).cast("int").alias("score"))


@query("score_cue", "cues", f"SELECT video_id, cue_idx, {sql_score_cue('text')} AS score FROM cues")
def _score_cue(d: Inputs):
    return d.cues().select("video_id", "cue_idx", X.score_cue(F.col("text")).alias("score"))


TAGS = ", ".join(
    f"CASE WHEN regexp_matches(trim(text), {sql_text(p)}) THEN '{name}' END" for name, p in vocab.SKIP_WORDINGS
)


@query("tag_text_multilang", "", f"""
    SELECT conv_id, turn, coalesce(array_to_string(list_filter([{TAGS}], lambda x: x IS NOT NULL), ','), '') AS tags
    FROM conversations""")
def _tags(d: Inputs):
    return d.table("conversations").select(
        "conv_id", "turn", F.array_join(X.skip_tags(F.col("text")), ",").alias("tags")
    )


@query("html_unescape", "", f"""
    SELECT page_id, md5(trim({DECODE.format("regexp_replace(html, '<[^>]+>', '', 'g')")})) AS text_md5 FROM pages""")
def _unescape(d: Inputs):
    return d.table("pages").select("page_id", F.md5(X.clean_caption(F.col("html"))).alias("text_md5"))


@query("fmt_time", "cues", """
    SELECT video_id, cue_idx, CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock
    FROM (SELECT video_id, cue_idx, start_ms // 1000 AS s FROM cues)""")
def _clock_text(d: Inputs):
    return d.cues().select("video_id", "cue_idx", X.format_clock(F.col("start_ms") / 1000).alias("clock"))


# -- windows over transcripts -----------------------------------------------------------


@query("build_windows", "labelled_cue_windows cues", f"""
    , w AS (SELECT w.video_id, w.window_idx, any_value(w.t_start_ms) AS t_start_ms, any_value(w.t_end_ms) AS t_end_ms,
        any_value(w.label) AS label, coalesce(string_agg(c.text, ' ' ORDER BY c.cue_idx), '') AS text
      FROM labelled_cue_windows w LEFT JOIN cues c ON c.video_id = w.video_id AND c.start_ms + c.dur_ms > w.t_start_ms
        AND c.start_ms < w.t_end_ms GROUP BY w.video_id, w.window_idx)
    SELECT *, array_to_string({sql_vector('text', vocab.VOCAB_PIPELINE)}, '') AS keyword_vec FROM w""")
def _build(d: Inputs):
    return flat_vector(W.build_windows(d.cues(), d.videos(), d.cue_segments()), "keyword_vec")


@query("anchored_windows", "cues", """
    , n AS (SELECT c.video_id, c.cue_idx, c.start_ms, (SELECT min(x.cue_idx) FROM cues x WHERE x.video_id = c.video_id
        AND x.start_ms >= c.start_ms + 5000) AS nxt FROM cues c),
    a(video_id, cue_idx, start_ms, nxt) AS (SELECT video_id, cue_idx, start_ms, nxt FROM n WHERE cue_idx = 0
      UNION ALL SELECT n.video_id, n.cue_idx, n.start_ms, n.nxt FROM a JOIN n ON n.video_id = a.video_id AND n.cue_idx = a.nxt)
    SELECT a.video_id, a.start_ms, max_by(c.start_ms + c.dur_ms, c.cue_idx) AS end_ms, count(*) AS n_cues,
      string_agg(c.text, ' ' ORDER BY c.cue_idx) AS text
    FROM a JOIN cues c ON c.video_id = a.video_id AND c.cue_idx >= a.cue_idx AND c.cue_idx < coalesce(a.nxt, 2000000000)
    GROUP BY a.video_id, a.start_ms""", recursive=True)
def _anchored(d: Inputs):
    return W.anchored_windows(d.cues())


@query("context_score", "cues", HITS + "SELECT video_id, cue_idx, start_ms, end_ms, score, back_ms FROM hits")
def _context(d: Inputs):
    return T.context_score(d.cues())


@query("cluster_hits", "cues", CLUSTERS + "SELECT * FROM clusters")
def _cluster(d: Inputs):
    return W.cluster_hits(T.context_score(d.cues()))


@query("snap_boundaries", "cues", SNAPPED + "SELECT * FROM snapped")
def _snap(d: Inputs):
    return T.snap_boundaries(W.cluster_hits(T.context_score(d.cues())), T.cue_breaks(d.cues()))


@query("detect_segments", "cues", DETECTED + "SELECT * FROM detected")
def _detect(d: Inputs):
    return T.detect_segments(d.cues())


@query("detect_segments_simple", "cues", f"""
    , h AS (SELECT * FROM (SELECT video_id, cue_idx, start_ms, start_ms + dur_ms AS end_ms, {sql_score_cue('text')} AS score
        FROM cues) WHERE score > 0),
    f AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY cue_idx) <= 8000 THEN 0 ELSE 1 END AS fresh FROM h),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY cue_idx ROWS UNBOUNDED PRECEDING) AS grp FROM f)
    SELECT video_id, CAST(greatest(0, min(start_ms) - 1500) AS BIGINT) AS start_ms, max_by(end_ms, cue_idx) + 2000 AS end_ms,
      CAST(sum(score) AS BIGINT) AS score, count(*) AS n_hits FROM g GROUP BY video_id, grp HAVING sum(score) >= 6""")
def _simple(d: Inputs):
    return W.detect_segments_simple(d.cues())


@query("merge_scored_windows", "predictions", """
    , k AS (SELECT video_id, window_idx * 5000 AS s, window_idx * 5000 + 5000 AS e, prob FROM predictions WHERE prob >= 0.5),
    f AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY video_id ORDER BY s) <= 8000 THEN 0 ELSE 1 END AS fresh FROM k),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS grp FROM f)
    SELECT * FROM (SELECT video_id, CAST(greatest(0, min(s) - 1500) AS BIGINT) AS start_ms, CAST(max(e) + 2000 AS BIGINT) AS end_ms,
      round(sum(prob) / count(*), 6) AS score, count(*) AS n_windows FROM g GROUP BY video_id, grp) WHERE end_ms - start_ms >= 8000""")
def _scored(d: Inputs):
    start = F.col("window_idx").cast("bigint") * 5000
    windows = d.predictions().withColumn("start_ms", start).withColumn("end_ms", start + 5000)
    # Six digits: means of two four-digit values sit exactly on a four-digit half.
    return W.merge_scored_windows(windows, digits=6)


# -- the detector scored against truth, end to end ------------------------------------------


BENCH = DETECTED.rstrip() + """,
    ev AS (SELECT video_id, t, sum(g) AS g, sum(d) AS d FROM (
      SELECT video_id, start_ms AS t, 1 AS g, 0 AS d FROM cue_segments UNION ALL SELECT video_id, end_ms, -1, 0 FROM cue_segments
      UNION ALL SELECT video_id, start_ms, 0, 1 FROM detected UNION ALL SELECT video_id, end_ms, 0, -1 FROM detected) GROUP BY 1, 2),
    sw AS (SELECT video_id, lead(t) OVER w - t AS len, sum(g) OVER w AS g, sum(d) OVER w AS d FROM ev
      WINDOW w AS (PARTITION BY video_id ORDER BY t)),
    inter AS (SELECT video_id, coalesce(sum(CASE WHEN g > 0 AND d > 0 THEN len END), 0) AS i FROM sw GROUP BY 1),
    gt AS (SELECT video_id, sum(end_ms - start_ms) AS gms, count(*) AS n FROM cue_segments GROUP BY 1),
    dt AS (SELECT video_id, sum(end_ms - start_ms) AS dms, count(*) AS n FROM detected GROUP BY 1)
    SELECT video_id, gt.n AS n_gt, coalesce(dt.n, 0) AS n_det, CAST(gms AS BIGINT) AS gt_ms, CAST(coalesce(dms, 0) AS BIGINT) AS det_ms,
      CAST(i AS BIGINT) AS inter_ms, CASE WHEN dt.n IS NULL THEN 1.0::DOUBLE ELSE round(i / dms::DOUBLE, 6) END AS "precision",
      CASE WHEN dt.n IS NULL THEN 0.0::DOUBLE ELSE round(i / gms::DOUBLE, 6) END AS recall,
      CASE WHEN dt.n IS NULL THEN 0.0::DOUBLE ELSE round(i / (gms + dms - i)::DOUBLE, 6) END AS iou, false AS true_negative
    FROM gt LEFT JOIN dt USING (video_id) LEFT JOIN inter USING (video_id)"""


@query("detection_benchmark", "cues cue_segments", BENCH)
def _benchmark(d: Inputs):
    truth = materialize(intervals.merge_intervals(d.cue_segments()), "truth")
    found = materialize(T.detect_segments(d.cues()), "detections")
    return rounded(intervals.segment_metrics(found, truth))


SUMMARY = BENCH.rstrip().replace("    SELECT video_id, gt.n AS n_gt", "    , met AS (SELECT video_id, gt.n AS n_gt", 1) + """),
    cov AS (SELECT g.video_id, g.start_ms, 2 * coalesce(sum(CASE WHEN d.start_ms IS NOT NULL THEN least(g.end_ms, d.end_ms)
        - greatest(g.start_ms, d.start_ms) END), 0) >= any_value(g.end_ms - g.start_ms) AS covered FROM cue_segments g
      LEFT JOIN detected d ON d.video_id = g.video_id AND d.end_ms > g.start_ms AND d.start_ms < g.end_ms GROUP BY 1, 2),
    av AS (SELECT count(*) AS n, avg("precision") AS p, avg(recall) AS r, avg(iou) AS iou, sum(n_gt) AS n_gt FROM met)
    SELECT av.n AS n_total, CAST(0 AS BIGINT) AS n_errors, CAST(0 AS BIGINT) AS n_no_captions, CAST(0 AS BIGINT) AS n_true_negative,
      av.n AS n_with_segments, round(p, 5) AS avg_precision, round(r, 5) AS avg_recall, round(iou, 5) AS avg_iou,
      CAST(n_gt AS BIGINT) AS n_gt, CAST(0 AS BIGINT) AS n_false_pos, (SELECT count_if(covered)::BIGINT FROM cov) AS n_covered,
      round((SELECT count_if(covered) FROM cov) * 100.0::DOUBLE / n_gt, 5) AS covered_pct,
      CASE WHEN r < 0.3 THEN 'low' WHEN r < 0.5 THEN 'moderate' ELSE 'ok' END AS recall_level,
      CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.5 THEN 'moderate' ELSE 'ok' END AS precision_level, iou >= 0.4 AS decent_iou FROM av"""


# Every video has captions and truth here, so the status counts are known.
@query("detection_benchmark_summary", "cues cue_segments", SUMMARY)
def _benchmark_summary(d: Inputs):
    # Each use of the cues would shuffle all texts again.  Videos are not stored: by so small a file, Spark would
    # take the truth that is made of them for small too, and broadcast it.
    cues = materialize(d.cues(), "cues", compression="zstd")
    videos = d.videos(cues)
    truth = materialize(intervals.merge_intervals(d.cue_segments(videos)), "truth")
    found = materialize(T.detect_segments(cues), "detections")
    both = truth.select("video_id").union(found.select("video_id"))
    status = cleaning.detection_status(videos, cues, both)
    return rounded(evaluate.detection_summary(status, found, truth), 5)


# -- the same over a cleaned crowd table, with every status ---------------------------------

CLEANED = DETECTED.rstrip() + """,
    name AS (SELECT video_id AS old, 'vid' || lpad(substr(video_id, 2), 8, '0') AS video_id, CAST(substr(video_id, 2) AS BIGINT) % 13 = 5 AS failed
      FROM videos),
    found AS (SELECT n.video_id, d.start_ms, d.end_ms FROM detected d JOIN name n ON n.old = d.video_id WHERE NOT failed),
    clean AS (SELECT videoID AS video_id, CAST(startTime AS BIGINT) * 1000 AS start_ms, CAST(endTime AS BIGINT) * 1000 AS end_ms,
        CAST(votes AS INT) AS votes FROM crowd_raw
      WHERE category = 'sponsor' AND "hidden" <> '1' AND shadowHidden <> '1' AND service IN ('', 'YouTube') AND CAST(votes AS INT) >= 1
        AND CAST(videoDuration AS INT) >= 60 AND length(videoID) = 11),
    conf AS (SELECT * FROM clean WHERE video_id IN (SELECT video_id FROM clean GROUP BY 1 HAVING max(votes) >= 3)),
    mo AS (SELECT *, max(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM conf),
    mn AS (SELECT *, sum(CASE WHEN start_ms - reach <= 2000 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms
        ROWS UNBOUNDED PRECEDING) AS grp FROM mo),
    truth AS (SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM mn GROUP BY video_id, grp),
    st AS (SELECT t.video_id, CASE WHEN coalesce(n.failed, false) THEN 'error' WHEN n.video_id IS NULL THEN 'no_captions'
        WHEN s.video_id IS NULL THEN 'true_negative' ELSE 'with_segments' END AS status
      FROM (SELECT video_id FROM name UNION SELECT video_id FROM truth) t LEFT JOIN name n USING (video_id)
        LEFT JOIN (SELECT video_id FROM truth UNION SELECT video_id FROM found) s USING (video_id))
"""
CLEANED_SUMMARY = CLEANED.rstrip() + """,
    sc AS (SELECT video_id FROM st WHERE status = 'with_segments'),
    sg AS (SELECT * FROM truth WHERE video_id IN (FROM sc)),
    sd AS (SELECT * FROM found WHERE video_id IN (FROM sc)),
    ev AS (SELECT video_id, t, sum(g) AS g, sum(d) AS d FROM (
      SELECT video_id, start_ms AS t, 1 AS g, 0 AS d FROM sg UNION ALL SELECT video_id, end_ms, -1, 0 FROM sg
      UNION ALL SELECT video_id, start_ms, 0, 1 FROM sd UNION ALL SELECT video_id, end_ms, 0, -1 FROM sd) GROUP BY 1, 2),
    sw AS (SELECT video_id, lead(t) OVER w - t AS len, sum(g) OVER w AS g, sum(d) OVER w AS d FROM ev WINDOW w AS (PARTITION BY video_id ORDER BY t)),
    inter AS (SELECT video_id, sum(CASE WHEN g > 0 AND d > 0 THEN len ELSE 0 END) AS i FROM sw GROUP BY 1),
    gt AS (SELECT video_id, sum(end_ms - start_ms) AS gms, count(*) AS n FROM sg GROUP BY 1),
    dt AS (SELECT video_id, sum(end_ms - start_ms) AS dms, count(*) AS n FROM sd GROUP BY 1),
    met AS (SELECT video_id, coalesce(gt.n, 0) AS n_gt, coalesce(dt.n, 0) AS n_det,
        CASE WHEN dt.n IS NULL THEN 1.0 WHEN gt.n IS NULL THEN 0.0 ELSE i / dms::DOUBLE END::DOUBLE AS p,
        CASE WHEN gt.n IS NULL THEN 1.0 WHEN dt.n IS NULL THEN 0.0 ELSE i / gms::DOUBLE END::DOUBLE AS r,
        CASE WHEN dt.n IS NULL OR gt.n IS NULL THEN 0.0 ELSE i / (gms + dms - i)::DOUBLE END::DOUBLE AS iou
      FROM sc LEFT JOIN gt USING (video_id) LEFT JOIN dt USING (video_id) LEFT JOIN inter USING (video_id)),
    cov AS (SELECT g.video_id, g.start_ms, 2 * coalesce(sum(CASE WHEN d.start_ms IS NOT NULL THEN least(g.end_ms, d.end_ms)
        - greatest(g.start_ms, d.start_ms) END), 0) >= any_value(g.end_ms - g.start_ms) AS covered FROM sg g
      LEFT JOIN sd d ON d.video_id = g.video_id AND d.end_ms > g.start_ms AND d.start_ms < g.end_ms GROUP BY 1, 2),
    av AS (SELECT avg(p) AS p, avg(r) AS r, avg(iou) AS iou, sum(n_gt) AS n_gt, sum(CASE WHEN n_gt = 0 THEN n_det ELSE 0 END) AS n_fp FROM met),
    c AS (SELECT count(*) AS n_total, count_if(status = 'error')::BIGINT AS n_errors, count_if(status = 'no_captions')::BIGINT AS n_no_captions,
      count_if(status = 'true_negative')::BIGINT AS n_true_negative, count_if(status = 'with_segments')::BIGINT AS n_with_segments FROM st)
    SELECT c.*, round(p, 5) AS avg_precision, round(r, 5) AS avg_recall, round(iou, 5) AS avg_iou, CAST(n_gt AS BIGINT) AS n_gt,
      CAST(n_fp AS BIGINT) AS n_false_pos, (SELECT count_if(covered)::BIGINT FROM cov) AS n_covered,
      round((SELECT count_if(covered) FROM cov) * 100.0::DOUBLE / n_gt, 5) AS covered_pct,
      CASE WHEN r < 0.3 THEN 'low' WHEN r < 0.5 THEN 'moderate' ELSE 'ok' END AS recall_level,
      CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.5 THEN 'moderate' ELSE 'ok' END AS precision_level, iou >= 0.4 AS decent_iou FROM c, av"""


def cleaned_benchmark(d: Inputs):
    """(status, found, truth) of the crowd videos: clean, keep confident videos, merge, detect."""
    captioned = d.videos().withColumn("n", F.substring("video_id", 2, 20).cast("bigint")).select(
        "video_id", F.concat(F.lit("vid"), F.lpad(F.col("n").cast("string"), 8, "0")).alias("name"), (F.col("n") % 13 == 5).alias("failed"))
    captioned = materialize(captioned, "captioned")
    kept = cleaning.videos_with_confident_segment(cleaning.clean_segments_bench(d.crowd_raw()), 3)
    truth = materialize(intervals.merge_intervals(kept), "truth")
    cues = d.cues().join(captioned.filter("NOT failed").drop("failed"), "video_id").drop("video_id").withColumnRenamed("name", "video_id")
    found = materialize(T.detect_segments(cues), "detections")
    named = captioned.select(F.col("name").alias("video_id"), "failed")
    tested = named.select("video_id").union(truth.select("video_id")).distinct()
    both = truth.select("video_id").union(found.select("video_id"))
    status = cleaning.detection_status(tested, named, both, errors=named.filter("failed"))
    return materialize(status, "status"), found, truth


@query("detection_status_cleaned", "cues videos crowd_raw", CLEANED + "SELECT video_id, status FROM st")
def _status_cleaned(d: Inputs):
    return cleaned_benchmark(d)[0]


@query("detection_summary_cleaned", "cues videos crowd_raw", CLEANED_SUMMARY)
def _summary_cleaned(d: Inputs):
    """B2, B4, E6, E8, G1, F12 in a row, through the JSON report."""
    status, found, truth = cleaned_benchmark(d)
    path = new_shared_path(d.spark, "report")
    summary = rounded(evaluate.detection_summary(status, found, truth), 5)
    write_detection_report(summary, intervals.segment_metrics(found, truth), path)
    return d.spark.read.schema(summary.schema).json(f"{path}/summary")


# -- baselines over built windows ---------------------------------------------------------

FIRST64 = sql_weighted("vec", 4)


@query("keyword_baseline", "labelled_cue_windows cues", f"""
    , w AS (SELECT w.video_id, w.window_idx, any_value(w.label) AS label, coalesce(string_agg(c.text, ' ' ORDER BY c.cue_idx), '') AS text
      FROM labelled_cue_windows w LEFT JOIN cues c ON c.video_id = w.video_id AND c.start_ms + c.dur_ms > w.t_start_ms
        AND c.start_ms < w.t_end_ms GROUP BY w.video_id, w.window_idx),
    p AS (SELECT label, {FIRST64} >= 2.0 AS hit FROM (SELECT label, {sql_vector('text', vocab.VOCAB_PIPELINE)} AS vec FROM w)),
    c AS (SELECT count_if(hit AND label = 1)::BIGINT AS tp, count_if(hit AND label = 0)::BIGINT AS fp,
      count_if(NOT hit AND label = 1)::BIGINT AS fn, count_if(NOT hit AND label = 0)::BIGINT AS tn FROM p),
    s AS (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS p, tp / greatest(tp + fn, 1)::DOUBLE AS r FROM c)
    SELECT tp, fp, fn, tn, round(p, 6) AS "precision", round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-7::DOUBLE), 6) AS f1,
      round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy FROM s""")
def _baseline(d: Inputs):
    built = intervals.cues_in_window(labelled(d), d.cues()).withColumn(
        "keyword_vec", X.keyword_vector(F.col("text"))
    )
    return rounded(evaluate.keyword_baseline(built))


@query("error_keyword_signal", "labelled_cue_windows cues", f"""
    , w AS (SELECT w.video_id, w.window_idx, any_value(w.label) AS label, coalesce(string_agg(c.text, ' ' ORDER BY c.cue_idx), '') AS text
      FROM labelled_cue_windows w LEFT JOIN cues c ON c.video_id = w.video_id AND c.start_ms + c.dur_ms > w.t_start_ms
        AND c.start_ms < w.t_end_ms GROUP BY w.video_id, w.window_idx),
    v AS (SELECT *, {sql_vector('text', vocab.VOCAB_PIPELINE)} AS vec, (window_idx * 37 % 100) / 100.0::DOUBLE AS prob FROM w),
    t AS (SELECT CASE WHEN label = 1 AND prob < 0.5 THEN 'FN' WHEN label = 0 AND prob >= 0.5 THEN 'FP' WHEN label = 1 THEN 'TP'
        ELSE 'TN' END AS error_type, {sql_weighted('vec')} AS ks, list_sum(vec) AS nk FROM v)
    SELECT error_type, count(*) AS n, round(CAST(avg(ks) AS DOUBLE), 6) AS mean_score, round(CAST(avg(nk) AS DOUBLE), 6) AS mean_keywords,
      count_if((error_type = 'FP' AND nk = 0) OR (error_type = 'FN' AND ks >= 3.0))::BIGINT AS n_suspicious,
      round(count_if((error_type = 'FP' AND nk = 0) OR (error_type = 'FN' AND ks >= 3.0)) / count(*)::DOUBLE, 6) AS suspicious_share
    FROM t WHERE error_type <> 'TN' GROUP BY 1""")
def _signal(d: Inputs):
    built = intervals.cues_in_window(labelled(d), d.cues()).withColumn("vec", X.keyword_vector(F.col("text")))
    scored = built.withColumn("prob", (F.col("window_idx") * 37 % 100) / 100.0)
    typed = evaluate.error_types(scored).withColumn("keyword_score", X.keyword_score(F.col("vec"))).withColumn(
        "n_keywords", X.keyword_count(F.col("vec"))
    )
    return rounded(evaluate.error_keyword_signal(typed))
