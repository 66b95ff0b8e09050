"""Phrase scores, vectors, caption formats."""

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cuelake import vocab
from cuelake.functions import text as X
from cuelake.operators import text as T
from cuelake.sources.captions import caption_failures, read_captions


@pytest.fixture(scope="module")
def scored(spark):
    texts = [
        "and that wraps up today's tutorial", "", "Sponsored by Acme Corp", "BROUGHT TO YOU BY acme",
        "Sign up for free today", "Use my code SAVE20 for 20 percent off, just sign up first",
        "Today's sponsor is Brilliant. Go to brilliant.com to get started",
        "Use promo code TUBE for 15% off", "Link is in the description below", "Start your free trial today",
        "partnered with acme",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    out = df.select("t", X.score_text(F.col("t")).alias("a"), X.score_cue(F.col("t")).alias("b")).collect()
    return {r["t"]: (r["a"], r["b"]) for r in out}


def test_context_score_values(scored):
    assert scored["and that wraps up today's tutorial"][0] == 0
    assert scored[""] == (0, 0)
    assert scored["Sponsored by Acme Corp"][0] == 3
    assert scored["BROUGHT TO YOU BY acme"][0] == 3
    assert scored["Sign up for free today"][0] == 1
    assert scored["Use my code SAVE20 for 20 percent off, just sign up first"][0] >= 7
    assert scored["Today's sponsor is Brilliant. Go to brilliant.com to get started"][0] >= 6
    for t in ("Use promo code TUBE for 15% off", "Link is in the description below", "Start your free trial today"):
        assert scored[t][0] >= 3


def test_gate_hides_strong_phrase_without_gate_word(scored):
    assert scored["partnered with acme"] == (0, 0)


def test_simple_score_counts_distinct_patterns(scored):
    assert scored["Sponsored by Acme Corp"][1] == 3
    assert scored["Sign up for free today"][1] == 1


def test_every_pattern_keeps_its_mandatory_literal():
    import re

    samples = {
        r"\bsave\s+\d+\b": "save 20", r"\be.?commerce\b": "E-Commerce", r"(?:sponsored|presented) by": "PRESENTED by",
        r"\bhead\s+(over\s+)?to\b": "Head to",
    }
    for pattern, text in samples.items():
        assert re.search(pattern, text, re.I)
        assert X.required_literal(pattern) in text.lower()
    for pattern in vocab.VOCAB_PIPELINE + vocab.VOCAB_EXTENSION:
        assert X.required_literal(pattern), pattern


def test_vector_masks_round_trip(spark):
    df = spark.createDataFrame([("sponsored by us, use code X, antivirus, fintech",)], "t STRING")
    vec = X.keyword_vector(F.col("t"))
    low, high = X.vector_to_masks(vec)
    r = df.select(vec.alias("v"), X.masks_to_vector(low, high).alias("w"), X.keyword_score(vec).alias("s"),
                  X.keyword_count(vec).alias("n")).first()
    assert r["v"] == r["w"] and len(r["v"]) == 128
    hits = [i for i, x in enumerate(r["v"]) if x]
    assert hits == [0, 16, 117, 127]
    assert r["s"] == 3 + 1.5 + 0.5 + 0.5 and r["n"] == 4


def test_pooled_vector_misses_phrase_split_over_cues(spark):
    df = spark.createDataFrame([("w", "go"), ("w", "to shop now"), ("x", "go to it")], "k STRING, text STRING")
    out = {r["k"]: [i for i, x in enumerate(r["keyword_vec"]) if x]
           for r in T.keyword_vector_pooled(df, ["k"], patterns=vocab.VOCAB_PIPELINE).collect()}
    assert out == {"w": [80], "x": [29]}


def test_skip_tags(spark):
    df = spark.createDataFrame([(" Skip Ads ",), ("スキップ",), ("  ",), ("skipping",)], "t STRING")
    out = [r[0] for r in df.select(X.skip_tags(F.col("t"))).collect()]
    assert out == [["skip_ad", "skip_ads"], ["ja"], [], []]


def test_clock(spark):
    df = spark.createDataFrame([(0.0,), (65.9,), (3725.0,)], "s DOUBLE")
    assert [r[0] for r in df.select(X.format_clock(F.col("s"))).collect()] == ["0:00", "1:05", "62:05"]


VTT = """WEBVTT
Kind: captions

00:00:01.000 --> 00:00:03.500 align:start
<c>Hello</c> <00:00:01.500><c>world</c>

02:30.000 --> 02:35.500
Line one
line two

01:02:03.456 --> 01:02:05.000
Line one line two

bad --> 00:10.000
lost

00:20.000 --> 00:20.000
&amp; zero
"""


def parse(spark, payload, **kw):
    df = spark.createDataFrame([("v", payload)], "video_id STRING, payload STRING")
    return [tuple(r)[1:] for r in T.cues_from_vtt(df, **kw).orderBy("cue_idx").collect()]


def test_vtt_variants(spark):
    assert parse(spark, VTT, variant="bench") == [
        (0, 1000, 2500, "Hello world"), (1, 150000, 5500, "Line one line two"),
        (2, 3723456, 1544, "Line one line two"), (3, 20000, 1, "&amp; zero"),
    ]
    # Pipeline: equal neighbours collapse, a zero length goes.
    assert parse(spark, VTT) == [(0, 1000, 2500, "Hello world"), (1, 150000, 5500, "Line one line two")]
    assert parse(spark, "WEBVTT\r\n\r\n") == []


def test_vtt_timing_line_inside_block(spark):
    text = "00:01.000 --> 00:02.000\na\n00:03.000 --> 00:04.000\nb\n"
    assert parse(spark, text) == [(0, 1000, 1000, "a"), (1, 3000, 1000, "b")]
    joined = parse(spark, text, variant="bench")
    assert joined == [(0, 1000, 1000, "a 00:03.000 --> 00:04.000 b")]


def test_xml_and_json3(spark):
    xml = '<transcript><text start="1.5" dur="2.5">Hello\nthere</text><text start="4"></text><text start="5">x &amp; y</text></transcript>'
    df = spark.createDataFrame([("v", xml), ("w", "<broken")], "video_id STRING, payload STRING")
    assert rows(T.cues_from_xml(df).drop("cue_idx")) == [("v", 1500, 2500, "Hello there"), ("v", 5000, 2000, "x & y")]
    js = '{"events":[{"tStartMs":90000,"dDurationMs":1500,"segs":[{"utf8":"Hello "},{"utf8":"world"}]},{"tStartMs":1,"segs":[{"utf8":"\\n"}]},{"segs":[{"utf8":"z"}]}]}'
    df = spark.createDataFrame([("v", js), ("w", "{}"), ("x", "no json")], "video_id STRING, payload STRING")
    assert rows(T.cues_from_json3(df).drop("cue_idx")) == [("v", 0, 2000, "z"), ("v", 90000, 1500, "Hello world")]


def test_read_captions_routes_by_extension(spark, tmp_path):
    (tmp_path / "a.en.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nfrom vtt\n")
    (tmp_path / "b.json3").write_text('{"events":[{"tStartMs":1000,"segs":[{"utf8":"from json"}]}]}')
    (tmp_path / "c.xml").write_text('<transcript><text start="1" dur="1">from xml</text></transcript>')
    (tmp_path / "d.ttml").write_text('{"events":[{"tStartMs":2000,"segs":[{"utf8":"fallback"}]}]}')
    got = rows(read_captions(spark, str(tmp_path)).select("video_id", "text"))
    assert got == [("a", "from vtt"), ("b", "from json"), ("c", "from xml"), ("d", "fallback")]


def test_fallback_goes_by_what_could_be_read(spark, tmp_path):
    """XML is tried first, then JSON, whatever the first character is; the rest is told why it gave nothing."""
    event = '{"events":[{"tStartMs":2000,"segs":[{"utf8":"%s"}]}]}'
    files = {
        "a.ttml": "\n\t " + event % "after a blank line", "b.ttml": "\ufeff" + event % "after a mark", "c": "  <transcript><text start='1'>xml</text></transcript>",
        "d.ttml": "<transcript></transcript>", "e.ttml": "<transcript><text start='1'>cut", "f.ttml": "\n", "g.json3": "{", "h.vtt": "WEBVTT\n\n", "i.vtt": "prose",
        "j.ttml": '{"events":[]}', "k.srv3": event % "by extension", "l.json3": "<transcript><text start='1'>not asked</text></transcript>",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    assert rows(read_captions(spark, str(tmp_path)).select("video_id", "start_ms", "text")) == [
        ("a", 2000, "after a blank line"), ("b", 2000, "after a mark"), ("c", 1000, "xml"), ("k", 2000, "by extension")]
    assert [(r[0], r[2]) for r in rows(caption_failures(spark, str(tmp_path)))] == [
        ("d", "no cues"), ("e", "corrupt"), ("f", "empty"), ("g", "corrupt"), ("h", "no cues"), ("i", "corrupt"), ("j", "no cues"), ("l", "corrupt")]


def test_track_choice(spark):
    html = 'x "captionTracks": [{"languageCode":"fr","baseUrl":"f"},{"languageCode":"en-GB","baseUrl":"e"}], y'
    only = '"captionTracks":[{"languageCode":"fr","baseUrl":"f"}]'
    df = spark.createDataFrame([(html,), (only,), ("none",)], "html STRING")
    assert [r["track_url"] for r in T.caption_track_from_html(df).collect()] == ["e", "f", None]


@pytest.mark.parametrize("lines", [1, 1_000, 100_000])
def test_vtt_blocks_of_many_lines(spark, lines):
    """No pattern is matched across lines, so a block may have any number of them."""
    body = "\n".join(f"line {i}" for i in range(lines))
    payload = f"WEBVTT\n\n00:01.000 --> 00:02.000\n{body}\n\n00:03.000 --> 00:04.000\nlast\n"
    df = spark.createDataFrame([("v", payload)], "video_id STRING, payload STRING")
    for variant in ("pipeline", "bench"):
        got = T.cues_from_vtt(df, variant=variant).orderBy("cue_idx").collect()
        assert [(r.start_ms, r.dur_ms) for r in got] == [(1000, 1000), (3000, 1000)]
        assert got[0].text == body.replace("\n", " ") and got[1].text == "last"


def test_patterns_follow_unicode_words(spark):
    """Letters of any alphabet are word characters; curly quotes and special blanks are not."""
    cases = {
        "ésponsored by x": 0, "“sponsored by x”": 1, "sponsored by x": 1, "SPONſORED by x": 1,
        "use my code été": 1, "épromo codeé": 0,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t STRING")
    strong = X.matches_any(F.col("t"), [r"\bsponsored\s+by\b", r"\bmy\s+code\s+\w+", r"\bpromo\s+code\b"])
    got = {r.t: int(r.hit) for r in df.select("t", strong.alias("hit")).collect()}
    import re

    want = {t: int(any(re.search(p, t, re.I) for p in (r"\bsponsored\s+by\b", r"\bmy\s+code\s+\w+", r"\bpromo\s+code\b"))) for t in cases}
    assert got == want == cases


def test_required_tokens():
    assert X.required_tokens(r"brought\s+to\s+you") == [{"brought"}, {"to"}, {"you"}]
    assert X.required_tokens(r"use\s+(?:my\s+)?(?:code|link)") == [{"use"}, {"code", "link"}]
    assert X.required_tokens(r"a.b|c") == [] and X.required_tokens("thanks?") == [{"thank"}]


def test_token_masks_rule_out_no_match(spark):
    """Where the gate matches texts that are joined by blanks, their combined masks say that it can."""
    rng = random.Random(12)
    parts = [w for p in vocab.GATE_PHRASES for w in re.sub(r"\\s\+|[?:().|{},\\+]", " ", p).split()] + ["the", "Sponsor", "OFF", "50%", "x.com", "ſponsor", "today's", "50% off", "for free"]
    rows = [(k, i, " ".join(rng.choices(parts, k=rng.randint(0, 4)))) for k in range(400) for i in range(3)] + [(-1, 0, None), (-2, 0, "brought"), (-2, 1, "to you"), (-3, 0, "sign"), (-3, 1, "off")]
    df = spark.createDataFrame(rows, "k INT, i INT, text STRING")
    gate = X.TokenFilter(vocab.GATE_PHRASES)
    joined = df.withColumn("m", gate.mask(F.col("text"))).groupBy("k").agg(
        F.bit_or("m").alias("m"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("text"))
    got = joined.select("k", gate.possible(F.col("m")).alias("may"), X.matches_any(F.col("text"), vocab.GATE_PHRASES).alias("does")).collect()
    assert all(r.may for r in got if r.does) and any(r.does for r in got) and not all(r.may for r in got)
    may = {r.k: r.may for r in got}
    assert may[-2] and not may[-1]


def test_only_possible_patterns_are_counted(spark):
    """A text is held against the patterns it has the literals of, and the counts are those of all patterns."""
    rng = random.Random(7)
    pieces = [w for p in [*vocab.STRONG_PHRASES, *vocab.WEAK_PHRASES] for w in re.findall(r"[A-Za-z0-9'%.]+", p)]
    pieces += ["sponsored by", "Use my code", "go to acme.com", "SIGN UP", "free trial", "no cost", "12", "İ", "été", "."]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["Go TO it", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    for patterns in (vocab.STRONG_PHRASES, vocab.WEAK_PHRASES):
        found = df.select("t", X.found_in(
            F.col("t"), n=lambda t, low: X.count_matches(t, low, patterns), some=lambda _, low: X.possible_alternation(low, patterns),
            every=lambda t, _: F.regexp_count(t, F.lit("(?i)" + X.alternation(patterns)))).alias("f")).select("t", "f.*").collect()
        assert all(r.n == r.every for r in found) and sum(r.n or 0 for r in found) > 20
        assert {r.some for r in found if r.t in ("Go TO it", "")} == {""}
        assert any(0 < r.some.count("|(?:") < len(patterns) - 1 for r in found if r.t)


def test_leading_words():
    assert X.leading_words(r"\b(?:go|download)\s+to\b") == {"go", "dow"} and X.leading_words(r"\bno\b") == {"no"}
    assert X.leading_words(r"\bthe?\s+x") == {"th", "the"} and X.leading_words(r"\b(?:my )?code") == {"my", "cod"}
    assert all(X.leading_words(p) is None for p in (r"\b\d+% off", r"sponsor", r"\bgo", r"\bab?\w+", r"\be.?commerce"))


def test_vectors_are_those_of_the_patterns_alone(spark):
    """Beginnings of words rule out no pattern that matches."""
    rng = random.Random(8)
    for patterns in (vocab.VOCAB_PIPELINE, vocab.VOCAB_EXTENSION):
        pieces = [w for p in patterns for w in re.findall(r"[A-Za-z0-9'%.]+", re.sub(r"\\[a-z]", " ", p))]
        pieces += ["go to", "Sponsored BY", "5 days", "50% off", "use code", "no risk", "_", "é", "İn", "e-commerce", "for just $5", "to.go", "-app-"]
        texts = [rng.choice(["", " ", "“"]).join(" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(3)) for _ in range(400)]
        texts += ["in the bio", "go to", "IN\tthe bio", "e\u0301sponsored by", "", None] + [" ".join(re.findall(r"[A-Za-z0-9']+", re.sub(r"\\[a-z]|\?|\{.*?\}", " ", p))) for p in patterns]
        df = spark.createDataFrame([(t,) for t in texts], "t STRING")
        plain = X.found_in(F.coalesce("t", F.lit("")), v=lambda t, _: F.array(*[t.rlike("(?i)" + p).cast("tinyint") for p in patterns]))["v"]
        found = df.select("t", X.keyword_vector(F.col("t"), patterns).alias("got"), plain.alias("want")).collect()
        assert all(r.got == r.want for r in found) and sum(sum(r.want) for r in found) > 100


def test_caption_files_are_not_a_task_each(spark, tmp_path):
    """Many small files in folders are read by a bounded number of tasks, each once and whole, hidden and empty ones left out."""
    from cuelake.sources.files import READERS, read_named_files, write_named_files

    n = 40 * READERS
    docs = spark.range(n).selectExpr("concat('d', id, '.ttml') AS name", "concat('text ü\n', id) AS content")
    assert write_named_files(docs, str(tmp_path / "in"), folders=16) == n
    (tmp_path / "in" / "0003" / ".part").write_text("hidden")
    (tmp_path / "in" / "0003" / "empty.vtt").write_text("")
    (tmp_path / "in" / "top.vtt").write_text("top")
    got = read_named_files(spark, str(tmp_path / "in"))
    assert got.rdd.getNumPartitions() <= READERS
    assert sorted(map(tuple, got.collect())) == sorted([("top.vtt", "top"), *((f"d{i}.ttml", f"text ü\n{i}") for i in range(n))])
    assert [tuple(r) for r in read_named_files(spark, str(tmp_path / "in" / "top.vtt")).collect()] == [("top.vtt", "top")]
