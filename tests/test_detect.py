"""Context detector: hits, clusters, boundaries, floor."""

import random
import time

import pytest
from conftest import cue_table, rows
from pyspark.sql import functions as F

from cuelake import fixtures
from cuelake.catalog import QUERIES
from cuelake.operators import text as T, windows as W
from cuelake.session import materialize

SAVE = "Brought to you by Acme, use my code SAVE for percent off"
TRIAL = "Visit acme.com for a free trial today"
FAR = 60 + 5 + 120 + 25 + 10

CASES = {
    "none": [(0, 3, "Welcome to my channel"), (3, 3, "Today we learn Python"), (6, 3, "Let's get started with the basics")],
    "single": [(60, 5, "Sponsored by Acme Corp")],
    "split": [(60, 3, "this video is brought"), (63, 3, "to you by Acme Corp")],
    "floor": [(100, 5, "Sponsored by Acme, go to acme.com for a free trial"), (105, 5, "Use my code ACME for 20 percent off")],
    "zero": [(0, 5, SAVE), (5, 5, TRIAL)],
    "two": [(60, 5, SAVE), (65, 5, TRIAL), (FAR, 5, SAVE), (FAR + 5, 5, TRIAL)],
    "near": [(60, 5, SAVE), (70, 5, TRIAL)],
    "silence_before": [(0, 3, "Welcome to my channel today"), (60, 5, SAVE), (65, 5, TRIAL)],
    "silence_after": [(60, 5, SAVE), (65, 5, TRIAL), (120, 3, "Alright back to the tutorial where we left off")],
    "intro": [(55, 3, "but before we get into it"), (58, 2, "today's video is brought to you by Acme Corp"),
              (60, 5, "Go to acme.com and use code SAVE for 20 percent off")],
    "return": [(60, 5, SAVE), (65, 5, TRIAL), (70, 3, "anyway, let's get back to it"), (73, 5, "So the key insight")],
}


@pytest.fixture(scope="module")
def found(spark):
    out = {name: [] for name in CASES}
    for r in T.detect_segments(cue_table(spark, CASES)).orderBy("video_id", "start_ms").collect():
        out[r["video_id"]].append((r["start_ms"] / 1000, r["end_ms"] / 1000))
    return out


def test_counts(found):
    counts = {k: len(v) for k, v in found.items()}
    assert counts == {k: {"none": 0, "two": 2}.get(k, 1) for k in CASES}


def test_bounds(found):
    (s, e), = found["floor"]
    assert s <= 100 and e >= 110 and e - s >= 45
    assert found["zero"][0][0] == 0
    assert found["silence_before"][0][0] > 3
    assert found["silence_after"][0][1] < 120
    assert found["intro"][0][0] <= 55
    (s, e), = found["return"]
    assert s <= 60 and 70 <= e < 120
    (s, e), = found["single"]
    assert (s, e) == (40.0, 85.0)


def sequential(cues):
    """Plain restatement over one video's (start, dur, text) list, in ms."""
    import re

    from cuelake import vocab as v

    def any_of(patterns, text):
        return any(re.search(p, text, re.I) for p in patterns)

    def points(text):
        if not any_of(v.GATE_PHRASES, text):
            return 0
        count = lambda ps: len(list(re.finditer("|".join(f"(?:{p})" for p in ps), text, re.I)))
        return 3 * count(v.STRONG_PHRASES) + count(v.WEAK_PHRASES)

    n = len(cues)
    ends = [s + d for s, d, _ in cues]
    hits = []
    for i, (s, _, _) in enumerate(cues):
        around = " ".join(t for a, _, t in cues if abs(a - s) <= 12500)
        if points(around) >= 3:
            hits.append(i)
    clusters = []
    for i in hits:
        if clusters and cues[i][0] - ends[clusters[-1][-1]] <= 120000:
            clusters[-1].append(i)
        else:
            clusters.append([i])
    out = []
    for c in clusters:
        start = cues[c[0]][0]
        for j in range(c[0], -1, -1):
            if cues[c[0]][0] - cues[j][0] > 25000:
                break
            if (j and cues[j][0] - ends[j - 1] > 1500) or any_of(v.INTRO_PHRASES, cues[j][2]):
                start = cues[j][0]
                break
        end = ends[c[-1]]
        for j in range(c[-1], n):
            if cues[j][0] > ends[c[-1]] + 25000:
                break
            end = ends[j]
            if j + 1 < n and (cues[j + 1][0] - ends[j] > 1500 or any_of(v.RETURN_PHRASES, cues[j + 1][2])):
                break
        miss = max(0, 45000 - (end - start))
        out.append((max(0, start - miss // 2), end + miss - miss // 2))
    return out


def test_long_videos_equal_the_sequential_detector(spark, monkeypatch):
    """Many chunk borders: tiny index and time chunks must not change anything."""
    monkeypatch.setattr(T, "INDEX_CHUNK", 7)
    monkeypatch.setattr(T, "TIME_CHUNK_MS", 30_000)
    rng = random.Random(5)
    words = ["hello there", "this is fine", SAVE, "before we get into it", "anyway back to the video", "sign up",
             "link is in", "the description", "nothing here", "more text", "and so on", "okay then"]
    videos = {}
    for v in range(6):
        at, cues = 0, []
        for _ in range(150 if v else 600):
            at += rng.choice([1000, 2000, 3000, 4000, 9000, 30000, 70000])
            text = rng.choice(words) if rng.random() < 0.2 else "plain words"
            cues.append((at / 1000, rng.choice([0.5, 2, 3, 4, 40]), text))
        videos[f"v{v}"] = cues
    got = rows(T.detect_segments(cue_table(spark, videos)).select("video_id", "start_ms", "end_ms"))
    want = sorted(
        (v, s, e) for v, cues in videos.items()
        for s, e in sequential([(int(a * 1000), int(d * 1000), t) for a, d, t in cues])
    )
    assert got == want and len(got) > 10


def test_a_stored_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    counts = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):  # files go a moment later
        if (left := disk.getAllFiles().size()) <= before:
            break
        time.sleep(0.1)
    assert left <= before
    assert rows(counts) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_the_summary_makes_and_scores_its_cues_once(spark, monkeypatch):
    made, scored = [], []
    monkeypatch.setattr(fixtures.Inputs, "cues", lambda self, _cues=fixtures.Inputs.cues: made.append(1) or _cues(self))
    monkeypatch.setattr(T, "materialize", lambda df, label, _m=T.materialize: scored.append(label) or _m(df, label))
    [row] = QUERIES["detection_benchmark_summary"](spark, "/root/testdata/sf0.001").collect()
    assert len(made) == 1 and scored == ["hits"]
    assert row["n_total"] == row["n_with_segments"] == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.expr("doc_id div 20")).distinct().count()


def test_simple_detector(spark):
    cues = {"a": [(10, 2, "use my code"), (15, 2, "free trial"), (40, 2, "sign up")], "b": [(0.5, 1, "promo code and coupon code")]}
    assert rows(W.detect_segments_simple(cue_table(spark, cues))) == [
        ("a", 8500, 19000, 6, 2), ("b", 0, 3500, 6, 1),
    ]
