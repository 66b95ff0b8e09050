"""The near-duplicates stage against brute-force Jaccard similarity."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cuelake.llm import similar
from cuelake.llm.common import Hot

from .conftest import SCHEMA, prose


def plain_set(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Counter of the doc_ids that stay: the smallest of each component of pairs with 5 |A and B| >= 4 |A or B|."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [plain_set(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return Counter(rows[k][0] for k in range(len(rows)) if find(k) == k)


def copies(seed=3):
    """Texts with a common passage, chains of ever more changed copies, and a large group of near copies."""
    rng = random.Random(seed)
    passage, out = prose(rng, 40), []
    for _ in range(40):
        words = f"{prose(rng, rng.randint(5, 160))} {passage} {prose(rng, rng.randint(5, 60))}".split()
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
            out.append(" ".join(words))
    base = prose(rng, 120).split()
    for k in range(60):
        own = list(base)
        own[rng.randrange(len(own))] = f"own{k}"
        out.append(" ".join(own))
    rng.shuffle(out)
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(out)]


def test_one_changed_word_in_a_hundred_is_a_near_copy(spark):
    words = prose(random.Random(1), 100).split()
    other = [*words[:50], "changed", *words[51:]]
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join(other), "en", "s", 1)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert [r.doc_id for r in kept.collect()] == [1]


@pytest.mark.parametrize("share", [1, 10 ** 9])
def test_stage_equals_brute_force_with_any_order(spark, monkeypatch, share):
    monkeypatch.setattr(similar, "SHARE", share)  # all texts, or none, show what is common
    rows = copies()
    want = plain_kept(rows)
    assert 20 < len(want) < len(rows) - 60
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), "")
    assert Counter(r.doc_id for r in kept.collect()) == want


def made_pairs(spark, monkeypatch, rows):
    """(doc_ids that stay, pairs that were held against sketches)."""
    seen, inner = [], similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, *rest: (seen.append(pairs.distinct().count()), inner(pairs, *rest))[1])
    kept = similar.keep_dissimilar(spark.createDataFrame(rows, SCHEMA).repartition(4))
    return Counter(r.doc_id for r in kept.collect()), sum(seen)


@pytest.mark.parametrize("n", [300, 1200])
def test_forms_are_not_compared_pair_by_pair(spark, monkeypatch, n):
    """Texts that share an 80-word form and differ in ten words: none is similar, and pairs are no more than rows."""
    rng = random.Random(4)
    form = [f"form{k}" for k in range(80)]
    rows = [(i, " ".join([*form, *(f"w{rng.randrange(10 ** 9)}" for _ in range(10))]), "en", "s", 1) for i in range(n)]
    kept, pairs = made_pairs(spark, monkeypatch, rows)
    assert kept == Counter(range(n)) and pairs <= n


def test_many_near_copies_are_compared_with_few(spark, monkeypatch):
    """A group of near copies becomes one by its centres, not by all its pairs."""
    rng = random.Random(6)
    base, n = prose(rng, 150).split(), 500
    rows = []
    for i in range(n):
        own = list(base)
        own[rng.randrange(150)] = f"own{i}"
        rows.append((i, " ".join(own), "en", "s", 1))
    kept, pairs = made_pairs(spark, monkeypatch, rows)
    assert kept == Counter([0]) and pairs <= 8 * n


def test_hot_keys_join_as_others(spark):
    """Rows of a key that holds most of a table are dealt out; the result is that of a plain join."""
    many = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "key LONG, x LONG")
    few = spark.createDataFrame([(k, k * 10, 0) for k in range(0, 3000, 2)] + [(1, 5, 0), (1, 6, 0), (None, 7, 0)], "key LONG, y LONG, salt INT")
    hot = Hot(many, "key", share=10, least=10)
    assert hot.values == [1]
    for how in ("inner", "left", "left_semi"):
        got, want = hot.join(many, few, "x", how), many.join(few, "key", how)
        assert got.columns == want.columns
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_odd_rows_stay_once(clashing, nothing, odd_rows):
    kept = similar.keep_dissimilar(clashing)
    assert kept.columns == clashing.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == plain_kept(odd_rows)
    assert similar.keep_dissimilar(nothing).count() == 0


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(2)
    for n in (1, 5, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[n // 10:], rng.integers(0, 1 << 63, n // 10, np.uint64)]))
        bits = int(np.bitwise_count(similar.parity_sketch(a) ^ similar.parity_sketch(b)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_fingerprints_give_pairs_before_the_exact_join(spark, monkeypatch):
    """Without any shared first fifth, near copies are still found by their fingerprints, and verified by shingles."""
    rng = random.Random(8)
    monkeypatch.setattr(similar, "first_fifth", lambda found, common, times: found[:0])
    rows = []
    for i in range(30):
        words = prose(rng, 900).split()
        rows += [(2 * i, " ".join(words), "en", "s", 1), (2 * i + 1, " ".join([*words[:300], "changed", *words[301:]]), "en", "s", 1)]
    kept, pairs = made_pairs(spark, monkeypatch, rows)
    assert 0 < len(kept) <= 35 and set(range(0, 60, 2)) <= set(kept) and pairs < len(rows)
    far = [(0, "a b c " * 50 + "e", "en", "s", 1), (1, "a b c " * 50 + "f g h i j k", "en", "s", 1)]
    assert plain_kept(far) == Counter([0, 1]) and made_pairs(spark, monkeypatch, far) == (Counter([0, 1]), 1)
