"""Operators 2, 3, 5 and 8, and the pipeline, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cuelake.llm import langid, pii, quality, simhash

from .test_similar import plain_kept

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- SimHash -----------------------------------------------------------------


def plain_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if hashes and 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    """Smallest position reachable, for a list of fingerprints."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    p = np.array(prints, np.uint64)
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p[i] ^ p[i + 1:]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(p))]


def test_fingerprints(odd_rows, monkeypatch):
    texts = [t for _, t, *_ in odd_rows if t is None or len(t) < 20_000]
    assert [simhash.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]
    monkeypatch.setattr(simhash, "PART", 16)  # parts of a long text add up
    assert [simhash.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]


def near_prints(n=1500, seed=5):
    """Random fingerprints, chains of near ones, and a large group within few bits."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 3)]
    chain = rng.getrandbits(64)
    for _ in range(n // 3):
        for _ in range(rng.randint(1, 4)):
            chain ^= 1 << rng.randrange(64)
        out.append(chain)
    centre = rng.getrandbits(64)
    for _ in range(n // 3):
        out.append(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    return list(dict.fromkeys([0, *out]))


def test_tile_links_are_a_forest_of_all_links():
    prints = np.array(near_prints(), np.uint64)
    want = plain_components(prints.tolist())
    half = len(prints) // 2
    forest = simhash.Forest(len(prints))
    at = {int(p): k for k, p in enumerate(prints)}
    n = 0
    for left, right, same in ((prints[:half], prints[:half], True), (prints[half:], prints[half:], True), (prints[:half], prints[half:], False)):
        a, b = simhash.tile_links(left, right, 4, same)
        n += len(a)
        forest.add(np.array([at[int(x)] for x in a], int), np.array([at[int(x)] for x in b], int))
    assert forest.root.tolist() == want
    assert n <= 2 * len(prints)  # never all pairs of a group


def test_components_over_many_tiles(spark):
    prints = near_prints(6000)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp LONG")
    got = {r.node: r.label for r in simhash.components(simhash.links(df)).collect()}
    want = plain_components(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    mine, sizes = defaultdict(set), Counter(want)
    for k, root in enumerate(want):
        if sizes[root] > 1:
            mine[root].add(signed[k])
    theirs = defaultdict(set)
    for node, label in got.items():
        theirs[label].add(node)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(-5, -5), (-9, -8)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, -9: -9, -8: -9}


def test_near_duplicates_of_odd_rows(odd, clashing, nothing, odd_rows):
    rows = sorted(odd_rows, key=lambda r: (r[0] is None, r[0]))
    prints = [plain_print(t) if t is None or len(t) < 20_000 else simhash.fingerprint(t) for _, t, *_ in rows]
    roots = plain_components(prints)
    want = Counter((r[0], f"{p:016x}", rows[k][0]) for r, p, k in zip(rows, prints, roots))
    assert Counter(map(tuple, simhash.near_duplicates(odd).collect())) == want
    assert Counter(map(tuple, simhash.near_duplicates(clashing).collect())) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_row_of_each_group_stays(clashing, nothing, odd_rows):
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    got = kept.select("doc_id", "text").collect()
    rows = sorted(odd_rows, key=lambda r: (r[0] is None, r[0]))
    prints = [simhash.fingerprint(t) for _, t, *_ in rows]
    roots = set(plain_components(prints))
    assert Counter(r.doc_id for r in got) == Counter(rows[k][0] for k in roots)
    assert simhash.keep_one(nothing).count() == 0


# -- quality -----------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    covered = {k for starts in at.values() if len(starts) > 1 for i in starts for k in range(i, i + 8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)]


def test_counts(odd_rows):
    for _, text, *_ in odd_rows:
        assert quality.statistics(text)[0] == plain_counts(text)
    rng = random.Random(2)
    for _ in range(200):
        text = " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))
        assert quality.statistics(text)[0] == plain_counts(text)


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.2) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = quality.grow(x, y, [-1, 0, 0])
    assert ((trees.score(x) > 0) == (y > 0.5)).mean() > 0.93
    for _ in range(50):
        line = np.repeat(rng.random((1, 3)), 200, axis=0)
        line[:, 0] = np.linspace(-0.1, 1.1, 200)
        assert (np.diff(trees.score(line)) <= 1e-12).all()
    # Walking flat arrays equals walking each tree by itself.
    one = x[:1]
    total = trees.bias
    for node in trees.roots:
        while trees.left[node] != node:
            node = trees.left[node] if one[0, trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        total += trees.value[node]
    assert trees.score(one)[0] == pytest.approx(total)


def test_rules_of_the_supplied_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    right = Counter()
    for r in quality.quality_rules(docs, labels).collect():
        n = plain_counts(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == n
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        assert r.base_failed == failed and not (failed and r.kept)
        if r.doc_id in known and not failed:
            right[known[r.doc_id] == r.kept] += 1
    assert right[True] / right.total() > 0.95


def test_rules_of_odd_rows(spark, odd, clashing, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (5, None, None), (7, 0, 0), (7, 1, 0)], "doc_id LONG, quality INT, toxic INT")
    none = labels.limit(0)
    for given in (labels, none):
        got = quality.quality_rules(odd, given)
        assert got.count() == odd.count() and got.where("kept AND base_failed").count() == 0
        assert quality.quality_rules(nothing, given).count() == 0
    assert quality.quality_rules(odd, none).where("kept = base_failed").count() == 0  # no model: base rules alone
    kept = quality.keep_good(clashing, none)
    assert kept.columns == clashing.columns
    assert kept.count() == quality.quality_rules(odd, none).where("kept").count()


# -- personal data -------------------------------------------------------------


def plain_spans(text):
    """Base spans by kind, straight from the rules."""
    def luhn(number):
        total = 0
        for k, c in enumerate(reversed(number)):
            v = int(c) * (1 + k % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    def places(kind, pattern, ok):
        return [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if ok(m.group())]

    digits = lambda s: re.sub("[^0-9]", "", s)
    return (places("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True)
            + places("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split(".")))
            + places("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)))
            + places("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15))


TRICKY = [
    "mail a@b.co, a.b_c%d+e-f@x-y.co.uk. and a@b.c_x@d.e a@b@c.d a@b a@.b a@b..c @x.y é@b.co éa@b.co", "a@b.c@d.e.f a@b.c-d@e.f",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3 1..2.3.4.5 99999999999999999999.1.1.1 1.2.3.4a 1.2.3.256",
    "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112 4111  1111 11111111 0000000000000 42 4242424242424242 4242",
    "+1 (168) 555-5254 +49 30 123456 +1 +12 +1-2-3 ++4912345678 +1 234 567 8901 2345 67 +44 (20) 7946.0958)", "+123456789+123456789",
    "日本 1.2.3.4 \U0001F600 a@b.co \U0001F600 +49 30 1234567", "token = \"ffc3105535f423f352535e4ac53b5fefe076ac6d\" 078-05-1120", "",
    "1 " * 3000, "a.a" * 4000 + "@" + "b." * 4000 + "c", "1.2.3.4 " * 300, "+1" + " " * 5000 + "2345678901",
]


def test_base_spans(spark):
    rng = random.Random(11)
    texts = [*TRICKY, None]
    for _ in range(400):
        texts.append("".join(rng.choice("a1.@+- (2éx3)4,5\n") for _ in range(rng.randint(0, 60))))
    got = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(8)).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_spans(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        counts = Counter(k for k, _, _ in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [counts[k] for k in ("email", "ip", "card", "phone")], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (texts[r.doc_id], listed, r.spans)
        assert r.spans.startswith(listed)


def test_addresses_with_zero_parts(spark):
    texts = ["10.0.0.1", "at 0.0.0.0, 192.168.1.0 and 1.2.3.000", "00.000.0000.1 0256.1.1.1 1.0.0.00300 " + "0" * 4000 + ".0.0.0", "0.0.0 0.0.0.256"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    for r in pii.find_spans(df).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[r.doc_id]))
        assert r.n_ip == want.count("ip:") == [1, 3, 2, 0][r.doc_id] and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    cleaned = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert cleaned[0] == "<IP>" and cleaned[1] == "at <IP>, <IP> and <IP>"


def test_long_runs_are_candidates_for_secrets(spark):
    runs = ["a1" * 100, "a" * 100 + "1", "x" * 70 + "9" + "-" * 5000, "a1" * 10, "a" * 300, "a1" * 9]
    df = spark.createDataFrame([(i, f"key {t} end") for i, t in enumerate(runs)], "i INT, text STRING")
    got = {r.i: [(c.start, c.end) for c in r.found if pii.KINDS[c.kind] == "secret"] for r in df.select("i", pii.candidates(F.col("text")).alias("found")).collect()}
    assert got == {i: [(4, 4 + len(t))] if i < 4 else [] for i, t in enumerate(runs)}


def test_em_finds_the_reliable_labelers(spark):
    rng = random.Random(4)
    cells = Counter()
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = [int(rng.random() < (good if true else bad)) for good, bad in ((0.9, 0.1), (0.8, 0.3), (0.7, 0.05))]
        cells[(4, *votes, 3)] += 1
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "kind INT, v1 INT, v2 INT, v3 INT, shape INT, n LONG")
    state = pii.em(df, rounds=25)
    share, rates = state[4]
    assert share == pytest.approx(0.4, abs=0.05)
    assert [y for y, _ in rates] == pytest.approx([0.9, 0.8, 0.7], abs=0.06) and [n for _, n in rates] == pytest.approx([0.1, 0.3, 0.05], abs=0.06)
    odds = pii.classifier(df, state)
    assert odds[4, 1, 1, 1, 3] > 3 > 0 > odds[4, 0, 0, 0, 3]
    assert pii.classifier(df.limit(0), pii.em(df.limit(0))) == {}


def test_redaction(spark, clashing, nothing):
    texts = ["write to joe@x.org or +1 (168) 555-5254.", "clean text 12, no data", None, "4111 1111 1111 1111user@x.org", "é 1.2.3.4\nand 5.6.7.8"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[0].text == "write to <EMAIL> or <PHONE>." and got[0].n_chars == len(got[0].text)
    assert got[1].text == texts[1] and got[1].n_chars == len(texts[1]) and got[2].text is None and got[2].n_chars == 0
    assert "4111" not in got[3].text and "@" not in got[3].text and got[4].text == "é <IP>\nand <IP>"
    out = pii.redact(clashing)
    assert out.columns == clashing.columns and out.dtypes == clashing.dtypes and out.count() == clashing.count()
    assert out.exceptAll(clashing).count() == 0  # nothing to find there
    assert pii.redact(nothing).count() == 0 and pii.find_spans(nothing).count() == 0


# -- languages -----------------------------------------------------------------


def test_languages_of_the_supplied_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.languages(docs).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_unseen_words_back_off():
    model = langid.Model.learn([("singing", "en", 5), ("ringing", "en", 5), ("singend", "de", 5), ("ringend", "de", 5)])
    assert model.predict("clinging bringing")[0] == "en" and model.predict("klingend bringend")[0] == "de"
    assert model.predict("") == ("und", 0.0) == model.predict("12 34 ²") == model.predict(None)
    assert model.predict("ж")[1] == pytest.approx(0.5)  # nothing known: even
    assert model.predict("x" * 100_000)[0] in ("de", "en")


def test_language_is_not_learned_from_held_out_rows(spark):
    ids = range(400)
    out = [i for i in ids if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, "aaa bbb ccc" if i not in out else "zzz yyy", "xx" if i not in out else "yy") for i in ids]
    got = {r.doc_id: r for r in langid.languages(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")).collect()}
    assert {r.lang_pred for r in got.values()} == {"xx"}


def plain_predictions(rows):
    """Language and share of each text, from counts of all words and n-grams, one by one."""
    counts, pieces = defaultdict(Counter), defaultdict(Counter)
    found = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    for d, text, lang in rows:
        if d is not None and text is not None and lang is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            for w in found(text):
                counts[w][lang] += 1
                for k in range(1, 5):
                    for g in ([*w] if k == 1 else [f"^{w}$"[i:i + k] for i in range(len(w) + 3 - k)]):
                        pieces[g][lang] += 1
    langs = sorted({lang for c in counts.values() for lang in c})

    def logs(table):
        totals = {g: sum(c[g] for c in table.values()) for g in langs}
        one = {g: totals[g] / max(totals.values()) for g in langs}
        out = {}
        for name, c in table.items():
            row = np.array([np.log((c[g] + one[g]) / (totals[g] + one[g] * len(table))) for g in langs])
            out[name] = row - row.mean()
        return out

    words, tables = logs(counts), [logs({g: c for g, c in pieces.items() if len(g) == k}) for k in range(1, 5)]

    def gram(g):
        if g in tables[len(g) - 1]:
            return tables[len(g) - 1][g]
        return np.zeros(len(langs)) if len(g) == 1 else (gram(g[:-1]) + gram(g[1:])) / 2

    def unseen(w):
        if len(w) > 64:
            return np.mean([unseen(w[i:i + 64]) for i in range(0, len(w), 64)], axis=0)
        k = min(4, len(w) + 2)
        return np.mean([gram(g) for g in (f"^{w}$"[i:i + k] for i in range(len(w) + 3 - k))], axis=0)

    out = []
    for d, text, _ in rows:
        met = found(text or "")
        if not met or not langs:
            out.append((d, "und", 0.0))
            continue
        total = sum(words[w] if w in words else unseen(w) for w in met)
        best = int(np.argmax(total))
        out.append((d, langs[best], float(1 / np.exp(total - total[best]).sum())))
    return out


def test_predictions_equal_a_plain_scorer(spark, odd_rows):
    docs = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows = [*map(tuple, docs), (9001, "q" * 50 + " unheardof", "en"), (9002, "q" * 50, "en"), (9003, None, "en"), (9004, "12 34", "de"), (None, "le chat", "fr")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.languages(df, most_words=10 ** 9).collect()), key=repr)
    want = sorted(plain_predictions(rows), key=repr)
    same = [(g[0], w[1]) for g, w in zip(got, want) if g[1] != w[1]]
    # Single precision may turn ties; nothing else differs.
    assert [g[0] for g in got] == [w[0] for w in want] and len(same) <= len(rows) // 100
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=0.02)


def test_a_small_language_keeps_its_words(spark):
    """One row in a hundred is of a third language; few words are kept, and long ones count."""
    rng = random.Random(5)
    make = lambda letters: ["".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(400)]
    stems = {"en": make("abcdefgh"), "de": make("ijklmnop"), "zz": [*make("qrstuvwx")[:40], "q" * 45]}
    rows = [(i, " ".join(rng.choices(stems[lang], k=30)), lang) for i in range(3000) for lang in ["zz" if i % 100 == 7 else "de" if i % 2 else "en"]]
    got = {r.doc_id: r for r in langid.languages(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"), most_words=300).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out)
    only_long = langid.fit(spark.createDataFrame([(k, "q" * 45, "zz") for k in range(9)], "doc_id LONG, text STRING, lang STRING"))
    assert "q" * 45 in only_long.words[0]


def test_languages_of_odd_rows(odd, clashing, nothing):
    got = langid.languages(odd)
    assert got.count() == odd.count()
    rows = {r.doc_id: r for r in got.where("doc_id < 100").collect()}
    assert all(rows[d].lang_pred == "und" and rows[d].score == 0 for d in (1, 2, 3, 11))
    kept = langid.keep_known(clashing)
    assert kept.columns == clashing.columns and kept.where("doc_id IN (1, 2, 3, 11)").count() == 0
    assert langid.languages(nothing).count() == 0
    unknown = langid.languages(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}


# -- the pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, SMALL), "test-stage")
        assert out.columns == columns, name
        kept = {r.doc_id: r.text for r in out.collect()}
        if name == "near_duplicates":
            # Five-word shingles with a Jaccard similarity of 0.8 or more, pair by pair.
            assert set(kept) == set(plain_kept(sorted(texts.items())))
        elif name == "quality":
            judged = quality.quality_rules(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).where("kept").collect()
            assert set(kept) == {r.doc_id for r in judged}
        elif name == "personal_data":
            assert set(kept) == set(texts)
            for d, text in texts.items():
                assert not plain_spans(kept[d])
                if not plain_spans(text) and "token" not in text:
                    assert kept[d] == text
        docs, texts = out, kept
    assert 0 < len(texts) < n
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts)


def pipeline_rows(spark, tmp_path, docs, labels):
    """Rows of ``run`` over a folder with these tables."""
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path))


def test_pipeline_over_nothing(spark, nothing, tmp_path):
    labels = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    assert pipeline_rows(spark, tmp_path, nothing, labels).count() == 0


def test_pipeline_over_odd_rows(spark, odd, clashing, odd_rows, tmp_path):
    """Null texts and ids, empty and very long texts, repeated rows, and columns that are named like the stages' own."""
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(30)] + [(None, 1, 1), (100, None, None)], "doc_id LONG, quality INT, toxic INT")
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    plain = pipeline_rows(spark, tmp_path / "a", odd, labels)
    found = [tuple(r) for r in plain.collect()]
    at = {c: k for k, c in enumerate(plain.columns)}
    ids = {r[0] for r in odd_rows}
    assert found and {r[at["doc_id"]] for r in found} <= ids
    assert not {1, 2, 3} & {r[at["doc_id"]] for r in found}  # no language can be told
    pieces = Counter()
    for r in found:
        pieces[r[at["doc_id"]], r[at["doc_tokens"]]] += r[at["length"]]
    assert all(n % tokens == 0 for (_, tokens), n in pieces.items())
    more = pipeline_rows(spark, tmp_path / "b", clashing, labels).collect()
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(tuple(r[c] for c in keep) for r in more) == Counter(tuple(r[at[c]] for c in keep) for r in found)
