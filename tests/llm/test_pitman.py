"""Pitman-Yor scores: base columns by loops, seating against exact probabilities, scores against a plain sampler."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import pitman

from .conftest import SMALL

HELD = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 7 = 2"


def words(text):
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def is_held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def base(rows):
    counts = Counter(w for d, t in rows if not is_held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return [(d, is_held(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)))
            for d, t in rows]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[5]))


def same(got, want):
    got, want = in_order([tuple(r)[:6] for r in got]), in_order(want)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_base_and_gain_over_it(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = pitman.score_texts(docs, F.expr(HELD)).collect()
    same(got, base([(r.doc_id, r.text) for r in docs.collect()]))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    again = pitman.score_texts(docs, F.expr(HELD)).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in got})


def test_odd_rows(spark, odd, odd_rows, clashing, nothing):
    want = base([(r[0], r[1]) for r in odd_rows])
    got = pitman.score_texts(odd, F.expr(HELD)).collect()
    same(got, want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same(pitman.score_texts(clashing, F.expr(HELD)).collect(), want)
    assert pitman.score_texts(nothing, F.expr(HELD)).collect() == []
    untaught = pitman.score_texts(odd, F.lit(True)).collect()
    assert len(untaught) == len(odd_rows) and all(r.score == r.base_score == 0 and r.train_tokens == 0 for r in untaught)


def test_blocks_and_buckets_do_not_matter(spark, odd, monkeypatch):
    want = {(r.doc_id, r.n_tokens): r.score for r in pitman.score_texts(odd.coalesce(1), F.expr(HELD), samples=8).collect()}
    monkeypatch.setattr(pitman, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(pitman, "BUCKET_TOKENS", 2000)
    monkeypatch.setattr(pitman, "word_shards", lambda docs: 5)
    got = {(r.doc_id, r.n_tokens): r.score for r in pitman.score_texts(odd.repartition(7), F.expr(HELD), samples=8).collect()}
    assert got == pytest.approx(want, rel=0.03)


def set_partitions(n):
    """Sizes of the blocks of each partition of n customers."""
    def grow(k, sizes):
        if k == n:
            yield tuple(sizes)
            return
        for i in range(len(sizes)):
            yield from grow(k + 1, [*sizes[:i], sizes[i] + 1, *sizes[i + 1:]])
        yield from grow(k + 1, [*sizes, 1])
    return grow(0, [])


@pytest.mark.parametrize(("customers", "weight", "discount"), [(2, 0.3, 0.5), (5, 0.7, 0.4), (6, 2.0, 0.8), (4, 0.02, 0.2)])
def test_moves_reach_the_exact_distribution(customers, weight, discount):
    """Tables of a dish, given the weight of a new one: weight ** tables times the seating of each table."""
    exact = Counter()
    for sizes in set_partitions(customers):
        exact[len(sizes)] += weight ** len(sizes) * math.prod(math.prod(k - discount for k in range(1, s)) for s in sizes)
    total = sum(exact.values())
    n, rng = 40_000, np.random.default_rng(5)
    many = np.full(n, customers)
    seats = pitman.Seats(many, np.ones(n, np.int64), many.copy())
    weights = np.full(n, weight)
    for _ in range(60):
        seats.move(weights, discount, rng)
        assert seats.sizes.min() > 0 and len(seats.sizes) == seats.tables.sum()
    ends = np.cumsum(seats.tables)
    assert np.array_equal(np.add.reduceat(seats.sizes, ends - seats.tables), many)
    found = Counter(seats.tables.tolist())
    for t, p in exact.items():
        assert found[t] / n == pytest.approx(p / total, abs=0.012)


def test_a_sweep_moves_every_customer():
    """Where a new table is all but certain, one sweep leaves nobody at the table that all shared."""
    customers = np.array([2, 7, 300])
    for dishes in (customers, np.tile(customers, 40)):
        seats = pitman.Seats(dishes, np.ones(len(dishes), np.int64), dishes.copy())
        seats.move(np.full(len(dishes), 1e12), 0.5, np.random.default_rng(3))
        assert np.array_equal(seats.tables, dishes) and (seats.sizes == 1).all()


@pytest.mark.parametrize("few", [1, 1 << 30])
def test_moves_side_by_side_and_one_by_one_agree(few, monkeypatch):
    """Runs of dishes, uneven sizes, customers who leave and come: the exact mean of tables after sweeps."""
    monkeypatch.setattr(pitman, "FEW", few)
    monkeypatch.setattr(pitman, "SLAB", 1000)
    customers, discount, weight, rng = np.tile([2, 6, 4], 3000), 0.4, 0.7, np.random.default_rng(8)
    seats = pitman.Seats.start(np.tile([5, 3, 4], 3000), np.full(9000, weight), discount, rng)
    seats.change(customers, np.full(9000, weight), discount, rng)
    for _ in range(20):
        seats.move(np.full(9000, weight), discount, rng)
    assert np.array_equal(np.add.reduceat(seats.sizes, np.cumsum(seats.tables) - seats.tables), customers)
    for c in (2, 6, 4):
        chances = [(len(s), weight ** len(s) * math.prod(math.prod(k - discount for k in range(1, n)) for n in s)) for s in set_partitions(c)]
        exact = sum(t * p for t, p in chances) / sum(p for _, p in chances)
        assert seats.tables[customers == c].mean() == pytest.approx(exact, abs=0.06)


@pytest.mark.parametrize("at_once", [1 << 16, 3])
def test_all_customers_of_a_dish_are_seated_anew(at_once, monkeypatch):
    """One step from one table each: exact where dishes are drawn at once; dishes with more customers are swept until they are."""
    monkeypatch.setattr(pitman, "TOGETHER", at_once)
    customers, discount, rng = np.tile([2, 6, 4], 5000), 0.4, np.random.default_rng(8)
    weight = np.tile([0.7, 3.0, 40.0], 5000)
    dishes = pitman.Dishes(customers, np.ones(len(customers), np.int64))
    for _ in range(1 if at_once > 6 else 12):
        dishes.move(weight, discount, rng)
    for c, w in ((2, 0.7), (6, 3.0), (4, 40.0)):
        chances = [(len(s), w ** len(s) * math.prod(math.prod(k - discount for k in range(1, n)) for n in s)) for s in set_partitions(c)]
        exact = sum(t * p for t, p in chances) / sum(p for _, p in chances)
        assert dishes.tables[customers == c].mean() == pytest.approx(exact, abs=0.06)
    again = pitman.Dishes(customers, *pitman.unbundle(dishes.packed()))
    again.change(np.tile([3, 5, 9], 5000), weight, discount, rng)
    again.move(weight, discount, rng)
    assert (again.tables <= again.customers).all() and np.array_equal(again.seats.tables, again.tables[again.swept])


def test_seatings_by_sum_and_by_steps_agree():
    customers = np.array([900, 8000])
    for discount in (0.3, 0.5, 0.8):
        steps, sums = pitman.log_seatings(customers, discount)[0], pitman.log_seatings_of_many(customers, discount)
        assert not sums[1][:, :4].any()
        assert np.allclose(np.where(sums[1], 0, sums[0]), np.where(sums[1], 0, steps[:, :pitman.NARROW]), atol=1e-6)


def test_wide_dishes_are_swept(monkeypatch):
    """Tables beyond the width that is at hand are not cut off: equal means with little and much width."""
    customers, weight = np.full(200, 90), np.full(200, 25.0)
    means = []
    for width in (512, 8):
        monkeypatch.setattr(pitman, "WIDTH", width)
        dishes, rng, tables = pitman.Dishes(customers, np.full(200, 20)), np.random.default_rng(4), []
        for _ in range(25):
            dishes.move(weight, 0.5, rng)
            tables.append(dishes.tables.mean())
        assert len(dishes.swept) == (200 if width == 8 else 0)
        means.append(np.mean(tables[5:]))
    assert means[0] == pytest.approx(means[1], rel=0.02)


def test_start_seats_everyone():
    rng = np.random.default_rng(1)
    customers = np.array([2, 3, 16, 17, 1000, 100_000])
    seats = pitman.Seats.start(customers, np.full(6, 5.0), 0.5, rng)
    assert np.array_equal(np.add.reduceat(seats.sizes, np.cumsum(seats.tables) - seats.tables), customers) and seats.sizes.min() > 0


def test_probabilities_add_up_to_one(tmp_path):
    """Over the vocabulary and one unknown word, after a known, a once seen and an unknown context."""
    contexts, words, rng = np.arange(3), np.arange(5), np.random.default_rng(2)
    counts = np.array([[3, 1, 0, 9, 0], [0, 1, 0, 0, 0], [0, 0, 0, 0, 0]])
    pitman.put(f"{tmp_path}/0.pairs", pitman.bundle(contexts, counts.sum(axis=1), words, np.repeat(contexts, 5), np.tile(words, 3), counts.reshape(-1)))
    found = pitman.Restaurants(f"{tmp_path}/0.pairs")
    parent, none = np.array([0.4, 0.3, 0.15, 0.1, 0.05]), (np.zeros(0, np.int64),) * 2
    for _ in range(5):
        found.sweep(parent, none, 1.0, 0.6, rng)
        assert found.probabilities(parent, none, 1.0, 0.6).reshape(3, 5).sum(axis=1) == pytest.approx([1, 1, 1])
    split = np.array([0]), np.array([7.0])  # context 0 has more tables in other buckets
    assert found.in_context(split)[0] == 7


class PlainSampler:
    """The same model seated customer by customer, with the root's seating kept up to date."""

    def __init__(self, texts, theta, discount, root_discount, seed):
        self.rng, self.theta = random.Random(seed), theta
        self.d = {None: root_discount}
        self.default = discount
        self.tables = defaultdict(lambda: defaultdict(list))
        pairs = [(a, b) for t in texts for a, b in itertools.pairwise([b"", *t])]
        self.base = 1 / (len({b for _, b in pairs}) + 1)
        self.pairs = pairs
        for u, w in pairs:
            self.add(u, w)

    def p(self, u, w):
        r, d = self.tables[u], self.d.get(u, self.default)
        n, t = sum(map(sum, r.values())), sum(map(len, r.values()))
        up = self.base if u is None else self.p(None, w)
        return (sum(r[w]) - d * len(r[w]) + (self.theta + d * t) * up) / (self.theta + n) if n else up

    def add(self, u, w):
        r, d = self.tables[u], self.d.get(u, self.default)
        t = sum(map(len, r.values()))
        new = (self.theta + d * t) * (self.base if u is None else self.p(None, w))
        k = self.rng.choices(range(len(r[w]) + 1), [s - d for s in r[w]] + [new])[0]
        if k < len(r[w]):
            r[w][k] += 1
        else:
            r[w].append(1)
            if u is not None:
                self.add(None, w)

    def remove(self, u, w):
        r = self.tables[u][w]
        k = self.rng.choices(range(len(r)), r)[0]
        r[k] -= 1
        if not r[k]:
            r.pop(k)
            if u is not None:
                self.remove(None, w)


def test_scores_against_a_plain_sampler(spark):
    rng = random.Random(3)
    stems = [f"w{k}" for k in range(30)]
    rows = [(d, " ".join(rng.choices(stems, [1 / (k + 1) for k in range(30)], k=rng.randint(3, 14)))) for d in range(90)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {r.doc_id: r.score for r in pitman.score_texts(docs, F.expr(HELD), phases=4, sweeps=8, samples=40).collect()}
    taught = [words(t) for d, t in rows if not is_held(d)]
    singles = Counter(Counter(w for t in taught for w in t).values())
    pairs = Counter(Counter(p for t in taught for p in itertools.pairwise([b"", *t])).values())
    rate = lambda c: min(0.95, max(0.05, c[1] / max(1, c[1] + 2 * c[2])))
    plain = PlainSampler(taught, 1.0, rate(pairs), rate(singles), 4)
    turns, asked = 12, {p for d, t in rows for p in itertools.pairwise([b"", *words(t)])}
    mean = Counter()
    for turn in range(6 + turns):
        for u, w in plain.pairs:
            plain.remove(u, w)
            plain.add(u, w)
        if turn >= 6:
            for p in asked:
                mean[p] += plain.p(*p) / turns
    want = {d: sum(math.log10(mean[p]) for p in itertools.pairwise([b"", *words(t)])) for d, t in rows}
    out = [d for d, _ in rows if is_held(d)]
    assert sum(got[d] for d in out) == pytest.approx(sum(want[d] for d in out), rel=0.02)
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.02)
    assert all(got[d] == pytest.approx(want[d], rel=0.08) for d in want)
