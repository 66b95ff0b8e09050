"""Language-model scores by a hierarchical Pitman-Yor model, seated by Gibbs sampling (operator 11).

Every word that occurs before another is a restaurant (its dishes are the words that
follow), and all of them share one parent, the root, whose base is even over the vocabulary and
one unknown word.  A table of a context restaurant is a customer of the root.

Given the parent's probabilities and one Gamma variable per restaurant
(x ~ Gamma(concentration / discount + tables)), the dishes of a restaurant are independent: a
customer sits down at a table of its dish in proportion to the table's size less the discount, or at a
new one in proportion to discount * x * parent's probability of the dish.  So a sweep needs no
restaurant as a whole: pairs of words are dealt into buckets, those of a very
frequent context into several.  What travels between sweeps are tables per word (to the root) and
the root's answers (to the buckets that have the word), packed per pair of tasks.

Stages, each a written table or files in the shared folder: blocks of documents with their words by number;
words over all blocks with ids and counts; pairs of words of each block, dealt into buckets;
sweeps; log probabilities of the pairs back to the blocks; sums over each document.
"""

from __future__ import annotations

import math
import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.bpe import pack_words, unpack_words
from cuelake.llm.common import claim_cache, file_system, read_file, stored
from cuelake.session import new_shared_path

END = b""
BLOCK_TOKENS = 4 << 20
#: Most tokens in a bucket, and as many as are worth a task of its own.
BUCKET_TOKENS, TASK_TOKENS = 4 << 20, 1 << 20
FIRST = 16
#: Customers whose seats are held at a time; fewer dishes than this take their turns one after another.
SLAB, FEW = 4 << 20, 64
#: Dishes of at most so many customers, and mostly of fewer tables than ``WIDTH``, are drawn at once; others customer by customer.
TOGETHER, WIDTH = 1 << 16, 512
#: Beyond so many customers, seatings at up to ``NARROW`` tables are counted by a sum instead of step by step.
STEPS, NARROW = 1 << 13, 32
CELLS = 1 << 20

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


# Packed arrays and files


def bundle(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; whole numbers take as few bytes as the largest needs."""
    packer, out = zstandard.ZstdCompressor(level=1, write_content_size=True), []
    for a in arrays:
        if a.dtype.kind in "iub":
            top = int(a.max(initial=0))
            a = a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else np.zeros(0, np.uint8)
        body = packer.compress(planes.tobytes())
        out += [f"{a.dtype.str:4}".encode(), len(a).to_bytes(8, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def unbundle(raw: bytes) -> list[np.ndarray]:
    """The arrays of :func:`bundle`; whole numbers as 64-bit ones."""
    out, at, reader = [], 0, zstandard.ZstdDecompressor()
    while at < len(raw):
        kind, n, size = np.dtype(raw[at:at + 4].decode().strip()), *(int.from_bytes(raw[at + k:at + k + 8], "little") for k in (4, 12))
        planes = np.frombuffer(reader.decompress(raw[at + 20:at + 20 + size]), np.uint8)
        a = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(-1)
        out.append(a if kind.kind == "f" else a.astype(np.int64))
        at += 20 + size
    return out


def put(path: str, data: bytes) -> None:
    """Write a file that appears as a whole; a task that is run again writes the same."""
    fs, inner = file_system(path)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, inner)


def mixed(ids: np.ndarray) -> np.ndarray:
    """Well spread 62-bit numbers for ids."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(2)).astype(np.int64)


def by_key(batches, key: str):
    """(key, rows) of batches sorted by a column; rows as tuples of the other columns."""
    last, rows = None, []
    for batch in batches:
        names = [n for n in batch.schema.names if n != key]
        for k, *row in zip(batch.column(key).to_pylist(), *(batch.column(n).to_pylist() for n in names)):
            if k != last and rows:
                yield last, rows
                rows = []
            last = k
            rows.append(row)
    if rows:
        yield last, rows


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_shards(docs: DataFrame) -> int:
    """Shards of the vocabulary, which grows about with the root of the text: a bucket sends one message to each.

    By the size of the texts, so that messages follow the data and not the cluster's number of tasks.
    """
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 + math.isqrt(int(letters) >> 20)


def pair_buckets(docs: DataFrame, tokens: int) -> int:
    return max(1, -(-tokens // BUCKET_TOKENS), min(shuffle_tasks(docs), -(-tokens // TASK_TOKENS)))


# Blocks of documents


class Block:
    """Texts as numbers of their words, one end after each text (number 0)."""

    def __init__(self):
        self.words: dict[bytes, int] = {END: 0}
        self.docs, self.held, self.codes, self.tokens = [], [], [], 0

    def add(self, doc: int | None, text: str | None, held: bool) -> None:
        words = self.words
        codes = [words.setdefault(w, len(words)) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
        codes.append(0)
        self.docs.append(doc)
        self.held.append(held)
        self.codes.append(np.array(codes, np.uint32))
        self.tokens += len(codes)


def block_table(docs: DataFrame, held: Column, shards: int) -> DataFrame:
    """A row per block with its documents, and one per block and word shard with the words' numbers, bytes and counts in training texts."""

    def split(batches):
        claim_cache("pitman", lambda: None)
        task, made, block = TaskContext.get().partitionId(), 0, Block()

        def flush():
            name = (task << 20) + made
            sizes, codes = np.array([len(c) for c in block.codes]), np.concatenate(block.codes)
            learnt = codes[np.repeat(~np.array(block.held, bool), sizes)]
            counts = np.bincount(learnt, minlength=len(block.words))
            words = list(block.words)
            shard = np.array([zlib.crc32(w) % shards for w in words])
            order = np.argsort(shard, kind="stable")
            names, first = np.unique(shard[order], return_index=True)
            rows = [(name, None, block.docs, block.held, bundle(sizes, codes))]
            rows += [(name, s, None, None, bundle(p, counts[p]) + pack_words([words[k] for k in p.tolist()]))
                     for s, p in zip(names.tolist(), np.split(order, first[1:]))]
            for lo in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo:lo + 64]), [
                    pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()])], names=["block", "shard", "docs", "held", "packed"])

        for batch in batches:
            for doc, text, out in zip(*(c.to_pylist() for c in batch.columns)):
                block.add(doc, text, bool(out))
                if block.tokens >= BLOCK_TOKENS:
                    yield from flush()
                    block, made = Block(), made + 1
        if block.docs:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(False)).alias("held")).mapInArrow(
        split, "block long, shard int, docs array<long>, held array<boolean>, packed binary")


def cut_bundle(raw: bytes, n: int) -> tuple[list[np.ndarray], bytes]:
    """The first ``n`` arrays of a bundle and the bytes after them."""
    at = 0
    for _ in range(n):
        at += 20 + int.from_bytes(raw[at + 12:at + 20], "little")
    return unbundle(raw[:at]), raw[at:]


def number_words(blocks: DataFrame, shards: int, folder: str) -> dict[str, int]:
    """Give each word an id (rank in its shard * shards + shard) and its count over all training texts, as a file per block.

    Returns totals: tokens, words of training texts, words met once, twice.  A block has a word
    once, so a frequent word is no heavy key.
    """

    def number(batches):
        for shard, rows in by_key(batches, "shard"):
            ranks: dict[bytes, int] = {}
            asked, totals = [], np.zeros(1024, np.int64)
            for block, packed in rows:
                (places, counts), raw = cut_bundle(packed, 2)
                mine = np.array([ranks.setdefault(w, len(ranks)) for w in unpack_words(raw)], np.int64)
                if len(ranks) > len(totals):
                    totals = np.concatenate([totals, np.zeros(len(ranks), np.int64)])
                totals[mine] += counts
                asked.append((block, places, mine))
            yield row(None, bundle(np.array([totals.sum(), (totals > 0).sum(), (totals == 1).sum(), (totals == 2).sum()])))
            for block, places, mine in asked:
                yield row(block, bundle(places, mine * shards + shard, totals[mine]))

    def row(block, packed):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed], pa.binary())], names=["block", "packed"])

    def write(batches):
        for block, rows in by_key(batches, "block"):
            if block is None:
                yield from (row(None, p) for p, in rows)
                continue
            places, ids, counts = (np.concatenate(x) for x in zip(*(unbundle(p) for p, in rows)))
            order = np.argsort(places)
            put(f"{folder}/{block}.words", bundle(ids[order], counts[order]))

    lists = blocks.where("shard IS NOT NULL").select("shard", "block", "packed").repartitionById(shards, "shard").sortWithinPartitions("shard", "block")
    answers = lists.mapInArrow(number, "block long, packed binary").repartition(shuffle_tasks(blocks), "block").sortWithinPartitions("block")
    sums = np.sum([unbundle(r.packed)[0] for r in stored(answers.mapInArrow(write, "block long, packed binary"), "lm-words").collect()] or np.zeros((1, 4), np.int64), axis=0)
    return dict(zip(["tokens", "words", "once", "twice"], map(int, sums)))


class Pairs:
    """The pairs of words of a block: ids, counts, and which bucket each is dealt to."""

    def __init__(self, block: int, packed: bytes, held: list[bool], folder: str, tokens: int, buckets: int):
        self.sizes, codes = unbundle(packed)
        ids, counts = unbundle(read_file(f"{folder}/{block}.words"))
        by_id = np.argsort(ids)
        self.ids, self.counts = ids[by_id], counts[by_id]
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        self.codes, self.end = rank[codes], rank[0]
        self.keys = np.concatenate([[self.end], self.codes[:-1]]) << 32 | self.codes
        self.held = np.repeat(np.array(held, bool), self.sizes)
        self.tokens, self.buckets = tokens, buckets

    def dealt(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each of the distinct pairs, and their order by bucket (and by ids in a bucket)."""
        first, second = kinds >> 32, kinds & 0xFFFFFFFF
        spread = spread_of(self.counts, self.tokens, self.buckets)
        bucket = (mixed(self.ids)[first] + mixed(self.ids)[second] % spread[first]) % self.buckets
        small = bucket.astype(np.uint16) if self.buckets < 1 << 16 else bucket
        return bucket, np.argsort(small, kind="stable")


def spread_of(counts: np.ndarray, tokens: int, buckets: int) -> np.ndarray:
    """Over how many buckets the pairs of a context with such a count are dealt.

    More than one only for contexts with over 1 / (2 * buckets) of all tokens, of which there are at most 2 * buckets.
    """
    return 1 + np.minimum(buckets - 1, counts * 2 * buckets // max(1, tokens))


def deal_pairs(blocks: DataFrame, folder: str, tokens: int, buckets: int) -> DataFrame:
    """(bucket, block, packed): the distinct pairs of each block with their counts in training texts."""

    def deal(batches):
        for batch in batches:
            for block, held, packed in zip(*(c.to_pylist() for c in batch.columns)):
                p = Pairs(block, packed, held, folder, tokens, buckets)
                kinds = np.unique(p.keys)
                learnt, times = np.unique(p.keys[~p.held], return_counts=True)
                counts = np.zeros(len(kinds), np.int64)
                counts[np.searchsorted(kinds, learnt)] = times
                bucket, order = p.dealt(kinds)
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                for part in np.split(order, cuts):
                    first = kinds[part] >> 32
                    starts = np.flatnonzero(np.diff(first, prepend=-1))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([bucket[part[0]]], pa.int32()), pa.array([block], pa.int64()),
                        pa.array([bundle(p.ids[first[starts]], p.counts[first[starts]], np.diff(np.append(starts, len(part))),
                                         p.ids[kinds[part] & 0xFFFFFFFF], counts[part])], pa.binary())], names=["bucket", "block", "packed"])

    return blocks.where("shard IS NULL").select("block", "held", "packed").mapInArrow(deal, "bucket int, block long, packed binary")


# Seating


class Seats:
    """Tables of many dishes side by side: sizes of all tables, dish after dish."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, sizes: np.ndarray):
        self.customers, self.tables, self.sizes = customers, tables, sizes

    @staticmethod
    def start(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> Seats:
        """Customers as they would come in: the first ``FIRST`` one by one, new tables of the others by their rate."""
        tables = np.ones(len(customers), np.int64)
        for k in range(1, min(FIRST, int(customers.max(initial=1)))):
            tables += (customers > k) & (rng.random(len(customers)) * (k - discount * tables + weight) < weight)
        later = customers > FIRST
        tables[later] += np.minimum(rng.poisson(weight[later] * np.log(customers[later] / FIRST)), customers[later] - FIRST)
        sizes = np.ones(int(tables.sum()), np.int64)
        sizes[np.cumsum(tables) - tables] = customers - tables + 1
        return Seats(customers, tables, sizes)

    def move(self, weight: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """Each customer of each dish, in random order, stands up and sits down again: a Gibbs sweep."""
        self._in_turn(None, weight, discount, rng)

    def change(self, customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """Customers of dishes that have fewer now leave, chosen at random; those of dishes that have more come in one by one."""
        stay = np.minimum(customers, self.customers)
        if (stay < self.customers).any():
            dish = np.repeat(np.arange(len(stay)), self.customers)
            order = np.lexsort((rng.random(len(dish)), dish))
            rank = np.arange(len(dish)) - np.repeat(np.cumsum(self.customers) - self.customers, self.customers)
            table = np.repeat(np.arange(len(self.sizes)), self.sizes)[order[rank < stay[dish]]]
            sizes = np.bincount(table, minlength=len(self.sizes))
            of_dish = np.repeat(np.arange(len(stay)), self.tables)
            self.sizes, self.tables = sizes[sizes > 0], np.bincount(of_dish[sizes > 0], minlength=len(stay))
        self.customers = customers
        if (customers > stay).any():
            self._in_turn(customers - stay, weight, discount, rng)

    def _in_turn(self, come: np.ndarray | None, weight: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """:func:`seat_in_turn` for runs of dishes, which bounds the memory."""
        ends, table_ends = np.cumsum(self.customers), np.cumsum(self.tables)
        done, lo = [], 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLAB, "right")))
            held = self.sizes[table_ends[lo] - self.tables[lo]:table_ends[hi - 1]]
            done.append(seat_in_turn(self.customers[lo:hi], self.tables[lo:hi], held, None if come is None else come[lo:hi], weight[lo:hi], discount, rng))
            lo = hi
        if done:
            self.tables, self.sizes = (np.concatenate(x) for x in zip(*done))


def seat_in_turn(customers: np.ndarray, tables: np.ndarray, sizes: np.ndarray, come: np.ndarray | None,
                 weight: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables and sizes after the last ``come`` customers of each dish came in, or, without it, after each stood up and sat down again.

    Dishes are independent, so turns are taken side by side; when few dishes have customers left, dish by dish.
    A customer sits with another one picked at random, if the table accepts (its size less the discount, over its
    size), or at a new table, in proportion to ``weight``; else it picks again.
    """
    stands = come is None
    turns = customers if stands else come
    there, total = customers if stands else customers - come, int(customers.sum())
    kind = np.int32 if 2 * total < 1 << 31 else np.int64
    first = np.cumsum(customers) - customers
    # Tables opened here are named after the place of their first customer, those that were there by numbers from ``total``.
    names = (total + np.arange(len(sizes)) + np.repeat(first - (np.cumsum(tables) - tables), tables)).astype(kind)
    size, seat = np.zeros(2 * total, kind), np.zeros(total, kind)
    size[names] = sizes
    seat[np.arange(int(there.sum())) + np.repeat(first - (np.cumsum(there) - there), there)] = np.repeat(names, sizes)

    order = np.argsort(-turns, kind="stable")
    starts, left, heavy = first[order] + (there - turns if stands else there)[order], turns[order], weight[order]
    firsts, others = first[order], (customers - 1 if stands else there)[order]
    rising, turn = left[::-1], 0
    while (n := len(left) - int(np.searchsorted(rising, turn, "right"))) >= FEW:
        own = starts[:n] + turn
        if stands:
            pick = own + (rng.random(n) * (left[:n] - turn)).astype(np.int64)
            size[seat[pick]] -= 1
            seat[pick] = seat[own]
        seat[own] = own
        table = own.copy()
        present = others[:n] if stands else others[:n] + turn
        asks = np.arange(n)
        while len(asks):
            here, mine = present[asks], own[asks]
            spot = rng.random(len(asks)) * (here + heavy[asks])
            other = firsts[asks] + spot.astype(np.int64)
            other += other >= mine
            other = np.where(spot < here, other, mine)
            found = seat[other]
            sits = (other == mine) | (rng.random(len(asks)) * size[found] >= discount)
            table[asks[sits]] = found[sits]
            asks = asks[~sits]
        seat[own] = table
        size[table] += 1
        turn += 1
    draw = random.Random(int(rng.integers(1 << 62))).random
    for k in range(n):
        _one_by_one(seat, size, int(firsts[k]), int(starts[k] - firsts[k]), turn, int(left[k]), stands, float(heavy[k]), discount, draw)

    used = np.flatnonzero(size)
    place = used % total
    by_dish = np.argsort(place, kind="stable")
    dish = np.searchsorted(first, place, "right") - 1
    return np.bincount(dish, minlength=len(customers)), size[used[by_dish]].astype(np.int64)


def _one_by_one(seat: np.ndarray, size: np.ndarray, first: int, start: int, turn: int, turns: int, stands: bool,
                weight: float, discount: float, draw) -> None:
    """The turns of one dish from ``turn`` on, as in :func:`seat_in_turn`."""
    places = seat[first:first + start + turns].tolist()
    names = np.unique(seat[first:first + start + (turns if stands else turn)])
    held = dict(zip(names.tolist(), size[names].tolist()))
    for own in range(start + turn, start + turns):
        if stands:
            pick = own + int(draw() * (turns - own))
            table = places[pick]
            places[pick] = places[own]
            held[table] -= 1
        present = turns - 1 if stands else own
        while True:
            spot = draw() * (present + weight)
            if spot >= present:
                table = first + own
                break
            other = int(spot)
            table = places[other + (other >= own)]
            if draw() * held[table] >= discount:
                break
        places[own] = table
        held[table] = held.get(table, 0) + 1
    size[np.fromiter(held, np.int64, len(held))] = np.fromiter(held.values(), np.int64, len(held))


def log_seatings(customers: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the ways to seat each of the rising numbers of customers at t = 1, 2, ... tables; whether one is too small to tell.

    Ways are weighted by the tables' sizes (a generalised Stirling number S), and divided by what all t share and by
    1 / (discount ** (t - 1) * (t - 1)!), which keeps them near one: S(c + 1, t) = S(c, t - 1) + (c - discount * t) * S(c, t).
    """
    width = min(WIDTH, int(customers.max(initial=1)))
    t = np.arange(1, width + 1)
    out, ways, k = np.empty((len(customers), width)), (t == 1).astype(float), 0
    grows, stays = discount * (t[1:] - 1), discount * t
    for c in range(1, int(customers.max(initial=0)) + 1):
        if customers[k] == c:
            out[k], k = ways, k + 1
        more = grows / c * ways[:-1]
        ways *= 1 - stays / c
        ways[1:] += more
    least, there = 1e-300, t <= customers[:, None]
    return np.where(there, np.log(np.maximum(out, least)), -np.inf), there & (out < least)


def log_seatings_of_many(customers: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`log_seatings` for up to ``NARROW`` tables, by the alternating sum for generalised Stirling numbers; second, where it cancels."""
    width = range(1, NARROW + 1)
    poles = [k * discount == int(k * discount) for k in width]
    signed = [0.0 if pole else (-1) ** k / math.gamma(-k * discount) for k, pole in zip(width, poles)]
    powers = np.exp([[math.lgamma(c - k * discount) - math.lgamma(c) for k in width] for c in customers.tolist()]).reshape(-1, NARROW) * signed
    choose = np.array([[math.comb(t, k) for k in width] for t in width], float).T
    ways, size = powers @ choose, np.abs(powers) @ choose
    return np.log(np.maximum(ways, 1e-300) / (discount * np.arange(1, NARROW + 1))), ways < 1e-4 * size


class Dishes:
    """Tables of many dishes side by side.

    Given the weight of a new table, all customers of a dish are seated anew at once: their tables are drawn from the exact
    distribution over all seatings (a blocked Gibbs step, after which only the number of tables counts).  Dishes of which that
    distribution is not at hand, with very many customers or tables, are ``swept`` instead, customer by customer.
    """

    def __init__(self, customers: np.ndarray, tables: np.ndarray, swept: np.ndarray | None = None, sizes: np.ndarray | None = None):
        self.customers, self.tables = customers, tables
        self.swept = np.zeros(0, np.int64) if swept is None else swept
        self.seats = Seats(customers[self.swept], tables[self.swept], np.zeros(0, np.int64) if sizes is None else sizes)
        #: Mean of the tables over the distribution that the last step drew them from.
        self.expected = tables.astype(np.float64)
        self._known: tuple | None = None

    def packed(self) -> bytes:
        return bundle(self.tables, self.swept, self.seats.sizes)

    def change(self, customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """Other numbers of customers."""
        if len(self.swept):
            before = np.bincount(np.repeat(np.arange(len(self.swept)), self.seats.tables), self.seats.sizes, len(self.swept)).astype(np.int64)
            self.seats.customers = before
            self.seats.change(customers[self.swept], weight[self.swept], discount, rng)
        self.customers, self.tables, self._known = customers, np.minimum(self.tables, customers), None
        self.tables[self.swept] = self.seats.tables

    def _sweep_too(self, more: np.ndarray) -> None:
        """Hold seats of further dishes: all customers beside the first of each table share one."""
        sizes = dict(zip(self.swept.tolist(), np.split(self.seats.sizes, np.cumsum(self.seats.tables)[:-1])))
        for k in more.tolist():
            sizes[k] = np.append(self.customers[k] - self.tables[k] + 1, np.ones(self.tables[k] - 1, np.int64))
        self.swept = np.array(sorted(sizes), np.int64)
        self.seats = Seats(self.customers[self.swept], self.tables[self.swept], np.concatenate([sizes[k] for k in self.swept.tolist()]))

    def _draw(self, dishes: np.ndarray, widths: np.ndarray, known: tuple, rate: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Draw the tables of the ``dishes`` out of up to ``widths``; those of which other numbers may count are left, and returned."""
        kinds, logs, untold = known
        drawn = dishes[np.argsort(widths[dishes], kind="stable")]
        wide = np.minimum(widths[drawn], logs.shape[1])
        t, falls = np.arange(1, logs.shape[1] + 1), np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, logs.shape[1])))])
        left, lo = [drawn[:0]], 0
        while lo < len(drawn):
            hi = min(len(drawn), lo + max(1, CELLS // int(wide[lo])))
            while (hi - lo) * int(wide[hi - 1]) > 2 * CELLS and hi > lo + 1:
                hi = lo + max(1, 2 * CELLS // int(wide[hi - 1]))
            part, w = drawn[lo:hi], int(wide[hi - 1])
            row = np.searchsorted(kinds, self.customers[part])
            x = np.log(rate[part])[:, None] * t[:w] - falls[:w] + logs[row, :w]
            top = x.max(axis=1)
            told = ~(untold[row, :w] & (x > top[:, None] - 70)).any(axis=1)
            cut = self.customers[part] > w
            if cut.any():
                # Terms are log-concave in t: beyond a small and falling one all are smaller still.
                told &= ~cut | ((x[:, -1] < top - 40) & (x[:, -1] < x[:, -2] - 0.7) if w > 1 else ~cut)
            chances = np.exp(x - top[:, None])
            expected = chances @ t[:w]
            chances = np.cumsum(chances, axis=1)
            picked = 1 + (chances <= (rng.random(len(part)) * chances[:, -1])[:, None]).sum(axis=1)
            self.tables[part[told]] = np.minimum(picked, w)[told]
            self.expected[part[told]] = (expected / chances[:, -1])[told]
            left.append(part[~told])
            lo = hi
        return np.concatenate(left)

    def move(self, weight: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """Every customer of every dish is seated anew."""
        rate, held = weight / discount, np.zeros(len(self.customers), bool)
        held[self.swept] = True
        # The tables' number is about Poisson or less; whether the rest can be left away is seen from the terms.
        need = np.minimum(self.customers, np.minimum(WIDTH, 12 + 3 * rate).astype(np.int64))
        if self._known is None or self._known[0] != discount:
            steps = (self.customers <= min(STEPS, TOGETHER)) | (self.customers <= TOGETHER) & (need > NARROW)
            by_steps, by_sum = np.unique(self.customers[steps]), np.unique(self.customers[(self.customers > STEPS) & (need <= NARROW)])
            self._known = discount, (by_steps, *log_seatings(by_steps, discount)), (by_sum, *log_seatings_of_many(by_sum, discount))
        _, steps, sums = self._known
        narrow = (self.customers > STEPS) & (need <= NARROW) & np.isin(self.customers, sums[0]) & ~held
        wide = np.isin(self.customers, steps[0]) & ~narrow & ~held
        every = np.arange(len(held))
        # Those that a first width does not settle are tried with all that is at hand.
        rest = self._draw(every[wide], need, steps, rate, rng)
        rest = self._draw(rest, np.minimum(self.customers, steps[1].shape[1]), steps, rate, rng)
        open_ = [rest, self._draw(every[narrow], np.full(len(held), NARROW), sums, rate, rng), every[~wide & ~narrow & ~held]]
        more = np.concatenate(open_)
        if len(more):
            self._sweep_too(more)
        if len(self.swept):
            self.seats.move(weight[self.swept], discount, rng)
            self.tables[self.swept] = self.expected[self.swept] = self.seats.tables

    def settled(self, weight: np.ndarray, discount: float, rng: np.random.Generator, moves: int) -> np.ndarray:
        """Seat everyone anew under a weight that stands still; mean tables.

        Dishes drawn at once have the same distribution in each further step, so one is enough; swept ones take ``moves`` sweeps
        to settle and as many to average.
        """
        self.move(weight, discount, rng)
        mean = self.expected.copy()
        if len(self.swept):
            mean[self.swept] = 0
            for turn in range(1, 2 * moves):
                self.seats.move(weight[self.swept], discount, rng)
                mean[self.swept] += self.seats.tables * (turn >= moves) / moves
            self.tables[self.swept] = self.seats.tables
        return mean


class Restaurants:
    """The context restaurants of a bucket, or the parts of them that were dealt there."""

    def __init__(self, path: str):
        self.contexts, self.context_counts, self.words, self.context, self.word, self.counts = unbundle(read_file(path))
        self.many = np.flatnonzero(self.counts > 1)
        self.seats: Dishes | None = None

    def tables(self, expected: bool = False) -> np.ndarray:
        """Tables of each pair, or their means where the last step has them."""
        out = np.minimum(self.counts, 1).astype(np.float64 if expected else np.int64)
        if self.seats is not None:
            out[self.many] = self.seats.expected if expected else self.seats.tables
        return out

    def per_context(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, tables, len(self.contexts))

    def sweep(self, parent: np.ndarray, totals: tuple[np.ndarray, np.ndarray], theta: float, discount: float, rng: np.random.Generator) -> None:
        """Gibbs sweep over the customers of each pair, given the parent's probability of each word and the tables of contexts that other buckets share."""
        drawn = rng.gamma(theta / discount + self.in_context(totals))
        weight = discount * drawn[self.context[self.many]] * parent[self.word[self.many]]
        if self.seats is None:
            self.seats = Dishes(self.counts[self.many], Seats.start(self.counts[self.many], weight, discount, rng).tables)
        self.seats.move(weight, discount, rng)

    def in_context(self, totals: tuple[np.ndarray, np.ndarray], expected: bool = False) -> np.ndarray:
        """Tables of each context, over all buckets."""
        tables, (shared, held) = self.per_context(self.tables(expected)), totals
        if len(shared):
            at = np.minimum(np.searchsorted(shared, self.contexts), len(shared) - 1)
            tables = np.where(shared[at] == self.contexts, held[at], tables)
        return tables

    def probabilities(self, parent: np.ndarray, totals: tuple[np.ndarray, np.ndarray], theta: float, discount: float) -> np.ndarray:
        """Predictive probability of each pair's second word after its first; it is linear in the tables, so their means are put in."""
        tables, seated = self.tables(expected=True), self.context_counts + theta
        own = np.where(self.counts > 0, self.counts - discount * tables, 0) / seated[self.context]
        rest = np.where(self.context_counts > 0, (theta + discount * self.in_context(totals, expected=True)) / seated, 1.0)
        return own + rest[self.context] * parent[self.word]


def merge_pairs(dealt: DataFrame, folder: str, tokens: int, buckets: int, shards: int) -> DataFrame:
    """Add up each bucket's pairs over all blocks (a file per bucket); first messages to the root.

    Rows (shard, bucket, packed) as in :func:`messages`; one per bucket with shard -2 has the pairs met once and twice.
    """

    def merge(batches):
        for bucket, rows in by_key(batches, "bucket"):
            first, of_first, runs, second, counts = zip(*(unbundle(p) for _, p in rows))
            contexts, at, where = np.unique(np.concatenate(first), return_index=True, return_inverse=True)
            context_counts = np.concatenate(of_first)[at]
            words, word = np.unique(np.concatenate(second), return_inverse=True)
            kinds, place = np.unique(np.repeat(where, np.concatenate(runs)) * len(words) + word, return_inverse=True)
            total = np.bincount(place, np.concatenate(counts), len(kinds)).astype(np.int64)
            put(f"{folder}/{bucket}.pairs", bundle(contexts, context_counts, words, kinds // len(words), kinds % len(words), total))
            # A block's pairs come in the order of their ids, so the places rise: only the steps are kept.
            sizes = np.array([len(s) for s in second])
            steps = np.diff(place, prepend=0)
            starts = np.cumsum(sizes) - sizes
            steps[starts] = place[starts]
            put(f"{folder}/{bucket}.places", bundle(np.array([b for b, _ in rows]), sizes, steps))
            found = Restaurants(f"{folder}/{bucket}.pairs")
            yield from messages(bucket, found, tokens, buckets, shards)
            yield message(-2, bucket, bundle(np.array([(total == 1).sum(), (total == 2).sum()])))

    return dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(merge, MESSAGE)


MESSAGE = "shard int, bucket int, packed binary"


def message(shard: int, bucket: int, packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())],
                                      names=["shard", "bucket", "packed"])


def messages(bucket: int, found: Restaurants, tokens: int, buckets: int, shards: int):
    """To each word shard: words of the bucket and their tables; to all (shard -1): tables of the contexts that are dealt over several buckets."""
    tables = found.tables()
    per_word = np.bincount(found.word, tables, len(found.words)).astype(np.int64)
    for shard, at in shard_places(found.words, shards):
        yield message(shard, bucket, bundle(found.words[at], per_word[at]))
    split = np.flatnonzero(spread_of(found.context_counts, tokens, buckets) > 1)
    if len(split):
        yield message(-1, bucket, bundle(found.contexts[split], found.per_context(tables)[split].astype(np.int64)))


def shard_places(words: np.ndarray, shards: int):
    """(shard, places of its words), by shard."""
    shard = words % shards
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        yield int(shard[part[0]]), part


def seat_root(sent: DataFrame, phase: int, folder: str, shards: int, totals: dict, theta: float, discount: float, moves: int) -> DataFrame:
    """Answers of the root to messages: per bucket and shard the discounted customers of each word asked for.

    The root's customers are the tables of all contexts.  Those of tables that are gone leave the seating of the
    phase before, those of new tables come in, then all are moved by Gibbs sweeps.  Rows with shard -3 have the sums of customers and tables; other rows pass.
    """
    base = 1 / (totals["words"] + 1)
    drawn = float(np.random.default_rng([phase, 0, 0]).gamma(theta / discount + totals["root_tables"]))

    def seat(batches):
        for shard, rows in by_key(batches, "shard"):
            if shard < 0:
                yield from (message(shard, b, p) for b, p in rows)
                continue
            words, asked = zip(*(unbundle(p) for _, p in rows))
            lengths = [len(w) for w in words]
            every, place = np.unique(np.concatenate(words), return_inverse=True)
            customers = np.bincount(place, np.concatenate(asked), len(every)).astype(np.int64)
            known = np.flatnonzero(customers)
            rng = np.random.default_rng([phase, 1, shard])
            weight = np.full(len(known), discount * drawn * base)
            if phase == 1:
                seats = Dishes(customers[known], Seats.start(customers[known], weight, discount, rng).tables)
            else:
                tables, swept, sizes = unbundle(read_file(f"{folder}/root{shard}.seats{phase - 1}"))
                seats = Dishes(customers[known], tables, swept, sizes)
                seats.change(customers[known], weight, discount, rng)
            mean = seats.settled(weight, discount, rng, moves)
            put(f"{folder}/root{shard}.seats{phase}", seats.packed())
            out = customers.astype(np.float64)
            out[known] -= discount * mean
            for (bucket, _), answer in zip(rows, np.split(out[place], np.cumsum(lengths)[:-1])):
                yield message(shard, bucket, bundle(answer.astype("<f4")))
            yield message(-3, -1, bundle(np.array([float(customers.sum()), mean.sum()])))

    # Rows for all (below zero, few) go with the first shard's.
    return sent.repartitionById(shards, F.greatest("shard", F.lit(0))).sortWithinPartitions("shard", "bucket").mapInArrow(seat, MESSAGE)


class Root:
    """What the driver knows of a phase: a few sums, and the tables of contexts dealt over several buckets (at most 4 entries per bucket)."""

    def __init__(self, answers: DataFrame, totals: dict, theta: float, discount: float):
        rows = answers.where("shard < 0").collect()
        customers, tables = np.sum([unbundle(r.packed)[0] for r in rows if r.shard == -3] or np.zeros((1, 2)), axis=0)
        self.tables = float(tables)
        self.rest = (theta + discount * self.tables) / (totals["words"] + 1)
        self.seated = theta + float(customers)
        parts = [unbundle(r.packed) for r in rows if r.shard == -1]
        ids, held = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
        shared, where = np.unique(ids, return_inverse=True)
        self.shared = shared, np.bincount(where, held, len(shared))
        kinds = [unbundle(r.packed)[0] for r in rows if r.shard == -2]
        self.once, self.twice = map(int, np.sum(kinds or np.zeros((1, 2), np.int64), axis=0))

    def parent(self, words: np.ndarray, rows: list, shards: int) -> np.ndarray:
        """The root's probability of each of a bucket's words, from its answers by shard."""
        out = np.empty(len(words))
        for (_, at), (_, packed) in zip(shard_places(words, shards), rows, strict=True):
            out[at] = unbundle(packed)[0]
        return (out + self.rest) / self.seated


def answers_by_bucket(answers: DataFrame, buckets: int) -> DataFrame:
    return (answers.where("shard >= 0").select("bucket", "shard", "packed").repartitionById(buckets, "bucket")
            .sortWithinPartitions("bucket", "shard"))


def open_bucket(folder: str, bucket: int, phase: int) -> Restaurants:
    """A bucket's restaurants as the phase before left them."""
    found = Restaurants(f"{folder}/{bucket}.pairs")
    if phase > 1:
        found.seats = Dishes(found.counts[found.many], *unbundle(read_file(f"{folder}/{bucket}.seats{phase - 1}")))
    return found


def sweep_buckets(answers: DataFrame, root: Root, phase: int, folder: str, tokens: int, buckets: int, shards: int,
                  theta: float, discount: float, sweeps: int) -> DataFrame:
    """Gibbs sweeps in all buckets, given the root's answers; the next messages."""

    def sweep(batches):
        for bucket, rows in by_key(batches, "bucket"):
            found, rng = open_bucket(folder, bucket, phase), np.random.default_rng([phase, 2, bucket])
            parent = root.parent(found.words, rows, shards)
            for _ in range(sweeps):
                found.sweep(parent, root.shared, theta, discount, rng)
            put(f"{folder}/{bucket}.seats{phase}", found.seats.packed())
            yield from messages(bucket, found, tokens, buckets, shards)

    return answers_by_bucket(answers, buckets).mapInArrow(sweep, MESSAGE)


def predict(answers: DataFrame, root: Root, phase: int, folder: str, buckets: int, shards: int, theta: float, discount: float, samples: int) -> DataFrame:
    """(block, bucket, packed): log10 probabilities of each block's pairs, averaged over ``samples`` seatings before the logarithm."""

    def score(batches):
        for bucket, rows in by_key(batches, "bucket"):
            found, rng = open_bucket(folder, bucket, phase), np.random.default_rng([phase, 2, bucket])
            parent = root.parent(found.words, rows, shards)
            mean = np.zeros(len(found.counts))
            for _ in range(samples):
                found.sweep(parent, root.shared, theta, discount, rng)
                mean += found.probabilities(parent, root.shared, theta, discount)
            logs = np.log10(mean / samples).astype("<f4")
            names, sizes, steps = unbundle(read_file(f"{folder}/{bucket}.places"))
            for block, part in zip(names.tolist(), np.split(steps, np.cumsum(sizes)[:-1])):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()),
                                                  pa.array([bundle(logs[np.cumsum(part)])], pa.binary())], names=["block", "bucket", "packed"])

    return answers_by_bucket(answers, buckets).mapInArrow(score, "block long, bucket int, packed binary")


def write_logs(scored: DataFrame, folder: str) -> None:
    """A file per block with the log probabilities of its pairs, by bucket."""

    def write(batches):
        for block, rows in by_key(batches, "block"):
            put(f"{folder}/{block}.logs", bundle(np.concatenate([unbundle(p)[0] for _, p in rows])))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64())], names=["block"])

    stored(scored.repartition(shuffle_tasks(scored), "block").sortWithinPartitions("block", "bucket").mapInArrow(write, "block long"), "lm-logs")


def score_texts(docs: DataFrame, held: Column, phases: int = 3, sweeps: int = 4, samples: int = 4, theta: float = 1.0) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_tokens, n_known, train_tokens, base_score and score (log10); rows that ``held`` names teach nothing.

    Words are lower-cased (A-Z), split at ASCII white space, and end with one end token.  Null texts are
    empty: one token.  Null and repeated ids stay rows of their own, repeated rows teach as often as they
    occur, a null ``held`` is false; other columns are left alone.  Without any training row all
    scores are zero; an empty table gives no row.  All pairs of words of all training rows are counted.

    ``phases`` exchanges between root and contexts (the first before any seating), ``sweeps`` Gibbs sweeps, each over every
    customer, in a phase, ``samples`` averaged in the last.  Discounts are estimated from how many words and pairs occur once and twice.
    """
    shards = word_shards(docs)
    blocks = stored(block_table(docs, held, shards), "lm-blocks")
    folder = new_shared_path(docs.sparkSession, "lm")
    totals = number_words(blocks, shards, folder)
    tokens = totals["tokens"]
    buckets = pair_buckets(docs, tokens)
    estimate = lambda once, twice: min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    root_discount = estimate(totals["once"], totals["twice"])
    totals["root_tables"] = float(totals["words"])

    sent = merge_pairs(deal_pairs(blocks, folder, tokens, buckets), folder, tokens, buckets, shards)
    for phase in range(1, phases + 1):
        answers = stored(seat_root(sent, phase, folder, shards, totals, theta, root_discount, 2 * sweeps), "lm-root")
        root = Root(answers, totals, theta, root_discount)
        totals["root_tables"] = root.tables
        if phase == 1:
            discount = estimate(root.once, root.twice)
        if phase < phases:
            sent = sweep_buckets(answers, root, phase, folder, tokens, buckets, shards, theta, discount, sweeps)
    write_logs(predict(answers, root, phases, folder, buckets, shards, theta, discount, samples), folder)

    def digest(batches):
        for batch in batches:
            for block, ids, out, packed in zip(*(c.to_pylist() for c in batch.columns)):
                p = Pairs(block, packed, out, folder, tokens, buckets)
                kinds, place = np.unique(p.keys, return_inverse=True)
                logs = np.empty(len(kinds))
                logs[p.dealt(kinds)[1]] = unbundle(read_file(f"{folder}/{block}.logs"))[0]
                counts, starts = p.counts[p.codes], np.cumsum(p.sizes) - p.sizes
                base = np.log10((p.counts + 1) / (tokens + totals["words"] + 1))[p.codes]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(p.sizes), pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(ids), tokens)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs[place], starts))], names=NAMES)

    return blocks.where("shard IS NULL").select("block", "docs", "held", "packed").mapInArrow(digest, RESULT)
