"""Operators 4, 7 and 10 against brute force and SQL."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from cuelake.llm import topk, urlfilter, warc
from cuelake.llm.queries import ORACLE, QUERIES, URL_RULES

SMALL = "/root/testdata/sf0.001"


# -- top-k --------------------------------------------------------------------


def plain_top(rows, k, is_query):
    usable = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for n, (q, a) in enumerate(usable):
        if is_query(q):
            scored = [(-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(usable) if m != n and len(b) == len(a)]
            out.update((q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1))
    return out


def vectors(seed, n, dim=6, spread=3.0):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-spread, spread) for _ in range(dim)]) for i in range(n)]
    rows += [(1000 + i, list(rows[20][1])) for i in range(60)]  # a very common vector: ties far beyond k
    rows += [(40, list(rows[3][1])), (40, list(rows[3][1])), (None, [1.0] * dim), (7000, None), (8000, [1.0, None] * 3), (9000, [float("nan")] * dim),
             (9020, [float("inf")] * dim), (5000, [2.0, 1.0]), (5020, [1.0, 1.0]), (6000, []), (6020, []), (3000, [0.5] * 9)]
    return rows


@pytest.mark.parametrize("spread", [3.0, 4e5])
def test_top_k_with_ties_nulls_and_odd_lengths(spark, spread):
    rows = vectors(1, 150, spread=spread)
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").withColumn("score", F.lit("clash"))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, tile_rows=32, query_rows=4).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_top(rows, 5, lambda i: i % 20 == 0)


def test_top_k_of_few_and_none(spark):
    schema = "vec_id LONG, embedding ARRAY<FLOAT>"
    few = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (20, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(few, schema), F.col("vec_id") % 20 == 0).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_top(few, 20, lambda i: i % 20 == 0)
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_neither_shuffles_nor_broadcasts_tiles(spark, monkeypatch):
    rows = vectors(2, 150)
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>")
    passes = []
    monkeypatch.setattr(topk, "kept", lambda grid, *more, _kept=topk.kept: passes.append(grid) or _kept(grid, *more))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, tile_rows=32, query_rows=4).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_top(rows, 5, lambda i: i % 20 == 0)
    assert passes[0].count() == 7 * 5  # every query tile meets every candidate tile
    assert {kind for _, kind in passes[0].dtypes} <= {"int", "string"}  # of which the rows hold names only


# -- WARC ---------------------------------------------------------------------


PAGES = "page_id LONG, url STRING, html STRING"


def odd_pages():
    big, other = "<p>é</p>" * 200, "y" * 999
    rows = [(i, f"http://h/{i}", big) for i in (4, 9, 2, 30)] + [(i, f"http://h/{i}", other) for i in (5, 6)]
    rows += [(7, None, None), (8, "http://h/\r\nX: y", ""), (None, "http://n/", big), (None, None, None), (31, "http://h/31", "z" * 1000), (31, "http://h/31", "z" * 1000),
             (32, "http://h/32", "z" * 1000 + "\r\n\r\nWARC/1.1\r\n"), (40, "http://é/", "L" * 3_000_000)]
    return rows


def plain_pages(rows, least=1000):
    heads = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= least and page is not None:
            heads[payload] = max(heads.get(payload, page), page)
    out = Counter()
    for page, _, html in rows:
        payload = (html or "").encode()
        head = heads.get(payload)
        revisit = head is not None and head != page
        out[page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", head if revisit else None] += 1
    return out


def test_warc_round_trip(spark):
    rows = odd_pages()
    df = spark.createDataFrame(rows, PAGES).withColumns({"same": F.lit(1), "payload": F.lit("x"), "digest": F.lit("y")})
    assert Counter(map(tuple, warc.warc_round_trip(df).collect())) == plain_pages(rows)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_records_are_fetched_by_place_and_bundles_are_plain_zstd(spark, tmp_path):
    rows = odd_pages()
    index = warc.write_bundles(spark.createDataFrame(rows, PAGES), str(tmp_path)).collect()
    html = {p: h for p, _, h in rows}
    for r in index:
        fields, payload = warc.fetch(r.bundle, r.frame, r.start)
        assert warc.page_of(fields["WARC-Record-ID"]) == r.page_id
        if fields["WARC-Type"] == "response" and r.page_id is not None:
            assert payload.decode() == (html[r.page_id] or "")
    for path in {r.bundle for r in index}:
        data = open(path, "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert plain == b"".join(warc.frames(path))


# -- URL filter -----------------------------------------------------------------


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:end], rest[end:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
        path = tail[:stop]
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


URLS = ["http://A.Example.ORG/es/1?x", "http://example.org/es/", "http://example.org/es", "http://notexample.org/es/2", "https://x.org", "ftp://org/y#z",
        "http://b.example.com/de/3", "http://b.example.com/fr/3", "http://com/de/", "http://b.example.com/en", "x.org/y", "", None, "://", "a://b://c/d",
        "http://h?x=/org/", "http://h#://z", "http://É.org/ä/ü", "http://example.org/en/12", "http://example.org/en/2", "http://xcom/de/", "http://a.net/\n/b"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS * 2)] + [(None, "http://x.org/", "")], PAGES).withColumns({"host": F.lit(1), "rule": F.lit(2)})
    got = urlfilter.judge(df, URL_RULES).collect()
    assert len(got) == 2 * len(URLS) + 1
    for r in got:
        host, path, rule, verdict = plain_rule(URLS[r.page_id % len(URLS)] if r.page_id is not None else "http://x.org/")
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    assert urlfilter.judge(df.limit(0), URL_RULES).count() == 0


def link_pages(n=300, seed=6):
    rng = random.Random(seed)
    hosts = [f"{s}.{d}" for d in ("a.com", "b.org", "c.net", "d.io") for s in ("www", "m", "x.y")]
    rows = []
    for i in range(n):
        links = "".join(rng.choice(['<a href="{}">', "<a HREF='{}'>", "<a href={} >"]).format(
            rng.choice([f"http://{rng.choice(hosts)}/p{i}", f"//{rng.choice(hosts).upper()}?q", "/local", "#top", "mailto:a@b.c"])) for _ in range(rng.randint(0, 4)))
        rows.append((i, f"https://{rng.choice(hosts)}/{rng.choice(['de', 'fr', 'en', 'es'])}/{i}", links))
    return rows


def test_propagation_equals_its_sql(spark, tmp_path):
    df = spark.createDataFrame(link_pages(), PAGES)
    df.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    want = con.execute(ORACLE["op10_url_filter"])
    names = [c[0] for c in want.description]
    got = urlfilter.judge(df, URL_RULES).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_distrust_goes_to_those_who_link_to_blocked_hosts(spark):
    rows = [(0, "http://bad.com/de/1", ""), (1, "http://linker.net/x", '<a href="http://bad.com/">'), (2, "http://good.org/x", '<a href="http://friend.net/">'),
            (3, "http://friend.net/x", ""), (4, "http://alone.net/x", "")]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, PAGES), URL_RULES).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow"}


def plain_scores(edges, seeds):
    """Fixed point of personalised PageRank as a linear system."""
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    step = np.zeros((len(hosts), len(hosts)))
    for a, b in edges:
        step[at[b], at[a]] = 1 / sum(x == a for x, _ in edges)
    start = np.array([seeds.get(h, 0.0) for h in hosts])
    found = np.linalg.solve(np.eye(len(hosts)) - urlfilter.DAMPING * step, (1 - urlfilter.DAMPING) * start)
    return dict(zip(hosts, found))


def test_scores_are_the_fixed_point(spark):
    """A chain of ten hosts behind a seed, a ring, a host with many links, and one that no seed reaches."""
    rng = random.Random(8)
    edges = {(f"c{k}", f"c{k + 1}") for k in range(10)} | {(f"r{k}", f"r{(k + 1) % 5}") for k in range(5)} | {("c9", "r0"), ("lost", "c3")}
    edges |= {("hub", f"r{rng.randrange(5)}") for _ in range(4)} | {("r2", "hub")}
    seeds = [("c0", 0.5, 0.0), ("r1", 0.5, 0.25), ("hub", 0.0, 0.75), ("single", 0.0, 0.0)]
    got = {r.host: r for r in urlfilter.propagate(spark.createDataFrame(sorted(edges), "src STRING, dst STRING"),
                                                  spark.createDataFrame(seeds, "host STRING, trust DOUBLE, distrust DOUBLE")).collect()}
    trust = plain_scores(edges, {h: t for h, t, _ in seeds})
    distrust = plain_scores({(b, a) for a, b in edges}, {h: d for h, _, d in seeds})
    assert got["c9"].trust > 0 and "single" not in got and got["lost"].trust == 0
    for h in trust:
        if h in got:
            assert (got[h].trust, got[h].distrust) == pytest.approx((trust[h], distrust[h]), rel=1e-4)
        else:
            assert trust[h] == distrust[h] == 0


def test_a_seed_ten_hosts_away_decides(spark):
    links = [(k, f"http://h{k}.net/x", f'<a href="http://h{k + 1}.net/">') for k in range(9)] + [(9, "http://h9.net/x", '<a href="http://bad.com/">'), (10, "http://bad.com/de/1", "")]
    rows = spark.createDataFrame(links, PAGES)
    assert {r.verdict for r in urlfilter.judge(rows, URL_RULES).collect()} == {"block"}
    # A thousand times the pages, elsewhere: the same hosts get the same verdicts.
    more = rows.union(spark.range(1000).select(F.col("id") + 100, F.format_string("http://e%d.org/x", "id"), F.lit("")))
    assert {r.verdict for r in urlfilter.judge(more, URL_RULES).where("page_id < 100").collect()} == {"block"}


def test_many_rules_are_a_table(spark):
    rng = random.Random(3)
    labels = ["a", "b", "com", "org", "x"]
    rules = {}
    for _ in range(400):
        r = urlfilter.Rule(".".join(rng.choices(labels, k=rng.randint(1, 4))), "/" + "/".join(rng.choices("pq", k=rng.randint(0, 3))), rng.choice(["allow", "block"]))
        rules[r.name] = r
    rows = [(k % 290, f"http://{'.'.join(rng.choices(labels, k=rng.randint(1, 5)))}/{'/'.join(rng.choices('pqr', k=3))}", None) for k in range(300)] + [(None, None, None)]
    named = spark.createDataFrame(rows, PAGES).select("page_id", *[c.alias(n) for c, n in zip(urlfilter.parts(F.col("url")), ("host", "path"))])
    want = Counter(map(tuple, urlfilter.with_rule(named, list(rules.values()), inline=10 ** 6).collect()))
    assert Counter(map(tuple, urlfilter.with_rule(named, list(rules.values()), inline=0).collect())) == want
    assert len({r[3] for r in want}) > 20


# -- registered SQL -------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_registered_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "embeddings", "documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())
