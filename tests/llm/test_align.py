"""Tokenizer alignment against plain loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.llm import align
from cuelake.llm.common import tokenizer_path
from cuelake.llm.queries import ENGLISH_BPE, PIECE_BPE

from .conftest import SMALL

PLACES = tokenizer_path(ENGLISH_BPE), tokenizer_path(PIECE_BPE), public_tokenizers.PATTERN
CELLS = st.lists(st.lists(st.integers(0, 3), min_size=4, max_size=4), min_size=0, max_size=6)


def sparse(dense: np.ndarray) -> align.Csr:
    row, col = np.nonzero(dense)
    return align.Csr(np.searchsorted(row, np.arange(len(dense) + 1)), col, dense[row, col], dense.shape[1])


def whole(m: align.Csr) -> np.ndarray:
    out = np.zeros((m.rows, m.width), np.int64)
    np.add.at(out, m.pairs(), m.values)
    return out


@settings(max_examples=60, deadline=None)
@given(CELLS, CELLS, st.integers(1, 9))
def test_products(a, b, block):
    a, b = np.array(a, np.int64).reshape(-1, 4), np.array(b, np.int64).reshape(-1, 4)
    held, align.BLOCK = align.BLOCK, block
    try:
        got = align.product(sparse(a), align.turned(sparse(b)))
    finally:
        align.BLOCK = held
    assert np.array_equal(whole(got), a @ b.T)
    assert np.array_equal(whole(align.turned(sparse(a))), a.T)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=30), st.lists(st.booleans(), max_size=30))
def test_links_of_two_cuts(a, b):
    n = min(len(a), len(b)) + 1
    sizes = [np.diff([0, *[k + 1 for k in range(n - 1) if cuts[k]], n]) for cuts in (a, b)]
    spans_a, spans_b = ([(e - s, e) for s, e in zip(x, np.cumsum(x))] for x in sizes)
    overlaps = align.overlap_links(*sizes)
    want = [[max(0, min(e, f) - max(s, t)) for t, f in spans_b] for s, e in spans_a]
    assert np.array_equal(whole(overlaps), want)
    i, j = align.end_links(*sizes, overlaps)
    assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x, (_, e) in enumerate(spans_a) for y, (_, f) in enumerate(spans_b) if e == f}
    group_a, group_b = align.group_sizes(i), align.group_sizes(j)
    place = lambda k, ends: sum(k > e for e in ends)
    shared = whole(align.shared_group_links(group_a, group_b))
    assert np.array_equal(shared, [[int(place(x, i) == place(y, j)) for y in range(len(spans_b))] for x in range(len(spans_a))])
    assert shared.sum() == group_a @ group_b


def plain(texts):
    """Digest rows by loops over bytes, with the library that reads the vocabulary's other file."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_BPE))
    table = align.opened(*PLACES)
    found, counts = [], Counter()
    for text in texts:
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        line = (" " + (text or "")).encode()
        if not text or b"".join(table.a_bytes[x] for x in a) != line or b"".join(table.b_bytes[x] for x in b) != line:
            found.append(([], []))
            continue
        ends = [{e: k for k, e in enumerate(np.cumsum([len(t[x]) for x in ids]).tolist())} for t, ids in ((table.a_bytes, a), (table.b_bytes, b))]
        links = [(ends[0][e], ends[1][e]) for e in ends[0] if e in ends[1]]
        counts.update((a[i], b[j]) for i, j in links)
        groups, p, q = [], 0, 0
        for i, j in links:
            groups.append((a[p:i + 1], b[q:j + 1]))
            p, q = i + 1, j + 1
        found.append(([(a[i], b[j]) for i, j in links], groups))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for links, groups in found:
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    return out


def digests(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, align.alignment_digests(df, *PLACES).select(columns).collect()), key=repr)


def test_digests_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert digests(docs) == sorted([(r.doc_id, *p) for r, p in zip(rows, plain([r.text for r in rows]))], key=repr)


def test_odd_rows(spark, odd, odd_rows, clashing, nothing):
    more = [(50, "<|endoftext|> <s> </s> <unk>", "en", "a", 1), (51, "▁a ▁ b", "en", "a", 1), (52, "tab\tand\nline", "en", "a", 1), (53, "a  b   c", "en", "a", 1)]
    df = odd.union(spark.createDataFrame(more, odd.schema))
    every = [*odd_rows, *more]
    assert digests(df) == sorted([(r[0], *p) for r, p in zip(every, plain([r[1] for r in every]))], key=repr)
    assert digests(clashing) == digests(odd)
    assert digests(nothing) == []


def test_long_texts_are_cut_without_a_trace(monkeypatch, odd_rows):
    both = align.opened(*PLACES)
    text = odd_rows[4][1]
    want = both.encode(text[:40_000])
    monkeypatch.setattr(align, "PART", 1000)
    assert all(np.array_equal(x, y) for x, y in zip(both.encode(text[:40_000]), want, strict=True))


def test_link_tables(spark):
    docs = spark.createDataFrame([(1, "unaligned tokenizations"), (2, None)], "doc_id LONG, text STRING")
    aligned = align.alignments(docs, *PLACES)
    row = aligned.where("doc_id = 1").first()
    by_kind = {k: align.links(aligned, *PLACES, kind=k).collect() for k in ("overlap", "end", "group")}
    assert len(by_kind["overlap"]) == row.n_overlaps and len(by_kind["group"]) == row.n_shared
    assert sum(r.weight for r in by_kind["overlap"]) == len(" unaligned tokenizations")
    assert {(r.a, r.b) for r in by_kind["end"]} == set(zip((np.cumsum(align.unpacked(row.group_a)) - 1).tolist(), (np.cumsum(align.unpacked(row.group_b)) - 1).tolist()))
    assert {r.doc_id for k in by_kind for r in by_kind[k]} == {1}
    assert 0 < align.pair_counts(aligned).count() <= align.most_pairs(*PLACES)
