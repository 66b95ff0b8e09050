"""Operators 1, 6 and 9 against the tokenizer libraries."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from cuelake.llm import bpe, packing, tokenfile, wordbpe
from cuelake.llm.queries import BYTE_BPE, WORD_BPE
from cuelake.llm.wordbpe import WordBpe

RANKS, WORDS = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(WORD_BPE)


@pytest.fixture(scope="module")
def byte_ids():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: library.encode_ordinary(text or "")


@pytest.fixture(scope="module")
def word_ids():
    library = Tokenizer.from_file(WORDS)
    return lambda text: library.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder_equals_the_library():
    encoder = WordBpe(WORDS, held=40)  # so few that it must forget
    texts = ["", "a", "  x  ", "Don't can't I'll é", "é́ x", "x ́y", "ÀÉß Ünï", "İstanbul ΣΑΣ", "a\x1cb\x1dc", "a\x85b c d",
             "<|endoftext|> z<|startoftext|>x", "it's''s", "1234 5a6", "!!!??? ...", "日本語 テキスト", "foo\tbar\r\nbaz", "º ª ²",
             "x " * 3000, "word, Word. WORD! word"]
    for text in texts + texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("together", [1, 50_000, 8 << 20])
def test_texts_encoded_together_equal_the_library(monkeypatch, odd_rows, word_ids, together):
    monkeypatch.setattr(wordbpe, "TOGETHER", together)
    texts = [r[1] for r in odd_rows] + ["Don't I'll", "a\tb\nc\rd", "x  y", " ", "café ÀÉÿ ß÷× naïve!?", "<|endoftext|> a", "́x y"]
    got = [flat[starts[k]:starts[k + 1]].tolist() for flat, starts in WordBpe(WORDS).encode_many(pa.array(texts)) for k in range(len(starts) - 1)]
    assert got == [word_ids(t)[:-1] for t in texts]
    sliced = WordBpe(WORDS).encode_many(pa.array(["never", *texts, "never"]).slice(1, len(texts)))
    assert [flat[starts[k]:starts[k + 1]].tolist() for flat, starts in sliced for k in range(len(starts) - 1)] == got
    assert list(WordBpe(WORDS).encode_many(pa.array([], pa.string()))) == []


def test_long_texts_are_encoded_in_parts(monkeypatch):
    from cuelake.llm import common

    encoder = WordBpe(WORDS)
    text = "some words, and more\nof them " * 50
    want = encoder.library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr("cuelake.llm.wordbpe.segments", lambda t: common.segments(t, 64))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


def test_byte_bpe_equals_the_library(odd, odd_rows, byte_ids):
    want = Counter()
    for doc, text, *_ in odd_rows:
        ids = byte_ids(text)
        want[doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.encode_decode(odd, RANKS, public_tokenizers.PATTERN).collect())) == want


def test_byte_bpe_pieces():
    import regex

    texts = [" a", "a ", " ", "  ", "a  b", "a   b", "a \n b", "a\n b", "a\n\n b", "a \nb", "a\n \nb", "a\t b", "a 's b", "a  b", "x\n", "\n x", "a \n", ""]
    block = bpe.Block(regex.compile(public_tokenizers.PATTERN))
    for k, text in enumerate(texts):
        block.add(k, text)
    words = list(block.words)
    for k, codes in block.codes():
        assert [words[c] for c in codes] == regex.findall(public_tokenizers.PATTERN, texts[k]), repr(texts[k])


def test_packed_words_and_numbers_come_back():
    words = [b"", b"a", " é".encode(), b"x" * 70_000]
    assert bpe.unpack_words(bpe.pack_words(words)) == words and bpe.unpack_words(bpe.pack_words([])) == []
    for numbers in ([], [0, 1, 2**32 - 1], list(range(1000))):
        assert bpe.unshrink(bpe.shrink(np.array(numbers, np.uint32))).tolist() == numbers


def test_byte_bpe_of_nothing_and_more_columns(nothing, clashing, odd):
    run = lambda df: bpe.encode_decode(df, RANKS, public_tokenizers.PATTERN)
    assert run(nothing).count() == 0
    assert Counter(map(tuple, run(clashing).collect())) == Counter(map(tuple, run(odd).collect()))


def test_token_files_round_trip(odd, clashing, nothing, odd_rows, word_ids):
    got = tokenfile.token_file_round_trip(odd, WORDS, docs_per_range=8, file_bytes=20_000).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(i), crc(i)) for d, i in ((d, word_ids(t)) for d, t, *_ in odd_rows))
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    ids = [r.doc_id for r in got]
    known = [d for d in ids if d is not None]
    assert known == sorted(known) and ids[:len(known)] == known  # ascending, nulls last
    assert len({r.file for r in got}) > 3
    again = tokenfile.token_file_round_trip(clashing, WORDS).collect()
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in again) == sorted((r.start, r.n_tokens, r.ids_crc32) for r in got)
    assert tokenfile.token_file_round_trip(nothing, WORDS).count() == 0


def test_one_document_is_read_by_its_index(word_ids):
    held = []
    packer = tokenfile.compressor(b"")
    for d in (5, None, 9):
        ids = np.array(word_ids(f"text of {d}"), "<u2")
        held.append((d, len(ids), packer.compress(ids.tobytes())))
    data = tokenfile.token_file(held, b"\0" * 32, 2)
    index = tokenfile.file_index(data)
    assert tokenfile.read_document(data, index, 2, tokenfile.decompressor(b"")).tolist() == word_ids("text of 9")
    with pytest.raises(ValueError):
        tokenfile.file_index(data[:-1] + b"x")


def check_packing(rows, want, window):
    """Every id in one piece, sequences gapless and within the window; the share of padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for doc, ids in want.items():
        found = sorted(pieces[doc], key=lambda r: r.start)
        assert sum(r.length for r in found) == len(ids)
        at = 0
        for r in found:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at:at + r.length])
            at += r.length
        total += len(ids)
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    return padding / (padding + total)


def test_packing_of_the_supplied_documents(spark, word_ids):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: word_ids(r.text) for r in docs.collect()}
    for window, unit in ((4096, 16), (512, 8)):
        assert check_packing(packing.pack(docs, WORDS, window=window, unit=unit).collect(), want, window) < 0.04


def test_packing_of_odd_rows(spark, odd, clashing, nothing, odd_rows, word_ids):
    got = packing.pack(odd, WORDS).collect()
    assert sum(r.length for r in got) == sum(len(word_ids(t)) for _, t, *_ in odd_rows)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == Counter(
        (r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.pack(clashing, WORDS).collect())
    assert packing.pack(nothing, WORDS).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(3)
    for full in (16, 256):
        histogram = dict(enumerate(rng.integers(0, 400, full), 1))
        made = packing.plan(histogram, full)
        used = Counter()
        for mix, times in made:
            assert 0 < sum(mix) <= full and times > 0
            for c in mix:
                used[c] += times
        assert used == Counter({c: int(n) for c, n in histogram.items() if n})
    assert packing.plan({}, 16) == []


def test_least_squares_meets_a_solvable_system():
    matrix = np.array([[1.0, 0, 2, 1], [0, 1, 1, 3], [1, 1, 0, 0]])
    target = matrix @ np.array([2.0, 0, 1, 3])
    x = packing.least_squares(matrix, target)
    assert (x >= 0).all() and np.allclose(matrix @ x, target, atol=1e-4)
