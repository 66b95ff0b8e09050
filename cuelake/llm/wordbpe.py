"""Encoding of whole texts with a word-end BPE of the ``tokenizers`` library.

White space only separates words in such a vocabulary, so a text's ids are the ids
of its blank-separated pieces in order.  A worker keeps the pieces it has met and asks
the library for new ones only: pieces repeat far more often than texts do.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cuelake.llm.bpe import spans
from cuelake.llm.common import claim_cache, segments

#: Letters of one alphabet block that need no normalisation but lower case, then ASCII signs
#: without the apostrophe (contractions are split by rule): two pre-tokens of the library.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: The same for Arrow.
PLAIN_PARTS = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"
#: Bytes of texts whose pieces are found together.
TOGETHER = 8 << 20


class WordBpe:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the library's own."""

    def __init__(self, path: str, held: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.held, self.pieces, self.words = held, {"": b""}, {}

    def encode(self, text: str) -> bytes:
        return b"".join([self._segment(part) for part in segments(text)])

    def _segment(self, part: str) -> bytes:
        for blank in "\n\t\r":
            if blank in part:
                part = part.replace(blank, " ")
        pieces = part.split(" ")
        found = list(map(self.pieces.get, pieces))
        if None in found:
            self._learn({p for p, ids in zip(pieces, found) if ids is None})
            found = [self.pieces[p] if ids is None else ids for p, ids in zip(pieces, found)]
        return b"".join(found)

    def encode_many(self, texts: pa.Array):
        """(ids, starts) of runs of texts, all in order: text k of a run has ``ids[starts[k]:starts[k + 1]]``.

        Distinct pieces are found by Arrow, and the library is asked once for the new words of a run.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(texts):
            before = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, before + TOGETHER, "right")))
            yield self._run(texts.slice(lo, hi - lo))
            lo = hi

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        listed = pc.split_pattern(pc.replace_substring_regex(texts, r"[\n\t\r]", " "), " ")
        ends = listed.offsets.to_numpy().astype(np.int64)
        coded = listed.flatten().dictionary_encode()
        pieces = coded.dictionary
        parts = pc.extract_regex(pieces, PLAIN_PARTS)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        words = pc.utf8_lower(parts.field("word").filter(parts.is_valid())).dictionary_encode()
        signs = parts.field("signs").filter(parts.is_valid()).dictionary_encode()
        other = pieces.filter(pa.array(~plain)).to_pylist()
        # A piece is two units: a word and its signs, or the piece as it is and nothing.
        every_word, every_sign = words.dictionary.to_pylist(), signs.dictionary.to_pylist()
        if len(self.words) > self.held * 3 // 2:  # forget, to bound memory
            self.words = {}
        self._learn_words({w for w in every_word if w not in self.words})
        for sign in every_sign:
            if sign not in self.words:
                self.words[sign] = self._library([sign])[0]
        units = [*map(self.words.__getitem__, every_word), *map(self.words.__getitem__, every_sign), *self._library(other), b""]
        pairs = np.empty((len(pieces), 2), np.int64)
        pairs[plain, 0] = words.indices.to_numpy()
        pairs[plain, 1] = signs.indices.to_numpy().astype(np.int64) + len(every_word)
        pairs[~plain, 0] = np.arange(len(other)) + len(every_word) + len(every_sign)
        pairs[~plain, 1] = len(units) - 1
        starts = np.concatenate([[0], np.cumsum([len(u) // 4 for u in units])])
        picked = pairs[coded.indices.to_numpy()].reshape(-1)
        before = np.concatenate([[0], np.cumsum(np.diff(starts)[picked])])
        return spans(np.frombuffer(b"".join(units), "<u4"), starts, picked), before[2 * (ends - ends[0])]

    def _learn(self, new: set[str]) -> None:
        if len(self.pieces) + len(new) > self.held:  # forget, to bound memory
            self.pieces = {"": b""}
            if len(self.words) > self.held * 3 // 2:
                self.words = {}
        plain = {p: m for p in new if (m := PLAIN.fullmatch(p))}
        self._learn_words({w for m in plain.values() if (w := m[1].lower()) not in self.words})
        for signs in {m[2] for m in plain.values() if m[2] not in self.words}:
            self.words[signs] = self._library([signs])[0]
        for piece, m in plain.items():
            self.pieces[piece] = self.words[m[1].lower()] + self.words[m[2]]
        other = [p for p in new if p not in plain]
        self.pieces.update(zip(other, self._library(other)))

    def _learn_words(self, words: set[str]) -> None:
        """One call for all words: each ends at its only token that carries the word end."""
        if not words:
            return
        ordered = list(words)
        ids = np.array(self.library.encode(" ".join(ordered), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(ordered) and (not len(stops) or stops[-1] == len(ids)):
            raw, start = ids.tobytes(), 0
            for word, stop in zip(ordered, (stops * 4).tolist()):
                self.words[word] = raw[start:stop]
                start = stop
        else:
            self.words.update(zip(ordered, self._library(ordered)))

    def _library(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]


_OPEN: dict[str, WordBpe] = {}


def opened(path: str) -> WordBpe:
    """The worker's encoder for a vocabulary file, kept until another operator's cache takes its place."""
    claim_cache("wordbpe", _OPEN.clear)
    if path not in _OPEN:
        _OPEN[path] = WordBpe(path)
    return _OPEN[path]
