"""Language identification by words first, then ever shorter character n-grams (operator 8).

A word that the model knows is scored by its log frequency per language.  An unseen
word is scored by its longest character n-grams; where one of those is unseen too, the
n-grams one character shorter stand in for it, down to single characters.

Words and n-grams are counted over the whole sample and kept by rank within each language, so a small
language beside large ones keeps its own.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import claim_cache, fresh, hash_share, segments, stored

#: Runs of letters: word characters of any alphabet without digits and the underscore.
WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
UNKNOWN = "und"
HELD = 150_000


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between bounds."""
    padded = f"^{word}$"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


Table = tuple[dict[str, int], np.ndarray]


class Model:
    """Log frequencies of words and of n-grams: row numbers by name, and a float32 row per name with a column per language."""

    def __init__(self, languages: list[str], words: Table, tables: list[Table]):
        self.languages, self.words, self.tables = languages, words, tables
        self.met: dict[str, np.ndarray] = {}

    @classmethod
    def learn(cls, counts: list[tuple[str, str, int]]) -> Model:
        """From (word, language, count) of all words."""
        languages = sorted({lang for _, lang, _ in counts})
        of_grams = Counter()
        for word, lang, n in counts:
            for k in range(1, LONGEST + 1):
                of_grams.update({(g, lang): n * m for g, m in Counter(grams(word, k)).items()})
        return cls.of_counts(languages, counts, [(g, lang, n) for (g, lang), n in of_grams.items()])

    @classmethod
    def of_counts(cls, languages: list[str], words: list[tuple[str, str, int]], pieces: list[tuple[str, str, int]]) -> Model:
        """From the counts of the words and of the n-grams that are kept."""
        at = {lang: k for k, lang in enumerate(languages)}
        tables: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for table, name, lang, n in [*((0, *w) for w in words), *((len(g[0]), *g) for g in pieces)]:
            tables[table].setdefault(name, np.zeros(len(languages)))[at[lang]] += n
        return cls(languages, smoothed(tables[0]), [smoothed(t) for t in tables[1:]])

    def unseen_score(self, word: str) -> np.ndarray:
        row = self.met.get(word)
        if row is None:
            if len(self.met) >= HELD:
                self.met.clear()
            row = self.met[word] = self._unseen(word)
        return row

    def _unseen(self, word: str) -> np.ndarray:
        """Mean over the longest n-grams of the word, each backed off until it is known."""
        if len(word) > 64:  # not a word: its n-grams in parts, so that work stays in proportion
            parts = [word[i:i + 64] for i in range(0, len(word), 64)]
            return np.mean([self._unseen(p) for p in parts], axis=0, dtype=np.float32)
        total, n = np.zeros(len(self.languages), np.float32), 0
        for gram in grams(word, min(LONGEST, len(word) + 2)):
            total += self._gram(gram)
            n += 1
        return total / max(n, 1)

    def _gram(self, gram: str) -> np.ndarray:
        known, rows = self.tables[len(gram) - 1]
        if gram in known:
            return rows[known[gram]]
        if len(gram) == 1:
            return np.zeros(len(self.languages), np.float32)
        return (self._gram(gram[:-1]) + self._gram(gram[1:])) / 2

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, its share of the evidence); ``und`` and 0 for a text without a letter."""
        met = Counter()
        for part in segments(text or ""):
            met.update(WORD.findall(part.lower()))
        met = {w: n for w, n in met.items() if w.isalpha() or any(map(str.isalpha, w))}
        if not met or not self.languages:
            return UNKNOWN, 0.0
        known, rows = self.words
        at = np.array([known.get(w, -1) for w in met])
        times, seen = np.array(list(met.values()), np.float64), at >= 0
        total = times[seen] @ rows[at[seen]]
        for word, n, there in zip(met, times.tolist(), seen.tolist()):
            if not there:
                total = total + n * self.unseen_score(word)
        best = int(np.argmax(total))  # ties: the first language by name
        return self.languages[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def smoothed(table: dict[str, np.ndarray]) -> Table:
    """Log of smoothed shares, less their mean over languages.

    One is added for the language with most counts, and as much less for the others as they have less: what
    a language has not met is equally rare in all of them, whatever their sizes.
    """
    if not table:
        return {}, np.zeros((0, 1), np.float32)
    rows = np.array(list(table.values()))
    totals = np.maximum(rows.sum(axis=0), 1e-9)
    one = totals / totals.max()
    logs = np.log((rows + one) / (totals + one * len(rows)))
    logs -= logs.mean(axis=1, keepdims=True)
    return {name: k for k, name in enumerate(table)}, logs.astype(np.float32)


def counted(rows: DataFrame, names: list[str], count) -> DataFrame:
    """(name, lang, n): what ``count`` adds to a Counter of (name, lang) for each row, summed up."""

    def add(batches):
        claim_cache("langid", lambda: None)
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in held]), pa.array([g for _, g in held]), pa.array(list(held.values()), pa.int64())],
                ["name", "lang", "n"])
            held.clear()
            return out

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                count(held, *row)
                if len(held) > 100_000:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(add, "name string, lang string, n long").groupBy("name", "lang").agg(F.sum("n").alias("n"))


def count_words(held: Counter, text: str | None, lang: str) -> None:
    for part in segments(text or ""):
        for word, n in Counter(WORD.findall(part.lower())).items():
            held[word, lang] += n


def count_grams(held: Counter, word: str, lang: str, n: int) -> None:
    for part in (word[i:i + 64] for i in range(0, len(word), 64)):
        for k in range(1, LONGEST + 1):
            for gram in grams(part, k):
                held[gram, lang] += n


def most_frequent(counts: DataFrame, most: int, size: Column) -> list[tuple[str, str, int]]:
    """Counts, in all languages, of the names that are among the most frequent of a language; ``size`` tells kinds of names apart.

    ``most`` names of a kind are shared out evenly; of names that are equally frequent at the end of a
    language's share all go or all stay.
    """
    sized = stored(counts.withColumn("size", size.cast("int")), "lang-counts")
    steps = sized.groupBy("size", "lang", "n").agg(F.count("*").alias("names")).collect()
    share = max(1, most // max(1, len({r.lang for r in steps})))
    least: dict = {}
    taken: Counter = Counter()
    for r in sorted(steps, key=lambda r: -r.n):
        key = r["size"], r.lang
        taken[key] += r.names
        if taken[key] <= share or key not in least:
            least[key] = r.n
    if not least:
        return []
    bounds = counts.sparkSession.createDataFrame([(*k, n) for k, n in least.items()], "size INT, lang STRING, least LONG")
    kept = sized.join(bounds, ["size", "lang"]).where("n >= least").select("name").distinct()
    found = sized.join(kept, "name").select("name", "lang", "n").toArrow()
    return sorted(zip(*(found.column(c).to_pylist() for c in ("name", "lang", "n"))))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, most_docs: int = 20_000, most_words: int = 60_000) -> Model:
    """Learn from about ``most_docs`` documents with a language, chosen by a hash of doc_id among those not held out.

    All their words and n-grams are counted; of each kind (words, n-grams of one length) about ``most_words``
    are kept, as many for each language.
    """
    usable = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    chosen = usable.where(hash_share("doc_id", most_docs, usable.select("doc_id").count()))
    words = stored(counted(chosen, ["text", "lang"], count_words), "lang-words")
    pieces = counted(words, ["name", "lang", "n"], count_grams)
    kept = most_frequent(words, most_words, F.lit(0))
    return Model.of_counts(sorted({lang for _, lang, _ in kept}), kept, most_frequent(pieces, most_words, F.length("name")))


def predicted(docs: DataFrame, **options) -> tuple[DataFrame, str]:
    """``docs`` with a struct (lang, score) added, and that column's name."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        model = shared.value
        claim_cache("langid", model.met.clear)
        found = [model.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang", "score"])

    name = fresh(docs.columns, "predicted")
    return docs.withColumn(name, predict(F.col("text"))), name


def languages(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs(doc_id, text, lang)``: doc_id, held_out, lang_pred, score.

    Null and letterless texts are ``und`` with score 0, and so is every text where nothing could
    be learned; repeated rows are predicted one by one.  Of equally likely languages the first by name is taken.
    Texts of any length are read whole, in parts; an empty table gives no row.
    """
    out, name = predicted(docs.select("doc_id", "text", "lang"), **options)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                      F.col(name)["lang"].alias("lang_pred"), F.col(name)["score"].alias("score"))


def keep_known(docs: DataFrame, least_score: float = 0.5, **options) -> DataFrame:
    """Rows of ``docs`` whose language can be told, with their columns as they are."""
    out, name = predicted(docs, **options)
    return out.where((F.col(name)["lang"] != UNKNOWN) & (F.col(name)["score"] >= least_score)).select(*docs.columns)
