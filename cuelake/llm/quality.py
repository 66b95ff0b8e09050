"""Quality rules and gradient-boosted trees over document statistics (operator 3).

Statistics come from whole texts.  Trees are grown on histograms of a bounded sample of
labelled documents, with monotonic constraints on chosen features, and flattened into
numpy node arrays: scoring walks all trees of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import claim_cache, fresh, hash_share

WINDOW = 8
BLANK_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOL_BYTES = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Features of the trees with their constraint: -1 where more of it can only lower the
#: chance of good quality, 0 where the trees are free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": 0, "digit_share": 0, "mark_share": 0, "lone_sign_share": -1, "distinct_share": 0,
    "words_per_line": 0,
}


def word_ids(words: list[bytes]) -> np.ndarray:
    """Small integers, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) that occur twice or more, the first included.

    Windows are named exactly by doubling: pairs of names of half the length.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    names, span = ids, 1
    while span < window:
        both = names[:-span] * (int(names.max()) + 1) + names[span:]
        names, span = np.unique(both, return_inverse=True)[1], 2 * span
    twice = np.bincount(names)[names] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(:data:`COUNTS`, :data:`FEATURES`) of a text; null is empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    ids = word_ids(words)
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, BLANK_BYTES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOL_BYTES))
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(ids)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marks = raw.count(b"!") + raw.count(b"?")
    lone = raw.count(b" | ")
    some, per = max(n, 1), max(chars, 1)
    return ([n, chars, symbols, dups, repeats],
            [float(np.log1p(n)), chars / some, symbols / per, dups / max(len(lines), 1), repeats / some, upper / per,
             digits / per, marks / per, lone / some, (int(ids.max()) + 1) / n if n else 0.0, n / max(len(lines), 1)])


STATISTICS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("x", T.ArrayType(T.DoubleType()))])


def all_statistics(texts: pa.Array) -> pa.Array:
    claim_cache("quality", lambda: None)
    found = [statistics(t) for t in texts.to_pylist()]
    counts = [pa.array([c[k] for c, _ in found], pa.int64()) for k in range(len(COUNTS))]
    x = pa.array([x for _, x in found], pa.list_(pa.float64()))
    return pa.StructArray.from_arrays([*counts, x], [*COUNTS, "x"])


def statistics_column(text: str | Column) -> Column:
    return F.arrow_udf(all_statistics, STATISTICS)(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


@dataclass
class Trees:
    """Boosted trees as flat node arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of ``x``: all trees step down together."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], *, rounds: int = 60, depth: int = 3, rate: float = 0.2,
         bins: int = 64, ridge: float = 1.0, least: int = 20) -> Trees:
    """Fit trees to 0/1 labels by logistic loss.

    A split on a feature with sign s must not lower s times the right value below the left
    one, and the middle of both bounds all values below it: scores are monotonic.
    """
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        def best_value(gs, hs):
            return np.clip(-gs / (hs + ridge), low, high)

        own = float(best_value(g[rows].sum(), h[rows].sum()))
        best = None
        if level < depth and len(rows) >= 2 * least:
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b = binned[f][rows]
                n = np.bincount(b, minlength=len(cut) + 1).cumsum()
                gs = np.bincount(b, g[rows], len(cut) + 1).cumsum()
                hs = np.bincount(b, h[rows], len(cut) + 1).cumsum()
                gl, hl, nl = gs[:-1], hs[:-1], n[:-1]
                gr, hr, nr = gs[-1] - gl, hs[-1] - hl, n[-1] - nl
                vl, vr = best_value(gl, hl), best_value(gr, hr)
                loss = gl * vl + 0.5 * (hl + ridge) * vl ** 2 + gr * vr + 0.5 * (hr + ridge) * vr ** 2
                ok = (nl >= least) & (nr >= least) & ((signs[f] == 0) | (signs[f] * (vr - vl) >= 0))
                if ok.any():
                    k = int(np.argmin(np.where(ok, loss, np.inf)))
                    if best is None or loss[k] < best[0]:
                        best = (float(loss[k]), f, k, float(vl[k]), float(vr[k]))
            whole = g[rows].sum() * own + 0.5 * (h[rows].sum() + ridge) * own ** 2
            if best and best[0] > whole - 1e-6:
                best = None
        if best is None:
            return leaf(rate * own)
        _, f, k, vl, vr = best
        here = len(nodes)
        nodes.append([f, float(cuts[f][k]), 0, 0, 0.0])
        go = binned[f][rows] <= k
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[f]]
        nodes[here][2] = build(rows[go], g, h, level + 1, *bounds[0])
        nodes[here][3] = build(rows[~go], g, h, level + 1, *bounds[1])
        return here

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(build(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        margin += flat(nodes, [roots[-1]], depth, 0.0).score(x)
    return flat(nodes, roots, depth, bias)


def flat(nodes: list[list], roots: list[int], depth: int, bias: float) -> Trees:
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
    return Trees(np.array(roots), feature, threshold, left, right, value, depth, bias)


def fit(measured: DataFrame, labels: DataFrame, most_labels: int = 10_000, **options) -> Trees | None:
    """Trees from about ``most_labels`` labelled documents, chosen by a hash of doc_id.

    ``measured`` has doc_id and the statistics.  None where the sample has one class only.
    """
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    chosen = hash_share("doc_id", most_labels, labels.count())
    rows = (measured.where(chosen).join(labels.where(chosen), "doc_id")
            .select("doc_id", "quality", F.col("stats.x").alias("x")).toArrow())
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(rows), len(FEATURES))
    y = (rows.column("quality").to_numpy() > 0).astype(float)
    if len(set(y.tolist())) < 2:
        return None
    # Row order must not matter: sums of floats depend on it.
    order = np.lexsort([*x.T, y, rows.column("doc_id").to_numpy()])
    return grow(x[order], y[order], list(FEATURES.values()), **options)


def verdicts(docs: DataFrame, labels: DataFrame, least_chance: float = 0.5, **options):
    """Function of the statistics' ``x``: whether the trees give at least ``least_chance`` of good quality (true where none can be fitted)."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    chosen = hash_share("doc_id", options.get("most_labels", 10_000), sample.count())
    trees = fit(known.where(chosen).select("doc_id", statistics_column("text").alias("stats")), labels, **options)
    limit = float(np.log(least_chance / (1 - least_chance)))

    def good(x: pa.Array) -> pa.Array:
        if trees is None:
            return pa.array(np.ones(len(x), bool))
        return pa.array(trees.score(x.flatten().to_numpy().reshape(len(x), len(FEATURES))) >= limit)

    return good


def judged(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, str, str, str]:
    """``docs`` with statistics, base rule and verdict added; also the three names of those columns.

    A document is kept if it passes the base rules and the trees call it good (:func:`verdicts`).
    """
    stats, failed, kept = (fresh(docs.columns, n) for n in ("stats", "base_failed", "kept"))
    good = F.arrow_udf(verdicts(docs, labels, **options), "boolean")
    out = docs.withColumn(stats, statistics_column("text"))
    out = out.withColumn(failed, base_failed(F.col(stats)["n_words"], F.col(stats)["n_repeat_words"]))
    return out.withColumn(kept, ~F.col(failed) & good(F.col(stats)["x"])), stats, failed, kept


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts, base verdict and verdict.

    Null texts are empty (and fail the base rules); null or repeated ids are judged row
    by row; labels of ids that are null, unknown or repeated only weigh in the fit.
    """
    out, stats, failed, kept = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, **options)
    return out.select("doc_id", *[F.col(stats)[c].alias(c) for c in COUNTS],
                      F.col(failed).alias("base_failed"), F.col(kept).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that are kept, with their columns as they are.

    Statistics and verdict are one call, so that a task has one Python worker.
    """
    good = verdicts(docs, labels, **options)

    @F.arrow_udf("boolean")
    def keeps(texts: pa.Array) -> pa.Array:
        found = all_statistics(texts)
        n, repeated = (found.field(c).to_numpy() for c in ("n_words", "n_repeat_words"))
        failed = (n < 20) | (100 * repeated > 30 * n)
        return pa.array(~failed & good(found.field("x")).to_numpy(zero_copy_only=False))

    return docs.where(keeps("text"))
