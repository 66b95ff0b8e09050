"""Splits, weights, sequences, context features, scoring and training (H operators)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuelake.functions.let import bound
from cuelake.functions.math import array_sum, relu, sigmoid
from cuelake.functions.text import group_sum
from cuelake.operators.evaluate import best_threshold, threshold_curve
from cuelake.plans.onerow import with_one_row
from cuelake.plans.ordered import CHUNK, INDEX_CHUNK, Scan, carry_scan, chunk_of, halo, own_rows

N_CONTEXT = 10

# ---------------------------------------------------------------------------
# splits and weights
# ---------------------------------------------------------------------------


def split_by_video(
    df: DataFrame, train: float = 0.70, val: float = 0.15, seed: str = "42"
) -> DataFrame:
    """Adds ``split``: all windows of a video go the same way, stable as data grows.

    The first 32 bits of an md5 are compared with the cut points, row by row; no
    shuffle, and adding videos never moves the others.
    """
    draw = F.substring(F.md5(F.concat(F.lit(seed), "video_id")), 1, 8)

    def cut(share: float) -> Column:
        return F.lit(f"{min(int(share * 2**32), 2**32 - 1):08x}")

    return df.withColumn(
        "split",
        F.when(draw < cut(train), "train").when(draw < cut(train + val), "val").otherwise("test"),
    )


def class_balance_weights(df: DataFrame, level: str = "window") -> DataFrame:
    """Adds ``balance_weight`` = 1 / class size; null if a class is empty.

    ``window``: classes are window labels.  ``video``: a video is positive if it has
    a positive window, and the weight counts videos.
    """
    if level == "window":
        flag, unit, out = F.col("label") == 1, df, df
    elif level == "video":
        flag = F.col("has_segment")
        videos = df.groupBy("video_id").agg(F.bool_or(F.col("label") == 1).alias("has_segment"))
        unit = videos
        out = videos
    else:
        raise ValueError(f"unknown level {level!r}")
    counts = unit.agg(F.count_if(flag).alias("_pos"), F.count_if(~flag).alias("_neg"))
    both = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    return with_one_row(out, counts).withColumn(
        "balance_weight",
        F.when(both, F.lit(1.0) / F.when(flag, F.col("_pos")).otherwise(F.col("_neg"))),
    ).drop("_pos", "_neg")


def balanced_resample(
    weighted: DataFrame, seed: int = 42, keys: Sequence[str] = ("video_id", "window_idx"),
) -> DataFrame:
    """Rows repeated so that classes are even in expectation and the size is kept.

    Sampling with replacement becomes an independent Poisson count per row, drawn from a
    hash of the row's keys: the same on every run and for every partitioning.
    """
    total = weighted.agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("balance_weight").cast("decimal(38,20)")).cast("double").alias("_w"),
    )
    named = F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    draw = (F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(2.0**32)
    rate = F.col("balance_weight") / F.col("_w") * F.col("_n")
    # Poisson by inversion of one uniform draw: k = number of cumulative terms passed.
    drawn = with_one_row(weighted, total).withColumn("_rate", rate).withColumn("_u", draw)
    # Terms up to far beyond the mean; the tail beyond has probability below 1e-12.
    steps = F.sequence(F.lit(1), (F.col("_rate") + 12 * F.sqrt(F.col("_rate")) + 20).cast("int"))
    start = F.struct(
        F.exp(-F.col("_rate")).alias("term"), F.exp(-F.col("_rate")).alias("cum"), F.lit(0).alias("k")
    )

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * F.col("_rate") / i
        more = acc["cum"] < F.col("_u")
        return F.struct(
            term.alias("term"), (acc["cum"] + term).alias("cum"),
            F.when(more, i).otherwise(acc["k"]).alias("k"),
        )

    copies = F.aggregate(steps, start, step, lambda acc: acc["k"])
    return (
        drawn.withColumn("_k", F.explode(F.array_repeat(F.lit(1), copies)))
        .drop("_k", "_rate", "_u", "_n", "_w")
    )


# ---------------------------------------------------------------------------
# sequences
# ---------------------------------------------------------------------------


def assign_batches(videos: DataFrame, batch_size: int, seed: str = "42") -> DataFrame:
    """Adds ``batch``: videos in pseudo-random order, ``batch_size`` at a time."""
    keyed = videos.withColumn("_all", F.lit(1)).withColumn(
        "_draw", F.md5(F.concat(F.lit(seed), "video_id"))
    )
    chunk = F.conv(F.substring("_draw", 1, 3), 16, 10).cast("bigint")
    ranked = carry_scan(keyed, ["_all"], ["_draw", "video_id"], chunk, [Scan("_rank", "rank")])
    return ranked.withColumn("batch", F.floor(F.col("_rank") / batch_size).cast("bigint")).drop(
        "_all", "_draw", "_rank"
    )


def padded_rows(windows: DataFrame, batch_size: int, vectors: Sequence[str] = ()) -> DataFrame:
    """Batches in long form: every video filled up to the longest one of its batch.

    Padding rows carry label -1, weight 0 and zero vectors.
    """
    lengths = windows.groupBy("video_id").agg(F.count(F.lit(1)).alias("length"))
    placed = assign_batches(lengths, batch_size)
    longest = placed.groupBy("batch").agg(F.max("length").alias("pad_to"))
    plan = placed.join(longest, "batch")
    real = windows.join(plan, "video_id")
    sizes = {v: windows.agg(F.max(F.size(v)).alias("_n")) for v in vectors}
    padding = plan.filter("length < pad_to").withColumn(
        "window_idx", F.explode(F.sequence(F.col("length"), F.col("pad_to") - 1))
    ).withColumn("window_idx", F.col("window_idx").cast("int")).withColumn("label", F.lit(-1)).withColumn("vote_weight", F.lit(0.0))
    for v, n in sizes.items():
        padding = with_one_row(padding, n).withColumn(
            v, F.array_repeat(F.lit(0.0), F.col("_n"))
        ).drop("_n")
    names = ["batch", "video_id", "length", "pad_to", "window_idx", "label", "vote_weight", *vectors]
    return real.select(*names).unionByName(padding.select(*names))


def assemble_sequences(
    windows: DataFrame, batch_size: int, vectors: Sequence[str] = (), block: int = INDEX_CHUNK
) -> DataFrame:
    """Padded label/weight/vector arrays per video, in blocks of at most ``block`` windows.

    A video shorter than a block is one row; longer ones continue in further rows,
    so no array grows with the data.
    """
    rows = padded_rows(windows, batch_size, vectors).withColumn(
        "block", chunk_of(F.col("window_idx"), block)
    )
    held = F.array_sort(F.collect_list(F.struct("window_idx", "label", "vote_weight", *vectors)))
    grouped = rows.groupBy("batch", "video_id", "block").agg(
        F.first("length").alias("length"), F.first("pad_to").alias("pad_to"), held.alias("_h")
    )
    return grouped.select(
        "batch", "video_id", "block", "length", "pad_to",
        # A field of an array of structs is the array of that field.
        F.col("_h.label").alias("labels"), F.col("_h.vote_weight").alias("weights"),
        *[F.col(f"_h.{v}").alias(v) for v in vectors],
    )


# ---------------------------------------------------------------------------
# teacher context
# ---------------------------------------------------------------------------


def attach_teacher_logit(windows: DataFrame, logits: DataFrame) -> DataFrame:
    """Adds ``teacher_logit``; where absent, +10 for a truthy label, else -10."""
    joined = windows.join(
        logits.withColumnRenamed("logit", "_logit"), ["video_id", "window_idx"], "left"
    )
    default = F.when(F.col("label") != 0, F.lit(10.0)).otherwise(F.lit(-10.0))
    return joined.withColumn("teacher_logit", F.coalesce("_logit", default)).drop("_logit")


def context_features(
    windows: DataFrame, k: int = N_CONTEXT, prob: str = "teacher_prob", newest_first: bool = True
) -> DataFrame:
    """Adds ``context``: the k preceding probabilities, 0.5 where there is none.

    Apply before rows are dropped: positions count every window.
    """
    spread = halo(windows, "window_idx", INDEX_CHUNK, before=k)
    w = Window.partitionBy("video_id", CHUNK).orderBy("window_idx")

    def back(i: int) -> Column:
        adjacent = F.lag("window_idx", i).over(w) == F.col("window_idx") - i
        return F.coalesce(F.when(adjacent, F.lag(prob, i).over(w)), F.lit(0.5))

    order = range(1, k + 1) if newest_first else range(k, 0, -1)
    return own_rows(spread.withColumn("context", F.array(*[back(i) for i in order])))


# ---------------------------------------------------------------------------
# fixed scorer and blending
# ---------------------------------------------------------------------------


def heuristic_score(vec: Column, mean_mfcc: Column) -> Column:
    """The hand-weighted scorer in closed form over group sums and audio means."""

    def sums(v: Column) -> Column:
        low, high = F.slice(v["m"], 1, 6), F.slice(v["m"], 7, 7)
        groups = [group_sum(v["k"], i).cast("double").alias(f"g{i}") for i in range(8)]
        return F.struct(*groups, array_sum(low).alias("low"), array_sum(high).alias("high"))

    def score(v: Column) -> Column:
        g = [v[f"g{i}"] for i in range(8)]
        intro = relu(g[0] * 0.8 + g[4] * 0.6 - 0.5)
        action = relu(g[1] * 0.65 + g[5] * 0.5 - 0.5)
        offer = relu(g[2] * 0.65 + g[6] * 0.5 - 0.5)
        product = relu(g[3] * 0.45 + g[7] * 0.35 - 0.8)
        audio = relu(v["low"] * 0.7 + v["high"] * 0.25 + g[0] * 0.15 - 0.8)
        z1 = relu(intro * 9.6 - 0.3)
        z2 = relu(action * 6.4 + offer * 6.4 - 1.1)
        z3 = relu(audio * 4.0 - 0.3)
        z4 = relu(audio * 2.8 + product * 1.2 - 1.5)
        return sigmoid(z1 * 8.0 + z2 * 6.4 + z3 * 3.6 + z4 * 5.2 - 1.6)

    return bound(bound(F.struct(vec.alias("k"), mean_mfcc.alias("m")), sums), score)


def blended_score(
    ticks: DataFrame, entry: float = 0.85, boost: float = 0.80, ml_weight: float = 0.75,
    audio_weight: float = 0.25,
) -> DataFrame:
    """Adds ``blended`` and ``enter_at`` (lower inside a pre-detected segment)."""
    return ticks.withColumn(
        "blended", F.col("ml") * ml_weight + F.col("anomaly") * audio_weight
    ).withColumn("enter_at", F.when(F.col("in_segment"), F.lit(entry * boost)).otherwise(F.lit(entry)))


# ---------------------------------------------------------------------------
# pluggable batch scoring
# ---------------------------------------------------------------------------

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Callable[[], Encoder]:
    """Default encoder factory: signed feature hashing of lower-cased words."""

    def load() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in enumerate(texts):
                for word in text.lower().split():
                    h = int.from_bytes(hashlib.md5(word.encode("utf-8")).digest()[:4], "big")
                    out[row, h % dim] += 1.0 if h & 0x80000000 else -1.0
            return out

        return encode

    return load


def score_windows(
    df: DataFrame, load: Callable[[], Encoder], dim: int, keys: Sequence[str] = ("video_id", "window_idx"),
    text: str = "text", batch: int = 32, out: str = "text_emb", blank: str = "[UNK]",
) -> DataFrame:
    """Run an encoder over window texts: loaded once per task, called in small batches.

    Blank texts are sent as ``blank``.  Where a call fails, its texts are tried one by one; a text
    that fails by itself gets a null vector and its error in ``<out>_error``, else null.
    """
    keys = list(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def attempt(encode: Encoder, some: list[str]) -> list[tuple[list | None, str | None]]:
        try:
            return [(v, None) for v in np.asarray(encode(some), np.float32).reshape(len(some), dim).tolist()]
        except Exception as error:
            if len(some) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
            return [x for one in some for x in attempt(encode, [one])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for pdf in batches:
            texts = pdf[text].fillna("")
            texts = texts.where(texts.str.strip() != "", blank).tolist()
            done = [x for at in range(0, len(texts), batch) for x in attempt(encode, texts[at:at + batch])]
            yield pdf[keys].assign(**{out: [v for v, _ in done], f"{out}_error": [e for _, e in done]})

    return df.select(*keys, text).mapInPandas(run, f"{schema}, `{out}` ARRAY<FLOAT>, `{out}_error` STRING")


# ---------------------------------------------------------------------------
# training on Spark ML
# ---------------------------------------------------------------------------


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    parts = [F.transform(f, lambda x: x.cast("double")) for f in features]
    return df.withColumn("_features", array_to_vector(F.concat(*parts)))


def _training_weights(df: DataFrame) -> DataFrame:
    """vote_weight x class weight, scaled so that the mean class weight is 1."""
    known = df.filter("label >= 0")
    balanced = class_balance_weights(known)
    half = known.agg((F.count(F.lit(1)) / 2).alias("_half"))
    return with_one_row(balanced, half).withColumn(
        "_w",
        F.coalesce(F.col("vote_weight"), F.lit(1.0))
        * F.coalesce(F.col("balance_weight") * F.col("_half"), F.lit(1.0)),
    )


def train_window_classifier(
    df: DataFrame, features: Sequence[str], reg: float = 0.01, elastic: float = 0.0, max_iter: int = 50, tol: float = 1e-6,
) -> LogisticRegressionModel:
    """Weighted logistic model on window features; ignored labels are left out."""
    data = _vectors(_training_weights(df), features)
    learner = LogisticRegression(
        featuresCol="_features", labelCol="label", weightCol="_w", regParam=reg,
        elasticNetParam=elastic, maxIter=max_iter, tol=tol,
    )
    return learner.fit(data.select("_features", F.col("label").cast("double").alias("label"), "_w"))


def apply_classifier(model: LogisticRegressionModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``logit`` and ``prob``."""
    scored = model.transform(_vectors(df, features))
    return (
        scored.withColumn("logit", vector_to_array("rawPrediction")[1])
        .withColumn("prob", vector_to_array("probability")[1])
        .drop("_features", "rawPrediction", "probability", "prediction")
    )


def tune_window_classifier(
    df: DataFrame, features: Sequence[str], grid: Sequence[tuple[float, float]]
) -> DataFrame:
    """Trials over (reg, elastic): train split fits, val split gives the best F1.

    Each fit runs on the whole cluster; only one number per trial comes back.
    """
    split = split_by_video(df)
    train, val = split.filter("split = 'train'"), split.filter("split = 'val'")
    rows = []
    for trial, (reg, elastic) in enumerate(grid):
        model = train_window_classifier(train, features, reg, elastic)
        best = best_threshold(threshold_curve(apply_classifier(model, val, features))).first()
        rows.append((trial, "COMPLETE", float(best["f1"]), {"reg": reg, "elastic": elastic}))
    return df.sparkSession.createDataFrame(
        rows, "trial INT, state STRING, val_f1 DOUBLE, params MAP<STRING,DOUBLE>"
    )


def distill(
    df: DataFrame, features: Sequence[str], temperature: float = 4.0, alpha: float = 0.7,
    reg: float = 0.01, max_iter: int = 50, tol: float = 1e-6,
) -> LogisticRegressionModel:
    """Fit on soft targets: each row counts as positive with weight q and negative with 1 - q."""
    soft = sigmoid(F.col("teacher_logit") / F.lit(temperature))
    q = soft * alpha + F.col("label").cast("double") * (1 - alpha)
    w = F.coalesce(F.col("vote_weight"), F.lit(1.0))
    data = _vectors(df.filter("label >= 0"), features).select(
        "_features",
        F.explode(F.array(
            F.struct(F.lit(1.0).alias("y"), (w * q).alias("w")),
            F.struct(F.lit(0.0).alias("y"), (w * (F.lit(1.0) - q)).alias("w")),
        )).alias("t"),
    ).select("_features", F.col("t.y").alias("label"), F.col("t.w").alias("_w"))
    learner = LogisticRegression(
        featuresCol="_features", labelCol="label", weightCol="_w", regParam=reg, maxIter=max_iter, tol=tol
    )
    return learner.fit(data)


def coefficients(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    """(term, value) of a fitted model in the session of ``df``: ``x0``, ``x1``, ... and ``intercept``."""
    rows = [(f"x{k}", float(v)) for k, v in enumerate(model.coefficients)] + [("intercept", float(model.intercept))]
    return df.sparkSession.createDataFrame(rows, "term STRING, value DOUBLE")
