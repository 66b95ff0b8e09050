"""Frame buffers, spectra, rolling baselines and anomaly scores (H operators)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuelake.functions.let import bound
from cuelake.functions.math import array_sum, chi_squared, cosine_distance
from cuelake.operators.windows import greedy_anchors
from cuelake.plans.ordered import CHUNK, INDEX_CHUNK, halo, own_rows

N_FRAMES = 30
N_COEFFS = 13
N_MEL = 26
SHORT_HISTORY = 5
LONG_HISTORY = 60


# ---------------------------------------------------------------------------
# frame buffers
# ---------------------------------------------------------------------------


def frames_for_windows(windows: DataFrame, frames: DataFrame, n: int = N_FRAMES) -> DataFrame:
    """(window, frame) pairs with the frame index in [floor(t) - n, floor(t)).

    Each window names the at most ``n`` frames it needs; the join is on equality.
    """
    upto = F.floor(F.col("t_start_ms") / 1000).cast("int")
    wanted = windows.withColumn("_upto", upto).filter("_upto > 0").withColumn(
        "frame_idx",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("_upto") - n), F.col("_upto") - 1)),
    )
    return wanted.join(frames, ["video_id", "frame_idx"]).drop("_upto")


def frame_buffer(windows: DataFrame, frames: DataFrame, n: int = N_FRAMES) -> DataFrame:
    """Adds ``buffer``: n frames of coefficients, newest last, zero frames in front."""
    pairs = frames_for_windows(windows, frames.select("video_id", "frame_idx", "coeffs"), n)
    held = pairs.groupBy("video_id", "window_idx").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("frame_idx", "coeffs"))), lambda x: x["coeffs"]
        ).alias("_held")
    )
    zero = F.array_repeat(F.lit(0.0), N_COEFFS)
    got = F.coalesce(F.col("_held"), F.array().cast("array<array<double>>"))
    return (
        windows.join(held, ["video_id", "window_idx"], "left")
        .withColumn("buffer", F.concat(F.array_repeat(zero, F.lit(n) - F.size(got)), got))
        .drop("_held")
    )


def mean_pool(buffer: Column, size: int = N_COEFFS) -> Column:
    """Mean over the frames of a buffer; zeros for an empty one."""
    zeros = F.array_repeat(F.lit(0.0), size)

    def pooled(frames: Column) -> Column:
        total = F.aggregate(
            frames, zeros, lambda acc, f: F.zip_with(acc, f, lambda a, b: a + b)
        )
        mean = F.transform(total, lambda x: x / F.size(frames))
        return F.when(F.size(frames) == 0, zeros).otherwise(mean)

    return bound(buffer, pooled)


def pad_trim(flat: Column, size: int = N_FRAMES * N_COEFFS) -> Column:
    """The newest ``size`` values, zero-padded in front."""

    def fitted(values: Column) -> Column:
        kept = F.slice(values, F.greatest(F.lit(1), F.size(values) - size + 1), size)
        missing = F.greatest(F.lit(0), F.lit(size) - F.size(values))
        return F.concat(F.array_repeat(F.lit(0.0), missing), kept)

    return bound(flat, fitted)


# ---------------------------------------------------------------------------
# spectra
# ---------------------------------------------------------------------------


def mel_filterbank(n_bins: int, sample_rate: float = 48_000.0, n_mel: int = N_MEL,
                   low_hz: float = 80.0, high_hz: float = 8000.0) -> list[tuple[int, int, float]]:
    """(filter, bin, weight) of triangular filters evenly spaced on the mel scale."""
    nyquist = sample_rate / 2
    to_mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    low, high = to_mel(low_hz), to_mel(min(high_hz, nyquist))
    edges = []
    for i in range(n_mel + 2):
        hz = 700 * (10 ** ((low + i / (n_mel + 1) * (high - low)) / 2595) - 1)
        edges.append(min(n_bins - 1, math.floor(hz / nyquist * n_bins)))
    weights = []
    for m in range(n_mel):
        lo, mid, hi = edges[m : m + 3]
        rising = [(m, k, (k - lo) / (mid - lo)) for k in range(lo, mid) if k > lo]
        falling = [(m, k, (hi - k) / (hi - mid)) for k in range(mid, hi)]
        weights += rising + falling
    return weights


def mfcc_from_spectrum(
    frames: DataFrame, n_bins: int, sample_rate: float = 48_000.0, n_coeffs: int = N_COEFFS
) -> DataFrame:
    """Adds ``mfcc``: dB spectrum -> power -> mel energies -> log -> DCT-II.

    Every frame is handled inside its row.  The filter weights and cosines are small
    constants of the plan (they depend only on the spectrum size), so there is no
    join and no shuffle.
    """
    by_filter: dict[int, list[tuple[int, float]]] = {m: [] for m in range(N_MEL)}
    for m, k, weight in mel_filterbank(n_bins, sample_rate):
        by_filter[m].append((k, weight))
    power = F.transform("spectrum", lambda db: F.pow(F.lit(10.0), db.cast("double") / 10))

    def log_energies(p: Column) -> Column:
        def energy(parts: list[tuple[int, float]]) -> Column:
            total = F.lit(0.0)
            for k, weight in parts:
                total = total + F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)) * F.lit(weight)
            return F.ln(F.greatest(total, F.lit(1e-10)))

        return F.array(*[energy(by_filter[m]) for m in range(N_MEL)])

    cosines = F.array(*[
        F.array(*[F.lit(math.cos(math.pi * n * (2 * m + 1) / (2 * N_MEL))) for m in range(N_MEL)])
        for n in range(n_coeffs)
    ])

    def cepstrum(mel: Column) -> Column:
        return F.transform(
            cosines, lambda row: array_sum(F.zip_with(mel, row, lambda e, c: e * c))
        )

    return frames.withColumn("mfcc", bound(bound(power, log_energies), cepstrum))


class DeltaHistory:
    """Baseline subtraction of one key: the last 60 deltas are the whole state."""

    def __init__(self, past: np.ndarray | None = None):
        self.deltas: list[np.ndarray] = [] if past is None else list(past)

    def step(self, raw: np.ndarray) -> np.ndarray:
        if len(self.deltas) < SHORT_HISTORY:
            delta = raw.copy()
        else:
            base = np.mean(self.deltas[: max(1, len(self.deltas) - 2)], axis=0)
            delta = (raw - base) / (np.abs(base) + 1.0)
        self.deltas.append(delta)
        if len(self.deltas) > LONG_HISTORY:
            self.deltas.pop(0)
        return delta

    def anomaly(self) -> float:
        if len(self.deltas) < 8:
            return 0.0
        now = np.mean(self.deltas[-SHORT_HISTORY:], axis=0)
        base = np.mean(self.deltas[:-SHORT_HISTORY], axis=0)
        norm = float(np.linalg.norm(now) * np.linalg.norm(base))
        if norm == 0:
            return 0.0
        return (1 - max(-1.0, min(1.0, float(now @ base) / norm))) / 2


DELTA_SCHEMA = "video_id STRING, frame_idx INT, delta ARRAY<DOUBLE>, anomaly DOUBLE"


def delta_mfcc(frames: DataFrame, coeffs: str = "coeffs") -> DataFrame:
    """Recursive baseline subtraction per video, with its anomaly score.

    Every delta depends on the sixty before it, so a video's frames have to be
    walked in order.  They are streamed through the task in sorted batches with a
    60-frame state; no video is ever held in memory as a group.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, history = None, DeltaHistory()
        for pdf in batches:
            deltas, scores = [], []
            for vid, raw in zip(pdf["video_id"], pdf["c"]):
                if vid != video:
                    video, history = vid, DeltaHistory()
                deltas.append(history.step(np.asarray(raw, dtype=np.float64)))
                scores.append(history.anomaly())
            yield pd.DataFrame({
                "video_id": pdf["video_id"], "frame_idx": pdf["frame_idx"],
                "delta": deltas, "anomaly": scores,
            })

    return (
        frames.select("video_id", "frame_idx", F.col(coeffs).alias("c"))
        .repartition("video_id").sortWithinPartitions("video_id", "frame_idx")
        .mapInPandas(walk, DELTA_SCHEMA)
    )


def anomaly_score(deltas: DataFrame, vector: str = "delta", size: int = N_COEFFS) -> DataFrame:
    """Cosine distance between the last five frames and the up to 55 before them.

    0 while fewer than eight frames are known.  ``frame_idx`` counts frames without
    gaps, so a halo of 59 frames makes each index chunk self-contained.
    """
    spread = halo(deltas, "frame_idx", INDEX_CHUNK, before=LONG_HISTORY - 1)
    w = Window.partitionBy("video_id", CHUNK).orderBy("frame_idx")
    recent = w.rowsBetween(-(SHORT_HISTORY - 1), Window.currentRow)
    older = w.rowsBetween(-(LONG_HISTORY - 1), -SHORT_HISTORY)
    now = F.array(*[F.avg(F.get(vector, F.lit(i))).over(recent) for i in range(size)])
    base = F.array(*[F.avg(F.get(vector, F.lit(i))).over(older) for i in range(size)])
    known = F.count(F.lit(1)).over(w.rowsBetween(-(LONG_HISTORY - 1), Window.currentRow))
    scored = own_rows(
        spread.withColumn("_now", now).withColumn("_base", base).withColumn("_known", known)
    )
    return scored.withColumn(
        "anomaly",
        F.when(F.col("_known") < 8, F.lit(0.0)).otherwise(cosine_distance(F.col("_now"), F.col("_base"))),
    ).drop("_now", "_base", "_known")


# ---------------------------------------------------------------------------
# colour and band profiles
# ---------------------------------------------------------------------------


def color_histogram(pixels: DataFrame, bins: int = 8) -> DataFrame:
    """Normalised per-channel histogram; ``pixels(video_id, frame_idx, r, g, b)``.

    The fixed 3 x bins counters aggregate on the map side; no per-pixel shuffle.
    """
    width = 256 // bins
    aggs = []
    for channel in ("r", "g", "b"):
        bin_of = F.least(F.floor(F.col(channel) / width), F.lit(bins - 1))
        aggs += [F.count_if(bin_of == i).alias(f"_{channel}{i}") for i in range(bins)]
    counted = pixels.groupBy("video_id", "frame_idx").agg(F.count(F.lit(1)).alias("n_pixels"), *aggs)
    names = [f"_{c}{i}" for c in ("r", "g", "b") for i in range(bins)]
    return counted.select(
        "video_id", "frame_idx", "n_pixels",
        F.array(*[F.col(n) / F.col("n_pixels") for n in names]).alias("hist"),
    )


def band_profile(frames: DataFrame, spectrum: str = "spectrum", low_end: int = 10) -> DataFrame:
    """Adds ``low``, ``high`` (band means) and ``ratio`` = low share of their sum."""
    values = F.col(spectrum)
    rest = F.greatest(F.size(values) - low_end, F.lit(1))
    low = array_sum(F.slice(values, 1, low_end)) / low_end
    high = array_sum(F.slice(values, low_end + 1, F.greatest(F.size(values) - low_end, F.lit(0)))) / rest
    out = frames.withColumn("low", low).withColumn("high", high)
    total = F.col("low") + F.col("high")
    return out.withColumn("ratio", F.when(total > 0, F.col("low") / total).otherwise(F.lit(0.5)))


def av_windows(samples: DataFrame, width_ms: int = 5000, bins: int = 24) -> DataFrame:
    """Greedy averages: a window closes with the first sample >= width after its start.

    That sample still counts for the closing window; the next one starts at its time.
    The last, unclosed window is not reported.
    """
    placed = greedy_anchors(samples, "time_ms", ["time_ms"], width_ms)
    # An opening sample belongs to the window before it, except the very first one.
    no_window = placed["before_ms"] < 0
    home = F.when(F.col("opens") & ~no_window, F.col("before_ms")).otherwise(F.col("anchor_ms"))
    grouped = placed.withColumn("_win", home).groupBy("video_id", "_win").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.max("time_ms").alias("_last"),
        *[F.avg(F.get("hist", F.lit(i))).alias(f"_h{i}") for i in range(bins)],
        F.avg("low").alias("low"), F.avg("high").alias("high"), F.avg("ratio").alias("ratio"),
    )
    return grouped.filter(F.col("_last") - F.col("_win") >= width_ms).select(
        "video_id", F.col("_win").alias("time_ms"), "n_samples",
        F.array(*[F.col(f"_h{i}") for i in range(bins)]).alias("hist"), "low", "high", "ratio",
    )


def av_baseline(windows: DataFrame, n: int = 12) -> DataFrame:
    """Adds ``base_*``: the upper median per value over up to ``n`` preceding windows."""
    spread = halo(windows, "win_idx", INDEX_CHUNK, before=n)
    w = Window.partitionBy("video_id", CHUNK).orderBy("win_idx").rowsBetween(-n, -1)
    held = F.collect_list(F.struct("hist", "low", "high", "ratio")).over(w)
    local = own_rows(spread.withColumn("_held", held))

    def upper_median(values: Column, empty: float) -> Column:
        return F.coalesce(
            F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int")), F.lit(empty)
        )

    past = F.col("_held")
    hist = F.transform(
        "hist",
        lambda v, i: upper_median(F.transform(past, lambda r: F.get(r["hist"], i)), 0.0),
    )
    out = local.withColumn("base_hist", hist)
    # A field of an array of structs is the array of that field.
    for name, empty in (("low", 0.0), ("high", 0.0), ("ratio", 0.5)):
        out = out.withColumn(f"base_{name}", upper_median(past[name], empty))
    return out.drop("_held")


def av_scores(
    baselined: DataFrame, visual_weight: float = 0.6, audio_weight: float = 0.4,
    threshold: float = 0.45, warmup: int = 6,
) -> DataFrame:
    """Adds ``visual``, ``audio``, ``combined`` and ``flagged`` against the baseline."""
    one = F.lit(1.0)
    visual = F.least(chi_squared(F.col("hist"), F.col("base_hist")) / 2, one)
    here, base = F.col("low") + F.col("high"), F.col("base_low") + F.col("base_high")
    energy = F.abs(here - base) / F.greatest(here, base, one)
    audio = F.least((F.abs(F.col("ratio") - F.col("base_ratio")) + energy) / 2, one)
    return (
        baselined.withColumn("visual", visual).withColumn("audio", audio)
        .withColumn("combined", F.col("visual") * visual_weight + F.col("audio") * audio_weight)
        .withColumn("flagged", (F.col("combined") >= threshold) & (F.col("win_idx") >= warmup))
    )
