"""Online state machines and their batch twins (S2-S6)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuelake.operators.intervals import first_match_pieces, point_in_segments
from cuelake.operators.signal import DeltaHistory
from cuelake.plans.ordered import ChunkFold, Scan, carry_scan, chunk_fold
from cuelake.plans.spans import BUCKET, level_width, over_levelled_buckets
from cuelake.session import materialize

MAX_COUNT = 10


# ---------------------------------------------------------------------------
# Keyed state on streams
# ---------------------------------------------------------------------------


class KeyFold:
    """What a stream computes per key, row after row in order of time.

    ``needs`` are the columns it is given (with their types), ``result`` what it returns; a key's state
    is a short list of tuples of plain values.
    """

    needs: dict[str, str]
    result: str

    def advance(self, rows: pd.DataFrame, state: list[tuple]) -> tuple[pd.DataFrame, list[tuple]]:
        """Results for ``rows``, and the state after them; the state of a new or ended key is empty."""
        raise NotImplementedError

    def advance_all(self, rows: pd.DataFrame, starts: np.ndarray, before: list[list[tuple]]) -> tuple[pd.DataFrame, list[list[tuple]]]:
        """The same for the rows of several keys, one key after the other; results carry ``video_id``."""
        outs, after = [], []
        for start, stop, state in zip(starts, [*starts[1:], len(rows)], before):
            out, state = self.advance(rows.iloc[start:stop].reset_index(drop=True), state)
            out.insert(0, "video_id", rows["video_id"].iat[start])
            outs.append(out)
            after.append(state)
        return pd.concat(outs, ignore_index=True), after


class InOrder(StatefulProcessor):
    """Runs a :class:`KeyFold` over each video's rows in order of event time, in whatever order they arrive.

    Videos are dealt into groups by hash, and a group is what the stream is keyed by: each call into
    Python and to the state store serves a group of videos, where a video's few rows would not pay for it.
    Rows wait in state, as the batches that brought them, in spans of ``wait_ms`` of event time.
    When the watermark has passed a span, its timer fires: the span's rows are sorted and folded, video by
    video.  So no more than one span of one group is ever held in memory.  The state of a video that
    had no row in the ``idle_ms`` after its last span is ended, at a second timer; a row that comes later
    starts afresh.  Timers fire in order of time, so results do not depend on micro-batches.
    """

    def __init__(self, fold: KeyFold, wait_ms: int, idle_ms: int):
        self.fold, self.wait_ms, self.idle_ms = fold, wait_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: By video, the end of its last span and its state, pickled.
        self.state = handle.getValueState("state", "held binary")
        self.batches = handle.getMapState("batches", "span_end long", "n long")
        self.rows = handle.getMapState("rows", "span_end long, batch long", "held binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["video_id", "at_us", *self.fold.needs]
        for batch in rows:
            ends = (batch["at_us"].to_numpy() // 1000 // self.wait_ms + 1) * self.wait_ms
            for end, part in batch[names].groupby(ends):
                end = int(end)
                found = self.batches.getValue((end,))
                n = found[0] if found else 0
                self.rows.updateValue((end, n), (packed(part),))
                self.batches.updateValue((end,), (n + 1,))
                if not n:
                    self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        found = self.batches.getValue((now,))
        if found:
            yield self._fold_span(now, found[0])
        else:
            held = self._held()
            if any(end + self.idle_ms <= now for end, _ in held.values()):
                self._hold(held, now)

    def _held(self) -> dict[str, tuple[int, list[tuple]]]:
        return pickle.loads(self.state.get()[0]) if self.state.exists() else {}

    def _hold(self, held: dict[str, tuple[int, list[tuple]]], now: int) -> None:
        live = {video: x for video, x in held.items() if x[0] + self.idle_ms > now}
        if live:
            self.state.update((pickle.dumps(live),))
        else:
            self.state.clear()

    def _fold_span(self, end: int, n: int) -> pd.DataFrame:
        parts = [unpacked(self.rows.getValue((end, k))[0]) for k in range(n)]
        order = ["video_id", "at_us", *list(self.fold.needs)[:1]]
        rows = pa.concat_tables(parts, promote_options="permissive").to_pandas().sort_values(order, ignore_index=True)
        videos = rows["video_id"].to_numpy(dtype=object)
        starts = np.flatnonzero(np.concatenate([[True], videos[1:] != videos[:-1]]))
        held = self._held()
        # A video whose last span is longer ago than ``idle_ms`` has ended, whether or not its timer has swept it yet.
        known = [held.get(video, (end, [])) for video in videos[starts]]
        out, after = self.fold.advance_all(rows, starts, [state if end <= last + self.idle_ms else [] for last, state in known])
        for video, state in zip(videos[starts], after):
            if state:
                held[video] = (end, state)
            else:
                held.pop(video, None)
        for k in range(n):
            self.rows.removeKey((end, k))
        self.batches.removeKey((end,))
        self._hold(held, end)
        if any(after):
            self.handle.registerTimer(end + self.idle_ms)
        return out

    def close(self) -> None:
        pass


def packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(held: bytes) -> pa.Table:
    return pa.ipc.open_stream(held).read_all()


#: Into how many groups a stream's videos are dealt, which is also how many tasks can share them.
GROUPS = 1024


def in_order(rows: DataFrame, fold: KeyFold, clock: str, late: str, wait_ms: int, idle_ms: int, groups: int = GROUPS) -> DataFrame:
    """``fold`` per ``video_id`` of a stream, by its event time ``clock``; rows behind the watermark are dropped.

    Rows of one time go by the first column the fold needs.  Results come when the watermark has passed.
    Start such a stream by :func:`online.run_append` or within :func:`session.rocks_state`.
    """
    group = F.pmod(F.xxhash64("video_id"), F.lit(groups)).cast("int")
    return (
        rows.withWatermark(clock, late)
        .select(group.alias("video_group"), "video_id", clock, F.unix_micros(clock).alias("at_us"),
                *[F.col(c).cast(kind).alias(c) for c, kind in fold.needs.items()])
        .groupBy("video_group")
        .transformWithStateInPandas(InOrder(fold, wait_ms, idle_ms), f"video_id STRING, {fold.result}", "append", "eventTime")
    )


#: How long rows may be late, how much of a key is folded at once, and when an idle key is forgotten.
LATE, WAIT_MS, IDLE_MS = "30 seconds", 60_000, 6 * 3_600_000


# ---------------------------------------------------------------------------
# S3: consecutive-frame hysteresis
# ---------------------------------------------------------------------------


N_STATES = 2 * (MAX_COUNT + 1)


class CounterFold(ChunkFold):
    """State code = 2 * count + inside: 22 states, so a tick is one of few 22-entry tables.

    Ticks are classified (above the entry threshold?, below the exit one?), each class
    is a transition table, and a chunk is the composition of its ticks' tables.
    """

    initial = [0]

    def __init__(self, exit_below: float, min_consec: int):
        self.exit_below = exit_below
        self.tables = np.array([
            [self._step(code, bool(kind & 2), bool(kind & 1), min_consec) for code in range(N_STATES)]
            for kind in range(4)
        ])

    @staticmethod
    def _step(code: int, above: bool, low: bool, min_consec: int) -> int:
        count, inside = divmod(code, 2)
        count = min(count + 1, MAX_COUNT) if above else max(0, count - 1)
        if count >= min_consec:
            inside = 1
        elif low and count == 0:
            inside = 0
        return 2 * count + inside

    def _kinds(self, rows: pd.DataFrame) -> np.ndarray:
        score = rows["score"].to_numpy()
        above, low = score >= rows["enter_at"].to_numpy(), score < self.exit_below
        return 2 * above.astype(np.int64) + low.astype(np.int64)

    def summarize(self, rows: pd.DataFrame) -> list[int]:
        maps = self.tables[self._kinds(rows)]
        while len(maps) > 1:  # compose neighbours pairwise, in order
            odd = maps[-1:] if len(maps) % 2 else maps[:0]
            first, second = maps[0 : len(maps) - len(odd) : 2], maps[1 : len(maps) : 2]
            maps = np.concatenate([np.take_along_axis(second, first, axis=1), odd])
        return [int(v) for v in maps[0]]

    def advance(self, state: list[int], summary: list[int]) -> list[int]:
        return [summary[state[0]]]

    def replay(self, rows: pd.DataFrame, state: list[int]) -> pd.DataFrame:
        codes, _ = self.codes(rows, [0], state)
        return rows.assign(consecutive=codes // 2, inside=codes % 2 == 1)

    def codes(self, rows: pd.DataFrame, starts: list[int], before: list[int]) -> tuple[np.ndarray, list[int]]:
        """The code after each tick of keys that follow one another from ``starts`` on, and each key's last."""
        tables, kinds, codes, after = self.tables.tolist(), self._kinds(rows).tolist(), [], []
        for start, stop, code in zip(starts, [*starts[1:], len(kinds)], before):
            for kind in kinds[start:stop]:
                code = tables[kind][code]
                codes.append(code)
            after.append(code)
        return np.array(codes, dtype=np.int32), after


COUNTER_COLUMNS = T.StructType([
    T.StructField("consecutive", T.IntegerType()), T.StructField("inside", T.BooleanType()),
])


def hysteresis_segments(
    ticks: DataFrame, order: list[str], chunk: Column, exit_below: float = 0.50, min_consec: int = 2
) -> DataFrame:
    """Batch twin: adds ``consecutive`` and ``inside`` per tick.

    ``ticks`` carries ``score`` and ``enter_at``.  Ticks of one video are split into
    chunks; each chunk is tabulated for all 22 states, the tables are chained.
    """
    return chunk_fold(
        ticks, ["video_id"], order, chunk, CounterFold(exit_below, min_consec),
        ["score", "enter_at"], COUNTER_COLUMNS,
    )


class Hysteresis(KeyFold):
    needs = {"event_id": "long", "score": "double", "enter_at": "double"}
    result = "event_id LONG, score DOUBLE, consecutive INT, inside BOOLEAN"

    def __init__(self, exit_below: float, min_consec: int):
        self.fold = CounterFold(exit_below, min_consec)

    def advance_all(self, rows: pd.DataFrame, starts: np.ndarray, before: list[list[tuple]]) -> tuple[pd.DataFrame, list[list[tuple]]]:
        codes, after = self.fold.codes(rows, starts.tolist(), [state[0][0] if state else 0 for state in before])
        out = rows[["video_id", "event_id", "score"]].assign(consecutive=codes // 2, inside=codes % 2 == 1)
        return out, [[(code,)] for code in after]


def stream_hysteresis(
    ticks: DataFrame, exit_below: float = 0.50, min_consec: int = 2, late: str = LATE, wait_ms: int = WAIT_MS, idle_ms: int = IDLE_MS,
) -> DataFrame:
    """Streaming S3: (video_id, ts, event_id, score, enter_at) in, counter and flag out."""
    return in_order(ticks, Hysteresis(exit_below, min_consec), "ts", late, wait_ms, idle_ms)


# ---------------------------------------------------------------------------
# S2: recursive deltas
# ---------------------------------------------------------------------------


class Deltas(KeyFold):
    """The state is the ring of the last 60 deltas."""

    needs = {"frame_idx": "int", "coeffs": "array<double>"}
    result = "frame_idx INT, delta ARRAY<DOUBLE>, anomaly DOUBLE"

    def advance(self, rows: pd.DataFrame, state: list[tuple]) -> tuple[pd.DataFrame, list[tuple]]:
        history = DeltaHistory(np.array([d for d, in state], dtype=np.float64) if state else None)
        deltas, scores = [], []
        for raw in rows["coeffs"]:
            deltas.append(history.step(np.asarray(raw, dtype=np.float64)))
            scores.append(history.anomaly())
        out = pd.DataFrame({"frame_idx": rows["frame_idx"], "delta": deltas, "anomaly": scores})
        return out, [(d.tolist(),) for d in history.deltas]


def stream_delta_mfcc(frames: DataFrame, clock: str = "captured_at", late: str = LATE, wait_ms: int = WAIT_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """Streaming twin of ``delta_mfcc``: (video_id, frame_idx, coeffs) with the time of capture, which orders the frames."""
    return in_order(frames, Deltas(), clock, late, wait_ms, idle_ms)


# ---------------------------------------------------------------------------
# S4: two-level hysteresis
# ---------------------------------------------------------------------------


def hysteresis_two_level(
    ticks: DataFrame, order: list[str], chunk: Column, high: float = 0.45, low: float = 0.315
) -> DataFrame:
    """Batch twin: the last decisive score (enter or exit) so far decides."""
    mark = F.when(F.col("score") >= high, 1).when(F.col("score") < low, 0)
    scanned = carry_scan(ticks, ["video_id"], order, chunk, [Scan("_mark", "last", mark)])
    return scanned.withColumn("inside", F.coalesce(F.col("_mark"), F.lit(0)) == 1).drop("_mark")


class TwoLevel(KeyFold):
    needs = {"event_id": "long", "score": "double"}
    result = "event_id LONG, score DOUBLE, inside BOOLEAN"

    def __init__(self, high: float, low: float):
        self.high, self.low = high, low

    def advance(self, rows: pd.DataFrame, state: list[tuple]) -> tuple[pd.DataFrame, list[tuple]]:
        score = rows["score"].to_numpy()
        mark = np.where(score >= self.high, 1.0, np.where(score < self.low, 0.0, np.nan))
        inside = pd.Series(np.concatenate([[float(state[0][0]) if state else 0.0], mark])).ffill().to_numpy()[1:]
        return rows[["event_id", "score"]].assign(inside=inside == 1), [(int(inside[-1]),)]


def stream_hysteresis_two_level(
    ticks: DataFrame, high: float = 0.45, low: float = 0.315, late: str = LATE, wait_ms: int = WAIT_MS, idle_ms: int = IDLE_MS,
) -> DataFrame:
    return in_order(ticks, TwoLevel(high, low), "ts", late, wait_ms, idle_ms)


# ---------------------------------------------------------------------------
# S5: membership and its transitions
# ---------------------------------------------------------------------------


def segment_transitions(
    ticks: DataFrame, segments: DataFrame, order: list[str], chunk: Column
) -> DataFrame:
    """Batch twin: ticks at which playback enters or leaves a segment."""
    flagged = point_in_segments(ticks, segments)
    seen = carry_scan(
        flagged, ["video_id"], order, chunk, [Scan("_was", "prev", F.col("in_segment"))]
    )
    was = F.coalesce(F.col("_was"), F.lit(False))
    return seen.filter(F.col("in_segment") != was).withColumn(
        "change", F.when(F.col("in_segment"), "enter").otherwise("exit")
    ).drop("_was")


def stream_segment_membership(ticks: DataFrame, segments: DataFrame) -> DataFrame:
    """Stream-static join of ticks with the static first-match pieces (equi on buckets).

    The stream has no last tick to cut the pieces at, so long pieces go to coarser
    bucket levels; a tick is looked up on the levels in use (seven at most, usually
    one), which are asked for once when the stream is set up.
    """
    width = 10_000
    # Asked for levels, then read by each of them in each micro-batch: worked out once.
    pieces = materialize(over_levelled_buckets(
        first_match_pieces(segments), F.col("piece_ms"), F.col("seg_end_ms"), width
    ).withColumnsRenamed({"video_id": "_vid", BUCKET: "_pb", "_level": "_pl"}), "pieces")
    levels = sorted(r[0] for r in pieces.select("_pl").distinct().collect())
    found, ends = ticks, []
    for level in levels:
        side = pieces.filter(F.col("_pl") == level).select(
            "_vid", "_pb", "piece_ms", F.col("seg_end_ms").alias(f"_end{level}")
        )
        here = F.floor(F.col("t_ms") / level_width(F.lit(level), width)).cast("bigint")
        cond = (
            (F.col("video_id") == F.col("_vid")) & (here == F.col("_pb"))
            & (F.col("t_ms") >= F.col("piece_ms")) & (F.col("t_ms") <= F.col(f"_end{level}"))
        )
        found = found.join(side, cond, "left").drop("_vid", "_pb", "piece_ms")
        ends.append(F.col(f"_end{level}"))
    # Pieces are disjoint, so a tick matches on one level at most.
    end = F.coalesce(*ends) if ends else F.lit(None).cast("bigint")
    return found.select(
        *ticks.columns, end.isNotNull().alias("in_segment"), end.alias("seg_end_ms")
    )


# ---------------------------------------------------------------------------
# S6: counter since the last reset
# ---------------------------------------------------------------------------


def count_since_reset(
    events: DataFrame, order: list[str], chunk: Column, counted: Column, reset: Column
) -> DataFrame:
    """Batch twin: running count of ``counted`` rows since the last ``reset`` row.

    The count at the last reset is subtracted from the running count, so no group
    per reset is formed.
    """
    hits = F.when(counted & ~reset, 1).otherwise(0).cast("bigint")
    total = carry_scan(events, ["video_id"], order, chunk, [Scan("_total", "sum", hits)])
    at_reset = carry_scan(
        total, ["video_id"], order, chunk,
        [Scan("_base", "last", F.when(reset, F.col("_total")))],
    )
    return at_reset.withColumn(
        "since_reset", F.col("_total") - F.coalesce(F.col("_base"), F.lit(0))
    ).drop("_total", "_base")


class SinceReset(KeyFold):
    needs = {"event_id": "long", "event_type": "string"}
    result = "event_id LONG, since_reset LONG"

    def __init__(self, counted: str, resets: list[str], ends: list[str]):
        self.counted, self.resets, self.ends = counted, [*resets, *ends], ends

    def advance(self, rows: pd.DataFrame, state: list[tuple]) -> tuple[pd.DataFrame, list[tuple]]:
        kind = rows["event_type"]
        hits = (kind == self.counted).to_numpy().astype(np.int64)
        hits[kind.isin(self.resets).to_numpy()] = 0
        total = np.cumsum(hits) + (int(state[0][0]) if state else 0)
        # What had been counted at the last reset; before the first, nothing is taken off.
        counts = total - np.maximum.accumulate(np.where(kind.isin(self.resets), total, 0))
        ended = kind.iloc[-1] in self.ends
        return rows[["event_id"]].assign(since_reset=counts), [] if ended else [(int(counts[-1]),)]


def stream_count_since_reset(
    events: DataFrame, counted: str, resets: list[str], ends: list[str] = (), late: str = LATE, wait_ms: int = WAIT_MS, idle_ms: int = IDLE_MS,
) -> DataFrame:
    """Streaming S6.  An event of ``ends`` counts as a reset, and ends the key's state if no other event follows it."""
    return in_order(events, SinceReset(counted, resets, list(ends)), "ts", late, wait_ms, idle_ms)
