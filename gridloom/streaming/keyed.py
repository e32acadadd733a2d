"""Streams with state per meter: rolling anomalies and threshold alerts.

State lives in Spark's state store (RocksDB, so it may exceed memory), is kept
per meter and is bounded: the newest readings that a verdict needs, readings that
still wait for the watermark, or one open alert. Nothing kept is read again from
files, and a restart goes on from the checkpoint.

Readings are judged in event-time order once the watermark has passed them, so
the result is the same for any cut of the input into micro-batches, as long as
no reading is later than the delay; later ones are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DataType

from gridloom.operators.anomaly import HISTORY_RANGE, MAD_SCALE, check_settings

_STORE = "spark.sql.streaming.stateStore"
#: The store that state with timers needs; commits write changes instead of whole tables, and a store of little state reserves no space.
SETTINGS = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
}
#: Values of the windows that are judged at once.
WINDOW_VALUES = 1 << 22


def use_keyed_state(spark: SparkSession) -> None:
    """Settings of the session for streams with keyed state."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)


def _named(key: str) -> Column:
    """The key as a text that is never null, as null numbers don't compare equal in a task."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def _key_of(kind: DataType) -> Column:
    return F.when(F.col("g_key") != "", F.substr("g_key", F.lit(2))).cast(kind)


def rolling_scores(values: np.ndarray, known: int, records: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median, scaled median deviation and size of the newest ``records`` values at each place from ``known`` on.

    The window of a place ends with that place.
    """
    n = len(values) - known
    centers, scales, sizes = np.empty(n), np.empty(n), np.minimum(np.arange(known, known + n) + 1, records)
    short = int((sizes < records).sum())
    for i in range(short):
        part = values[: known + i + 1]
        centers[i] = np.median(part)
        scales[i] = np.median(np.abs(part - centers[i]))
    step = max(1, WINDOW_VALUES // records)
    for i in range(short, n, step):
        upto = min(n, i + step)
        first = known + i + 1 - records
        windows = np.lib.stride_tricks.sliding_window_view(values[first : known + upto], records)
        centers[i:upto] = np.median(windows, axis=1)
        scales[i:upto] = np.median(np.abs(windows - centers[i:upto, None]), axis=1)
    return centers, scales * MAD_SCALE, sizes


class _RollingAnomalies(StatefulProcessor):
    """Newest readings and waiting readings of one meter; a timer for each of the two."""

    def __init__(self, records: int, idle_us: int, threshold: float):
        self.records, self.idle_us, self.threshold = records, idle_us, threshold

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("meter", "times array<bigint>, values array<double>, waiting_times array<bigint>, waiting_values array<double>")

    def _load(self) -> list[np.ndarray]:
        row = self.state.get() if self.state.exists() else ([], [], [], [])
        return [np.array(row[i], np.int64 if i % 2 == 0 else float) for i in range(4)]

    def _advance(self, key: tuple, arrived: list[pd.DataFrame], watermark_ms: int) -> Iterator[pd.DataFrame]:
        times, values, waiting_times, waiting_values = self._load()
        waiting_times = np.concatenate([waiting_times, *[a["g_us"].to_numpy(np.int64) for a in arrived]])
        waiting_values = np.concatenate([waiting_values, *[a["g_value"].to_numpy(float) for a in arrived]])
        order = np.lexsort((waiting_values, waiting_times))
        waiting_times, waiting_values = waiting_times[order], waiting_values[order]
        ready = int(np.searchsorted(waiting_times, watermark_ms * 1000, "left"))
        new_times, new_values = waiting_times[:ready], waiting_values[:ready]
        waiting_times, waiting_values = waiting_times[ready:], waiting_values[ready:]
        while len(new_times):
            # a long silence starts the meter's history anew
            after = np.diff(np.concatenate([times[-1:] if len(times) else new_times[:1], new_times])) > self.idle_us
            cut = int(after.argmax()) if after.any() else len(new_times)
            if cut == 0:
                times, values = times[:0], values[:0]
                after[0] = False
                cut = int(after.argmax()) if after.any() else len(new_times)
            series = np.concatenate([values, new_values[:cut]])
            centers, scales, sizes = rolling_scores(series, len(values), self.records)
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = np.abs(new_values[:cut] - centers) / scales
            hit = (scales > 0) & (sizes >= HISTORY_RANGE[0]) & (scores >= self.threshold)
            picked = np.flatnonzero(hit)
            if len(picked):
                yield pd.DataFrame({"g_key": [key[0]] * len(picked), "g_us": new_times[picked], "g_actual": new_values[picked], "g_expected": centers[picked], "g_score": scores[picked]})
            times = np.concatenate([times, new_times[:cut]])[-self.records :]
            values = series[-self.records :]
            new_times, new_values = new_times[cut:], new_values[cut:]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(times) and not len(waiting_times) and times[-1] + self.idle_us < watermark_ms * 1000:
            self.state.clear()  # idle for so long that the next reading starts anew
            return
        self.state.update((times.tolist(), values.tolist(), waiting_times.tolist(), waiting_values.tolist()))
        if len(waiting_times):
            self.handle.registerTimer(int(waiting_times[0]) // 1000 + 1)  # a timer of the watermark's own time has fired
        elif len(times):
            self.handle.registerTimer((int(times[-1]) + self.idle_us) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        yield from self._advance(key, list(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def rolling_anomalies(
    source: DataFrame, key: str, ts: str, value: str, records: int = 100, idle_seconds: int = 30 * 86400, threshold: float = 3.5, delay: str = "1 hour"
) -> DataFrame:
    """Anomalies of a stream: each reading against the newest ``records`` of its meter up to itself.

    A reading is judged when the watermark has passed it. A silence of more than
    ``idle_seconds`` starts a meter's history anew, and a timer drops the state
    of a meter that stays silent. Readings without time or value are left out;
    a null meter is a meter of its own. Fewer than three readings or no spread
    report nothing; of equal times the smaller value comes first. A task holds
    one meter's readings of one micro-batch, which the source's rate bounds.
    """
    check_settings(threshold, records)
    use_keyed_state(source.sparkSession)
    kind = source.schema[key].dataType
    slim = source.where(F.col(ts).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    slim = slim.select(_named(key).alias("g_key"), F.col(ts).alias("g_ts"), F.unix_micros(F.col(ts)).alias("g_us"), F.col(value).cast("double").alias("g_value"))
    processor = _RollingAnomalies(records, idle_seconds * 1_000_000, threshold)
    found = slim.withWatermark("g_ts", delay).groupBy("g_key").transformWithStateInPandas(
        processor, "g_key string, g_us long, g_actual double, g_expected double, g_score double", "append", "eventTime"
    )
    center, actual = F.col("g_expected"), F.col("g_actual")
    deviation = F.when(center == 0, 0.0).otherwise((actual - center) / F.abs(F.nullif(center, F.lit(0.0))) * 100)
    return found.select(
        _key_of(kind).alias(key),
        F.timestamp_micros("g_us").alias(ts),
        F.when(actual > center, "spike").otherwise("drop").alias("anomaly_type"),
        F.when(F.col("g_score") >= threshold * 1.5, "high").otherwise("medium").alias("severity"),
        actual.alias("actual_kwh"),
        center.alias("expected_kwh"),
        deviation.alias("deviation_pct"),
        F.col("g_score").alias("score"),
    )


class _Alerts(StatefulProcessor):
    """The open alert of one meter, if any."""

    def __init__(self, enter: float, leave: float):
        self.enter, self.leave = enter, leave

    def init(self, handle) -> None:
        self.state = handle.getValueState("alert", "opened bigint, peak double, windows bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        frame = pd.concat(frames).sort_values("g_us")
        opened, peak, windows = self.state.get() if self.state.exists() else (None, None, None)
        was_open, out = opened is not None, []
        for us, level in zip(frame["g_us"].tolist(), frame["g_level"].tolist()):
            if opened is None and level >= self.enter:
                opened, peak, windows = us, level, 1
                out.append((key[0], "opened", us, us, level, 1))
            elif opened is not None and level < self.leave:
                out.append((key[0], "cleared", opened, us, peak, windows))
                opened = None
            elif opened is not None:
                peak, windows = max(peak, level), windows + 1
        if opened is not None:
            self.state.update((opened, peak, windows))
        elif was_open:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=["g_key", "event", "g_opened", "g_at", "peak", "windows"])

    def close(self) -> None:
        pass


def threshold_alerts(
    source: DataFrame, key: str, ts: str, value: str, enter: float, leave: float, width: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour"
) -> DataFrame:
    """Alerts on the mean of sliding windows: one ``opened`` and one ``cleared`` row per excursion.

    A window whose mean reaches ``enter`` opens an alert; it stays open, without
    further rows, until a window falls below ``leave`` (not above ``enter``), which
    arms the meter again. Windows are judged in the order of their ends when the
    watermark closes them; windows without readings change nothing. The mean is
    combined before it moves, so a busy meter sends one row per task and window.
    ``peak`` and ``windows`` cover the excursion up to the row. Readings without
    time or value are left out; a null meter is a meter of its own.
    """
    if leave > enter:
        raise ValueError("an alert must clear at or below the level at which it opens")
    use_keyed_state(source.sparkSession)
    kind = source.schema[key].dataType
    slim = source.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(_named(key).alias("g_key"), F.col(ts).alias("g_ts"), F.col(value).cast("double").alias("g_value"))
    levels = slim.withWatermark("g_ts", delay).groupBy("g_key", F.window("g_ts", width, slide).alias("g_window")).agg(F.avg("g_value").alias("g_level"))
    ends = levels.select("g_key", F.window_time("g_window").alias("g_ts"), F.unix_micros(F.col("g_window.end")).alias("g_us"), "g_level")
    found = ends.groupBy("g_key").transformWithStateInPandas(
        _Alerts(enter, leave), "g_key string, event string, g_opened long, g_at long, peak double, windows long", "append", "none"
    )
    return found.select(
        _key_of(kind).alias(key), "event", F.timestamp_micros("g_opened").alias("opened_at"), F.timestamp_micros("g_at").alias("noticed_at"), "peak", "windows"
    )


def prediction_outcomes(
    predictions: DataFrame,
    actuals: DataFrame,
    key: str,
    ts: str,
    predicted: str,
    actual: str,
    prediction_delay: str = "1 hour",
    actual_delay: str = "2 hours",
) -> DataFrame:
    """Every prediction of a stream with the reading it was made for, as that arrives.

    A prediction and a reading meet on the meter and the time predicted. A
    prediction whose reading does not come within the delays is emitted with a
    null ``actual``; a reading that comes later is dropped. A reading sent twice
    counts once, the first time; its copies are known for as long as the
    watermark needs. Readings nobody predicted are left out, and so are rows
    without time. Both sides keep only what the watermarks still allow to meet.
    """
    left = predictions.where(F.col(ts).isNotNull()).select(F.col(key).alias("p_key"), F.col(ts).alias("p_ts"), F.col(predicted).cast("double").alias("p_value"))
    right = actuals.where(F.col(ts).isNotNull()).select(F.col(key).alias("a_key"), F.col(ts).alias("a_ts"), F.col(actual).cast("double").alias("a_value"))
    right = right.withWatermark("a_ts", actual_delay).dropDuplicatesWithinWatermark(["a_key", "a_ts"])
    met = left.withWatermark("p_ts", prediction_delay).join(right, (F.col("p_key") == F.col("a_key")) & (F.col("p_ts") == F.col("a_ts")), "leftOuter")
    error = F.col("p_value") - F.col("a_value")
    return met.select(
        F.col("p_key").alias(key),
        F.col("p_ts").alias(ts),
        F.col("p_value").alias("predicted"),
        F.col("a_value").alias("actual"),
        error.alias("error"),
        F.abs(error).alias("absolute_error"),
    )


def accuracy(outcomes: DataFrame, key: str) -> DataFrame:
    """Per meter: predictions, how many met a reading, and the mean errors of those."""
    return outcomes.groupBy(key).agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count("actual").alias("met"),
        F.avg("error").alias("bias"),
        F.avg("absolute_error").alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
    )
