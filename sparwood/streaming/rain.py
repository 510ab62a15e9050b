"""Rain features over a stream of slots (px, ts, rate): the same results as in batch, as far as a stream can know them.

Late slots are taken up to the watermark; the default is the window's 14 days, so nothing inside it is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import priors as P
from ..functions import scoring as S


def read_slots(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """New files of a folder as they arrive; those seen are remembered by the query's checkpoint."""
    return spark.readStream.schema("px bigint, ts timestamp, rate double").option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def events(slots: DataFrame, late: str = "14 days") -> DataFrame:
    """Rain events as session windows of wet slots; a gap of exactly the dry gap goes on."""
    wet = slots.where("rate > 0").withWatermark("ts", late)
    e = wet.groupBy("px", F.session_window("ts", f"{P.DRY_GAP_HOURS} hours").alias("w")).agg((F.sum("rate") * P.SLOT_HOURS).alias("event_mm"), F.max("ts").alias("ended"), F.count("*").alias("slots"))
    return e.select("px", F.col("w.start").alias("began"), "ended", "slots", "event_mm")


def quarter_hours(slots: DataFrame, late: str = "14 days") -> DataFrame:
    """Valid slots and rain per quarter of an hour."""
    w = slots.withWatermark("ts", late).groupBy("px", F.window("ts", "15 minutes").alias("w"))
    return w.agg(F.count("rate").alias("valid"), (F.coalesce(F.sum("rate"), F.lit(0.0)) * P.SLOT_HOURS).alias("mm")).select("px", F.col("w.start").alias("ts"), "valid", "mm")


def sliding_day(slots: DataFrame, late: str = "14 days") -> DataFrame:
    """Rain of every 24 hours that begin at a quarter of an hour."""
    w = slots.withWatermark("ts", late).groupBy("px", F.window("ts", "24 hours", "15 minutes").alias("w"))
    return w.agg((F.coalesce(F.sum("rate"), F.lit(0.0)) * P.SLOT_HOURS).alias("day_mm")).select("px", F.col("w.start").alias("ts"), "day_mm")


_NAMES = ["rain_3d_mm", "rain_7d_mm", "rain_14d_mm", "coverage_3d", "coverage_7d", "coverage_14d", "wet_hours_72h", "hours_since_any_rain",
          "hours_since_significant_rain", "last_significant_mm", "hours_since_strong_rain", "last_strong_mm", "max_24h_rain_14d"]
_STATE, _DAY = "ts array<bigint>, rate array<double>", 86_400_000_000


def features(ts: np.ndarray, rate: np.ndarray, now: int, expected: dict[int, int]) -> list[float | None]:
    """What the batch's features say of one pixel's slots (microseconds in order, NaN: invalid) of the 14 days before now."""
    mm = np.where(np.isnan(rate), 0.0, rate) * P.SLOT_HOURS
    since = {d: ts >= now - d * _DAY for d in expected}
    hours = lambda t: (now - t) / (_DAY / 24)
    out: list = [float(mm[w].sum()) for w in since.values()] + [min(1.0, float((~np.isnan(rate[w])).sum() / expected[d])) for d, w in since.items()]
    wet = np.flatnonzero(rate > 0)
    out += [float((since[3][wet]).sum() * P.SLOT_HOURS), hours(int(ts[wet[-1]])) if len(wet) else None]
    first = np.r_[True, np.diff(ts[wet]) > P.DRY_GAP_HOURS * _DAY / 24][: len(wet)]
    event = np.cumsum(first) - 1
    total = np.bincount(event, rate[wet], minlength=0) * P.SLOT_HOURS if len(wet) else np.empty(0)
    ended = ts[wet][np.r_[first[1:], True][: len(wet)]]
    for least in (P.SIGNIFICANT_MM, P.STRONG_MM):
        big = np.flatnonzero(total >= least)
        out += [hours(int(ended[big[-1]])), float(total[big[-1]])] if len(big) else [None, 0.0]
    so_far = np.r_[0.0, np.cumsum(mm)]
    return out + [max(0.0, float((so_far[1:] - so_far[np.searchsorted(ts, ts - _DAY)]).max(initial=0.0)))]


def running(slots: DataFrame, expected: dict[int, int] | None = None, days: int = 14) -> DataFrame:
    """All rain features of a pixel, anew with every batch that brings slots of it: px, as_of (the newest slot's end) and the features.

    The state is the pixel's slots of the last days, whatever the order they came in: a late one takes its place, one that comes
    again replaces the first, so results are those of the batch over the same slots. What comes later than the days behind the
    newest slot of all is dropped, as it lies outside the window by then. Slots older than the days leave the state,
    and a pixel of which nothing newer has come when the watermark is days past its newest slot leaves it whole.
    """
    expected = expected or P.SLOTS

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        new = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        ts, rate = (np.asarray(x, t) for x, t in zip(state.get, (np.int64, float))) if state.exists else (np.empty(0, np.int64), np.empty(0))
        ts, rate = np.r_[ts, new], np.r_[rate, rows["rate"].to_numpy(float)]
        order = np.argsort(ts, kind="stable")
        ts, rate = ts[order], rate[order]
        last = np.r_[ts[1:] != ts[:-1], True]
        ts, rate = ts[last], rate[last]
        now = int(ts[-1]) + int(P.SLOT_HOURS * _DAY / 24)
        kept = ts >= now - days * _DAY
        ts, rate = ts[kept], rate[kept]
        state.update((ts.tolist(), rate.tolist()))
        state.setTimeoutTimestamp(max(int(ts[-1]) // 1000 + days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([[key[0], pd.Timestamp(now, unit="us"), *features(ts, rate, now, expected)]], columns=["px", "as_of", *_NAMES])

    schema = "px bigint, as_of timestamp, " + ", ".join(f"{n} double" for n in _NAMES)
    return slots.withWatermark("ts", f"{days} days").groupBy("px").applyInPandasWithState(fold, schema, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def gated(f: DataFrame, met_age_hours: Column, met_coverage: Column) -> DataFrame:
    """Running features with the gates of the batch: what a window covers too little is null, and quality says which are."""
    cov = {d: F.col(f"coverage_{d}d") for d in (3, 7, 14)}
    of = lambda n: 3 if n in ("rain_3d_mm", "wet_hours_72h") else 7 if n == "rain_7d_mm" else 14
    values = {n: S.if_covered(F.col(n), cov[of(n)]) for n in _NAMES if not n.startswith("coverage")}
    return f.withColumns({"quality": S.data_quality(cov, met_age_hours, met_coverage), **values})
