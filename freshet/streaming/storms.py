"""Storms of a stream with their numbers and dry spells, and samples of a stream with their storms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from freshet import workers
from freshet.functions.volumes import LITERS_PER_CUBICMETER
from freshet.operators.storms import is_wet, with_flow_columns

_STORM = (
    "site string, storm_number int, start_date timestamp, end_date timestamp, duration_hours double, antecedent_days double, "
    "total_precip_depth double, peak_precip_intensity double, total_outflow_m3 double, peak_outflow double"
)
#: Bins that may still get earlier ones, the running storm, and what the next one needs to know of the last.
_STATE = (
    "times array<long>, rains array<double>, flows array<double>, "
    "number int, start long, last long, rain double, peak_rain double, flow double, peak_flow double, previous_end long"
)
_EMPTY = ([], [], [], 0, None, None, 0.0, 0.0, 0.0, 0.0, None)


def numbered_storms(bins: DataFrame, interevent_hours: float = 6, period_minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """Storms of a stream of regular bins, one row each when it closes, numbered per site from 1.

    The rows are those of the batch storm statistics, as far as a stream of
    bins has them. Bins may come in any order up to ``late``; later ones are
    left out. The state of a site is its running storm, the last number and the
    bins younger than the watermark: it does not grow with the record. A storm
    closes when the watermark passes the last moment at which a bin could still
    belong to it, whether or not the site sends anything.
    """
    workers.ship(bins.sparkSession)
    gap, period = round(interevent_hours * 3.6e9), round(period_minutes * 6e7)

    def closed(site: str, s: dict) -> tuple:
        end = s["last"] + period
        dry = None if s["previous_end"] is None else (s["start"] - s["previous_end"]) / 8.64e10
        wet = s["peak_flow"] > 0
        return (
            site, s["number"], pd.Timestamp(s["start"], unit="us"), pd.Timestamp(end, unit="us"), (end - s["start"]) / 3.6e9, dry,
            s["rain"], s["peak_rain"] * 60 / period_minutes,
            s["flow"] * 60 * period_minutes / LITERS_PER_CUBICMETER if wet else None, s["peak_flow"] if wet else None,
        )

    def follow(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(_NAMES, state.get if state.exists else _EMPTY))
        waiting = list(zip(s["times"], s["rains"], s["flows"]))
        for batch in batches:
            waiting += zip(batch["micros"].tolist(), batch["rain"].tolist(), batch["flow"].tolist())
        waiting.sort()
        now = state.getCurrentWatermarkMs() * 1000
        rows = []
        done = 0
        for micros, rain, flow in waiting:
            if micros >= now:
                break
            done += 1
            if s["last"] is None or micros - s["last"] > gap:
                if s["last"] is not None:
                    rows.append(closed(key[0], s))
                    s["previous_end"] = s["last"] + period
                s |= {"number": s["number"] + 1, "start": micros, "rain": 0.0, "peak_rain": 0.0, "flow": 0.0, "peak_flow": 0.0}
            s["last"] = micros
            for total, peak, v in (("rain", "peak_rain", rain), ("flow", "peak_flow", flow)):
                s[total], s[peak] = s[total] + v, max(s[peak], v)
        waiting = waiting[done:]
        if s["last"] is not None and now > s["last"] + gap:
            rows.append(closed(key[0], s))
            s |= {"previous_end": s["last"] + period, "last": None}
        s["times"], s["rains"], s["flows"] = (list(c) for c in zip(*waiting)) if waiting else ([], [], [])
        state.update(tuple(s[n] for n in _NAMES))
        # called again when the watermark has passed the oldest waiting bin, or the running storm
        due = [t for t in ([waiting[0][0]] if waiting else []) + ([s["last"] + gap] if s["last"] is not None else [])]
        if due:
            state.setTimeoutTimestamp(max(min(due), now) // 1000 + 1)
        yield pd.DataFrame(rows, columns=_COLUMNS)

    wet = with_flow_columns(bins).filter(is_wet()).withWatermark("ts", late)
    picked = wet.select(
        "site", "ts", F.unix_micros("ts").alias("micros"),
        F.coalesce("precip_mm", F.lit(0.0)).alias("rain"), F.coalesce("flow_lps", F.lit(0.0)).alias("flow"),
    )
    return picked.groupBy("site").applyInPandasWithState(follow, _STORM, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


_NAMES = [f.split()[0] for f in _STATE.split(", ")]
_COLUMNS = [f.split()[0] for f in _STORM.split(", ")]


def samples_in_storms(
    samples: DataFrame, storms: DataFrame, lookback_hours: float = 0, late: str = "1 hour", storm_late: str = "30 days"
) -> DataFrame:
    """Streamed samples with the storm they fall in, each sample once.

    ``samples`` has ``site`` and ``samplestart``, ``storms`` is a stream of
    closed storms (:func:`numbered_storms`). A sample belongs to the storm that
    was the last to start before it, if it was taken until ``lookback_hours``
    after its end; storms of a site are farther apart than that, so this is an
    interval join. A sample without a storm comes, with a null number, once the
    watermarks of both sides show that none can follow. ``storm_late`` bounds
    how long a storm lasts, since a storm arrives after its end.
    """
    hours = f"INTERVAL {round(lookback_hours * 3600)} SECONDS"
    of_storm = storms.select(
        F.col("site").alias("_site"), F.col("storm_number"), F.col("start_date").alias("_start"), F.col("end_date").alias("_end")
    ).withWatermark("_start", storm_late)
    taken = samples.withWatermark("samplestart", late)
    inside = F.expr(f"""site = _site AND samplestart >= _start AND samplestart <= _end + {hours}
        AND samplestart <= _start + INTERVAL {storm_late} + {hours}""")
    return taken.join(of_storm, inside, "left_outer").select(*samples.columns, "storm_number")
