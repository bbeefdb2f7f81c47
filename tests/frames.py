"""Small tables that several tests share."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from sondeflow.schema import MEASURES, PHYSICAL_RULES, RAW_TO_CLEAN

#: Our own readings: when they start, their first number, and how many there are.
START, FIRST, ROWS = datetime(2021, 2, 27, 3), 5000, 360


def plausible(name: str) -> tuple[float, float]:
    """A range inside the physical limits of the measure, from 5 to 95 % of them."""
    limits = [(r.low, r.high) for r in PHYSICAL_RULES if RAW_TO_CLEAN[name] in r.columns]
    low = max((low for low, _ in limits if low is not None), default=0)
    high = min((high for _, high in limits if high is not None), default=low + 40)
    return low + 0.05 * (high - low), high - 0.05 * (high - low)


def raw_frame(n: int = ROWS, hours: int = 15) -> pd.DataFrame:
    """Readings under raw headers: fixed seed, text timestamps, empty flags."""
    random = np.random.default_rng(7)
    measures = [name for name, clean_name in RAW_TO_CLEAN.items() if clean_name in MEASURES]
    frame = pd.DataFrame({
        "Timestamp": [str(START + timedelta(hours=hours * i)) for i in range(n)],
        "Record number": np.arange(FIRST, FIRST + n),
        **{name: random.uniform(*plausible(name), n).round(4) for name in measures},
    })
    for name in RAW_TO_CLEAN:
        if name.endswith("[quality]"):
            frame[name] = np.nan
    return frame[list(RAW_TO_CLEAN)]


def to_spark(spark, frame: pd.DataFrame):
    return spark.createDataFrame(frame)


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def series(spark, days, name="value", type_="double"):
    """A daily series from (iso date, value) pairs."""
    return spark.createDataFrame(
        [(pd.Timestamp(d).date(), v) for d, v in days], f"date date, {name} {type_}"
    )


def readings(spark, pairs):
    """Readings from (iso time, value) pairs, numbered in the order given."""
    data = [
        (i, None if t is None else pd.Timestamp(t).to_pydatetime(), None if v is None else float(v))
        for i, (t, v) in enumerate(pairs)
    ]
    return spark.createDataFrame(data, "record_number bigint, timestamp timestamp_ntz, value double")
