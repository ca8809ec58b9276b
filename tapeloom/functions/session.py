"""Calendar and session columns, and normalisation by time of day. Times are UTC without a zone."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .along import EPS, Along, flag

#: Fixed value: the zone of the sessions.
ZONE = "America/New_York"


def eastern(ts: Column) -> Column:
    """Wall-clock time of the sessions."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts)


def is_rth_bar(et: Column) -> Column:
    """09:30 to 16:00, both ends included."""
    return (F.hour(et) * 60 + F.minute(et)).between(570, 960)


def is_warm(et: Column) -> Column:
    """Not in the first half minute after the reopening at 17:00."""
    return ~((F.hour(et) == 17) & (F.minute(et) == 0) & (F.second(et) <= 30))


def rth_date(et: Column) -> Column:
    """The day whose session began last."""
    return F.when(F.hour(et) * 60 + F.minute(et) >= 570, F.to_date(et)).otherwise(F.date_sub(F.to_date(et), 1))


def session_flags(bars: DataFrame) -> DataFrame:
    """hour_et and is_asia, is_eu, is_rth, is_eth; is_rth here is hours 9 to 15 and replaces a column of that name."""
    h = F.hour(eastern(F.col("ts")))
    return bars.withColumns({"hour_et": h, "is_asia": flag((h >= 18) | (h < 3)), "is_eu": flag((h >= 3) & (h < 9)), "is_rth": flag((h >= 9) & (h < 16)), "is_eth": flag((h >= 16) & (h < 18))})


def session_name(hour: Column) -> Column:
    return F.when((hour >= 18) | (hour < 3), "ASIA").when(hour < 9, "EU").when(hour < 16, "RTH").otherwise("ETH")


def cyclic_minute(bars: DataFrame) -> DataFrame:
    et = eastern(F.col("ts"))
    angle = (F.hour(et) * 60 + F.minute(et)) / 1440.0 * 2.0 * math.pi
    return bars.withColumns({"minute_of_day_sin": F.sin(angle), "minute_of_day_cos": F.cos(angle)})


def bar_of_day(ts: Column, minutes: int) -> Column:
    if minutes <= 0 or 60 % minutes:
        raise ValueError(f"{minutes} minutes don't divide an hour")
    et = eastern(ts)
    return F.hour(et) * (60 // minutes) + F.floor(F.minute(et) / minutes).cast("int")


def time_of_day(by: str = "instr", bod: str = "bod", order=("ts", "seq")) -> Along:
    """Rows of one time of day, day after day."""
    return Along([by, bod], order)


def tc_zscore(a: Along, value: Column, days: int) -> Column:
    """Deviation from the mean of the same time of day over `days` days, this one included."""
    return a.zscore(value, days)


def robust_deviation(x: np.ndarray, days: int) -> np.ndarray:
    """Deviation from the rolling median of `days` values, over the median of such deviations. The windows are ordered structures that
    each row updates by one insertion and one deletion."""
    values = pd.Series(x)
    middle = values.rolling(days, min_periods=days).median()
    spread = (values - middle).abs().rolling(days, min_periods=max(2, days // 2)).median()
    return ((values - middle) / (1.4826 * spread + EPS)).to_numpy()


def session_vwap(bars: DataFrame, by: str = "instr") -> Column:
    """Volume-weighted typical price since the day began."""
    a = Along([by, "_et_date"], ["ts", "seq"])
    return a.total((F.col("high") + F.col("low") + F.col("close")) / 3.0 * F.col("volume")) / (a.total(F.col("volume")) + EPS)
