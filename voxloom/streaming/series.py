"""Structured Streaming: windowed reductions with late data, and the balloon response as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.neighborhood import balloon_steps


def windowed_reduce(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(by, start, n, sum, avg, min, max) for tumbling or sliding windows; a stream drops rows later than the watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, late).groupBy(by, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(by, F.col("w.start").alias("start"), "n", "sum", "avg", "min", "max")


def sessions(events: DataFrame, time: str, by: str, value: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of events with no pause longer than the gap."""
    out = events.withWatermark(time, late).groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("sum"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "sum")


STATE = "s double, f double, v double, q double, mean double, t long"


def balloon_stream(inputs: DataFrame, dt: float, learn: float = 0.0) -> DataFrame:
    """(region, t, y): Euler steps of the balloon model over streamed (region, t, u), state kept per region.

    Rows of a micro-batch are taken in order of t. A row that isn't newer than its region's last
    step is dropped, as a watermark would drop it: the model can't go back.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        *now, last = state.get if state.exists else (0.0, 1.0, 1.0, 1.0, 0.0, -1)
        rows = pd.concat(list(batches)).sort_values("t")
        rows = rows[rows["t"] > last]  # what comes late can't be stepped any more
        if not len(rows):
            return
        out, now = balloon_steps(rows["u"].to_numpy(), dt, learn, tuple(now))
        state.update((*now, int(rows["t"].iloc[-1])))
        yield pd.DataFrame({"region": key[0], "t": rows["t"].to_numpy(), "y": out})

    return inputs.groupBy("region").applyInPandasWithState(step, "region long, t long, y double", STATE, "append", "NoTimeout")
