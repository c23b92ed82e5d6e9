"""The stream forms of duplicate suppression and of trains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..params import Trains

TRAINS = "src long, start_time double, end_time double, n_clicks long, mean_ici double"
STATE = "last double, start double, n long"


def distinct_within(stream: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """One row of each key within the watermark's delay; late rows go."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def train_stream(stream: DataFrame, ts: str, p: Trains, delay: str) -> DataFrame:
    """Trains of (src, t in seconds, ts as event time) as they close: by a gap outside the bounds, or by the watermark.

    A session window has no lower bound for gaps; the state is one open train per source. Rows of a micro-batch are
    ordered by t; one that is older than its train's last click starts no train and is left out.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        last, start, n = state.get if state.exists else (None, None, 0)

        def close() -> None:
            if n >= p.min_clicks:
                done.append((key[0], start, last, n, (last - start) / (n - 1) if n > 1 else 0.0))

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            for t in sorted(t for b in batches for t in b["t"]):
                if last is not None and t < last:
                    continue
                if last is not None and p.min_ici <= t - last <= p.max_ici:
                    last, n = t, n + 1
                else:
                    close()
                    last, start, n = t, t, 1
            if last is not None:
                state.update((last, start, n))
                state.setTimeoutTimestamp(max(int((last + p.max_ici) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["src", "start_time", "end_time", "n_clicks", "mean_ici"])

    rows = stream.withWatermark(ts, delay).groupBy("src")
    return rows.applyInPandasWithState(run, TRAINS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
