"""Functions over whole groups, many groups a call: a call for each group costs more than the work on small groups.

The rows are dealt and sorted by key; each call gets a frame of whole groups, about an Arrow batch of rows, and does the
grouping inside it with pandas. A group that goes over the ends of batches is held until it is complete, so a worker
holds a batch and a group. A null key is a group of its own (pandas needs `dropna=False`). An empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def _like_last(frame: pd.DataFrame, keys: Sequence[str]) -> pd.Series:
    """Which rows have the key of the last one."""
    out = pd.Series(True, frame.index)
    for k in keys:
        last = frame[k].iloc[-1]
        out &= frame[k].isna() if pd.isna(last) else frame[k] == last
    return out


def whole_groups(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Frames sorted by key, cut anew so that no group is in two of them."""
    held: list[pd.DataFrame] = []  # rows of one group
    for frame in frames:
        if frame.empty:
            continue
        last = _like_last(frame, keys)
        if last.all() and (not held or _like_last(pd.concat([held[0].iloc[-1:], frame.iloc[-1:]], ignore_index=True), keys).all()):
            held.append(frame)
            continue
        yield pd.concat([*held, frame[~last]], ignore_index=True)
        held = [frame[last]]
    if held:
        yield pd.concat(held, ignore_index=True)


def apply(df: DataFrame, keys: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that `function` makes of frames of whole groups."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(function, whole_groups(frames, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
