"""Cleaning a stream with statistics fitted on a batch table.

The reference has no streams. What carries over is the recipe: once fitted,
every cleaning stage and feature rule is a pure column expression or filter,
so a fitted recipe applies unchanged to a Structured Streaming DataFrame.
Full-row de-duplication on a stream needs bounded state, so it is done within
an event-time watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.features import FeatureRules
from ..plans.recipe import FittedCleaning


def clean_stream(stream: DataFrame, fitted: FittedCleaning, rules: FeatureRules | None = None,
                 event_time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Apply frozen cleaning stages (and feature rules) to ``stream``.

    A de-duplication stage is replaced by ``dropDuplicatesWithinWatermark``
    on ``event_time`` (required then), so state stays bounded.
    """
    df = stream
    for name, stage in fitted.stages:
        if name == "dedup" and stream.isStreaming:
            if not event_time:
                raise ValueError("de-duplicating a stream needs an event-time column")
            df = df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark()
        else:
            df = stage(df)
    if rules is not None:
        df, errors = rules.apply(df)
        if errors:
            raise ValueError("; ".join(errors))
    return df
