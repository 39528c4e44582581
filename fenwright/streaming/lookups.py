"""Streams of lookup calls: rate by window with late data, and the state machine of negative answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def call_counts(calls: DataFrame, key: str, ts: str, late: str = "2 minutes", window: str = "60 seconds") -> DataFrame:
    """Calls of each key per window; calls later than `late` are dropped from closed windows."""
    w = F.window(ts, window)
    return calls.withWatermark(ts, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("calls")).select(key, F.col("window.start").alias("begin"), "calls")


def next_state(status: str, misses: int, found: bool, final_after: int = 3) -> tuple[str, int]:
    """found stays found, final stays final; a miss is flaky until the third."""
    if status in ("found", "final"):
        return status, misses
    if found:
        return "found", misses
    return ("final" if misses + 1 >= final_after else "flaky"), misses + 1


def answer_states(answers: DataFrame, key: str, final_after: int = 3) -> DataFrame:
    """The state of each key after each batch of answers (key, found), as a stateful stream."""
    kind = answers.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, misses = state.get if state.exists else ("", 0)
        for b in batches:
            for found in b["found"]:
                status, misses = next_state(status, misses, bool(found), final_after)
        state.update((status, misses))
        yield pd.DataFrame({key: [k[0]], "status": [status], "misses": [misses]})

    return answers.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string, misses int", "status string, misses int", "update", GroupStateTimeout.NoTimeout)


def answer_states_batch(answers: DataFrame, key: str, order: list[str], final_after: int = 3) -> DataFrame:
    """The same over a stored log, with aggregates only: found at all before the third miss, else by the number of misses."""
    miss_no = F.sum(F.when(F.col("found"), 0).otherwise(1))
    from pyspark.sql import Window

    before = miss_no.over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = answers.withColumn("m", before)
    ok = F.min(F.when(F.col("found") & (F.col("m") < final_after), F.col("m")))
    g = d.groupBy(key).agg(ok.alias("ok"), F.least(F.max("m"), F.lit(final_after)).alias("n"))
    return g.select(key, F.when(F.col("ok").isNotNull(), "found").when(F.col("n") >= final_after, "final").otherwise("flaky").alias("status"), F.coalesce("ok", "n").cast("int").alias("misses"))
