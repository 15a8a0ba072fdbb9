"""Stateful operators: each has a batch form, which is its definition, and a Structured Streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiforge.operators import ordered


def count_windows(rows: DataFrame, by: str, order: list[str], value: str, size: int = 10) -> DataFrame:
    """Tumbling windows of ``size`` rows in each group: (by, window, n, total, first, last), full windows only."""
    i = F.floor((F.col("_i") - 1) / size).cast("long")
    numbered = ordered.with_number(rows, by, order, "_i").withColumn("window", i)
    out = numbered.groupBy(by, "window").agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    return out.where(F.col("n") == size)


def count_windows_stream(rows: DataFrame, by: str, value: str, size: int = 10) -> DataFrame:
    """The same over a stream, in order of arrival; the state of a group is its unfinished window."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, n, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        for frame in frames:
            values = frame[value].fillna(0).to_numpy(np.float64)
            totals = np.bincount((n + np.arange(len(values))) // size, values, minlength=(n + len(values)) // size + 1)
            totals[0] += total
            full, n = divmod(n + len(values), size)
            out += [(key[0], number + i, size, round(float(totals[i]), 6)) for i in range(full)]
            number, total = number + full, float(totals[full])
        state.update((number, n, total))
        yield pd.DataFrame(out, columns=[by, "window", "n", "total"])

    kind = rows.schema[by].dataType.simpleString()
    return rows.groupBy(by).applyInPandasWithState(update, f"{by} {kind}, window long, n long, total double", "number long, n long, total double", "append", GroupStateTimeout.NoTimeout)


def sessions(rows: DataFrame, by: str, ts: str, hours: int = 24) -> DataFrame:
    """(by, session, n, begin, end): a session ends after ``hours`` without a row; rows without a time are in none."""
    before = ordered.with_row_before(rows.where(F.col(ts).isNotNull()), by, [ts], [ts])
    new = F.coalesce(F.col(ts) - F.col(f"_before.{ts}") > F.expr(f"interval '{hours}' hour"), F.lit(True)).cast("long")
    numbered = ordered.with_sum_before(before, by, [ts], new, "session")
    return numbered.groupBy(by, "session").agg(F.count("*").alias("n"), F.min(ts).alias("begin"), F.max(ts).alias("end"))


def sessions_stream(rows: DataFrame, by: str, ts: str, hours: int = 24, late: str = "1 hour") -> DataFrame:
    out = rows.withWatermark(ts, late).groupBy(by, F.session_window(ts, f"{hours} hours")).agg(F.count("*").alias("n"))
    return out.select(by, "n", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("until"))


def tumbling(rows: DataFrame, ts: str, by: str, value: str, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; with ``late`` a stream drops rows that are later than that."""
    source = rows.withWatermark(ts, late) if late else rows
    out = source.groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("begin"), by, "n", "total")


def file_states(files: DataFrame, before: DataFrame, verify_hash: bool = False) -> DataFrame:
    """(path, change) from file states (path, modified, size, hash); with ``verify_hash`` only a new hash is a change."""
    a, b = before.select("path", F.struct("modified", "size", "hash").alias("_a")), files.select("path", F.struct("modified", "size", "hash").alias("_b"))
    differs: Column = F.col("_a.hash") != F.col("_b.hash") if verify_hash else (F.col("_a.modified") != F.col("_b.modified")) | (F.col("_a.size") != F.col("_b.size"))
    change = F.when(F.col("_a").isNull(), "created").when(F.col("_b").isNull(), "deleted").when(differs, "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")
