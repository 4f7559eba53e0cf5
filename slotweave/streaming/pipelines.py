"""Structured Streaming pipelines: slots, sliding windows, deduplication, late panes and the notification rule as keyed state.

Each reads a folder of files with ``availableNow`` and writes a Parquet table; checkpoint, sink and feed lie in the shared folder
``spark.checkpoint.dir`` of the session and belong to the run: ``feed`` plays a table in as files in order of arrival, one micro-batch after another, so late rows
do meet state of earlier batches. Watermarks bound all state but the rule's (one small row a station).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slotweave.functions.timeexpr import MICROS, floor_us, instant, micros
from slotweave.operators import matching
from slotweave.runtime import shared_folder
from slotweave.sources import store


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table as a stream of files, in the schema of the files that lie there."""
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{base}/{name}.parquet*")


def start(stream: DataFrame, at: str, mode: str, sink: Callable[[DataFrame, int], None] | None = None):
    """Run to the end of what is there; the batches go to ``sink``, or with their number to the table ``at/sink``."""

    def write(batch: DataFrame, number: int) -> None:
        # a batch that runs again replaces itself
        batch.write.mode("overwrite").parquet(f"{at}/sink/batch={number}")

    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    q = w.foreachBatch(sink or write).start()
    q.awaitTermination()
    return q


def written(stream: DataFrame, at: str) -> DataFrame:
    """The table written, with the number of the batch each row came in."""
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return stream.sparkSession.read.schema(schema).parquet(f"{at}/sink")


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of what is there and read the result."""
    at = scratch(stream.sparkSession)
    start(stream, at, mode)
    return written(stream, at).drop("batch")


def feed(
    rows: DataFrame, arrival: Column, build: Callable[[DataFrame], DataFrame], *, parts: int = 4, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None, progress: list | None = None
) -> DataFrame:
    """Play ``rows`` in, in order of arrival (microseconds) and ``parts`` files, and run the stream ``build`` makes of them on after each; the rows written, with their ``batch``.

    The borders are quantiles of the arrival (a few numbers on the driver). Rows without arrival never arrive. ``progress`` takes the last progress of each run.
    """
    spark, at = rows.sparkSession, scratch(rows.sparkSession)
    timed = rows.withColumn("__at", arrival).where("__at is not null")
    inner = timed.approxQuantile("__at", [k / parts for k in range(1, parts)], 0.001)
    borders = [float("-inf"), *sorted(set(inner)), float("inf")]
    stream = build(spark.readStream.schema(rows.schema).parquet(f"{at}/in/*"))
    for k, (lo, hi) in enumerate(zip(borders, borders[1:])):
        timed.where((F.col("__at") > lo) & (F.col("__at") <= hi)).drop("__at").write.parquet(f"{at}/in/part{k}")
        q = start(stream, at, mode, sink)
        if progress is not None:
            progress.append(q.lastProgress)
    return stream if sink else written(stream, at)


def latest(emitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key the row of the last batch (``update`` mode publishes a key whenever it changes)."""
    return store.dedupe_last(emitted, keys, [F.col("batch")]).drop("batch")


def slot_counts(obs: DataFrame, cutoff_min: int = 1440) -> DataFrame:
    """Tumbling hours of event time per station and parameter: readings, known values and total, of deliveries up to ``cutoff_min`` after the hour.

    The watermark runs two cut-offs behind the newest reading, so no delivery within the cut-off comes too late for it, and state of older hours is dropped.
    """
    us = micros("observed_utc")
    end = floor_us(us, 3600 * MICROS) + F.lit((60 + cutoff_min) * 60 * MICROS)
    o = obs.where(F.coalesce(micros("created_utc"), us) <= end).withWatermark("observed_utc", f"{2 * cutoff_min} minutes")
    g = o.groupBy(F.window("observed_utc", "1 hour").alias("w"), "station_id", "parameter_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_known"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))
    return g.select("station_id", "parameter_id", micros(F.col("w.start")).alias("hour_us"), "n", "n_known", "total")


def sliding_counts(warned: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Windows of thirty minutes every ten: warnings per station (a ring buffer of recent events)."""
    g = warned.withWatermark("warned_at_utc", watermark).groupBy(F.window("warned_at_utc", "30 minutes", "10 minutes").alias("w"), "station_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("station_id", micros(F.col("w.start")).alias("from_us"), "n")


def first_deliveries(obs: DataFrame, watermark: str = "3 days") -> DataFrame:
    """The first delivery of each key within the watermark, for consumers that cannot take a row back."""
    return obs.withWatermark("observed_utc", watermark).dropDuplicatesWithinWatermark(["station_id", "observed_utc", "parameter_id"])


def last_deliveries(path: str, keys: Sequence[str], order: Sequence[Column], partition: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps a table with the last delivery of each key: every batch is merged into the partitions it touches; a batch that runs again changes nothing."""
    return lambda batch, number: store.append_idempotent(batch.sparkSession, path, batch, keys, order, partition)


RULE_STATE = "armed boolean, streak int, below long, seen long, notified boolean, calm int, cleared boolean"
ACTION = "station_id string, row_id long, us long, action string"


def rule_step(threshold: float, rule: matching.Rule = matching.Rule()) -> Callable:
    """The notification rule as a keyed state function; rows of a batch are taken in order of time, stale ones do nothing."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(matching.STATE, state.get)) if state.exists else matching.fresh()
        rows = pd.concat(list(batches)).sort_values(["us", "row_id"])
        out = []
        for r in rows.itertuples(index=False):
            a = matching.step(s, int(r.us), None if pd.isna(r.p) else float(r.p), bool(r.raining), threshold, rule)
            if a != "none":
                out.append((key[0], int(r.row_id), int(r.us), a))
        state.update(tuple(s[k] for k in matching.STATE))
        yield pd.DataFrame(out, columns=["station_id", "row_id", "us", "action"])

    return work


def decide(decisions: DataFrame, threshold: float) -> DataFrame:
    """``decisions``: ``station_id, us, row_id, p, raining`` as a stream; a row per action."""
    return decisions.groupBy("station_id").applyInPandasWithState(rule_step(threshold), ACTION, RULE_STATE, "append", GroupStateTimeout.NoTimeout)


PANE_STATE = "event_us array<long>, arrival_us array<long>, ids array<long>, amounts array<long>"
PANE = "station_id string, pane_us long, n long, amount long, arrived_us long"
_COLS = ["event_us", "arrival_us", "id", "amount"]


def pane_step(cutoff_us: int, pane_us: int, block_us: int) -> Callable:
    """Keeps the readings of a block of panes; emits count and total of every pane that a batch changes; forgets a pane when the watermark of arrival has passed its cut-off, with the last one the block."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = [np.asarray(x, np.int64) for x in state.get] if state.exists else [np.zeros(0, np.int64)] * len(_COLS)
        rows = pd.concat([b[_COLS] for b in batches])
        new = [rows[c].to_numpy(np.int64) for c in _COLS]
        # of a key's deliveries the one arrived last counts, then the greater id
        held = [np.concatenate(x) for x in zip(old, new)]
        order = np.lexsort(held[2::-1])
        order = order[np.r_[held[0][order][1:] != held[0][order][:-1], True]]
        held = [x[order] for x in held]
        panes, at = np.unique(new[0] // pane_us, return_inverse=True)

        def totals(x: list[np.ndarray]) -> np.ndarray:
            k = np.searchsorted(panes, x[0] // pane_us)
            ok = panes[np.minimum(k, len(panes) - 1)] == x[0] // pane_us
            out = np.zeros((2, len(panes)), np.int64)
            np.add.at(out, (0, k[ok]), 1)
            np.add.at(out, (1, k[ok]), x[3][ok])
            return out

        n, amount = totals(held)
        changed = ((n, amount) != totals(old)).any(0)
        arrived = np.full(len(panes), np.iinfo(np.int64).min)
        np.maximum.at(arrived, at, new[1])
        passed = state.getCurrentWatermarkMs()
        open_ = held[0] // pane_us * pane_us + cutoff_us >= passed * 1000
        state.update(tuple(x[open_].tolist() for x in held))
        state.setTimeoutTimestamp(max((int(key[1]) + block_us - pane_us + cutoff_us) // 1000, passed + 1))
        if changed.any():
            yield pd.DataFrame({"station_id": key[0], "pane_us": panes[changed] * pane_us, "n": n[changed], "amount": amount[changed], "arrived_us": arrived[changed]})

    return work


def live_panes(obs: DataFrame, pane_min: int = 60, cutoff_min: int = 1440, block: int = 24) -> DataFrame:
    """Hourly panes of rain as keyed state: only panes a batch touches are worked on and emitted; rows after the cut-off are dropped, and so is the state then.

    A state holds the panes of a ``block``, as a call costs more than a pane. The watermark is on arrival, so rows must come in order of it (but for ten minutes).
    """
    v, us = F.col("value").cast("double"), micros("observed_utc")
    pane_us = pane_min * 60 * MICROS
    rows = obs.where("parameter_id = 'precip_past10min' and value is not null and not isnan(value) and station_id is not null and observed_utc is not null").select(
        "station_id", floor_us(us, pane_us * block).alias("block_us"), us.alias("event_us"), F.coalesce(micros("created_utc"), us).alias("arrival_us"), F.col("obs_id").alias("id"), F.round(F.greatest(v, F.lit(0.0)) * 10).cast("long").alias("amount")
    )
    reach = pane_us + cutoff_min * 60 * MICROS
    rows = rows.where(F.col("arrival_us") <= floor_us(F.col("event_us"), pane_us) + F.lit(reach)).withColumn("arrived", instant(F.col("arrival_us"))).withWatermark("arrived", "10 minutes")
    return rows.groupBy("station_id", "block_us").applyInPandasWithState(pane_step(reach, pane_us, pane_us * block), PANE, PANE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
