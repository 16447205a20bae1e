"""Accesses as a stream: windows with late data, activation kept per memory, and a sink that survives replays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.plans.shared import shared_path

_STATE = "activation double, ts_us long, n long"


def seconds(us: str) -> Column:
    return F.timestamp_micros(us)


def tumbling(a: DataFrame, length: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, n, boost): accesses by windows one after the other; start in seconds since 1970. With `late`, of a stream, rows later than that are dropped."""
    return _windowed(a, F.window("at", length), late)


def sliding(a: DataFrame, length: str = "1 day", step: str = "12 hours", late: str | None = None) -> DataFrame:
    """As tumbling, by windows that overlap."""
    return _windowed(a, F.window("at", length, step), late)


def _windowed(a: DataFrame, window: Column, late: str | None) -> DataFrame:
    a = a.withColumn("at", seconds("ts_us"))
    a = a.withWatermark("at", late) if late else a
    g = a.groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.sum("boost").alias("boost"))
    return g.select(F.unix_seconds("w.start").alias("start"), "n", "boost")


def sessions(a: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """(id, start_us, n): each memory's accesses with no gap of that length between them."""
    a = a.withColumn("at", seconds("ts_us"))
    a = a.withWatermark("at", late) if late else a
    g = a.groupBy("id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("id", F.unix_micros("w.start").alias("start_us"), "n")


def activations(a: DataFrame, first: float = 0.5, decay_rate: float = 1e-6, idle: str | None = None) -> DataFrame:
    """A stream (id, activation, ts_us, n) of each memory's state after each batch: decayed since its last access, boosted by each.

    Every memory begins at `first` with its first access. Accesses of a batch are taken in order of time; one that
    comes later than those counted already boosts without decay. idle: a memory without access for so long, by the
    watermark of that length, is forgotten: a last row with n = -1 says so, and its state is removed; else state stays.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            act, last, _ = state.get
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "activation": [act], "ts_us": [last], "n": [-1]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts_us", "event_id"])
        t, boost = rows["ts_us"].to_numpy(np.int64), rows["boost"].to_numpy(float)
        act, last, n = state.get if state.exists else (first, int(t[0]), 0)
        # decay and boost are maps a -> p * a + q, so all of a batch are one product and one sum
        seen = np.maximum.accumulate(np.append(last, t))
        log_p = np.log1p(-boost) - decay_rate * np.maximum(0, t - seen[:-1]) / 1e6
        after = np.append(np.cumsum(log_p[::-1])[::-1][1:], 0.0)
        act = min(1.0, float(act * np.exp(log_p.sum()) + (boost * np.exp(after)).sum()))
        last, n = int(seen[-1]), n + len(t)
        state.update((act, last, n))
        if idle:
            state.setTimeoutTimestamp(max(last // 1000 + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": [key[0]], "activation": [act], "ts_us": [last], "n": [n]})

    if not idle:
        return a.groupBy("id").applyInPandasWithState(update, f"id long, {_STATE}", _STATE, "update", GroupStateTimeout.NoTimeout)
    span = int(pd.Timedelta(idle).total_seconds() * 1000)
    a = a.withColumn("at", seconds("ts_us")).withWatermark("at", idle)
    return a.groupBy("id").applyInPandasWithState(update, f"id long, {_STATE}", _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def thresholds(searches: DataFrame, base: float = 0.1, keep: int = 20) -> DataFrame:
    """A stream (context, threshold, n) of the adaptive threshold of each context after its searches (context, at_us, results, words), which are taken in order of time; the last `keep` thresholds are its state."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at_us", "results", "words"])
        history, n = list(state.get[0]) if state.exists else [], state.get[1] if state.exists else 0
        for results, words in zip(rows["results"], rows["words"]):
            history = [*history, threshold(base, int(results), int(words), key[0], history)][-keep:]
        n += len(rows)
        state.update((history, n))
        yield pd.DataFrame({"context": [key[0]], "threshold": [history[-1]], "n": [n]})

    return searches.groupBy("context").applyInPandasWithState(update, "context string, threshold double, n long", "history array<double>, n long", "update", GroupStateTimeout.NoTimeout)


def threshold(base: float, results: int, words: int, context: str, history: list[float]) -> float:
    """As operators.recall.adaptive_threshold, of one search."""
    x = base * (0.5 if results < 3 else 1.5 if results > 30 else 1.2 if results > 15 else 1.0)
    x *= 0.8 if words > 6 else 0.9 if words > 3 else 1.3 if words == 1 else 1.0
    x *= {"precise": 1.4, "broad": 0.7}.get(context, 1.0)
    if len(history) > 5:
        x = (x + sum(history[-5:]) / 5) / 2
    return max(0.01, min(0.6, x))


def maintenance(ticks: DataFrame, memories, decayed, write, every: str = "60 seconds"):
    """A query that decays the store with each tick of a stream, for as long as it runs. memories() reads the table, decayed(table, seconds) gives it as of a second, write(table, number) replaces it; a tick that is run again replaces its own."""

    def step(batch: DataFrame, number: int) -> None:
        at = batch.agg(F.max("timestamp").cast("long").alias("s")).first().s
        if at is not None:
            write(decayed(memories(), at), number)

    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", shared_path(ticks.sparkSession, "maintenance")).trigger(processingTime=every)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)


def drained(df: DataFrame, name: str, mode: str, key: list[str]) -> DataFrame:
    """Run a stream over all there is and return its result: of rows with one key that of the last batch.

    Each batch is written to its own folder in the shared directory, so a batch that is run again replaces itself.
    """
    spark = df.sparkSession
    out = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", shared_path(spark, f"{name}-progress")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").parquet(out)
    rest = [c for c in found.columns if c not in key and c != "batch"]
    return found.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
