"""Stateful streams: the live follower, the noise gate, the latest value per key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.listening import DIM, Follower, Reference, noise_gate, normalize

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FollowProcessor(StatefulProcessor):
    """Frames of a take in, its cursor out. State: the mass vector and five scalars."""

    def __init__(self, ref: Reference):
        self.ref = ref

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("follower", "alpha binary, started boolean, position int, display int, target int, held int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        f = Follower(self.ref, tuple(self.store.get()) if self.store.exists() else None)
        pdf = pd.concat(list(rows)).sort_values("t")
        out = []
        for r in pdf.itertuples():
            missing = r.vec is None
            live = np.zeros(DIM) if missing else normalize(r.vec)[0]
            f.step(live, bool(r.silent) or missing)
            label = "locked" if f.confidence > 0.5 else "searching" if f.confidence > 0.15 else "lost"
            out.append((key[0], int(r.t), f.position, f.display, float(f.confidence), label))
        self.store.update(f.state)
        yield pd.DataFrame(out, columns=["take", "t", "position", "display", "confidence", "label"])

    def close(self) -> None:
        pass


def follow(frames: DataFrame, ref: Reference) -> DataFrame:
    """A stream of frames (take, t, vec, silent) to a stream of cursors. Needs RocksDB as
    the state store (``use_rocksdb``). Keys are takes, so takes run in parallel."""
    return frames.groupBy("take").transformWithStateInPandas(
        FollowProcessor(ref), outputStructType="take long, t long, position int, display int, confidence double, label string", outputMode="append", timeMode="none"
    )


class GateProcessor(StatefulProcessor):
    """Energies of a take in, silence out; the floor is the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("floor", "floor double")

    def handleInputRows(self, key, rows, timer):
        floor = self.store.get()[0] if self.store.exists() else float("inf")
        pdf = pd.concat(list(rows)).sort_values("t")
        silent, floor = noise_gate(pdf["energy"].tolist(), floor)
        self.store.update((float(floor),))
        yield pd.DataFrame({"take": key[0], "t": pdf["t"], "silent": silent})

    def close(self) -> None:
        pass


def gate_noise(frames: DataFrame) -> DataFrame:
    return frames.groupBy("take").transformWithStateInPandas(GateProcessor(), outputStructType="take long, t long, silent boolean", outputMode="append", timeMode="none")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Events per type and tumbling window of event time; rows later than ``late``
    behind the newest are dropped. Times without zone are read as UTC."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def upsert_latest(store: str, keys: list[str], order: list[str]):
    """A ``foreachBatch`` function that keeps the latest row per key in a ``LatestStore``:
    a batch writes its own rows only, and running it again changes nothing."""
    from ..sources.stores import LatestStore

    return LatestStore(store, keys, order).write
