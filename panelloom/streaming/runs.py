"""Restartable runs over a stream: the twin of windows.restartable_runs with keyed state instead of a window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PANEL = "entity_id long, obs_id long, t double, v double, crossed boolean, absent boolean"
OUTPUT = "entity_id long, obs_id long, t double, run_id long, status string"
#: Buckets of entities, and what the state of one holds; both are part of a stream's progress.
BUCKETS = 4096
_STATE = {"entity": np.int64, "t": np.float64, "obs": np.int64, "run": np.int64}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Runs(StatefulProcessor):
    """State per bucket of entities: the last observation of each and the run number after it, as packed arrays by entity.

    A call takes all rows that a batch has of a bucket, so calls are bounded by the buckets and not by the entities. Rows of
    an entity are taken in the order of (t, obs_id). A row equal to the last observation is a repetition and gives nothing;
    one before it is late: it comes out with the status late and no run, and changes nothing, as runs that were given out
    stay as they are.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", ", ".join(f"{c} binary" for c in _STATE))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows)
        batch = batch.iloc[np.lexsort([batch[c].to_numpy() for c in ("obs_id", "t", "entity_id")])]
        entity, obs, t = (batch[c].to_numpy(kind) for c, kind in (("entity_id", np.int64), ("obs_id", np.int64), ("t", np.float64)))
        usable = ~batch["absent"].to_numpy(bool) & (batch["v"].to_numpy(np.float64) > 0)
        held = self.last.get() if self.last.exists() else [b""] * len(_STATE)
        known = {c: np.frombuffer(x, kind) for (c, kind), x in zip(_STATE.items(), held)}
        seen = np.isin(entity, known["entity"])
        place = np.searchsorted(known["entity"], entity[seen])
        last_t, last_obs, run = np.full(len(t), -np.inf), np.full(len(t), -(2**63)), np.zeros(len(t), np.int64)
        last_t[seen], last_obs[seen], run[seen] = known["t"][place], known["obs"][place], known["run"][place]
        late = seen & ((t < last_t) | ((t == last_t) & (obs < last_obs)))
        first = np.append(True, entity[1:] != entity[:-1])
        again = ~first & np.append(False, (t[1:] == t[:-1]) & (obs[1:] == obs[:-1]))
        taken = ~late & ~again & ~(seen & (t == last_t) & (obs == last_obs))
        steps = taken & (batch["crossed"].to_numpy(bool) | ~usable)
        upto = np.cumsum(steps)
        run += upto - (upto - steps)[first][np.cumsum(first) - 1]
        ends = np.flatnonzero(taken)
        ends = ends[np.append(entity[ends][1:] != entity[ends][:-1], True)] if len(ends) else ends
        if len(ends):
            stays = ~np.isin(known["entity"], entity[ends])
            now = {c: np.concatenate([known[c][stays], x[ends]]) for c, x in zip(_STATE, (entity, t, obs, run))}
            order = np.argsort(now["entity"])
            self.last.update(tuple(now[c][order].tobytes() for c in _STATE))
        out = late | (taken & usable)
        numbers = pd.Series(run[out]).astype("Int64").mask(late[out])
        yield pd.DataFrame({"entity_id": entity[out], "obs_id": obs[out], "t": t[out], "run_id": numbers, "status": np.where(late[out], "late", "new").astype(object)})

    def close(self) -> None:
        pass


def restartable_runs(spark: SparkSession, source: str, target: str, progress: str) -> DataFrame:
    """Appends the runs of the files in `source` that were not seen before to `target`, and returns the whole of it.

    State and offsets live in `progress`, so a later call goes on where an earlier one stopped or was interrupted. Files must
    bring an entity's rows in the order of time, or they come out as late. Rows without entity, time or number are left out.
    """
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        rows = spark.readStream.schema(PANEL).option("maxFilesPerTrigger", 64).parquet(source).where("entity_id is not null and obs_id is not null and t is not null and not isnan(t)")
        clean = rows.withColumns({"v": F.coalesce("v", F.lit(0.0)), "absent": F.coalesce("absent", F.lit(False)), "crossed": F.coalesce("crossed", F.lit(False))})
        runs = clean.withColumn("bucket", F.pmod(F.xxhash64("entity_id"), F.lit(BUCKETS)).cast("int")).groupBy("bucket").transformWithStateInPandas(Runs(), OUTPUT, "append", "none")
        runs.writeStream.format("parquet").option("path", target).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return spark.read.schema(OUTPUT).parquet(target)
