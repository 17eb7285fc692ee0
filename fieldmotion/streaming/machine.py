"""Running a per-frame step function over clips, as a stream or as a batch.

A step is ``step(state, frame_idx, rows) -> list of output dicts``: it gets the clip's
state (a dict, changed in place) and one frame's rows as arrays by column. Frames arrive in
order. A stream holds the newest frame back until a later one arrives, since more of its
rows may come; rows of a frame that was already stepped are late: they give one output row
with their number in ``n_late`` and nothing else. A row with frame_idx END_FRAME ends its
clip and sets the held frame free; so does a true WHOLE on any row.

A ``Walk`` takes many frames of a clip in one call, where that is cheaper than one by one;
``Blocks`` gives columns for them, where a frame has many rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from fieldmotion.operators.reliable import spread

Step = Callable[[dict, int, Mapping[str, np.ndarray]], list[dict]]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END_FRAME = 2**31 - 1
WHOLE = "input_is_whole"  # a stream renames columns that start with an underscore


@dataclass(frozen=True)
class Walk:
    """``run(state, frames, starts, rows)`` gives one output dict a frame, in order; frame i
    has the rows from starts[i] up to starts[i + 1]."""

    run: Callable[[dict, list[int], list[int], Mapping[str, np.ndarray]], Iterator[dict]]


@dataclass(frozen=True)
class Blocks:
    """Like ``Walk``, with any number of output rows a frame: ``run`` gives the rows of each
    frame, in order, as (number of rows by frame, {column: values})."""

    run: Callable[[dict, list[int], list[int], Mapping[str, np.ndarray]], tuple[list[int], dict]]


def _columns(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema + ", n_late int")


def advance(step: Step | Walk | Blocks, state: dict, clip: str, rows: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """Feed rows of one clip, frame by frame, to the step."""
    out: list[dict] = []
    if not len(rows):
        return pd.DataFrame(columns=names)
    frames = rows["frame_idx"].to_numpy()
    order = np.argsort(frames, kind="stable")
    frames, columns = frames[order], {c: rows[c].to_numpy()[order] for c in rows.columns}
    starts = np.flatnonzero(np.append(True, frames[1:] != frames[:-1])).tolist()
    numbers, bounds = frames[starts].tolist(), [*starts, len(frames)]
    n_late = int(np.searchsorted(numbers, state.get("last_frame", -1), side="right"))
    out += [{"clip": clip, "frame_idx": int(f), "n_late": e - s} for f, s, e in zip(numbers[:n_late], bounds, bounds[1:])]
    numbers, bounds = [int(f) for f in numbers[n_late:]], bounds[n_late:]
    if isinstance(step, Blocks):
        if not numbers:
            return pd.DataFrame({n: [r.get(n) for r in out] for n in names})
        counts, values = step.run(state, numbers, bounds, columns)
        state["last_frame"] = numbers[-1]
        block = pd.DataFrame({**values, "clip": clip, "frame_idx": np.repeat(np.array(numbers, np.int32), counts), "n_late": np.zeros(sum(counts), np.int32)}, columns=names)
        if not out:
            return block
        out += block.astype(object).replace({pd.NA: None}).to_dict("records")
    elif isinstance(step, Walk):
        for frame, row in zip(numbers, step.run(state, numbers, bounds, columns), strict=True):
            out.append({**row, "clip": clip, "frame_idx": frame, "n_late": 0})
        state["last_frame"] = numbers[-1] if numbers else state["last_frame"]
    else:
        for frame, s, e in zip(numbers, bounds, bounds[1:]):
            state["last_frame"] = frame
            for row in step(state, frame, {c: v[s:e] for c, v in columns.items()}):
                row["clip"], row["frame_idx"], row["n_late"] = clip, frame, 0
                out.append(row)
    return pd.DataFrame({n: [r.get(n) for r in out] for n in names})


def _plain(v):
    return v.tolist() if hasattr(v, "tolist") else str(v)


class ClipProcessor(StatefulProcessor):
    """One clip's state: small values as JSON, identities by (kind, slot), the open frame's rows.

    A clip idle for ``idle_ms`` steps its open frame and is forgotten; identities expire
    by themselves after that time as well.
    """

    def __init__(self, step: Step | Walk | Blocks, names: list[str], idle_ms: int | None):
        self.step, self.names, self.idle_ms = step, names, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("clip_state", "state string")
        self.bank = handle.getMapState("identities", "kind string, slot int", "first int, n int, last int, u double, v double", self.idle_ms)
        self.open = handle.getListState("open_frame", "row string")

    def _load(self) -> dict:
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else {}
        bank = {f"{kind}|{slot}": {"first": first, "n": n, "last": last, "at": [u, v]} for (kind, slot), (first, n, last, u, v) in self.bank.iterator()} if self.bank.exists() else {}
        return {**state, "bank": bank} if bank else state

    def _save(self, state: dict, before: dict) -> None:
        bank = state.pop("bank", {})
        entry = lambda t: (t["first"], t["n"], t["last"], *t["at"])
        name = lambda k: (k.rsplit("|", 1)[0], int(k.rsplit("|", 1)[1]))
        for k in before.keys() - bank.keys():
            self.bank.removeKey(name(k))
        for k, t in bank.items():
            if before.get(k) != entry(t):
                self.bank.updateValue(name(k), entry(t))
        self.kept.update((json.dumps(state, default=_plain),))

    def _step(self, clip: str, rows: pd.DataFrame) -> pd.DataFrame:
        state = self._load()
        before = {k: (t["first"], t["n"], t["last"], *t["at"]) for k, t in state.get("bank", {}).items()}
        out = advance(self.step, state, clip, rows, self.names)
        self._save(state, before)
        return out

    def _held(self) -> list[dict]:
        return [json.loads(r[0]) for r in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        ended = bool((batch["frame_idx"] == END_FRAME).any())
        if WHOLE in batch:
            ended |= bool(batch.pop(WHOLE).fillna(False).any())
        batch = batch[batch["frame_idx"] != END_FRAME]
        held = self._held()
        if held:
            batch = pd.concat([pd.DataFrame(held, columns=batch.columns), batch], ignore_index=True)
        newest = batch["frame_idx"].max() if len(batch) and not ended else None
        late = newest is not None and self.kept.exists() and newest <= json.loads(self.kept.get()[0]).get("last_frame", -1)
        rest = batch[batch["frame_idx"] == newest] if newest is not None and not late else batch[:0]
        ready = batch.drop(rest.index)
        self.open.clear()
        if len(rest):
            self.open.put([(json.dumps(r, default=_plain),) for r in rest.to_dict("records")])
        if self.idle_ms:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._step(key[0], ready)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held:
            yield self._step(key[0], pd.DataFrame(held))
        self.kept.clear()
        self.bank.clear()
        self.open.clear()

    def close(self) -> None:
        pass


def run_stream(rows: DataFrame, step: Step | Walk | Blocks, schema: str, idle_ms: int | None = None) -> DataFrame:
    """Streaming output of the step over a stream of rows with clip and frame_idx.

    ``idle_ms`` sets a processing-time timer per clip; it keeps the query running, so use
    it with a continuous trigger, not with ``availableNow``. The query must be started
    with the state store of ``keyed_state``.
    """
    out = _columns(schema)
    return rows.groupBy("clip").transformWithStateInPandas(
        statefulProcessor=ClipProcessor(step, out.fieldNames(), idle_ms), outputStructType=out,
        outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None")


@contextmanager
def keyed_state(spark: SparkSession):
    """Start queries inside with the state store that keyed states need; the session keeps its own."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def complete(rows: DataFrame) -> DataFrame:
    """The rows of an input that is complete, each saying so, which costs no row more."""
    return rows.withColumn(WHOLE, F.lit(True))


def closed(rows: DataFrame) -> DataFrame:
    """The rows and an end mark with each of them, for input that is complete."""
    marks = F.explode(F.array(F.lit(False), F.lit(True))).alias("_end")
    kept = [F.when(~F.col("_end"), F.col(f"`{c}`")).alias(c) for c in rows.columns if c not in ("clip", "frame_idx")]
    both = rows.select("*", marks)
    return both.select("clip", F.when(F.col("_end"), F.lit(END_FRAME)).otherwise(F.col("frame_idx")).cast("int").alias("frame_idx"), *kept).select(*rows.columns)


def run_batch(rows: DataFrame, step: Step | Walk | Blocks, schema: str) -> DataFrame:
    """Batch twin: clips are hashed to partitions and read in frame order as Arrow
    batches, so a task holds one frame and one clip's state, never a whole clip."""
    out = _columns(schema)
    names = out.fieldNames()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clip, state, rest = None, {}, None
        for batch in batches:
            data = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            # the last frame may go on in the next batch
            tail = (data["clip"] == data["clip"].iloc[-1]) & (data["frame_idx"] == data["frame_idx"].iloc[-1])
            rest, whole = data[tail], data[~tail]
            for name, part in whole.groupby("clip", sort=False):
                if name != clip:
                    clip, state = name, {}
                yield advance(step, state, clip, part, names)
        if rest is not None and len(rest):
            if rest["clip"].iloc[0] != clip:
                clip, state = rest["clip"].iloc[0], {}
            yield advance(step, state, clip, rest, names)

    ordered = spread(rows, "clip").sortWithinPartitions("clip", "frame_idx")
    return ordered.mapInPandas(walk, out)


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over everything available into parquet files and read them back."""
    with keyed_state(stream.sparkSession):
        query = (stream.writeStream.format("parquet").option("path", f"{path}/out")
                 .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
