"""Live capture as Structured Streaming: fragments of sessions to whole interactions, appended as they end.

The producers' hooks write event rows; the engine begins where these land. State is one list of fragments a
session, in the state store; a session is given out when a fragment ends it, or when nothing came for ``idle``.
A query that stops and starts again goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import formats
from ..schema import MESSAGES

EVENT = f"session string, seq long, messages {MESSAGES}, iterations int, max_iter int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FINAL = "Final Answer:"


def ends(iterations: Column, max_iter: Column, messages: Column) -> Column:
    """A fragment that completes its session: the last iteration allowed, or a final answer in its last message."""
    last = F.coalesce(F.try_element_at(messages, F.lit(-1))["content"], F.lit(""))
    return F.coalesce(iterations >= max_iter, F.lit(False)) | last.contains(FINAL)


def session_key(crew: Column, agent: Column, task: Column) -> Column:
    """crew:agent:task, without the crew if there is none."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return F.concat_ws(":", F.nullif(crew, F.lit("")), known(agent), known(task))


def merged(messages: Column) -> Column:
    """The messages of fragments in order; a message that was there before, by role, content and tool, is left out."""
    return F.array_distinct(F.flatten(messages))


def merge_batch(events: DataFrame) -> DataFrame:
    """(session, segment, messages, complete): the same in batch, with a segment for each completion."""
    from ..operators.conversation import segments

    e = events.withColumn("__end", ends(F.col("iterations"), F.col("max_iter"), F.col("messages")))
    e = segments(e, "session", ["seq"], F.col("__end"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "messages"))), lambda x: x["messages"])
    return e.groupBy("session", "segment").agg(merged(parts).alias("messages"), F.max("__end").alias("complete"))


def _processor(idle_ms: int):
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

    class Sessions(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            shape = StructType([StructField("seq", LongType()), StructField("part", StringType())])
            self.handle = handle
            self.parts = handle.getListState("parts", shape)
            self.count = handle.getValueState("segment", StructType([StructField("n", LongType()), StructField("open", BooleanType())]))

        def _out(self, key, parts: list[tuple[int, str]], complete: bool) -> pd.DataFrame:
            n = self.count.get()[0] if self.count.exists() else 0
            self.count.update((n + 1, False))
            text = "[" + ",".join(p for _, p in sorted(parts)) + "]"
            return pd.DataFrame({"session": [key[0]], "segment": [n], "parts": [text], "complete": [complete]})

        def _held(self) -> list[tuple[int, str]]:
            return [(r[0], r[1]) for r in self.parts.get()] if self.parts.exists() else []

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            fresh, ended = [], False
            for pdf in rows:
                for seq, part, end in sorted(pdf[["seq", "part", "end"]].itertuples(index=False, name=None)):
                    fresh.append((int(seq), part))
                    if end:
                        yield self._out(key, fresh if ended else self._held() + fresh, True)
                        fresh, ended = [], True
            if ended:
                self.parts.clear()
            if fresh:  # what was there before is neither read nor written again
                self.parts.appendList(fresh)
            for t in list(self.handle.listTimers()) if idle_ms else ():
                self.handle.deleteTimer(t)
            if idle_ms and self.parts.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)

        def handleExpiredTimer(self, key, timerValues, expired) -> Iterator[pd.DataFrame]:
            held = self._held()
            if held:
                self.parts.clear()
                yield self._out(key, held, False)

        def close(self) -> None:
            return

    return Sessions()


def merge_stream(events: DataFrame, idle_ms: int = 0) -> DataFrame:
    """(session, segment, messages, complete) of a stream of EVENT rows, each session as it ends. idle_ms also
    gives out, marked incomplete, what has waited so long, and needs a trigger by time; 0 keeps it until it ends."""
    end = ends(F.col("iterations"), F.col("max_iter"), F.col("messages"))
    flat = events.select("session", "seq", F.to_json("messages").alias("part"), end.alias("end"))
    out = flat.groupBy("session").transformWithStateInPandas(statefulProcessor=_processor(idle_ms), outputStructType="session string, segment long, parts string, complete boolean", outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None")
    parts = F.from_json("parts", f"array<{MESSAGES}>")
    return out.select("session", "segment", merged(parts).alias("messages"), "complete")


def pending(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session, messages, complete) of the sessions that a stopped merge_stream query has not given out, from its
    checkpoint: what there is to flush when no more will come. It changes nothing; a query that goes on has them."""
    rows = spark.read.format("statestore").option("stateVarName", "parts").load(checkpoint)
    parts = F.array_sort(F.collect_list(F.struct("seq", "part")))
    held = rows.select("key.session", "list_element.seq", "list_element.part").groupBy("session").agg(F.transform(parts, lambda x: F.from_json(x["part"], MESSAGES)).alias("parts"))
    return held.select("session", merged(F.col("parts")).alias("messages"), F.lit(False).alias("complete"))


def without_chunks(events: DataFrame, kind: str = "event_type", include: bool = False) -> DataFrame:
    """Events less the pieces of streamed answers."""
    return events if include else events.where(~F.lower(kind).contains("chunk"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last snapshot of each key, as a running aggregate for update or complete output."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__r")).select(key, "__r.*")


def start(interactions: DataFrame, path: str, checkpoint: str, format_name: str = "openai_chat", every: str | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Formats and appends as batches end. Each batch has a folder of its own, written over if the batch is
    repeated, so a record is stored once. Without ``every`` it takes what is there and stops."""

    def flush(batch: DataFrame, number: int) -> None:
        out = formats.formatted(batch, format_name, **({"key": F.concat_ws(":", "session", "segment")} if format_name in ("openai_chat", "preference") else {})).select("value")
        out.write.mode("overwrite").text(f"{path}/batch={number}")

    writer = interactions.writeStream.foreachBatch(sink or flush).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
