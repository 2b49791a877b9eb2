"""The session log as a stream: each session's next index is keyed state, so turns are numbered on across batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

TURN = "session_id string, seq long, question string, answer string, sources string, created_at double"
MESSAGE = "session_id string, idx long, role string, content string, sources string, created_at double"
_STORE = "spark.sql.streaming.stateStore.providerClass"


class Numbering(StatefulProcessor):
    """Turns of a session to a user's and an assistant's message each; the state is the next index and the last turn taken."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "next long, seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        now = self.state.get()
        at, last = (0, None) if now is None else (now[0], now[1])
        for r in sorted(rows, key=lambda r: r["seq"]):
            if last is not None and r["seq"] <= last:
                continue  # a turn that came again
            last = r["seq"]
            yield Row(session_id=key[0], idx=at, role="user", content=r["question"], sources="[]", created_at=r["created_at"])
            yield Row(session_id=key[0], idx=at + 1, role="assistant", content=r["answer"], sources=r["sources"] or "[]", created_at=r["created_at"])
            at += 2
        if last is not None:
            self.state.update((at, last))

    def close(self) -> None:
        pass


def messages(turns: DataFrame) -> DataFrame:
    """A stream of messages from a stream of turns (TURN). A session's turns count once each, by seq, which rises; turns without a session or seq are passed over."""
    kept = turns.filter("session_id is not null and seq is not null")
    return kept.groupBy("session_id").transformWithState(Numbering(), outputStructType=StructType.fromDDL(MESSAGE), outputMode="append", timeMode="none")


def append_sessions(spark: SparkSession, source: str, out: str, checkpoint: str, files_a_batch: int = 64) -> int:
    """Number the turns in new files of source into the message table at out; returns the messages added.

    A batch writes its own folder, over what a broken attempt left there; the state is kept with the checkpoint, so a
    run that starts again goes on where the last one ended. Needs a state store that holds typed state, which is set for
    the time of the run.
    """
    added: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/part={number}")
        added.append(spark.read.schema(MESSAGE).parquet(f"{out}/part={number}").count())

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        turns = spark.readStream.schema(TURN).option("maxFilesPerTrigger", files_a_batch).parquet(source)
        messages(turns).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return sum(added)


def read_messages(spark: SparkSession, out: str) -> DataFrame:
    """The messages that append_sessions() wrote, in no order; none where it hasn't run."""
    from ..session import path_of

    p, fs = path_of(spark, out)
    if not fs.exists(p):
        return spark.createDataFrame([], MESSAGE)
    return spark.read.schema(MESSAGE).parquet(out).select(*StructType.fromDDL(MESSAGE).names)


def latest_turn(spark: SparkSession, out: str) -> DataFrame:
    """(session_id, messages, updated_at) of the log."""
    return read_messages(spark, out).groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.max("created_at").alias("updated_at"))
