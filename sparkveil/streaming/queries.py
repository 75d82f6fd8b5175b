"""Streaming queries run over the events as a file stream, until all that is there has been read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans import scratch
from ..sources import table
from . import state


def _run(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    base = f"{scratch.shared_dir(spark).rstrip('/')}/sparkveil-stream-{uuid.uuid4().hex}"
    scratch.own(spark, base)
    out = make(source)
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def stream_session_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, state.session_steps).selectExpr("event_id", "k AS user_id", "step")


def stream_nonce_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, lambda e: state.nonce_replay(e, seconds=3600)).selectExpr("event_id", "k AS user_id", "accepted")


QUERIES = {"stream_session_steps": stream_session_steps, "stream_nonce_replay": stream_nonce_replay}
from ..operators.state import ORACLE as _BATCH  # noqa: E402

ORACLE = {"stream_session_steps": f"SELECT event_id, user_id, step FROM ({_BATCH['session_steps']})", "stream_nonce_replay": _BATCH["nonce_replay"]}
