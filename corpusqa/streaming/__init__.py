"""Incremental runs: gates on the sections that changed, driven by a file stream.

``run_gate`` keeps no state: each micro-batch is compared with a snapshot table by content.
``section_changes`` keeps the digest of each section as state, so that it needs no snapshot and tells
each change once, over restarts as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusqa.operators.gates import changed_sections
from corpusqa.schemas import SECTIONS


def section_stream(spark: SparkSession, path: str) -> DataFrame:
    """Sections (corpus, seq, text) that arrive as Parquet files."""
    return spark.readStream.schema(SECTIONS).parquet(path)


def run_gate(stream: DataFrame, snapshot: str, gate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply ``gate`` to what each batch adds or changes against the snapshot; append its findings to ``out``.

    A batch that is run again (after a failure) writes its own partition again, so findings are not doubled.
    """

    def each(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(SECTIONS).parquet(snapshot)
        changed = changed_sections(before, batch, ["corpus", "seq"]).select("corpus", "seq")
        gate(batch.join(changed, ["corpus", "seq"], "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHANGES = "corpus STRING, seq BIGINT, status STRING, text STRING"


def section_changes(stream: DataFrame) -> DataFrame:
    """(corpus, seq, status, text) of sections that are new to the stream (``added``) or have another text than before (``modified``).

    Of several rows of a section in one batch the one with the greatest ``rev`` counts (a column of the stream, if it
    has one), of equal ones the greatest text; a null text counts as empty.
    """
    rev = F.col("rev").cast("bigint") if "rev" in stream.columns else F.lit(0).cast("bigint")
    rows = stream.select("corpus", F.col("seq").cast("bigint").alias("seq"), F.coalesce(rev, F.lit(0)).alias("rev"), F.coalesce("text", F.lit("")).alias("text"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        latest = max((row for part in parts for row in zip(part["rev"].tolist(), part["text"].tolist())), default=None)
        if latest is None:
            return
        digest = hashlib.md5(latest[1].encode()).hexdigest()
        known = state.get[0] if state.exists else None
        if digest != known:
            state.update((digest,))
            yield pd.DataFrame({"corpus": [key[0]], "seq": [key[1]], "status": ["added" if known is None else "modified"], "text": [latest[1]]})

    return rows.groupBy("corpus", "seq").applyInPandasWithState(step, CHANGES, "digest STRING", "append", "NoTimeout")


def run_changes(stream: DataFrame, gate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply ``gate`` to the changes of each batch and append its findings to ``out``, a folder for each batch, so that one that is run again writes its own again."""

    def each(batch: DataFrame, number: int) -> None:
        gate(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return section_changes(stream).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
