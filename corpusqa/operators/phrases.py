"""Which of many phrases a text contains: an Aho-Corasick automaton, run once over each text.

The phrases are a table of any size.  While all of them are small enough for one automaton they are
sent to the tasks that read the texts, which then stay where they are.  Beyond that the phrases are cut into
shards; each text is dealt to every shard, and a task reads its shard first, builds the automaton, and
then streams its texts through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.sources import cut

#: Characters of the phrases of one automaton.
SHARD_CHARS = 1 << 21
#: Phrases up to which they are fetched before they are counted.
MOST_FORMS = 50_000
#: Bytes of text that a task holds as Python strings.
PIECE_BYTES = 1 << 20


def _automaton(forms: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for form in forms:
        out.add_word(form, form)
    out.make_automaton()
    return out


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``PIECE_BYTES`` of text (a longer text alone)."""
    edge = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(edge, edge[at] + PIECE_BYTES, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _matched(batch: pa.RecordBatch, automaton, keys: int, by_line: bool) -> pa.RecordBatch:
    """The rows of a batch (keys, text) for each phrase of each text or line."""
    at, lines, forms = [], [], []
    for i, text in enumerate(batch.column(keys).to_pylist()):
        for n, part in enumerate(text.split("\n") if by_line else [text]):
            met = {form for _, form in automaton.iter(part)}
            forms += met
            at += [i] * len(met)
            lines += [n] * len(met)
    place = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays([*(c.take(place) for c in batch.columns[:keys]), pa.array(lines, pa.int64()), pa.array(forms, pa.string())], names=[*batch.schema.names[:keys], "line", "form"])


def phrase_hits(texts: DataFrame, keys: list[str], phrases: DataFrame, text: str = "text", form: str = "form", by_line: bool = False, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(keys, line, form): each phrase of ``phrases`` that a text contains, or, with ``by_line``, each of its lines (from 0; else line is 0).

    Empty and null phrases are in no text, null texts have none; equal phrases count once.
    """
    forms = phrases.select(F.col(form).alias("form")).where("form IS NOT NULL AND form <> ''").distinct()
    few = [r[0] for r in forms.limit(MOST_FORMS + 1).collect()]
    total = sum(map(len, few)) if len(few) <= MOST_FORMS else None
    if total is None or total > shard_chars:
        forms = cut(forms)
        total = forms.agg(F.sum(F.length("form"))).first()[0]
    rows = texts.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    names = [f"k{i}" for i in range(len(keys))]
    schema = ", ".join([*(f"k{i} {texts.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)), "line long, form string"])
    n = len(keys)
    if total <= shard_chars:
        held = texts.sparkSession.sparkContext.broadcast(few if len(few) <= MOST_FORMS else [r[0] for r in forms.collect()])  # of a size checked above

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(held.value)
            for batch in batches:
                if held.value:
                    yield from (_matched(piece, automaton, n, by_line) for piece in _pieces(batch, n))

        hits = rows.mapInArrow(run, schema)
    else:
        shards = -(-total // shard_chars)
        slices = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
        slot = lambda shard, part: (shard * slices + part).cast("int").alias("slot")
        none = [F.lit(None).cast(texts.schema[k].dataType).alias(f"k{i}") for i, k in enumerate(keys)]
        parts = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part")
        listed = forms.select("form", parts).select(slot(F.pmod(F.xxhash64("form"), F.lit(shards)), F.col("part")), *none, F.lit(None).cast("string").alias("text"), "form")
        each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(*names, "text"), F.lit(slices))).select("*", each)
        dealt = dealt.select(slot(F.col("shard"), F.col("part")), *names, "text", F.lit(None).cast("string").alias("form"))
        stream = listed.unionByName(dealt).repartitionById(shards * slices, "slot").sortWithinPartitions(F.asc_nulls_last("form")).select(*names, "text", "form")

        def run_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed_forms: list[str] | None = []
            automaton = None
            for batch in batches:
                some = len(batch) - batch.column(n + 1).null_count
                if some:
                    listed_forms += batch.column(n + 1).slice(0, some).to_pylist()
                if some == len(batch):
                    continue
                if automaton is None and listed_forms:
                    automaton, listed_forms = _automaton(listed_forms), []
                if automaton is not None:
                    yield from (_matched(piece, automaton, n, by_line) for piece in _pieces(batch.slice(some), n))

        hits = stream.mapInArrow(run_shard, schema)
    return hits.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "line", "form")


def contained(texts: DataFrame, keys: list[str], phrases: DataFrame, text: str = "text", form: str = "form", **options) -> DataFrame:
    """(keys, form): each phrase that a text contains."""
    return phrase_hits(texts, keys, phrases, text, form, **options).drop("line")
