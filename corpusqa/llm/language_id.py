"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts is the number of byte n-grams (n = 1 to 4, each
order hashed into its own table of cells, A-Z lower-cased) that both have, divided by the root of
the product of their numbers.  Landmark documents give the Nystroem features of a text, a
one-versus-rest kernel ridge regression on them gives a margin for each language, and a batch of
texts is scored by two matrix products.

Defined results: a null text, or one without a letter, gets ``und`` and score 0; such rows and rows
without a label are not learned from, whatever doc_id they have; a repeated row counts as often as it
is chosen; if nothing can be learned all rows get ``und`` and 0; ties go to the
language first in order; repeated rows give repeated rows; columns of the input other than text,
``lang_pred`` and ``score`` are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_table, slices, text_buffer

UNKNOWN = "und"
#: Cells of the tables of n = 1, 2, 3, 4.
CELLS = (256, 1 << 14, 1 << 15, 1 << 15)
#: Bounds of what is learned from: rows (most evenly over the languages) and landmarks.
SAMPLE_ROWS = 1000
LANDMARKS = 96


@dataclass
class KernelModel:
    languages: list[str]
    cells: np.ndarray  #: the cells that any landmark has
    landmarks: np.ndarray  #: cells x landmarks, each column divided by the root of its number
    weights: np.ndarray  #: landmarks x languages
    sharpness: float = 6.0


def _codes(data: np.ndarray) -> list[np.ndarray]:
    """The cell of the n-gram that begins at each byte, for n = 2, 3, 4."""
    x = data.astype(np.uint32)
    two = (x[:-1] << np.uint32(8)) | x[1:]
    out = []
    for n, odd, cells in ((2, 0xC2B2AE35, CELLS[1]), (3, 0x9E3779B1, CELLS[2]), (4, 0x85EBCA77, CELLS[3])):
        if len(x) < n:
            out.append(np.zeros(0, np.int32))
            continue
        h = two[: len(x) - n + 1] * np.uint32(0x01000193) ^ (two[n - 2 : len(x) - 1] + np.uint32(n)) * np.uint32(odd)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out.append((h >> np.uint32(33 - cells.bit_length())).astype(np.int32))
    return out


def presence(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each row the table of cells, 1 where the text has such an n-gram (one reused array)."""
    cells = np.zeros(sum(CELLS), np.uint8)
    edge = np.cumsum((0, *CELLS))
    data = lower_table()[data]
    codes = _codes(data) if len(data) > 1 else [np.zeros(0, np.int32)] * 3
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        cells[:] = 0
        cells[data[a:b]] = 1
        for n, code, at in zip((2, 3, 4), codes, edge[1:]):
            if b - a >= n:
                cells[at + code[a : b - n + 1]] = 1
        yield cells


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, ridge: float = 1e-3) -> KernelModel:
    """Learn from ``text`` and ``lang`` of at most ``sample_rows`` rows of ``docs``.

    Rows are taken in the order of a hash of doc_id within each language, by turns.  They reach
    the driver as bit tables of fixed size (10 kB each), not as texts.
    """
    fit_rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", F.col("lang").alias("label"), "text", F.xxhash64("text").alias("text_hash"))
    known = fit_rows.select("doc_id", "label", "text_hash", F.xxhash64(F.col("doc_id")).alias("order"))
    # Counts by the hash's beginning tell how far each language must be read, so that no language is one task's group.
    ranged = known.withColumn("beginning", F.shiftright("order", 48))
    upto = F.sum("count").over(Window.partitionBy("label").orderBy("beginning"))
    last = ranged.groupBy("label", "beginning").count().withColumn("upto", upto).groupBy("label").agg(F.min(F.when(F.col("upto") >= sample_rows, F.col("beginning"))).alias("last"))
    known = ranged.join(F.broadcast(last), "label").where("last IS NULL OR beginning <= last")  # a row for each language, as the model has
    chosen = known.selectExpr("doc_id", "label", "text_hash", "row_number() OVER (PARTITION BY label ORDER BY order, doc_id, text_hash) AS turn")
    # The last turn that any language may need bounds the rows before the final choice.
    chosen = chosen.where(F.col("turn") <= sample_rows).orderBy("turn", "label", "doc_id", "text_hash").limit(sample_rows)
    turns = chosen.groupBy(F.col("doc_id").alias("chosen_id"), F.col("label").alias("chosen_label"), F.col("text_hash").alias("chosen_hash")).agg(F.collect_list("turn").alias("turns"))
    same = F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("label") == F.col("chosen_label")) & (F.col("text_hash") == F.col("chosen_hash"))
    picked = fit_rows.join(F.broadcast(turns), same)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [np.packbits(c).tobytes() for c in presence(*text_buffer(part.column(0)))]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *part.columns[1:]], names=["bits", "label", "turns", "doc_id", "text_hash"])

    marked = picked.select("text", "label", "turns", F.col("doc_id").cast("long"), "text_hash").mapInArrow(bits, "bits binary, label string, turns array<int>, doc_id long, text_hash long")
    # Repeated rows meet in one: each chosen row is one row of the model, however many are equal to it.
    rows = marked.groupBy("label", "doc_id", "text_hash").agg(F.first("bits").alias("bits"), F.first("turns").alias("turns")).toPandas()
    if rows.empty:
        return KernelModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    rows = rows.explode("turns").sort_values(["turns", "label", "doc_id"], kind="stable")
    unpacked = lambda part: np.stack([np.unpackbits(np.frombuffer(b, np.uint8))[: sum(CELLS)] for b in part])
    marks = unpacked(rows["bits"].iloc[:landmarks])
    cells = np.flatnonzero(marks.any(0))
    scaled = (marks[:, cells] / np.sqrt(marks.sum(1, dtype=np.int64))[:, None]).astype(np.float32)
    kernel = []
    for at in range(0, len(rows), 64):
        table = unpacked(rows["bits"].iloc[at : at + 64])
        kernel.append((table[:, cells].astype(np.float32) @ scaled.T) / np.sqrt(table.sum(1, dtype=np.int64))[:, None])
    kernel = np.concatenate(kernel).astype(np.float64)
    values, vectors = np.linalg.eigh((scaled @ scaled.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    languages = sorted(set(rows["label"]))
    label = rows["label"].to_numpy()
    target = np.where(label[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + ridge * len(features) * np.eye(features.shape[1]), features.T @ target)
    weights = (root @ solved).astype(np.float32)
    if not np.isfinite(weights).all():
        raise ArithmeticError("the kernel regression has no finite solution")
    return KernelModel(languages, cells, np.ascontiguousarray(scaled.T), weights)


def predict(docs: DataFrame, model: KernelModel) -> DataFrame:
    """Add lang_pred and score (softmax of the margins) to every row; text is left out."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded: landmarks x cells
    keep = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = KernelModel(**held.value)
        for batch in batches:
            for whole in slices(batch, "text"):
                for at in range(0, whole.num_rows, 256):
                    part = whole.slice(at, 256)
                    names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                    letters = np.array(part.column(1).to_pylist(), bool)
                    if m.languages and letters.any():
                        x = np.zeros((part.num_rows, len(m.cells)), np.float32)
                        for i, cells in enumerate(presence(*text_buffer(part.column(0)))):
                            x[i] = cells[m.cells]
                            x[i] /= np.sqrt(max(1, int(np.count_nonzero(cells))))
                        margin = (x @ m.landmarks) @ m.weights
                        odds = np.exp(m.sharpness * (margin - margin.max(1, keepdims=True)).astype(np.float64))
                        odds /= odds.sum(1, keepdims=True)
                        best = odds.argmax(1)
                        for i in np.flatnonzero(letters).tolist():
                            names[i], scores[i] = m.languages[best[i]], odds[i, best[i]]
                    yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=None, names=[*keep, "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("text").alias("text"), letters.alias("has_letter"), *(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
